"""Ranking building blocks that stay exact and skew-safe at scale.

* ``sequence_within`` numbers rows inside groups (1-based, total order) without
  sending a whole group to one task: rows are range-partitioned on the group *and*
  order keys, so a hot group is spread over many partitions; each row's number is
  its position in its partition plus the rows of the same group in earlier
  partitions. The offsets come from a table of at most (partitions × groups) rows.
* ``dense_index`` is the same with no group: a distributed ``zipWithIndex``.
* ``top_n`` is ``row_number() <= n``; Catalyst plans a partial ``WindowGroupLimit``
  before the shuffle, so a hot group ships at most n rows per map task.
* ``global_order_topn`` ranks items for every user by one global order, in blocks
  (``functions/blocks.py``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.session import ensure_checkpoint_dir

_POS_BITS = 33  # monotonically_increasing_id: partition id in the upper 31 bits


def _as_order(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sequence_within(df: DataFrame, group_cols: list[str], order_cols: list,
                    rn: str = "rn", count: str | None = "n") -> DataFrame:
    """Add ``rn`` (1-based position by ``order_cols`` within ``group_cols``) and ``count``.

    ``order_cols`` should make the order total inside a group. The range-partitioned,
    sorted rows are checkpointed once so that positions and offsets are read from the
    same materialised data (stable under task retries and lost executors).
    """
    ensure_checkpoint_dir(df.sparkSession)
    keys = [F.col(g) for g in group_cols] + [_as_order(c) for c in order_cols]
    ranged = (df.repartitionByRange(*keys)
              .sortWithinPartitions(*keys)
              .withColumn("_mid", F.monotonically_increasing_id())
              .checkpoint(eager=True))
    pid = F.shiftright(F.col("_mid"), _POS_BITS)
    stats = (ranged.groupBy(pid.alias("_pid"), *group_cols)
             .agg(F.count(F.lit(1)).alias("_c"), F.min("_mid").alias("_m0")))
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(
        Window.unboundedPreceding, -1)
    stats = stats.withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    if count:
        stats = stats.withColumn(count, F.sum("_c").over(Window.partitionBy(*group_cols)))
    stats = stats.drop("_c")
    if not group_cols:
        # at most one row per partition: a proven size bound
        stats = F.broadcast(stats)
    out = (ranged.withColumn("_pid", pid)
           .join(stats, on=["_pid", *group_cols])
           .withColumn(rn, (F.col("_off") + F.col("_mid") - F.col("_m0") + 1).cast("long"))
           .drop("_pid", "_mid", "_m0", "_off"))
    return out


def dense_index(values: DataFrame, col: str, idx_col: str, **measures: Column) -> DataFrame:
    """Map each distinct value of ``col`` to its 0-based position in sorted order.

    ``measures``: aggregates of a value's rows, as further columns.
    """
    known = values.where(F.col(col).isNotNull())
    distinct = (known.groupBy(col).agg(*[m.alias(name) for name, m in measures.items()]) if measures
                else known.select(col).distinct())
    seq = sequence_within(distinct, [], [col], rn="_rn", count=None)
    return seq.select(col, (F.col("_rn") - 1).alias(idx_col), *measures)


def top_n(df: DataFrame, group_cols: list[str], order: list, n: int,
          rank_col: str = "rank") -> DataFrame:
    """Keep the first ``n`` rows of each group, numbered from 1."""
    w = Window.partitionBy(*group_cols).orderBy(*[_as_order(c) for c in order])
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def score_key(score: str | Column, decimals: int = 9) -> Column:
    """Ranking key: scores rounded so that float noise does not decide order."""
    s = F.col(score) if isinstance(score, str) else score
    return F.round(s, decimals)


def seen_lists(seen: DataFrame) -> DataFrame:
    """(user_idx, _seen array) — a user's distinct seen items (≤ catalogue size)."""
    return (seen.select("user_idx", "item_idx").distinct().groupBy("user_idx")
            .agg(F.collect_list("item_idx").alias("_seen")))


def global_order_topn(users: DataFrame, items: DataFrame, value_col: str, n: int,
                      seen: DataFrame, offset_col: str | None = None) -> DataFrame:
    """Top-n unseen per user when score = user offset + item value (one global order).

    ``users``: user_idx (+ ``offset_col``); ``items``: item_idx + ``value_col``. Items
    without a vector in ``blocked_topn``: nearly every user is settled by the first block.
    """
    from rankloom.functions.blocks import blocked_topn, item_blocks
    none = F.lit(None).cast("array<double>")
    asked = (users.join(seen_lists(seen), "user_idx", "left")
             .select(F.col("user_idx").alias("qid"), none.alias("vec"),
                     (F.col(offset_col) if offset_col else F.lit(0.0)).alias("off"),
                     F.lit(n).alias("n"), F.col("_seen").alias("seen")))
    ranked = blocked_topn(asked, item_blocks(items.select("item_idx", none.alias("vec"),
                                                          F.col(value_col).alias("bias"))), n)
    return ranked.withColumnRenamed("qid", "user_idx")


def spread(df: DataFrame, key: str = "user_idx", factor: int = 4) -> DataFrame:
    """Hash-partition ``df`` into ``factor × default parallelism`` parts before heavy
    per-row Python work. An explicit count is not coalesced away by AQE, which would
    otherwise fold a small key table (e.g. the user list) into a single task."""
    n = max(2, df.sparkSession.sparkContext.defaultParallelism * factor)
    return df.repartition(n, key)
