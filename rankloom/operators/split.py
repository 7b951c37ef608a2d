"""Chronological splits and the pair sets derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom import config as C
from rankloom.functions.ranking import sequence_within
from rankloom.operators import ingest

SPLIT_ORDER = ["timestamp", "item_idx", "rating"]
#: rows from which a user's are numbered over many tasks; the others' are sorted inside one
HOT_ROWS = 1_000_000


def split_roles(ratings: DataFrame, test_ratio: float = C.TEST_RATIO,
                val_ratio: float = C.VAL_RATIO) -> DataFrame:
    """D01 + D02 in one ranking pass.

    Per user, rows ordered by (timestamp, item_idx, rating): the first
    ``c1 = ⌊n·(1−test)⌋`` are train+val and the rest test; of those, the first
    ``c2 = ⌊c1·(1−val)⌋`` are train. ``role`` is train/val/test (fitting) and
    ``serve_role`` is train/test (serving keeps validation rows as seen).
    """
    return with_roles(sequence_within(ratings, ["user_idx"], SPLIT_ORDER, rn="rn", count="n"),
                      test_ratio, val_ratio)


def index_and_split(ratings: DataFrame, users: DataFrame, item_map: DataFrame,
                    hot_rows: int = HOT_ROWS) -> DataFrame:
    """Indexed ratings with their split roles; ``users`` holds each user's number of rows as ``_n``.

    The count comes with the join by user, after which a user's rows already lie together
    and are numbered where they are. Only users of more than ``hot_rows`` rows (at most
    rows / ``hot_rows``, so they are broadcast) take the way of ``split_roles``.
    """
    users = users.withColumnRenamed("_n", "n")
    hot = users.where(F.col("n") > hot_rows)
    spread = not hot.isEmpty()
    rest = ratings.join(F.broadcast(hot.select("user_id")), "user_id", "left_anti") if spread else ratings
    w = Window.partitionBy("user_id", "user_idx").orderBy(*SPLIT_ORDER)
    seq = ingest.index_ratings(rest, users, item_map).withColumn("rn", F.row_number().over(w).cast("long"))
    if spread:
        far = ingest.index_ratings(ratings, F.broadcast(hot), item_map)
        seq = seq.unionByName(sequence_within(far, ["user_idx"], SPLIT_ORDER, rn="rn", count=None))
    return with_roles(seq)


def with_roles(seq: DataFrame, test_ratio: float = C.TEST_RATIO, val_ratio: float = C.VAL_RATIO) -> DataFrame:
    """``role`` and ``serve_role`` of rows numbered ``rn`` of ``n`` within their user."""
    c1 = F.floor(F.col("n") * F.lit(1.0 - test_ratio))
    c2 = F.floor(c1 * F.lit(1.0 - val_ratio))
    return (seq.withColumn("role", F.when(F.col("rn") <= c2, "train")
                           .when(F.col("rn") <= c1, "val").otherwise("test"))
            .withColumn("serve_role", F.when(F.col("rn") <= c1, "train").otherwise("test")))


def fit_train(interactions: DataFrame) -> DataFrame:
    return interactions.where(F.col("role") == "train")


def seen_pairs(train: DataFrame) -> DataFrame:
    """Distinct (user_idx, item_idx) of a training part."""
    return train.select("user_idx", "item_idx").distinct()


def relevant_pairs(held_out: DataFrame, threshold: float = C.RELEVANCE_THRESHOLD) -> DataFrame:
    """Held-out pairs with rating ≥ 3.5."""
    return (held_out.where(F.col("rating") >= F.lit(threshold))
            .select("user_idx", "item_idx").distinct())


def first_users(pairs: DataFrame, n_users: int) -> DataFrame:
    """The first ``n_users`` users in index order (a sample cap that is the feature)."""
    return pairs.select("user_idx").distinct().orderBy("user_idx").limit(n_users)
