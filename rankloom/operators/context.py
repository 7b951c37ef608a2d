"""Temporal-context scorer: hour / day-of-week rating deviations per feature.

All bias tables come from one pass over ``train ⋈ features`` with grouping sets
``(feature, hour), (feature, day_of_week), (feature)``; the global tables from one
more pass with ``(hour), (day_of_week)``. The item score at a requested context is
a join of the long feature table with the two bias tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom import config as C
from rankloom.functions.ranking import score_key, top_n


def _mean_rating(train: DataFrame):
    return train.select(F.avg("rating")).scalar()


def global_time_bias(train: DataFrame) -> DataFrame:
    """(kind, key, bias) for kind ∈ {hour, dow}: mean rating − global mean."""
    mu = _mean_rating(train)
    g = (train.groupingSets([["hour"], ["day_of_week"]], "hour", "day_of_week")
         .agg(F.avg("rating").alias("_m"), F.grouping_id().alias("_gid")))
    return g.select(
        F.when(F.col("_gid") == 1, "hour").otherwise("dow").alias("kind"),
        F.when(F.col("_gid") == 1, F.col("hour")).otherwise(F.col("day_of_week")).alias("key"),
        (F.col("_m") - mu).alias("bias"))


def feature_time_bias(train: DataFrame, features: DataFrame,
                      min_support: int = C.CONTEXT_MIN_SUPPORT) -> DataFrame:
    """X01 + X03: (feature, kind, key, bias) for features with ≥ ``min_support`` rows.

    Deviations are from the *global* mean; the support count comes from the same pass.
    """
    mu = _mean_rating(train)
    j = train.select("item_idx", "rating", "hour", "day_of_week").join(
        features.select("item_idx", "feature"), "item_idx")
    g = (j.groupingSets([["feature", "hour"], ["feature", "day_of_week"], ["feature"]],
                        "feature", "hour", "day_of_week")
         .agg(F.avg("rating").alias("_m"), F.count(F.lit(1)).alias("_c"),
              F.grouping_id().alias("_gid")))
    support = g.where(F.col("_gid") == 3).select("feature", F.col("_c").alias("_support"))
    cells = g.where(F.col("_gid") != 3).join(support, "feature").where(
        F.col("_support") >= min_support)
    return cells.select(
        "feature",
        F.when(F.col("_gid") == 1, "hour").otherwise("dow").alias("kind"),
        F.when(F.col("_gid") == 1, F.col("hour")).otherwise(F.col("day_of_week")).alias("key"),
        (F.col("_m") - mu).alias("bias"))


def supported_features(train: DataFrame, features: DataFrame,
                       min_support: int = C.CONTEXT_MIN_SUPPORT) -> DataFrame:
    return (train.select("item_idx").join(features.select("item_idx", "feature"), "item_idx")
            .groupBy("feature").count().where(F.col("count") >= min_support).select("feature"))


def _contexts(contexts) -> F.Column:
    """Literal array of requested (hour, dow) pairs — a bounded domain (≤ 24 × 7)."""
    pairs = sorted({(int(h), int(d)) for h, d in contexts})
    return F.array(*[F.struct(F.lit(h).alias("hour"), F.lit(d).alias("dow")) for h, d in pairs])


def context_tables(train: DataFrame, features: DataFrame) -> dict[str, DataFrame]:
    """What ``context_scores`` learns: biases per feature and overall, and the supported features."""
    return {"context_feature": feature_time_bias(train, features), "context_global": global_time_bias(train),
            "context_supported": supported_features(train, features)}


def context_scores(items: DataFrame, features: DataFrame, train: DataFrame,
                   contexts=((C.DEFAULT_HOUR, C.DEFAULT_DOW),), of: DataFrame | None = None,
                   tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """``(hour, dow, item_idx, ctx)`` for every item and requested (hour, dow).

    Per item: mean over its supported features of (h + d)/2 with missing cells 0;
    items without a supported feature take the global (h + d)/2. ``of`` holds the features of
    ``items`` where these are not the catalogue that the biases come from; ``tables`` are stored
    ``context_tables``, with which ``train`` is not read.
    """
    tables = context_tables(train, features) if tables is None else tables
    fb, gb, sup = (tables[f"context_{t}"] for t in ("feature", "global", "supported"))
    ctx = _contexts(contexts)
    fh = fb.where(F.col("kind") == "hour").select("feature", F.col("key").alias("hour"),
                                                   F.col("bias").alias("_h"))
    fd = fb.where(F.col("kind") == "dow").select("feature", F.col("key").alias("dow"),
                                                  F.col("bias").alias("_d"))
    per_feat = ((features if of is None else of).select("item_idx", "feature").join(F.broadcast(sup), "feature")  # a row per feature
                .select("item_idx", "feature", F.inline(ctx))
                .join(fh, ["feature", "hour"], "left").join(fd, ["feature", "dow"], "left")
                .groupBy("hour", "dow", "item_idx")
                .agg(F.avg((F.coalesce("_h", F.lit(0.0)) + F.coalesce("_d", F.lit(0.0))) / 2)
                     .alias("_f")))
    gh = gb.where(F.col("kind") == "hour").select(F.col("key").alias("hour"),
                                                   F.col("bias").alias("_gh"))
    gd = gb.where(F.col("kind") == "dow").select(F.col("key").alias("dow"),
                                                  F.col("bias").alias("_gd"))
    glob = (gh.sparkSession.range(1).select(F.inline(ctx))
            .join(gh, "hour", "left").join(gd, "dow", "left")
            .select("hour", "dow", ((F.coalesce("_gh", F.lit(0.0)) + F.coalesce("_gd", F.lit(0.0)))
                                    / 2).alias("_g")))
    return (items.select("item_idx", F.inline(ctx))
            .join(per_feat, ["hour", "dow", "item_idx"], "left")
            .join(F.broadcast(glob), ["hour", "dow"])
            .select("hour", "dow", "item_idx", F.coalesce("_f", "_g").alias("ctx")))


def context_rerank(ranked: DataFrame, ctx: DataFrame, alpha: float,
                   n: int | None = None) -> DataFrame:
    """Score + α·ctx, re-sorted per user (optionally cut to n)."""
    adj = (ranked.join(ctx.select("item_idx", "ctx"), "item_idx", "left")
           .withColumn("score", F.col("score") + F.lit(alpha) * F.coalesce("ctx", F.lit(0.0))))
    out = top_n(adj, ["user_idx"], [score_key("score").desc(), F.col("item_idx")],
                n if n is not None else 1 << 30)
    return out.drop("ctx")
