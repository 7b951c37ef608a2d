"""Serving jobs over request tables.

Each request is a row; a batch of requests is answered by one Spark job, so
"recommend for every user" is the same code path as a single request.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom import config as C
from rankloom.functions.columns import engagement_weight, inferred_rating
from rankloom.functions.ranking import top_n

MODELS = ["cf", "cbf", "ncf", "hybrid"]


def request_bounds(requests: DataFrame) -> DataFrame:
    """Valid flag and the first failing rule for each recommendation/interaction request.

    Rules: hour 0–23, dow 0–6, mon 0–11, n 1–50, history 1–100, model in {cf, cbf, ncf, hybrid},
    rating 1–5 when given, view time ≥ 0.
    """
    checks = [
        (~F.col("hour").between(0, 23), "hour must be 0-23"),
        (~F.col("dow").between(0, 6), "dow must be 0-6"),
        (~F.col("mon").between(0, 11), "mon must be 0-11"),
        (~F.col("n").between(1, 50), "n must be 1-50"),
        (~F.col("history").between(1, 100), "history must be 1-100"),
        (~F.col("model").isin(*MODELS), "model must be one of cf, cbf, ncf, hybrid"),
        (F.col("rating").isNotNull() & ~F.col("rating").between(1.0, 5.0), "rating must be 1-5"),
        (F.col("view_time_sec") < 0, "view_time_sec must be >= 0"),
    ]
    reason = F.lit(None).cast("string")
    for cond, msg in reversed(checks):
        reason = F.when(F.coalesce(cond, F.lit(False)), F.lit(msg)).otherwise(reason)
    return requests.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def engagement(events: DataFrame) -> DataFrame:
    """Engagement weight and effective rating (explicit, else inferred)."""
    flags = {k: F.col(k) for k in C.BEHAVIOR_FLAG_WEIGHTS if k in events.columns}
    w = engagement_weight(flags, F.col("view_time_sec"))
    return (events.withColumn("engagement", w)
            .withColumn("effective_rating", F.coalesce(F.col("rating"), inferred_rating(w))))


def signals_applied(events: DataFrame) -> F.Column:
    """Q09: names of the signals that were on, in a fixed order."""
    names = [F.when(F.coalesce(F.col(k), F.lit(False)), F.lit(k))
             for k in C.BEHAVIOR_FLAG_WEIGHTS if k in events.columns]
    names.append(F.when(F.col("view_time_sec") > 0, F.lit("view_time_sec")))
    return F.array_compact(F.array(*names))


def item_lookup(items: DataFrame, features: DataFrame) -> DataFrame:
    """Item id, name and its features in config order."""
    feats = (features.groupBy("item_idx")
             .agg(F.array_sort(F.collect_list(F.struct("feature_pos", "feature"))).alias("_f")))
    return (items.select("item_idx", "item_id", "name").join(feats, "item_idx", "left")
            .select("item_idx", "item_id", "name",
                    F.coalesce(F.col("_f.feature"), F.array().cast("array<string>"))
                    .alias("features")))


def enrich(ranked: DataFrame, items: DataFrame, features: DataFrame) -> DataFrame:
    """Q04 applied to a ranking; unknown items get name ``Unknown`` and no features."""
    look = item_lookup(items, features)
    return (ranked.join(look, "item_idx", "left")
            .withColumn("name", F.coalesce("name", F.lit("Unknown")))
            .withColumn("features", F.coalesce("features", F.array().cast("array<string>"))))


def user_page(users: DataFrame, offset: int, limit: int) -> DataFrame:
    """Q05: users ordered by id, one page."""
    return users.orderBy("user_id").offset(offset).limit(limit)


def user_history(ratings: DataFrame, limit: int = 20) -> DataFrame:
    """Q07 (all users): newest first, ``limit`` rows per user, with position ``pos``."""
    return top_n(ratings, ["user_idx"], [F.col("timestamp").desc(), F.col("item_idx")], limit,
                 rank_col="pos")


def rating_histogram(history: DataFrame, bins: int = 9, lo: float = 1.0,
                     hi: float = 5.0) -> DataFrame:
    """Q11: equal-width bins over [lo, hi] per user."""
    width = (hi - lo) / bins
    b = F.least(F.greatest(F.floor((F.col("rating") - lo) / width), F.lit(0)),
                F.lit(bins - 1)).cast("int")
    return (history.withColumn("bin", b).groupBy("user_idx", "bin")
            .agg(F.count(F.lit(1)).cast("long").alias("n"))
            .withColumn("bin_lo", F.lit(lo) + F.col("bin") * width)
            .withColumn("bin_hi", F.lit(lo) + (F.col("bin") + 1) * width))


def history_feature_counts(history: DataFrame, features: DataFrame) -> DataFrame:
    """Q12: how often each feature occurs in a user's history (descending when displayed)."""
    return (history.select("user_idx", "item_idx").join(features, "item_idx")
            .groupBy("user_idx", "feature").agg(F.count(F.lit(1)).cast("long").alias("n")))


def rank_change(before: DataFrame, after: DataFrame, top: int = 5) -> DataFrame:
    """Q10: items in the top ``top`` after that were not in the top ``top`` before."""
    b = before.where(F.col("rank") <= top).select("user_idx", "item_idx")
    return after.where(F.col("rank") <= top).drop("rank", "score").join(b, ["user_idx", "item_idx"], "left_anti")
