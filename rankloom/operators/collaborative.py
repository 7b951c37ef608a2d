"""Collaborative scorer: shrunk biases, popularity prior, residual matrix, truncated SVD.

C01–C07 are aggregations over the training interactions; C08 (truncated SVD) runs
block Krylov passes over cached user rows (see ``rankloom.operators.svd``);
C09–C12 score in user blocks and keep only the top of each user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom import config as C
from rankloom.functions.columns import confidence
from rankloom.functions.ranking import global_order_topn


def weighted(train: DataFrame) -> DataFrame:
    """Add ``_w`` (confidence) and ``_wr`` (w·rating)."""
    w_col = "interaction_weight" if "interaction_weight" in train.columns else None
    return (train.withColumn("_w", confidence(w_col))
            .withColumn("_wr", F.col("_w") * F.col("rating")))


def global_mean(train: DataFrame) -> DataFrame:
    """Weighted mean Σwr/Σw (one row)."""
    return weighted(train).agg((F.sum("_wr") / F.sum("_w")).alias("mu"))


def _mu(train: DataFrame):
    return global_mean(train).scalar()


def user_bias(train: DataFrame, reg: float = C.CF_BIAS_REG) -> DataFrame:
    """b_u = (Σwr − μΣw)/(λ + Σw)."""
    mu = _mu(train)
    return (weighted(train).groupBy("user_idx")
            .agg(F.sum("_wr").alias("_swr"), F.sum("_w").alias("_sw"))
            .select("user_idx", ((F.col("_swr") - mu * F.col("_sw"))
                                 / (F.lit(reg) + F.col("_sw"))).alias("user_bias")))


def item_bias(train: DataFrame, reg: float = C.CF_BIAS_REG) -> DataFrame:
    """C04 + C05: b_i and the log popularity prior log1p(Σw) per training item."""
    mu = _mu(train)
    return (weighted(train).groupBy("item_idx")
            .agg(F.sum("_wr").alias("_swr"), F.sum("_w").alias("_sw"))
            .select("item_idx",
                    ((F.col("_swr") - mu * F.col("_sw"))
                     / (F.lit(reg) + F.col("_sw"))).alias("item_bias"),
                    F.log1p(F.col("_sw")).alias("pop_prior")))


def residual_cells(train: DataFrame) -> DataFrame:
    """C06 + C07: r − μ − b_u − b_i, repeated (user, item) cells summed."""
    mu = _mu(train)
    ub = user_bias(train)
    ib = item_bias(train).select("item_idx", "item_bias")
    return (train.select("user_idx", "item_idx", "rating")
            .join(ub, "user_idx").join(ib, "item_idx")
            .withColumn("_res", F.col("rating") - mu - F.col("user_bias") - F.col("item_bias"))
            .groupBy("user_idx", "item_idx").agg(F.sum("_res").alias("residual")))


def bias_topn(train: DataFrame, n: int = 10, pop_beta: float = C.CF_POP_BETA) -> DataFrame:
    """``bias_ranked`` with scores rounded to 6 decimals."""
    return bias_ranked(train, n, pop_beta).select(
        "user_idx", "rank", "item_idx", F.round("score", 6).alias("score"))


def bias_ranked(train: DataFrame, n: int = 10, pop_beta: float = C.CF_POP_BETA,
                users: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
    """Top-n unseen by μ + b_u + b_i + β·log1p(Σw) for every user with training rows.

    The user term is constant per user, so every user walks one global item order
    (``global_order_topn``), never users × items.
    """
    mu = _mu(train)
    ib = item_bias(train).withColumn(
        "_s", F.col("item_bias") + F.lit(pop_beta) * F.col("pop_prior"))
    ub = user_bias(train).withColumn("_off", mu + F.col("user_bias"))
    users = ub if users is None else users.select("user_idx").distinct().join(ub, "user_idx")
    return global_order_topn(users, ib, "_s", n, train if seen is None else seen,
                             offset_col="_off")


def popularity_ranked(train: DataFrame, n: int = 10, users: DataFrame | None = None,
                      seen: DataFrame | None = None) -> DataFrame:
    """Deterministic popularity scorer: log1p(Σw) over training items, top-n unseen."""
    ib = item_bias(train)
    users = train.select("user_idx").distinct() if users is None else users
    return global_order_topn(users, ib, "pop_prior", n, train if seen is None else seen)
