"""Ingest: dense id encoding, temporal features, labels, weights, item alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom import config as C
from rankloom.config import DatasetConfig
from rankloom.functions.columns import (hour_of, interaction_weight, month0_of, utc_datetime,
                                        weekday_of)
from rankloom.functions.ranking import dense_index


def qcol(name: str):
    """Column reference that tolerates spaces and dots in configured names."""
    return F.col(f"`{name}`")


def encode_ids(ratings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sorted distinct ids → 0..n−1 (numeric order for numbers, code point for text).

    The users also come with ``_n``, the number of their rows that name an item.
    """
    user_map = dense_index(ratings, "user_id", "user_idx", _n=F.count("item_id"))
    item_map = dense_index(ratings, "item_id", "item_idx")
    return user_map, item_map


def temporal_features(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Datetime (UTC), hour, day_of_week (Mon=0), month (Jan=0) from Unix seconds."""
    return (df.withColumn("datetime", utc_datetime(ts))
            .withColumn("hour", hour_of(ts))
            .withColumn("day_of_week", weekday_of(ts))
            .withColumn("month", month0_of(ts)))


def positive_label(df: DataFrame, threshold: float) -> DataFrame:
    """label = rating ≥ threshold as float 0/1."""
    return df.withColumn("label", (F.col("rating") >= F.lit(float(threshold))).cast("float"))


def with_interaction_weight(df: DataFrame) -> DataFrame:
    """Confidence weight from whichever behaviour columns are present."""
    return df.withColumn("interaction_weight", interaction_weight(df.columns))


def index_ratings(ratings: DataFrame, user_map: DataFrame, item_map: DataFrame) -> DataFrame:
    """Raw columns + user_idx, item_idx; joined by item first, so the rows lie by user after it."""
    return ratings.join(item_map, "item_id").join(user_map, "user_id")


def rating_features(indexed: DataFrame, cfg: DatasetConfig) -> DataFrame:
    """Adds temporal features, label and weight."""
    return with_interaction_weight(positive_label(temporal_features(indexed), cfg.rating_threshold))


def process_ratings(ratings: DataFrame, cfg: DatasetConfig, user_map: DataFrame,
                    item_map: DataFrame) -> DataFrame:
    """Processed ratings: raw columns + user_idx, item_idx, temporal features, label, weight."""
    return rating_features(index_ratings(ratings, user_map, item_map), cfg)


def coerce_feature(c) -> F.Column:
    """null→0, clip to [0,1], truncate to int (0.5→0, 1.7→1, −0.3→0)."""
    v = c.try_cast("double") if not isinstance(c, str) else F.col(c).try_cast("double")
    return F.least(F.greatest(F.coalesce(v, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).cast("int")


def align_items(items: DataFrame, cfg: DatasetConfig, item_map: DataFrame) -> DataFrame:
    """Keep rated items, attach item_idx, name column → ``name``, coerce features."""
    feats = [coerce_feature(qcol(f)).alias(f) for f in cfg.feature_cols]
    return (items.join(item_map, "item_id")
            .select("item_id", "item_idx", qcol(cfg.item_name_col).cast("string").alias("name"),
                    *feats))


def feature_long(items: DataFrame, cfg: DatasetConfig) -> DataFrame:
    """Wide 0/1 feature columns → ``(item_idx, feature_pos, feature)`` rows where the flag is 1."""
    entries = F.array(*[
        F.struct(F.lit(i).alias("feature_pos"), F.lit(f).alias("feature"),
                 qcol(f).cast("int").alias("_v"))
        for i, f in enumerate(cfg.feature_cols)])
    return (items.select("item_idx", F.inline(entries))
            .where(F.col("_v") == 1).drop("_v"))


def stub_users(ratings: DataFrame) -> DataFrame:
    """Users table from the distinct rated ids."""
    return ratings.select("user_id").distinct()


def dataset_summary(ratings: DataFrame) -> DataFrame:
    """Counts from the ratings (not from the items file), one row."""
    present = [c for c in C.BEHAVIOR_COLS if c in ratings.columns]
    rating = F.col("rating").try_cast("double") if dict(ratings.dtypes).get(
        "rating") == "string" else F.col("rating")
    return ratings.agg(
        F.count(F.lit(1)).cast("long").alias("n_ratings"),
        F.count_distinct("user_id").cast("long").alias("n_users"),
        F.count_distinct("item_id").cast("long").alias("n_items"),
        F.min(rating).cast("double").alias("rating_min"),
        F.max(rating).cast("double").alias("rating_max"),
    ).withColumn("behavioural_columns", F.lit(",".join(present)))
