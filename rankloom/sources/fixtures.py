"""Map the driver's tables onto the interaction data model (see FIXTURES.md).

Fixture R (ratings) comes from ``lineitem ⋈ orders``, items from ``part`` and
fixture E (interaction events) from ``events``. Every builder reads Parquet with
only the columns it needs so the scans prune columns and push filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.config import RETAIL_CONFIG, DatasetConfig
from rankloom.functions.columns import epoch_seconds_ntz
from rankloom.functions.ranking import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def retail_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload-shaped ratings: user_id, item_id, rating, timestamp + three flags + view time."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount",
        "l_linestatus", "l_returnflag", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = li.join(orders, li.l_orderkey == orders.o_orderkey)
    offset = F.pmod(F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 3607, F.lit(86400))
    return j.select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        (F.lit(1.0) + F.floor((F.col("l_quantity") - 1) / 10)).cast("double").alias("rating"),
        (epoch_seconds_ntz("l_shipdate") + offset).cast("long").alias("timestamp"),
        F.pmod(F.col("l_orderkey") * 31 + F.col("l_partkey") * 17, F.lit(601))
        .cast("double").alias("view_time_sec"),
        (F.col("l_discount") >= 0.08).cast("int").alias("liked"),
        (F.col("l_linestatus") == "O").cast("int").alias("add_to_cart"),
        (F.col("l_returnflag") != "R").cast("int").alias("ordered"),
        F.col("l_orderkey").alias("_key"),
    )


def retail_ratings_text(spark: SparkSession, sf_dir: str, dirty: bool = True) -> DataFrame:
    """Ratings as an all-string upload (the CSV read path), optionally dirtied.

    Dirt, by ``l_orderkey``: rating text 'bad' every 97th key, null timestamp every
    101st, add_to_cart = 2 every 103rd, view_time_sec = -1 every 107th and rows of
    keys divisible by 109 twice.
    """
    r = retail_ratings(spark, sf_dir)
    k = F.col("_key")

    def text(name, cond=None, bad=None):
        clean = F.col(name).cast("string")
        out = F.when(cond, bad).otherwise(clean) if dirty and cond is not None else clean
        return out.alias(name)

    cols = [
        text("user_id"), text("item_id"),
        text("rating", k % 97 == 0, F.lit("bad")),
        text("timestamp", k % 101 == 0, F.lit(None).cast("string")),
        text("view_time_sec", k % 107 == 0, F.lit("-1")),
        text("liked"),
        text("add_to_cart", k % 103 == 0, F.lit("2")),
        text("ordered"),
        k,
    ]
    out = r.select(*cols)
    if dirty:  # repeated where they stand: a union would join the orders once more
        times = F.array_repeat(F.lit(0), F.when(k % 109 == 0, 2).otherwise(1))
        out = out.select("*", F.explode(times).alias("_again")).drop("_again")
    return out


def part_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, product_name and the category list ['Parts', type_…, w_…, w_…]."""
    # a short file is one split: its rows are spread before the flags are worked out
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type"), "p_partkey")
    words = F.split(F.col("p_name"), " ")
    return p.select(
        F.col("p_partkey").alias("item_id"),
        F.concat_ws(" ", "p_name", "p_brand").alias("product_name"),
        F.array(F.lit("Parts"), F.concat(F.lit("type_"), F.col("p_type")),
                F.concat(F.lit("w_"), F.get(words, 0)),
                F.concat(F.lit("w_"), F.get(words, 1))).alias("categories"),
    )


def retail_items(spark: SparkSession, sf_dir: str, cfg: DatasetConfig = RETAIL_CONFIG,
                 dirty: bool = False) -> DataFrame:
    """Upload-shaped wide items: item_id, product_name, one 0/1 column per feature.

    Dirty variant: items with ``item_id % 50 = 0`` removed (orphans) and feature value
    2 where ``item_id % 40 = 0``.
    """
    p = part_categories(spark, sf_dir)
    cats = F.slice(F.col("categories"), 2, 3)
    flags = []
    for f in cfg.feature_cols:
        v = F.array_contains(cats, f).cast("int")
        if dirty:
            v = F.when((F.col("item_id") % 40 == 0) & (v == 1), F.lit(2)).otherwise(v)
        flags.append(v.alias(f))
    out = p.select("item_id", "product_name", *flags)
    if dirty:
        out = out.where(F.col("item_id") % 50 != 0)
    return out


def event_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture E: one row per non-error event with behaviour flags and optional rating."""
    return events_to_interactions(table(spark, sf_dir, "events"))


def events_to_interactions(events: DataFrame) -> DataFrame:
    """Fixture E projection; works on a static or a streaming ``events`` DataFrame."""
    e = events.select("event_id", "ts", "user_id", "event_type", "value", "props")
    t = F.col("event_type")
    return e.where(t != "error").select(
        "event_id",
        F.col("user_id").cast("long").alias("user_id"),
        F.get_json_object("props", "$.k").cast("long").alias("item_id"),
        F.col("ts").alias("event_time"),
        epoch_seconds_ntz("ts").alias("timestamp"),
        F.when(t == "view", F.col("value")).otherwise(F.lit(0.0)).alias("view_time_sec"),
        (t == "click").alias("clicked"),
        (t == "purchase").alias("ordered"),
        (t == "signup").alias("liked"),
        F.lit(False).alias("wishlist"),
        F.lit(False).alias("add_to_cart"),
        F.when(t == "purchase", F.least(F.lit(5.0), F.lit(1.0) + F.floor(F.col("value") / 25)))
        .cast("double").alias("rating"),
    )


def event_stream(spark: SparkSession, path_glob: str, max_files: int | None = None) -> DataFrame:
    """The events table as a file stream (schema taken from the files, not inferred)."""
    schema = spark.read.parquet(path_glob).schema
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path_glob)
