"""File sources and sinks.

Uploads are read with an explicit all-string schema (validation must see the bad
cells that inference would hide), the reader's missing-value tokens become null,
and ``row_no`` records 0-based file order. Processed tables, models and results
are Parquet tables under a run folder; nothing is pickled.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom import config as C
from rankloom.config import DatasetConfig
from rankloom.functions.ranking import sequence_within

# Fixed column names of the public rating data set files.
ML_RATING_COLS = ["user_id", "item_id", "rating", "timestamp"]
ML_ITEM_BASE_COLS = ["item_id", "title", "release_date", "video_release_date", "imdb_url"]
ML_GENRES = ["unknown", "Action", "Adventure", "Animation", "Children's", "Comedy", "Crime",
             "Documentary", "Drama", "Fantasy", "Film-Noir", "Horror", "Musical", "Mystery",
             "Romance", "Sci-Fi", "Thriller", "War", "Western"]
ML_USER_COLS = ["user_id", "age", "gender", "occupation", "zip_code"]


def _strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def null_tokens(df: DataFrame) -> DataFrame:
    """Map the missing-value tokens of the upload reader to null (string columns)."""
    toks = [t for t in C.CSV_NULL_TOKENS if t]
    out = df
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            c = F.col(f"`{f.name}`")
            out = out.withColumn(f.name, F.when(F.trim(c).isin(*toks) | (F.trim(c) == ""),
                                                F.lit(None)).otherwise(c))
    return out


def with_row_no(df: DataFrame) -> DataFrame:
    """0-based file order of a file scan: by path, then block, then place in the block, without gaps."""
    tagged = df.select("*", F.col("_metadata.file_path").alias("_path"),
                       F.col("_metadata.file_block_start").alias("_block"),
                       F.monotonically_increasing_id().alias("_scan"))
    return (sequence_within(tagged, [], ["_path", "_block", "_scan"], rn="_rn", count=None)
            .withColumn("row_no", F.col("_rn") - 1).drop("_rn", "_path", "_block", "_scan"))


def header_of(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> list[str]:
    """Column names from the header line (one small read)."""
    return list(spark.read.option("header", True).option("sep", sep)
                .option("encoding", encoding).csv(path).columns)


def read_upload_csv(spark: SparkSession, path: str, row_numbers: bool = True) -> DataFrame:
    """CSV with header as all-string columns, null tokens mapped, optional ``row_no``."""
    cols = header_of(spark, path)
    df = (spark.read.schema(_strings(cols)).option("header", True).option("mode", "PERMISSIVE")
          .option("escape", '"').csv(path))
    return null_tokens(with_row_no(df) if row_numbers else df)


def typed_ratings(text: DataFrame) -> DataFrame:
    """Cast a validated all-string ratings upload (ids kept as supplied; numbers via try_cast)."""
    out = text
    for c in ("rating", C.VIEW_TIME_COL, *C.BEHAVIOR_FLAG_WEIGHTS):
        if c in out.columns:
            out = out.withColumn(c, F.col(c).try_cast("double"))
    return out.withColumn("timestamp", F.col("timestamp").try_cast("double").cast("long"))


def read_tab_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated ratings without header."""
    df = spark.read.schema(_strings(ML_RATING_COLS)).option("sep", "\t").csv(path)
    return df.select(F.col("user_id").cast("long"), F.col("item_id").cast("long"),
                     F.col("rating").cast("double"), F.col("timestamp").cast("long"))


def read_pipe_items(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-separated latin-1 items: 5 fields + 19 genre flags."""
    cols = ML_ITEM_BASE_COLS + ML_GENRES
    df = (spark.read.schema(_strings(cols)).option("sep", "|")
          .option("encoding", "ISO-8859-1").csv(path))
    return df.select(F.col("item_id").cast("long"), *[F.col(f"`{c}`") for c in cols[1:5]],
                     *[F.col(f"`{g}`").cast("int").alias(g) for g in ML_GENRES])


def read_pipe_users(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-separated users (age, gender, occupation, zip)."""
    df = spark.read.schema(_strings(ML_USER_COLS)).option("sep", "|").csv(path)
    return df.select(F.col("user_id").cast("long"), F.col("age").cast("int"), "gender",
                     "occupation", "zip_code")


REVIEW_SCHEMA = T.StructType([
    T.StructField("reviewerID", T.StringType()), T.StructField("asin", T.StringType()),
    T.StructField("overall", T.DoubleType()), T.StructField("unixReviewTime", T.LongType()),
    T.StructField("verified", T.BooleanType())])
META_SCHEMA_TEXT = T.StructType([
    T.StructField("asin", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("category", T.StringType()), T.StructField("categories", T.StringType())])


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType,
                    partitions: int | None = None) -> DataFrame:
    """JSON lines (gzip allowed), malformed lines dropped, file order in ``row_no``.

    A gzip file is one task; rows are spread again after numbering.
    """
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    df = with_row_no(df)
    return df.repartition(partitions) if partitions else df


def json_records(spark: SparkSession, path: str | list[str], schema: T.StructType, out: str) -> DataFrame:
    """S05 with a channel for what can't be read: ``schema``, ``row_no`` and ``corrupt`` (the line, null if it parses).

    A compressed file is read once by one task; its numbered records are written to ``out`` in many
    row groups, so that every later pass splits and prunes. Blank lines are no records.
    """
    lines = with_row_no(spark.read.text(path)).where(F.trim("value") != "")
    wide = T.StructType([*schema.fields, T.StructField("corrupt", T.StringType())])
    parsed = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"})
    lines.select("row_no", parsed.alias("r")).select("row_no", "r.*").write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata lines: ``category`` (list) or legacy ``categories`` (nested list), one list out."""
    raw = read_json_lines(spark, path, META_SCHEMA_TEXT)
    flat = F.from_json(F.col("category"), "array<string>")
    nested = F.from_json(F.col("categories"), "array<array<string>>")
    nested_flat = F.from_json(F.col("categories"), "array<string>")
    cats = F.coalesce(F.when(F.size(flat) > 0, flat), F.get(nested, 0),
                      F.when(F.size(nested_flat) > 0, nested_flat))
    return raw.select("asin", "title", cats.alias("categories"), "row_no")


def read_config(spark: SparkSession, path: str) -> DatasetConfig:
    """One JSON document → validated config record (job parameter, driver side)."""
    rows = spark.read.option("multiLine", True).json(path).collect()
    if len(rows) != 1:
        raise ValueError(f"config file must hold one JSON object, found {len(rows)}")
    return DatasetConfig.from_dict(rows[0].asDict(recursive=True))


def meta_record(spark: SparkSession, cfg: DatasetConfig, n_users: int | None = None,
                n_items: int | None = None, behavior_cols: list[str] | None = None) -> DataFrame:
    """The config (+ counts, legacy alias) as a one-row table."""
    m = cfg.to_meta_dict()
    row = (m["dataset_name"], m["item_label"], m["feature_cols"], m["feature_label"],
           float(m["rating_threshold"]), m["item_name_col"], m["genre_cols"], n_users, n_items,
           behavior_cols or [])
    return spark.createDataFrame([row], "dataset_name string, item_label string, "
                                 "feature_cols array<string>, feature_label string, "
                                 "rating_threshold double, item_name_col string, "
                                 "genre_cols array<string>, n_users long, n_items long, "
                                 "behavior_cols_present array<string>")


# ── run folders (S08, S09, S17) ──────────────────────────────────────────────
def new_run(root: str, dataset_name: str) -> str:
    """A fresh run folder per ingest; readers pick the newest complete one."""
    stamp = time.strftime("%Y%m%dT%H%M%S", time.gmtime())
    return f"{root.rstrip('/')}/{dataset_name}/run={stamp}-{uuid.uuid4().hex[:6]}"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def latest_run(spark: SparkSession, root: str, dataset_name: str) -> str | None:
    """Newest run folder of a dataset that has a completion marker."""
    fs, base = _fs(spark, f"{root.rstrip('/')}/{dataset_name}")
    if not fs.exists(base):
        return None
    runs = sorted(str(s.getPath().toString()) for s in fs.listStatus(base)
                  if s.isDirectory() and s.getPath().getName().startswith("run="))
    for r in reversed(runs):
        fs2, marker = _fs(spark, f"{r}/_COMPLETE")
        if fs2.exists(marker):
            return r
    return None


def mark_complete(spark: SparkSession, run_dir: str) -> None:
    fs, marker = _fs(spark, f"{run_dir}/_COMPLETE")
    fs.create(marker, True).close()


PROCESSED = ("ratings", "items", "item_features", "users", "user_map", "item_map", "meta")


def write_processed(tables: dict[str, DataFrame], run_dir: str) -> None:
    """Every processed table as Parquet, then the completion marker."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{run_dir}/{name}")
    mark_complete(spark, run_dir)


def read_processed(spark: SparkSession, run_dir: str) -> dict[str, DataFrame]:
    """Read the processed tables; a legacy ``title`` column becomes ``name``."""
    out = {}
    for name in PROCESSED:
        fs, p = _fs(spark, f"{run_dir}/{name}")
        if fs.exists(p):
            df = spark.read.parquet(f"{run_dir}/{name}")
            if name == "items" and "title" in df.columns and "name" not in df.columns:
                df = df.withColumnRenamed("title", "name")
            out[name] = df
    return out


def export_prepared(ratings: DataFrame, items: DataFrame, cfg: dict, out_dir: str) -> None:
    """Ratings.csv and items.csv with header (one file each) and config.json."""
    ratings.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{out_dir}/ratings")
    items.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{out_dir}/items")
    spark = ratings.sparkSession
    spark.createDataFrame([(json.dumps(cfg, indent=2),)], "value string").coalesce(1) \
        .write.mode("overwrite").text(f"{out_dir}/config")


def save_table(df: DataFrame, path: str) -> None:
    """Results and models are Parquet tables."""
    df.write.mode("overwrite").parquet(path)


def load_table_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Read a saved table, or an empty one with ``schema`` when it does not exist."""
    fs, p = _fs(spark, path)
    if fs.exists(p):
        return spark.read.parquet(path)
    return spark.createDataFrame([], schema)


def fusion_params(spark: SparkSession, weights, ctx_alpha: float | None) -> DataFrame:
    """Fusion weights + context strength as one row."""
    return spark.createDataFrame([(float(weights[0]), float(weights[1]), float(weights[2]),
                                   None if ctx_alpha is None else float(ctx_alpha))],
                                 "w_cf double, w_cbf double, w_ncf double, ctx_alpha double")


def read_fusion_params(df: DataFrame) -> DataFrame:
    """A missing context strength defaults to 0.15."""
    return df.withColumn("ctx_alpha", F.coalesce("ctx_alpha", F.lit(C.DEFAULT_CTX_ALPHA)))


def neural_weights_table(spark: SparkSession, params: dict) -> DataFrame:
    """Neural weights as ``(layer, row, values array<float>)`` plus shapes in the rows."""
    rows = []
    for layer, arr in params.items():
        a = arr if arr.ndim == 2 else arr.reshape(1, -1)
        for r in range(a.shape[0]):
            rows.append((layer, r, [float(x) for x in a[r]]))
    return spark.createDataFrame(rows, "layer string, row long, values array<float>")


def neural_params_from_table(df: DataFrame) -> dict:
    """Inverse of ``neural_weights_table`` (bias vectors come back 1-D)."""
    import numpy as np
    out: dict = {}
    for r in df.orderBy("layer", "row").collect():
        out.setdefault(r["layer"], []).append(r["values"])
    params = {k: np.asarray(v, dtype=np.float32) for k, v in out.items()}
    for k in list(params):
        if k.startswith("b") and params[k].shape[0] == 1:
            params[k] = params[k][0]
    return params


# ── S18 self-describing schema ───────────────────────────────────────────────
def schema_table(spark: SparkSession) -> DataFrame:
    """Expected upload columns as a table (file, kind, column, type, description)."""
    rows = [
        ("ratings", "required", "user_id", "int or string", "id of the rating person"),
        ("ratings", "required", "item_id", "int or string", "id of the rated thing"),
        ("ratings", "required", "rating", "number", "how well it was liked, on a scale from 1 to 5"),
        ("ratings", "required", "timestamp", "int", "seconds since 1970, UTC"),
        ("ratings", "optional", "view_time_sec", "number >= 0", "viewing time"),
        ("ratings", "optional", "clicked", "0/1", "1 where the page was opened"),
        ("ratings", "optional", "liked", "0/1", "1 where a like was given"),
        ("ratings", "optional", "wishlist", "0/1", "1 where it was saved for later"),
        ("ratings", "optional", "add_to_cart", "0/1", "1 where it was put in the cart"),
        ("ratings", "optional", "ordered", "0/1", "1 where it was bought or finished"),
        ("items", "required", "item_id", "int or string", "the id used by the ratings"),
        ("items", "required", "<item_name_col>", "string",
         "label shown to people; the config says which column"),
        ("items", "required", "<feature columns>", "0/1",
         "flags of the categories that the config lists"),
        ("config", "field", "dataset_name", "string", "short name of this data set"),
        ("config", "field", "item_label", "string", "what one item is called"),
        ("config", "field", "feature_cols", "list of strings",
         "which items columns are category flags"),
        ("config", "field", "feature_label", "string", "what a category is called"),
        ("config", "field", "rating_threshold", "number",
         "rating from which an item counts as liked"),
        ("config", "field", "item_name_col", "string", "items column with the label"),
    ]
    return spark.createDataFrame(rows, "file string, kind string, column string, type string, "
                                       "description string")


# The sample upload files (small fixtures users can start from).
SAMPLE_RATINGS_CSV = (
    "user_id,item_id,rating,timestamp,view_time_sec,clicked,add_to_cart,wishlist,ordered\n"
    "ana,t-01,4.0,1650000000,95,1,0,1,0\n"
    "ana,t-02,2.5,1650003600,12,1,0,0,0\n"
    "bo,t-02,3.5,1650100000,60,1,1,0,1\n"
    "cy,t-03,5.0,1650200000,300,1,1,0,1\n"
)
SAMPLE_ITEMS_CSV = (
    "item_id,title,Herbal,Green,Black\n"
    "t-01,Mint Leaves,1,0,0\n"
    "t-02,Spring Sencha,0,1,0\n"
    "t-03,Smoky Breakfast,0,0,1\n"
)
SAMPLE_CONFIG_JSON = (
    '{\n  "dataset_name": "tea-shop",\n  "item_label": "tea",\n'
    '  "feature_cols": ["Herbal", "Green", "Black"],\n'
    '  "feature_label": "Kind",\n  "rating_threshold": 3.5,\n'
    '  "item_name_col": "title"\n}\n'
)
