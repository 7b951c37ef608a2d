"""Gated ingest in one pass over an upload.

The typed ratings are written to a folder that no manifest names yet; the checks are
metrics observed by that very write. Only an upload without errors is published, any
other leaves no table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from rankloom import config as C
from rankloom.config import DatasetConfig
from rankloom.operators import validate as va
from rankloom.plans.store import Store

REPORT = "section string, name string, value double"


def _metrics(ratings: DataFrame, row_no: str | None) -> dict[str, F.Column]:
    num, out = va._num, {}
    for c in ("rating", "timestamp"):
        out[f"{c}_empty"] = F.count_if(F.col(c).isNull())
        out[f"{c}_non_numeric"] = F.count_if(F.col(c).isNotNull() & num(c).isNull())
        if row_no:
            out[f"{c}_first_bad"] = F.min(F.when(num(c).isNull(), F.col(row_no)))
    for c in ("user_id", "item_id"):
        out[f"{c}_empty"] = F.count_if(F.col(c).isNull())
    for c in C.BEHAVIOR_FLAG_WEIGHTS:
        if c in ratings.columns:
            out[f"flag_values:{c}"] = F.count_if(num(c).isNotNull() & ~num(c).isin(0.0, 1.0))
    if C.VIEW_TIME_COL in ratings.columns:
        out["view_time_negative"] = F.count_if(num(C.VIEW_TIME_COL) < 0)
    return out | {"rows": F.count(F.lit(1)), "rating_min": F.min(num("rating")), "rating_max": F.max(num("rating"))}


def gated_ingest(ratings: DataFrame, items: DataFrame, cfg: DatasetConfig, store: Store,
                 row_no: str | None = None) -> tuple[DataFrame, int | None]:
    """The report (section, name, value) of an all-string upload, and the version it was published as.

    Sections: ``error`` and ``warning`` (counts of every check, 0 included), ``first_bad``
    (by ``row_no``, null if none), ``stat``, and ``verdict`` (valid, published: 1 or 0).
    Cells that aren't numbers count as empty among duplicates. With absent columns
    (V01, V09) nothing is read and only these errors are reported.
    """
    spark = ratings.sparkSession
    absent = [m for side in va.schema_problems(ratings.columns, items.columns, cfg) for m in side]
    if absent:
        rows = [("error", m, 1.0) for m in absent] + [("verdict", "valid", 0.0), ("verdict", "published", 0.0)]
        return spark.createDataFrame(rows, REPORT), None

    signals = [c for c in C.BEHAVIOR_COLS if c in ratings.columns]
    seen = Observation()
    typed = (ratings.observe(seen, *(m.alias(n) for n, m in _metrics(ratings, row_no).items()))
             .select("user_id", "item_id", va._num("rating").alias("rating"),
                     va._num("timestamp").cast("long").alias("timestamp"), *(va._num(c).alias(c) for c in signals)))
    folder = store.folder("datasets")
    store.write(folder, {"ratings": typed})
    got = {k: v for k, v in seen.get.items()}
    rows = [("stat" if n in ("rows", "rating_min", "rating_max") else "first_bad" if n.endswith("_first_bad") else "error",
             n.removesuffix("_first_bad"), None if v is None else float(v)) for n, v in got.items()]

    written = spark.read.parquet(f"{store.root}/{folder}/ratings")
    counts = written.agg(F.count_distinct("user_id"), F.count_distinct("item_id")).first()
    ids = items.withColumn("item_id", F.col("item_id").cast("string"))
    odd = {r.feature: r.n for r in va.feature_non_binary(items, cfg).collect()}
    rows += [("stat", "users", float(counts[0])), ("stat", "items", float(counts[1])),
             ("warning", "duplicates", float(va.duplicate_count(written).first()[0])),
             ("warning", "few_rows", float(got["rows"] < 100)),
             ("warning", "orphans", float(va.orphan_items(written, ids).count())),
             *(("warning", f"feature_non_binary:{f}", float(n)) for f, n in odd.items())]
    valid = not any(v for section, _, v in rows if section == "error")
    version = None
    if valid:
        store.write(folder, {"items": items})
        version = store.publish(folder)
    else:
        store.discard(folder)
    rows += [("verdict", "valid", float(valid)), ("verdict", "published", float(version is not None))]
    return spark.createDataFrame(rows, REPORT), version
