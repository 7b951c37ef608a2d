"""Structured Streaming jobs over interaction events.

* T01 source: a file stream of events (``event_stream``).
* T02 engagement and effective rating: a stateless projection.
* T03 profile state: ``applyInPandasWithState`` keyed by user; the state is the
  profile vector and the items consumed so far (a catalogue's worth at most). Item
  vectors and base profiles arrive by stream–static joins. Within a micro-batch a
  user's events are applied in (event_time, event_id) order, across micro-batches in
  arrival order (T06).
* T04 seen set: no operator state; a batch adds the pairs that its compacted table
  does not hold yet, so old and late events count alike.
* T05 re-rank touched users per micro-batch in ``foreachBatch``.
* T07 running popularity: keyed aggregate in update mode.
* T08 daily activity per feature: event-time windows with a watermark.

Every job has one folder below the shared checkpoint folder, named by the job and its
input, with the streaming checkpoint and a table of one folder per micro-batch. A
restarted job finds its offsets and state there; a batch that is repeated after a
failure replaces its own folder, so each counts once. ``run_to_table`` drives a job
with ``availableNow`` and returns the final value per key as a batch DataFrame.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from rankloom import config as C
from rankloom.plans.serving import engagement, signals_applied
from rankloom.session import scratch_path
from rankloom.sources.fixtures import events_to_interactions


def job_folder(spark, name: str) -> str:
    """The folder of a job; ``name`` says what it does and what it reads."""
    return scratch_path(spark, "streams", name)


def _table(spark, out: str, schema) -> DataFrame:
    """What the job's batches have written so far, with their numbers in ``_batch``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return spark.read.schema(f"{schema.toDDL()}, `_batch` bigint").parquet(out)


def _drive(stream: DataFrame, name: str, output_mode: str, result) -> DataFrame:
    """Write ``result(batch, earlier)`` of every micro-batch; ``earlier`` is what former batches wrote."""
    spark = stream.sparkSession
    root = job_folder(spark, name)
    out = f"{root}/table"
    schema = result(spark.createDataFrame([], stream.schema), None).schema

    def sink(batch: DataFrame, batch_id: int):
        earlier = _table(batch.sparkSession, out, schema).where(F.col("_batch") < batch_id)
        result(batch, earlier).write.mode("overwrite").parquet(f"{out}/_batch={batch_id}")

    (stream.writeStream.outputMode(output_mode).foreachBatch(sink)
     .option("checkpointLocation", f"{root}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())
    return _table(spark, out, schema)


def last_per_key(table: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of each key's last batch (a key may have several, e.g. a ranking)."""
    last = table.groupBy(*keys).agg(F.max("_batch").alias("_batch"))
    return table.join(last, [*keys, "_batch"]).drop("_batch")


def run_to_table(stream: DataFrame, keys: list[str], name: str,
                 output_mode: str = "update") -> DataFrame:
    """Run ``stream`` to completion (availableNow) and return the last row per key."""
    table = _drive(stream, name, output_mode, lambda batch, earlier: batch)
    return last_per_key(table, keys) if keys else table.drop("_batch")


def run_seen(stream: DataFrame, name: str) -> DataFrame:
    """The distinct rows of ``stream``; a batch adds those that no former one wrote."""
    def fresh(batch, earlier):
        rows = batch.distinct()
        return rows if earlier is None else rows.join(earlier.drop("_batch"), batch.columns, "left_anti")

    return _drive(stream, name, "append", fresh).drop("_batch")


def run_rerank(updates: DataFrame, rerank, name: str, keys: list[str]) -> DataFrame:
    """``rerank(profiles)`` of every micro-batch's touched users; the last ranking of each."""
    return last_per_key(_drive(updates, name, "update", lambda batch, earlier: rerank(batch)), keys)


def interactions(events_stream: DataFrame) -> DataFrame:
    """Events → interactions with engagement, effective rating and applied signals."""
    ev = events_to_interactions(events_stream)
    return engagement(ev).withColumn("signals", signals_applied(ev))


def _profile_fn(n_features: int):
    def fn(key, pdfs, state):
        frames = [p for p in pdfs]
        pdf = pd.concat(frames, ignore_index=True) if frames else None
        if state.exists:
            prof = np.asarray(state.get[0], dtype=np.float64)
            n_seen = int(state.get[1])
            consumed = set(state.get[2])
        else:
            base = pdf["base"].iloc[0] if pdf is not None and len(pdf) else None
            prof = (np.asarray(base, dtype=np.float64) if base is not None
                    else np.zeros(n_features))
            n_seen, consumed = 0, set()
        last_alpha = 0.0
        if pdf is not None and len(pdf):
            pdf = pdf.sort_values(["event_time", "event_id"], kind="mergesort")
            consumed.update(int(i) for i in pdf["item_id"].dropna())
            for vec, rating, eng in zip(pdf["vec"], pdf["effective_rating"], pdf["engagement"]):
                n_seen += 1
                if vec is None:
                    last_alpha = 0.0
                    continue
                v = np.asarray(vec, dtype=np.float64)
                alpha = min(C.EMA_MAX_ALPHA, C.EMA_BASE * (rating / 5.0) * max(eng, 0.1))
                last_alpha = alpha
                if alpha > 0:
                    upd = (1 - alpha) * prof + alpha * v
                    nrm = np.sqrt(np.sum(upd * upd))
                    prof = upd / nrm if nrm > 0 else upd
        state.update((prof.tolist(), n_seen, sorted(consumed)))
        yield pd.DataFrame({"user_id": [key[0]], "profile": [prof.tolist()], "n_events": [n_seen],
                            "last_alpha": [last_alpha], "consumed": [sorted(consumed)]})
    return fn


def profile_stream(events_stream: DataFrame, item_vecs: DataFrame, base_profiles: DataFrame,
                   n_features: int) -> DataFrame:
    """Keyed EMA profile and consumed items; emits each touched user's per micro-batch.

    ``item_vecs``: (item_id, vec); ``base_profiles``: (user_id, base) — static tables.
    """
    ev = (interactions(events_stream)
          .join(item_vecs, "item_id", "left")
          .join(base_profiles, "user_id", "left")
          .select("user_id", "item_id", "event_id", "event_time", "vec", "base", "effective_rating",
                  "engagement"))
    return ev.groupBy("user_id").applyInPandasWithState(
        _profile_fn(n_features),
        outputStructType="user_id long, profile array<double>, n_events long, last_alpha double, "
                         "consumed array<long>",
        stateStructType="profile array<double>, n long, consumed array<long>",
        outputMode="update",
        timeoutConf=GroupStateTimeout.NoTimeout,
    )


def seen_stream(events_stream: DataFrame) -> DataFrame:
    """(user, item) pairs as they arrive; ``run_seen`` keeps each once."""
    return events_to_interactions(events_stream).select("user_id", "item_id")


def popularity_stream(events_stream: DataFrame) -> DataFrame:
    """Running Σ engagement and event count per item (update mode)."""
    return (interactions(events_stream).groupBy("item_id")
            .agg(F.sum("engagement").alias("weight"), F.count(F.lit(1)).alias("events")))


def window_stream(events_stream: DataFrame, item_features: DataFrame,
                  watermark: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Per (day window, feature): events and mean effective rating, event time + watermark."""
    ev = (interactions(events_stream)
          .withColumn("event_ts", F.col("event_time").cast("timestamp"))
          .withWatermark("event_ts", watermark)
          .join(item_features, "item_id"))
    return (ev.groupBy(F.window("event_ts", width).alias("w"), "feature")
            .agg(F.count(F.lit(1)).alias("events"), F.avg("effective_rating").alias("avg_rating"))
            .select(F.col("w.start").alias("window_start"), "feature", "events", "avg_rating"))


def replay_profiles_local(events: pd.DataFrame, item_vecs: dict, base: dict,
                          n_features: int) -> dict:
    """T09 reference fold in plain pandas (tests only): the same EMA, event by event."""
    out = {}
    for uid, g in events.sort_values(["event_time", "event_id"]).groupby("user_id"):
        prof = np.asarray(base.get(uid, np.zeros(n_features)), dtype=np.float64)
        for _, r in g.iterrows():
            v = item_vecs.get(r["item_id"])
            if v is None:
                continue
            a = min(C.EMA_MAX_ALPHA, C.EMA_BASE * (r["effective_rating"] / 5.0)
                    * max(r["engagement"], 0.1))
            if a > 0:
                upd = (1 - a) * prof + a * np.asarray(v)
                n = np.sqrt(np.sum(upd * upd))
                prof = upd / n if n > 0 else upd
        out[uid] = prof
    return out
