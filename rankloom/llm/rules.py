"""Quality rules with thresholds from mergeable quantile sketches per language and source.

The sketch of a group is a log-linear histogram of whole numbers: exact below
64, then 32 bins per power of two, so a quantile is at most a 32nd too high. A
document adds its words to its bin, so that quantiles tell of words, not of many
short texts. Two sketches merge by adding; a group is therefore one plain
aggregation with partial sums in every task, whatever its size, and language and
overall sketches are sums of the finer ones.

A metric's limit is where + greatest(FENCE * spread, NOISE * error). ``where`` is the
group's first quartile: up to three quarters of its words may be junk without
moving it, and a source whose texts are all alike moves it with them. ``spread`` is
the group's distance between quartiles, at most that of the language's typical group
(the median by documents), as junk of a quarter or more of a group widens its own; or
the distance between its lowest 20th and first quartile where that is wider. Quartiles
and spreads are drawn towards the wider level's as if that level gave PRIOR documents
more, so small groups need no rule of their own. ``error`` is the document's: a rate
of k events is uncertain by sqrt(k + 1) events. No constant belongs to one metric.
A language whose typical source is junk by a quarter or more keeps that junk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm import text as tx
from rankloom.llm.scratch import Scratch

MIN_WORDS = 50
REPEAT_PERCENT = 50
FENCE = 6.0
NOISE = 3.0
#: documents that the wider level's quartiles count for in a group's
PRIOR = 50.0
#: groups up to which the table of limits is broadcast (a hundred bytes each, about)
BROADCAST_GROUPS = 100000

#: metric (thousandths or tenths): what is counted, per what, scale, and the independent events counted
METRICS = {
    "symbol_rate": ("n_symbols", "word_chars", 1000, "n_symbols"),
    "dup_rate": ("n_dup_lines", "n_lines", 1000, "n_dup_lines"),
    "repeat_rate": ("n_repeat_words", "n_words", 1000, "n_repeat_runs"),
    "word_length": ("word_chars", "n_words", 10, "n_words"),
}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80

BASE_SCHEMA = "doc_id bigint, lang string, source string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_lines bigint, n_repeat_words bigint, n_repeat_runs bigint"


def _per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def _repeated(word: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document, the words inside a three-word window that the document holds twice or more, and their unbroken runs."""
    h, d, at = tx.shingles(word, doc, n, 3)
    whole = np.bincount(doc, minlength=n)[d] >= 3 if len(d) else np.zeros(0, bool)
    h, d, at = h[whole], d[whole], at[whole]
    if not len(h):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    _, which, times = np.unique(tx.mix(h + d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    hit = at[times[which] > 1]
    covered = np.zeros(len(word), bool)
    for i in range(3):
        covered[hit + i] = True
    first = covered.copy()
    first[1:] &= ~covered[:-1] | (doc[1:] != doc[:-1])
    return np.bincount(doc[covered], minlength=n), np.bincount(doc[first], minlength=n)


def _lines(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document, lines with a word, and those of them equal to an earlier line."""
    n = len(off) - 1
    many, again = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(n):
        lines = [x for x in buf[off[i]:off[i + 1]].tobytes().split(b"\n") if x.strip()]
        many[i], again[i] = len(lines), len(lines) - len(set(lines))
    return many, again


def base_metrics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, n_repeat_runs per row.

    Null or empty text: all counts 0. Whole texts; other columns are ignored; repeated rows stay.
    """
    def run(batches):
        for batch in batches:
            buf, off = tx.utf8(batch.column(3))
            for i, j in tx.pieces(off):
                b, o = buf[off[i]:off[j]], off[i:j + 1] - off[i]
                s, e, d = tx.words(b, o)
                n = j - i
                n_lines, dup = _lines(b, o)
                cols = [np.bincount(d, minlength=n), _per_doc(_LEAD[b] & ~tx.SPACE[b], o), _per_doc(_SYMBOL[b], o), dup, n_lines,
                        *_repeated(tx.hashes(b, s, e), d, n)]
                head = [batch.column(k).slice(i, n) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*head, *[pa.array(c, pa.int64()) for c in cols]], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string()),
                        *[(k, pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_repeat_runs")]])
    cols = docs.select(F.col("doc_id").cast("bigint"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))
    return cols.mapInArrow(run, BASE_SCHEMA)


def sketch_bin(v: Column) -> Column:
    """Bin of a whole number: itself below 64, else 32 bins per power of two."""
    power = F.length(F.conv(v.cast("string"), 10, 2))
    shift = F.greatest(power - 6, F.lit(0))
    return F.when(v < 64, v).otherwise((shift + 1) * 32 + (F.floor(v / F.pow(F.lit(2.0), shift)) - 32)).cast("bigint")


def bin_top(b: Column) -> Column:
    """Largest whole number of a bin."""
    shift = F.floor(b / 32) - 1
    return F.when(b < 64, b).otherwise((b - (shift + 1) * 32 + 33) * F.pow(F.lit(2.0), shift) - 1).cast("bigint")


def sketches(metrics: DataFrame) -> DataFrame:
    """lang, source, metric, bin, docs, words: one mergeable sketch per group and metric."""
    pairs = [F.struct(F.lit(k).alias("metric"), F.expr(f"{c} * {scale} div greatest({per}, 1)").cast("bigint").alias("value"))
             for k, (c, per, scale, _) in METRICS.items()]
    long = metrics.select("lang", "source", "n_words", F.explode(F.array(*pairs)).alias("p"))
    return long.groupBy("lang", "source", F.col("p.metric").alias("metric"), sketch_bin(F.col("p.value")).alias("bin")).agg(
        F.count("*").alias("docs"), F.sum("n_words").alias("words"))


def merge(sketch: DataFrame, *keys: str) -> DataFrame:
    return sketch.groupBy(*keys, "metric", "bin").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words"))


def quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """Per group and metric: documents, first quartile, its distances to the lowest 20th and to the third quartile.

    The windows order a group's bins (some hundreds), not documents.
    """
    group = [*keys, "metric"]
    up = Window.partitionBy(*group).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(*group)
    s = sketch.withColumn("upto", F.sum("words").over(up)).withColumn("all_words", F.sum("words").over(everything))
    q = lambda percent: bin_top(F.min(F.when(F.col("upto") * 100 >= F.col("all_words") * percent, F.col("bin"))))
    s = s.groupBy(*group).agg(F.sum("docs").alias("docs"), q(5).alias("q05"), q(25).alias("q25"), q(75).alias("q75"))
    return s.select(*group, "docs", F.col("q25").cast("double").alias("q25"), (F.col("q25") - F.col("q05")).cast("double").alias("low"),
                    (F.col("q75") - F.col("q25")).cast("double").alias("between"))


def _drawn(name: str) -> Column:
    """A group's figure (g) drawn towards the wider level's (w) by its number of documents."""
    return ((F.col("g.docs") * F.col(f"g.{name}") + F.lit(PRIOR) * F.col(f"w.{name}")) / (F.col("g.docs") + F.lit(PRIOR))).alias(name)


def _typical(group: DataFrame, *keys: str) -> DataFrame:
    """Medians by documents of the groups' spreads; one value per group, not per document, meets here."""
    return group.groupBy(*keys, "metric").agg(*[F.expr(f"percentile({x}, 0.5D, docs)").alias(x) for x in ("low", "between")])


def limits(fine: DataFrame) -> DataFrame:
    """lang, source and per metric <metric>_where and <metric>_spread, from the sketches of ``fine``."""
    by_lang = merge(fine, "lang")
    group = quartiles(fine, "lang", "source")
    figures = ("q25", "low", "between")
    same = lambda a, b: (F.col(f"{a}.metric") == F.col(f"{b}.metric")) & F.col(f"{a}.lang").eqNullSafe(F.col(f"{b}.lang"))
    whole = quartiles(merge(by_lang)).select("metric", "q25").join(_typical(group), "metric")
    lang = quartiles(by_lang, "lang").alias("q").join(_typical(group, "lang").alias("t"), same("q", "t")).select(
        "q.lang", "q.metric", "q.docs", "q.q25", "t.low", "t.between")
    lang = lang.alias("g").join(whole.alias("w"), "metric").select("g.lang", "metric", *[_drawn(x) for x in figures])
    group = group.alias("g").join(lang.alias("w"), same("g", "w")).select(
        "g.lang", "g.source", "g.metric", *[_drawn(x) for x in figures], F.col("w.between").alias("most"))
    of = lambda k, x: F.max(F.when(F.col("metric") == k, x))
    spread = F.greatest(F.col("low"), F.least("between", "most"))
    return group.groupBy("lang", "source").agg(*[c for k in METRICS for c in (
        of(k, F.col("q25")).alias(f"{k}_where"), of(k, spread).alias(f"{k}_spread"))])


def _over(k: str) -> Column:
    """Whether a document's metric is above the limit of its group and its own error."""
    count, per, scale, events = METRICS[k]
    rate = F.col(count) * F.lit(float(scale)) / F.greatest(F.col(per), F.lit(1))
    error = rate * F.sqrt(F.col(events) + F.lit(1.0)) / F.greatest(F.col(events), F.lit(1))
    return F.coalesce(rate > F.col(f"{k}_where") + F.greatest(F.lit(FENCE) * F.col(f"{k}_spread"), F.lit(NOISE) * error), F.lit(False))


def apply_rules(docs: DataFrame) -> DataFrame:
    """Base counts, base_failed and kept per row of ``docs`` (doc_id, text, lang, source).

    kept: not base_failed and no metric above its limit. Null lang or source are groups of their own.
    Null text: no words, so base_failed. Repeated rows are judged alike. No rows: no rows. The counts
    are taken once and written to the shared folder.
    """
    scratch = Scratch(docs.sparkSession, "rules")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    m = scratch.table(base_metrics(docs).withColumn("base_failed", failed), "metrics")
    table = scratch.table(limits(scratch.table(sketches(m.where(~F.col("base_failed"))), "sketches")), "limits")
    if table.count() <= BROADCAST_GROUPS:
        table = F.broadcast(table)
    d, t = m.alias("d"), table.alias("t")
    joined = d.join(t, F.col("d.lang").eqNullSafe(F.col("t.lang")) & F.col("d.source").eqNullSafe(F.col("t.source")), "left")
    over = [_over(k) for k in METRICS]
    bad = over[0]
    for x in over[1:]:
        bad = bad | x
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~F.col("base_failed") & ~bad).alias("kept"))
