"""Line-level quality by a linear-chain conditional random field.

Every line of a text is a node with the states bad and good; its features are
its own counts and those of the lines before and after. The chain is trained on
document labels laid on all lines of a bounded sample, and a document's score is
the mean of the lines' forward-backward marginals, weighted by line length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from rankloom.llm import text as tx

#: labelled documents in the fit, and the lines above which a document is left out of the fit only
FIT_DOCS, FIT_LINES = 3000, 400
THRESHOLD = 0.3
ROUNDS, RATE, RIDGE = 150, 0.1, 1e-3

_CLASS = {name: np.zeros(256, bool) for name in ("upper", "lower", "digit", "symbol", "bang", "stop", "other", "lead", "bar")}
_CLASS["upper"][65:91] = True
_CLASS["lower"][97:123] = True
_CLASS["lower"][0xC0:] = True  # first byte of a longer character, counted as one letter
_CLASS["digit"][48:58] = True
_CLASS["symbol"][list(b"#*$%&<>")] = True
_CLASS["bang"][list(b"!")] = True
_CLASS["bar"][list(b"|")] = True
_CLASS["stop"][list(b".,;:?")] = True
_CLASS["other"][list(b"/\\@_={}[]()~^+\"'`-")] = True
_CLASS["lead"][:] = (np.arange(256) & 0xC0) != 0x80
N_OWN = 13


def line_ranges(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every \\n-split line; an empty text has one empty line."""
    n = len(off) - 1
    nl = np.flatnonzero(buf == 10)
    starts = np.concatenate([off[:-1], nl + 1])
    docs = np.concatenate([np.arange(n), np.searchsorted(off, nl, "right") - 1])
    order = np.lexsort((starts, docs))
    starts, docs = starts[order], docs[order]
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    ends[-1:] = off[-1]
    last = np.flatnonzero(np.r_[docs[1:] != docs[:-1], True])
    ends[last] = off[docs[last] + 1]
    return starts, ends, docs


def line_features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x N_OWN), code points and document of every line."""
    s, e, d = line_ranges(buf, off)
    c = {}
    for name, table in _CLASS.items():
        total = np.concatenate([[0], np.cumsum(table[buf], dtype=np.int64)])
        c[name] = (total[e] - total[s]).astype(np.float64)
    ws, we, _ = tx.words(buf, off)
    begun = np.concatenate([[0], np.cumsum(np.bincount(ws, minlength=len(buf)) if len(buf) else [0])])
    n_words = (begun[e] - begun[s]).astype(np.float64)
    line_of = np.searchsorted(s, ws, "right") - 1
    salt = np.uint64(0x9E3779B97F4A7C15)
    word = tx.mix(tx.hashes(buf, ws, we) + line_of.astype(np.uint64) * salt)
    _, first = np.unique(word, return_index=True)
    distinct = np.bincount(line_of[first], minlength=len(s)).astype(np.float64)
    whole = tx.mix(tx.hashes(buf, s, e) + d.astype(np.uint64) * salt)
    _, first = np.unique(whole, return_index=True)
    again = np.ones(len(s))
    again[first] = 0
    again[n_words == 0] = 0
    chars = c["lead"]
    per_char = lambda x: x / np.maximum(chars, 1)
    per_word = lambda x: x / np.maximum(n_words, 1)
    x = np.stack([
        np.log1p(chars), np.log1p(n_words), c["upper"] / np.maximum(c["upper"] + c["lower"], 1),
        np.minimum(per_word(c["symbol"]), 4), per_char(c["digit"]), np.minimum(per_word(c["bang"]), 4),
        np.minimum(per_word(c["bar"]), 2), np.minimum(per_word(c["stop"]), 2), np.minimum(per_word(chars), 40) / 10,
        again, distinct / np.maximum(n_words, 1), (n_words == 0).astype(float), per_char(c["other"]),
    ], axis=1)
    return x, chars, d


def with_neighbours(x: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Own, previous and next line's features (zero over a document's edge), edge flags and a constant."""
    same = (d[1:] == d[:-1])[:, None] if len(d) else np.zeros((0, 1), bool)
    prev, after = np.zeros_like(x), np.zeros_like(x)
    prev[1:] = x[:-1] * same
    after[:-1] = x[1:] * same
    at_start = np.r_[np.ones(min(1, len(d))), 1.0 - same[:, 0]]
    at_end = np.r_[1.0 - same[:, 0], np.ones(min(1, len(d)))]
    return np.column_stack([x, prev, after, at_start, at_end, np.ones(len(x))])


def marginals(unary: np.ndarray, d: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line and the summed edge marginals (2 x 2), all chains at once.

    unary: score of good over bad. Chains advance together, longest first, so one step costs the chains still open.
    """
    n = len(unary)
    emit = np.empty((n, 2))
    emit[:, 1] = 1 / (1 + np.exp(-np.clip(unary, -40, 40)))
    emit[:, 0] = 1 - emit[:, 1]
    move = np.exp(trans)
    begin = np.flatnonzero(np.r_[True, d[1:] != d[:-1]]) if n else np.zeros(0, int)
    length = np.diff(np.r_[begin, n])
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    deep = int(length[0]) if len(length) else 0
    open_at = np.searchsorted(-length, -np.arange(deep + 1), "left")  # chains longer than t
    ahead, back = np.empty((n, 2)), np.ones((n, 2))
    for t in range(deep):
        at = begin[:open_at[t]] + t
        a = emit[at] if t == 0 else (ahead[at - 1] @ move) * emit[at]
        ahead[at] = a / a.sum(1, keepdims=True)
    edges = np.zeros((2, 2))
    for t in range(deep - 1, 0, -1):
        at = begin[:open_at[t]] + t
        b = emit[at] * back[at]
        pair = ahead[at - 1][:, :, None] * move[None] * b[:, None, :]
        edges += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
        b = b @ move.T
        back[at - 1] = b / b.sum(1, keepdims=True)
    both = ahead * back
    return both[:, 1] / both.sum(1), edges


def fit(x: np.ndarray, d: np.ndarray, good: np.ndarray) -> dict:
    """Maximum likelihood by gradient steps (Adam) over all sample chains; good: label of each line."""
    mean, dev = x.mean(0), x.std(0) + 1e-6
    f = with_neighbours((x - mean) / dev, d)
    same = d[1:] == d[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (good[:-1][same].astype(int), good[1:][same].astype(int)), 1)
    w = np.zeros(f.shape[1] + 4)
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    n = max(1, len(f))
    for k in range(1, ROUNDS + 1):
        p, edges = marginals(f @ w[:-4], d, w[-4:].reshape(2, 2))
        grad = np.r_[f.T @ (good - p), (seen - edges).ravel()] / n - RIDGE * w
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        w = w + RATE * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.999**k)) + 1e-8)
    return {"mean": mean, "dev": dev, "w": w}


def score_lines(model: dict, x: np.ndarray, d: np.ndarray) -> np.ndarray:
    w = model["w"]
    return marginals(with_neighbours((x - model["mean"]) / model["dev"], d) @ w[:-4], d, w[-4:].reshape(2, 2))[0]


def fit_sample(docs: DataFrame, labels: DataFrame, usable: Column) -> dict:
    """Model fitted on FIT_DOCS labelled documents, taken by a hash of doc_id among those with ``usable``.

    The sample's line features, not its texts, come to the driver: at most FIT_DOCS * FIT_LINES rows.
    Without labelled rows of both kinds the model calls every line good with even chance.
    """
    lab = labels.where(F.col("quality").isNotNull() & usable).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    lab = lab.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(FIT_DOCS)
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(lab), "doc_id")

    def run(batches):
        for batch in batches:
            buf, off = tx.utf8(batch.column(1))
            for i, j in tx.pieces(off):
                x, _, d = line_features(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                few = np.bincount(d, minlength=j - i) <= FIT_LINES
                for k in np.flatnonzero(few):
                    rows = d == k
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).slice(i + k, 1), batch.column(2).slice(i + k, 1),
                        pa.array([x[rows].astype(np.float32).tobytes()], pa.binary())], names=["doc_id", "quality", "x"])

    got = sorted((r.doc_id, r.quality, bytes(r.x)) for r in chosen.select("doc_id", "text", "quality").mapInArrow(run, "doc_id bigint, quality int, x binary").collect())
    if len({q for _, q, _ in got}) < 2:
        return {"mean": np.zeros(N_OWN), "dev": np.ones(N_OWN), "w": np.zeros(3 * N_OWN + 3 + 4)}
    parts = [np.frombuffer(b, np.float32).reshape(-1, N_OWN).astype(float) for _, _, b in got]
    d = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    good = np.repeat([float(q) for _, q, _ in got], [len(p) for p in parts])
    return fit(np.concatenate(parts), d, good)


def score_udf(model: dict):
    """Pandas-free Arrow scorer for mapInArrow over (doc_id, text): adds nothing but the score."""
    def run(batches):
        for batch in batches:
            buf, off = tx.utf8(batch.column(1))
            out = []
            for i, j in tx.pieces(off):
                x, chars, d = line_features(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                p = score_lines(model, x, d)
                weight = np.bincount(d, chars, minlength=j - i)
                plain = np.bincount(d, p, minlength=j - i) / np.maximum(np.bincount(d, minlength=j - i), 1)
                out.append(np.where(weight > 0, np.bincount(d, p * chars, minlength=j - i) / np.maximum(weight, 1), plain))
            score = np.clip(np.concatenate(out), 0, 1) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*batch.schema.names, "score"])
    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All columns of ``docs`` with held_out, score and predicted (1 where score >= THRESHOLD).

    ``docs`` columns of those three names are replaced. Null text counts as empty; an empty text scores
    as one empty line. Repeated rows score alike; a document with several labels learns the highest.
    No rows: no rows; no labels: score 0.5.
    """
    model = fit_sample(docs, labels, ~held_out(F.col("doc_id")))
    names = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    src = docs.select(*names)
    at = names.index("text")

    def run(batches):
        inner = score_udf(model)
        for batch in batches:
            narrow = pa.RecordBatch.from_arrays([batch.column(at), batch.column(at)], names=["k", "text"])
            got = next(inner([narrow]))
            yield pa.RecordBatch.from_arrays([*batch.columns, got.column(2)], names=[*names, "score"])

    schema = StructType([*src.schema.fields, StructField("score", DoubleType())])
    return src.mapInArrow(run, schema).select(
        *names, held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score is THRESHOLD or more, with all their columns and no others."""
    model = fit_sample(docs, labels, ~held_out(F.col("doc_id")))
    at = docs.columns.index("text")

    def run(batches):
        inner = score_udf(model)
        for batch in batches:
            got = next(inner([pa.RecordBatch.from_arrays([batch.column(at), batch.column(at)], names=["k", "text"])]))
            yield batch.filter(pa.array(got.column(2).to_numpy() >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
