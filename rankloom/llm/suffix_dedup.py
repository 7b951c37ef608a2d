"""Removal of byte strings that occur earlier, by a difference cover and suffix buckets.

Two suffixes that share their first WINDOW bytes share, at one common distance
below PERIOD, a position of the difference cover in both documents, so the
SAMPLE bytes there have equal rank. The ranks of the cover's samples are counted
first; only suffixes that can reach a sample of repeated rank are carried on.
Those are dealt into buckets by their least sample hash, which equal suffixes
have in common, and every bucket is sorted on its own, in bounded memory; equal
neighbours are compared byte by byte and all but the earliest are marked.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import text as tx
from rankloom.llm.scratch import Scratch

WINDOW = 100
#: a perfect difference set: every distance below PERIOD is a difference of two members
PERIOD, COVER = 57, (0, 1, 3, 13, 32, 36, 43, 52)
SAMPLE = WINDOW - PERIOD + 1
#: cover samples of a rank bucket, and bytes of a suffix bucket, about
RANK_ROWS, BUCKET_BYTES = 1500000, 3000000
#: bytes of a batch's chunk
CHUNK = 4 * tx.PIECE
_M = [np.uint64(x) for x in np.random.default_rng(99).integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]


def _hash_at(buf: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of the ``size`` bytes at every position."""
    words = np.ndarray((max(0, len(buf) - 7),), "<u8", np.ascontiguousarray(buf).data, strides=(1,))
    steps = [*range(0, size - 7, 8)]
    if steps[-1] != size - 8:
        steps.append(size - 8)
    h = np.zeros(len(at), np.uint64)
    for k, s in enumerate(steps):
        h ^= (words[at + s] + _M[k]) * _M[(k + 1) % len(_M)]
        h = (h << np.uint64(23)) | (h >> np.uint64(41))
        h *= np.uint64(0x9E3779B97F4A7C15)
    return tx.mix(h)


def _cover_positions(off: np.ndarray) -> np.ndarray:
    """Positions of the cover in every document, counted from its start, that a whole sample fits behind."""
    out = []
    for c in COVER:
        size = np.diff(off)
        n = np.maximum(0, (size - SAMPLE - c) // PERIOD + 1)
        n = np.where(size >= max(WINDOW, SAMPLE + c), n, 0)
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out.append(np.repeat(off[:-1], n) + c + PERIOD * k)
    return np.sort(np.concatenate(out))


def _sample_rows(n_buckets: int):
    """Rows (bucket, chunk, kind, a, b). kind 0: sample hashes of a rank bucket and their offsets in the chunk;
    1: offsets of samples repeated inside the chunk; 2: the chunk's doc_ids and their offsets."""
    names = ["bucket", "chunk", "kind", "a", "b"]

    def run(batches):
        for batch in batches:
            buf, off = tx.utf8(batch.column(1))
            ids = batch.column(0).to_numpy()
            for i, j in tx.pieces(off, CHUNK):
                b, o = buf[off[i]:off[j]], off[i:j + 1] - off[i]
                at = _cover_positions(o)
                if not len(at):
                    continue
                chunk = int.from_bytes(hashlib.blake2b(ids[i:j].tobytes() + o.tobytes(), digest_size=8).digest(), "little", signed=True)
                h, first, which, times = np.unique(_hash_at(b, at, SAMPLE), return_index=True, return_inverse=True, return_counts=True)
                again = at[times[which] > 1]
                bucket = (h % np.uint64(n_buckets)).astype(np.int64)
                where = at[first]
                order = np.lexsort((where, bucket))
                bucket, h, where = bucket[order], h[order], where[order]
                cut = np.searchsorted(bucket, np.arange(n_buckets + 1))
                rows = []
                for k in range(n_buckets):
                    lo, hi = cut[k], cut[k + 1]
                    if hi > lo:
                        short = (h[lo:hi] // np.uint64(n_buckets)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                        gap = np.diff(where[lo:hi], prepend=0).astype("<u4")
                        planes = np.concatenate([(gap & 0xFFFF).astype("<u2"), (gap >> 16).astype("<u2")])
                        rows.append((k, chunk, 0, short.tobytes(), planes.tobytes()))
                side = n_buckets + chunk % n_buckets
                rows.append((side, chunk, 1, again.astype("<i8").tobytes(), b""))
                rows.append((side, chunk, 2, ids[i:j].astype("<i8").tobytes(), o.astype("<i8").tobytes()))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()),
                                                  pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.binary())], names=names)
    return run


def _repeated_ranks(table: pa.Table) -> pa.Table:
    """Of one rank bucket, every chunk's offsets whose sample occurs in several chunks; other kinds pass."""
    kind = table.column("kind").to_pylist()
    if kind and kind[0] != 0:
        return table.select(["chunk", "kind", "a", "b"])
    keys, sizes = [], []
    for a in table.column("a").to_pylist():
        raw = np.frombuffer(a, np.uint8).reshape(-1, 5)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :5] = raw
        keys.append(wide.view("<u8").ravel())
        sizes.append(len(raw))
    every = np.concatenate(keys)
    _, which, times = np.unique(every, return_inverse=True, return_counts=True)
    many = times[which] > 1
    out_chunk, out_a, at = [], [], 0
    for chunk, b, n in zip(table.column("chunk").to_pylist(), table.column("b").to_pylist(), sizes, strict=True):
        hit = many[at:at + n]
        at += n
        if hit.any():
            planes = np.frombuffer(b, "<u2").astype(np.int64)
            where = np.cumsum(planes[:n] + (planes[n:] << 16))
            out_chunk.append(chunk)
            out_a.append(where[hit].astype("<i8").tobytes())
    n = len(out_chunk)
    return pa.table({"chunk": pa.array(out_chunk, pa.int64()), "kind": pa.array([1] * n, pa.int32()), "a": pa.array(out_a, pa.binary()), "b": pa.array([b""] * n, pa.binary())})


def _document_runs(table: pa.Table) -> pa.Table:
    """Of one chunk, per document the runs (start, stop) of suffixes that reach a repeated sample."""
    kind, a, b = (table.column(k).to_pylist() for k in ("kind", "a", "b"))
    whole = kind.index(2)
    ids, off = np.frombuffer(a[whole], "<i8"), np.frombuffer(b[whole], "<i8")
    at = np.unique(np.concatenate([np.frombuffer(x, "<i8") for k, x in zip(kind, a, strict=True) if k == 1]))
    doc = np.searchsorted(off, at, "right") - 1
    lo = np.maximum(at - PERIOD + 1, off[doc])
    hi = np.minimum(at, off[doc + 1] - WINDOW) + 1
    fine = hi > lo
    doc, lo, hi = doc[fine], lo[fine], hi[fine]
    fresh = np.r_[True, (doc[1:] != doc[:-1]) | (lo[1:] > hi[:-1])] if len(doc) else np.zeros(0, bool)
    begin = np.flatnonzero(fresh)
    stop = np.r_[begin[1:], len(doc)] - 1
    d = doc[begin]
    spans = np.column_stack([lo[begin] - off[d], hi[stop] - off[d]]).astype("<i8")
    out = [(int(ids[k]), spans[d == k].tobytes(), int(np.diff(spans[d == k]).sum())) for k in np.unique(d)]
    return pa.table({"doc_id": pa.array([x[0] for x in out], pa.int64()), "runs": pa.array([x[1] for x in out], pa.binary()), "n": pa.array([x[2] for x in out], pa.int64())})


def _least(h: np.ndarray, n: int) -> np.ndarray:
    """Least hash of every PERIOD neighbours from the first n positions on."""
    m, w = h, 1
    while 2 * w <= PERIOD:
        m = np.minimum(m[:len(m) - w], m[w:])
        w *= 2
    return np.minimum(m[:n], m[PERIOD - w:PERIOD - w + n])


def _segments(n_buckets: int):
    """Rows (bucket, doc_id, start, bytes) of neighbouring suffixes with one least sample hash; bytes null: marked already.

    Equal segments of a batch are sent once, by the earliest; the others are repeats of it.
    """
    def run(batches):
        for batch in batches:
            best: dict[bytes, tuple[int, int, int]] = {}
            late = []
            for doc, text, runs in zip(*batch.columns, strict=True):   # a batch's texts aren't copied at once
                doc, raw, runs = doc.as_py(), text.as_py().encode(), runs.as_py()
                buf = np.frombuffer(raw, np.uint8)
                for lo, hi in np.frombuffer(runs, "<i8").reshape(-1, 2):
                    hi = min(int(hi), len(raw) - WINDOW + 1)
                    if hi <= lo:
                        continue
                    n = hi - int(lo)
                    least = _least(_hash_at(buf[lo:hi + WINDOW - 1], np.arange(n + PERIOD - 1), SAMPLE), n)
                    edge = np.r_[0, np.flatnonzero(least[1:] != least[:-1]) + 1, n]
                    for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                        piece = raw[lo + s:lo + e + WINDOW - 1]
                        mine = (doc, int(lo) + s, int(least[s] % np.uint64(n_buckets)))
                        old = best.get(piece)
                        if old is None:
                            best[piece] = mine
                        elif mine[:2] < old[:2]:
                            best[piece] = mine
                            late.append((*old, e - s))
                        elif mine[:2] > old[:2]:
                            late.append((*mine, e - s))
            cols = [[v[k] for v in best.values()] + [v[k] for v in late] for k in range(3)]
            yield pa.RecordBatch.from_arrays([
                pa.array(cols[2], pa.int32()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                pa.array([len(p) - WINDOW + 1 for p in best] + [v[3] for v in late], pa.int64()),
                pa.array([*best] + [None] * len(late), pa.binary())], names=["bucket", "doc_id", "start", "n", "bytes"])
    return run


def _sort_bucket(table: pa.Table) -> pa.Table:
    """Runs (doc_id, start, n) of suffixes in one bucket that occur earlier."""
    doc, start, n, raw = (table.column(k).to_pylist() for k in ("doc_id", "start", "n", "bytes"))
    out = [(d, s, k) for d, s, k, r in zip(doc, start, n, raw, strict=True) if r is None]
    live = [k for k, r in enumerate(raw) if r is not None]
    if live:
        size = np.array([n[k] for k in live])
        buf = np.frombuffer(b"".join(raw[k] for k in live), np.uint8)
        base = np.cumsum(size + WINDOW - 1) - (size + WINDOW - 1)
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        at = np.repeat(base, size) + step
        d = np.repeat(np.array([doc[k] for k in live]), size)
        s = np.repeat(np.array([start[k] for k in live]), size) + step
        h = _hash_at(buf, at, WINDOW)
        order = np.lexsort((s, d, h))
        h, d, s, at = h[order], d[order], s[order], at[order]
        head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        first = np.repeat(head, np.diff(np.r_[head, len(h)]))
        later = np.flatnonzero((d != d[first]) | (s != s[first]))
        words = np.ndarray((max(0, len(buf) - 7),), "<u8", buf.data, strides=(1,))
        same = np.ones(len(later), bool)
        for k in [*range(0, WINDOW - 7, 8), WINDOW - 8]:
            same &= words[at[later] + k] == words[at[first[later]] + k]
        later = later[same]
        order = np.lexsort((s[later], d[later]))
        d, s = d[later][order], s[later][order]
        edge = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (s[1:] > s[:-1] + 1)]) if len(d) else np.zeros(0, int)
        stop = np.r_[edge[1:], len(d)] - 1 if len(d) else edge
        out += zip(d[edge].tolist(), s[edge].tolist(), (s[stop] - s[edge] + 1).tolist(), strict=True)
    cols = list(zip(*out, strict=True)) or [[], [], []]
    return pa.table({"doc_id": pa.array(cols[0], pa.int64()), "start": pa.array(cols[1], pa.int64()), "n": pa.array(cols[2], pa.int64())})


def _cover_spans(runs, size: int) -> list[tuple[int, int]]:
    """Maximal removed byte ranges of a text from the runs of its marked suffixes."""
    out: list[list[int]] = []
    for s, n in sorted(runs):
        e = min(size, s + n - 1 + WINDOW)
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(a, b) for a, b in out]


class Repeats:
    """identity (doc_id, n_bytes, sha, copy) of every row, and marked (doc_id, text, runs) of texts that lose bytes in part.

    A text of WINDOW bytes or more that a smaller doc_id has in full loses everything and needs no search: what
    it could show to be a repeat, the first of its copies shows as well.
    """

    def __init__(self, docs: DataFrame, scratch: Scratch):
        src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        ids = scratch.table(src.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha")), "ids")
        first = ids.groupBy("sha").agg(F.min("doc_id").alias("first"))
        self.identity = scratch.table(ids.join(first, "sha").select(
            "doc_id", "n_bytes", "sha", ((F.col("n_bytes") >= WINDOW) & (F.col("doc_id") > F.col("first"))).alias("copy")), "identity")
        n_bytes = self.identity.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
        ranks = max(8, -(-n_bytes * len(COVER) // PERIOD // RANK_ROWS))
        long = src.where(F.octet_length("text") >= WINDOW)
        # each phase ends in a table and drops its frames, so that release() can free their shuffle files
        scratch.table(self._ranked(long, ranks), "ranked")
        scratch.release()
        runs = scratch.table(self._joined_runs(scratch.read("ranked")), "runs")
        reach = runs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        some = scratch.table(long.join(runs.select("doc_id", "runs"), "doc_id"), "some")
        scratch.release()
        buckets = max(8, -(-reach * 5 // BUCKET_BYTES))
        self.marks = scratch.table(self._marked(some, buckets), "marks")
        scratch.release()
        self.marked = some.select("doc_id", "text").join(self.marks, "doc_id")

    @staticmethod
    def _ranked(long: DataFrame, buckets: int) -> DataFrame:
        sampled = long.select("doc_id", "text").mapInArrow(_sample_rows(buckets), "bucket int, chunk bigint, kind int, a binary, b binary")
        found = sampled.groupBy("bucket").applyInArrow(_repeated_ranks, "chunk bigint, kind int, a binary, b binary")
        return found.groupBy("chunk").applyInArrow(_document_runs, "doc_id bigint, runs binary, n bigint")

    def _joined_runs(self, runs: DataFrame) -> DataFrame:
        copies = self.identity.where("copy").select("doc_id").distinct()
        per = runs.join(copies, "doc_id", "left_anti").groupBy("doc_id").agg(F.array_join(F.collect_list(F.hex("runs")), "").alias("r"), F.sum("n").alias("n"))
        return per.select("doc_id", F.unhex("r").alias("runs"), "n")

    @staticmethod
    def _marked(some: DataFrame, buckets: int) -> DataFrame:
        cut = some.select("doc_id", "text", "runs").mapInArrow(_segments(buckets), "bucket int, doc_id bigint, start bigint, n bigint, bytes binary")
        marks = cut.groupBy("bucket").applyInArrow(_sort_bucket, "doc_id bigint, start bigint, n bigint")
        return marks.groupBy("doc_id").agg(F.collect_set(F.struct("start", "n")).alias("runs"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row of ``docs`` (doc_id, text).

    Null text: empty, nothing removed. Texts under WINDOW bytes never repeat. Rows that share a doc_id count as
    one document whose starts are compared, so of equal rows none removes the other. No rows: no rows.
    """
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    found = Repeats(docs, scratch)
    names = ["doc_id", "sha", "n_removed", "n_spans", "kept"]

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = text.encode()
                spans = _cover_spans([(r["start"], r["n"]) for r in runs], len(raw))
                left = hashlib.sha256()
                at = 0
                for a, b in spans:
                    left.update(raw[at:a])
                    at = b
                left.update(raw[at:])
                rows.append((doc, hashlib.sha256(raw).hexdigest(), sum(b - a for a, b in spans), len(spans), left.hexdigest()))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    part = found.marked.mapInArrow(run, "doc_id bigint, sha string, n_removed bigint, n_spans bigint, kept string").dropDuplicates(["doc_id", "sha"])
    whole = found.identity.join(part, ["doc_id", "sha"], "left")
    copy = F.col("copy")
    return whole.select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated strings cut from the texts, whole characters only; emptied texts go, and whole copies.

    All columns of ``docs`` stay; n_chars, where present, is counted anew for changed texts.
    """
    found = Repeats(docs, Scratch(docs.sparkSession, "suffix-dedup"))
    copies = found.identity.where("copy").select("doc_id").distinct()
    kept = docs.join(copies, "doc_id", "left_anti").join(found.marks.withColumnRenamed("runs", "_marks"), "doc_id", "left").select(*docs.columns, "_marks")
    names = list(docs.columns)
    at = names.index("text")
    counted = names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for batch in batches:
            marks = batch.column(len(names)).to_pylist()
            texts = []
            for text, runs in zip(batch.column(at).to_pylist(), marks, strict=True):
                if runs:
                    raw = text.encode()
                    keep = bytearray()
                    end = 0
                    for a, b in _cover_spans([(r["start"], r["n"]) for r in runs], len(raw)):
                        while a < b and raw[a] & 0xC0 == 0x80:
                            a += 1
                        while b < len(raw) and b > a and raw[b] & 0xC0 == 0x80:
                            b -= 1
                        keep += raw[end:a]
                        end = max(end, b)
                    text = (bytes(keep) + raw[end:]).decode()
                    if not text.strip():
                        text = None
                texts.append(text)
            cols = [*batch.columns[:-1]]
            cols[at] = pa.array(texts, cols[at].type)
            if counted is not None:
                was = cols[counted].to_pylist()
                cols[counted] = pa.array([len(t) if r and t else n for t, r, n in zip(texts, marks, was, strict=True)], cols[counted].type)
            stay = pa.array([t is not None or not r for t, r in zip(texts, marks, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(stay)
    return kept.mapInArrow(run, docs.schema)
