"""Benchmark decontamination: a BM25 index of test items, queried by every training passage.

Items are indexed in shards of bounded size, so that an index can be broadcast
however many items there are. Impacts are divided by the item's own full score,
so one threshold holds for all items and a score is the share of an item's BM25
weight that a passage has. Items lie in blocks with the greatest impact of each
term; a document, then a passage, opens a block only if its terms' block maxima
reach the threshold, and only items of opened blocks are scored exactly. Hits
are verified by the overlap of the item's question and answer with the passage;
an item without a question mark has no such border, so its whole verifies as well.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import text as tx

#: items of a broadcast index shard, and of a block of one
SHARD_ITEMS, BLOCK_ITEMS = 4000, 4
K1, B = 1.2, 0.75
#: share of an item's BM25 weight that a passage must have, and share of five-word shingles that verify it
THRESHOLD, OVERLAP, SHINGLE = 0.6, 0.75, 5


def _words(text: str | None) -> np.ndarray:
    buf, off = tx.utf8(pa.array([text or ""]))
    buf = tx.LOWER[buf]
    s, e, _ = tx.words(buf, off)
    return tx.hashes(buf, s, e)


def _border(text: str) -> int:
    """Behind the last question mark that text follows, or 0."""
    q = text.rfind("?") + 1
    return q if text[q:].strip() else 0


def _halves(text: str) -> tuple[str, str]:
    """Question and answer: behind the last question mark, else the halves by words."""
    q = _border(text)
    if q:
        return text[:q], text[q:]
    w = text.split()
    return " ".join(w[:len(w) // 2]), " ".join(w[len(w) // 2:])


def _shingles(h: np.ndarray, k: int) -> np.ndarray:
    return np.unique(tx.shingles(h, np.zeros(len(h), np.int64), 1, k)[0])


class Index:
    """One shard: postings by term and block, block maxima, and the shingles that verify a hit."""

    def __init__(self, items: list[tuple[int, str]], df: dict[int, int], n_items: int, mean_words: float):
        self.ids = np.array([i for i, _ in items], np.int64)
        words = [_words(t) for _, t in items]
        self.longest = max([1, *map(len, words)])
        self.parts, self.whole = [], []
        rows_t, rows_i, rows_w = [], [], []
        for i, w in enumerate(words):
            halves = [x for x in map(_words, _halves(items[i][1])) if len(x)]
            self.parts.append([(min(SHINGLE, len(x)), _shingles(x, min(SHINGLE, len(x)))) for x in halves])
            self.whole.append(None if _border(items[i][1]) else (min(SHINGLE, len(w)), _shingles(w, min(SHINGLE, len(w)))))
            terms, tf = np.unique(w, return_counts=True)
            idf = np.log(1 + np.array([(n_items - df[int(t)] + 0.5) / (df[int(t)] + 0.5) for t in terms.view(np.int64)]))
            impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean_words))
            rows_t.append(terms)
            rows_i.append(np.full(len(terms), i))
            rows_w.append(impact / max(impact.sum(), 1e-12))
        t, i, w = np.concatenate(rows_t), np.concatenate(rows_i), np.concatenate(rows_w)
        self.terms, t = np.unique(t, return_inverse=True)
        order = np.lexsort((i, t))
        t, self.item, self.impact = t[order], i[order], w[order]
        self.post = np.searchsorted(t, np.arange(len(self.terms) + 1))
        block = self.item // BLOCK_ITEMS
        fresh = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (block[1:] != block[:-1])])
        self.block, self.block_max = block[fresh], np.maximum.reduceat(self.impact, fresh)
        self.block_post = np.searchsorted(t[fresh], np.arange(len(self.terms) + 1))
        self.n_blocks = int(block.max()) + 1
        self.n_items = len(items)

    def term_ids(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return np.where(self.terms[at] == h, at, -1)

    @staticmethod
    def _gather(row: np.ndarray, term: np.ndarray, post: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and posting of every posting of the rows' terms."""
        size = post[term + 1] - post[term]
        begin = np.cumsum(size) - size
        at = np.arange(int(size.sum())) - np.repeat(begin - post[term], size)
        return np.repeat(row, size), at

    def open_blocks(self, row: np.ndarray, term: np.ndarray, n_rows: int) -> np.ndarray:
        """row * n_blocks + block wherever the rows' distinct terms can reach the threshold."""
        r, at = self._gather(row, term, self.block_post)
        bound = np.bincount(r * self.n_blocks + self.block[at], self.block_max[at], minlength=n_rows * self.n_blocks)
        return np.flatnonzero(bound >= THRESHOLD - 1e-9)

    def hits(self, row: np.ndarray, term: np.ndarray, opened: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, item and score of all items of opened blocks that reach the threshold."""
        r, at = self._gather(row, term, self.post)
        key = r * self.n_blocks + self.item[at] // BLOCK_ITEMS
        place = np.minimum(np.searchsorted(opened, key), len(opened) - 1)
        live = opened[place] == key
        pair, which = np.unique(r[live] * self.n_items + self.item[at[live]], return_inverse=True)
        score = np.bincount(which, self.impact[at[live]])
        good = score >= THRESHOLD - 1e-9
        return pair[good] // self.n_items, pair[good] % self.n_items, score[good]

    def _distinct(self, row: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = np.unique(row * np.int64(len(self.terms)) + term)
        return key // len(self.terms), key % len(self.terms)

    def search(self, buf: np.ndarray, off: np.ndarray) -> list[tuple[int, int, float, float, float]]:
        """(document, item, score, question overlap, answer overlap) of all verified hits, best passage each."""
        n = len(off) - 1
        buf = tx.LOWER[buf]
        s, e, d = tx.words(buf, off)
        h = tx.hashes(buf, s, e)
        t = self.term_ids(h)
        known = t >= 0
        row, term = self._distinct(d[known], t[known])
        out = []
        step = max(1, (1 << 22) // self.n_blocks)
        for lo in range(0, n, step):
            hi = min(n, lo + step)
            a, b = np.searchsorted(row, (lo, hi))
            opened = self.open_blocks(row[a:b] - lo, term[a:b], hi - lo)
            for doc in np.unique(opened // self.n_blocks) + lo:
                w0, w1 = np.searchsorted(d, (doc, doc + 1))
                out += [(int(doc), *x) for x in self.search_document(h[w0:w1], t[w0:w1])]
        return out

    def search_document(self, h: np.ndarray, t: np.ndarray) -> list[tuple[int, float, float, float]]:
        """Queries with every passage: windows of twice the longest item, one item length apart."""
        wide = 2 * self.longest
        starts = np.arange(0, max(1, len(h) - self.longest), self.longest)
        best: dict[int, tuple[float, float, float]] = {}
        for lo in range(0, len(starts), 512):
            some = starts[lo:lo + 512]
            size = np.minimum(some + wide, len(h)) - some
            row = np.repeat(np.arange(len(some)), size)
            pos = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - some, size)
            term = t[pos]
            row, term = self._distinct(row[term >= 0], term[term >= 0])
            opened = self.open_blocks(row, term, len(some))
            if not len(opened):
                continue
            for r, i, score in zip(*self.hits(row, term, opened), strict=True):
                passage = h[some[r]:some[r] + size[r]]
                share = [float(np.isin(p, _shingles(passage, k)).mean()) for k, p in self.parts[i]]
                good = share and min(share) >= OVERLAP
                if share and not good and self.whole[i]:
                    k, p = self.whole[i]
                    good = np.isin(p, _shingles(passage, k)).mean() >= OVERLAP
                if good:
                    got = (float(score), share[0], share[-1])
                    best[int(i)] = max(best.get(int(i), (0.0, 0.0, 0.0)), got)
        return [(i, *v) for i, v in sorted(best.items())]


def index_shards(benchmark: DataFrame):
    """Index shards of at most SHARD_ITEMS items each; statistics are those of all items.

    Null and wordless items are left out; repeated items count once by id and text.
    """
    items = benchmark.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("item_id", "text").distinct()
    hashed = items.mapInArrow(_item_terms, "item_id bigint, words bigint, term bigint")
    per_item = hashed.groupBy("item_id").agg(F.max("words").alias("words"))
    n, mean = per_item.agg(F.count("*"), F.avg("words")).first()
    if not n:
        return
    shards = -(-n // SHARD_ITEMS)
    shard = F.pmod(F.xxhash64("item_id"), F.lit(2 * shards if shards > 1 else 1))
    df = hashed.groupBy("term").agg(F.countDistinct("item_id").alias("df"))
    for k in range(2 * shards if shards > 1 else 1):
        rows = [(r.item_id, r.text) for r in items.where(shard == k).orderBy("item_id", "text").collect()]
        if rows:
            terms = hashed.where(shard == k).select("term").distinct()
            yield Index(rows, {r.term: r.df for r in df.join(terms, "term").collect()}, n, mean)


def _item_terms(batches):
    for batch in batches:
        ids, words, terms = [], [], []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            h = _words(t)
            u = np.unique(h).view(np.int64)
            ids += [i] * len(u)
            words += [len(h)] * len(u)
            terms += u.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.int64()), pa.array(terms, pa.int64())], names=["item_id", "words", "term"])


def _search_batch(index: Index, col) -> list[tuple]:
    buf, off = tx.utf8(col)
    return [(i + d, *rest) for i, j in tx.pieces(off) for d, *rest in index.search(buf[off[i]:off[j]], off[i:j + 1] - off[i])]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: one row per document row and item it holds.

    Null or empty texts hold nothing; a repeated row gives its rows again; no items: no rows.
    """
    spec = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double"
    names = [x.split()[0] for x in spec.split(", ")]
    found = None
    for index in index_shards(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                got = _search_batch(shared.value, batch.column(1))
                doc = batch.column(0).to_pylist()
                cols = [[doc[r[0]] for r in got], [int(shared.value.ids[r[1]]) for r in got], *[[r[k] for r in got] for k in (2, 3, 4)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 2 else pa.float64()) for k, c in enumerate(cols)], names=names)

        part = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, spec)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], spec)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; one pass per index shard, no shuffle."""
    at = docs.columns.index("text")
    for index in index_shards(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                bad = {r[0] for r in _search_batch(shared.value, batch.column(at))}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
