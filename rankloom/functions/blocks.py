"""Exact top-n of ``offset + vector · item vector + item bias`` by blocks of queries and items.

Neither side passes through the driver or one task, whatever its size. Items with few
distinct vectors (feature flags; none at all) lie in blocks by vector, then falling bias:

* a block holds each of its vectors once, and the bias that the first 1, 2, 4, ... items
  of a vector reach; these are all that a query meets at first;
* they give a score that ``n`` + seen items reach, so the query's n-th unseen item does;
* a query is sent to the blocks where a vector's best item reaches that score, hot blocks
  in several shares, and only items that reach it come back;
* where the first items of all vectors are few (``HEADS``), queries that cannot need an item
  beyond them (few seen items) are answered where they lie, and no found item is shuffled.

Items with many distinct vectors lie in blocks by falling ``bias + norm``:

* queries (a user, or a request with its own vector, length and seen items) are scored
  against the first block, which leaves each with a score that its n-th item must reach;
* by the Cauchy-Schwarz bound ``offset + |vector| · largest norm + largest bias`` a
  block of queries only meets the item blocks that can still matter to one of them, and
  there only the queries they can matter to.

The best of all blocks are merged per query. Order is by score rounded to 9 decimals, then
item; items in ``seen`` never appear.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.ranking import score_key, sequence_within, top_n
from rankloom.session import ensure_checkpoint_dir

#: items of a block, queries of a block, and queries of one score matrix
ITEMS, QUERIES, MATRIX = 8192, 2048, 256
#: distinct vectors up to which items lie by vector; those a query's bound is read from; queries of a block's share
VECTORS, NEAREST, SHARE = 4096, 64, 16384
#: first items of a vector beyond a list's length that heads may hold, and items of all heads
HEAD, HEADS = (1024, 256), 1 << 19
#: what rounding to 9 decimals can move a score
SLACK = 1e-8

FOUND = "qid long, item_idx long, score double"


def _matrix(column, rows: int) -> np.ndarray:
    """Vectors of an Arrow list column as rows; nulls and missing vectors are zeros."""
    filled = [v if v is not None else [] for v in column.to_pylist()]
    out = np.zeros((rows, max(map(len, filled), default=0)))
    for k, v in enumerate(filled):
        out[k, :len(v)] = [x if x is not None else 0.0 for x in v]
    return out


def _read(data: bytes, kind=np.float64) -> np.ndarray:
    return np.frombuffer(data, kind) if data else np.zeros(0, kind)


def _distinct(vec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, and each row's number among them."""
    if not vec.shape[1]:
        return vec[:1], np.zeros(len(vec), np.int64)
    rows, at = np.unique(vec, axis=0, return_inverse=True)
    return rows, at.reshape(-1)


def _pack_items(key, rows):
    """One row per item block, its items by number; ``kind`` numbers their vectors where items lie by vector."""
    rows = rows.sort_by("item_idx")
    vec = _matrix(rows["vec"].combine_chunks(), rows.num_rows)
    bias = rows["bias"].to_numpy()
    norm, kind, steps = float(np.sqrt((vec * vec).sum(1)).max(initial=0.0)), b"", [b""] * 3
    if rows["by_vector"][0].as_py():
        vec, at = _distinct(vec)
        order = np.lexsort((-bias, at))
        first = np.searchsorted(at[order], np.arange(len(vec)))
        nth = np.arange(len(at)) - first[at[order]] + 1
        step = np.flatnonzero((nth & (nth - 1) == 0) | np.r_[at[order][1:] != at[order][:-1], True])
        # the items of a vector since its step before have at least this bias
        steps = [at[order][step].tobytes(), bias[order][step].tobytes(), np.diff(step, prepend=-1).tobytes()]
        kind = at.astype(np.int32).tobytes()
    return pa.table({"block": pa.array([key[0].as_py()]), "by_vector": rows["by_vector"].slice(0, 1), "copies": rows["copies"].slice(0, 1),
                     "n_items": pa.array([rows.num_rows]), "norm": pa.array([norm]), "top": pa.array([float(bias.max(initial=-np.inf))]),
                     "ids": pa.array([rows["item_idx"].to_numpy().astype(np.int64).tobytes()], pa.binary()),
                     "vecs": pa.array([vec.tobytes()], pa.binary()), "kind": pa.array([kind], pa.binary()),
                     "biases": pa.array([bias.tobytes()], pa.binary()),
                     **{c: pa.array([x], pa.binary()) for c, x in zip(_STEPS, steps)}})


_STEPS = ("step_vec", "step_bias", "step_n")


def item_blocks(items: DataFrame) -> DataFrame:
    """``items``: item_idx, vec, bias → blocks of ``ITEMS`` items with their largest norm and bias, checkpointed."""
    ensure_checkpoint_dir(items.sparkSession)
    items = items.select("item_idx", F.coalesce("vec", F.array().cast("array<double>")).alias("vec"),
                         F.col("bias").cast("double").alias("bias")).checkpoint()
    copies = items.groupBy("item_idx").count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    # how items lie, not what is found, depends on this estimate
    by_vector = items.agg(F.approx_count_distinct("vec")).first()[0] <= VECTORS
    keys = ["vec", "_key"] if by_vector else ["_key"]
    numbered = sequence_within(items.withColumn("_key", -F.col("bias") if by_vector else -(F.col("bias") + norm)),
                               [], [*keys, "item_idx"], rn="_rn", count=None)
    return (numbered.withColumn("block", F.floor((F.col("_rn") - 1) / ITEMS).cast("long"))
            .select("block", "item_idx", "vec", "bias", F.lit(by_vector).alias("by_vector"), F.lit(copies).cast("long").alias("copies")).groupBy("block")
            .applyInArrow(_pack_items, "block long, by_vector boolean, copies long, n_items long, norm double, top double, ids binary, vecs binary, "
                                       "kind binary, biases binary, step_vec binary, step_bias binary, step_n binary")
            .checkpoint())


def _best(block: dict, vec, off, n, seen):
    """(query row, item, score) of each query's first n unseen items of one block."""
    ids = _read(block["ids"], np.int64)
    kind = _read(block["kind"], np.int32)
    items = _read(block["vecs"]).reshape(int(kind.max()) + 1 if len(kind) else len(ids), -1)
    biases = _read(block["biases"])
    width = min(vec.shape[1], items.shape[1])
    out = []
    for at in range(0, len(vec), MATRIX):
        part = slice(at, at + MATRIX)
        scores = vec[part, :width] @ items[:, :width].T
        scores = (scores[:, kind] if len(kind) else scores) + biases + off[part, None]
        lists = seen[part]
        gone = np.concatenate([np.asarray(s, np.int64) for s in lists]) if lists else np.zeros(0, np.int64)
        col = np.minimum(np.searchsorted(ids, gone), len(ids) - 1)
        here = ids[col] == gone
        scores[np.repeat(np.arange(len(lists)), [len(s) for s in lists])[here], col[here]] = -np.inf
        most = min(int(n[part].max(initial=0)), len(ids))
        if not most:
            continue
        least = np.partition(scores, len(ids) - most, axis=1)[:, len(ids) - most]
        row, col = np.nonzero((scores >= least[:, None] - SLACK) & (scores > -np.inf))
        found = scores[row, col]
        order = np.lexsort((ids[col], -np.round(found, 9), row))
        row, col, found = row[order], col[order], found[order]
        first = np.searchsorted(row, np.arange(len(lists)))
        keep = np.arange(len(row)) - first[row] < n[part][row]
        out.append((row[keep] + at, ids[col[keep]], found[keep]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out))


_BLOCK = ("ids", "vecs", "kind", "biases")
_QUERIES = "qids binary, vec binary, off binary, n binary, seen array<array<long>>"
_ROUND1 = _QUERIES + ", least binary, later array<long>, found_q binary, found_i binary, found_s binary"
_QUERY_FIELDS = [*((c, pa.binary()) for c in ("qids", "vec", "off", "n")), ("seen", pa.list_(pa.list_(pa.int64())))]


def _pack_queries(batches):
    """One row per block of queries, so that an item block is sent to it once."""
    schema = pa.schema(_QUERY_FIELDS)
    for whole in batches:
        for at in range(0, whole.num_rows, QUERIES):
            b = whole.slice(at, QUERIES)
            qid, off, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("qid", "off", "n"))
            values = [qid.astype(np.int64).tobytes(), _matrix(b.column("vec"), b.num_rows).tobytes(),
                      off.astype(float).tobytes(), n.astype(np.int64).tobytes(), [s or [] for s in b.column("seen").to_pylist()]]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, schema.types)], schema=schema)


def _unpack_queries(r: dict):
    qid = _read(r["qids"], np.int64)
    return qid, _read(r["vec"]).reshape(len(qid), -1), _read(r["off"]), _read(r["n"], np.int64)


def _first_block(batches):
    """Scores blocks of queries against the first item block; names the item blocks they still need."""
    schema = pa.schema([*_QUERY_FIELDS, ("least", pa.binary()), ("later", pa.list_(pa.int64())),
                        *((c, pa.binary()) for c in ("found_q", "found_i", "found_s"))])
    for b in batches:
        for k in range(b.num_rows):
            r = {c: b.column(c)[k].as_py() for c in b.schema.names}
            qid, vec, off, n = _unpack_queries(r)
            row, item, score = _best(r, vec, off, n, r["seen"])
            count = np.bincount(row, minlength=len(n))
            least = np.full(len(n), -np.inf)
            full = (count >= n) & (n > 0)
            least[full] = score[np.cumsum(count)[full] - 1]
            norm = np.sqrt((vec * vec).sum(1))
            later = [block for block, norm_b, top_b in zip(r["blocks"], r["norms"], r["tops"])
                     if (off + norm * norm_b + top_b >= least - SLACK).any()]
            values = [r["qids"], r["vec"], r["off"], r["n"], r["seen"], least.tobytes(), later,
                      qid[row].tobytes(), item.tobytes(), score.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, schema.types)], schema=schema)


def _results(qid, item, score):
    return pa.RecordBatch.from_arrays([pa.array(qid, pa.int64()), pa.array(item, pa.int64()), pa.array(score, pa.float64())],
                                      names=["qid", "item_idx", "score"])


def _unpack_found(batches):
    for b in batches:
        for q, i, s in zip(*(c.to_pylist() for c in b.columns)):
            yield _results(_read(q, np.int64), _read(i, np.int64), _read(s))


def _later_block(batches):
    """Scores the queries of a block that an item block can still matter to."""
    for b in batches:
        for k in range(b.num_rows):
            r = {c: b.column(c)[k].as_py() for c in b.schema.names}
            (qid, vec, off, n), least = _unpack_queries(r), _read(r["least"])
            need = np.flatnonzero(off + np.sqrt((vec * vec).sum(1)) * r["norm"] + r["top"] >= least - SLACK)
            row, item, score = _best(r, vec[need], off[need], n[need], [r["seen"][j] for j in need])
            yield _results(qid[need][row], item, score)


class _Steps:
    """What queries meet first of blocks by vector: vectors, each with the biases its first 1, 2, 4, ... items of a block reach."""

    def __init__(self, blocks: list[dict]):
        blocks = sorted(blocks, key=lambda b: b["block"])
        at = [_read(b["step_vec"], np.int64) for b in blocks]
        count = np.array([int(x[-1]) + 1 for x in at])
        vecs = [_read(b["vecs"]).reshape(k, -1) for b, k in zip(blocks, count)]
        self.copies = max(b["copies"] for b in blocks)
        self.blocks, self.first = [b["block"] for b in blocks], np.cumsum(count) - count
        self.vecs = np.zeros((int(count.sum()), max(v.shape[1] for v in vecs)))
        for k, v in zip(self.first, vecs):
            self.vecs[k:k + len(v), :v.shape[1]] = v
        row = np.concatenate([x + k for x, k in zip(at, self.first)])
        col = np.arange(len(row)) - np.searchsorted(row, row)
        self.bias = np.full((len(self.vecs), int(col.max()) + 1), -np.inf)
        self.n = np.zeros(self.bias.shape, np.int64)
        self.bias[row, col] = np.concatenate([_read(b["step_bias"]) for b in blocks])
        self.n[row, col] = np.concatenate([_read(b["step_n"], np.int64) for b in blocks])

    def _reached(self, near: np.ndarray, bias: np.ndarray, n: np.ndarray, need: np.ndarray) -> np.ndarray:
        """The score that the first ``need`` items of these vectors reach, -inf if there are fewer."""
        value = (near[:, :, None] + bias).reshape(len(near), -1)
        order = np.argsort(-value, axis=1)
        total = np.cumsum(np.take_along_axis(np.broadcast_to(n, (*near.shape, n.shape[-1])).reshape(value.shape), order, axis=1), axis=1)
        at = (total < need[:, None]).sum(1)
        least = value[np.arange(len(near)), order[np.arange(len(near)), np.minimum(at, value.shape[1] - 1)]]
        return np.where(at < value.shape[1], least, -np.inf)

    def route(self, vec: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every query's score, without offset, that ``need`` items reach; and which blocks hold items that reach it."""
        width = min(vec.shape[1], self.vecs.shape[1])
        near = vec[:, :width] @ self.vecs[:, :width].T
        best = near + self.bias[:, 0]
        if len(self.vecs) > NEAREST:
            some = np.argpartition(-best, NEAREST, axis=1)[:, :NEAREST]
            least = self._reached(np.take_along_axis(near, some, axis=1), self.bias[some], self.n[some], need)
            for k in np.flatnonzero(least == -np.inf):
                least[k] = self._reached(near[k:k + 1], self.bias, self.n, need[k:k + 1])[0]
        else:
            least = self._reached(near, self.bias, self.n, need)
        return least, np.logical_or.reduceat(best >= least[:, None] - SLACK, self.first, axis=1)


_ROUTED = "block long, asked long, qids binary, vec binary, off binary, n binary, least binary, seen binary, seen_n binary"


def _route(batches):
    """Sends blocks of queries to the item blocks that can matter to them, each with the queries it can matter to."""
    for b in batches:
        for k in range(b.num_rows):
            r = {c: b.column(c)[k].as_py() for c in b.schema.names}
            qid, vec, off, n = _unpack_queries(r)
            steps = _Steps(r["blocks"])
            seen_n = np.array([len(s) for s in r["seen"]], np.int64)
            parts = [steps.route(vec[at:at + MATRIX], (n + seen_n * steps.copies)[at:at + MATRIX]) for at in range(0, len(qid), MATRIX)]
            least, needed = (np.concatenate(x) for x in zip(*parts))
            needed &= (n > 0)[:, None]
            out = [[] for _ in range(9)]
            for j in np.flatnonzero(needed.any(axis=0)):
                q = np.flatnonzero(needed[:, j])
                gone = np.concatenate([np.asarray(r["seen"][i], np.int64) for i in q])
                values = [steps.blocks[j], len(q), *(x.tobytes() for x in (qid[q], vec[q], off[q], n[q], (least + off)[q], gone, seen_n[q]))]
                for column, value in zip(out, values):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 7]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)],
                                             names=[c.split()[0] for c in _ROUTED.split(", ")])


def _score_share(queries: pa.Table, block: pa.Table) -> pa.Table:
    """What a share of the queries sent to a block finds there."""
    packs = queries.to_pylist()
    qid, n, seen_n = (np.concatenate([_read(p[c], np.int64) for p in packs]) for c in ("qids", "n", "seen_n"))
    off, least = (np.concatenate([_read(p[c]) for p in packs]) for c in ("off", "least"))
    vecs = [_read(p["vec"]).reshape(p["asked"], -1) for p in packs]
    vec = np.zeros((len(qid), max(v.shape[1] for v in vecs)))
    at = 0
    for v in vecs:
        vec[at:at + len(v), :v.shape[1]] = v
        at += len(v)
    seen = np.split(np.concatenate([_read(p["seen"], np.int64) for p in packs]), np.cumsum(seen_n)[:-1])
    row, item, score = _best(block.to_pylist()[0], vec, off, n, seen)
    keep = score >= least[row] - SLACK
    return pa.Table.from_batches([_results(qid[row[keep]], item[keep], score[keep])])


def _found_by_vector(asked: DataFrame, blocks: DataFrame) -> DataFrame:
    steps = blocks.agg(F.collect_list(F.struct("block", "copies", "vecs", *_STEPS)).alias("blocks"))
    routed = asked.mapInArrow(_pack_queries, _QUERIES).join(F.broadcast(steps)).mapInArrow(_route, _ROUTED).checkpoint()
    shares = F.broadcast(routed.groupBy("block").agg(F.ceil(F.sum("asked") / SHARE).cast("long").alias("shares")))
    sent = routed.join(shares, "block").withColumn("share", F.pmod(F.xxhash64("qids"), F.col("shares"))).drop("shares")
    held = (blocks.select("block", *_BLOCK).join(shares, "block")
            .withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).drop("shares"))
    return sent.groupBy("block", "share").cogroup(held.groupBy("block", "share")).applyInArrow(_score_share, FOUND)


def _block_heads(most: int):
    """The first ``most`` items of every vector of a block, by falling bias, and how many items it has there."""
    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                r = {c: b.column(c)[k].as_py() for c in b.schema.names}
                ids, kind, bias = _read(r["ids"], np.int64), _read(r["kind"], np.int32), _read(r["biases"])
                vecs = _read(r["vecs"]).reshape(int(kind.max()) + 1, -1)
                order = np.lexsort((ids, -bias, kind))
                ends = np.searchsorted(kind[order], np.arange(len(vecs) + 1))
                heads = [order[a:min(a + most, z)] for a, z in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in vecs], pa.binary()), pa.array([ids[h].tobytes() for h in heads], pa.binary()),
                                                  pa.array([bias[h].tobytes() for h in heads], pa.binary()), pa.array(np.diff(ends), pa.int64())],
                                                 names=["vec", "ids", "biases", "n"])
    return run


def _merge_heads(most: int):
    def run(key, rows):
        ids = np.concatenate([_read(x, np.int64) for x in rows["ids"].to_pylist()])
        bias = np.concatenate([_read(x) for x in rows["biases"].to_pylist()])
        order = np.lexsort((ids, -bias))[:most]
        whole = len(order) == sum(rows["n"].to_pylist())
        # items left out can be among the first of these only if a rounded score of theirs is equal
        safe = -1 if whole else int((bias[order] > bias[order[-1]] + SLACK).sum())
        return pa.table({"vec": pa.array([key[0].as_py()], pa.binary()), "ids": pa.array([ids[order].tobytes()], pa.binary()),
                         "biases": pa.array([bias[order].tobytes()], pa.binary()), "n": pa.array([len(order)], pa.int64()),
                         "safe": pa.array([safe], pa.int64()), "odd": pa.array([bool(np.isnan(bias).any())])})
    return run


class Heads(_Steps):
    """The first items of every vector, from ``item_heads``."""

    def __init__(self, rows: list):
        steps = []
        for k, r in enumerate(rows):
            bias = _read(r["biases"])
            nth = np.arange(1, len(bias) + 1)
            step = np.flatnonzero((nth & (nth - 1) == 0) | (nth == len(bias)))
            steps.append({"block": k, "copies": 1, "vecs": r["vec"], "step_vec": np.zeros(len(step), np.int64).tobytes(),
                          "step_bias": bias[step].tobytes(), "step_n": np.diff(step, prepend=-1).tobytes()})
        super().__init__(steps)
        self.ids = np.concatenate([_read(r["ids"], np.int64) for r in rows])
        self.biases = np.concatenate([_read(r["biases"]) for r in rows])
        self.size = np.array([len(r["ids"]) // 8 for r in rows])
        self.start = np.cumsum(self.size) - self.size

    def _reach(self, v: np.ndarray, bar: np.ndarray) -> np.ndarray:
        """How many of a vector's items have at least this bias."""
        low, high = np.zeros(len(v), np.int64), self.size[v]
        while (low < high).any():
            mid = (low + high) // 2
            up = (low < high) & (self.biases[np.minimum(self.start[v] + mid, len(self.biases) - 1)] >= bar)
            low, high = np.where(up, mid + 1, low), np.where(up | (low >= high), high, mid)
        return low

    def find(self, vec: np.ndarray, off: np.ndarray, n: np.ndarray, gone: np.ndarray, gone_n: np.ndarray):
        """(query row, item, score) of each query's first n unseen items, in order; ``gone``: the seen items of all, ``gone_n`` each."""
        out, width, span = [], min(vec.shape[1], self.vecs.shape[1]), int(self.ids.max()) + 1
        till = np.cumsum(gone_n)
        for at in range(0, len(n), MATRIX):
            part = slice(at, at + MATRIX)
            least, needed = self.route(vec[part], (n + gone_n)[part])
            q, v = np.nonzero(needed & (n[part] > 0)[:, None])
            near = (vec[part, :width] @ self.vecs[:, :width].T)[q, v]
            count = self._reach(v, least[q] - near - SLACK)
            pair = np.repeat(np.arange(len(q)), count)
            place = self.start[v][pair] + np.arange(len(pair)) - (np.cumsum(count) - count)[pair]
            row, item = q[pair], self.ids[place]
            score = near[pair] + self.biases[place] + off[part][row]
            seen = gone[till[at] - gone_n[at]:till[part][-1]]
            seen = (np.repeat(np.arange(len(n[part])), gone_n[part]) * span + seen)[(seen >= 0) & (seen < span)]
            keep = ~np.isin(row * span + item, seen) & (score > -np.inf)
            row, item, score = row[keep], item[keep], score[keep]
            order = np.lexsort((item, -np.round(score, 9), row))
            row, item, score = row[order], item[order], score[order]
            keep = np.arange(len(row)) - np.searchsorted(row, np.arange(len(n[part])))[row] < n[part][row]
            out.append((row[keep] + at, item[keep], score[keep]))
        return tuple(np.concatenate(x) for x in zip(*out))


def item_heads(blocks: DataFrame, most: int):
    """The rows of ``Heads`` of item blocks for lists of ``most`` items, broadcast, and how many items a query may ask
    for that needs no others, seen ones included. None where heads hold more than ``HEADS`` items."""
    known = blocks.agg(F.first("by_vector"), F.max("copies")).first()
    if not known[0] or known[1] > 1:
        return None
    for more in HEAD:
        heads = (blocks.select("ids", "vecs", "kind", "biases").mapInArrow(_block_heads(most + more), "vec binary, ids binary, biases binary, n long")
                 .groupBy("vec").applyInArrow(_merge_heads(most + more), "vec binary, ids binary, biases binary, n long, safe long, odd boolean"))
        total, safe, odd = heads.agg(F.sum("n"), F.min(F.when(F.col("safe") >= 0, F.col("safe"))), F.max("odd")).first()
        if total <= HEADS and not odd:
            rows = [r.asDict() for r in heads.select("vec", "ids", "biases").collect()]
            return blocks.sparkSession.sparkContext.broadcast(rows), 1 << 62 if safe is None else safe
    return None


def list_values(column) -> tuple[np.ndarray, np.ndarray]:
    """The values of an Arrow list column, and how many are each row's."""
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _answers(b, heads, vec: str, off: str, n: str):
    """What the queries of a batch find in heads."""
    numbers = [b.column(c).to_numpy(zero_copy_only=False) for c in (off, n)]
    gone, gone_n = list_values(b.column("seen"))
    return heads.find(_matrix(b.column(vec), b.num_rows), numbers[0].astype(float), numbers[1].astype(np.int64), gone.astype(np.int64), gone_n)


def _needed(n, seen="seen") -> F.Column:
    return F.col(n) + F.greatest(F.coalesce(F.size(seen), F.lit(0)), F.lit(0))


def _found_in_heads(asked: DataFrame, rows) -> DataFrame:
    def run(batches):
        heads = Heads(rows.value)
        for whole in batches:
            for at in range(0, whole.num_rows, QUERIES):
                b = whole.slice(at, QUERIES)
                row, item, score = _answers(b, heads, "vec", "off", "n")
                rank = np.arange(len(row)) - np.searchsorted(row, np.arange(b.num_rows))[row] + 1
                qid = b.column("qid").to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (qid[row], rank.astype(np.int64), item, score)], names=["qid", "rank", "item_idx", "score"])

    return asked.mapInArrow(run, "qid long, rank long, item_idx long, score double")


def lists_by_heads(queries: DataFrame, heads: dict, use, schema: str, dealt: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """What ``use`` makes of the queries' lists of several scorers, found and used where the query lies, and the queries that heads
    don't answer, if any.

    ``queries``: qid, seen, and vec_<m>, off_<m>, n_<m> of every scorer of ``heads`` (its ``item_heads``); ``use`` turns a
    batch of the queries' other columns with items_<m>, scores_<m>, the lists in order, into one of ``schema``.
    ``dealt``: the queries are spread over tasks as they are.
    """
    within = F.lit(True)
    for m, (_, safe) in heads.items():
        within = within & (_needed(f"n_{m}") <= safe)
    passed = [c for c in queries.columns if c != "seen" and c not in {f"{x}_{m}" for x in ("vec", "off", "n") for m in heads}]
    rows = {m: r for m, (r, _) in heads.items()}

    def run(batches):
        heads = {m: Heads(r.value) for m, r in rows.items()}
        for whole in batches:
            for at in range(0, whole.num_rows, MATRIX):
                b = whole.slice(at, MATRIX)
                columns = {c: b.column(c) for c in passed}
                for m, h in heads.items():
                    row, item, score = _answers(b, h, f"vec_{m}", f"off_{m}", f"n_{m}")
                    ends = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32))
                    columns[f"items_{m}"] = pa.ListArray.from_arrays(ends, pa.array(item, pa.int64()))
                    columns[f"scores_{m}"] = pa.ListArray.from_arrays(ends, pa.array(score, pa.float64()))
                yield use(pa.RecordBatch.from_arrays([*columns.values()], names=[*columns]))

    inside, rest = queries.where(within), queries.where(~within)
    if not dealt:
        inside = inside.repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), "qid")
    return inside.mapInArrow(run, schema), None if rest.isEmpty() else rest


def topn_of_lists(queries: DataFrame, model: str, heads, keep: str, dealt: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(the columns of ``keep``, a schema, rank, item_idx, score) of the queries' lists of one scorer, and the queries left."""
    kept = [c.split()[0] for c in keep.split(", ")]

    def use(b):
        (item, count), (score, _) = list_values(b.column(f"items_{model}")), list_values(b.column(f"scores_{model}"))
        row = np.repeat(np.arange(b.num_rows), count)
        rank = np.arange(len(row)) - (np.cumsum(count) - count)[row] + 1
        return pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(row)) for c in kept), pa.array(rank), pa.array(item), pa.array(score)],
                                          names=[*kept, "rank", "item_idx", "score"])

    return lists_by_heads(queries, {model: heads}, use, f"{keep}, rank long, item_idx long, score double", dealt)


def head_values(values: DataFrame, column: str, heads: dict):
    """The sorted items of heads that have a value, and these values, broadcast (``values``: item_idx and the column)."""
    spark = values.sparkSession
    ids = np.unique(np.concatenate([_read(r["ids"], np.int64) for rows, _ in heads.values() for r in rows.value]))
    got = values.join(spark.createDataFrame(pa.table({"item_idx": ids})), "item_idx").select("item_idx", F.col(column).cast("double").alias("v")).toArrow()
    found = got["item_idx"].to_numpy()
    order = np.argsort(found)
    return spark.sparkContext.broadcast((found[order], np.nan_to_num(got["v"].to_numpy())[order]))


def _found_by_norm(asked: DataFrame, blocks: DataFrame) -> DataFrame:
    # single rows: the first block, and two numbers of each later one
    first = blocks.where(F.col("block") == 0).select(*_BLOCK)
    others = blocks.where(F.col("block") > 0).agg(*(F.collect_list(F.struct("block", "norm", "top")).getField(c).alias(a)
                                                    for c, a in (("block", "blocks"), ("norm", "norms"), ("top", "tops"))))
    round1 = (asked.mapInArrow(_pack_queries, _QUERIES).join(F.broadcast(first)).join(F.broadcast(others))
              .mapInArrow(_first_block, _ROUND1).checkpoint())
    found = round1.select("found_q", "found_i", "found_s").mapInArrow(_unpack_found, FOUND)
    pairs = (round1.select("qids", "vec", "off", "n", "seen", "least", F.explode("later").alias("block"))
             .join(blocks, "block"))
    return found.unionByName(pairs.mapInArrow(_later_block, FOUND))


def blocked_topn(queries: DataFrame, blocks: DataFrame, most: int) -> DataFrame:
    """(qid, rank, item_idx, score): the first ``n`` unseen items of every query.

    ``queries``: qid, vec (array<double> or null), off, n (at most ``most``), seen (array<long> or null);
    ``blocks``: the items, from ``item_blocks``. Vectors beyond the other side's length don't count.
    """
    spark = queries.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = queries.select("qid", "vec", F.col("off").cast("double").alias("off"),
                           F.least("n", F.lit(most)).cast("long").alias("n"), "seen").repartition(parts, "qid")
    one = blocks.select("by_vector").first()
    heads = item_heads(blocks, most) if one is not None else None
    inside = None
    if heads is not None:
        within = _needed("n") <= heads[1]
        inside, asked = _found_in_heads(asked.where(within), heads[0]), asked.where(~within)
        if asked.isEmpty():
            return inside
    found = (_found_by_vector if one is not None and one.by_vector else _found_by_norm)(asked, blocks)
    ranked = (top_n(found, ["qid"], [score_key("score").desc(), F.col("item_idx")], most)
              .join(asked.select("qid", "n"), "qid").where(F.col("rank") <= F.col("n"))
              .select("qid", F.col("rank").cast("long").alias("rank"), "item_idx", "score"))
    return ranked if inside is None else inside.unionByName(ranked)
