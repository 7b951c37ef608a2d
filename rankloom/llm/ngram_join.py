"""N-gram Jaccard join by prefix filter and prefix tree, with connected components.

Documents with the same set of word shingles are one node. All sets are put in
one global order by the documents that hold them, counted over all, the most
frequent shingles last; two sets that are
similar enough share a shingle within the first quarter of that order. Nodes
that share such a shingle are candidates: first every node against the pivot of
its posting list (the node most of whose shingles are shared), which joins
groups of copies without their pairs; then, where a posting list still holds
several components, the pairs across components that may be long enough.
Candidates are verified per pivot: their ordered sets form a prefix tree, walked
once with the overlap of every shared prefix kept, and left where even the rest
of both sets cannot reach the threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm import text as tx
from rankloom.llm.components import components
from rankloom.llm.scratch import Scratch

SHINGLE = 5
#: similarity in hundredths
PERCENT = 75
#: documents from which a shingle may count as frequent, and entries of the table of frequent ones (some 16 MB)
FREQUENT, MOST_FREQUENT = 3, 1 << 20
#: shingles counted in one bucket, and bits that tell them apart there
BUCKET, KEY_BITS = 4_000_000, 36
#: hash bins of a set's counts, which rule out candidates without reading their sets
BINS = 256
#: candidates of one pivot that are verified in one group
GROUP = 1000
#: share of a salted part of a frequent shingle's posting list: rows expected in it
PART = 4000


def _sets(buf: np.ndarray, off: np.ndarray):
    """Per document, its sorted distinct shingle hashes."""
    buf = tx.LOWER[buf]
    n = len(off) - 1
    s, e, d = tx.words(buf, off)
    h, doc, _ = tx.shingles(tx.hashes(buf, s, e), d, n, SHINGLE)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
    h, doc = h[keep], doc[keep]
    return h, doc, np.searchsorted(doc, np.arange(n + 1))


def _nodes(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit identity of every set: equal sets have equal nodes."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tx.mix(h ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    return tx.mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64)


def _batches(batches, col: int):
    for batch in batches:
        buf, off = tx.utf8(batch.column(col))
        for i, j in tx.pieces(off):
            yield batch, i, j, *_sets(buf[off[i]:off[j]], off[i:j + 1] - off[i])


def membership(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node (null for an empty set) and bins (shingles per hash bin, 255 for more) per row."""
    def run(batches):
        for batch, i, j, h, doc, at in _batches(batches, 1):
            n = np.diff(at)
            bins = np.bincount(doc * BINS + (tx.mix(h) % np.uint64(BINS)).astype(np.int64), minlength=(j - i) * BINS)
            bins = np.minimum(bins, 255).astype(np.uint8).reshape(j - i, BINS)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(_nodes(h, at), pa.int64(), mask=n == 0),
                                              pa.array([b.tobytes() for b in bins], pa.binary())], names=["doc_id", "n_shingles", "node", "bins"])
    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, node bigint, bins binary")


def within_reach(pairs: DataFrame, bins: DataFrame) -> DataFrame:
    """The candidate pairs that their bins don't rule out: two sets overlap by at most the sum of the bins' minima."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BINS) for k in (2, 3))
            n, m = (batch.column(k).to_numpy() for k in (4, 5))
            low = np.minimum(x, y)
            fine = (low.sum(1, dtype=np.int64) * (100 + PERCENT) >= (n + m) * PERCENT) | (low == 255).any(1)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(fine)) for k in (0, 1)], names=["pivot", "node"])

    p = pairs.alias("p").join(bins.alias("a"), F.col("p.pivot") == F.col("a.node")).select("p.pivot", "p.node", F.col("a.bins").alias("x"), F.col("a.n").alias("n"))
    both = p.alias("p").join(bins.alias("b"), F.col("p.node") == F.col("b.node")).select("p.pivot", "p.node", "p.x", F.col("b.bins").alias("y"), "p.n", F.col("b.n").alias("m"))
    return both.mapInArrow(run, "pivot bigint, node bigint")


def _counting_keys(h: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket of every shingle, and KEY_BITS of its hash: what counts are kept by."""
    low = h & np.uint64((1 << KEY_BITS) - 1)
    return (h >> np.uint64(KEY_BITS)) % np.uint64(n_buckets) << np.uint64(KEY_BITS) | low


def _packed(low: np.ndarray) -> tuple[int, bytes]:
    """Ascending numbers as differences of as many bytes as the largest needs."""
    gaps = np.diff(low, prepend=np.uint64(0))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    return width, gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(width: int, blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(blob, np.uint8).reshape(-1, width)
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def document_frequencies(docs: DataFrame, n_buckets: int) -> DataFrame:
    """key, n: shingles of FREQUENT documents or more, counted over all documents.

    A batch counts equal sets once and sends a bucket its distinct keys in one row, so that a shingle of
    any number of documents reaches its bucket once per batch. Two shingles of one key add up: the counts
    only choose the order.
    """
    def send(batches):
        for _, i, j, h, doc, at in _batches(batches, 1):
            _, first = np.unique(_nodes(h, at), return_index=True)
            own = np.zeros(j - i, bool)
            own[first] = True
            key, n = np.unique(_counting_keys(h[own[doc]], n_buckets), return_counts=True)
            bucket = (key >> np.uint64(KEY_BITS)).astype(np.int64)
            edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(key) else np.zeros(0, np.int64)
            rows = []
            for x, y in zip(edge, np.r_[edge[1:], len(key)][:len(edge)], strict=True):
                several = np.flatnonzero(n[x:y] > 1)
                width, blob = _packed(key[x:y] & np.uint64((1 << KEY_BITS) - 1))
                rows.append((bucket[x], width, blob, several.astype("<u4").tobytes(), n[x:y][several].astype("<u4").tobytes()))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)],
                                             names=["bucket", "width", "keys", "at", "times"])

    def add(table: pa.Table) -> pa.Table:
        keys, counts = [], []
        for width, blob, where, times in zip(*(table.column(c).to_pylist() for c in ("width", "keys", "at", "times")), strict=True):
            keys.append(_unpacked(width, blob))
            counts.append(np.ones(len(keys[-1]), np.int64))
            counts[-1][np.frombuffer(where, "<u4")] = np.frombuffer(times, "<u4")
        key, n = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(key)
        key, n = key[order], n[order]
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        n = np.add.reduceat(n, begin)
        many = n >= FREQUENT
        head = np.int64(table.column("bucket")[0].as_py()) << KEY_BITS
        return pa.table({"key": pa.array(key[begin][many].astype(np.int64) | head), "n": pa.array(n[many], pa.int64())})

    sent = docs.mapInArrow(send, "bucket bigint, width int, keys binary, at binary, times binary")
    return sent.groupBy("bucket").applyInArrow(add, "key bigint, n bigint")


#: sorted counting keys of the frequent shingles, their documents, a bit per key's hash, and the keys' buckets
Frequent = tuple[np.ndarray, np.ndarray, np.ndarray, int]


def frequent_shingles(docs: DataFrame, scratch: Scratch, n_shingles: int) -> Frequent:
    """The shingles of most documents: all those above the least number that leaves at most MOST_FREQUENT of them.

    So a shingle that isn't frequent has at most that number of documents, whatever the corpus holds.
    """
    n_buckets = max(1, -(-n_shingles // BUCKET))
    counts = scratch.table(document_frequencies(docs, n_buckets), "frequencies")
    # the numbers of documents, as powers of 2^(1/8): some hundreds of rows
    step = F.floor(F.log2("n") * 8)
    least, held = None, 0
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("keys"), F.min("n").alias("least")).orderBy(F.col("step").desc()).collect():
        held += r["keys"]
        if held > MOST_FREQUENT:
            break
        least = r["least"]
    got = counts.where(F.col("n") >= least).toArrow() if least else counts.limit(0).toArrow()
    scratch.drop("frequencies")
    keys, n = got.column("key").to_numpy().view(np.uint64), got.column("n").to_numpy().astype(np.float64)
    order = np.argsort(keys)
    keys = keys[order]
    bits = np.zeros(1 << 21, np.uint8)
    slot = _slots(keys.view(np.int64), len(bits) * 8)
    np.bitwise_or.at(bits, slot >> 3, np.uint8(1) << (slot & 7).astype(np.uint8))
    return keys, n[order], bits, n_buckets


def _documents_of(h: np.ndarray, frequent: Frequent) -> np.ndarray:
    """Documents of every shingle, 0 for those that aren't frequent."""
    keys, docs, bits, n_buckets = frequent
    out = np.zeros(len(h))
    if not len(h) or not len(keys):
        return out
    key = _counting_keys(h, n_buckets)
    slot = _slots(key.view(np.int64), len(bits) * 8)
    may = np.flatnonzero((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
    key = key[may]
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    out[may] = np.where(keys[at] == key, docs[at], 0.0)
    return out


def _ordered(h: np.ndarray, doc: np.ndarray, frequent: Frequent) -> tuple[np.ndarray, np.ndarray]:
    """The sets in global order (rare by hash, then frequent by documents and hash), and each one's documents or 0."""
    weight = _documents_of(h, frequent)
    order = np.lexsort((h, weight, doc))
    return h[order], weight[order]


def postings(docs: DataFrame, frequent) -> DataFrame:
    """token, parts, part, node, n, pos: every node under each shingle of its prefix, once per batch; frequent ones in salted parts."""
    def run(batches):
        for _, i, j, h, doc, at in _batches(batches, 1):
            node, n = _nodes(h, at), np.diff(at)
            h, weight = _ordered(h, doc, frequent.value)
            _, first = np.unique(node, return_index=True)
            own = np.zeros(j - i, bool)
            own[first] = True
            own &= n > 0
            size = np.where(own, n - (-(-PERCENT * n // 100)) + 1, 0)
            pos = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            rows = np.repeat(at[:-1], size) + pos
            who = np.repeat(np.arange(j - i), size)
            parts = np.maximum(1, np.ceil(weight[rows] / PART)).astype(np.int64)
            part = (tx.mix(node[who].view(np.uint64)) % parts.astype(np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(h[rows].view(np.int64)), pa.array(parts, pa.int32()), pa.array(part, pa.int32()), pa.array(node[who]), pa.array(n[who], pa.int32()), pa.array(pos, pa.int32())],
                                             names=["token", "parts", "part", "node", "n", "pos"])
    return docs.mapInArrow(run, "token bigint, parts int, part int, node bigint, n int, pos int")


def ordered_sets(docs: DataFrame, frequent, wanted) -> DataFrame:
    """node, seq: ordered sets (big-endian) of nodes that the bit filter may hold, once per batch."""
    bits = wanted

    def run(batches):
        for _, i, j, h, doc, at in _batches(batches, 1):
            node = _nodes(h, at)
            h, _ = _ordered(h, doc, frequent.value)
            slot = _slots(node, len(bits.value) * 8)
            may = (bits.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1
            _, first = np.unique(node, return_index=True)
            pick = [k for k in first if may[k] and at[k + 1] > at[k]]
            yield pa.RecordBatch.from_arrays([pa.array(node[pick], pa.int64()), pa.array([h[at[k]:at[k + 1]].astype(">u8").tobytes() for k in pick], pa.binary())],
                                             names=["node", "seq"])
    return docs.mapInArrow(run, "node bigint, seq binary")


#: bits of the filter of candidate nodes at most; a fuller filter only lets more sets through
FILTER_BITS = 1 << 24


def _slots(node: np.ndarray, n_bits: int) -> np.ndarray:
    return (tx.mix(node.view(np.uint64) ^ np.uint64(0xD6E8FEB86659FD93)) & np.uint64(n_bits - 1)).astype(np.int64)


def node_filter(nodes: DataFrame, n_nodes: int) -> np.ndarray:
    """A bit array with the slot of every node set; its size is bounded by FILTER_BITS."""
    n_bits = min(FILTER_BITS, 1 << max(10, int(16 * max(1, n_nodes) - 1).bit_length()))

    def run(batches):
        bits = np.zeros(n_bits // 8, np.uint8)
        for batch in batches:
            s = _slots(batch.column(0).to_numpy(), n_bits)
            np.bitwise_or.at(bits, s >> 3, np.uint8(1) << (s & 7).astype(np.uint8))
        words = bits.view("<i8")
        some = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(words[some], pa.int64())], names=["at", "bits"])

    rows = nodes.mapInArrow(run, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(n_bits // 64, "<i8")
    out[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out.view(np.uint8)


def tree_matches(pivot: np.ndarray, sets: list[bytes]) -> list[int]:
    """Which ordered sets are similar to the pivot's: a walk over their prefix tree.

    The sets, sorted, are the tree's leaves; a set shares with its predecessor the path of their common
    prefix, whose running overlap is kept. A path is left as soon as its overlap and what the rest of
    either set can add stay below the need, and every set below that path with it.
    """
    order = sorted(range(len(sets)), key=lambda k: sets[k])
    have = np.sort(pivot)
    n = len(pivot)
    out = []
    before = np.zeros(0, np.uint64)
    upto = np.zeros(1, np.int64)
    for k in order:
        seq = np.frombuffer(sets[k], ">u8").astype(np.uint64)
        m = len(seq)
        need = -(-PERCENT * (n + m) // (100 + PERCENT))
        both = min(len(before), m)
        differ = np.flatnonzero(before[:both] != seq[:both])
        shared = min(int(differ[0]) if len(differ) else both, len(upto) - 1)
        path = np.empty(m + 1, np.int64)
        path[:shared + 1] = upto[:shared + 1]
        depth, overlap = shared, int(upto[shared])
        while depth < m and overlap + min(m - depth, n - overlap) >= need:
            step = min(m, depth + 256)
            part = seq[depth:step]
            hit = have[np.minimum(np.searchsorted(have, part), n - 1)] == part
            path[depth + 1:step + 1] = overlap + np.cumsum(hit)
            depth, overlap = step, int(path[step])
        before, upto = seq, path[:depth + 1]
        if depth == m and 100 * overlap >= PERCENT * (n + m - overlap):
            out.append(k)
    return out


def verified(pairs: DataFrame, docs: DataFrame, frequent) -> DataFrame:
    """a, b of the candidate pairs (pivot, part, node) whose sets are similar; one tree per pivot and part.

    A node's set is read from every batch that holds it, so a repeat may arrive; the first one counts.
    """
    roles = pairs.select("pivot", "part", "node").unionByName(
        pairs.select("pivot", "part", F.col("pivot").alias("node")).distinct())
    nodes = roles.select("node").distinct()
    bits = docs.sparkSession.sparkContext.broadcast(node_filter(nodes, nodes.count()))

    def run(table: pa.Table) -> pa.Table:
        head = table.column("pivot")[0].as_py()
        seqs = dict(zip(table.column("node").to_pylist(), table.column("seq").to_pylist(), strict=True))
        rest = sorted(k for k in seqs if k != head)
        won = tree_matches(np.frombuffer(seqs[head], ">u8").astype(np.uint64), [seqs[k] for k in rest])
        return pa.table({"a": pa.array([head] * len(won), pa.int64()), "b": pa.array([rest[k] for k in won], pa.int64())})

    return roles.join(ordered_sets(docs, frequent, bits), "node").groupBy("pivot", "part").applyInArrow(run, "a bigint, b bigint")


def _may_match(a: str, b: str) -> Column:
    """Whether two nodes whose first common shingle this is can overlap enough: lengths and what is left behind it."""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    return F.least(n - F.col(f"{a}pos"), m - F.col(f"{b}pos")) * (100 + PERCENT) >= (n + m) * PERCENT


def _with_parts(pairs: DataFrame) -> DataFrame:
    """Pairs with the part of the pivot's group, so that a pivot of any number of candidates is split."""
    per = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / F.lit(GROUP)).alias("parts"))
    return pairs.join(per, "pivot").select("pivot", "node", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))


def _stars(rows: DataFrame, by: list[str]) -> DataFrame:
    """pivot, node: every row of a group against the group's best pivot; no pairs among the rest."""
    best = rows.groupBy(*by).agg(F.max(F.struct("shared", "node", "n", "pos")).alias("best"))
    return rows.join(best, by).where((F.col("node") != F.col("best.node")) & _may_match("", "best.")).select(
        F.col("best.node").alias("pivot"), "node")


def _shared_postings(docs: DataFrame, frequent) -> DataFrame:
    """token, part, node, n, pos of shingles that several nodes have in their prefix."""
    alone = Window.partitionBy("token", "part")
    # once per batch and node so far; the rest of a node's repeats meets here
    rows = postings(docs, frequent).repartition("token", "part").dropDuplicates(["token", "part", "node"])
    rows = rows.withColumn("others", F.min("node").over(alone) != F.max("node").over(alone))
    # a token with several parts is kept in all of them: their pivots meet in a second star
    return rows.where((F.col("parts") > 1) | F.col("others")).select("token", "part", "node", "n", "pos")


def _scored(rows: DataFrame) -> DataFrame:
    return rows.join(rows.groupBy("node").agg((F.count("*") / F.first("n")).alias("shared")), "node")


def _star_pairs(rows: DataFrame) -> DataFrame:
    heads = rows.groupBy("token", "part").agg(F.max(F.struct("shared", "node", "n", "pos")).alias("h")).select("token", "h.*")
    return _stars(rows, ["token", "part"]).unionByName(_stars(heads, ["token"])).distinct()


def _open_rows(rows: DataFrame, label: DataFrame) -> DataFrame:
    """Posting lists that hold several components, with every node's component."""
    comp = rows.join(label.select(F.col("a").alias("node"), F.col("b").alias("label")), "node", "left").select(
        "token", "node", "n", "pos", F.coalesce("label", "node").alias("label"))
    several = comp.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token")
    return comp.join(several, "token")


def _across_pairs(rest: DataFrame, tried: DataFrame) -> DataFrame:
    """Pairs of one posting list and different components that weren't tried yet and may overlap enough.

    Every pair that is similar enough passes at the first shingle that both hold: what lies before it is not shared,
    so the shorter set has it within its first seventh, and both have enough behind it. Long lists are split: a row
    looks for longer sets from its own part, and is looked for in all.
    """
    size = rest.groupBy("token").agg(F.ceil(F.count("*") / F.lit(PART)).cast("int").alias("parts"))
    dealt = rest.join(size, "token")
    early = (F.col("n") - F.col("pos")) * (100 + PERCENT) >= 2 * PERCENT * F.col("n")
    x = dealt.where(early).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).alias("x")
    y = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("y")
    longer = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.node") < F.col("y.node")))
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.part") == F.col("y.part")) & longer
                 & (F.col("x.label") != F.col("y.label")) & _may_match("x.", "y."))
    across = met.select(F.least("x.node", "y.node").alias("pivot"), F.greatest("x.node", "y.node").alias("node")).distinct()
    done = tried.select(F.least("pivot", "node").alias("pivot"), F.greatest("pivot", "node").alias("node"))
    return across.join(done, ["pivot", "node"], "left_anti")


def links(docs: DataFrame, scratch: Scratch, member: DataFrame) -> DataFrame:
    """a, b: links between nodes whose components are those of all links. ``member``: see membership().

    Each phase is a table and holds no frame of the one before, so that its shuffle files can go.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, scratch, member.agg(F.sum("n_shingles")).first()[0] or 0))
    scratch.release()
    bins = scratch.table(member.where(F.col("node").isNotNull()).groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("bins").alias("bins")), "bins")
    scratch.table(_shared_postings(docs, frequent), "postings")
    scratch.release()
    rows = scratch.table(_scored(scratch.read("postings")), "scored")
    scratch.drop("postings")
    tried = scratch.table(_star_pairs(rows), "stars")
    scratch.release()
    pairs = scratch.table(_with_parts(scratch.table(within_reach(tried, bins), "near-stars")), "star-groups")
    first = scratch.table(verified(pairs, docs, frequent), "links1")
    scratch.release()
    scratch.table(_open_rows(rows, components(first, scratch, "joined")), "open")
    scratch.release()
    scratch.table(_across_pairs(scratch.read("open"), tried), "across")
    scratch.release()
    across = scratch.table(_with_parts(scratch.table(within_reach(scratch.read("across"), bins), "near-across")), "across-groups")
    scratch.drop("scored", "open", "across")
    scratch.release()
    if across.isEmpty():
        return first
    return first.unionByName(scratch.table(verified(across, docs, frequent), "links2"))


def join_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id per row of ``docs`` (doc_id, text).

    component_id: the smallest doc_id reachable by links. Null or wordless text: no shingles, linked with
    nothing, its own component. Rows that share a doc_id keep their own sets; equal sets are linked. No rows: no rows.
    """
    scratch = Scratch(docs.sparkSession, "ngram-join")
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    member = scratch.table(membership(src), "membership")
    edges = links(src, scratch, member)
    label = components(edges, scratch, "all")
    tagged = member.select("doc_id", "n_shingles", "node").join(label.select(F.col("a").alias("node"), F.col("b").alias("label")), "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("label", "node").alias("label"))
    least = tagged.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("doc_id").alias("least"))
    return tagged.join(least, "label", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is its component's smallest, with all their columns.

    Rows equal in doc_id and text stay once; different texts under one doc_id are versions of one
    document and stay or go together. Texts without words are their own components and stay.
    """
    found = Scratch(docs.sparkSession, "ngram-join").table(join_documents(docs), "components")
    gone = found.groupBy("doc_id").agg(F.min("component_id").alias("least"), F.count("*").alias("rows"))
    left = docs.join(gone.where("least < doc_id").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    several = gone.where("rows > 1 and least >= doc_id").select("doc_id")
    if several.isEmpty():
        return left
    once = left.join(several, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return left.join(several, "doc_id", "left_anti").select(*docs.columns).unionByName(once)
