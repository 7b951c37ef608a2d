"""Katz backoff language model of words, learned and applied as Spark tables.

Bigram counts are Good-Turing discounted up to CUT; a history's backoff weight is
what the discounted probabilities leave, divided by the unigram mass of the words
not seen after it, so every history sums to one exactly over the training words
and one class for all unseen words. A token after a history scores the bigram's
probability where training has seen it; else it backs off to the history's weight
times the token's own probability.

The texts are tokenised once into a table of blocks (words as local numbers). Each
block sends the distinct bigrams it holds to buckets of histories, packed into one
row per block and bucket, and gets their corpus counts back in the order sent; so a
bigram costs its bytes once per block, not once per document, and every document is
scored inside its block. Beyond some hundred TB a packed row holds about one bigram,
and the shuffle is that of a plain bigram table. The model's tables are words (count,
probability), histories (base, backoff weight) and the buckets' bigram counts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm import text as tx
from rankloom.llm.scratch import Scratch

#: counts up to which Good-Turing discounts
CUT = 5
#: hashes of the end token and of the history before the first word
END, START = np.uint64(1), np.uint64(2)
#: tokens of a block (a longer document is a block of its own) and of a bucket on average
BLOCK, BUCKET = 1_500_000, 1_000_000
#: tokens after one history from which it is split over several buckets; histories that may be so at most
PART, MOST_HEAVY = 250_000, 1 << 20

BLOCKS = "block bigint, doc_id array<bigint>, held array<boolean>, off binary, vocab binary, ids binary"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _pack(values: np.ndarray, planes: bool = True) -> bytes:
    """``values`` compressed, by default first bytes first: numbers shrink so, runs of equal hashes don't."""
    values = np.ascontiguousarray(values)
    raw = (values.view(np.uint8).reshape(-1, values.itemsize).T if planes else values).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def _unpack(data: bytes, dtype, planes: bool = True) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b"", np.uint8)
    return (np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T) if planes else raw).ravel().view(dtype)


def _tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of every document, END last, and how many each has."""
    n = len(off) - 1
    buf = tx.LOWER[buf]
    s, e, d = tx.words(buf, off)
    count = np.bincount(d, minlength=n) + 1
    token = np.full(int(count.sum()), END)
    is_word = np.ones(len(token), bool)
    is_word[np.cumsum(count) - 1] = False
    token[is_word] = tx.hashes(buf, s, e)
    return token, count


def blocks(docs: DataFrame) -> DataFrame:
    """BLOCKS of ``docs`` (doc_id, held, text): documents, offsets of their tokens, sorted word hashes, token numbers."""
    def block(number, held):
        ids, marks, tokens, count = zip(*held, strict=True)
        held.clear()   # a block's tokens are held once
        ids, marks, off = sum(ids, []), sum(marks, []), np.concatenate([[0], np.cumsum(np.concatenate(count))])
        token = np.concatenate([[START], *tokens])
        del tokens
        vocab, at = np.unique(token, return_inverse=True)
        del token
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([marks], pa.list_(pa.bool_())),
             *(pa.array([_pack(x)], pa.binary()) for x in (off, vocab, at[1:].astype(np.int32)))],
            names=["block", "doc_id", "held", "off", "vocab", "ids"])

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for batch in batches:
            buf, off = tx.utf8(batch.column(2))
            for i, j in tx.pieces(off):
                token, count = _tokens(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                held.append((batch.column(0).slice(i, j - i).to_pylist(), batch.column(1).slice(i, j - i).to_pylist(), token, count))
                size += len(token)
                if size >= BLOCK:
                    yield block(number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield block(number, held)

    return docs.mapInArrow(run, BLOCKS)


class _Block:
    """One row of BLOCKS, unpacked."""

    def __init__(self, row: dict):
        self.block, self.doc_id, self.held = row["block"], row["doc_id"], np.array(row["held"], bool)
        self.off, self.vocab, self.ids = _unpack(row["off"], np.int64), _unpack(row["vocab"], np.uint64), _unpack(row["ids"], np.int32)
        self.n = _unpack(row["n"], np.int64) if "n" in row else None
        self.train = np.repeat(~self.held, np.diff(self.off))
        self.before = np.empty_like(self.ids)
        self.before[1:] = self.ids[:-1]
        self.before[self.off[:-1]] = np.searchsorted(self.vocab, START)

    def pairs(self, heavy: np.ndarray, parts: np.ndarray, n_buckets: int):
        """Distinct bigrams by bucket (history and word as local numbers), their bucket, and every token's bigram."""
        v = len(self.vocab)
        code, at = np.unique(self.before.astype(np.int64) * v + self.ids, return_inverse=True)
        a, b = code // v, code % v
        split = np.ones(v, np.uint64)
        if len(heavy):
            k = np.minimum(np.searchsorted(heavy, self.vocab), len(heavy) - 1)
            split = np.where(heavy[k] == self.vocab, parts[k], 1).astype(np.uint64)
        part = tx.mix(self.vocab[b]) % split[a]
        bucket = (tx.mix(self.vocab[a] + part * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        return a[order], b[order], bucket[order], rank[at]


def block_words(table: DataFrame) -> DataFrame:
    """block, w, n: the words of every block and their training count in it."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x = _Block(row)
                n = np.bincount(x.ids[x.train], minlength=len(x.vocab))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), x.block)), pa.array(x.vocab.view(np.int64)), pa.array(n, pa.int64())],
                                                 names=["block", "w", "n"])
    return table.mapInArrow(run, "block bigint, w bigint, n bigint")


def packed(asked: DataFrame, *names: str) -> DataFrame:
    """block, names: a block's values packed in the order of its sorted words. ``asked``: block, w, names, every word of a block once."""
    def run(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("w").to_numpy().view(np.uint64))
        return pa.table({"block": rows.column("block").slice(0, 1), **{k: pa.array([_pack(rows.column(k).to_numpy()[order])], pa.binary()) for k in names}})

    return asked.groupBy("block").applyInArrow(run, "block bigint, " + ", ".join(f"{k} binary" for k in names))


def packed_counts(asked: DataFrame) -> DataFrame:
    """block, n: a block's counts packed in the order of its sorted words."""
    return packed(asked, "n")


def with_counts(table: DataFrame, counts: DataFrame) -> DataFrame:
    """The blocks with n, the training counts of their words. ``counts``: as of ``packed_counts``."""
    return table.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(
        lambda left, right: left.append_column("n", right.column("n")), BLOCKS + ", n binary")


def discounts(counts_of_counts: dict[int, int]) -> list[float]:
    """Factor of every count up to CUT by Good-Turing; half a count less where the counts are too few to tell."""
    n = [counts_of_counts.get(r, 0) for r in range(CUT + 2)]
    tail = (CUT + 1) * n[CUT + 1] / n[1] if n[1] else 1.0
    out = []
    for r in range(1, CUT + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


def _discounted(n: Column, factors: list[float]) -> Column:
    out = n.cast("double")
    for r, d in enumerate(factors, 1):
        out = F.when(n == r, F.lit(r * d)).otherwise(out)
    return out


def _discounted_array(n: np.ndarray, factors: list[float]) -> np.ndarray:
    return np.where(n <= CUT, np.r_[0.0, np.arange(1, CUT + 1) * factors][np.minimum(n, CUT)], n.astype(float))


class Model:
    """Tables words (w, n) and histories (w1, base, log_alpha); ``blocks`` with their words' counts, bigram counts in ``paired``,
    what their words are as histories in ``told``.

    ``table``: the blocks, a table "blocks" of ``scratch`` that is dropped when its words are counted.
    """

    def __init__(self, table: DataFrame, scratch: Scratch):
        local = scratch.table(block_words(table), "block-words")
        self.words = scratch.table(local.where("n > 0").groupBy("w").agg(F.sum("n").alias("n")), "unigrams")
        scratch.release()
        self.train_tokens, self.types = self.words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        total = max(1, self.train_tokens)
        few = {r.n: r["count"] for r in self.words.where(F.col("n") <= CUT + 1).groupBy("n").count().collect()}
        factors = discounts(few)
        kept = self.words.agg(F.sum(_discounted(F.col("n"), factors) / F.lit(float(total)))).first()[0] or 0.0
        # frequent words alone leave nothing: then one token more stands for the unseen
        shrink = 1.0 if 1.0 - kept > 1e-12 else total / (total + 1.0)
        self.unseen = max(1.0 - kept, 1.0 / (total + 1.0)) if shrink == 1.0 else 1.0 - shrink * kept
        self.word_factors, self.scale = factors, shrink / total
        # histories of many tokens; a document begins with START, so that is split by the number of documents
        n_docs, n_tokens = (table.select(F.size("doc_id").alias("d")).agg(F.coalesce(F.sum("d"), F.lit(0))).first()[0], self.train_tokens)
        least = max(PART, n_tokens // MOST_HEAVY + 1)
        heavy = [(r.w, r.n) for r in self.words.where(F.col("n") >= least).select("w", "n").collect()] + [(int(START), n_docs)]
        keys = np.array([w for w, _ in heavy], np.int64).view(np.uint64)
        order = np.argsort(keys)
        self.heavy = keys[order], np.maximum(1, -(-np.array([n for _, n in heavy], np.int64) // PART))[order]
        self.n_buckets = max(1, -(-(n_tokens + n_docs) // BUCKET))
        asked = scratch.table(local.select("block", "w").join(self.words, "w", "left").select("block", "w", F.coalesce("n", F.lit(0)).alias("n")), "asked")
        scratch.drop("block-words")
        scratch.release()
        # the words' rows are gone before the blocks are shuffled and written again
        counts = scratch.table(packed_counts(asked), "counts")
        scratch.drop("asked")
        del local, asked
        scratch.release()
        self.blocks = scratch.table(with_counts(table, counts), "counted")
        scratch.drop("blocks", "counts")
        del table, counts
        scratch.release()
        self.paired = scratch.table(self._bucket_counts(self._dealt(), factors, self.scale), "paired")
        scratch.release()
        sums = self.paired.where(F.col("w1").isNotNull()).groupBy("w1").agg(
            *(F.sum(f"k{r}").alias(f"k{r}") for r in range(1, CUT + 2)), F.sum("more").alias("more"), F.sum("seen").alias("seen"))
        sums = scratch.table(sums, "histories")
        few = sums.agg(*(F.coalesce(F.sum(f"k{r}"), F.lit(0)) for r in range(1, CUT + 2))).first()
        self.factors = discounts(dict(enumerate(few, 1)))
        count = lambda by: sum((F.col(f"k{r}") * F.lit(by(r)) for r in range(1, CUT + 1)), F.col("more"))
        history = sums.select("w1", "seen", count(lambda r: r).alias("total"), count(lambda r: r * self.factors[r - 1]).alias("kept"))
        # a history whose counts are all above CUT keeps one count for the unseen
        history = history.withColumn("base", F.when(F.col("kept") < F.col("total"), F.col("total")).otherwise(F.col("total") + 1).cast("double"))
        alpha = (1 - F.col("kept") / F.col("base")) / F.greatest(1 - F.col("seen"), F.lit(1e-300))
        self.histories = history.select("w1", "base", F.log10(alpha).alias("log_alpha"))
        # as with the counts, the words' rows are gone before the blocks are shuffled again
        asked = block_words(self.blocks).select("block", "w").join(self.histories.withColumnRenamed("w1", "w"), "w", "left").select(
            "block", "w", F.coalesce("base", F.lit(1.0)).alias("base"), F.coalesce("log_alpha", F.lit(0.0)).alias("log_alpha"))
        self.told = scratch.table(packed(asked, "base", "log_alpha"), "told")
        del asked
        scratch.release()

    def _dealt(self) -> DataFrame:
        """bucket, block, w1, w2, n2, t: packed distinct bigrams of a block in a bucket, the word's count and the training count here."""
        heavy, n_buckets = self.heavy, self.n_buckets

        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    x = _Block(row)
                    a, b, bucket, at = x.pairs(*heavy, n_buckets)
                    t = np.bincount(at[x.train], minlength=len(a))
                    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                    for i, j in zip(cut, np.r_[cut[1:], len(a)], strict=True):
                        sent = (_pack(x.vocab[a[i:j]], False), _pack(x.vocab[b[i:j]], False), _pack(x.n[b[i:j]]), _pack(t[i:j]))
                        yield pa.RecordBatch.from_arrays([pa.array([bucket[i]], pa.int64()), pa.array([x.block], pa.int64()), *(pa.array([c], pa.binary()) for c in sent)],
                                                         names=["bucket", "block", "w1", "w2", "n2", "t"])

        return self.blocks.mapInArrow(run, "bucket bigint, block bigint, w1 binary, w2 binary, n2 binary, t binary")

    @staticmethod
    def _bucket_counts(dealt: DataFrame, factors: list[float], scale: float) -> DataFrame:
        """block, bucket, counts (of the bigrams as the block sent them); and per history of the bucket w1, k1.., more, seen."""
        names = ["block", "bucket", "counts", "w1", *(f"k{r}" for r in range(1, CUT + 2)), "more", "seen"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * (CUT + 3), pa.float64()]

        def run(table: pa.Table) -> pa.Table:
            rows = table.to_pylist()
            w1, w2 = (np.concatenate([_unpack(r[k], np.uint64, False) for r in rows]) for k in ("w1", "w2"))
            n2, t = (np.concatenate([_unpack(r[k], np.int64) for r in rows]) for k in ("n2", "t"))
            order = np.lexsort((w2, w1))
            h, w = w1[order], w2[order]
            fresh = np.r_[True, (h[1:] != h[:-1]) | (w[1:] != w[:-1])]
            first = np.flatnonzero(fresh)
            c = np.add.reduceat(t[order], first)
            every = np.empty(len(t), np.int64)
            every[order] = c[np.cumsum(fresh) - 1]
            ends = np.cumsum([int.from_bytes(r["w1"][:8], "little") // 8 for r in rows])[:-1]
            back = [_pack(x) for x in np.split(every, ends)]
            h, c, p2 = h[first], c, _discounted_array(n2[order][first], factors) * scale
            h, c, p2 = h[c > 0], c[c > 0], p2[c > 0]
            key, at = np.unique(h, return_inverse=True)
            sums = [np.bincount(at, weights=x, minlength=len(key)) for x in (*(c == r for r in range(1, CUT + 2)), np.where(c > CUT, c, 0), p2)]
            n, m = len(rows), len(key)
            head = [pa.array([r["block"] for r in rows], pa.int64()), pa.array([r["bucket"] for r in rows], pa.int64()), pa.array(back, pa.binary())]
            first_rows = pa.table([*head, *(pa.nulls(n, k) for k in kinds[3:])], names=names)
            tail = [pa.array(key.view(np.int64)), *(pa.array(x.astype(np.int64)) for x in sums[:-1]), pa.array(sums[-1])]
            return pa.concat_tables([first_rows, pa.table([*(pa.nulls(m, k) for k in kinds[:3]), *tail], names=names)])

        schema = "block bigint, bucket bigint, counts binary, w1 bigint, " + ", ".join(f"k{r} bigint" for r in range(1, CUT + 2)) + ", more bigint, seen double"
        return dealt.groupBy("bucket").applyInArrow(run, schema)

    def score(self) -> DataFrame:
        """doc_id, n_tokens, n_known, base_score, score of every document of the blocks."""
        heavy, n_buckets, factors = self.heavy, self.n_buckets, self.factors
        word_factors, scale, unseen = self.word_factors, self.scale, self.unseen
        norm = math.log10(self.train_tokens + 0.5 * (self.types + 1))
        names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            out = []
            is_word = right.column("bucket").is_null().to_numpy()
            told = right.filter(pa.array(is_word)).to_pylist()
            sent = right.filter(pa.array(~is_word)).sort_by("bucket").column("counts").to_pylist()
            for row in left.to_pylist():
                x = _Block(row)
                base, back = (_unpack(told[0][k], np.float64) for k in ("base", "log_alpha"))
                n = x.n
                logp = np.log10(np.where(n > 0, _discounted_array(n, word_factors) * scale, unseen))
                c = np.concatenate([_unpack(s, np.int64) for s in sent])[x.pairs(*heavy, n_buckets)[3]]
                i, h = x.ids, x.before
                value = np.log10(np.maximum(_discounted_array(c, factors), 1e-300)) - np.log10(base[h])
                value = np.where(c > 0, value, logp[i] + back[h])
                total = lambda v: np.add.reduceat(v, x.off[:-1])  # noqa: E731, B023
                out.append(pa.table([pa.array(x.doc_id, pa.int64()), pa.array(np.diff(x.off), pa.int64()), pa.array(total((n[i] > 0).astype(np.int64))),
                                     pa.array(total(np.log10(n[i] + 0.5) - norm)), pa.array(total(value))], names=names))
            return pa.concat_tables(out)

        told = self.told.unionByName(self.paired.where(F.col("block").isNotNull()).select("block", "bucket", "counts"), allowMissingColumns=True)
        return self.blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(
            run, "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row of ``docs`` (doc_id, text).

    Null or empty text: the end token alone. Rows that share a doc_id, repeated ones too, are each scored by
    their own text. A null doc_id trains. No training rows: every token is unseen. No rows: no rows.
    """
    scratch = Scratch(docs.sparkSession, "katz")
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id").cast("bigint")).alias("held"), F.col("text").cast("string").alias("text"))
    table = scratch.table(blocks(src), "blocks")
    model = Model(table, scratch)
    scratch.release()
    return model.score().select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
                                            F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
