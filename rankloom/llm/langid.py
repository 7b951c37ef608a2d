"""Language identification by words first, then ever shorter character n-grams.

A known word adds its log frequency in every language; an unseen word is scored
by its longest character n-grams that are known, backing off from four letters
to one. The tables are fitted on a bounded sample of labelled documents and have
a bounded number of entries, so they can be broadcast; scoring is one map over
whole texts without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm import text as tx
from rankloom.llm.scratch import Scratch

#: labelled documents of the fit per language, and entries of the word and the n-gram table
FIT_DOCS, MOST_WORDS, MOST_GRAMS = 800, 60000, 60000
LONGEST = 4
#: languages up to which the table of sampling shares is broadcast
BROADCAST_LANGS = 100000
#: characters scored in one vectorised block; a longer text is a block of its own
BLOCK = 1 << 20

_WORD = re.compile(r"[^\W\d_]+")


def usable(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams(word: str, n: int) -> list[str]:
    w = f"^{word}$" if n > 1 else word
    return [w[i:i + n] for i in range(len(w) - n + 1)]


def _count(batches):
    """(lang, kind, key, n) of a task's documents; kind 0: words, n: character n-grams."""
    for batch in batches:
        per: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            per.setdefault(lang, Counter()).update(tokens(text))
        for lang, count in per.items():
            out: Counter = Counter()
            for w, c in count.items():
                out[0, w] += c
                for n in range(1, LONGEST + 1):
                    for g in grams(w, n):
                        out[n, g] += c
            keys = list(out)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array([k for k, _ in keys], pa.int32()),
                                              pa.array([g for _, g in keys]), pa.array([out[k] for k in keys], pa.int64())],
                                             names=["lang", "kind", "key", "n"])


def fit(docs: DataFrame) -> dict:
    """Tables of log frequencies from up to about FIT_DOCS documents of every language with a label.

    Documents are taken by a hash of doc_id, so that the sample is spread evenly and repeatable.
    The most frequent entries of each table are kept; ties by key.
    """
    train = docs.where(usable(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    scratch = Scratch(docs.sparkSession, "langid")
    share = scratch.table(train.groupBy("lang").agg((F.lit(float(FIT_DOCS)) / F.count("*")).alias("share")), "shares")
    if share.count() <= BROADCAST_LANGS:    # one short row per language: the texts stay where they are
        share = F.broadcast(share)
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(5), "doc_id"), 12) / F.lit(float(1 << 52))
    sample = train.withColumn("chance", chance).join(share, "lang").where(F.col("chance") < F.col("share")).select("lang", "text")
    counts = sample.mapInArrow(_count, "lang string, kind int, key string, n bigint").groupBy("kind", "key").agg(
        F.collect_list(F.struct("lang", "n")).alias("by_lang"), F.sum("n").alias("total"))
    counts = scratch.table(counts, "counts")
    got = []
    for words, most in ((True, MOST_WORDS), (False, MOST_GRAMS)):
        part = counts.where((F.col("kind") == 0) & (F.col("total") > 1) if words else F.col("kind") > 0)
        part = part.orderBy(F.col("total").desc(), "kind", "key").limit(most)
        got.append(part.select("kind", "key", F.col("by_lang.lang").alias("langs"), F.col("by_lang.n").alias("n")).toArrow())
    got = pa.concat_tables(got).combine_chunks()    # columns, as rows would take the driver several times the memory
    count = pc.list_value_length(got["langs"]).to_numpy()
    names = pc.list_flatten(got["langs"])
    langs = sorted(pc.unique(names).to_pylist())
    freq = np.zeros((len(got), len(langs)))
    if len(langs):
        freq[np.repeat(np.arange(len(got)), count), pc.index_in(names, pa.array(langs)).to_numpy()] = pc.list_flatten(got["n"]).to_numpy()
    keys = {k: i for i, k in enumerate(zip(got["kind"].to_pylist(), got["key"].to_pylist(), strict=True))}
    kind = got["kind"].to_numpy()
    logs = np.zeros_like(freq)
    for k in range(LONGEST + 1):
        rows = kind == k
        logs[rows] = np.log((freq[rows] + 0.1) / (freq[rows].sum(0) + 0.1 * max(1, rows.sum())))
    return {"langs": langs, "keys": keys, "logs": logs.astype(np.float32)}


_CODE = np.random.default_rng(13).integers(1, 1 << 63, LONGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every character n-gram of the words, edges marked from two letters on, and the word's index."""
    joined = "".join(f"^{w}$" for w in words) if n > 1 else "".join(words)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + (2 if n > 1 else 0)
    word = np.repeat(np.arange(len(words)), size)
    m = max(0, len(code) - n + 1)
    h = np.full(m, n, np.uint64)
    for i in range(n):
        h += code[i:i + m] * _CODE[i]
    inside = word[:m] == word[n - 1:n - 1 + m] if m else np.zeros(0, bool)
    return tx.mix(h[inside]), word[:m][inside]


def gram_tables(model: dict) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n from LONGEST to 1, sorted hashes of the known n-grams and their log frequencies."""
    out = []
    for n in range(LONGEST, 0, -1):
        known = [(g, i) for (k, g), i in model["keys"].items() if k == n]
        code = np.array([[ord(c) for c in g] for g, _ in known], np.uint64).reshape(len(known), n)
        h = np.full(len(known), n, np.uint64)
        for i in range(n):
            h += code[:, i] * _CODE[i]
        h = tx.mix(h)
        order = np.argsort(h)
        out.append((h[order], model["logs"][[known[i][1] for i in order]].astype(np.float64)))
    return out


def unseen(tables: list, words: list[str], n_langs: int) -> np.ndarray:
    """Per word, the mean log frequency of its longest n-grams that are known; zero where none is."""
    out = np.zeros((len(words), n_langs))
    left = np.arange(len(words))
    for n, (keys, logs) in zip(range(LONGEST, 0, -1), tables, strict=True):
        if not len(left) or not len(keys):
            continue
        h, word = gram_hashes([words[i] for i in left], n)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        hit = keys[at] == h
        at, word = at[hit], word[hit]
        found = np.bincount(word, minlength=len(left))
        for k in range(n_langs):
            out[left, k] = np.bincount(word, logs[at, k], minlength=len(left)) / np.maximum(found, 1)
        left = left[found == 0]
    return out


def scorer(model: dict):
    langs, logs = model["langs"], model["logs"].astype(np.float64)
    known = {w: i for (k, w), i in model["keys"].items() if k == 0}
    tables = gram_tables(model)

    def block(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        ids: list[int] = []
        times: list[int] = []
        sizes: list[int] = []
        fresh: dict[str, int] = {}
        for text in texts:
            count = Counter(tokens(text))
            sizes.append(len(count))
            times.extend(count.values())
            for w in count:
                i = known.get(w)
                ids.append(i if i is not None else -1 - fresh.setdefault(w, len(fresh)))
        index, weight = np.array(ids, np.int64), np.array(times, np.float64)
        doc = np.repeat(np.arange(len(texts)), sizes)
        back_off = unseen(tables, list(fresh), len(langs))
        every = np.concatenate([logs, back_off[::-1]]) if len(langs) else np.zeros((0, 0))
        total = np.stack([np.bincount(doc, weight * every[index, k], minlength=len(texts)) for k in range(len(langs))], axis=1) \
            if len(langs) else np.zeros((len(texts), 0))
        words = np.bincount(doc, weight, minlength=len(texts))
        best = total.argmax(1) if len(langs) else np.zeros(len(texts), int)
        lead = total[np.arange(len(texts)), best][:, None] if len(langs) else 0
        score = 1 / np.exp((total - lead) / np.sqrt(np.maximum(words, 1))[:, None]).sum(1) if len(langs) else np.zeros(len(texts))
        some = [bool(langs) and bool(t) and (n > 0 or any(map(str.isalpha, t))) for t, n in zip(texts, sizes, strict=True)]
        return [langs[b] if s else "und" for b, s in zip(best, some, strict=True)], np.where(some, score, 0.0)

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            langs_out: list[str] = []
            scores = [np.zeros(0)]
            begin, held = 0, 0
            for i, t in enumerate(texts):
                held += len(t or "")
                if held >= BLOCK or i == len(texts) - 1:
                    got, score = block(texts[begin:i + 1])
                    langs_out += got
                    scores.append(score)
                    begin, held = i + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs_out, pa.string()), pa.array(np.concatenate(scores), pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])
    return run


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score per row of ``docs`` (doc_id, text, lang).

    lang_pred is ``und`` with score 0 for null text or text without a letter, or where nothing was learned;
    ties go to the first language by code point. Repeated rows are judged alike; other columns are ignored.
    """
    model = fit(docs)
    got = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(scorer(model), "doc_id bigint, lang_pred string, score double")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return got.select("doc_id", out.alias("held_out"), "lang_pred", "score")
