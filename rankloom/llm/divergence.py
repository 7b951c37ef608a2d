"""Source divergence audit by chunk factorization.

White-space chunks are counted per document inside blocks of documents; a block sends
one row per language and chunk, however often the chunk occurs, so no chunk or source
can fill a task. The rows are added up per language and chunk; every globally distinct
chunk is tokenised once, and its terms are joined back.

A document may hold a term by several chunks, so documents of different chunks must not
be added. A chunk keeps the exact number of its documents, the first and the last of
them: with two at most these are all, with more the term is in enough documents anyway.

Two sources of a language are compared over all kept terms without forming them: what
a pair of absent counts, and a present against an absent count, contribute follows
from each source's histogram of counts; only terms that both sources hold are compared
one by one, in numpy, by groups of terms. Every row is a document; null text, language
and source are ''. All arithmetic is exact: decimals in Spark, 64-bit integers where
the values are bounded by 10^18.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.scratch import Scratch

#: a language keeps the terms that this many of its documents hold (a chunk names two of its documents)
MIN_DOCS = 3
#: terms reported per source
TOP = 200
#: text bytes of one block of documents
BLOCK = 24 << 20
#: terms of one comparison group, and of one numpy pass
GROUP, PASS = 1 << 16, 1 << 13
#: sources of one tile of the comparison
TILE = 64

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"([^\x00-\x40\x5B-\x60\x7B-\x7F]+)"
BIG = "decimal(38,0)"


SCHEMA = pa.schema([("lang", pa.string()), ("chunk", pa.string()), ("docs", pa.int64()), ("first", pa.int64()),
                    ("last", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def _count_block(langs: pa.Array, sources: pa.Array, texts: pa.Array, base: int) -> pa.RecordBatch:
    """Rows (lang, chunk) of some documents: how many hold it, the first, the last, and occurrences per source."""
    split = pc.ascii_split_whitespace(texts)
    chunks = split.flatten().dictionary_encode()
    doc = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    lang, source = langs.dictionary_encode(), sources.dictionary_encode()
    of_lang, of_source = lang.indices.to_numpy().astype(np.int64), source.indices.to_numpy().astype(np.int64)
    code, names = chunks.indices.to_numpy(), chunks.dictionary
    blank = pc.index(names, pa.scalar("")).as_py()  # white space at an end gives an empty chunk
    if blank >= 0:
        solid = code != blank
        code, doc = code[solid], doc[solid]

    # per document: each of its chunks with its count
    key = (of_lang[doc] * len(names) + code) * len(texts) + doc
    key.sort()
    start = np.flatnonzero(np.diff(key, prepend=-1))
    count = np.diff(start, append=len(key))
    held, doc = key[start] // len(texts), key[start] % len(texts)

    # per language and chunk
    head = np.flatnonzero(np.diff(held, prepend=-1))
    docs = np.diff(head, append=len(held))
    by_source = np.repeat(np.arange(len(head)), docs) * len(source.dictionary) + of_source[doc]
    order = np.argsort(by_source, kind="stable")
    by_source = by_source[order]
    start = np.flatnonzero(np.diff(by_source, prepend=-1))
    total = np.add.reduceat(count[order], start) if len(start) else count
    ends = np.searchsorted(by_source[start], np.arange(len(head) + 1) * len(source.dictionary))
    ends = pa.array(ends, pa.int32())
    return pa.RecordBatch.from_arrays([
        lang.dictionary.take(pa.array(held[head] // len(names))), names.take(pa.array(held[head] % len(names))),
        pa.array(docs, pa.int64()), pa.array(base + doc[head]), pa.array(base + doc[head + docs - 1]),
        pa.ListArray.from_arrays(ends, source.dictionary.take(pa.array(by_source[start] % len(source.dictionary)))),
        pa.ListArray.from_arrays(ends, pa.array(total, pa.int64()))], schema=SCHEMA)


def _count_chunks(batches):
    """Blocks of at most BLOCK bytes of text, or one longer document; documents are numbered over all tasks."""
    from pyspark import TaskContext

    from rankloom.llm import text

    base = TaskContext.get().partitionId() << 40
    for batch in batches:
        _, off = text.utf8(batch.column("text"))
        for i, j in text.pieces(off, BLOCK):
            yield _count_block(*(batch.column(c).slice(i, j - i) for c in ("lang", "source", "text")), base)
            base += j - i


#: SQL of 1 + floor(10^9 (c + 1) / (n + v)), exactly
RATE = "(1 + cast((cast({c} as decimal(19,0)) + 1) * 1000000000 div (cast({n} as decimal(19,0)) + {v}) as long))"


def _apart(p: str, q: str) -> str:
    """SQL of floor((p - q)^2 / q); p and q are at most 10^9 + 1."""
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def _with_sources(rows: DataFrame, key: str) -> DataFrame:
    """Rows grouped by language and ``key``, counts added per source; stays within the partitions of ``key``."""
    return (rows.groupBy("lang", key, "source")
            .agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"),
                 F.min("first").alias("first"), F.max("last").alias("last"))
            .groupBy("lang", key)
            .agg(F.sum("docs").alias("docs"), F.min("first").alias("first"), F.max("last").alias("last"),
                 F.collect_list(F.struct("source", "count")).alias("uses")))


def kept_terms(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(lang, term, count, uses): terms in MIN_DOCS documents of their language, with counts per source."""
    rows = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    blocks = rows.mapInArrow(_count_chunks, "lang string, chunk string, docs long, first long, last long, "
                                            "sources array<string>, counts array<long>")
    once = lambda c: F.when(F.col("pos") == 0, F.col(c)).alias(c)
    chunks = scratch.table(_with_sources(
        blocks.repartition("chunk")
        .select("lang", "chunk", "docs", "first", "last", F.posexplode(F.arrays_zip("sources", "counts")))
        .select("lang", "chunk", F.col("col.sources").alias("source"), F.col("col.counts").alias("count"),
                once("docs"), once("first"), once("last")), "chunk"), "chunks")
    scratch.release()
    lowered = F.translate("chunk", UPPER, LOWER)
    terms = (chunks.select("chunk").distinct()
             .select("chunk", F.regexp_extract_all(lowered, F.lit(TERM), 1).alias("terms"))
             .where(F.size("terms") > 0))
    # one row per source of a chunk, and one per named document, so that both are grouped in one go
    number = F.lit(None).cast("long")
    parts = F.concat(
        F.transform("uses", lambda u: F.struct(u.source.alias("source"), u["count"].alias("count"),
                                               number.alias("doc"), number.alias("docs"))),
        F.array(*(F.struct(F.lit(None).cast("string").alias("source"), number.alias("count"),
                           F.col(c).alias("doc"), F.col("docs").alias("docs")) for c in ("first", "last"))))
    kept = (chunks.join(terms, "chunk")
            .select("lang", F.explode("terms").alias("term"), "docs", "first", "last", "uses")
            .repartition("lang", "term").select("lang", "term", F.explode(parts).alias("p"))
            .groupBy("lang", "term", "p.source", "p.doc")
            .agg(F.sum("p.count").alias("count"), F.max("p.docs").alias("docs"))
            .groupBy("lang", "term")
            .agg(F.sum("count").alias("count"), F.count("doc").alias("named"), F.max("docs").alias("docs"),
                 F.collect_list(F.when(F.col("doc").isNull(), F.struct("source", "count"))).alias("uses"))
            .where(F.greatest("named", "docs") >= MIN_DOCS).drop("named", "docs"))
    return scratch.table(kept, "kept")


def group_table(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, i, v, total, lang_total, p0): every occurring group, numbered within its language."""
    groups = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    totals = (kept.select("lang", F.explode("uses").alias("u"))
              .groupBy("lang", "u.source").agg(F.sum("u.count").alias("total")))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("count").alias("lang_total"))
    return (groups.join(totals, ["lang", "source"], "left").join(langs, ["lang"], "left")
            .na.fill(0, ["total", "v", "lang_total"])
            .withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
            .withColumn("p0", F.when(F.col("v") > 0, F.expr(RATE.format(c="0", n="total", v="v")))))


def _shared(key, terms: pa.Table, groups: pa.Table) -> pa.Table:
    """Per pair of sources, what terms of both add beyond what their counts alone say."""
    p0 = np.empty(groups.num_rows, np.int64)
    p0[groups["no"].to_numpy()] = groups["base"].to_numpy()
    at, p, term = terms["i"].to_numpy(), terms["p"].to_numpy(), terms["id"].to_numpy()
    tile = at // TILE
    order = np.lexsort((term, tile))
    at, p, term, tile = at[order], p[order], term[order], tile[order]
    edge = np.searchsorted(tile, np.arange(len(p0) // TILE + 2))
    apart = lambda a, b: (a - b) * (a - b) // b
    seen = [np.unique(term[a:b]) for a, b in zip(edge, edge[1:])]

    def dense(k, some):
        """Rates of ``some`` terms at the sources of tile k, and where they are present."""
        a, b = edge[k] + np.searchsorted(term[edge[k]:edge[k + 1]], [some[0], some[-1]], "left")
        b = edge[k] + np.searchsorted(term[edge[k]:edge[k + 1]], some[-1], "right")
        row = np.searchsorted(some, term[a:b])
        own = some[np.minimum(row, len(some) - 1)] == term[a:b]
        base = p0[k * TILE:(k + 1) * TILE]
        out, there = np.tile(base, (len(some), 1)), np.zeros((len(some), len(base)), bool)
        col = at[a:b][own] - k * TILE
        out[row[own], col], there[row[own], col] = p[a:b][own], True
        return out, there

    found = []
    for i in range(len(seen)):
        for j in range(len(seen)):
            both = np.intersect1d(seen[i], seen[j], assume_unique=True)
            q0 = p0[j * TILE:(j + 1) * TILE]
            total = np.zeros((len(p0[i * TILE:(i + 1) * TILE]), len(q0)), np.int64)
            for s in range(0, len(both), PASS):
                left, there = dense(i, both[s:s + PASS])
                right, _ = dense(j, both[s:s + PASS])
                for a in range(len(total)):
                    own, base = there[:, a], p0[i * TILE + a]
                    pa_, pb = left[own, a][:, None], right[own]
                    total[a] += (apart(pa_, pb) - apart(pa_, q0) - apart(base, pb) + apart(base, q0)).sum(0)
            a, b = np.nonzero(total)
            found.append((a + i * TILE, b + j * TILE, total[a, b]))
    a, b, value = (np.concatenate(x) for x in zip(*found))
    apart_ones = a != b
    a, b, value = a[apart_ones], b[apart_ones], value[apart_ones]
    return pa.table({"lang": pa.array([key[0].as_py()] * len(a), pa.string()), "a": a, "b": b, "value": value})


def pair_values(kept: DataFrame, rates: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value): divergence of source number a from b, over all kept terms."""
    a = groups.select("lang", "v", F.col("i").alias("a"), F.col("p0").alias("pa"))
    b = groups.select("lang", F.col("i").alias("b"), F.col("p0").alias("pb"))
    none = a.join(b, "lang").where("a <> b").select(
        "lang", "a", "b", F.expr(f"coalesce(cast(v as {BIG}) * {_apart('pa', 'pb')}, 0)").alias("value"))

    # a source's terms against sources that lack them: by how many terms have a rate
    sizes = (rates.groupBy("lang", F.col("i").alias("a"), "p").agg(F.count("*").alias("n"))
             .join(a.select("lang", "a", "pa"), ["lang", "a"]).join(b, "lang").where("a <> b"))
    one = sizes.select("lang", F.explode(F.array(
        F.struct("a", "b", F.expr(f"cast(n as {BIG}) * ({_apart('p', 'pb')} - {_apart('pa', 'pb')})").alias("value")),
        F.struct(F.col("b").alias("a"), F.col("a").alias("b"),
                 F.expr(f"cast(n as {BIG}) * ({_apart('pb', 'p')} - {_apart('pb', 'pa')})").alias("value")))).alias("x")
    ).select("lang", "x.*")

    salts = F.expr(f"1 + v div {GROUP}")
    terms = (rates.withColumn("salt", F.pmod(F.xxhash64("id"), salts))
             .select("lang", "salt", "id", "i", "p").groupBy("lang", "salt"))
    sides = (groups.where("v > 0").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
             .select(F.col("lang").alias("lang"), "salt", F.col("i").alias("no"), F.col("p0").alias("base"))
             .groupBy("lang", "salt"))
    both = terms.cogroup(sides).applyInArrow(_shared, "lang string, a long, b long, value long")
    parts = [x.select("lang", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"),
                      F.col("value").cast(BIG).alias("value")) for x in (none, one, both)]
    return (parts[0].unionByName(parts[1]).unionByName(parts[2])
            .groupBy("lang", "a", "b").agg(F.sum("value").cast("long").alias("value")))


def audit(docs: DataFrame, top: int = TOP) -> DataFrame:
    """Divergence of every source from every other of its language, and its most typical terms."""
    scratch = Scratch(docs.sparkSession, "divergence")
    kept = kept_terms(docs, scratch)
    scratch.drop("chunks")
    scratch.release()
    groups = scratch.table(group_table(docs, kept), "groups")
    # numbered before they are exploded: all rows of a term share its number
    rates = (kept.withColumn("id", F.monotonically_increasing_id())
             .select("lang", "term", "id", F.col("count").alias("lang_count"), F.explode("uses").alias("u"))
             .select("lang", "term", "id", "lang_count", "u.source", F.col("u.count").alias("count"))
             .join(groups, ["lang", "source"])
             .withColumn("p", F.expr(RATE.format(c="count", n="total", v="v")))
             .withColumn("q", F.expr(RATE.format(c="lang_count", n="lang_total", v="v"))))

    names = groups.select("lang", "source", "i")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = (pair_values(kept, rates, groups)
             .join(names.withColumnRenamed("i", "a"), ["lang", "a"])
             .join(names.select("lang", F.col("i").alias("b"), F.col("source").alias("item")), ["lang", "b"])
             .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
             .withColumn("rank", F.row_number().over(best)))
    terms = (rates.where("p > q")
             .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                     F.expr(_apart("p", "q")).alias("value"))
             .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top))
    return pairs.unionByName(terms)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
w AS (SELECT no, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS cl FROM w GROUP BY ALL HAVING count(DISTINCT no) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
lv AS (SELECT lang, count(*) AS v, sum(cl) AS nl FROM k GROUP BY lang),
gn AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
         1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (coalesce(gn.n, 0) + lv.v) AS p,
         1 + (1000000000::HUGEINT * (k.cl + 1)) // (lv.nl + lv.v) AS q
  FROM g JOIN k USING (lang) JOIN lv USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN gn USING (lang, source)),
x AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INT) AS rank
FROM r QUALIFY part = 'pair' OR rank <= 200
"""
