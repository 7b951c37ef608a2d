"""Phrase collocation mining by direct-address tiling.

Documents are tokenised once into blocks, a block being one language's documents of one
task as a stream of numbers. Words of enough occurrences get ids by falling frequency.
The ids of two neighbours address a cell of a matrix that is cut into tiles: the first
spans ``TILE`` ids, each further one as many as all before it, so that a block has few
tiles however many words there are. A block sends each tile once, as sorted cells with
their counts. Dense tiles are summed by direct address, sparse ones as sorted
coordinates. Pairs of enough occurrences are ranked in turn, sent back to the blocks
that asked, and paired with the word behind them: triples, then quadruples.

No cell is sent more than once by a block, and a tile of many occurrences is split by
cell, so no word or pair can fill a task. A row is a document; a null text is empty, a
null language is ``und``; empty tables give no phrase. Counts and products are exact.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.ranking import sequence_within
from rankloom.llm.scratch import Scratch

#: occurrences of a candidate, and its most words
LEAST, WORDS = 30, 4
#: a phrase goes if a longer candidate holds it in this share of its occurrences (percent)
CONTAINED = 80
#: phrases reported per language
TOP = 2000
#: text bytes of the blocks that a task fills at a time
BLOCK = 32 << 20
#: ids of the first tile, and cells that are counted by direct address
TILE, DENSE = 2048, 1 << 22
#: occurrences of one part of a tile, about
SPLIT = 1 << 25

#: bytes that end a piece become 0xFF, which UTF-8 never has; A-Z become lower case
_TABLE = bytes(0xFF if chr(b) in ".,;:!?\n\v\f\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_BREAK = b"\xff"


# ── numbers in rows ──────────────────────────────────────────────────────────
def pack(values: np.ndarray) -> bytes:
    """Non-negative integers in the least width that holds them all."""
    top = int(values.max(initial=0))
    return values.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if top <= np.iinfo(t).max)).tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}" if n else "<u1").astype(np.int64)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=0))


def unpack_sorted(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(data, n))


# ── tiles ────────────────────────────────────────────────────────────────────
def tile_of(ids: np.ndarray) -> np.ndarray:
    """0 for ids below TILE, then one tile per doubling."""
    return np.where(ids < TILE, 0, np.frexp(np.maximum(ids, 1) // TILE)[1]).astype(np.int64)


def base_of(tile: int) -> int:
    return TILE << (tile - 1) if tile else 0


def width_of(tile: int) -> int:
    return TILE << max(0, tile - 1)


def cells(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tile (64 times the left one's number plus the right one's) and cell of every pair of ids."""
    tx, ty = tile_of(x), tile_of(y)
    base, width = (np.array([f(t) for t in range(40)], np.int64) for f in (base_of, width_of))
    return tx * 64 + ty, (x - base[tx]) * width[ty] + y - base[ty]


def ids_of(tile: int, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    tx, ty = divmod(tile, 64)
    return base_of(tx) + cell // width_of(ty), base_of(ty) + cell % width_of(ty)


def count(tile: int, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells, ascending, and their counts: by direct address, or sorted coordinates."""
    size = width_of(tile // 64) * width_of(tile % 64)
    if size <= DENSE and len(cell) * 16 >= size:
        full = np.bincount(cell, minlength=size)
        found = np.flatnonzero(full)
        return found, full[found]
    return np.unique(cell, return_counts=True)


def part_of(cell: np.ndarray, parts: int) -> np.ndarray:
    mixed = cell.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


# ── tasks ────────────────────────────────────────────────────────────────────
def _tokenise(batches):
    """Rows (block, lang, n, words, counts, stream): local numbers, 0 between pieces and documents."""
    from pyspark import TaskContext

    schema = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("n", pa.int64()),
                        ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("stream", pa.binary())])
    block, size, held = TaskContext.get().partitionId() << 32, 0, {}

    def emit():
        nonlocal block
        for lang, (numbers, stream) in held.items():
            stream = np.concatenate(stream)
            total = np.bincount(stream, minlength=len(numbers))[1:]
            words = pa.array(list(numbers)[1:], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([
                pa.array([block]), pa.array([lang]), pa.array([int(total.sum())]),
                pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
                pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(total, pa.int64())),
                pa.array([stream.tobytes()], pa.binary())], schema=schema)
            block += 1

    for batch in batches:
        for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
            if lang not in held:
                numbers = defaultdict()
                numbers.default_factory = numbers.__len__
                numbers[_BREAK]
                held[lang] = numbers, []
            numbers, stream = held[lang]
            # only blank and tab are left for split()
            tokens = text.encode().translate(_TABLE).replace(_BREAK, b" \xff ").split()
            tokens.append(_BREAK)
            stream.append(np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens)))
            size += len(text)
            if size >= BLOCK:
                yield from emit()
                held.clear()
                size = 0
    yield from emit()


STREAM = "block long, lang string, n long, places binary, phrases binary, lasts binary"


def _stream(block: pa.Table, at: np.ndarray, phrase: np.ndarray, last: np.ndarray) -> pa.Table:
    """A block's frequent phrases of one length: where they start, their ids and their last words."""
    packed = {"places": pack_sorted(at), "phrases": pack(phrase), "lasts": pack(last)}
    return pa.table({"block": block["block"], "lang": block["lang"], "n": pa.array([len(at)], pa.int64()),
                     **{k: pa.array([v], pa.binary()) for k, v in packed.items()}})


def _pairs(n: int, places: bytes, phrases: bytes, lasts: bytes):
    """Places where two frequent phrases start one behind the other: the first, and the second's last word.

    A longer phrase is only frequent if all but its first and all but its last word are. Pieces are
    told apart by a gap.
    """
    at, phrase, last = unpack_sorted(places, n), unpack(phrases, n), unpack(lasts, n)
    first = np.flatnonzero(at[1:] == at[:-1] + 1)
    return at[first], phrase[first], last[first + 1]


def _to_ids(key, block: pa.Table, known: pa.Table) -> pa.Table:
    """The block's frequent words as phrases of one word."""
    stream = np.frombuffer(block["stream"][0].as_py(), np.int32)
    ids = np.full(int(stream.max(initial=0)) + 1, -1, np.int32)
    ids[known["pos"].to_numpy()] = known["id"].to_numpy()
    words = ids[stream]
    at = np.flatnonzero(words >= 0)
    return _stream(block, at, words[at], words[at])


def _send(heavy: dict):
    """Rows (block, lang, tile, part, n, cells, counts) of every block; ``heavy`` holds weights that call for a split."""
    schema = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("tile", pa.int32()), ("part", pa.int32()),
                        ("n", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())])

    def rows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block, lang, *stream = (batch.column(c)[i].as_py() for c in range(6))
                _, x, y = _pairs(*stream)
                tile, cell = cells(x, y)
                order = np.argsort(tile.astype(np.uint16), kind="stable")
                tile, cell = tile[order], cell[order]
                edge = np.append(np.flatnonzero(np.diff(tile, prepend=-1)), len(tile))
                for a, b in zip(edge, edge[1:]):
                    t = int(tile[a])
                    found, times = count(t, cell[a:b])
                    weight = min(heavy.get((lang, 0, t // 64), 0), heavy.get((lang, 1, t % 64), 0))
                    parts = 1 + weight // SPLIT
                    if parts == 1:
                        yield block, lang, t, 0, len(found), pack_sorted(found), pack(times)
                        continue
                    part = part_of(found, parts)
                    for p in np.unique(part).tolist():
                        own = part == p
                        yield block, lang, t, p, int(own.sum()), pack_sorted(found[own]), pack(times[own])

    def run(batches):
        held, size = [], 0
        for row in rows(batches):
            held.append(row)
            size += len(row[5]) + len(row[6])
            if size >= 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    return run


def _sum_tile(least: int):
    def run(key, rows):
        """Cells of one tile part with at least ``least`` occurrences in all blocks."""
        lang, tile, part = (k.as_py() for k in key)
        size = width_of(tile // 64) * width_of(tile % 64)
        each = ((unpack_sorted(c.as_py(), n.as_py()), unpack(t.as_py(), n.as_py()))
                for n, c, t in zip(rows["n"], rows["cells"], rows["counts"]))
        if size <= DENSE:
            full = np.zeros(size, np.int64)
            for cell, times in each:
                full[cell] += times  # a block names a cell once
            cell = np.flatnonzero(full >= least)
            total = full[cell]
        else:
            cell, times = (np.concatenate(x) for x in zip(*each))
            order = np.argsort(cell, kind="stable")
            cell, times = cell[order], times[order]
            first = np.flatnonzero(np.diff(cell, prepend=-1))
            total = np.add.reduceat(times, first)
            cell, total = cell[first][total >= least], total[total >= least]
        x, y = ids_of(tile, cell)
        k = len(cell)
        return pa.table({"lang": pa.array([lang] * k, pa.string()), "tile": pa.array([tile] * k, pa.int32()),
                         "part": pa.array([part] * k, pa.int32()), "cell": cell, "x": x, "y": y, "a": total})

    return run


def _answer(key, asked: pa.Table, known: pa.Table) -> pa.Table:
    """For every block that sent this tile part: its cells that are ranked phrases, with their ids."""
    tile = key[1].as_py()
    cell = known["cell"].to_numpy()
    order = np.argsort(cell)
    cell, ids = cell[order], known["id"].to_numpy()[order]
    out = []
    for block, n, data in zip(asked["block"], asked["n"], asked["cells"]) if len(cell) else ():
        own = unpack_sorted(data.as_py(), n.as_py())
        at = np.minimum(np.searchsorted(cell, own), len(cell) - 1)
        hit = cell[at] == own
        if hit.any():
            out.append((block.as_py(), tile, int(hit.sum()), pack_sorted(own[hit]), pack(ids[at[hit]])))
    schema = pa.schema([("block", pa.int64()), ("tile", pa.int32()), ("n", pa.int32()),
                        ("cells", pa.binary()), ("ids", pa.binary())])
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, schema.types)], schema=schema)


def _next_level(key, block: pa.Table, found: pa.Table) -> pa.Table:
    """The block's frequent phrases of one word more; no row if it has none."""
    if not block.num_rows or not found.num_rows:
        return block.slice(0, 0)
    at, x, y = _pairs(*(block[c][0].as_py() for c in ("n", "places", "phrases", "lasts")))
    tile, cell = cells(x, y)
    longer = np.full(len(at), -1, np.int64)
    answers = defaultdict(list)
    for t, k, c, i in zip(*(found[c].to_pylist() for c in ("tile", "n", "cells", "ids"))):
        answers[t].append((unpack_sorted(c, k), unpack(i, k)))
    for t, parts in answers.items():
        known, ids = (np.concatenate(z) for z in zip(*parts))
        order = np.argsort(known)
        known, ids = known[order], ids[order]
        own = np.flatnonzero(tile == t)
        where = np.minimum(np.searchsorted(known, cell[own]), len(known) - 1)
        hit = known[where] == cell[own]
        longer[own[hit]] = ids[where[hit]]
    hit = longer >= 0
    return _stream(block, at[hit], longer[hit], y[hit])


# ── the job ──────────────────────────────────────────────────────────────────
def _heavy(left: DataFrame, words: DataFrame) -> dict:
    """Occurrences per language and tile of ids, of those above SPLIT: at most 8 x all words / SPLIT entries."""
    tile = F.when(F.col("id") < TILE, 0).otherwise(F.floor(F.log2((F.col("id") / TILE).cast("long"))) + 1)
    return {(r.lang, side, int(r.tile)): int(r.w)
            for side, ids in enumerate((left, words))
            for r in (ids.groupBy("lang", tile.alias("tile")).agg(F.sum("a").alias("w"))
                      .where(F.col("w") >= SPLIT).collect())}


def count_phrases(docs: DataFrame, scratch: Scratch, least: int = LEAST) -> tuple[DataFrame, dict[int, DataFrame]]:
    """Words per language, and for m = 1 to 4 the phrases of m words with at least ``least`` occurrences.

    Phrases come as (lang, id, x, y, a): x the id of the first m - 1 words, y that of the last word.
    """
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = scratch.table(rows.mapInArrow(
        _tokenise, "block long, lang string, n long, words array<string>, counts array<long>, stream binary"), "blocks")
    totals = scratch.table(blocks.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    used = (blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")))
            .select("block", "lang", (F.col("pos") + 1).alias("pos"), F.col("col.words").alias("word"),
                    F.col("col.counts").alias("count")))
    frequent = used.groupBy("lang", "word").agg(F.sum("count").alias("a")).where(F.col("a") >= least)
    found = {1: scratch.table(
        sequence_within(frequent, ["lang"], [F.desc("a"), "word"], rn="id", count=None)
        .withColumn("id", F.col("id") - 1), "phrases1")}
    ids = used.join(found[1].select("lang", "word", "id"), ["lang", "word"]).select(F.col("block").alias("at"), "pos", "id")
    level = scratch.table(blocks.select("block", "lang", "stream").groupBy("block")
                          .cogroup(ids.groupBy("at")).applyInArrow(_to_ids, STREAM), "level1")
    scratch.drop("blocks")
    for m in range(2, WORDS + 1):
        heavy = _heavy(found[m - 1], found[1])
        sent = scratch.table(level.mapInArrow(
            _send(heavy), "block long, lang string, tile int, part int, n int, cells binary, counts binary"), f"sent{m}")
        ranked = (sent.groupBy("lang", "tile", "part").applyInArrow(
            _sum_tile(least), "lang string, tile int, part int, cell long, x long, y long, a long"))
        found[m] = scratch.table(
            sequence_within(ranked, ["lang"], [F.desc("a"), "x", "y"], rn="id", count=None)
            .withColumn("id", F.col("id") - 1), f"phrases{m}")
        if m < WORDS:
            answers = (sent.select("lang", "tile", "part", "block", "n", "cells").groupBy("lang", "tile", "part")
                       .cogroup(found[m].select("lang", "tile", "part", "cell", "id").groupBy("lang", "tile", "part"))
                       .applyInArrow(_answer, "block long, tile int, n int, cells binary, ids binary"))
            level = scratch.table(level.groupBy("block").cogroup(answers.groupBy("block"))
                                  .applyInArrow(_next_level, STREAM), f"level{m}")
        scratch.drop(f"sent{m}", f"level{m - 1}")
    return totals, found


def _cut(a, l, r, k):
    """(score, k, l, r) of one cut; the product may pass 64 bits."""
    score = F.expr(f"cast(cast({a} as decimal(19,0)) * 2000000 div (cast({l} as decimal(19,0)) + {r}) as long)")
    return F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r"))


def score_phrases(found: dict[int, DataFrame]) -> DataFrame:
    """(lang, phrase, a, l, r, score) of every candidate that no longer one nearly always holds."""
    words = found[1].select("lang", F.col("id").alias("y"), F.col("word"), F.col("a").alias("ry"))
    first = found[1].select("lang", F.col("id").alias("x"), F.col("word").alias("phrase"), F.col("a").alias("l1"))
    grown = {1: first.withColumn("w1", F.col("x"))}
    for m in range(2, WORDS + 1):
        # the words of a phrase, its text, and the counts of its beginnings l1 ... l(m-1) and of itself, l(m)
        grown[m] = (found[m].select("lang", F.col("id").alias("_id"), "x", "y", F.col("a").alias(f"l{m}"))
                    .join(grown[m - 1], ["lang", "x"]).join(words, ["lang", "y"])
                    .select("lang", F.col("_id").alias("x"), *(f"w{k}" for k in range(1, m)), F.col("y").alias(f"w{m}"),
                            F.concat_ws(" ", "phrase", "word").alias("phrase"),
                            *(f"l{k}" for k in range(1, m + 1)), F.col("ry").alias(f"r{m - 1}")))
    out = []
    for m in range(2, WORDS + 1):
        rows = grown[m]
        for k in range(1, m - 1):  # the rest behind the first k words, itself frequent
            rest = grown[m - k].select("lang", *(F.col(f"w{j}").alias(f"w{j + k}") for j in range(1, m - k + 1)),
                                       F.col(f"l{m - k}").alias(f"r{k}"))
            rows = rows.join(rest, ["lang", *(f"w{j + k}" for j in range(1, m - k + 1))])
        if m < WORDS:
            # what lies in a quadruple lies in one of its triples, which is as frequent at least
            at = [F.struct(*(F.col(f"w{j + k}").alias(f"w{j}") for j in range(1, m + 1))) for k in range(2)]
            longer = (grown[m + 1].select("lang", F.explode(F.array(*at)).alias("s"), F.col(f"l{m + 1}").alias("longer"))
                      .select("lang", "s.*", "longer").groupBy("lang", *(f"w{j}" for j in range(1, m + 1)))
                      .agg(F.max("longer").alias("longer")))
            rows = (rows.join(longer, ["lang", *(f"w{j}" for j in range(1, m + 1))], "left")
                    .where(F.expr(f"coalesce(100 * longer < {CONTAINED} * l{m}, true)")))
        cut = F.array_min(F.array(*(_cut(f"l{m}", f"l{k}", f"r{k}", k) for k in range(1, m))))
        out.append(rows.select("lang", "phrase", F.col(f"l{m}").alias("a"), cut.alias("c"))
                   .select("lang", "phrase", "a", "c.l", "c.r", "c.score"))
    return out[0].unionByName(out[1]).unionByName(out[2])


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of every language."""
    scratch = Scratch(docs.sparkSession, "phrases")
    totals, found = count_phrases(docs, scratch, least)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = score_phrases(found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS no,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (
  SELECT lang, m, w[i:i + m - 1] AS p, count(*) AS a
  FROM i, (SELECT unnest(range(1, 5)) AS m) WHERE i + m - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT * FROM g WHERE m >= 2 AND a >= 30),
cut AS (
  SELECT c.lang, c.m, c.p, c.a, k, x.a AS l, y.a AS r, CAST(2000000::HUGEINT * c.a // (x.a + y.a) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c
  JOIN g x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN g y ON y.lang = c.lang AND y.p = c.p[k + 1:c.m]),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
longer AS (
  SELECT lang, s, max(a) AS a FROM (
    SELECT lang, a, p[j:j + q - 1] AS s FROM (
      SELECT *, unnest(range(1, m - q + 2)) AS j FROM (SELECT *, unnest(range(2, m)) AS q FROM c))) GROUP BY ALL),
kept AS (
  SELECT best.* FROM best LEFT JOIN longer ON longer.lang = best.lang AND longer.s = best.p
  WHERE longer.a IS NULL OR 100 * longer.a < 80 * best.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(p, ' '))) AS rank,
       array_to_string(p, ' ') AS phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""
