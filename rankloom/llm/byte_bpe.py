"""Byte-level BPE by overlapping chunk encoding.

A text of at most ``CHUNK + OVERLAP`` code points is one chunk. A longer one is cut
into chunks that overlap, so that one text spreads over many tasks:

1. every chunk is pre-tokenised on its own; a chunk starts anywhere, so its first
   boundaries may be wrong;
2. two neighbours are stitched at the first position of their overlap where both
   have a boundary: a match depends only on the text behind its start, so from there
   on both agree. Where an overlap has none (one run of letters, digits, signs or
   white space fills it), the neighbours are merged and pre-tokenised again as one;
3. the pieces between two stitches are encoded, and a text's ids are put together.

Decoding concatenates the tokens' raw bytes. Null texts count as empty; repeated rows
are encoded each; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.llm.scratch import Scratch

#: code points from one chunk's start to the next, and how far a chunk reaches into the next
CHUNK, OVERLAP = 32768, 1024
#: a match is settled once this many code points behind its end are known
LOOKAHEAD = 3
#: pieces whose ids a task remembers, and the longest remembered
REMEMBERED, SHORT = 300_000, 64
#: rows and bytes of one output batch
ROWS, BYTES = 2048, 16 << 20


def _ranges(points: set[str]) -> str:
    """Characters as ranges of a character class."""
    at = np.sort(np.fromiter(map(ord, points), np.int64))
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    last = np.append(first[1:], len(at))[:len(first)] - 1
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(at[first], at[last]))


def exact_classes(pattern: str) -> tuple[str, str]:
    """``pattern`` with the encoder's own ``\\p{L}`` and ``\\p{N}``, and a class of the characters in dispute.

    The splitting and the encoding library may know different Unicode versions. The
    encoder is asked once: with single bytes as its only tokens and a class as its
    pattern, the bytes it returns are the characters that it counts to the class.
    """
    import regex
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    disputed = ""
    for name in (r"\p{L}", r"\p{N}"):
        probe = tiktoken.Encoding("probe", pat_str=name, mergeable_ranks=single, special_tokens={})
        theirs = set(probe.decode_bytes(probe.encode_ordinary(every)).decode())
        ours = set(regex.findall(name, every))
        less, more = _ranges(ours - theirs), _ranges(theirs - ours)
        exact = f"[{name}--[{less}]]" if less else name
        exact = f"[{exact}{more}]" if more else exact
        pattern, disputed = pattern.replace(name, exact), disputed + less + more
    return pattern, f"[{disputed}]" if disputed else ""


class _Pieces(dict):
    """Ids of a piece as packed little-endian 32-bit integers; forgets all when full."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        out = np.array(self.encode(piece), "<u4").tobytes()
        if len(piece) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = out
        return out


class Codec:
    """Splits, encodes and decodes inside a task; made from what ``vocabulary`` broadcasts."""

    def __init__(self, ranks: dict[bytes, int], plain: str, exact: str, disputed: str):
        import regex
        import tiktoken

        # the whole piece is one match, so nothing is split again
        whole = tiktoken.Encoding("piece", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.ids = _Pieces(whole.encode_ordinary)
        self.plain, self.exact = regex.compile(plain).findall, regex.compile(exact, regex.V1).findall
        self.disputed = regex.compile(disputed, regex.V1).search if disputed else lambda text: None
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token

    def pieces(self, text: str) -> list[str]:
        odd = not text.isascii() and self.disputed(text)
        return self.exact(text) if odd else self.plain(text)

    def encode(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.ids.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def vocabulary(spark: SparkSession, path: str, pattern: str):
    """Broadcast of the rank file at ``path`` (one public vocabulary, of fixed size) and the split patterns."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return spark.sparkContext.broadcast((ranks, pattern, *exact_classes(pattern)))


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded rows and bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if len(held) >= ROWS or size >= BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, ROWS).columns))


def _encode_short(vocab):
    schema = pa.schema([("doc", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        codec = Codec(*vocab.value)
        yield from _batches(((d, codec.encode(codec.pieces(t))) for d, t in _rows(batches)), schema)

    return run


def _cut(chunk: int, overlap: int):
    schema = pa.schema([("row", pa.int64()), ("doc", pa.int64()), ("k", pa.int32()), ("n", pa.int32()),
                        ("text", pa.string())])

    def chunks(batches):
        for row, doc, text in _rows(batches):
            n = max(1, -((overlap - len(text)) // chunk))
            for k in range(n):
                yield row, doc, k, n, text[k * chunk:] if k == n - 1 else text[k * chunk:(k + 1) * chunk + overlap]

    def run(batches):
        yield from _batches(chunks(batches), schema)

    return run


def _pretokenise(vocab, chunk: int, overlap: int):
    """Adds a chunk's boundaries: all of them, and those in its overlaps with the chunk before and behind."""
    whole = pa.list_(pa.int32())
    schema = pa.schema([("row", pa.int64()), ("doc", pa.int64()), ("k", pa.int32()), ("n", pa.int32()),
                        ("text", pa.string()), ("ends", whole), ("head", whole), ("tail", whole)])

    def run(batches):
        codec = Codec(*vocab.value)

        def each():
            for row, doc, k, n, text in _rows(batches):
                ends = np.cumsum(np.fromiter(map(len, codec.pieces(text)), np.int32), dtype=np.int32)
                if k < n - 1:
                    ends = ends[ends + LOOKAHEAD <= len(text)]
                head = np.append(np.int32(0), ends[:np.searchsorted(ends, overlap, "right")])
                tail = ends[np.searchsorted(ends, chunk):] - np.int32(chunk) if k < n - 1 else ends[:0]
                yield row, doc, k, n, text, ends, head, tail

        yield from _batches(each(), schema)

    return run


def _encode_pieces(vocab, chunk: int):
    """Ids of each run of chunks between two stitches; rows come sorted by text, run and chunk."""
    schema = pa.schema([("row", pa.int64()), ("doc", pa.int64()), ("run", pa.int32()), ("ids", pa.binary())])

    def run(batches):
        codec = Codec(*vocab.value)

        def settled(parts) -> tuple:
            row, doc, first, _, ends, start, _ = parts[0]
            *others, (_, _, _, text, _, _, beyond) = parts
            text = "".join([p[3][:chunk] for p in others] + [text])
            stop = len(text) if beyond is None else len(parts) * chunk + beyond
            if not others:
                at = [start, *(e for e in ends if start < e < stop), stop]
                pieces = [text[a:b] for a, b in zip(at, at[1:])]
            else:
                pieces = codec.pieces(text[start:])
                ends = start + np.cumsum(np.fromiter(map(len, pieces), np.int64))
                pieces = pieces[:int(np.searchsorted(ends, stop)) + 1]
                if sum(map(len, pieces)) != stop - start:
                    raise ValueError("two chunks were stitched where the text has no boundary")
            return row, doc, first, codec.encode([p for p in pieces if p])

        def runs():
            parts = []
            for x in _rows(batches):
                if parts and (x[0], x[2]) != (parts[0][0], parts[0][2]):
                    yield settled(parts)
                    parts = []
                parts.append(x)
            if parts:
                yield settled(parts)

        yield from _batches(runs(), schema)

    return run


def _assemble(batches):
    """One row per text from its runs, which come sorted."""
    schema = pa.schema([("doc", pa.int64()), ("ids", pa.binary())])

    def texts():
        row, doc, parts = None, None, []
        for r, d, ids in _rows(batches):
            if parts and r != row:
                yield doc, b"".join(parts)
                parts = []
            row, doc = r, d
            parts.append(ids)
        if parts:
            yield doc, b"".join(parts)

    yield from _batches(texts(), schema)


def encode(docs: DataFrame, vocab, id_col: str = "doc_id", text_col: str = "text",
           chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``id_col`` and ``ids`` (little-endian unsigned 32-bit integers) of every row's whole text."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(text_col, F.lit("")).alias("text"))
    long = F.char_length("text") > chunk + overlap
    short = rows.where(~long).mapInArrow(_encode_short(vocab), "doc long, ids binary")

    scratch = Scratch(spark, "byte_bpe")
    cut = (rows.where(long).select(F.monotonically_increasing_id().alias("row"), "doc", "text")
           .mapInArrow(_cut(chunk, overlap), "row long, doc long, k int, n int, text string"))
    chunks = scratch.table(
        cut.repartition("row", "k").mapInArrow(
            _pretokenise(vocab, chunk, overlap),
            "row long, doc long, k int, n int, text string, ends array<int>, head array<int>, tail array<int>"),
        "chunks")

    # stitches: the first boundary that a chunk shares with the one before it
    before = chunks.select("row", (F.col("k") + 1).alias("k"), F.col("tail").alias("seen"))
    text = Window.partitionBy("row").orderBy("k")
    cuts = (chunks.select("row", "k", "head").join(before, ["row", "k"], "left")
            .select("row", "k", F.when(F.col("k") == 0, F.lit(0)).otherwise(
                F.array_min(F.array_intersect("head", "seen"))).alias("start"))
            .select("row", "k", "start", F.lead("start").over(text).alias("stop"),
                    F.max(F.when(F.col("start").isNotNull(), F.col("k"))).over(text).alias("run")))
    runs = (chunks.join(cuts, ["row", "k"])
            .select("row", "doc", "k", "run", "text", "ends", "start", "stop")
            .repartition("row", "run").sortWithinPartitions("row", "run", "k")
            .select("row", "doc", "run", "text", "ends", "start", "stop")
            .mapInArrow(_encode_pieces(vocab, chunk), "row long, doc long, run int, ids binary"))
    whole = (runs.repartition("row").sortWithinPartitions("row", "run").select("row", "doc", "ids")
             .mapInArrow(_assemble, "doc long, ids binary"))
    return short.unionByName(whole).withColumnRenamed("doc", id_col)


def decode(encoded: DataFrame, vocab, id_col: str = "doc_id") -> DataFrame:
    """``encoded`` with ``bytes``, the concatenated raw bytes of every row's tokens."""
    schema = pa.schema([("doc", pa.int64()), ("ids", pa.binary()), ("bytes", pa.binary())])

    def run(batches):
        codec = Codec(*vocab.value)
        yield from _batches(((d, i, codec.decode(i)) for d, i in _rows(batches)), schema)

    return (encoded.select(F.col(id_col).alias("doc"), "ids")
            .mapInArrow(run, "doc long, ids binary, bytes binary").withColumnRenamed("doc", id_col))


def digest(docs: DataFrame, path: str, pattern: str, **sizes) -> DataFrame:
    """Counts and hashes of every text's ids and of the bytes they decode to."""
    vocab = vocabulary(docs.sparkSession, path, pattern)
    return decode(encode(docs, vocab, **sizes), vocab).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
