"""Byte-level BPE, source divergence and phrase mining against brute force; odd rows everywhere."""
import base64
import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest

from rankloom.llm import byte_bpe, divergence, phrases

DOCS = "doc_id bigint, text string, lang string, source string, block string, ids int, cells string, n string"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def frame(spark, rows):
    return spark.createDataFrame([(d, t, la, so, "x", 7, "y", "z") for d, t, la, so in rows], DOCS)


# op11
@pytest.fixture(scope="module")
def ranks():
    with open(RANKS, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@pytest.fixture(scope="module")
def library(ranks):
    import tiktoken
    return tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def merged(piece, ranks):
    """Plain byte-pair merging of one piece."""
    parts = [bytes([b]) for b in piece]
    while len(parts) > 1:
        rank, i = min((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 30:
            break
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def digests(rows, library):
    out = []
    for d, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        out.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def bpe_rows():
    rng = random.Random(5)
    alphabet = "ab 'sre\n\t  ,.12é字՘࢏\U000200001　\xa0\x1c"
    texts = [None, "", "a" * 500, "'" * 300 + "'re's" + " " * 400 + "x", "\n" * 200, "<|endoftext|> and more" * 20]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(150)]
    texts += ["".join(rng.choice(alphabet) * rng.choice([1, 1, 1, 2, 60]) for _ in range(rng.randint(0, 80))) for _ in range(150)]
    rows = [(k, t, None, None) for k, t in enumerate(texts)]
    return rows + rows[:5] + [(None, "no id here " * 9, None, None), (3, "one id, other text", None, None)]


@pytest.mark.parametrize("chunk,overlap", [(32, 8), (40, 1), (byte_bpe.CHUNK, byte_bpe.OVERLAP)])
def test_bpe_equals_library(spark, library, chunk, overlap):
    rows = bpe_rows()
    got = byte_bpe.digest(frame(spark, rows), RANKS, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap)
    assert sorted(map(tuple, got.collect()), key=repr) == digests(rows, library)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_bpe_documents(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = byte_bpe.digest(docs, RANKS, public_tokenizers.PATTERN, chunk=500, overlap=40)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, got.collect()), key=repr) == digests(rows, library)
    assert byte_bpe.digest(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_pieces_equal_plain_merging(ranks, library):
    codec = byte_bpe.Codec(ranks, public_tokenizers.PATTERN, *byte_bpe.exact_classes(public_tokenizers.PATTERN))
    for text in ("Hello there, it's 2024!", "naïve  字字\n\n x", "a" * 70 + " zzqx"):
        want = [i for p in codec.pieces(text) for i in merged(p.encode(), ranks)]
        got = codec.encode(codec.pieces(text))
        assert np.frombuffer(got, "<u4").tolist() == want
        assert codec.decode(got) == text.encode()
    long = "ab" * 100_000  # one piece
    assert codec.decode(codec.encode(codec.pieces(long))) == long.encode()


# op12
ODD = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", None), (4, "Foo-foo foo, BAR bar.", "en", "a"),
       (5, "foo bar\x0bbaz\xa0baz É é", "en", "b"), (5, "foo bar\x0bbaz\xa0baz É é", "en", "b"), (6, "bar foo|bar x1y x", "en", "c"),
       (7, "foo " * 5000 + "bar", "en", None), (8, "only here", "fr", "a"), (9, "other there", "fr", "b"), (10, "word", None, "a"),
       (11, "word Word", None, "b"), (12, "word,word x", "", ""), (13, "12 34 !", "de", "a"), (14, "é É é x y", "en", "d")]


def brute_audit(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(la or "", so or "", re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower))) for _, t, la, so in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = collections.Counter(t for _, _, ts in own for t in set(ts))
        kept = {t for t, k in held.items() if k >= 3}
        count = {s: collections.Counter(t for _, so, ts in own if so == s for t in ts if t in kept) for s in {d[1] for d in own}}
        whole = sum(count.values(), collections.Counter())
        rate = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))
        for s, c in count.items():
            pairs = {o: sum((rate(c, t) - rate(q, t))**2 // rate(q, t) for t in kept) for o, q in count.items() if o != s}
            terms = {t: (rate(c, t) - rate(whole, t))**2 // rate(whole, t) for t in kept if c[t] and rate(c, t) > rate(whole, t)}
            for part, found, top in (("pair", pairs, None), ("term", terms, 200)):
                ranked = sorted(found.items(), key=lambda x: (-x[1], x[0].encode()))[:top]
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(ranked, 1)]
    return sorted(out)


def test_audit_odd_rows(spark):
    got = divergence.audit(frame(spark, ODD))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_audit(ODD)
    assert divergence.audit(frame(spark, ODD).limit(0)).count() == 0


def test_audit_many_blocks_and_tiles(spark, monkeypatch):
    for name, value in (("BLOCK", 400), ("GROUP", 4), ("PASS", 3), ("TILE", 3)):
        monkeypatch.setattr(divergence, name, value)
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in "abcdefgh" for b in "xyzé"]
    rows = [(k, " ".join(rng.choices(vocabulary, weights=range(1, 33), k=rng.randint(0, 30))), rng.choice(["en", "en", "fr"]),
             f"s{min(rng.randint(0, 12), rng.randint(0, 12))}") for k in range(160)]
    assert sorted(map(tuple, divergence.audit(frame(spark, rows).repartition(3)).collect())) == brute_audit(rows)


# op13
def brute_phrases(rows, least, top=2000):
    out = []
    for lang in {la or "und" for _, _, la, _ in rows}:
        f = collections.Counter()
        for _, text, la, _ in rows:
            if (la or "und") != lang:
                continue
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
            for piece in re.split("[.,;:!?\n-\r]", low):
                w = [x for x in re.split("[ \t]+", piece) if x]
                f.update(tuple(w[i:i + m]) for m in range(1, 5) for i in range(len(w) - m + 1))
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, a in candidates.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
                if j - i < len(p) and 100 * a >= 80 * f[p[i:j]]}
        found = []
        for p, a in candidates.items():
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            if p not in gone:
                found.append((-score, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]]))
        out += [(lang, k, p.decode(), a, le, r, n, -s) for k, (s, _, p, a, le, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def phrase_rows():
    rng = random.Random(9)
    vocabulary = [f"{a}{b}" for a in "abcdefgh" for b in "wxyzé"]
    rows = [(k, "".join(rng.choices(vocabulary, weights=[400 // (i + 1) + 1 for i in range(40)])[0] + rng.choice([" ", " ", " ", "\t ", ", ", ".\n", "\x0b"])
                        for _ in range(rng.randint(0, 60))), rng.choice(["en", "en", "fr", None]), None) for k in range(120)]
    return rows + [(500, None, "en", None), (501, "", None, None), (502, "ha " * 300, "en", None), (502, "HA Ha hA ha!", "xx", None),
                   (503, "to be or not to be; " * 40, "de", None), (503, "to be or not to be; " * 40, "de", None), (504, "...", "yy", None)]


@pytest.mark.parametrize("least,top", [(2, 2000), (5, 7)])
def test_phrases_equal_brute_force(spark, monkeypatch, least, top):
    for name, value in (("BLOCK", 3000), ("TILE", 4), ("DENSE", 256), ("SPLIT", 500)):
        monkeypatch.setattr(phrases, name, value)
    rows = phrase_rows()
    got = phrases.mine(frame(spark, rows).repartition(3), least=least, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, least, top)


def test_phrases_of_nothing(spark):
    assert phrases.mine(frame(spark, phrase_rows()).limit(0)).count() == 0


def test_cells_round_trip():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 1 << 30, 4000), rng.integers(0, 1 << 26, 4000)
    x[:1000], y[500:2000] = x[:1000] % 5000, y[500:2000] % 5000
    tile, cell = phrases.cells(x, y)
    for t in np.unique(tile):
        a, b = phrases.ids_of(int(t), cell[tile == t])
        assert (a == x[tile == t]).all() and (b == y[tile == t]).all()
    values = np.sort(rng.choice(1 << 40, 100, replace=False))
    assert (phrases.unpack_sorted(phrases.pack_sorted(values), 100) == values).all()
    assert len(phrases.unpack(phrases.pack(values[:0]), 0)) == 0
