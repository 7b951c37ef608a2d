"""Operators against brute force, round trips and held-out accuracy; odd rows everywhere."""
import collections
import hashlib
import math
import time
import zlib

import numpy as np
import pytest

from rankloom.llm import chat, crf, decontaminate, html_main, katz, langid, mixing, ngram_join, queries, rules, suffix_dedup
from rankloom.llm.components import components
from rankloom.llm.scratch import Scratch

LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, size string"


def words(text, lower=True):
    raw = (text or "").encode()
    return (raw.translate(LOW) if lower else raw).split()


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, repeated rows and ids, null lang and source, a very long line, clashing names."""
    long = " ".join(f"w{i % 700} x{i}" for i in range(30000))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", None), (4, "one", "en", "a"), (5, "One two  three", None, "a"),
            (5, "One two  three", None, "a"), (6, "one TWO three", "fr", "b"), (7, long, "en", "a"), (8, long, "en", None),
            (9, "§ " * 90 + "é" * 120, "xx", "b"), (10, "a b c d e f g", "en", "c"), (5, "other words under one id", "de", "c")]
    return spark.createDataFrame([(i, t, la, s, len(t or ""), 0.5, "x") for i, t, la, s in rows], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# op1
def test_chat_round_trip(spark):
    turns = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "[\\INST] <\\/s> [[/INST]"), (2, 0, None, None), (2, 0, "assistant", ""),
             (3, 5, "[INST]odd</s>", "plain"), (3, 6, "assistant", "<s>" * 3 + "é\\"), (3, 6, "assistant", "again"), (4, None, "user", "[IN" + "ST]")]
    df = spark.createDataFrame([(*t, "z") for t in turns], "conv_id bigint, turn bigint, role string, text string, formatted string")
    out = {r.conv_id: r for r in chat.format_conversations(df).withColumn("turns", chat.parse(chat.F.col("formatted"))).collect()}
    for conv, r in out.items():
        want = sorted(((-1 if t is None else t), ro or "", tx or "") for c, t, ro, tx in turns if c == conv)
        assert r.identical and [(x.role, x.text) for x in r.turns] == [(ro, tx) for _, ro, tx in want]
        back = "".join(r.formatted[s.start:s.start + s.length] for s in r.loss_spans)
        assert back.replace("[\\", "[").replace("<\\", "<") == "".join(tx for _, ro, tx in want if ro == "assistant")
    assert chat.format_conversations(df.where("conv_id > 99")).count() == 0


# op2
def brute_repeats(rows):
    seen, out = {}, collections.defaultdict(list)
    for doc, text in sorted((d, t or "") for d, t in rows):
        raw = text.encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            first = seen.setdefault(raw[i:i + 100], (doc, i))
            if first < (doc, i):
                gone[i:i + 100] = b"\1" * 100
        spans = sum(1 for i in range(len(raw)) if gone[i] and (not i or not gone[i - 1]))
        out[doc].append((len(raw), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


def repeats(df):
    out = collections.defaultdict(list)
    for r in suffix_dedup.digest(df).collect():
        out[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    return {k: sorted(v) for k, v in out.items()}


def test_cover_is_a_difference_cover():
    got = {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER}
    assert got == set(range(suffix_dedup.PERIOD)) and suffix_dedup.SAMPLE + suffix_dedup.PERIOD - 1 == suffix_dedup.WINDOW


def test_suffix_dedup_equals_brute_force(spark, documents, odd, empty):
    assert repeats(documents) == brute_repeats([(r.doc_id, r.text) for r in documents.collect()])
    rng = np.random.default_rng(1)
    base = "".join(rng.choice(list("abé "), 900))
    rows = [(1, base), (2, "zz" + base[100:400] + "y" + base[250:420]), (3, base[500:] + base[:300]), (4, "ab" * 300), (5, base[:99]), (6, base[:100]), (7, base)]
    small = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert repeats(small) == brute_repeats(rows)
    short = odd.where("doc_id <> 5")
    assert repeats(short) == brute_repeats([(r.doc_id, r.text) for r in short.collect()])
    assert suffix_dedup.digest(empty).count() == 0
    kept = {r.doc_id: r for r in suffix_dedup.without_repeats(short).collect()}
    assert set(kept) == {1, 2, 3, 4, 6, 7, 9, 10} and kept[7].size == "x" and len(kept[9].text) < 210


# op3
def brute_components(rows):
    sets = {}
    for i, (d, t) in enumerate(rows):
        w = words(t)
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


def test_ngram_join_equals_brute_force(spark, documents, odd, empty, monkeypatch):
    for df in (documents, odd):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        assert sorted(tuple(r) for r in ngram_join.join_documents(df).collect()) == brute_components(rows)
    rng = np.random.default_rng(5)
    base = [f"t{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        w = list(base)
        for k in rng.choice(120, rng.integers(1, 5), replace=False):
            w[k] = f"n{i}_{k}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(ngram_join, "PART", 5)  # many salted parts
    monkeypatch.setattr(ngram_join, "GROUP", 7)
    monkeypatch.setattr(ngram_join, "MOST_FREQUENT", 9)  # most repeated shingles count as rare
    monkeypatch.setattr(ngram_join, "BUCKET", 1000)
    assert sorted(tuple(r) for r in ngram_join.join_documents(df).collect()) == brute_components(rows)
    assert ngram_join.join_documents(empty).count() == 0
    one = sorted((r.doc_id, r.text) for r in ngram_join.keep_one(odd.where("text is not null")).collect())
    assert [d for d, _ in one] == [2, 3, 4, 5, 5, 7, 9, 10]


def test_document_frequencies_are_exact(spark, empty, monkeypatch):
    texts = [f"a b c d e f {'x ' * (i % 3)}g{i} h{i // 4} i{i // 4} j{i // 4} k{i // 4} l{i // 4}" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "doc_id bigint, text string")
    want = collections.Counter(s for t in texts for s in {tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)})
    assert sorted(r.n for r in ngram_join.document_frequencies(df.repartition(4), 3).collect()) == sorted(n for n in want.values() if n >= ngram_join.FREQUENT)
    assert ngram_join.document_frequencies(empty, 1).count() == 0
    monkeypatch.setattr(ngram_join, "MOST_FREQUENT", 20)
    keys, docs, _, _ = ngram_join.frequent_shingles(df, Scratch(spark, "t"), 500)
    assert 0 < len(keys) <= 20 and sorted(docs) == sorted(want.values())[-len(docs):]
    for numbers in ([0, 0, 1], [5, 1 << 35, (1 << 36) - 1], [7]):
        assert ngram_join._unpacked(*ngram_join._packed(np.array(numbers, np.uint64))).tolist() == numbers


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(99, 98), (98, 99), (5, 5)], "a bigint, b bigint")
    got = {r.a: r.b for r in components(edges, Scratch(spark, "t"), "c").collect()}
    assert got == {i: 0 for i in range(1, 41)} | {99: 98}


# op4
PAGE = """<html><head><title>t</title></head><body class="has-sidebar"><header><h1>Site</h1></header><div class="cookie-notice">We use</div>
<div id="c"><div class="post-12"><h2>Head &amp; line</h2><p>Para  one <b>bo</b>ld a &lt; b<br>next words follow here<p>Para&nbsp;two <i>x</i></p><script>var a="</p>";</script>
<ul><li>one<li>two</ul><div class="comments"><p>nice!</p></div></div><aside>side</aside></div><footer>f</footer></body></html>"""
TEXT = "Head & line\n\nPara one bold a < b next words follow here\n\nPara two x\n\none\n\ntwo"


def test_main_text(spark):
    pages = [(1, "http://a.example/1", PAGE), (2, "http://a.example/2", PAGE.replace("post-12", "post-7")), (3, None, None), (4, "odd", ""), (5, "http://a.example/3", "just text"),
             (6, "http://b.example/", "<div class='ad'>buy</div>"), (6, "http://b.example/", "<article><p>x</article>")]
    df = spark.createDataFrame([(*p, "q") for p in pages], "page_id bigint, url string, html string, text string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_main.main_text(df).collect())
    assert got == [(1, TEXT, len(TEXT)), (2, TEXT, len(TEXT)), (3, "", 0), (4, "", 0), (5, "just text", 9), (6, "", 0), (6, "x", 1)]
    assert html_main.main_text(df.where("page_id > 9")).count() == 0


# op5
def test_crf_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    unary, trans, d = rng.normal(size=7), rng.normal(size=(2, 2)), np.array([0, 0, 0, 0, 1, 2, 2])
    got, _ = crf.marginals(unary, d, trans)
    for doc in range(3):
        at = np.flatnonzero(d == doc)
        total, good = 0.0, np.zeros(len(at))
        for code in range(2 ** len(at)):
            y = [(code >> k) & 1 for k in range(len(at))]
            p = math.exp(sum(unary[a] * s for a, s in zip(at, y, strict=True)) + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False)))
            total, good = total + p, good + p * np.array(y)
        assert np.allclose(got[at], good / total)


def test_quality_scores(spark, documents, odd, empty):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = crf.score_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    assert crf.score_documents(odd, labels).count() == odd.count() and crf.score_documents(empty, labels).count() == 0
    assert crf.keep_good(odd, labels.limit(0)).columns == odd.columns


# op6
def test_rules_base(spark, documents, odd, empty):
    for df in (documents, odd):
        want = []
        for r in df.collect():
            w, t = words(r.text, False), r.text or ""
            tri = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
            hit = {i + k for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for k in range(3)}
            lines = [x for x in t.split("\n") if words(x, False)]
            want.append((r.doc_id, len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit),
                         len(w) < 50 or 100 * len(hit) > 50 * len(w)))
        got = rules.apply_rules(df).collect()
        assert sorted(tuple(r)[:7] for r in got) == sorted(want)
        assert not any(r.kept and r.base_failed for r in got)
    assert rules.apply_rules(empty).count() == 0


def test_sketch_bins(spark):
    df = spark.range(0, 100000, 7).select("id", rules.sketch_bin(rules.F.col("id")).alias("b")).select("id", "b", rules.bin_top(rules.F.col("b")).alias("top"))
    assert all(r.id <= r.top <= r.id * 33 / 32 + 1 for r in df.collect())


# op7
def test_decontamination(spark, sf, documents, odd, empty):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = {r.item_id: words(r.text) for r in bench.collect()}
    grams = lambda w: {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
    want = set()
    for r in documents.collect():
        have = grams(words(r.text))
        want |= {(r.doc_id, i) for i, w in items.items() if len(grams(w) & have) >= 0.9 * len(grams(w)) > 0}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(documents, bench).collect()}
    assert got >= want and len(got - want) <= 1
    assert decontaminate.clean(documents, bench).count() == documents.count() - len({d for d, _ in got})
    assert decontaminate.contaminated(odd, bench).count() == 0 and decontaminate.clean(empty, bench).count() == 0
    assert decontaminate.contaminated(documents, bench.limit(0)).count() == 0
    some = spark.createDataFrame([(1, None), (2, " "), (3, "Q one two? yes it is so indeed"), (3, "Q one two? yes it is so indeed")], "item_id bigint, text string")
    text = spark.createDataFrame([(7, "x y z " * 50 + "q ONE two? yes it is so indeed" + " k l" * 90)], "doc_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(text, some).collect()} == {(7, 3)}


# op8
def test_language_id(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    got = langid.identify(odd).collect()
    assert len(got) == odd.count() and {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    assert langid.identify(empty).count() == 0


# op9
def test_katz_equals_brute_force_and_sums_to_one(spark, documents, odd, empty):
    for df in (documents, odd):
        rows = [(r.doc_id, [*words(r.text), None]) for r in df.collect()]
        train = [w for d, w in rows if zlib.crc32(str(d).encode()) % 5 != 1]
        uni = collections.Counter(x for w in train for x in w)
        bi = collections.Counter(p for w in train for p in zip(["<s>", *w[:-1]], w, strict=True))
        n, v = sum(uni.values()), len(uni)
        cut = lambda c, f: c * f[c - 1] if c <= katz.CUT else c
        f1, f2 = katz.discounts(collections.Counter(uni.values())), katz.discounts(collections.Counter(bi.values()))
        p1 = {w: cut(c, f1) / n for w, c in uni.items()}
        unseen = 1 - math.fsum(p1.values())
        after = collections.defaultdict(dict)
        for (h, w), c in bi.items():
            after[h][w] = c
        context = {}
        for h, ws in after.items():
            total, kept = sum(ws.values()), sum(cut(c, f2) for c in ws.values())
            base = total if kept < total else total + 1
            context[h] = base, (1 - kept / base) / (1 - sum(p1[w] for w in ws))
        for h in list(after)[:20]:
            base, alpha = context[h]
            mass = sum(cut(c, f2) / base for c in after[h].values()) + alpha * (sum(p for w, p in p1.items() if w not in after[h]) + unseen)
            assert abs(mass - 1) < 1e-9
        want = []
        for d, w in rows:
            base = sum(math.log10((uni[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
            score = 0.0
            for h, x in zip(["<s>", *w[:-1]], w, strict=True):
                score += math.log10(cut(bi[h, x], f2) / context[h][0]) if (h, x) in bi else math.log10(p1.get(x, unseen)) + (math.log10(context[h][1]) if h in context else 0)
            want.append((d, len(w), sum(x in uni for x in w), n, base, score))
        got = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in katz.score_documents(df).collect())
        assert len(got) == len(want)
        for a, b in zip(got, sorted(want), strict=True):
            assert a[:4] == b[:4] and np.allclose(a[4:], b[4:], rtol=1e-9)
    assert katz.score_documents(empty).count() == 0


def test_katz_counts_reach_the_blocks_as_one_row_each(spark):
    words_of = {7: [2**63 + 5, 3, 2**64 - 1], 9: [4, 2**63]}
    asked = [(b, w - 2**64 if w >= 2**63 else w, w % 11) for b, ws in words_of.items() for w in ws]
    counts = katz.packed_counts(spark.createDataFrame(asked, "block bigint, w bigint, n bigint").repartition(3))
    want = {b: [w % 11 for w in sorted(ws)] for b, ws in words_of.items()}
    assert sorted((r.block, katz._unpack(r.n, np.int64).tolist()) for r in counts.collect()) == sorted(want.items())
    table = spark.createDataFrame([(b, [b], [False], b"o", b"v", b"i") for b in words_of], katz.BLOCKS)
    assert {r.block: (r.ids, katz._unpack(r.n, np.int64).tolist()) for r in katz.with_counts(table, counts).collect()} == {b: (b"i", n) for b, n in want.items()}


def test_katz_histories_reach_the_blocks_as_one_row_each(spark):
    docs = spark.createDataFrame([(d, d == 3, f"a b a {d} b") for d in range(6)], "doc_id bigint, held boolean, text string")
    scratch = Scratch(spark, "katz-test")
    model = katz.Model(scratch.table(katz.blocks(docs.repartition(2)), "blocks"), scratch)
    known = {r.w1: (r.base, r.log_alpha) for r in model.histories.collect()}
    told = {r.block: r for r in model.told.collect()}
    rows = model.blocks.collect()
    assert len(told) == len(rows) > 1
    for r in rows:
        want = [known.get(w, (1.0, 0.0)) for w in katz._unpack(r.vocab, np.int64).tolist()]
        assert [*zip(*(katz._unpack(told[r.block][k], np.float64).tolist() for k in ("base", "log_alpha")), strict=True)] == want


def test_katz_packs_numbers_by_their_bytes():
    n = np.random.default_rng(3).geometric(0.001, 20000)
    for x in (n, -n, n.astype(np.int32), n.astype(np.uint64), np.sqrt(n), n[:0], n[:1], n[::2]):
        for planes in (True, False):
            got = katz._unpack(katz._pack(x, planes), x.dtype, planes)
            assert got.dtype == x.dtype and got.tolist() == x.tolist()
    assert len(katz._pack(n.astype(np.int32))) < 0.9 * len(katz._pack(n.astype(np.int32), False))


# op10
def test_mixing(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mix(docs).collect()
    assert sorted(got) == sorted(mixing.mix(docs.repartition(7)).collect())
    source = {r.doc_id: r.source for r in docs.collect()}
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        size[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6 * sum(size.values())
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size))}
    free = [target[s] / weight[s] for s in size if target[s] < 2 * size[s] - 1e-6]
    assert max(free) - min(free) < 1e-6 * max(free) and all(target[s] <= 2 * size[s] + 1e-9 for s in size)
    assert all(min(free) * weight[s] >= 2 * size[s] - 1e-6 for s in size if target[s] > 2 * size[s] - 1e-6)
    assert all(abs(taken[s] - target[s]) <= 0.03 * target[s] for s in size)
    some = mixing.mix(odd).collect()
    assert len(some) == odd.count() and all(r.taken == 0 for r in some if r.doc_id in (1, 2, 3))
    assert mixing.mix(empty).count() == 0


def test_native_plans_run_no_python(spark, sf):
    for name in ("op1_chat_format", "op10_mixing"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_main_text_inside_marked_wrappers():
    body = "<p>" + "some words of the story " * 20 + "</p>"
    text = " ".join(("some words of the story " * 20).split())
    for wrapper in ("class='layout with-sidebar'", "id='page' class='has-comments'"):
        for inner in (f"<article>{body}</article>", f"<main>{body}</main>", f"<div class='body'>{body}</div>"):
            page = f"<html><body><div {wrapper}>{inner}<div class='sidebar'><p>see also this</p></div></div></body></html>"
            assert html_main.extract(page, None) == text
    assert html_main.extract(f"<form id='aspnet'><div>{body}</div></form>", None) == text
    teaser = "<div class='related'><article><p>a short teaser</p></article></div>"
    assert html_main.extract(f"<div class='x'>{body}</div>{teaser}", None) == text


@pytest.mark.parametrize("html", [
    "<a" * 500_000, "<a" * 500_000 + ">", "<a " * 300_000, '<a ">" ' * 100_000, '<a ">' * 200_001, "<a '" * 200_000 + ">", "<!--" * 200_000, "<![x" * 200_000,
    "<div>x" * 50_000, "<span>x" * 50_000, "<b>" * 50_000 + "</i>" * 50_000, "<p><div>" * 30_000, "<div class='comment'>x" * 30_000])
def test_malformed_pages_take_linear_time(html):
    begin = time.process_time()
    html_main.extract(html, None)
    assert time.process_time() - begin < 10


def test_tags_and_deep_paths():
    html = "a<!-- <b> -->x<p class='>'>t</P ><br/><a href=\"o>1 < 2<!DOCTYPE y><i"
    assert [(html[i:j], c, n) for i, j, c, n, _ in html_main.tags(html)] == [
        ("<!-- <b> -->", False, ""), ("<p class='>'>", False, "p"), ("</P >", True, "p"), ("<br/>", False, "br"), ('<a href="o>', False, "a"), ("<!DOCTYPE y>", False, "")]
    deep = "<div class=k>" * 2000
    _, nodes = html_main.read_page(deep + "text " * 50)
    assert len(nodes) == 2001 and max(len(p) for *_, p in nodes) <= html_main.LONG_PATH and len({p for *_, p in nodes}) == 2001
    assert html_main.extract(deep + "text " * 50, [nodes[-1][2]]) == ("text " * 50).strip()


def test_main_text_keeps_a_lead_beside_the_container():
    body = "<p>" + "some words of the story " * 40 + "</p>"
    page = f"<body><div id=w><div class='lead'><p>The lead comes first.</p></div><div class='body'>{body}</div></div><div class='sidebar'><p>aside words</p></div></body>"
    got = html_main.extract(page, None)
    assert got.startswith("The lead comes first.") and got.endswith("of the story") and "aside" not in got


def test_decontamination_of_edited_passages(spark):
    item = [f"w{i}" for i in range(37)]
    edits = {1: (9,), 2: (27,), 3: (9, 10), 4: (26, 28), 5: (3, 9, 15, 21, 27, 33)}
    docs = [(d, " ".join([f"a{k}" for k in range(60)] + ["other" if k in at else w for k, w in enumerate(item)] + [f"b{k}" for k in range(60)])) for d, at in edits.items()]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(f"z{i}" for i in range(30)))], "item_id bigint, text string")
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()} == {(d, 1) for d in (1, 2, 3, 4)}
    assert [r.doc_id for r in decontaminate.clean(df, bench).collect()] == [5]


def test_rules_in_a_source_that_is_half_junk(spark):
    word = lambda d, k: f"word{d}x{k}"
    good = [(d, " ".join(word(d, k) for k in range(60)), "en", "abcd"[d % 4]) for d in range(1200)]
    junk = [(10000 + d, " ".join(word(d, k) + "#" * 6 for k in range(60)), "en", "d") for d in range(300)]
    df = spark.createDataFrame(good + junk, "doc_id bigint, text string, lang string, source string")
    kept = {r.doc_id for r in rules.apply_rules(df).where("kept").collect()}
    assert kept == {d for d, *_ in good}


def rules_by_hand(rows):
    """The verdict of every row of base counts (dicts), with quartiles read from sorted lists of bins."""
    def top(v):
        k = max(v.bit_length() - 6, 0)
        return v if v < 64 else ((v >> k) + 1 << k) - 1

    def figures(some, c, per, scale):
        bins = sorted((top(r[c] * scale // max(r[per], 1)), r["n_words"]) for r in some)
        total = sum(w for _, w in bins)

        def q(percent):
            upto = 0
            for v, w in bins:
                upto += w
                if upto * 100 >= total * percent:
                    return v
        return np.array([q(25), q(25) - q(5), q(75) - q(25)], float)

    judged = [r for r in rows if not r["base_failed"]]
    out = []
    for r in rows:
        ok = not r["base_failed"]
        if ok:
            lang = [x for x in judged if x["lang"] == r["lang"]]
            group = [x for x in lang if x["source"] == r["source"]]
            for c, per, scale, events in rules.METRICS.values():
                groups = collections.defaultdict(list)
                for x in judged:
                    groups[x["lang"], x["source"]].append(x)
                each = {k: figures(g, c, per, scale) for k, g in groups.items()}
                typical = lambda some: np.median([each[x["lang"], x["source"]][1:] for x in some], axis=0)  # noqa: E731, B023
                whole, wide = (np.r_[figures(x, c, per, scale)[0], typical(x)] for x in (judged, lang))
                wide = (len(lang) * wide + rules.PRIOR * whole) / (len(lang) + rules.PRIOR)
                own = (len(group) * each[r["lang"], r["source"]] + rules.PRIOR * wide) / (len(group) + rules.PRIOR)
                rate = r[c] * scale / max(r[per], 1)
                error = rate * (r[events] + 1) ** 0.5 / max(r[events], 1)
                ok &= rate <= own[0] + max(rules.FENCE * max(own[1], min(own[2], wide[2])), rules.NOISE * error)
        out.append((r["doc_id"], ok))
    return sorted(out)


def rules_sample(spark, symbols, lang="en", many_docs=150):
    """Documents of 60 to 99 words; per source a function of the number gives the symbols of each document."""
    rows = []
    for s, (source, many) in enumerate(symbols.items()):
        for d in range(many_docs):
            n = 60 + d * 7 % 40
            signs = iter("#" * many(d))
            rows.append((s * 1000 + d, " ".join(f"word{s}x{d}x{k}" + next(signs, "") for k in range(n)), lang, source))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")


def test_rules_verdict_by_hand(spark, odd):
    df = rules_sample(spark, {"plain": lambda d: 50 * (d % 9 == 0), "code": lambda d: 30 + d % 9, None: lambda d: d % 3}, many_docs=50).unionByName(
        rules_sample(spark, {"plain": lambda d: 3 * (d % 2)}, "de", 40).withColumn("doc_id", rules.F.col("doc_id") + 50000)).unionByName(
        odd.select("doc_id", "text", "lang", "source").where("doc_id <> 7 and doc_id <> 8"))
    failed = (rules.F.col("n_words") < rules.MIN_WORDS) | (100 * rules.F.col("n_repeat_words") > rules.REPEAT_PERCENT * rules.F.col("n_words"))
    base = [r.asDict() for r in rules.base_metrics(df).withColumn("base_failed", failed).collect()]
    got = sorted((r.doc_id, r.kept) for r in rules.apply_rules(df).collect())
    assert got == rules_by_hand(base)


def test_rules_limits_follow_the_source(spark):
    half = lambda d: (60 + d * 7 % 40) // 2
    df = rules_sample(spark, {"plain": lambda d: half(d) * (d % 10 == 0), "code": half})
    kept = {r.doc_id: r.kept for r in rules.apply_rules(df).collect()}
    # the same share of symbols is an outlier in the one source and usual in the other
    assert all(kept[1000 + d] for d in range(150))
    assert all(kept[d] == (d % 10 != 0) for d in range(150))


def mix_by_hand(rows, share=1.5, most=2.0):
    """Words taken of every row (doc_id, source, size, chance), one by one in the Pareto order of each source."""
    sizes = collections.Counter()
    for _, s, n, _ in rows:
        sizes[s] += n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, share * sum(sizes.values()), set(names)
    while True:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > most * sizes[s]}
        target |= {s: most * sizes[s] if s in full else level * weight[s] for s in free}
        if not full or full == free:
            break
        left, free = left - sum(most * sizes[s] for s in full), free - full
    out = {}
    for s in names:
        docs = [(d, n, u) for d, x, n, u in rows if x == s and n]
        copies = int(target[s] // sizes[s]) if sizes[s] else 0
        gap = target[s] - copies * sizes[s]
        cls = {n: math.floor(math.log2(n) * mixing.CLASSES) for _, n, _ in docs}
        certain, rate, rest = set(), 0.0, docs
        for c in sorted(set(cls.values()), reverse=True):
            rest = [x for x in docs if cls[x[1]] <= c]
            mine = [n for _, n, _ in rest if cls[n] == c]
            rate = (gap - sum(n for _, n, _ in docs if cls[n] > c)) / sum(n * n for _, n, _ in rest)
            if rate * sum(mine) <= len(mine) * (1 + 1e-12):
                break
        certain = {d for d, n, _ in docs} - {d for d, n, _ in rest}
        gap -= sum(n for d, n, _ in docs if d in certain)
        odds = lambda p: p / (1 - p)
        line = sorted((odds(u) / max(odds(min(rate * n, mixing.ALMOST)), 1e-300), d, n) for d, n, u in rest)
        chosen = set(certain)
        while True:
            fit, used = [x for x in line if x[2] <= gap and x[1] not in chosen], 0
            for _, d, n in fit:
                if used + n > gap:
                    break
                used += n
                chosen.add(d)
            gap -= used
            if not used:
                break
        out |= {d: (copies + (d in chosen)) * n for d, x, n, _ in rows if x == s}
    return out


def test_mixing_by_hand(spark):
    lengths = [1, 2, 3, 5, 8, 13, 40, 90, 300, 1200]
    rows = [(d, "w " * lengths[(d * d + d // 7) % 10] if d % 31 else None, "en", (None, "a", "b", "c", "b", "b")[d % 6]) for d in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    chance = mixing._chance(mixing.F.col("doc_id"), mixing.F.xxhash64("text"), 20240229)
    bare = [tuple(r) for r in df.select("doc_id", "source", mixing.word_count(mixing.F.col("text")), chance).collect()]
    assert {r.doc_id: r.taken for r in mixing.mix(df).collect()} == mix_by_hand(bare)


def test_mixing_inclusion_in_proportion_to_size(spark):
    df = spark.range(6000).select(mixing.F.col("id").alias("doc_id"), mixing.F.lit("a").alias("source"),
                                  mixing.F.expr("repeat('w ', cast(10 * pow(2, id % 3) as int))").alias("text"))
    got = mixing.mix(df).groupBy("size").agg(mixing.F.avg(mixing.F.col("copies") - 1).alias("rate"), mixing.F.min("copies").alias("least")).collect()
    assert len(got) == 3 and all(r.least == 1 for r in got)
    assert all(abs(r.rate - r.size / 60) < 0.05 for r in got)   # 1.5 times all words: rate 0.5 * 70 / (100 + 400 + 1600)


def test_hashes_keep_small_tables(monkeypatch):
    """Words of a large text hash as they do alone, and no worker keeps tables of a text's length."""
    import numpy as np

    from rankloom.llm import text as tx
    monkeypatch.setattr(tx, "_powers", {})
    rng = np.random.default_rng(5)
    raw = [bytes(rng.integers(97, 123, k).astype(np.uint8)) for k in rng.integers(1, 12, 200_000)] + [b"x" * 300_000]
    buf = np.frombuffer(b" ".join(raw), np.uint8)
    s, e, _ = tx.words(buf, np.array([0, len(buf)]))
    h = tx.hashes(buf, s, e)
    assert sum(v.nbytes for v in tx._powers.values()) <= 8 << 20
    for k in (0, 1, 99_999, 199_999, 200_000):
        assert h[k] == tx.hashes(np.frombuffer(raw[k], np.uint8), np.array([0]), np.array([len(raw[k])]))[0]
