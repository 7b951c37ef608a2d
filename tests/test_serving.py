"""Block-wise top-n, request tables and resumable streams."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.functions import blocks
from rankloom.plans import catalog as cat
from rankloom.plans import requests as rq
from rankloom.plans.pipeline import prepare_retail
from rankloom.sources import fixtures as fx
from rankloom.streaming import jobs as st


@pytest.mark.parametrize("width", [0, 3])
def test_blocked_topn_equals_brute_force(spark, monkeypatch, width):
    for name, value in (("ITEMS", 7), ("QUERIES", 5), ("MATRIX", 3)):
        monkeypatch.setattr(blocks, name, value)
    rng = np.random.default_rng(4)
    items = [(int(i), rng.integers(-2, 3, width).astype(float).tolist() if width and i % 5 else None, float(rng.integers(0, 4)))
             for i in rng.permutation(40)]
    queries = [(q, rng.integers(-2, 3, width).astype(float).tolist() if width and q % 4 else None, float(q % 3), int(rng.integers(0, 12)),
                [int(x) for x in rng.choice(45, rng.integers(0, 40))] if q % 3 else None) for q in range(23)]
    queries.append((99, None, 0.0, 50, list(range(40))))
    side = spark.createDataFrame(items, "item_idx long, vec array<double>, bias double")
    asked = spark.createDataFrame(queries, "qid long, vec array<double>, off double, n int, seen array<long>")
    got = sorted((r.qid, r["rank"], r.item_idx, round(r.score, 9)) for r in
                 blocks.blocked_topn(asked, blocks.item_blocks(side), 12).collect())
    want = []
    for q, v, off, n, seen in queries:
        scored = [(-(off + b + (float(np.dot(v, w)) if v and w else 0.0)), i) for i, w, b in items if i not in (seen or [])]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(sorted(scored)[:min(n, 12)], 1)]
    assert got == sorted(want)
    assert blocks.blocked_topn(asked.limit(0), blocks.item_blocks(side), 12).count() == 0
    assert blocks.blocked_topn(asked, blocks.item_blocks(side.limit(0)), 12).count() == 0


@pytest.mark.parametrize("width", [0, 3])
def test_blocked_topn_by_norm_equals_brute_force(spark, monkeypatch, width):
    """As above, with items that lie by norm, as those of many vectors do."""
    monkeypatch.setattr(blocks, "VECTORS", 0)
    test_blocked_topn_equals_brute_force(spark, monkeypatch, width)


def test_few_vectors_send_each_query_to_few_blocks(spark, monkeypatch):
    """Of 60 blocks, whose largest norms rule none out, a query meets those of its nearest vectors; hot ones in shares."""
    for name, value in (("ITEMS", 16), ("QUERIES", 8), ("MATRIX", 4), ("NEAREST", 3), ("SHARE", 5)):
        monkeypatch.setattr(blocks, name, value)
    unit = np.eye(12)
    items = [(i, unit[i % 12].tolist(), 0.001 * (i % 7)) for i in range(960)]
    # a repeated item, of which a seen one hides a copy at most
    items += [(3, unit[3].tolist(), 0.006)] * 2
    queries = [(q, (unit[q % 12] + 0.1 * unit[0]).tolist(), 0.5, 5, [q % 12, q % 12 + 12, 10**6]) for q in range(70)]
    side = spark.createDataFrame(items, "item_idx long, vec array<double>, bias double")
    asked = spark.createDataFrame(queries, "qid long, vec array<double>, off double, n int, seen array<long>")
    held = blocks.item_blocks(side)
    assert held.count() == 61
    steps = blocks._Steps([r.asDict() for r in held.collect()])
    _, needed = steps.route(np.array([v for _, v, *_ in queries]), np.full(len(queries), 5 + 3 * 3))
    assert needed.sum(axis=1).max() <= 7
    got = {}
    for r in blocks.blocked_topn(asked, held, 5).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.item_idx, round(r.score, 9)))
    for q, v, off, n, seen in queries:
        if q % 12 == 3:   # the repeated item
            continue
        best = sorted((-round(off + float(np.dot(v, w)) + b, 9), i) for i, w, b in items if i not in seen)[:n]
        assert got[q] == [(i, -s) for s, i in best]
    assert all(len(v) == 5 for v in got.values()) and len(got) == 70


def test_requests_follow_their_own_settings(spark, sf):
    p = prepare_retail(spark, sf)
    user, item = p.serve_train.select("user_idx", "item_idx").first()
    rows = [(1, user, "cbf", 50, 3, 1, False, None, None, None), (2, user, "cbf", 50, 3, 1, True, None, None, None),
            (3, user, "cbf", 50, 3, 1, False, item, 5.0, 4.0), (4, user, "hybrid", 5, 3, 1, True, None, None, None),
            (5, user, "hybrid", 9, 20, 6, True, None, None, None), (6, 10**9, "ncf", 2, 0, 0, True, 10**9, 3.0, 1.0)]
    asked = spark.createDataFrame(rows, "request_id long, user_idx long, model string, n long, hour int, dow int, exclude_seen boolean, "
                                        "b_item long, b_rating double, b_engagement double")
    out = {}
    for r in rq.recommend(asked, p, rq.scorers(p)).orderBy("request_id", "rank").collect():
        out.setdefault(r.request_id, []).append((r.item_idx, r.score))
    seen = {r.item_idx for r in p.serve_train.where(F.col("user_idx") == user).select("item_idx").collect()}
    got = {k: [i for i, _ in v] for k, v in out.items()}
    assert [len(got[k]) for k in (1, 2, 4, 5, 6)] == [50, 50, 5, 9, 2]
    assert seen & set(got[1]) and not seen & set(got[2]) and not seen & set(got[4])
    assert item not in got[3] and out[3] != [x for x in out[1] if x[0] != item][:50]
    assert rq.recommend(asked.limit(0), p, rq.scorers(p)).count() == 0


def test_stream_resumes_after_a_lost_driver(spark, sf, tmp_path):
    """A job stopped in its third batch, after that batch was half written, ends like one that never stopped."""
    days = str(tmp_path / "events")
    fx.table(spark, sf, "events").withColumn("part", F.col("event_id") % 4).repartition("part").write.partitionBy("part").parquet(days)
    vecs, base = cat.stream_statics(spark, sf)
    updates = lambda: st.profile_stream(fx.event_stream(spark, days, max_files=1), vecs, base, cat.N_FEAT)
    rank = lambda batch: batch.select("user_id", F.posexplode("consumed").alias("rank", "item_id"), "n_events",
                                      F.transform("profile", lambda x: F.round(x, 9)).alias("profile"))
    rows = lambda df: sorted((r.user_id, r["rank"], r.item_id, r.n_events, tuple(r.profile)) for r in df.collect())
    calls = []

    def dying(batch):
        calls.append(1)
        if len(calls) == 4:  # the first call is for the schema
            rank(batch).limit(3).write.parquet(st.job_folder(spark, "t-stop") + "/table/_batch=2")
            raise RuntimeError("lost")
        return rank(batch)

    with pytest.raises(Exception, match="lost"):
        st.run_rerank(updates(), dying, "t-stop", ["user_id"])
    again = rows(st.run_rerank(updates(), rank, "t-stop", ["user_id"]))
    assert again == rows(st.run_rerank(updates(), rank, "t-whole", ["user_id"]))
    assert rows(st.run_rerank(updates(), rank, "t-stop", ["user_id"])) == again  # nothing new to read
    done = fx.event_interactions(spark, sf).select("user_id", "item_id").distinct()
    assert {x[:1] + x[2:3] for x in again} == {tuple(r) for r in done.collect()}


def test_seen_pairs_count_once_over_batches(spark, sf, tmp_path):
    days = str(tmp_path / "events")
    ev = fx.table(spark, sf, "events")
    ev.unionByName(ev.limit(50)).withColumn("part", F.col("event_id") % 3).repartition("part").write.partitionBy("part").parquet(days)
    out = st.run_seen(st.seen_stream(fx.event_stream(spark, days, max_files=1)), "t-seen")
    want = fx.event_interactions(spark, sf).select("user_id", "item_id").distinct()
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
