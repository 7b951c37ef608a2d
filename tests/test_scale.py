"""What a job sends through the driver stays small, whatever the tables' size."""
from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

from rankloom import session
from rankloom.functions import blocks
from rankloom.operators import context, fusion, neural
from rankloom.plans import pipeline
from rankloom.plans import requests as rq


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_small_files_of_many_rows_are_not_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_ROWS", 1000, raising=False)
    rows = spark.range(20000).select((F.col("id") % 5000).alias("user_idx"), (F.col("id") % 900).alias("item_idx"))
    for n, sent in ((900, True), (5000, False)):
        flags = spark.range(n).select(F.col("id").alias("item_idx"), F.lit("w_old").alias("feature"))
        kept = pipeline._write_read(flags, str(tmp_path / f"flags{n}"))
        joined = rows.join(kept.select("feature", "item_idx").where("feature = 'w_old'"), "item_idx")
        assert ("Broadcast" in _plan(joined)) == sent
        assert joined.count() == 20000


def test_dense_users_negatives_are_not_made_by_the_driver(spark):
    n = 20000
    seen = spark.range(n - 5).select(F.lit(0).cast("long").alias("user_idx"), F.col("id").alias("item_idx"))
    few = spark.createDataFrame([(1, 3), (1, 4), (None, 7)], "user_idx long, item_idx long")
    got = neural.negative_sample(seen.unionByName(few), n)
    assert len(_plan(got)) < 100_000
    rows = {(r.user_idx, r.item_idx) for r in got.collect()}
    assert {i for u, i in rows if u == 0} == set(range(n - 5, n))
    assert len([1 for u, _ in rows if u == 1]) == 8 and not {(1, 3), (1, 4)} & rows


def _side(spark, n, ties):
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) for x in rng.integers(0, 2, 3)], float(rng.integers(0, ties)) / 8) for i in range(n)]
    return spark.createDataFrame(rows, "item_idx long, vec array<double>, bias double")


def _asked(spark, n_items, most):
    rng = np.random.default_rng(3)
    rows = [(q, [float(x) for x in rng.random(3)] if q % 7 else None, float(q % 3), int(rng.integers(0, most + 1)),
             [int(x) for x in rng.integers(0, n_items + 5, int(rng.integers(0, 30)))] if q % 5 else None) for q in range(300)]
    rows.append((300, [1.0, 0.0, 0.0], 0.0, most, list(range(0, n_items, 2))))   # more seen items than heads hold
    return spark.createDataFrame(rows, "qid long, vec array<double>, off double, n int, seen array<long>")


def test_heads_give_the_lists_of_the_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "HEAD", (64,), raising=False)
    asked = _asked(spark, 3000, 12)
    for ties in (4, 400):   # few biases: an item left out of the heads may tie with any of them
        held = blocks.item_blocks(_side(spark, 3000, ties))
        got = sorted(map(tuple, blocks.blocked_topn(asked, held, 12).collect()))
        assert blocks.item_heads(held, 12)[1] < 1500   # the last query's lists come from the blocks
        with monkeypatch.context() as m:
            m.setattr(blocks, "item_heads", lambda *_: None)
            assert got == sorted(map(tuple, blocks.blocked_topn(asked, held, 12).collect()))


def _lists_and_candidates(spark, monkeypatch):
    monkeypatch.setattr(blocks, "HEAD", (64,), raising=False)
    queries, cands, heads = None, None, {}
    for k, m in enumerate("abc"):
        held = blocks.item_blocks(_side(spark, 2000 + k, 300))
        asked = _asked(spark, 2000, 25).withColumn("n", F.lit(25))
        heads[m] = blocks.item_heads(held, 25)
        one = blocks.blocked_topn(asked, held, 25).select(F.lit(m).alias("model"), F.col("qid").alias("user_idx"), "item_idx", "score")
        cands = one if cands is None else cands.unionByName(one)
        side = asked.select("qid", "seen", *(F.col(c).alias(f"{c}_{m}") for c in ("vec", "off", "n")))
        queries = side if queries is None else queries.join(side.drop("seen"), "qid")
    return queries, cands, heads


def test_lists_are_fused_as_candidates_are(spark, monkeypatch):
    queries, cands, heads = _lists_and_candidates(spark, monkeypatch)
    ctx = spark.range(1500).select(F.col("id").alias("item_idx"), (F.col("id") % 7 / 10).alias("ctx"))
    rounded = lambda df: sorted((*r[:3], round(r[3], 9)) for r in df.collect())
    normed, rest = fusion.minmax_of_lists(queries, heads)
    assert [r.qid for r in rest.collect()] == [300]   # left to the candidates
    assert "Window" not in _plan(normed)
    some = cands.where("user_idx < 300")
    assert rounded(normed) == rounded(fusion.minmax(some).select("model", "user_idx", "item_idx", "norm"))
    got, _ = fusion.fused_topn_of_lists(queries, heads, (0.3, 0.3, 0.4), 8, blocks.head_values(ctx, "ctx", heads), 0.15)
    assert rounded(got) == rounded(fusion.fused_topn(some, list("abc"), (0.3, 0.3, 0.4), 8, ctx, 0.15))
    relevant = some.where("item_idx % 3 = 0").select("user_idx", "item_idx").distinct()
    wanted = relevant.groupBy(F.col("user_idx").alias("qid")).agg(F.collect_set("item_idx").alias("rel"))
    grid = fusion.weight_grid()
    sums, _ = fusion.grid_of_lists(queries.join(wanted, "qid"), heads, blocks.head_values(ctx, "ctx", heads), 10, grid)
    n = relevant.select("user_idx").distinct().count()
    means = {r.combo_no: r.ndcg for r in fusion.grid_means(sums, F.lit(n), grid).collect()}
    expected = {r.combo_no: r.ndcg for r in fusion.grid_search(some, list("abc"), relevant, ctx).collect()}
    assert len(means) == 198 and all(abs(means[c] - v) < 1e-9 for c, v in expected.items())


def test_a_request_keeps_its_columns_beside_its_list(spark, monkeypatch):
    queries, cands, heads = _lists_and_candidates(spark, monkeypatch)
    asked = queries.select("seen", "vec_a", "off_a", "n_a", F.col("qid").alias("user_idx"), (F.col("qid") % 4).alias("rn"))
    got, rest = blocks.topn_of_lists(asked, "a", heads["a"], "user_idx long, rn long", dealt=True)
    assert rest.count() == 1
    rows = sorted((r.user_idx, r.item_idx) for r in got.where("rn = user_idx % 4 and rank <= 25").collect())
    assert rows == sorted((r.user_idx, r.item_idx) for r in cands.where("model = 'a' and user_idx < 300").collect())
    assert "monotonically_increasing_id" not in _plan(got)


def test_a_rows_context_score_is_found_by_its_items_features(spark):
    items = spark.createDataFrame([(i,) for i in range(9)], "item_idx long")
    features = spark.createDataFrame([(i, f"f{i % 3}") for i in range(8)], "item_idx long, feature string")
    train = spark.createDataFrame([(i % 9, float(1 + i * 7 % 5), i % 4, i % 3) for i in range(200)],
                                  "item_idx long, rating double, hour int, day_of_week int")
    rows = spark.createDataFrame([(r, r % 10, r % 5, r % 3) for r in range(60)], "id long, item_idx long, hour int, dow int")
    p = SimpleNamespace(items=items, features=features, train=train)
    every = context.context_scores(items, features, train, [(h, d) for h in range(5) for d in range(3)])
    for how in ("left", "inner"):
        got = rq.with_context_bias(rows, p, rows, how)
        expected = rows.join(every, ["item_idx", "hour", "dow"], how)
        columns = ["id", "item_idx", "hour", "dow", "ctx"]
        assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, expected.select(columns).collect()))
