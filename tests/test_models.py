"""Scorer properties: SVD against numpy, rankings, fusion, metrics, neural, streaming."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankloom.plans import catalog as cat
from rankloom.plans.pipeline import prepare_retail


def test_svd_matches_numpy(spark, sf):
    from rankloom.operators import collaborative as cf
    from rankloom.operators import svd
    p = prepare_retail(spark, sf)
    cells = cf.residual_cells(p.train).toPandas()
    users = sorted(cells.user_idx.unique())
    n_items = int(p.train.agg(F.max("item_idx")).first()[0]) + 1
    r = np.zeros((len(users), n_items))
    pos = {u: k for k, u in enumerate(users)}
    for u, i, v in cells[["user_idx", "item_idx", "residual"]].itertuples(index=False):
        r[pos[u], i] = v
    k = min(50, min(len(users), p.train.select("item_idx").distinct().count()) - 1)
    uu, s, vt = np.linalg.svd(r, full_matrices=False)
    expect = (uu[:, :k] * s[:k]) @ vt[:k]
    model = svd.fit(p.train)
    assert np.allclose(model.sigma, s[:k], atol=1e-8)
    uf = {row.user_idx: np.asarray(row.uf) for row in model.user_factors.collect()}
    vf = {row.item_idx: np.asarray(row.vf) for row in model.item_factors.collect()}
    for u in users[:20]:
        for i in list(vf)[:50]:
            assert uf[u] @ vf[i] == pytest.approx(expect[pos[u], i], abs=1e-8)


def test_svd_of_a_wide_catalogue_matches_numpy(spark):
    """More than 4,000 items: same method, scores and top 10 as a dense SVD."""
    from rankloom.operators import svd
    rng = np.random.default_rng(5)
    n_users, n_items, k = 300, 4500, 10
    r = np.where(rng.random((n_users, n_items)) < 0.02, rng.standard_normal((n_users, n_items)), 0.0)
    rows = spark.createDataFrame([(u, np.flatnonzero(x).tolist(), x[x != 0].tolist()) for u, x in enumerate(r)],
                                 "user_idx long, items array<long>, vals array<double>")
    v, sigma = svd.truncated_svd(rows, n_users, n_items, k)
    uu, s, vt = np.linalg.svd(r, full_matrices=False)
    assert np.allclose(sigma, s[:k], rtol=1e-8)
    expect, got = (uu[:, :k] * s[:k]) @ vt[:k], (r @ v) @ v.T
    assert np.abs(expect - got).max() < 1e-3 * np.abs(expect).max()
    best = lambda x: np.argsort(-np.round(x, 4), axis=1, kind="stable")[:, :10]
    same = [len(set(a) & set(b)) for a, b in zip(best(expect), best(got))]
    assert np.mean(same) > 9.95


def test_rankings_exclude_seen_and_are_dense(spark, sf):
    p = prepare_retail(spark, sf)
    for df in (cat.q_bias_topn(spark, sf), cat.q_content_topn(spark, sf),
               cat.q_svd_topn(spark, sf)):
        assert df.join(p.train.select("user_idx", "item_idx"), ["user_idx", "item_idx"],
                       "left_semi").count() == 0
        ranks = df.groupBy("user_idx").agg(F.max("rank").alias("m"), F.count("*").alias("c"))
        assert ranks.where(F.col("m") != F.col("c")).count() == 0


def test_minmax_in_unit_range(spark, sf):
    df = cat.q_minmax_scores(spark, sf)
    row = df.agg(F.min("norm"), F.max("norm")).first()
    assert 0.0 <= row[0] and row[1] <= 1.0


def test_metrics_in_unit_range(spark, sf):
    res = cat.q_evaluate_models(spark, sf).collect()
    assert res and all(0.0 <= r["value"] <= 1.0 for r in res)


def test_split_roles_cover_all_in_time_order(spark, sf):
    p = prepare_retail(spark, sf)
    assert p.ratings.where(F.col("role").isNull()).count() == 0
    w = p.ratings.groupBy("user_idx", "role").agg(F.min("rn").alias("lo"), F.max("rn").alias("hi"))
    pdf = w.toPandas()
    order = {"train": 0, "val": 1, "test": 2}
    for _, g in pdf.groupby("user_idx"):
        g = g.sort_values("role", key=lambda s: s.map(order))
        assert (g["lo"].to_numpy()[1:] > g["hi"].to_numpy()[:-1]).all()


def test_neural_training_and_shapley(spark, sf):
    hist = cat.q_neural_training(spark, sf).orderBy("epoch").toPandas()
    assert hist["train_loss"].iloc[-1] < hist["train_loss"].iloc[0]
    pred = cat.q_neural_predict(spark, sf).agg(F.min("ncf_score"), F.max("ncf_score")).first()
    assert 0.0 <= pred[0] and pred[1] <= 1.0
    a = cat.q_neural_attribution(spark, sf).toPandas()
    phi = a[["phi_user", "phi_item", "phi_hour", "phi_dow", "phi_month"]].sum(axis=1)
    assert np.allclose(phi, a["prediction"] - a["base_value"], atol=1e-5)


def test_stream_equals_batch_replay(spark, sf, tmp_path):
    """One file per day, several micro-batch cuttings, same final profiles."""
    from rankloom.sources import fixtures as fx
    from rankloom.streaming import jobs as st
    ev = fx.table(spark, sf, "events")
    days = tmp_path / "events"
    ev.withColumn("day", F.to_date("ts")).repartition("day").write.partitionBy("day") \
        .parquet(str(days))
    vecs, base = cat.stream_statics(spark, sf)
    results = []
    for max_files in (1, 7, None):
        stream = fx.event_stream(spark, str(days), max_files=max_files)
        ups = st.profile_stream(stream, vecs, base, cat.N_FEAT)
        out = st.run_to_table(ups, ["user_id"], f"t09-{max_files}")
        results.append({r.user_id: np.asarray(r.profile) for r in out.collect()})
    inter = st.interactions(fx.table(spark, sf, "events")).toPandas()
    local = st.replay_profiles_local(
        inter, {r.item_id: np.asarray(r.vec) for r in vecs.collect()},
        {r.user_id: np.asarray(r.base) for r in base.collect()}, cat.N_FEAT)
    for res in results:
        assert set(res) == set(local)
        for u, prof in res.items():
            assert np.allclose(prof, local[u], atol=1e-9)


def test_svd_factors_need_no_arrow(spark, sf):
    """The item side is built without Arrow, as in a session that doesn't enable it."""
    from rankloom.operators import svd
    from rankloom.plans.pipeline import prepare_retail
    key = "spark.sql.execution.arrow.pyspark.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        model = svd.fit(prepare_retail(spark, sf).train, n_factors=3)
        assert len(model.item_factors.first()["vf"]) == 3
    finally:
        spark.conf.set(key, was)


def test_svd_has_no_item_ceiling(spark, sf, monkeypatch):
    """A catalogue of several item blocks is fitted and ranked alike."""
    from rankloom.functions import blocks
    from rankloom.operators import svd
    train = prepare_retail(spark, sf).train
    rows = lambda df: sorted((r.user_idx, r["rank"], r.item_idx) for r in df.collect())
    whole = svd.fit(train, n_factors=5)
    expect = rows(svd.topn(whole, train, n=10))
    monkeypatch.setattr(blocks, "ITEMS", 16)
    monkeypatch.setattr(svd, "ITEM_BLOCK", 16, raising=False)
    model = svd.fit(train, n_factors=5)
    assert np.allclose(model.sigma, whole.sigma, rtol=1e-8)
    assert rows(svd.topn(model, train, n=10)) == expect


def test_tuning_takes_all_validation_users(spark, monkeypatch):
    from types import SimpleNamespace
    from rankloom.plans import training as tr
    val = spark.range(400).select(F.col("id").alias("user_idx"), F.lit(1).cast("long").alias("item_idx"),
                                  F.lit(5.0).alias("rating"))
    p = SimpleNamespace(val=val, train=None, items=None, features=None)
    monkeypatch.setattr(tr, "candidates", lambda p, models, users, seen: users)
    monkeypatch.setattr(tr.ctxm, "context_scores", lambda *a: None)
    monkeypatch.setattr(tr.hy, "grid_search", lambda cands, models, rel, ctx, k: (cands.count(), rel.count()))
    assert tr.tune(p, None) == (400, 400)
    assert tr.tune(p, None, n_users=7) == (7, 7)


def test_explanations_at_the_asked_time(spark):
    from types import SimpleNamespace

    from rankloom.operators import explain as ex
    from rankloom.operators import neural as ncf
    model = SimpleNamespace(params=ncf.init_params(5, 6))
    rows = [(1, 2, 3, 4, 5), (1, 2, 20, 0, 11), (4, 0, 3, 4, 5), (1, 2, 3, 4, 5), (4, 0, None, None, None)]
    requests = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "request_id long, user_idx long, item_idx long, hour int, dow int, mon int")
    asked = ex.with_context(requests).select("user_idx", "item_idx", *ex.CONTEXT).distinct()
    got = {tuple(r)[:5]: r.ncf_score for r in ncf.predict_pairs(model, asked).collect()}
    assert len(got) == 4 and (4, 0, 12, 2, 5) in got
    for (u, i, hour, dow, mon), score in got.items():
        one = spark.createDataFrame([(u, i)], "user_idx long, item_idx long")
        assert abs(ncf.predict_pairs(model, one, hour, dow, mon).first().ncf_score - score) < 1e-6
    from pyspark.sql import functions as F
    raw = ncf.predict_pairs(model, asked).withColumnRenamed("ncf_score", "ncf_raw").withColumns({"cf_raw": F.lit(0.5), "cbf_raw": F.lit(0.25)})
    items = spark.createDataFrame([(i, f"i{i}", f"n{i}") for i in range(6)], "item_idx long, item_id string, name string")
    features = spark.createDataFrame([(i, i % 2, "ab"[i % 2]) for i in range(6)], "item_idx long, feature_pos int, feature string")
    history = spark.createDataFrame([(1, 4, 5.0, 1), (4, 2, 5.0, 1)], "user_idx long, item_idx long, rating double, rn long")
    out = {r.request_id: r for r in ex.explain_requests(requests, raw, (0.3, 0.3, 0.4), history, items, features, "part").collect()}
    assert len(out) == len(rows)
    assert out[0].ncf_raw != out[1].ncf_raw and out[0].ncf_raw == out[3].ncf_raw
    assert all(out[0][k] == out[1][k] for k in ("cf_raw", "cbf_raw", "feature_match", "similar_liked"))
    assert out[0].sentence.startswith("Picked for you") and all(r.sentence for r in out.values())


def test_negative_draws_keep_their_partitions(spark):
    from rankloom.operators import neural
    train = spark.createDataFrame([(u, i) for u in range(40) for i in range(u % 7 + 1)], "user_idx long, item_idx long")
    neg = neural.negative_sample(train, 50)
    # few rows before the draws, many after: AQE may not fold the exchange into one task
    assert "REPARTITION_BY_NUM" in neg._jdf.queryExecution().executedPlan().toString()
    rows = [tuple(r) for r in neg.collect()]
    assert len(set(rows)) == len(rows) == sum(4 * (u % 7 + 1) for u in range(40))
    assert all(u % 7 < i < 50 for u, i in rows)


def _uploaded(spark):
    """Ratings of 40 users of 1 to 40 rows, with repeated times, null ids and rows that come twice."""
    rows = [(u, (u * 7 + k * 3) % 25, float(1 + k % 5), 1000 + k // 3, float(k), k % 2) for u in range(1, 41) for k in range(u)]
    rows += [r for r in rows if r[0] % 6 == 0] + [(None, 3, 4.0, 5, 1.0, 1), (7, None, 4.0, 5, 1.0, 1), (99, None, 2.0, 5, 1.0, 0)]
    return spark.createDataFrame(rows, "user_id long, item_id long, rating double, timestamp long, view_time_sec double, liked int")


def test_split_by_join_equals_the_split_over_many_tasks(spark):
    from rankloom.operators import ingest, split
    ratings = _uploaded(spark)
    users, items = ingest.encode_ids(ratings)
    users, items = users.cache(), items.cache()
    cols = ["user_id", "item_id", "rating", "timestamp", "user_idx", "item_idx", "n", "rn", "role", "serve_role"]
    want = split.split_roles(ingest.index_ratings(ratings, users.drop("_n"), items)).select(cols)
    for hot_rows in (split.HOT_ROWS, 20):   # 20: half of the users go over many tasks
        got = split.index_and_split(ratings, users, items, hot_rows).select(cols)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert users.where("user_id = 99").first()["_n"] == 0 and users.count() == 41


def test_ingest_checkpoints_no_ratings(spark, tmp_path, monkeypatch):
    from rankloom.config import DatasetConfig
    from rankloom.plans import pipeline
    ratings = _uploaded(spark)
    items = spark.createDataFrame([(i, f"item {i}", i % 2) for i in range(25)], "item_id long, name string, a int")
    kept, plain = [], type(ratings).checkpoint
    monkeypatch.setattr(type(ratings), "checkpoint", lambda self, eager=True: (kept.append(self.columns), plain(self, eager))[1])
    p = pipeline.ingest_tables(spark, ratings, items, DatasetConfig("x", ["a"]), str(tmp_path))
    assert kept and not any("rating" in columns for columns in kept)
    assert p.user_map.columns == ["user_id", "user_idx"] and p.ratings.count() == ratings.dropna(subset=["user_id", "item_id"]).count()


def test_similar_liked_deals_overlaps_once(spark):
    """A user's liked items by shared features, then history order; counts and ranks share one exchange by pair."""
    from rankloom.operators import explain as ex
    features = spark.createDataFrame([(i, k, f"f{k}") for i in range(12) for k in range(4) if (i >> k) & 1], "item_idx long, feature_pos int, feature string")
    items = spark.createDataFrame([(i, f"item {i}") for i in range(12)], "item_idx long, name string")
    liked = spark.createDataFrame([(u, i, n) for u in (1, 2) for n, i in enumerate([3, 5, 3, 7, 11, 0, u])], "user_idx long, liked_idx long, rn long")
    pairs = spark.createDataFrame([(1, 3), (1, 7), (2, 11), (2, 0), (3, 1), (1, 3)], "user_idx long, item_idx long")
    found = ex.similar_liked(pairs, liked, items, features)
    want = []
    for u, i in {(r.user_idx, r.item_idx) for r in pairs.collect()}:
        got = [(-bin(i & r.liked_idx).count("1"), r.rn, r.liked_idx) for r in liked.collect() if r.user_idx == u and r.liked_idx != i and i & r.liked_idx]
        want += [(u, i, pos, at, f"item {at}", -n) for pos, (n, _, at) in enumerate(sorted(got)[:3], 1)]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    by_pair = [line for line in plan.splitlines() if "Exchange hashpartitioning(user_idx" in line and ", item_idx" in line]
    assert sum("liked_idx" in line.split("ENSURE")[0] for line in by_pair) == 0, by_pair


def test_sentence_deals_top_features_as_plain_rows(spark):
    from rankloom.operators import explain as ex
    contrib = spark.createDataFrame([(1, 5, 0.2, 0.5, 0.3), (2, 5, 0.6, 0.2, 0.2)],
                                    "user_idx long, item_idx long, cf_contribution double, cbf_contribution double, ncf_contribution double")
    fm = spark.createDataFrame([(1, 5, 0, "red", 0.5), (1, 5, 1, "hot", 0.5), (1, 5, 2, "old", 0.1), (2, 5, 0, "red", 0.1)],
                               "user_idx long, item_idx long, feature_pos int, feature string, share double")
    sim = spark.createDataFrame([(2, 5, 1, "rod")], "user_idx long, item_idx long, pos long, liked_name string")
    found = ex.sentence(contrib, fm, sim, "part")
    assert {r.user_idx: r.sentence for r in found.collect()} == {
        1: "Picked for you: it has red, which you often pick among parts; its attributes fit your part history.",
        2: "Picked for you: it resembles 'rod' from your history; people who rate as you do gave it high marks."}
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].splitlines()
    at = [k for k, line in enumerate(plan) if "partial_max_by" in line]
    assert at and not any("Exchange" in plan[k - 1] for k in at)
