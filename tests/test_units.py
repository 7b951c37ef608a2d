"""Hand-computed cases, properties and file formats."""
import gzip
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom import config as C
from rankloom.functions.columns import hour_of, interaction_weight, month0_of, weekday_of
from rankloom.operators import ingest, prepare, validate
from rankloom.sources import files


def _write(tmp_path, name, text, encoding="utf-8"):
    p = tmp_path / name
    p.write_bytes(text.encode(encoding))
    return str(p)


def test_sample_template_weights(spark, tmp_path):
    path = _write(tmp_path, "ratings.csv", files.SAMPLE_RATINGS_CSV)
    df = files.read_upload_csv(spark, path)
    w = [r[0] for r in df.orderBy("row_no").select(interaction_weight(df.columns)).collect()]
    assert w == pytest.approx(
        [1.0 + 0.3 + 0.5 + 0.5 * 95 / 300, 1.0 + 0.3 + 0.5 * 12 / 300, 1.0 + 0.3 + 1.7 + 0.5 * 60 / 300,
         1.0 + 0.3 + 1.7 + 0.5])


def test_max_weight_is_four_and_a_half(spark):
    df = spark.createDataFrame([("1", "1", "1", "1", "1", "900")],
                               "clicked string, liked string, wishlist string, "
                               "add_to_cart string, ordered string, view_time_sec string")
    assert df.select(interaction_weight(df.columns)).first()[0] == pytest.approx(4.5)


def test_feature_coercion_truncates(spark):
    df = spark.createDataFrame([(0.5,), (1.7,), (-0.3,), (None,), (1.0,)], "v double")
    got = [r[0] for r in df.select(ingest.coerce_feature(F.col("v"))).collect()]
    assert got == [0, 1, 0, 0, 1]


def test_temporal_features_monday_zero(spark):
    # 2024-01-01 was a Monday; 1719800000 = 2024-07-01 02:13:20 UTC (a Monday)
    df = spark.createDataFrame([(1704067200,), (1719800000,), (1704067200 + 6 * 86400 + 3600 * 23,)],
                               "ts long")
    rows = df.select(hour_of("ts"), weekday_of("ts"), month0_of("ts")).collect()
    assert [tuple(r) for r in rows] == [(0, 0, 0), (2, 0, 6), (23, 6, 0)]


def test_validation_report_and_gate(spark, tmp_path):
    bad = (files.SAMPLE_RATINGS_CSV
           + "3,101,oops,1719840000,-5,1,2,0,1\n"
           + "3,102,,1719850000,10,0,0,0,1\n"
           + "ana,t-01,4.0,1650000000,95,1,0,1,0\n")
    r = files.read_upload_csv(spark, _write(tmp_path, "r.csv", bad))
    i = files.read_upload_csv(spark, _write(tmp_path, "i.csv", files.SAMPLE_ITEMS_CSV),
                              row_numbers=False)
    cfg = C.DatasetConfig.from_json(files.SAMPLE_CONFIG_JSON)
    rep = validate.report(r.drop("row_no"), i, cfg, row_no=None)
    msgs = [x["message"] for x in rep.orderBy("ord").collect()]
    assert "ratings.rating: 1 blank cells" in msgs
    assert any("are not numbers" in m for m in msgs)
    assert any("add_to_cart: only 0 and 1 count as signals, got [2]" in m for m in msgs)
    assert any("below zero" in m for m in msgs)
    assert any("1 rows repeat a user, item and time" in m for m in msgs)
    assert any("7 rows are few" in m for m in msgs)
    with pytest.raises(ValueError) as e:
        validate.gate(rep)
    assert " | " in str(e.value)
    first = validate.first_bad_row(r, "row_no").first()
    assert first["rating_first_bad"] == 4     # the empty cell (row 5) comes after 'oops' (row 4)


def test_clean_sample_is_valid(spark, tmp_path):
    r = files.read_upload_csv(spark, _write(tmp_path, "r.csv", files.SAMPLE_RATINGS_CSV))
    i = files.read_upload_csv(spark, _write(tmp_path, "i.csv", files.SAMPLE_ITEMS_CSV),
                              row_numbers=False)
    cfg = C.DatasetConfig.from_json(files.SAMPLE_CONFIG_JSON)
    rep = validate.report(r.drop("row_no"), i, cfg)
    assert validate.is_valid(rep)
    assert validate.gate(rep) == ["ratings: 4 rows are few to learn from"]


def test_missing_columns_stop_rating_checks(spark):
    r = spark.createDataFrame([("1", "2")], "user_id string, item_id string")
    i = spark.createDataFrame([("2", "x")], "item_id string, title string")
    cfg = C.DatasetConfig(dataset_name="d", feature_cols=["A"])
    msgs = [x["message"] for x in validate.report(r, i, cfg).collect()]
    assert any("absent columns ['rating', 'timestamp']" in m for m in msgs)
    assert any("no column 'name'" in m for m in msgs)
    assert any("absent feature columns ['A']" in m for m in msgs)


def test_config_requires_fields(spark, tmp_path):
    p = _write(tmp_path, "c.json", files.SAMPLE_CONFIG_JSON)
    cfg = files.read_config(spark, p)
    assert cfg.item_name_col == "title" and cfg.rating_threshold == 3.5
    with pytest.raises(ValueError):
        C.DatasetConfig.from_dict({"dataset_name": "x"})
    assert C.DatasetConfig.from_dict({"dataset_name": "x", "feature_cols": []}).item_label == "item"


def test_tab_and_pipe_readers(spark, tmp_path):
    tsv = "".join(f"{u}\t{i}\t{(u + i) % 5 + 1}\t{881250949 + u}\n" for u in range(1, 6)
                  for i in range(1, 3))
    r = files.read_tab_ratings(spark, _write(tmp_path, "u.data", tsv))
    assert r.count() == 10 and dict(r.dtypes)["rating"] == "double"
    genres = "|".join(["0"] * 18 + ["1"])
    items = f"1|Café Society (1995)|01-Jan-1995||http://x|{genres}\n"
    it = files.read_pipe_items(spark, _write(tmp_path, "u.item", items, "latin-1"))
    row = it.first()
    assert row["title"] == "Café Society (1995)" and row["Western"] == 1
    users = files.read_pipe_users(spark, _write(tmp_path, "u.user", "1|24|M|technician|85711\n"))
    assert users.first()["age"] == 24


def test_json_lines_preparation(spark, tmp_path):
    reviews = [
        {"reviewerID": "A", "asin": "p1", "overall": 5.0, "unixReviewTime": 10, "verified": True},
        {"reviewerID": "A", "asin": "p2", "overall": 4.0, "unixReviewTime": 11},
        {"reviewerID": "B", "asin": "p1", "unixReviewTime": 12},          # missing overall
        {"reviewerID": "B", "asin": "p2", "overall": 3.0, "unixReviewTime": 13, "verified": False},
        {"reviewerID": "A", "asin": "p1", "overall": 1.0, "unixReviewTime": 10},  # repeated key
    ]
    lines = [json.dumps(r) for r in reviews]
    lines.insert(2, "{not json")
    rpath = tmp_path / "reviews.json.gz"
    with gzip.open(rpath, "wt") as f:
        f.write("\n".join(lines) + "\n")
    meta = [
        {"asin": "p1", "title": "  Old title ", "category": ["Root", "Audio", " Cables ", "x"]},
        {"asin": "p2", "title": "", "categories": [["Root", "Audio", "Video"]]},
        {"asin": "p1", "title": "New title", "category": ["Root", "Audio", "Cables"]},
        {"asin": "p9", "title": "unrated", "category": ["Root", "Other"]},
    ]
    mpath = tmp_path / "meta.json.gz"
    with gzip.open(mpath, "wt") as f:
        f.write("\n".join(json.dumps(m) for m in meta) + "\n")
    ratings, items, cfg = prepare.prepare_from_files(spark, str(rpath), str(mpath), "Soft_ware")
    got = sorted((r.user_id, r.item_id, r.rating, r.ordered) for r in ratings.collect())
    assert got == [("A", "p1", 5.0, 1), ("A", "p2", 4.0, 0), ("B", "p2", 3.0, 0)]
    assert cfg["dataset_name"] == "amazon-soft-ware"
    assert cfg["feature_cols"] == ["Audio", "Cables", "Video"]
    rows = {r.item_id: r.asDict() for r in items.collect()}
    assert rows["p1"]["product_name"] == "New title" and rows["p2"]["product_name"] == "p2"
    assert (rows["p1"]["Cables"], rows["p2"]["Video"], rows["p1"]["Video"]) == (1, 1, 0)


def test_category_sanitising():
    assert prepare.sanitize_category("Musical_Instruments!") == "Musical_Instruments"
    assert prepare.sanitize_category("Électronique-é") == "Électroniqueé"
    assert prepare.dataset_slug("Luxury_Beauty") == "amazon-luxury-beauty"


def test_schema_table_and_fusion_params(spark):
    assert spark.sparkContext and files.schema_table(spark).count() == 19
    p = files.read_fusion_params(files.fusion_params(spark, (0.3, 0.3, 0.4), None)).first()
    assert p["ctx_alpha"] == 0.15


def test_weight_grid_enumeration():
    from rankloom.operators.fusion import weight_grid
    g = weight_grid()
    assert len(g) == 198
    assert g[0][1:] == (0.0, 0.0, 1.0, 0.0) and g[-1][1:] == (1.0, 0.0, 0.0, 0.15)
    assert all(math.isclose(w1 + w2 + w3, 1.0) for _, w1, w2, w3, _ in g)


def test_processed_tables_and_runs(spark, tmp_path):
    root = str(tmp_path / "runs")
    run = files.new_run(root, "demo")
    items = spark.createDataFrame([(1, "a")], "item_id long, title string")
    files.write_processed({"items": items, "ratings": spark.range(3)}, run)
    assert files.latest_run(spark, root, "demo") == files.latest_run(spark, root, "demo")
    got = files.read_processed(spark, files.latest_run(spark, root, "demo"))
    assert "name" in got["items"].columns and got["ratings"].count() == 3
    assert files.latest_run(spark, root, "other") is None


def test_neural_weights_roundtrip(spark):
    from rankloom.operators import neural
    p = neural.init_params(5, 7, seed=1)
    back = files.neural_params_from_table(files.neural_weights_table(spark, p))
    assert set(back) == set(p)
    for k in p:
        assert back[k].shape == p[k].shape and np.allclose(back[k], p[k])


def test_empty_results_table(spark, tmp_path):
    df = files.load_table_or_empty(spark, str(tmp_path / "missing"), "model string, value double")
    assert df.count() == 0 and df.columns == ["model", "value"]


def test_row_numbers_follow_files_and_text_features_are_reported(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    n = 0
    for k, rows in enumerate((10, 4990, 100)):
        lines = "".join(f"u,{n + j},4,1,\"say \"\"hi\"\"\"\n" for j in range(rows))
        (folder / f"part-{k}.csv").write_text("user_id,item_id,rating,timestamp,note\n" + lines)
        n += rows
    got = files.read_upload_csv(spark, str(folder))
    assert got.where("row_no <> cast(item_id as bigint)").count() == 0 and got.count() == n
    assert got.first()["note"] == 'say "hi"'
    items = spark.createDataFrame([("1", "x"), ("2", "1"), ("3", None), ("4", "n/a")], "item_id string, A string")
    cfg = C.DatasetConfig(dataset_name="d", feature_cols=["A"])
    bad = validate.feature_non_binary(files.null_tokens(items), cfg).first()
    assert (bad["feature"], bad["n"]) == ("A", 1)


def test_normalise_takes_time_in_proportion_to_the_vector(spark):
    import time

    from rankloom.functions.columns import ema_step
    n = 4000
    a, b = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (i + F.col("id")) * 1.0), F.array_repeat(F.lit(2.0), n)
    rows = spark.range(24).repartition(4)
    begun = time.time()
    got = rows.select("id", ema_step(a, b, F.lit(0.25)).alias("v")).orderBy("id").collect()
    assert time.time() - begun < 20
    for r in got[::7]:
        want = 0.75 * (np.arange(1, n + 1) + r.id) + 0.5
        assert np.allclose(r.v, want / np.sqrt((want * want).sum()))
    odd = rows.limit(1).select(ema_step(F.array(F.lit(0.0)), F.array(F.lit(0.0)), F.lit(0.5)).alias("z"),
                               ema_step(F.lit(None).cast("array<double>"), b, F.lit(0.5)).alias("none")).first()
    assert odd.z == [0.0] and odd.none is None


def test_grid_search_orders_as_a_full_sort_does(spark):
    """NDCG of every setting equals one read from whole sorted lists, with ties at the k-th place."""
    from rankloom.operators import fusion as hy
    rng = np.random.default_rng(3)
    rows = [(m, u, int(i), float(rng.integers(0, 4))) for m in "abc" for u in range(6) for i in rng.permutation(40)[:1 + 4 * u]]
    rel = [(u, int(i)) for u in range(7) for i in rng.permutation(40)[:9]]
    cands = spark.createDataFrame(rows, "model string, user_idx long, item_idx long, score double")
    relevant = spark.createDataFrame(rel, "user_idx long, item_idx long")
    got = {r.combo_no: r.ndcg for r in hy.grid_search(cands, list("abc"), relevant, None, k=10).collect()}
    norms = {}
    for m in "abc":
        for u in range(6):
            mine = {i: s for mm, uu, i, s in rows if (mm, uu) == (m, u)}
            lo, hi = min(mine.values()), max(mine.values())
            for i, s in mine.items():
                norms.setdefault(u, {}).setdefault(i, {})[m] = 0.5 if hi == lo else (s - lo) / (hi - lo)
    for combo, w1, w2, w3, _ in hy.weight_grid(alphas=[0.0]):
        total = 0.0
        for u, items in norms.items():
            best = sorted(items, key=lambda i: (-round(w1 * items[i].get("a", 0) + w2 * items[i].get("b", 0) + w3 * items[i].get("c", 0), 9), i))[:10]
            liked = {i for uu, i in rel if uu == u}
            total += sum(1 / np.log2(k + 2) for k, i in enumerate(best) if i in liked) / sum(1 / np.log2(k + 2) for k in range(min(len(liked), 10)))
        assert abs(got[combo] - total / 7) < 1e-9


def test_odd_upload_rows_join_the_orders_once(spark, tmp_path):
    import datetime
    from pyspark.sql import functions as F
    from rankloom.plans import catalog
    from rankloom.sources import fixtures as fx
    keys = [1, 2, 97, 101, 109, 97 * 101, 97 * 109, 101 * 109, 97 * 101 * 109, None]
    lines = [(k, 5, n, 12.0, 0.09, "O", "N", datetime.datetime(2020, 1, 2)) for k in keys for n in (1, 1, 2)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber long, l_quantity double, l_discount double, "
                          "l_linestatus string, l_returnflag string, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, 7) for k in keys], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    text = fx.retail_ratings_text(spark, str(tmp_path))
    whole, odd = catalog.review_lines(spark, str(tmp_path))
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join Inner")
    assert [joins(df) for df in (text, whole, odd)] == [1, 1, 1]
    known = [k for k in keys if k]
    assert {r._key: r["count"] for r in text.groupBy("_key").count().collect()} == {k: 3 * (2 if k % 109 == 0 else 1) for k in known}
    r = fx.retail_ratings(spark, str(tmp_path))
    line = lambda item, rating: F.to_json(F.struct(F.col("user_id").cast("string").alias("reviewerID"), item.alias("asin"), rating.alias("overall"),
                                                   F.col("timestamp").alias("unixReviewTime"), (F.col("ordered") == 1).alias("verified")))
    item, rating = F.col("item_id").cast("string"), F.col("rating")
    want = (r.where("_key % 97 = 0").select(F.substring(line(item, rating), 1, 25).alias("value"))
            .unionByName(r.where("_key % 101 = 0").select(line(F.lit(None).cast("string"), rating).alias("value")))
            .unionByName(r.where("_key % 109 = 0").select(line(item, rating + 7).alias("value"))))
    assert sorted(x.value for x in odd.collect()) == sorted(x.value for x in want.collect()) and whole.count() == 3 * len(known)
