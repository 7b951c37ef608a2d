"""Store of data sets and models, and the gate before it."""
import pytest
from pyspark.sql import functions as F

from rankloom.config import RETAIL_CONFIG
from rankloom.plans import intake
from rankloom.plans import requests as rq
from rankloom.plans.pipeline import prepare_retail
from rankloom.plans.store import StaleDataset, Store
from rankloom.sources import fixtures as fx


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def publish(store, spark, n):
    folder = store.folder("datasets")
    store.write(folder, {"ratings": spark.range(n)})
    store.publish(folder)
    return folder


def test_switch_drops_models_and_evaluation(store, spark):
    assert store.current() is None and store.dataset() == {} and store.models() == {} and store.evaluation() is None
    first = publish(store, spark, 3)
    store.save_models(first, {"cf_items": spark.range(5)})
    store.save_weights(first, (0.2, 0.3, 0.5), 0.05)
    store.save_evaluation(first, spark.range(2))
    again = Store(spark, store.root)  # another session
    assert again.models()["cf_items"].count() == 5 and again.evaluation().count() == 2
    assert again.current()["weights"] == {"weights": [0.2, 0.3, 0.5], "ctx_alpha": 0.05}
    second = publish(again, spark, 4)
    assert store.dataset()["ratings"].count() == 4
    assert store.models() == {} and store.evaluation() is None and store.current()["weights"] is None
    with pytest.raises(StaleDataset):  # fitted meanwhile on the old data
        store.save_models(first, {"cf_items": spark.range(5)})
    assert store.models() == {} and store.current()["dataset"] == second
    assert store.current(4)["evaluation"] and store.versions() == [1, 2, 3, 4, 5]


def test_interrupted_switch_leaves_the_old_data(store, spark, monkeypatch):
    first = publish(store, spark, 3)
    store.save_models(first, {"cf_items": spark.range(5)})
    folder = store.folder("datasets")
    store.write(folder, {"ratings": spark.range(9)})  # and the driver is lost before publish()
    assert store.dataset()["ratings"].count() == 3 and store.models()["cf_items"].count() == 5
    # two writers of the same version: the later one fails and changes nothing
    monkeypatch.setattr(store, "versions", lambda: [1])
    with pytest.raises(RuntimeError, match="another writer"):
        store.publish(folder)
    assert Store(spark, store.root).dataset()["ratings"].count() == 3


def test_stored_models_rank_like_fitted_ones(store, spark, sf):
    from rankloom.operators import svd
    p = prepare_retail(spark, sf)
    model = svd.fit(p.train, n_factors=4)
    data = publish(store, spark, 1)
    store.save_models(data, rq.scorer_tables(p) | rq.svd_tables(model))
    users = p.train.select("user_idx").distinct()
    seen = p.train.groupBy("user_idx").agg(F.collect_set("item_idx").alias("seen"))
    contexts = users.join(seen, "user_idx").select(F.col("user_idx").alias("qid"), "user_idx", "seen",
                                                   F.lit(None).cast("array<double>").alias("vec"), F.lit(10).alias("n_cf"))
    got = rq.rank_contexts(contexts, {"cf": rq.scorers_of(store.models())["cf"]})
    rows = lambda df, u: sorted((r[u], r["rank"], r.item_idx) for r in df.collect())
    assert rows(got, "qid") == rows(svd.topn(model, p.train, n=10), "user_idx")


def test_bad_upload_leaves_no_table(store, spark, sf, tmp_path):
    ratings, items = fx.retail_ratings_text(spark, sf, dirty=True), fx.retail_items(spark, sf, RETAIL_CONFIG, dirty=True)
    report, version = intake.gated_ingest(ratings, items, RETAIL_CONFIG, store)
    assert version is None and store.current() is None and not list((tmp_path / "store").glob("datasets/*"))
    found = {(r.section, r.name): r.value for r in report.collect()}
    assert found["verdict", "valid"] == 0 and found["error", "rating_non_numeric"] > 0
    assert not any(section == "first_bad" for section, _ in found)
    report, version = intake.gated_ingest(ratings.drop("rating"), items, RETAIL_CONFIG, store)
    assert version is None and report.where("section = 'error'").count() == 1
    clean = fx.retail_ratings_text(spark, sf, dirty=False)
    _, version = intake.gated_ingest(clean, fx.retail_items(spark, sf, RETAIL_CONFIG), RETAIL_CONFIG, store)
    assert version == 1 and store.dataset()["ratings"].count() == clean.count()
    report, version = intake.gated_ingest(clean.limit(0), items, RETAIL_CONFIG, store)
    assert version == 2 and {r.name: r.value for r in report.where("section = 'warning'").collect()}["few_rows"] == 1
