"""Registered jobs: one Spark callable per operator, each with its SQL twin when one exists.

Each job takes ``(spark, sf_dir)`` and returns a DataFrame over the whole input
tables. Integer outputs are ``bigint`` and doubles are rounded to 6 decimals as the
last step on both sides so the two engines can be compared value by value.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import collaborative as cf
from rankloom.operators import ingest, split
from rankloom import config as C
from rankloom.functions import ranking as rk
from rankloom.functions.blocks import blocked_topn, head_values, item_blocks, item_heads, topn_of_lists
from rankloom.oracle import sql
from rankloom.plans import intake
from rankloom.plans import requests as rq
from rankloom.plans.pipeline import prepare_retail
from rankloom.plans.store import Store
from rankloom.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def r6(c):
    return F.round(c, 6)


# ── ingest ──────────────────────────────────────────────────────────────────
@register("encode_users", sql("SELECT user_id, user_idx FROM UM", "UM"))
def q_encode_users(spark, sf):
    return prepare_retail(spark, sf).user_map.select("user_id", "user_idx")


@register("encode_items", sql("SELECT item_id, item_idx FROM IM", "IM"))
def q_encode_items(spark, sf):
    return prepare_retail(spark, sf).item_map.select("item_id", "item_idx")


@register("temporal_features", sql(
    'SELECT user_idx, item_idx, "timestamp", hour, day_of_week, month FROM P', "P"))
def q_temporal_features(spark, sf):
    return prepare_retail(spark, sf).ratings.select(
        "user_idx", "item_idx", "timestamp", "hour", "day_of_week", "month")


@register("positive_label", sql(
    'SELECT user_idx, item_idx, "timestamp", rating, label FROM P', "P"))
def q_positive_label(spark, sf):
    return prepare_retail(spark, sf).ratings.select(
        "user_idx", "item_idx", "timestamp", "rating", "label")


@register("interaction_weight", sql("""
SELECT user_idx, item_idx, "timestamp", round(interaction_weight, 6) AS interaction_weight,
       round(greatest(coalesce(interaction_weight, 1.0), 0.1), 6) AS confidence
FROM P""", "P"))
def q_interaction_weight(spark, sf):
    from rankloom.functions.columns import confidence
    return prepare_retail(spark, sf).ratings.select(
        "user_idx", "item_idx", "timestamp", r6("interaction_weight").alias("interaction_weight"),
        r6(confidence("interaction_weight")).alias("confidence"))


@register("align_items", sql("""
SELECT item_id, item_idx, name FROM ITEMS""", "ITEMS"))
def q_align_items(spark, sf):
    return prepare_retail(spark, sf).items.select("item_id", "item_idx", "name")


@register("item_features", sql("SELECT item_idx, feature_pos, feature FROM IF", "IF"))
def q_item_features(spark, sf):
    return prepare_retail(spark, sf).features.select(
        "item_idx", F.col("feature_pos").cast("int").alias("feature_pos"), "feature")


@register("dataset_summary", sql("""
SELECT CAST(count(*) AS BIGINT) AS n_ratings, CAST(count(DISTINCT user_id) AS BIGINT) AS n_users,
       CAST(count(DISTINCT item_id) AS BIGINT) AS n_items,
       CAST(min(rating) AS DOUBLE) AS rating_min, CAST(max(rating) AS DOUBLE) AS rating_max,
       'liked,add_to_cart,ordered,view_time_sec' AS behavioural_columns
FROM R""", "R"))
def q_dataset_summary(spark, sf):
    from rankloom.sources import fixtures
    return ingest.dataset_summary(fixtures.retail_ratings(spark, sf).drop("_key"))


# ── splits ──────────────────────────────────────────────────────────────────
@register("time_split_roles", sql(
    'SELECT user_idx, item_idx, "timestamp", rn, n, role, serve_role FROM S', "S"))
def q_time_split_roles(spark, sf):
    return prepare_retail(spark, sf).ratings.select(
        "user_idx", "item_idx", "timestamp", "rn", F.col("n").cast("long").alias("n"),
        "role", "serve_role")


@register("seen_pairs", sql("SELECT user_idx, item_idx FROM SEEN", "SEEN"))
def q_seen_pairs(spark, sf):
    return split.seen_pairs(prepare_retail(spark, sf).train)


@register("relevant_pairs", sql(
    "SELECT DISTINCT user_idx, item_idx FROM TE WHERE rating >= 3.5", "TE"))
def q_relevant_pairs(spark, sf):
    return split.relevant_pairs(prepare_retail(spark, sf).test)


@register("user_sample", sql("""
SELECT user_idx FROM (SELECT DISTINCT user_idx FROM VA WHERE rating >= 3.5)
ORDER BY user_idx LIMIT 300""", "VA"))
def q_user_sample(spark, sf):
    return split.first_users(split.relevant_pairs(prepare_retail(spark, sf).val), 300)


# ── collaborative biases ────────────────────────────────────────────────────
@register("global_mean", sql("SELECT round(mu, 6) AS mu FROM MU", "MU"))
def q_global_mean(spark, sf):
    return cf.global_mean(prepare_retail(spark, sf).train).select(r6("mu").alias("mu"))


@register("user_bias", sql("SELECT user_idx, round(user_bias, 6) AS user_bias FROM UB", "UB"))
def q_user_bias(spark, sf):
    return cf.user_bias(prepare_retail(spark, sf).train).select(
        "user_idx", r6("user_bias").alias("user_bias"))


@register("item_bias", sql("SELECT item_idx, round(item_bias, 6) AS item_bias FROM IB", "IB"))
def q_item_bias(spark, sf):
    return cf.item_bias(prepare_retail(spark, sf).train).select(
        "item_idx", r6("item_bias").alias("item_bias"))


@register("popularity_prior", sql(
    "SELECT item_idx, round(pop_prior, 6) AS pop_prior FROM IB", "IB"))
def q_popularity_prior(spark, sf):
    return cf.item_bias(prepare_retail(spark, sf).train).select(
        "item_idx", r6("pop_prior").alias("pop_prior"))


@register("residual_cells", sql("""
SELECT user_idx, item_idx,
       round(sum(rating - (SELECT mu FROM MU) - user_bias - item_bias), 6) AS residual
FROM TR JOIN UB USING (user_idx) JOIN IB USING (item_idx)
GROUP BY user_idx, item_idx""", "TR", "UB", "IB", "MU"))
def q_residual_cells(spark, sf):
    return cf.residual_cells(prepare_retail(spark, sf).train).select(
        "user_idx", "item_idx", r6("residual").alias("residual"))


BIAS_TOPN_SQL = sql(
    "SELECT user_idx, rank, item_idx, round(score, 6) AS score FROM BR WHERE rank <= 10", "BR")


@register("bias_topn", BIAS_TOPN_SQL)
def q_bias_topn(spark, sf):
    return cf.bias_topn(prepare_retail(spark, sf).train, n=10)


# ── content scorer ──────────────────────────────────────────────────────────
from rankloom.operators import content as cbf  # noqa: E402
from rankloom.operators import context as ctxm  # noqa: E402


@register("item_unit_vectors", sql(
    "SELECT item_idx, feature, round(value, 6) AS value FROM IV", "IV"))
def q_item_unit_vectors(spark, sf):
    return cbf.item_unit_vectors(prepare_retail(spark, sf).features).select(
        "item_idx", "feature", r6("value").alias("value"))


@register("item_popularity", sql("SELECT item_idx, round(pop, 6) AS pop FROM IPOP", "IPOP"))
def q_item_popularity(spark, sf):
    p = prepare_retail(spark, sf)
    return cbf.item_popularity(p.items, p.train).select("item_idx", r6("pop").alias("pop"))


@register("user_profile", sql(
    "SELECT user_idx, feature, round(value, 6) AS value FROM PROF", "PROF"))
def q_user_profile(spark, sf):
    p = prepare_retail(spark, sf)
    return cbf.user_profiles(p.train, p.features).select(
        "user_idx", "feature", r6("value").alias("value"))


@register("content_score", sql("""
SELECT t.user_idx, t.item_idx, round(coalesce(COS.cos, 0), 6) AS cbf_score
FROM (SELECT DISTINCT user_idx, item_idx FROM TE) t
LEFT JOIN COS ON COS.user_idx = t.user_idx AND COS.item_idx = t.item_idx""", "TE", "COS"))
def q_content_score(spark, sf):
    p = prepare_retail(spark, sf)
    pairs = p.test.select("user_idx", "item_idx").distinct()
    return cbf.pair_scores(pairs, cbf.user_profiles(p.train, p.features), p.features).select(
        "user_idx", "item_idx", r6("cbf_score").alias("cbf_score"))


CONTENT_TOPN_SQL = sql(
    "SELECT user_idx, rank, item_idx, round(score, 6) AS score FROM CR WHERE rank <= 10", "CR")


@register("content_topn", CONTENT_TOPN_SQL)
def q_content_topn(spark, sf):
    p = prepare_retail(spark, sf)
    return cbf.content_topn(p.train, p.items, p.features, n=10)


# ── context scorer ──────────────────────────────────────────────────────────
@register("hour_dow_bias", sql(
    "SELECT kind, CAST(key AS INTEGER) AS key, round(bias, 6) AS bias FROM GTB", "GTB"))
def q_hour_dow_bias(spark, sf):
    return ctxm.global_time_bias(prepare_retail(spark, sf).train).select(
        "kind", F.col("key").cast("int").alias("key"), r6("bias").alias("bias"))


@register("feature_time_bias", sql(
    "SELECT feature, kind, CAST(key AS INTEGER) AS key, round(bias, 6) AS bias FROM FTB", "FTB"))
def q_feature_time_bias(spark, sf):
    p = prepare_retail(spark, sf)
    return ctxm.feature_time_bias(p.train, p.features).select(
        "feature", "kind", F.col("key").cast("int").alias("key"), r6("bias").alias("bias"))


@register("context_score", sql("SELECT item_idx, round(ctx, 6) AS ctx FROM CTX", "CTX"))
def q_context_score(spark, sf):
    p = prepare_retail(spark, sf)
    return ctxm.context_scores(p.items, p.features, p.train, [(12, 2)]).select(
        "item_idx", r6("ctx").alias("ctx"))


@register("context_rerank", sql("""
SELECT user_idx, CAST(row_number() OVER (PARTITION BY user_idx
                                         ORDER BY round(score, 9) DESC, item_idx) AS BIGINT) AS rank,
       item_idx, round(score, 6) AS score
FROM (SELECT BR.user_idx, BR.item_idx, BR.score + 0.15 * coalesce(CTX.ctx, 0) AS score
      FROM BR LEFT JOIN CTX ON CTX.item_idx = BR.item_idx WHERE BR.rank <= 20)""", "BR", "CTX"))
def q_context_rerank(spark, sf):
    p = prepare_retail(spark, sf)
    base = cf.bias_ranked(p.train, n=20)
    ctx = ctxm.context_scores(p.items, p.features, p.train, [(12, 2)])
    out = ctxm.context_rerank(base.select("user_idx", "item_idx", "score"), ctx, 0.15)
    return out.select("user_idx", F.col("rank").cast("long").alias("rank"), "item_idx",
                      r6("score").alias("score"))


# ── metrics ─────────────────────────────────────────────────────────────────
from rankloom.operators import metrics as km  # noqa: E402


def eval_recs(spark, sf, n=20):
    """Bias and content rankings (list length 20) as one (model, user, rank, item) table."""
    p = prepare_retail(spark, sf)
    bias = cf.bias_ranked(p.train, n=n).select(F.lit("bias").alias("model"), "user_idx",
                                                "rank", "item_idx")
    cont = cbf.content_topn(p.train, p.items, p.features, n=n).select(
        F.lit("content").alias("model"), "user_idx", "rank", "item_idx")
    return bias.unionByName(cont)


def _per_user(spark, sf, model="bias"):
    p = prepare_retail(spark, sf)
    if model == "bias":
        recs = cf.bias_ranked(p.train, n=20).select(F.lit("bias").alias("model"), "user_idx",
                                                     "rank", "item_idx")
    else:
        recs = eval_recs(spark, sf)
    return km.per_user_metrics(recs, split.relevant_pairs(p.test), models=[model])


@register("precision_recall_at_k", sql("""
SELECT user_idx, k, round(precision, 6) AS precision, round(recall, 6) AS recall
FROM PUM WHERE model = 'bias'""", "PUM"))
def q_precision_recall(spark, sf):
    pu = _per_user(spark, sf)
    return pu.select("user_idx", "k", r6("precision").alias("precision"),
                     r6("recall").alias("recall"))


@register("ndcg_at_k", sql(
    "SELECT user_idx, k, round(ndcg, 6) AS ndcg FROM PUM WHERE model = 'bias'", "PUM"))
def q_ndcg(spark, sf):
    return _per_user(spark, sf).select("user_idx", "k", r6("ndcg").alias("ndcg"))


@register("mrr_at_k", sql(
    "SELECT user_idx, k, round(mrr, 6) AS mrr FROM PUM WHERE model = 'bias'", "PUM"))
def q_mrr(spark, sf):
    return _per_user(spark, sf).select("user_idx", "k", r6("mrr").alias("mrr"))


@register("evaluate_models", sql(
    "SELECT model, metric, CAST(k AS INTEGER) AS k, round(value, 6) AS value FROM EVAL", "EVAL"))
def q_evaluate_models(spark, sf):
    p = prepare_retail(spark, sf)
    res = km.evaluate(eval_recs(spark, sf), split.relevant_pairs(p.test),
                      models=["bias", "content"])
    return res.select("model", "metric", "k", r6("value").alias("value"))


@register("model_comparison", sql("""
SELECT model, metric, CAST(k AS INTEGER) AS k, round(value, 6) AS value,
       rank() OVER (PARTITION BY metric, k ORDER BY round(value, 9) DESC) = 1 AS is_best
FROM EVAL""", "EVAL"))
def q_model_comparison(spark, sf):
    p = prepare_retail(spark, sf)
    res = km.evaluate(eval_recs(spark, sf), split.relevant_pairs(p.test),
                      models=["bias", "content"])
    res = res.withColumn("value", F.round("value", 9))
    return km.comparison(res).select("model", "metric", "k", r6("value").alias("value"),
                                     "is_best")


# ── latent factor scorer (rows-only checks; numpy check in tests) ───────────
from rankloom.operators import svd  # noqa: E402

_SVD: dict = {}


def svd_model(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _SVD:
        _SVD[key] = svd.fit(prepare_retail(spark, sf).train)
    return _SVD[key]


@register("svd_predict")
def q_svd_predict(spark, sf):
    p = prepare_retail(spark, sf)
    pairs = p.test.select("user_idx", "item_idx").distinct()
    return svd.predict_pairs(svd_model(spark, sf), pairs).select(
        "user_idx", "item_idx", r6("cf_score").alias("cf_score"))


@register("svd_topn")
def q_svd_topn(spark, sf):
    p = prepare_retail(spark, sf)
    out = svd.topn(svd_model(spark, sf), p.train, n=10)
    return out.select("user_idx", "rank", "item_idx", r6("score").alias("score"))


# ── fusion ──────────────────────────────────────────────────────────────────
from rankloom.operators import fusion as hy  # noqa: E402

FUSION_MODELS = ["bias", "content", "popularity"]


def fusion_candidates(spark, sf, users=None, n_cand=200, seen=None):
    """Top-200 candidates of the three deterministic scorers as one long table."""
    p = prepare_retail(spark, sf)
    b = cf.bias_ranked(p.train, n=n_cand, users=users, seen=seen)
    c = cbf.content_topn(p.train, p.items, p.features, n=n_cand, users=users, seen=seen,
                         raw=True)
    q = cf.popularity_ranked(p.train, n=n_cand, users=users, seen=seen)
    return (b.select(F.lit("bias").alias("model"), "user_idx", "item_idx", "score")
            .unionByName(c.select(F.lit("content").alias("model"), "user_idx", "item_idx",
                                  "score"))
            .unionByName(q.select(F.lit("popularity").alias("model"), "user_idx", "item_idx",
                                  "score")))


def fusion_queries(spark, sf, users=None, n_cand=200):
    """The users of ``fusion_candidates`` with what its three scorers ask for."""
    p = prepare_retail(spark, sf)
    none = F.lit(None).cast("array<double>")
    known = cf.user_bias(p.train).select("user_idx", (cf._mu(p.train) + F.col("user_bias")).alias("off_bias"),
                                         F.lit(n_cand).alias("n_bias"))
    profiles = cbf.dense_profiles(cbf.user_profiles(p.train, p.features), cbf.feature_names(p.features))
    users = (p.train if users is None else users).select("user_idx").distinct()
    return (users.join(known, "user_idx", "left").join(profiles, "user_idx", "left")
            .join(rk.seen_lists(p.train), "user_idx", "left")
            .select(F.col("user_idx").alias("qid"), F.col("_seen").alias("seen"), none.alias("vec_bias"), "off_bias",
                    F.coalesce("n_bias", F.lit(0)).alias("n_bias"), F.col("profile").alias("vec_content"),
                    F.lit(0.0).alias("off_content"), F.lit(n_cand).alias("n_content"), none.alias("vec_popularity"),
                    F.lit(0.0).alias("off_popularity"), F.lit(n_cand).alias("n_popularity")))


def fusion_heads(spark, sf, n_cand=200):
    """``item_heads`` of the three scorers; None if one has none."""
    p = prepare_retail(spark, sf)
    ib = cf.item_bias(p.train)
    sides = {"bias": ib.select("item_idx", F.lit(None).cast("array<double>").alias("vec"),
                               (F.col("item_bias") + F.lit(C.CF_POP_BETA) * F.col("pop_prior")).alias("bias")),
             "content": cbf.content_side(p.train, p.items, p.features, cbf.feature_names(p.features)),
             "popularity": ib.select("item_idx", F.lit(None).cast("array<double>").alias("vec"), F.col("pop_prior").alias("bias"))}
    heads = {m: item_heads(item_blocks(side), n_cand) for m, side in sides.items()}
    return None if None in heads.values() else heads


def _by_lists(spark, sf, users, of_lists, of_candidates, queries=None):
    """``of_lists`` of the users whose lists heads give, with ``of_candidates`` of the others."""
    heads = fusion_heads(spark, sf)
    if heads is None:
        return of_candidates(users)
    out, rest = of_lists(fusion_queries(spark, sf, users) if queries is None else queries, heads)
    return out if rest is None else out.unionByName(of_candidates(rest.select(F.col("qid").alias("user_idx"))))


@register("minmax_scores", sql(
    "SELECT model, user_idx, item_idx, round(norm, 6) AS norm FROM NORMS", "NORMS"))
def q_minmax_scores(spark, sf):
    out = _by_lists(spark, sf, None, lambda queries, heads: hy.minmax_of_lists(queries, heads),
                    lambda users: hy.minmax(fusion_candidates(spark, sf, users)).select("model", "user_idx", "item_idx", "norm"))
    return out.select("model", "user_idx", "item_idx", r6("norm").alias("norm"))


@register("fused_topn", sql("""
SELECT user_idx, rank, item_idx, round(score, 6) AS score FROM (
  SELECT user_idx, item_idx, score,
         CAST(row_number() OVER (PARTITION BY user_idx
                                 ORDER BY round(score, 9) DESC, item_idx) AS BIGINT) AS rank
  FROM (SELECT w.user_idx, w.item_idx,
               CAST(0.3 AS DOUBLE) * coalesce(n_0, 0) + CAST(0.3 AS DOUBLE) * coalesce(n_1, 0)
               + CAST(0.4 AS DOUBLE) * coalesce(n_2, 0)
               + CAST(0.15 AS DOUBLE) * coalesce(CTX.ctx, 0) AS score
        FROM WIDE w LEFT JOIN CTX ON CTX.item_idx = w.item_idx))
WHERE rank <= 10""", "WIDE", "CTX"))
def q_fused_topn(spark, sf):
    p = prepare_retail(spark, sf)
    ctx = ctxm.context_scores(p.items, p.features, p.train, [(12, 2)])
    weights, alpha = (0.3, 0.3, 0.4), 0.15
    out = _by_lists(spark, sf, None, lambda queries, heads: hy.fused_topn_of_lists(
        queries, heads, weights, 10, head_values(ctx, "ctx", heads), alpha),
        lambda users: hy.fused_topn(fusion_candidates(spark, sf, users), FUSION_MODELS, weights, 10, ctx=ctx, alpha=alpha))
    return out.select("user_idx", "rank", "item_idx", r6("score").alias("score"))


_GRID_VALUES = ", ".join(f"({c}, {w1!r}, {w2!r}, {w3!r}, {a!r})"
                         for c, w1, w2, w3, a in hy.weight_grid())


@register("fusion_grid", sql("""
SELECT combo_no, w1, w2, w3, alpha, round(ndcg, 6) AS ndcg FROM (
  SELECT g.combo_no, g.w1, g.w2, g.w3, g.alpha,
         coalesce(sum(u.ndcg), 0) / (SELECT count(*) FROM TU) AS ndcg
  FROM GRID g LEFT JOIN (
    SELECT t.combo_no, t.user_idx,
           sum(CASE WHEN r.item_idx IS NOT NULL THEN 1.0 / log2(t.rank + 1) ELSE 0 END)
             / max(i.idcg) AS ndcg
    FROM (SELECT * FROM (
            SELECT g.combo_no, w.user_idx, w.item_idx,
                   row_number() OVER (PARTITION BY g.combo_no, w.user_idx
                                      ORDER BY round(g.w1 * coalesce(w.n_0, 0) + g.w2 * coalesce(w.n_1, 0)
                                                     + g.w3 * coalesce(w.n_2, 0)
                                                     + g.alpha * coalesce(CTX.ctx, 0), 9) DESC,
                                               w.item_idx) AS rank
            FROM TW w CROSS JOIN GRID g LEFT JOIN CTX ON CTX.item_idx = w.item_idx)
          WHERE rank <= 10) t
    LEFT JOIN VREL r ON r.user_idx = t.user_idx AND r.item_idx = t.item_idx
    JOIN (SELECT user_idx, count(*) AS n FROM VREL GROUP BY user_idx) nr ON nr.user_idx = t.user_idx
    JOIN IDCG i ON i.m = least(nr.n, 10)
    GROUP BY t.combo_no, t.user_idx) u ON u.combo_no = g.combo_no
  GROUP BY g.combo_no, g.w1, g.w2, g.w3, g.alpha)""", "WIDE", "CTX", "VA", "IDCG", extra={
    "VREL": "SELECT DISTINCT user_idx, item_idx FROM VA WHERE rating >= 3.5",
    "TU": "SELECT DISTINCT user_idx FROM VREL",
    "TW": "SELECT * FROM WIDE WHERE user_idx IN (SELECT user_idx FROM TU)",
    "GRID": f"""SELECT CAST(combo_no AS INTEGER) AS combo_no, CAST(w1 AS DOUBLE) AS w1,
                       CAST(w2 AS DOUBLE) AS w2, CAST(w3 AS DOUBLE) AS w3,
                       CAST(alpha AS DOUBLE) AS alpha
                FROM (VALUES {_GRID_VALUES}) AS t(combo_no, w1, w2, w3, alpha)"""}))
def q_fusion_grid(spark, sf):
    p = prepare_retail(spark, sf)
    vrel = split.relevant_pairs(p.val)
    users = vrel.select("user_idx").distinct()
    ctx = ctxm.context_scores(p.items, p.features, p.train, [(12, 2)])
    grid = hy.weight_grid()
    wanted = vrel.groupBy(F.col("user_idx").alias("qid")).agg(F.collect_set("item_idx").alias("rel"))
    sums = _by_lists(spark, sf, users, lambda queries, heads: hy.grid_of_lists(queries, heads, head_values(ctx, "ctx", heads), 10, grid),
                     lambda users: hy.grid_rows(fusion_candidates(spark, sf, users), FUSION_MODELS, vrel, ctx, 10, grid).select("combo_no", "ndcg"),
                     fusion_queries(spark, sf, users).join(wanted, "qid"))
    res = hy.grid_means(sums, hy.relevant_counts(vrel).select(F.count(F.lit(1))).scalar(), grid)
    return res.select("combo_no", "w1", "w2", "w3", "alpha", r6("ndcg").alias("ndcg"))


def _store(spark, name):
    return Store(spark, scratch_path(spark, "stores", f"{name}-{uuid.uuid4().hex[:8]}"))


@register("retune_from_store", ORACLE["fusion_grid"])
def q_retune_from_store(spark, sf):
    """Fit, save, load in a store of one's own, and tune from the loaded models only."""
    p = prepare_retail(spark, sf)
    store = _store(spark, "models")
    data = store.folder("datasets")
    store.write(data, {"ratings": p.ratings, "items": p.items, "item_features": p.features})
    store.publish(data)
    store.save_models(data, rq.scorer_tables(p))
    grid = rq.retune(Store(spark, store.root), p)
    return grid.select("combo_no", "w1", "w2", "w3", "alpha", r6("ndcg").alias("ndcg"))


# ── explanations ────────────────────────────────────────────────────────────
from rankloom.operators import explain as ex  # noqa: E402
from rankloom.plans import serving as sv  # noqa: E402
from rankloom.sources import fixtures as fx  # noqa: E402


def explain_pairs(spark, sf):
    return prepare_retail(spark, sf).test.select("user_idx", "item_idx").distinct()


def deterministic_raw(spark, sf, pairs):
    """E01 raw scores of distinct pairs from deterministic scorers: bias prediction/5, cosine, popularity share."""
    p = prepare_retail(spark, sf)
    mu = cf._mu(p.train)
    ub = cf.user_bias(p.train)
    ib = cf.item_bias(p.train)
    max_pop = ib.select(F.max("pop_prior")).scalar()
    cos = cbf.pair_scores(pairs, cbf.user_profiles(p.train, p.features), p.features)
    j = cos.join(ub, "user_idx", "left").join(ib, "item_idx", "left")
    cf_raw = F.when(F.col("user_bias").isNull() | F.col("item_bias").isNull(), mu).otherwise(
        F.least(F.greatest(mu + F.col("user_bias") + F.col("item_bias"), F.lit(1.0)),
                F.lit(5.0))) / 5.0
    return j.select("user_idx", "item_idx", cf_raw.alias("cf_raw"),
                    F.coalesce("cbf_score", F.lit(0.0)).alias("cbf_raw"),
                    (F.coalesce("pop_prior", F.lit(0.0)) / max_pop).alias("ncf_raw"))


@register("liked_history", sql("SELECT user_idx, liked_idx, rn FROM LK", "LK"))
def q_liked_history(spark, sf):
    return ex.liked_history(prepare_retail(spark, sf).serve_train)


@register("feature_match", sql(
    "SELECT user_idx, item_idx, feature_pos, feature, share FROM FM", "FM"))
def q_feature_match(spark, sf):
    p = prepare_retail(spark, sf)
    out = ex.feature_match(explain_pairs(spark, sf), ex.liked_history(p.serve_train), p.features)
    return out.select("user_idx", "item_idx", F.col("feature_pos").cast("int"), "feature", "share")


@register("similar_liked", sql(
    "SELECT user_idx, item_idx, pos, liked_idx, liked_name, overlap FROM SIM", "SIM"))
def q_similar_liked(spark, sf):
    p = prepare_retail(spark, sf)
    return ex.similar_liked(explain_pairs(spark, sf), ex.liked_history(p.serve_train), p.items,
                            p.features)


@register("model_contributions", sql("""
SELECT user_idx, item_idx, round(cf_raw, 4) AS cf_raw, round(cbf_raw, 4) AS cbf_raw,
       round(ncf_raw, 4) AS ncf_raw, cf_contribution, cbf_contribution, ncf_contribution,
       hybrid_score FROM CON""", "CON"))
def q_model_contributions(spark, sf):
    pairs = explain_pairs(spark, sf)
    c = ex.contributions(deterministic_raw(spark, sf, pairs), (0.3, 0.3, 0.4))
    return c.select("user_idx", "item_idx", F.round("cf_raw", 4).alias("cf_raw"),
                    F.round("cbf_raw", 4).alias("cbf_raw"), F.round("ncf_raw", 4).alias("ncf_raw"),
                    "cf_contribution", "cbf_contribution", "ncf_contribution", "hybrid_score")


@register("contribution_percentages", sql("""
SELECT user_idx, item_idx, model, round(contribution * 100, 6) AS pct FROM CON
UNPIVOT (contribution FOR model IN (cf_contribution AS 'cf', cbf_contribution AS 'cbf',
                                    ncf_contribution AS 'ncf'))""", "CON"))
def q_contribution_percentages(spark, sf):
    """Q13: contribution share × 100, one row per model.

    Display code formats ``pct`` with one decimal; the job returns the number so the
    value does not depend on an engine's half-way rounding of binary doubles.
    """
    pairs = explain_pairs(spark, sf)
    c = ex.contributions(deterministic_raw(spark, sf, pairs), (0.3, 0.3, 0.4))
    return c.select("user_idx", "item_idx", F.inline(F.array(*[
        F.struct(F.lit(m).alias("model"), F.round(F.col(f"{m}_contribution") * 100, 6).alias("pct"))
        for m in ("cf", "cbf", "ncf")])))


@register("explain_sentence", sql("""
SELECT c.user_idx, c.item_idx,
       'Picked for you: ' || concat_ws('; ',
          CASE WHEN tf.top_share > 0.1 THEN 'it has ' || tf.top_feat || ', which you often pick among parts' END,
          CASE WHEN s.liked_name IS NOT NULL
               THEN 'it resembles ''' || s.liked_name || ''' from your history' END,
          CASE WHEN c.cf_contribution >= c.cbf_contribution
                    AND c.cf_contribution >= c.ncf_contribution
               THEN 'people who rate as you do gave it high marks'
               WHEN c.ncf_contribution > c.cbf_contribution
               THEN 'the learned model ranks it near the top for you'
               ELSE 'its attributes fit your part history' END) || '.' AS sentence
FROM CON c
LEFT JOIN (SELECT user_idx, item_idx, max(share) AS top_share,
                  arg_max(feature, CAST(round(share * 10000) AS BIGINT) * 100 - feature_pos)
                    AS top_feat
           FROM FM GROUP BY user_idx, item_idx) tf
  ON tf.user_idx = c.user_idx AND tf.item_idx = c.item_idx
LEFT JOIN SIM s ON s.user_idx = c.user_idx AND s.item_idx = c.item_idx AND s.pos = 1""",
    "CON", "FM", "SIM"))
def q_explain_sentence(spark, sf):
    p = prepare_retail(spark, sf)
    pairs = explain_pairs(spark, sf)
    liked = ex.liked_history(p.serve_train)
    c = ex.contributions(deterministic_raw(spark, sf, pairs), (0.3, 0.3, 0.4))
    fm = ex.feature_match(pairs, liked, p.features)
    sim = ex.similar_liked(pairs, liked, p.items, p.features)
    return ex.sentence(c, fm, sim, p.cfg.item_label)


# ── serving ─────────────────────────────────────────────────────────────────
@register("recommend", sql("""
SELECT r.user_idx, r.rank, r.item_idx, l.item_id, l.name, l.features,
       round(r.score, 6) AS score
FROM CRS r JOIN LOOK l ON l.item_idx = r.item_idx WHERE r.rank <= 10""", "CRS", "LOOK"))
def q_recommend(spark, sf):
    """Q01: model=cbf, n=10, exclude_seen for every user; serving seen set (train+val)."""
    p = prepare_retail(spark, sf)
    ranked = cbf.content_topn(p.train, p.items, p.features, n=10,
                              users=p.serve_train.select("user_idx").distinct()
                              .join(p.train.select("user_idx").distinct(), "user_idx"),
                              seen=p.serve_train)
    out = sv.enrich(ranked, p.items, p.features)
    return out.select("user_idx", "rank", "item_idx", "item_id", "name",
                      F.array_join("features", ", ").alias("features"), "score")


@register("recommend_requests", sql("""
SELECT RQ.request_id, RQ.user_idx, RQ.model, CAST(s.rank AS BIGINT) AS rank, s.item_idx, round(s.score, 6) AS score
FROM RQ JOIN RQS s ON s.request_id = RQ.request_id AND s.model = RQ.model
UNION ALL
SELECT RQ.request_id, RQ.user_idx, RQ.model, CAST(h.rank AS BIGINT), h.item_idx, round(h.score, 6)
FROM RQ JOIN RQH h ON h.request_id = RQ.request_id AND h.rank <= RQ.n""", "RQ", "RQS", "RQH"))
def q_recommend_requests(spark, sf):
    """Q01/Q03: every event as a request with its own model, length, context, exclusion and behaviour."""
    p = prepare_retail(spark, sf)
    out = rq.recommend(rq.event_requests(spark, sf, p), p, rq.scorers(p))
    return out.select("request_id", "user_idx", "model", "rank", "item_idx", r6("score").alias("score"))


@register("request_behavior", sql("""
SELECT RQ.request_id, RQ.b_item, round(RQ.b_engagement, 3) AS engagement_weight,
       round(RQ.b_rating, 2) AS effective_rating, coalesce(RQA.alpha > 0, false) AS applied
FROM RQ LEFT JOIN RQA ON RQA.request_id = RQ.request_id WHERE RQ.b_rating IS NOT NULL""", "RQ", "RQA"))
def q_request_behavior(spark, sf):
    """Q03: what a request's behaviour amounts to, and whether it moved the profile."""
    p = prepare_retail(spark, sf)
    asked = rq.event_requests(spark, sf, p).where(F.col("b_rating").isNotNull())
    return rq.behaviours(asked, p).select(
        "request_id", "b_item", F.round("b_engagement", 3).alias("engagement_weight"),
        F.round("b_rating", 2).alias("effective_rating"), "applied")


def _bound_requests(spark, sf):
    e = fx.table(spark, sf, "events")
    v = F.floor(F.col("value")).cast("int")
    model = (F.when(F.col("event_type") == "click", "cf").when(F.col("event_type") == "view", "cbf")
             .when(F.col("event_type") == "purchase", "ncf")
             .when(F.col("event_type") == "signup", "hybrid").otherwise(F.col("event_type")))
    return e.select("event_id", F.col("user_id").alias("user_idx"), F.pmod(v, F.lit(30)).alias("hour"),
                    F.pmod(v, F.lit(9)).alias("dow"), (F.month("ts") - 1).alias("mon"),
                    v.alias("n"), F.pmod(F.floor(F.col("value") * 3).cast("int"), F.lit(130)).alias("history"),
                    model.alias("model"), (F.col("value") / 20).alias("rating"),
                    (F.col("value") - 40).alias("view_time_sec"))


@register("request_bounds", sql("""
SELECT event_id, reason IS NULL AS valid, reason FROM (
  SELECT event_id, CASE
    WHEN NOT (hour BETWEEN 0 AND 23) THEN 'hour must be 0-23'
    WHEN NOT (dow BETWEEN 0 AND 6) THEN 'dow must be 0-6'
    WHEN NOT (mon BETWEEN 0 AND 11) THEN 'mon must be 0-11'
    WHEN NOT (n BETWEEN 1 AND 50) THEN 'n must be 1-50'
    WHEN NOT (history BETWEEN 1 AND 100) THEN 'history must be 1-100'
    WHEN model NOT IN ('cf', 'cbf', 'ncf', 'hybrid') THEN 'model must be one of cf, cbf, ncf, hybrid'
    WHEN rating IS NOT NULL AND NOT (rating BETWEEN 1.0 AND 5.0) THEN 'rating must be 1-5'
    WHEN view_time_sec < 0 THEN 'view_time_sec must be >= 0' END AS reason
  FROM (SELECT event_id, CAST(floor(value) AS INTEGER) % 30 AS hour,
               CAST(floor(value) AS INTEGER) % 9 AS dow, month(ts) - 1 AS mon,
               CAST(floor(value) AS INTEGER) AS n, CAST(floor(value * 3) AS INTEGER) % 130 AS history,
               CASE event_type WHEN 'click' THEN 'cf' WHEN 'view' THEN 'cbf'
                    WHEN 'purchase' THEN 'ncf' WHEN 'signup' THEN 'hybrid' ELSE event_type END
                 AS model,
               value / 20 AS rating, value - 40 AS view_time_sec FROM events))"""))
def q_request_bounds(spark, sf):
    """Request bounds on a request table derived from the events."""
    return sv.request_bounds(_bound_requests(spark, sf)).select("event_id", "valid", "reason")


@register("engagement_rating", sql("""
SELECT event_id, round(engagement, 6) AS engagement, round(effective_rating, 6) AS effective_rating,
       CASE WHEN rating IS NULL THEN 'inferred' ELSE 'explicit' END AS rating_source
FROM ENG""", "ENG"))
def q_engagement_rating(spark, sf):
    out = sv.engagement(fx.event_interactions(spark, sf))
    return out.select("event_id", r6("engagement").alias("engagement"),
                      r6("effective_rating").alias("effective_rating"),
                      F.when(F.col("rating").isNull(), "inferred").otherwise("explicit")
                      .alias("rating_source"))


def session_requests(p):
    """Every held-out interaction as a "just interacted with" request: its user and place in the history."""
    return p.ratings.where(F.col("role") == "test").select(
        "user_idx", "rn", F.col("item_idx").alias("b_item"), F.col("rating").alias("b_rating"),
        F.col("interaction_weight").alias("b_engagement"), "hour", "day_of_week", "month")


def session_topn(spark, sf, n=5):
    """Content top-n per request from its previewed profile, without seen items and its own."""
    p = prepare_retail(spark, sf)
    none = F.array().cast("array<long>")
    # dealt by user once, in parts that aren't folded: for the profiles, the seen items and the ranking
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = (rq.behaviours(session_requests(p), p).repartition(parts, "user_idx").join(rk.seen_lists(p.serve_train), "user_idx", "left")
             .withColumn("seen", F.concat(F.coalesce("_seen", none), F.array("b_item")))
             .select("user_idx", "rn", "vec", F.lit(0.0).alias("off"), F.lit(n).alias("n"), "seen"))
    blocks = cbf.content_blocks(p.train, p.items, p.features, p.cfg.feature_cols)
    heads, out = item_heads(blocks, n), None
    if heads is not None:
        out, asked = topn_of_lists(asked.withColumnsRenamed({c: f"{c}_cbf" for c in ("vec", "off", "n")}), "cbf", heads,
                                   "user_idx long, rn long", dealt=True)
        asked = None if asked is None else asked.withColumnsRenamed({f"{c}_cbf": c for c in ("vec", "off", "n")})
    if asked is not None:
        asked = asked.withColumn("qid", F.monotonically_increasing_id()).checkpoint()
        found = (blocked_topn(asked.select("qid", "vec", "off", "n", "seen"), blocks, n)
                 .join(asked.select("qid", "user_idx", "rn"), "qid").select("user_idx", "rn", "rank", "item_idx", "score"))
        out = found if out is None else out.unionByName(found)
    return out.select("user_idx", "rn", "rank", "item_idx", r6("score").alias("score"))


@register("ema_preview", sql("SELECT user_idx, rn, feature, round(value, 6) AS value FROM PREV",
                             "PREV"))
def q_ema_preview(spark, sf):
    """The profile as it would be after each held-out interaction."""
    p = prepare_retail(spark, sf)
    names = F.array(*map(F.lit, p.cfg.feature_cols))
    return (rq.behaviours(session_requests(p), p).where("applied")
            .select("user_idx", "rn", F.posexplode("vec").alias("pos", "value")).where(F.col("value") != 0)
            .select("user_idx", "rn", F.element_at(names, F.col("pos") + 1).alias("feature"), r6("value").alias("value")))


@register("session_context_topn", sql(
    "SELECT user_idx, rn, rank, item_idx, round(score, 6) AS score FROM SESS", "SESS"))
def q_session_context_topn(spark, sf):
    return session_topn(spark, sf, 5)


@register("rank_change", sql("""
SELECT a.user_idx, a.rn, a.item_idx FROM SESS a
WHERE NOT EXISTS (
  SELECT 1 FROM CRS b WHERE b.user_idx = a.user_idx AND b.item_idx = a.item_idx AND b.rank <= 5)""",
    "SESS", "CRS"))
def q_rank_change(spark, sf):
    """Q10: items new in a user's top 5 after each session update."""
    p = prepare_retail(spark, sf)
    after = session_topn(spark, sf, 5)
    before = cbf.content_topn(p.train, p.items, p.features, n=5,
                              users=session_requests(p).select("user_idx").distinct(), seen=p.serve_train)
    return sv.rank_change(before, after, 5)


@register("item_lookup", sql("SELECT item_idx, item_id, name, features FROM LOOK", "LOOK"))
def q_item_lookup(spark, sf):
    p = prepare_retail(spark, sf)
    return sv.item_lookup(p.items, p.features).withColumn(
        "features", F.array_join("features", ", "))


@register("user_page", sql("SELECT user_id FROM UM ORDER BY user_id LIMIT 20 OFFSET 20", "UM"))
def q_user_page(spark, sf):
    p = prepare_retail(spark, sf)
    from rankloom.operators.ingest import stub_users
    return sv.user_page(stub_users(p.ratings), 20, 20)


@register("user_history", sql("""
SELECT user_idx, CAST(pos AS BIGINT) AS pos, item_idx, name, rating, "timestamp" FROM (
  SELECT S.user_idx, S.item_idx, ITEMS.name, S.rating, S."timestamp",
         row_number() OVER (PARTITION BY S.user_idx ORDER BY S."timestamp" DESC, S.item_idx) AS pos
  FROM S JOIN ITEMS ON ITEMS.item_idx = S.item_idx) WHERE pos <= 20""", "S", "ITEMS"))
def q_user_history(spark, sf):
    p = prepare_retail(spark, sf)
    h = sv.user_history(p.ratings, 20).join(p.items.select("item_idx", "name"), "item_idx")
    return h.select("user_idx", F.col("pos").cast("long").alias("pos"), "item_idx", "name",
                    "rating", "timestamp")


HIST50 = """
SELECT * FROM (SELECT S.*, row_number() OVER (PARTITION BY user_idx
                                              ORDER BY "timestamp" DESC, item_idx) AS pos FROM S)
WHERE pos <= 50"""


@register("rating_histogram", sql("""
SELECT user_idx, bin, CAST(count(*) AS BIGINT) AS n, round(1.0 + bin * (4.0 / 9), 6) AS bin_lo,
       round(1.0 + (bin + 1) * (4.0 / 9), 6) AS bin_hi
FROM (SELECT user_idx, CAST(least(greatest(floor((rating - 1.0) / (4.0 / 9)), 0), 8) AS INTEGER)
        AS bin FROM H50) GROUP BY user_idx, bin""", "S", extra={"H50": HIST50}))
def q_rating_histogram(spark, sf):
    """Q11: 9-bin rating histogram of each user's latest 50 interactions."""
    h = sv.user_history(prepare_retail(spark, sf).ratings, 50)
    out = sv.rating_histogram(h)
    return out.select("user_idx", "bin", "n", r6("bin_lo").alias("bin_lo"),
                      r6("bin_hi").alias("bin_hi"))


@register("history_feature_counts", sql("""
SELECT H50.user_idx, IF.feature, CAST(count(*) AS BIGINT) AS n
FROM H50 JOIN IF ON IF.item_idx = H50.item_idx GROUP BY H50.user_idx, IF.feature""",
    "S", "IF", extra={"H50": HIST50}))
def q_history_feature_counts(spark, sf):
    """Q12: feature counts over each user's latest 50 interactions."""
    p = prepare_retail(spark, sf)
    return sv.history_feature_counts(sv.user_history(p.ratings, 50), p.features)


# ── validation ──────────────────────────────────────────────────────────────
from rankloom.config import RETAIL_CONFIG  # noqa: E402
from rankloom.operators import prepare as prep  # noqa: E402
from rankloom.operators import validate as va  # noqa: E402


def _check_sql() -> str:
    parts = []

    def cnt(name, cond):
        parts.append(f"SELECT '{name}' AS \"check\", "
                     f"CAST(count(*) FILTER (WHERE {cond}) AS BIGINT) AS n FROM DR")

    for c in ("rating", "timestamp"):
        cnt(f"{c}_empty", f'"{c}" IS NULL')
        cnt(f"{c}_non_numeric", f'"{c}" IS NOT NULL AND TRY_CAST("{c}" AS DOUBLE) IS NULL')
    for c in ("user_id", "item_id"):
        cnt(f"{c}_empty", f"{c} IS NULL")
    for c in ("liked", "add_to_cart", "ordered"):
        cnt(f"flag_values:{c}", f"TRY_CAST({c} AS DOUBLE) IS NOT NULL "
                                f"AND TRY_CAST({c} AS DOUBLE) NOT IN (0.0, 1.0)")
    cnt("view_time_negative", "TRY_CAST(view_time_sec AS DOUBLE) < 0")
    parts.append("SELECT 'few_rows' AS \"check\", "
                 "CAST(CASE WHEN count(*) < 100 THEN 1 ELSE 0 END AS BIGINT) AS n FROM DR")
    for f in RETAIL_CONFIG.feature_cols:
        parts.append(f"SELECT 'feature_non_binary:{f}' AS \"check\", CAST(count(*) FILTER ("
                     f"WHERE item_id % 40 = 0 AND list_contains(list_slice(categories, 2, 4), "
                     f"'{f}')) AS BIGINT) AS n FROM DITEMS")
    return "\nUNION ALL ".join(parts)


def dirty_inputs(spark, sf):
    return (fx.retail_ratings_text(spark, sf, dirty=True),
            fx.retail_items(spark, sf, RETAIL_CONFIG, dirty=True))


@register("validation_checks", sql(_check_sql(), "DR", "DITEMS"))
def q_validation_checks(spark, sf):
    """V02–V04, V06–V08, V10 on the dirtied upload: one row per check."""
    ratings, items = dirty_inputs(spark, sf)
    r = va.ratings_check_counts(ratings.drop("_key"))
    i = va.feature_non_binary(items, RETAIL_CONFIG).select(
        F.concat(F.lit("feature_non_binary:"), F.col("feature")).alias("check"), "n")
    return r.unionByName(i)


@register("duplicate_interactions", sql("""
SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicates
FROM (SELECT count(*) AS c FROM DR GROUP BY user_id, item_id, "timestamp")""", "DR"))
def q_duplicate_interactions(spark, sf):
    ratings, _ = dirty_inputs(spark, sf)
    return va.duplicate_count(ratings)


@register("orphan_items", sql("""
SELECT DISTINCT item_id FROM DR
WHERE item_id NOT IN (SELECT CAST(item_id AS VARCHAR) FROM DITEMS)""", "DR", "DITEMS"))
def q_orphan_items(spark, sf):
    ratings, items = dirty_inputs(spark, sf)
    return va.orphan_items(ratings, items.withColumn("item_id", F.col("item_id").cast("string")))


@register("validation_report")
def q_validation_report(spark, sf):
    """The assembled report on the dirtied upload (unit-tested messages)."""
    ratings, items = dirty_inputs(spark, sf)
    return va.report(ratings.drop("_key"), items, RETAIL_CONFIG)


def _intake_sql(upload: str, table: str, items: str, non_binary: str) -> str:
    def row(section, name, value):
        return f"SELECT '{upload}' AS upload, '{section}' AS section, '{name}' AS name, CAST({value} AS DOUBLE) AS value"

    number = lambda c: f"TRY_CAST({c} AS DOUBLE)"
    errors, rows = [], []
    for c in ("rating", '"timestamp"'):
        name = c.strip('"')
        errors += [(f"{name}_empty", f"{c} IS NULL"), (f"{name}_non_numeric", f"{c} IS NOT NULL AND {number(c)} IS NULL")]
        rows.append(row("first_bad", name, f"(SELECT min(_key) FILTER ({number(c)} IS NULL) FROM {table})"))
    errors += [(f"{c}_empty", f"{c} IS NULL") for c in ("user_id", "item_id")]
    errors += [(f"flag_values:{c}", f"{number(c)} IS NOT NULL AND {number(c)} NOT IN (0.0, 1.0)") for c in ("liked", "add_to_cart", "ordered")]
    errors.append(("view_time_negative", f"{number('view_time_sec')} < 0"))
    rows += [row("error", n, f"(SELECT count(*) FILTER ({cond}) FROM {table})") for n, cond in errors]
    rows += [row("stat", n, f"(SELECT {e} FROM {table})") for n, e in (
        ("rows", "count(*)"), ("rating_min", f"min({number('rating')})"), ("rating_max", f"max({number('rating')})"),
        ("users", "count(DISTINCT user_id)"), ("items", "count(DISTINCT item_id)"))]
    rows += [row("warning", "duplicates", f"""(SELECT coalesce(sum(c - 1), 0) FROM (
               SELECT count(*) AS c FROM {table} GROUP BY user_id, item_id, "timestamp"))"""),
             row("warning", "few_rows", f"(SELECT CASE WHEN count(*) < 100 THEN 1 ELSE 0 END FROM {table})"),
             row("warning", "orphans", f"""(SELECT count(DISTINCT item_id) FROM {table}
               WHERE item_id NOT IN (SELECT CAST(item_id AS VARCHAR) FROM {items}))""")]
    rows += [row("warning", f"feature_non_binary:{f}", f"""(SELECT count(*) FILTER ({non_binary}
               AND list_contains(list_slice(categories, 2, 4), '{f}')) FROM {items})""") for f in RETAIL_CONFIG.feature_cols]
    valid = f"(SELECT CASE WHEN count(*) FILTER ({' OR '.join(f'coalesce({c}, false)' for _, c in errors)}) = 0 THEN 1 ELSE 0 END FROM {table})"
    return "\nUNION ALL ".join(rows + [row("verdict", "valid", valid), row("verdict", "published", valid)])


@register("gated_ingest", sql(
    _intake_sql("dirty", "DR", "DITEMS", "item_id % 40 = 0") + "\nUNION ALL " + _intake_sql("clean", "CLEAN", "PART", "false"),
    "DR", "DITEMS", "PART", extra={"CLEAN": """
SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(item_id AS VARCHAR) AS item_id, CAST(rating AS VARCHAR) AS rating,
       CAST("timestamp" AS VARCHAR) AS "timestamp", CAST(view_time_sec AS VARCHAR) AS view_time_sec,
       CAST(liked AS VARCHAR) AS liked, CAST(add_to_cart AS VARCHAR) AS add_to_cart,
       CAST(ordered AS VARCHAR) AS ordered, _key FROM R"""}))
def q_gated_ingest(spark, sf):
    """Two uploads through the gate, one with errors, one without; what it found and published."""
    out = None
    for upload, dirty in (("dirty", True), ("clean", False)):
        ratings = fx.retail_ratings_text(spark, sf, dirty=dirty)
        items = fx.retail_items(spark, sf, RETAIL_CONFIG, dirty=dirty)
        report, _ = intake.gated_ingest(ratings, items, RETAIL_CONFIG, _store(spark, "intake"), row_no="_key")
        report = report.select(F.lit(upload).alias("upload"), "section", "name", "value")
        out = report if out is None else out.unionByName(report)
    return out


# ── preparation ─────────────────────────────────────────────────────────────
RECENT_N = 20000


def _typed_with_copies(spark, sf):
    r = fx.retail_ratings(spark, sf)
    return r.unionByName(r.where(F.col("_key") % 109 == 0))


@register("dedup_first", sql("""
SELECT DISTINCT user_id, item_id, "timestamp", rating FROM R""", "R"))
def q_dedup_first(spark, sf):
    """I11 on fixture R with every 109th order key repeated (first copy kept)."""
    r = _typed_with_copies(spark, sf).select("user_id", "item_id", "timestamp", "rating", "_key")
    return prep.dedup_first(r, order="_key").drop("_key")


def _recent(spark, sf):
    r = fx.retail_ratings(spark, sf).select("user_id", "item_id", "timestamp")
    return prep.most_recent(r, RECENT_N, order=("user_id", "item_id"))


RECENT_SQL = f"""
SELECT user_id, item_id, "timestamp" FROM R
ORDER BY "timestamp" DESC, user_id, item_id LIMIT {RECENT_N}"""


@register("most_recent_n", sql('SELECT user_id, item_id, "timestamp" FROM RECENT', "R",
                               extra={"RECENT": RECENT_SQL}))
def q_most_recent_n(spark, sf):
    return _recent(spark, sf)


def _core_sql() -> dict:
    out, prev = {}, "ALL_ROWS"
    for i in range(1, 4):
        out[f"K{i}"] = f"""
SELECT * FROM {prev}
WHERE user_id IN (SELECT user_id FROM {prev} GROUP BY user_id HAVING count(*) >= 3)
  AND item_id IN (SELECT item_id FROM {prev} GROUP BY item_id HAVING count(*) >= 3)"""
        prev = f"K{i}"
    return out


@register("three_core", sql('SELECT user_id, item_id, "timestamp" FROM K3', "R",
                            extra={"ALL_ROWS": 'SELECT user_id, item_id, "timestamp" FROM R', **_core_sql()}))
def q_three_core(spark, sf):
    """Three rounds of the 3-core filter on the whole table."""
    return prep.k_core(fx.retail_ratings(spark, sf).select("user_id", "item_id", "timestamp"))


def _meta(spark, sf):
    p = fx.part_categories(spark, sf)
    return p.select(F.col("item_id").alias("asin"), F.col("product_name").alias("title"),
                    "categories", F.col("item_id").alias("row_no"))


def _clean_meta(spark, sf):
    rated = fx.retail_ratings(spark, sf).select("item_id")
    return prep.clean_metadata(_meta(spark, sf), rated), rated


VOCAB_SQL = """
SELECT CAST(row_number() OVER (ORDER BY n DESC, first_key) AS BIGINT) AS rank, category,
       CAST(n AS BIGINT) AS n
FROM (SELECT category, count(*) AS n, min(first_row * 100 + pos) AS first_key
      FROM (SELECT m.item_id AS first_row, u.category, u.pos
            FROM (SELECT item_id, categories FROM PART
                  WHERE item_id IN (SELECT item_id FROM R)) m,
                 LATERAL (SELECT trim(c) AS category, i AS pos
                          FROM (SELECT unnest(m.categories[2:]) AS c,
                                       generate_subscripts(m.categories[2:], 1) AS i)) u
            WHERE length(u.category) > 1)
      GROUP BY category)
ORDER BY n DESC, first_key LIMIT 12"""


@register("feature_vocabulary", sql("SELECT rank, category, n FROM VOCAB", "PART", "R",
                                    extra={"VOCAB": VOCAB_SQL}))
def q_feature_vocabulary(spark, sf):
    """I14 + I15 on part metadata restricted to rated items."""
    meta, _ = _clean_meta(spark, sf)
    return prep.vocabulary(meta)


@register("multi_hot", sql("""
SELECT m.item_id, v.category,
       CAST(list_contains(list_transform(m.categories[2:], lambda c: trim(c)), v.category) AS INTEGER)
         AS flag
FROM (SELECT item_id, categories FROM PART WHERE item_id IN (SELECT item_id FROM R)) m
CROSS JOIN VOCAB v""", "PART", "R", extra={"VOCAB": VOCAB_SQL}))
def q_multi_hot(spark, sf):
    """I16 in long form over the top-12 vocabulary."""
    meta, rated = _clean_meta(spark, sf)
    names = [r["category"] for r in prep.vocabulary(meta).orderBy("rank").collect()]
    return prep.multi_hot_long(rated, meta, names)


def review_lines(spark, sf):
    """Review lines of fixture R; and, to be written after them, lines to reject: cut off, without an item id, and
    repeats of a key with another rating."""
    r = fx.retail_ratings(spark, sf)
    line = lambda item, rating: F.to_json(F.struct(
        F.col("user_id").cast("string").alias("reviewerID"), item.cast("string").alias("asin"), rating.alias("overall"),
        F.col("timestamp").alias("unixReviewTime"), (F.col("ordered") == 1).alias("verified")))
    item, rating, k = F.col("item_id"), F.col("rating"), F.col("_key")
    # all odd lines of a row at once: a union would join the orders once per kind
    kinds = F.array(F.when(k % 97 == 0, F.substring(line(item, rating), 1, 25)), F.when(k % 101 == 0, line(F.lit(None), rating)),
                    F.when(k % 109 == 0, line(item, rating + 7)))
    odd = r.where((k % 97 == 0) | (k % 101 == 0) | (k % 109 == 0)).select(F.explode(F.array_compact(kinds)).alias("value"))
    return r.select(line(item, rating).alias("value")), odd


def metadata_lines(spark, sf):
    """Metadata lines of the parts in order of id: even ids in the present form, odd ids in the nested older one."""
    p = fx.part_categories(spark, sf).orderBy("item_id")
    even = F.col("item_id") % 2 == 0
    return p.select(F.to_json(F.struct(
        F.col("item_id").cast("string").alias("asin"), F.col("product_name").alias("title"),
        F.when(even, F.col("categories")).alias("category"), F.when(~even, F.array("categories")).alias("categories"))).alias("value"))


@register("prepare_reviews", sql("""
SELECT 'records' AS section, 'read' AS name, CAST((SELECT count(*) FROM R) + count(*) FILTER (_key % 97 = 0)
       + count(*) FILTER (_key % 101 = 0) + count(*) FILTER (_key % 109 = 0) AS DOUBLE) AS value FROM R
UNION ALL SELECT 'records', 'corrupt', CAST(count(*) FILTER (_key % 97 = 0) AS DOUBLE) FROM R
UNION ALL SELECT 'records', 'incomplete', CAST(count(*) FILTER (_key % 101 = 0) AS DOUBLE) FROM R
UNION ALL SELECT 'prepared', 'kept', CAST(count(*) AS DOUBLE) FROM RR
UNION ALL SELECT 'prepared', 'rating_sum', CAST(sum(rating) AS DOUBLE) FROM RR
UNION ALL SELECT 'prepared', 'ordered_sum', CAST(sum(ordered) AS DOUBLE) FROM RR
UNION ALL SELECT 'feature', v.category, CAST(count(*) FILTER (
    list_contains(list_transform(m.categories[2:], lambda c: trim(c)), v.category)) AS DOUBLE)
  FROM (SELECT item_id, categories FROM PART WHERE item_id IN (SELECT item_id FROM R)) m CROSS JOIN VOCAB v GROUP BY v.category
UNION ALL SELECT 'stat', 'rows', CAST(count(*) AS DOUBLE) FROM RR
UNION ALL SELECT 'stat', 'rating_min', CAST(min(rating) AS DOUBLE) FROM RR
UNION ALL SELECT 'stat', 'rating_max', CAST(max(rating) AS DOUBLE) FROM RR
UNION ALL SELECT 'stat', 'users', CAST(count(DISTINCT user_id) AS DOUBLE) FROM RR
UNION ALL SELECT 'stat', 'items', CAST(count(DISTINCT item_id) AS DOUBLE) FROM RR
UNION ALL SELECT 'verdict', 'valid', 1.0
UNION ALL SELECT 'verdict', 'published', 1.0""", "PART", "R",
    extra={"VOCAB": VOCAB_SQL, "RR": 'SELECT user_id, item_id, "timestamp", any_value(rating) AS rating, any_value(ordered) AS ordered FROM R GROUP BY user_id, item_id, "timestamp"'}))
def q_prepare_reviews(spark, sf):
    """Gzip review and metadata lines of the given tables, prepared, gated and published."""
    import uuid
    root = scratch_path(spark, "prepare", uuid.uuid4().hex[:8])
    for name, lines in zip(("a", "b"), review_lines(spark, sf), strict=True):
        lines.write.option("compression", "gzip").text(f"{root}/reviews/{name}")
    metadata_lines(spark, sf).write.option("compression", "gzip").text(f"{root}/metadata")
    report, _ = prep.prepare_and_publish(spark, [f"{root}/reviews/a", f"{root}/reviews/b"], f"{root}/metadata",
                                         "Machine_Parts", _store(spark, "prepare"), f"{root}/work")
    return report


# ── streaming ───────────────────────────────────────────────────────────────
from rankloom.streaming import jobs as st  # noqa: E402

N_FEAT = len(RETAIL_CONFIG.feature_cols)


def _events_glob(sf):
    return f"{sf.rstrip('/')}/events*.parquet"


def stream_statics(spark, sf):
    """Item vectors by item_id and base profiles by user_id (dense, config order)."""
    p = prepare_retail(spark, sf)
    vecs = (cbf.dense_item_vectors(p.features, RETAIL_CONFIG.feature_cols)
            .join(p.item_map, "item_idx").select("item_id", "vec"))
    base = (cbf.dense_profiles(cbf.user_profiles(p.train, p.features), RETAIL_CONFIG.feature_cols)
            .join(p.user_map, "user_idx").select("user_id", F.col("profile").alias("base")))
    return vecs, base


_STREAM_MEMO: dict = {}


def _job(name, sf):
    """A stream job's name: what it does, over which input, in which session's tables."""
    return f"{name}-{hashlib.sha1(sf.rstrip('/').encode()).hexdigest()[:10]}"


def profile_run(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STREAM_MEMO:
        vecs, base = stream_statics(spark, sf)
        ups = st.profile_stream(fx.event_stream(spark, _events_glob(sf)), vecs, base, N_FEAT)
        _STREAM_MEMO[key] = st.run_to_table(ups, ["user_id"], _job("profiles", sf))
    return _STREAM_MEMO[key]


_REC_CTE = """
SELECT u.user_id, 0 AS step,
       coalesce(BP.base, list_transform(range(22), lambda i: 0.0)) AS p
FROM (SELECT DISTINCT user_id FROM EVX) u LEFT JOIN BP ON BP.user_id = u.user_id
UNION ALL
SELECT r.user_id, r.step + 1,
       CASE WHEN x.alpha > 0 THEN list_transform(
              list_transform(list_zip(r.p, x.vec), lambda t: (1.0 - x.alpha) * t[1] + x.alpha * t[2]),
              lambda y: y / sqrt(list_sum(list_transform(
                  list_transform(list_zip(r.p, x.vec),
                                 lambda t: (1.0 - x.alpha) * t[1] + x.alpha * t[2]),
                  lambda z: z * z))))
            ELSE r.p END
FROM REC r JOIN EVX x ON x.user_id = r.user_id AND x.rn = r.step + 1"""


@register("ema_replay", sql("""
SELECT r.user_id, CAST(i - 1 AS INTEGER) AS feature_pos, round(r.p[i], 6) AS value
FROM REC r JOIN (SELECT user_id, max(rn) AS n FROM EVX GROUP BY user_id) m
  ON m.user_id = r.user_id AND r.step = m.n
CROSS JOIN range(1, 23) AS t(i)""", "EVX", "BP", extra={"REC": _REC_CTE}).replace(
    "WITH ", "WITH RECURSIVE ", 1))
def q_ema_replay(spark, sf):
    """Profiles after replaying every event in order through the keyed state."""
    out = profile_run(spark, sf)
    return out.select("user_id", F.posexplode("profile").alias("feature_pos", "value")).select(
        "user_id", F.col("feature_pos").cast("int"), r6("value").alias("value"))


@register("stream_profiles", sql("""
SELECT user_id, CAST(count(*) AS BIGINT) AS n_events,
       round(arg_max(alpha, rn), 6) AS last_alpha FROM EVX GROUP BY user_id""", "EVX"))
def q_stream_profiles(spark, sf):
    """Per user, events applied and the step size of the last one."""
    return profile_run(spark, sf).select("user_id", "n_events", r6("last_alpha").alias("last_alpha"))


@register("stream_seen", sql("SELECT DISTINCT user_id, item_id FROM EV", "EV"))
def q_stream_seen(spark, sf):
    s = st.seen_stream(fx.event_stream(spark, _events_glob(sf)))
    return st.run_seen(s, _job("seen", sf))


@register("stream_popularity", sql("""
SELECT item_id, round(sum(engagement), 6) AS weight, CAST(count(*) AS BIGINT) AS events
FROM ENG GROUP BY item_id""", "ENG"))
def q_stream_popularity(spark, sf):
    s = st.popularity_stream(fx.event_stream(spark, _events_glob(sf)))
    out = st.run_to_table(s, ["item_id"], _job("popularity", sf))
    return out.select("item_id", r6("weight").alias("weight"), "events")


@register("stream_windows", sql("""
SELECT date_trunc('day', e.event_time) AS window_start, f.feature,
       CAST(count(*) AS BIGINT) AS events, round(avg(e.effective_rating), 6) AS avg_rating
FROM ENG e JOIN IM ON IM.item_id = e.item_id JOIN IF f ON f.item_idx = IM.item_idx
GROUP BY 1, 2""", "ENG", "IM", "IF"))
def q_stream_windows(spark, sf):
    p = prepare_retail(spark, sf)
    feats = p.features.join(p.item_map, "item_idx").select("item_id", "feature")
    s = st.window_stream(fx.event_stream(spark, _events_glob(sf)), feats)
    out = st.run_to_table(s, ["window_start", "feature"], _job("windows", sf))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "feature",
                      "events", r6("avg_rating").alias("avg_rating"))


@register("stream_rerank", sql("""
SELECT user_idx, rank, item_idx, round(score, 6) AS score FROM (
  SELECT w.user_idx, w.item_idx, s.score,
         CAST(row_number() OVER (PARTITION BY w.user_idx ORDER BY round(s.score, 9) DESC, w.item_idx) AS BIGINT) AS rank
  FROM SRW w LEFT JOIN CTX c ON c.item_idx = w.item_idx,
  LATERAL (SELECT CAST(0.3 AS DOUBLE) * coalesce(w.n_0, 0) + CAST(0.3 AS DOUBLE) * coalesce(w.n_1, 0)
                  + CAST(0.4 AS DOUBLE) * coalesce(w.n_2, 0)
                  + CAST(0.15 AS DOUBLE) * coalesce(c.ctx, 0) AS score) s)
WHERE rank <= 10""", "EVX", "EV", "BP", "UM", "IM", "IF", "DV", "IB", "UB", "MU", "IPOP", "CSEEN", "CTX", extra={
    "REC": _REC_CTE,
    "SRU": """
SELECT UM.user_idx, r.p FROM REC r JOIN UM ON UM.user_id = r.user_id
JOIN (SELECT user_id, max(rn) AS n FROM EVX GROUP BY user_id) m ON m.user_id = r.user_id AND r.step = m.n""",
    "SRSEEN": """
SELECT user_idx, item_idx FROM CSEEN
UNION SELECT UM.user_idx, IM.item_idx FROM EV JOIN UM ON UM.user_id = EV.user_id JOIN IM ON IM.item_id = EV.item_id""",
    "SRC": """
SELECT user_idx, model, item_idx, score,
       row_number() OVER (PARTITION BY user_idx, model ORDER BY round(score, 9) DESC, item_idx) AS rank
FROM (SELECT u.user_idx, 'cbf' AS model, IPOP.item_idx,
             coalesce(list_sum(list_transform(list_zip(u.p, d.vec), lambda t: t[1] * t[2])), 0) + 0.05 * IPOP.pop AS score
      FROM SRU u CROSS JOIN IPOP LEFT JOIN IM ON IM.item_idx = IPOP.item_idx LEFT JOIN DV d ON d.item_id = IM.item_id
      UNION ALL
      SELECT u.user_idx, 'cf', IB.item_idx,
             coalesce((SELECT mu FROM MU) + UB.user_bias, 0) + IB.item_bias + 0.5 * IB.pop_prior
      FROM SRU u CROSS JOIN IB LEFT JOIN UB ON UB.user_idx = u.user_idx
      UNION ALL
      SELECT u.user_idx, 'ncf', IB.item_idx, IB.pop_prior FROM SRU u CROSS JOIN IB) x
WHERE NOT EXISTS (SELECT 1 FROM SRSEEN s WHERE s.user_idx = x.user_idx AND s.item_idx = x.item_idx)
QUALIFY rank <= 200""",
    "SRW": """
SELECT user_idx, item_idx, max(CASE WHEN model = 'cf' THEN norm END) AS n_0,
       max(CASE WHEN model = 'cbf' THEN norm END) AS n_1, max(CASE WHEN model = 'ncf' THEN norm END) AS n_2
FROM (SELECT *, CASE WHEN mx = mn THEN 0.5 ELSE (score - mn) / (mx - mn) END AS norm
      FROM (SELECT *, min(score) OVER (PARTITION BY user_idx, model) AS mn,
                   max(score) OVER (PARTITION BY user_idx, model) AS mx FROM SRC))
GROUP BY user_idx, item_idx"""}).replace("WITH ", "WITH RECURSIVE ", 1))
def q_stream_rerank(spark, sf):
    """Each micro-batch ranks the users it touched by the hybrid, from their profile after it,
    without anything they have consumed; a user's last ranking."""
    p = prepare_retail(spark, sf)
    vecs, base = stream_statics(spark, sf)
    ups = st.profile_stream(fx.event_stream(spark, _events_glob(sf), max_files=1), vecs, base, N_FEAT)
    return st.run_rerank(ups, hybrid_rerank(p), _job("rerank", sf), ["user_idx"]).select(
        "user_idx", "rank", "item_idx", r6("score").alias("score"))


def hybrid_rerank(p, n: int = 10):
    """A function from a batch of stream profiles to the touched users' rankings."""
    models, seen = rq.scorers(p), rk.seen_lists(p.serve_train)

    def rerank(batch):
        touched = batch.join(p.user_map, "user_id")
        consumed = (touched.select("user_idx", F.explode("consumed").alias("item_id")).join(p.item_map, "item_id")
                    .groupBy("user_idx").agg(F.collect_set("item_idx").alias("_new")))
        none = F.array().cast("array<long>")
        contexts = (touched.select(F.col("user_idx").alias("qid"), "user_idx", F.col("profile").alias("vec"))
                    .join(seen, "user_idx", "left").join(consumed, "user_idx", "left")
                    .withColumn("seen", F.concat(F.coalesce("_seen", none), F.coalesce("_new", none)))
                    .withColumns({f"n_{m}": F.lit(C.N_CANDIDATES) for m in rq.MODELS}))
        contexts = contexts.checkpoint()
        asked = contexts.select(F.col("qid").alias("request_id"), F.lit(n).alias("n"),
                                F.lit(C.DEFAULT_HOUR).alias("hour"), F.lit(C.DEFAULT_DOW).alias("dow"))
        ranked = rq.rank_contexts(contexts, models).withColumnRenamed("qid", "request_id")
        return rq.fuse_requests(ranked, asked, p).withColumnRenamed("request_id", "user_idx")

    return rerank


# ── neural scorer ───────────────────────────────────────────────────────────
from rankloom.operators import neural as ncf  # noqa: E402

_NCF: dict = {}
NCF_EPOCHS = 15


def index_sizes(p):
    row = p.ratings.agg(F.max("user_idx").alias("u"), F.max("item_idx").alias("i")).first()
    return int(row["u"]) + 1, int(row["i"]) + 1


def ncf_model(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _NCF:
        p = prepare_retail(spark, sf)
        n_users, n_items = index_sizes(p)
        _NCF[key] = ncf.fit(p.train, n_users, n_items, epochs=NCF_EPOCHS)
    return _NCF[key]


@register("negative_sample", sql("""
SELECT t.user_idx, CAST(count(*) AS BIGINT) AS n_pos,
       CAST(least(4 * count(*), (SELECT count(*) FROM IM) - count(DISTINCT t.item_idx)) AS BIGINT)
         AS n_neg,
       CAST(0 AS BIGINT) AS n_bad
FROM TR t GROUP BY t.user_idx""", "TR", "IM"))
def q_negative_sample(spark, sf):
    """Positives and sampled negatives per user; ``n_bad`` counts seen/duplicate draws."""
    p = prepare_retail(spark, sf)
    _, n_items = index_sizes(p)
    neg = ncf.negative_sample(p.train, n_items)
    seen = p.train.select("user_idx", "item_idx").distinct().withColumn("_seen", F.lit(1))
    drawn = (neg.groupBy("user_idx", "item_idx").agg(F.count(F.lit(1)).alias("_n"))
             .join(seen, ["user_idx", "item_idx"], "left")
             .groupBy("user_idx").agg(
                 F.sum("_n").alias("n_neg"),
                 F.sum(F.when(F.col("_seen") == 1, F.col("_n")).otherwise(0)
                       + (F.col("_n") > 1).cast("long")).alias("n_bad")))
    pos = p.train.groupBy("user_idx").agg(F.count(F.lit(1)).alias("n_pos"))
    return (pos.join(drawn, "user_idx", "left")
            .select("user_idx", F.col("n_pos").cast("long"),
                    F.coalesce("n_neg", F.lit(0)).cast("long").alias("n_neg"),
                    F.coalesce("n_bad", F.lit(0)).cast("long").alias("n_bad")))


@register("median_context", sql("""
SELECT user_idx, CAST(floor(median(hour)) AS INTEGER) AS med_hour,
       CAST(floor(median(day_of_week)) AS INTEGER) AS med_day_of_week,
       CAST(floor(median(month)) AS INTEGER) AS med_month
FROM TR GROUP BY user_idx""", "TR"))
def q_median_context(spark, sf):
    return ncf.median_context(prepare_retail(spark, sf).train)


@register("neural_training")
def q_neural_training(spark, sf):
    """Per-epoch train and validation loss of the data-parallel fit."""
    m = ncf_model(spark, sf)
    return spark.createDataFrame(m.history, "epoch long, train_loss double, val_loss double")


@register("neural_predict")
def q_neural_predict(spark, sf):
    """Probability for every held-out pair at the default context (12, 2, 5)."""
    p = prepare_retail(spark, sf)
    pairs = p.test.select("user_idx", "item_idx").distinct()
    return ncf.predict_pairs(ncf_model(spark, sf), pairs).select(
        "user_idx", "item_idx", r6("ncf_score").alias("ncf_score"))


@register("neural_topn")
def q_neural_topn(spark, sf):
    """Top-10 unseen over the full index range for every user with training rows."""
    p = prepare_retail(spark, sf)
    out = ncf.topn(ncf_model(spark, sf), p.train.select("user_idx"), p.train, n=10)
    return out.select("user_idx", "rank", "item_idx", r6("score").alias("score"))


@register("neural_attribution")
def q_neural_attribution(spark, sf):
    """Exact Shapley values for every held-out interaction at its own time (100-row
    background of training rows, chosen by hash with seed 42)."""
    p = prepare_retail(spark, sf)
    req = session_requests(p).withColumnRenamed("b_item", "item_idx")
    bg = (p.train.select("user_idx", "item_idx", "hour", "day_of_week", "month")
          .orderBy(F.xxhash64("user_idx", "item_idx", "hour", F.lit(42))).limit(100))
    out = ncf.shapley(ncf_model(spark, sf), req, bg)
    return out.select("user_idx", "item_idx", "hour", "day_of_week", "month", *[r6(c).alias(c) for c in (
        "phi_user", "phi_item", "phi_hour", "phi_dow", "phi_month", "base_value", "prediction")])


# ── full hybrid over the real scorers (rows-only: depends on the neural fit) ──
from rankloom.plans import training as tr  # noqa: E402

_TUNED: dict = {}


def trained(spark, sf):
    return tr.Trained(svd_model(spark, sf), ncf_model(spark, sf), NCF_EPOCHS)


def tuned(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TUNED:
        grid = tr.tune(prepare_retail(spark, sf), trained(spark, sf)).checkpoint(eager=True)
        _TUNED[key] = (grid, *tr.best_weights(grid))
    return _TUNED[key]


@register("hybrid_tuning")
def q_hybrid_tuning(spark, sf):
    """Mean NDCG@10 of all 198 settings for the real cf/cbf/ncf candidates."""
    grid = tuned(spark, sf)[0]
    return grid.select("combo_no", "w1", "w2", "w3", "alpha", r6("ndcg").alias("ndcg"))


@register("hybrid_recommend")
def q_hybrid_recommend(spark, sf):
    """Q01 (model=hybrid): tuned fusion, context (12, 2, 5), top 10, serving seen set."""
    p = prepare_retail(spark, sf)
    _, weights, alpha, _ = tuned(spark, sf)
    users = p.serve_train.select("user_idx").distinct()
    out = tr.hybrid_topn(p, trained(spark, sf), users, p.serve_train, weights, alpha, n=10)
    return sv.enrich(out, p.items, p.features).select(
        "user_idx", "rank", "item_idx", "item_id", "name", r6("score").alias("score"))


@register("evaluate_all")
def q_evaluate_all(spark, sf):
    """Cf, cbf, ncf and hybrid on the held-out part, k = 5, 10, 20."""
    _, weights, alpha, _ = tuned(spark, sf)
    res, _ = tr.evaluate_all(prepare_retail(spark, sf), trained(spark, sf), weights, alpha)
    return res.select("model", "metric", "k", r6("value").alias("value"))


@register("run_metadata")
def q_run_metadata(spark, sf):
    """Weights, context strength, evaluated users and epochs of the run."""
    _, weights, alpha, _ = tuned(spark, sf)
    p = prepare_retail(spark, sf)
    spark_ = p.ratings.sparkSession
    return spark_.createDataFrame(
        [(float(weights[0]), float(weights[1]), float(weights[2]), float(alpha), "all",
          int(len(ncf_model(spark, sf).history)))],
        "w_cf double, w_cbf double, w_ncf double, ctx_alpha double, eval_users string, "
        "ncf_epochs int")


@register("explain")
def q_explain(spark, sf):
    """Explanation structs for every held-out pair with the tuned weights."""
    p = prepare_retail(spark, sf)
    _, weights, _, _ = tuned(spark, sf)
    pairs = explain_pairs(spark, sf)
    raw = tr.raw_scores(p, trained(spark, sf), pairs)
    return ex.explain(pairs, raw, weights, p.serve_train, p.items, p.features,
                      p.cfg.item_label)


def held_out_requests(p):
    """A request per held-out row, at the row's own time."""
    return p.test.select("user_idx", "item_idx", "timestamp", "hour", F.col("day_of_week").alias("dow"), F.col("month").alias("mon"))


@register("explain_requests")
def q_explain_requests(spark, sf):
    """An explanation of every held-out row at its own hour, day and month."""
    p = prepare_retail(spark, sf)
    _, weights, _, _ = tuned(spark, sf)
    asked = ex.with_context(held_out_requests(p))
    raw = tr.raw_scores(p, trained(spark, sf), asked)
    return ex.explain_requests(asked, raw, weights, p.serve_train, p.items, p.features, p.cfg.item_label)


@register("request_contributions", sql("""
SELECT user_idx, item_idx, "timestamp", hour, dow, round(CAST(0.3 AS DOUBLE) * cf_raw / tot, 4) AS cf_contribution,
       round(CAST(0.3 AS DOUBLE) * cbf_raw / tot, 4) AS cbf_contribution, round(CAST(0.4 AS DOUBLE) * ncf_raw / tot, 4) AS ncf_contribution,
       round(tot, 4) AS hybrid_score
FROM (SELECT *, CAST(0.3 AS DOUBLE) * cf_raw + CAST(0.3 AS DOUBLE) * cbf_raw + CAST(0.4 AS DOUBLE) * ncf_raw AS tot
      FROM (SELECT t.user_idx, t.item_idx, t."timestamp", t.hour, t.day_of_week AS dow, r.cf_raw, r.cbf_raw,
                   1 / (1 + exp(-(r.ncf_raw + c.ctx))) AS ncf_raw
            FROM TE t JOIN RAW r ON r.user_idx = t.user_idx AND r.item_idx = t.item_idx
            JOIN CTXR c ON c.hour = t.hour AND c.dow = t.day_of_week AND c.item_idx = t.item_idx))""", "TE", "RAW", "CTXR"))
def q_request_contributions(spark, sf):
    """E01/E06 per request: a third scorer that depends on the request's time (popularity and temporal score) moves its share."""
    p = prepare_retail(spark, sf)
    asked = ex.with_context(held_out_requests(p))
    pairs = asked.select("user_idx", "item_idx", *ex.CONTEXT).distinct()
    raw = deterministic_raw(spark, sf, explain_pairs(spark, sf)).join(pairs, ["user_idx", "item_idx"])
    raw = rq.with_context_bias(raw, p, asked, "inner")
    raw = raw.withColumn("ncf_raw", 1 / (1 + F.exp(-(F.col("ncf_raw") + F.col("ctx")))))
    told = ex.contributions(raw, (0.3, 0.3, 0.4))
    return asked.join(told, ["user_idx", "item_idx", *ex.CONTEXT]).select(
        "user_idx", "item_idx", "timestamp", "hour", "dow", "cf_contribution", "cbf_contribution", "ncf_contribution", "hybrid_score")


# ── file formats on the real tables ─────────────────────────────────────────
from rankloom.session import scratch_path  # noqa: E402
from rankloom.sources import files as fl  # noqa: E402


@register("csv_roundtrip", sql("""
SELECT CAST(count(*) AS BIGINT) AS n_ratings, CAST(count(DISTINCT user_id) AS BIGINT) AS n_users,
       CAST(count(DISTINCT item_id) AS BIGINT) AS n_items,
       CAST(min(rating) AS DOUBLE) AS rating_min, CAST(max(rating) AS DOUBLE) AS rating_max,
       'liked,add_to_cart,ordered,view_time_sec' AS behavioural_columns
FROM R""", "R"))
def q_csv_roundtrip(spark, sf):
    """S11 → S01 → I09: fixture R exported as CSV with header, read back as an all-string
    upload (null tokens mapped, file order numbered) and summarised."""
    import uuid
    out = scratch_path(spark, "exports", uuid.uuid4().hex[:8])
    r = fx.retail_ratings(spark, sf).drop("_key")
    r.write.mode("overwrite").option("header", True).csv(f"{out}/ratings")
    back = fl.read_upload_csv(spark, f"{out}/ratings")
    return ingest.dataset_summary(back.drop("row_no"))
