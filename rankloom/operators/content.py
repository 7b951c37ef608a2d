"""Content scorer: unit item vectors, weighted profiles, cosine scores, EMA updates.

Vectors are kept in long form ``(key, feature, value)`` so a dot product is an
equi-join on ``feature`` plus a sum, and the feature count never limits scale.

Top-n for all users (B06) scores blocks of dense profiles against blocks of dense item
vectors (``functions/blocks.py``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom import config as C
from rankloom.functions.columns import ema_alpha
from rankloom.functions.blocks import blocked_topn, item_blocks
from rankloom.functions.ranking import seen_lists


def item_unit_vectors(features: DataFrame) -> DataFrame:
    """Value 1/√(number of features of the item); featureless items have no rows."""
    w = Window.partitionBy("item_idx")
    return (features.select("item_idx", "feature")
            .withColumn("value", F.lit(1.0) / F.sqrt(F.count(F.lit(1)).over(w).cast("double"))))


def item_popularity(items: DataFrame, train: DataFrame) -> DataFrame:
    """log1p(Σ interaction_weight) per item row (row count without weights), 0 if unrated."""
    if "interaction_weight" in train.columns:
        agg = F.sum("interaction_weight")
    else:
        agg = F.count(F.lit(1)).cast("double")
    pop = train.groupBy("item_idx").agg(agg.alias("_p"))
    return (items.select("item_idx").join(pop, "item_idx", "left")
            .select("item_idx", F.log1p(F.coalesce(F.col("_p"), F.lit(0.0))).alias("pop")))


def liked_rows(train: DataFrame, threshold: float = C.CBF_LIKE_THRESHOLD) -> DataFrame:
    """Rows rated ≥ threshold; a user without such rows keeps all of them."""
    liked = F.col("rating") >= F.lit(threshold)
    any_liked = F.max(liked.cast("int")).over(Window.partitionBy("user_idx"))
    return (train.withColumn("_any", any_liked)
            .where(liked | (F.col("_any") == 0)).drop("_any"))


def user_profiles(train: DataFrame, features: DataFrame) -> DataFrame:
    """profile = normalise(Σ rating·weight·unit vector) over liked rows, long form.

    Users whose sum is zero have no rows (a zero vector). ``users_with_profile``
    lists every user that has one, zero or not.
    """
    src = liked_rows(train)
    w = F.col("rating")
    if "interaction_weight" in src.columns:
        w = w * F.coalesce(F.col("interaction_weight"), F.lit(1.0))
    vec = item_unit_vectors(features)
    summed = (src.select("user_idx", "item_idx", w.alias("_w"))
              .join(vec, "item_idx")
              .groupBy("user_idx", "feature").agg(F.sum(F.col("_w") * F.col("value")).alias("_s")))
    norm = F.sqrt(F.sum(F.col("_s") * F.col("_s")).over(Window.partitionBy("user_idx")))
    return (summed.withColumn("_n", norm).where(F.col("_n") > 0)
            .select("user_idx", "feature", (F.col("_s") / F.col("_n")).alias("value")))


def users_with_profile(train: DataFrame) -> DataFrame:
    return train.select("user_idx").distinct()


def pair_scores(pairs: DataFrame, profiles: DataFrame, features: DataFrame) -> DataFrame:
    """Cosine of (user, item) pairs, 0 for unknown users/items."""
    vec = item_unit_vectors(features)
    dots = (pairs.select("user_idx", "item_idx").distinct()
            .join(vec, "item_idx")
            .join(profiles.withColumnRenamed("value", "_p"), ["user_idx", "feature"])
            .groupBy("user_idx", "item_idx").agg(F.sum(F.col("_p") * F.col("value")).alias("_c")))
    return (pairs.join(dots, ["user_idx", "item_idx"], "left")
            .withColumn("cbf_score", F.coalesce(F.col("_c"), F.lit(0.0))).drop("_c"))


def item_signatures(items: DataFrame, features: DataFrame) -> DataFrame:
    """item_idx → signature (sorted array of features, empty when featureless)."""
    sig = features.groupBy("item_idx").agg(F.array_sort(F.collect_list("feature")).alias("sig"))
    return (items.select("item_idx").join(sig, "item_idx", "left")
            .withColumn("sig", F.coalesce(F.col("sig"), F.array().cast("array<string>"))))


def content_topn(train: DataFrame, items: DataFrame, features: DataFrame, n: int = 10,
                 profiles: DataFrame | None = None, users: DataFrame | None = None,
                 seen: DataFrame | None = None, pop_weight: float = C.CBF_POP_WEIGHT,
                 raw: bool = False, feature_cols: list[str] | None = None) -> DataFrame:
    """Top-n unseen by cosine + 0.05·log1p(pop) for every user with a profile.

    ``profiles``/``users``/``seen`` default to those of ``train``; pass overrides for
    session profiles (B07) or serving seen sets.
    """
    profiles = user_profiles(train, features) if profiles is None else profiles
    users = users_with_profile(train) if users is None else users
    seen = train if seen is None else seen
    feats = feature_cols or feature_names(features)
    asked = (users.select("user_idx").distinct().join(dense_profiles(profiles, feats), "user_idx", "left")
             .join(seen_lists(seen), "user_idx", "left")
             .select(F.col("user_idx").alias("qid"), F.col("profile").alias("vec"), F.lit(0.0).alias("off"),
                     F.lit(n).alias("n"), F.col("_seen").alias("seen")))
    ranked = blocked_topn(asked, content_blocks(train, items, features, feats, pop_weight), n)
    return ranked.select(F.col("qid").alias("user_idx"), "rank", "item_idx",
                         F.col("score") if raw else F.round("score", 6).alias("score"))


def feature_names(features: DataFrame) -> list[str]:
    """The configured features that occur, sorted (one name per feature column)."""
    return [r[0] for r in features.select("feature").distinct().orderBy("feature").collect()]


def content_blocks(train: DataFrame, items: DataFrame, features: DataFrame, feature_cols: list[str],
                   pop_weight: float = C.CBF_POP_WEIGHT) -> DataFrame:
    """Item blocks of the content scorer."""
    return item_blocks(content_side(train, items, features, feature_cols, pop_weight))


def content_side(train: DataFrame, items: DataFrame, features: DataFrame, feature_cols: list[str],
                 pop_weight: float = C.CBF_POP_WEIGHT) -> DataFrame:
    """(item_idx, vec, bias): unit vectors in ``feature_cols`` order, weighted popularity."""
    side = item_popularity(items, train).join(dense_item_vectors(features, feature_cols), "item_idx", "left")
    return side.select("item_idx", "vec", (F.col("pop") * F.lit(float(pop_weight))).alias("bias"))


# ── EMA updates (B08–B10) ────────────────────────────────────────────────────
def dense_profiles(profiles: DataFrame, feature_cols: list[str]) -> DataFrame:
    """Long profile rows → ``(user_idx, profile array<double>)`` in config order."""
    if not feature_cols:
        return profiles.select("user_idx", F.array().cast("array<double>").alias("profile")).distinct()
    pos = {f: i for i, f in enumerate(feature_cols)}
    mapping = F.create_map(*[x for f, i in pos.items() for x in (F.lit(f), F.lit(i))])
    entries = profiles.withColumn("_pos", mapping[F.col("feature")])
    arr = (entries.groupBy("user_idx")
           .agg(F.map_from_entries(F.collect_list(F.struct("_pos", "value"))).alias("_m")))
    return arr.select("user_idx", F.transform(
        F.sequence(F.lit(0), F.lit(len(feature_cols) - 1)),
        lambda i: F.coalesce(F.col("_m")[i], F.lit(0.0))).alias("profile"))


def dense_item_vectors(features: DataFrame, feature_cols: list[str]) -> DataFrame:
    vec = item_unit_vectors(features)
    prof = dense_profiles(vec.withColumnRenamed("item_idx", "user_idx"), feature_cols)
    return prof.withColumnRenamed("user_idx", "item_idx").withColumnRenamed("profile", "vec")


def ema_preview(requests: DataFrame, base_profiles: DataFrame, item_vecs: DataFrame,
                n_features: int) -> DataFrame:
    """One EMA step per request row without persisting.

    ``requests``: user_idx, item_idx, rating (effective), engagement. Unknown items
    give α = 0 and a null preview; unknown users start from zeros.
    """
    from rankloom.functions.columns import ema_step
    zeros = F.array_repeat(F.lit(0.0), n_features)
    # profiles last: they aren't dealt again by item, and what follows finds the rows dealt by user
    r = (requests.join(item_vecs, "item_idx", "left")
         .join(base_profiles, "user_idx", "left")
         .withColumn("_p", F.coalesce(F.col("profile"), zeros)))
    alpha = F.when(F.col("vec").isNull(), F.lit(0.0)).otherwise(
        ema_alpha(F.col("rating"), F.col("engagement")))
    r = r.withColumn("alpha", alpha)
    return r.withColumn("preview", F.when(F.col("alpha") > 0,
                                          ema_step(F.col("_p"), F.col("vec"), F.col("alpha"))))
