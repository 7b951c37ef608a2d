"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

A source's target of t words over s words gives every document floor(t / s)
certain copies. The words left over are sampled with probability proportional to
size: a document's inclusion probability for one copy more is rate * size, where
the source's rate makes the probabilities' words add up to the words left over;
size classes that would pass one are taken for certain, first. The others are
ranked by random odds over inclusion odds, (u / (1 - u)) / (p / (1 - p)), and the
sample takes the lowest ranks until the words are reached; where the next document
would exceed them, the order goes on with documents that still fit, until none
does. The order is cut by sums over rank bins and one bin's rows, so that no
source, however large, is sorted in one task, and the state between rounds is one
row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.scratch import Scratch

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: rows of a source that meet in one rank bin, about; size classes per power of two
BIN_ROWS, CLASSES = 5000, 4
#: a sampled document's inclusion probability at most (those above are certain by their class)
ALMOST = 1.0 - 1e-6


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target: ``share`` of all words dealt by weight, at most ``most`` times the source.

    Sources by code point, null last, take the weights in turn. Filling is exact: sources ordered by
    limit over weight, those that a common level would lift over their limit form a prefix of that order.
    The table has one row per source; its windows order that table, not documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    wheel = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.get(wheel, ((F.row_number().over(by_name) - 1) % len(weights)).cast("int")))
    per = per.withColumn("limit", F.col("source_size") * F.lit(float(most)))
    level_order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = level_order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    load = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / load)
    fits = F.col("level") * F.col("weight") <= F.col("limit")
    per = per.withColumn("common", F.max(F.when(fits, F.col("level"))).over(everything))
    target = F.least(F.col("common") * F.col("weight"), F.col("limit"))  # least() skips nulls
    return per.select("source", "source_size", target.alias("target"))


def _chance(doc_id: Column, text_key: Column, seed: int) -> Column:
    """A uniform number in (0, 1) that depends on the row and the seed alone."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, text_key), 12)
    return (h.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def size_class(size: Column) -> Column:
    return F.floor(F.log2(size) * CLASSES).cast("int")


def inclusion(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """source, rate, top, certain: probabilities rate * size of the classes up to ``top`` and the words of those above.

    The classes above ``top`` are certain: going down from the largest, a class is certain while the rate
    that the rest would need gives its documents more than one. Sums are exact, so reruns agree. The window
    orders a source's classes (CLASSES per power of two), not documents.
    """
    square = F.col("size").cast("decimal(19,0)") * F.col("size").cast("decimal(18,0)")
    per = sizes.groupBy("source", size_class(F.col("size")).alias("class")).agg(
        F.count("*").alias("n"), F.sum("size").alias("words"), F.sum(square).alias("squares"))
    c, p = per.alias("c"), plan.alias("p")
    per = c.join(p, F.col("c.source").eqNullSafe(F.col("p.source")), "inner").select("c.*", "p.gap")
    down = Window.partitionBy("source").orderBy(F.col("class").desc())
    above = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("squares").over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing)).cast("double")
    per = per.withColumn("certain", above).withColumn("rate", (F.col("gap") - F.col("certain")) / rest)
    fits = F.col("rate") * F.col("words") <= F.col("n") * F.lit(1.0 + 1e-12)
    best = per.groupBy("source").agg(F.max(F.when(fits, F.struct("class", "rate", "certain"))).alias("b"))
    return best.select("source", F.col("b.rate").alias("rate"), F.col("b.class").alias("top"), F.col("b.certain").alias("certain"))


def _cut(rows: DataFrame, plan: DataFrame, bins: int) -> DataFrame:
    """``plan`` with the rank below which one more round takes rows that fit, and the words then left."""
    fit = rows.where(F.col("size") <= F.col("gap"))
    per_bin = fit.groupBy("source", "gap", "bin").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    per_bin = per_bin.withColumn("upto", F.sum("words").over(upto))
    edge = per_bin.where(F.col("upto") > F.col("gap")).groupBy("source").agg(
        F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("base"))).alias("edge"))
    f, e = fit.alias("f"), edge.alias("e")
    same_bin = F.col("f.source").eqNullSafe(F.col("e.source")) & (F.col("f.bin") == F.col("e.edge.bin"))
    inside = f.join(e, same_bin, "inner").select("f.source", "f.size", "f.gap", "f.rank", "e.edge")
    by_rank = Window.partitionBy("source").orderBy("rank").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("sum", F.col("edge.base") + F.sum("size").over(by_rank))
    last = inside.groupBy("source").agg(
        F.max(F.when(F.col("sum") <= F.col("gap"), F.col("rank"))).alias("rank"),
        F.max(F.when(F.col("sum") <= F.col("gap"), F.col("sum"))).alias("sum"),
        F.first("edge").alias("edge"))
    total = per_bin.groupBy("source").agg(F.sum("words").alias("all_words"))
    p, t, c = plan.alias("p"), total.alias("t"), last.alias("c")
    joined = p.join(t, F.col("p.source").eqNullSafe(F.col("t.source")), "left").join(
        c, F.col("p.source").eqNullSafe(F.col("c.source")), "left")
    # below the edge bin everything that fits is taken; without an edge bin all of it
    cut = F.when(F.col("t.all_words").isNull(), F.lit(-1.0)).when(F.col("c.edge").isNull(), F.lit(1.0)).otherwise(
        F.coalesce(F.col("c.rank"), F.col("c.edge.bin") / F.lit(float(bins)) - F.lit(1e-18)))
    used = F.when(F.col("t.all_words").isNull(), F.lit(0)).when(F.col("c.edge").isNull(), F.col("t.all_words")).otherwise(
        F.coalesce(F.col("c.sum"), F.col("c.edge.base")))
    return joined.select("p.source", "p.source_size", "p.target", "p.copies", "p.rate", "p.top",
                         F.concat("p.cuts", F.array(F.struct(F.col("p.gap").alias("fit"), cut.alias("cut")))).alias("cuts"),
                         (F.col("p.gap") - used).alias("gap"))


def _taken(size: Column, rank: Column, cuts: Column) -> Column:
    return F.exists(cuts, lambda c: (size <= c["fit"]) & (rank <= c["cut"]))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST,
        seed: int = 20240229, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken (= copies * size) and copies for every row of ``docs``.

    ``keep``: further columns of ``docs`` to return. Null or empty text: size 0, no copy. Null source: a
    source of its own, last. Rows repeated in full get the same decision; where they don't fit together,
    their source's order ends with them. No rows: no rows. The result depends on rows, weights and seed
    only, so reruns agree whatever the partitioning.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    base = docs.select("doc_id", "source", *keep, word_count(F.col("text")).alias("size"),
                       _chance(F.col("doc_id"), F.xxhash64("text"), seed).alias("chance"))
    narrow = scratch.table(base.select("doc_id", "source", "size", "chance"), "sizes")
    plan = source_targets(narrow, weights, share, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(ratio).cast("int")
    plan = plan.select("source", "source_size", "target", copies.alias("copies"),
                       F.greatest(F.col("target") - copies * F.col("source_size"), F.lit(0.0)).alias("gap"))
    plan = scratch.table(plan, "targets")
    some = narrow.where("size > 0")
    p, i = plan.alias("p"), inclusion(some, plan).alias("i")
    plan = p.join(i, F.col("p.source").eqNullSafe(F.col("i.source")), "left").select(
        "p.source", "p.source_size", "p.target", "p.copies", "i.rate", "i.top",
        F.array().cast("array<struct<fit:double,cut:double>>").alias("cuts"),
        (F.col("p.gap") - F.coalesce("i.certain", F.lit(0))).alias("gap"))
    plan = scratch.table(plan, "plan0")
    bins = max(64, -(-some.count() // BIN_ROWS))

    def ranked(rows: DataFrame, plan: DataFrame) -> DataFrame:
        r, p = rows.alias("r"), plan.alias("p")
        chance = F.least(F.col("p.rate") * F.col("r.size"), F.lit(ALMOST))
        odds = F.greatest(chance / (F.lit(1.0) - chance), F.lit(1e-300))
        df = r.join(p, F.col("r.source").eqNullSafe(F.col("p.source")), "inner").select(
            "r.*", "p.source_size", "p.target", "p.copies", "p.cuts", "p.gap",
            ((F.col("r.size") > 0) & (size_class(F.greatest("r.size", F.lit(1))) > F.col("p.top"))).alias("certain"),
            (F.col("r.chance") / (F.lit(1.0) - F.col("r.chance")) / odds).alias("pareto"))
        # a monotone map of the Pareto rank to (0, 1)
        return df.withColumn("rank", F.col("pareto") / (F.lit(1.0) + F.col("pareto"))).drop("pareto")

    k, open_words = 0, None
    while open_words != (open_words := plan.agg(F.sum(F.floor("gap"))).first()[0]):    # until a round takes nothing
        rows = ranked(some, plan).where(~F.col("certain") & (F.col("gap") >= 1) & ~_taken(F.col("size"), F.col("rank"), F.col("cuts")))
        rows = rows.withColumn("bin", F.least(F.floor(F.col("rank") * bins), F.lit(bins - 1)).cast("long"))
        k += 1
        plan = scratch.table(_cut(rows, plan, bins), f"plan{k}")
    done = ranked(base if keep else narrow, plan)
    more = F.col("certain") | _taken(F.col("size"), F.col("rank"), F.col("cuts"))
    extra = F.when((F.col("size") > 0) & more, F.lit(1)).otherwise(F.lit(0))
    number = F.when(F.col("size") > 0, F.col("copies") + extra).otherwise(F.lit(0)).cast("int")
    return done.select("doc_id", *keep, "size", "source_size", "target",
                       (number * F.col("size")).cast("long").alias("taken"), number.alias("copies"))
