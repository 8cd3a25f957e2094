"""Mixing sources to target weights by entropy balancing.

Sources have weights; together they get ``share`` times all words. A source's target stops at ``most`` times its
words, and what is over is shared by weight among the others until none is above (``targets``).

Each document gets a rate, how often the mix takes it. Of all rates between 0 and ``most`` that meet each source's
token constraint, those that depart least from 1 (Kullback-Leibler) are ``least(most, exp(tilt * size / mean))``, an
exponential tilt of documents by their size with one dual variable a source. The dual is convex, and its
gradient and curvature are sums over documents: every Newton iteration is one aggregation, over the different
sizes of each source with their numbers rather than over documents, for all sources at once. A bracket guards
the steps: one that leaves it, or that didn't halve the residual, is replaced by the bracket's middle. Sums are of
fixed-point numbers, so that they don't depend on the order of rows; a source whose target is at the stop takes
every document ``most`` times.

Rates become whole copies by systematic rounding: with the documents of a source in the order of falling size,
copies of a document are how many whole numbers the running sum of rates passes in it, from a start. Each
document gets its rate rounded up or down, so none exceeds ``most`` times its size, and the words of a source depart
from the target by at most one of its largest documents; of ``STARTS`` starts the one that comes nearest is taken.
Running sums are of sizes first, then by number within a size, so that neither a hot source nor a hot size meets in
one task: there documents are numbered in ranges of the order.

A size is the number of words; null and empty texts, and texts without words, have size 0 and are never taken. A
null source is a source of its own, after all others; repeated rows and ids are documents of their own; an empty
table gives no rows; sources without words have the target 0. Other columns neither clash nor matter. Memory:
one text a task. Reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.llm.common import col_of, kept, numbered

#: Fixed point of sums; starts of the rounding that are tried; Newton iterations at most.
SCALE, STARTS, MOST_ROUNDS = 1024, 64, 300
WEIGHTS = (5.0, 2.0, 1.0)


def fixed_sum(value: Column) -> Column:
    """A sum of doubles that doesn't depend on their order."""
    return (F.sum(F.round(value * SCALE).cast("decimal(38,0)")) / SCALE).cast("double")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(key, source_size, target) of sources (key, source_size); weights repeat in the order of keys.

    Each round shares what the stopped sources leave among the others and stops those that get more than ``most``
    times their size; a stopped one stays stopped, as the others' shares only grow. Two sums a round come to the driver.
    """
    if share > most:
        raise ValueError("the sources can't give so much")
    place = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("number") - 1, F.lit(len(weights))) + 1).cast("int"))
    now = kept(numbered(sources, [F.asc("key")], "number", "sources").withColumn("weight", place).drop("number"), "sources")
    total = share * (now.agg(F.sum("source_size")).first()[0] or 0)
    cap = F.col("source_size") * most
    level = stopped = None
    while True:
        # Words for each unit of weight: a source is above if this gives it more than it may have.
        full = F.col("weight") * level > cap if level is not None else F.lit(False)
        n, held, rest = now.agg(F.sum(full.cast("long")), F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)), F.coalesce(fixed_sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if n == stopped or not rest:
            break
        stopped, level = n, (total - held) / rest
    target = F.least(cap, F.col("weight") * level) if level is not None else F.lit(0.0)
    return now.select("key", "source_size", target.cast("double").alias("target"))


def tilts(sizes: DataFrame, wanted: DataFrame, most: float = 2.0) -> DataFrame:
    """(key, tilt, mean) of every source: Newton iterations on the dual, from the numbers ``n`` of each (key, size).

    ``tilt`` is null where all documents have the rate ``most``, as where the target is at its stop.
    """
    shape = sizes.where("size > 0").groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("words"), F.sum("n").alias("documents"), F.min("size").alias("least"))
    mean, top = F.col("words") / F.col("documents"), math.log(most)
    # At the bracket's ends every document's rate is beyond what the mean rate has to be.
    low = F.when(F.col("target") < F.col("words"), F.log(F.col("target") / F.col("words")) * mean / F.col("least")).otherwise(0.0)
    high = F.when(F.col("target") > F.col("words"), top * mean / F.col("least")).otherwise(0.0)
    full = F.col("target") >= most * F.col("words") - 0.5
    state = kept(
        wanted.join(shape, "key").select("key", "target", mean.alias("mean"), F.when(full, None).otherwise(F.lit(0.0)).alias("tilt"), low.alias("low"), high.alias("high"), F.lit(None).cast("double").alias("was"), full.alias("done")),
        "tilts",
    )
    for _ in range(MOST_ROUNDS):
        if state.where("not done").isEmpty():
            return state.select("key", "tilt", "mean")
        u = F.col("tilt") * F.col("size") / F.col("mean")
        rate = F.least(F.lit(most), F.exp(F.least(u, F.lit(top))))
        each = sizes.where("size > 0").join(state.where("not done").select("key", "tilt", "mean"), "key")
        sums = each.groupBy("key").agg(fixed_sum(F.col("n") * F.col("size") * rate).alias("words"), fixed_sum(F.when(u < top, F.col("n") * F.col("size") * F.col("size") / F.col("mean") * rate).otherwise(0.0)).alias("curve"))
        off = F.col("words") - F.col("target")
        near = F.abs(off) <= F.greatest(F.lit(0.5), F.col("target") * 1e-7)
        step = state.join(sums, "key", "left").withColumn("off", off).withColumn("near", F.coalesce(near, F.lit(True)))
        step = step.withColumn("low", F.when(F.col("off") < 0, F.col("tilt")).otherwise(F.col("low"))).withColumn("high", F.when(F.col("off") > 0, F.col("tilt")).otherwise(F.col("high")))
        newton = F.col("tilt") - F.try_divide("off", "curve")
        good = (newton > F.col("low")) & (newton < F.col("high")) & (F.col("was").isNull() | (F.abs("off") <= F.col("was") / 2))
        moved = F.when(good, newton).otherwise((F.col("low") + F.col("high")) / 2)
        done = F.col("done") | F.col("near")
        state = kept(step.select("key", "target", "mean", F.when(done, F.col("tilt")).otherwise(moved).alias("tilt"), "low", "high", F.abs("off").alias("was"), done.alias("done")), "tilts")
    raise RuntimeError(f"the tilts did not settle in {MOST_ROUNDS} iterations")


def copies(begin: Column, end: Column, start: Column) -> Column:
    """Whole numbers passed from one running sum of rates to the next."""
    return F.floor(end + start) - F.floor(begin + start)


def mix(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(id_col, size, source_size, target, taken) of every document; ``taken`` is ``size`` times its copies."""
    size = F.regexp_count(F.coalesce(col_of(documents, text_col), F.lit("")), F.lit("[^ \\t-\\r]+")).cast("long")
    # Keys in the order of code points, null last.
    key = F.coalesce(F.concat(F.lit("k"), col_of(documents, source_col).cast("string")), F.lit("n"))
    rows = kept(documents.select(col_of(documents, id_col).alias("id"), key.alias("key"), size.alias("size")), "sizes")
    placed = kept(numbered(rows, [F.asc("key"), F.desc("size"), F.asc("id")], "number", "placed"), "placed")
    sizes = kept(placed.groupBy("key", "size").agg(F.count("*").alias("n"), F.min("number").alias("first")), "histogram")
    wanted = kept(targets(sizes.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, share, most), "targets")
    tilt = tilts(sizes, wanted, most)
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("tilt").isNull(), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(math.log(most))))))
    rated = sizes.join(tilt, "key", "left").select("key", "size", "n", "first", rate.alias("rate"))
    # A source has as many rows here as different sizes.
    before = F.sum(F.col("n") * F.col("rate")).over(Window.partitionBy("key").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1))
    rated = kept(rated.withColumn("before", F.coalesce(before, F.lit(0.0))), "rates")
    tried = [fixed_sum(F.col("size") * copies(F.col("before"), F.col("before") + F.col("n") * F.col("rate"), F.lit(k / STARTS))).alias(f"t{k}") for k in range(STARTS)]
    off = rated.groupBy("key").agg(*tried).join(wanted.select("key", "target"), "key")
    best = F.array_min(F.array(*(F.struct(F.abs(F.col(f"t{k}") - F.col("target")).alias("off"), F.lit(k / STARTS).alias("start")) for k in range(STARTS))))["start"]
    per_size = kept(rated.join(off.select("key", best.alias("start")), "key").join(wanted, "key").drop("n"), "per_size")
    both = placed.join(per_size, ["key", "size"])
    at = F.col("number") - F.col("first")
    some = copies(F.col("before") + at * F.col("rate"), F.col("before") + (at + 1) * F.col("rate"), F.col("start"))
    taken = F.col("size") * F.greatest(F.floor("rate"), F.least(F.ceil("rate"), some))
    return both.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"))
