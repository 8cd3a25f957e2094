"""Roots with the same givens, but for their names, are derived once.

What can be derived below a root depends on which of the properties that matter its givens have and on how these
are linked, not on their ids. So givens are numbered within a root in the order of these properties, ids only
breaking ties, and the numbered givens are the root's *shape*: a million documents in four languages have four.
Rounds of derivation and searches for plans go over shapes; what they find goes to roots by one join at the end, where
numbers become ids again. A root with more than ``MOST_GIVENS`` givens is a shape of its own, with its own ids, so no
root's givens are gathered that are many; results are the same.

Ids of what is derived are those of the shape: unique within a root, equal in roots of one shape.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.plans.rounds import settled

#: Givens of a root that are numbered; properties that are told apart as mattering, beyond which all of them do.
MOST_GIVENS, MOST_PROPS = 64, 1000
#: So many properties that matter are looked for one by one.
FEW_PROPS = 32


def mattering(*props: DataFrame) -> list[str] | None:
    """The different properties that requirements and targets ask for; None where they are very many."""
    found = None
    for df in props:
        each = df.select(F.explode("props").alias("p"))
        found = each if found is None else found.unionByName(each)
    got = [r[0] for r in found.distinct().limit(MOST_PROPS + 1).collect()]
    return None if len(got) > MOST_PROPS else sorted(p for p in got if p is not None)


@dataclass
class Shapes:
    """``roots``: (root, shape, gids), gids null where ids are the root's own; ``givens``: of shapes (root, id, props, parents)."""

    roots: DataFrame
    givens: DataFrame

    def to_roots(self, df: DataFrame, ids: list[str] = (), lists: list[str] = ()) -> DataFrame:
        """Rows of shapes (column ``root``) as rows of every root that has the shape; ``ids`` and ``lists`` name givens."""
        both = df.withColumnRenamed("root", "shape").join(self.roots, "shape")
        named = {c: _name(F.col(c)) for c in ids} | {c: F.transform(c, _name) for c in lists}
        return both.withColumns(named).select("root", *(c for c in df.columns if c != "root"))


def _name(x: Column) -> Column:
    """A given's number as the root's id; other ids as they are."""
    return F.when(F.col("gids").isNotNull() & x.startswith("#"), F.try_element_at("gids", F.try_add(F.substring(x, 2, 9).try_cast("int"), F.lit(1)))).otherwise(x)


def shapes_of(givens: DataFrame, matter: list[str] | None = None) -> Shapes:
    """Shapes of givens (root, id, props[, parents])."""
    parents = F.coalesce("parents", F.array()).cast("array<string>") if "parents" in givens.columns else F.array().cast("array<string>")
    # sort_array stays in generated code, array_sort compares by a function of two members.
    have = F.sort_array(F.array_distinct(F.coalesce("props", F.array().cast("array<string>"))))
    if matter is not None and len(matter) <= FEW_PROPS:
        have = F.array_compact(F.array(*(F.when(F.array_contains("props", p), F.lit(p)) for p in sorted(matter)))).cast("array<string>")
    elif matter is not None:
        have = F.array_intersect(have, F.array(*map(F.lit, matter)).cast("array<string>"))
    rows = givens.select("root", F.col("id").cast("string").alias("id"), have.alias("props"), parents.alias("parents"))
    # Mostly there are none, and then the givens are read once more and not three times, and joined with nothing.
    many = settled(givens.groupBy("root").count().where(F.col("count") > MOST_GIVENS).select("root"))
    some = not many.isEmpty()
    few = rows.join(many, "root", "left_anti") if some else rows
    entries = few.groupBy("root").agg(F.sort_array(F.collect_list(F.struct("props", F.size("parents").alias("n"), "id", "parents"))).alias("e"))
    gids = F.transform("e", lambda x: x["id"])
    number = lambda x: F.array_position("gids", x)
    label = lambda x: F.when(number(x) > 0, F.concat(F.lit("#"), (number(x) - 1).cast("string"))).otherwise(F.concat(F.lit("?"), x))
    drawn = entries.select("root", "e", gids.alias("gids")).withColumn("canon", F.transform("e", lambda x: F.struct(x["props"].alias("props"), F.transform(x["parents"], label).alias("parents"))))
    numbered = settled(drawn.select("root", F.sha2(F.to_json("canon"), 256).alias("shape"), "gids", "canon"))
    roots = numbered.select("root", "shape", "gids")
    reps = numbered.groupBy("shape").agg(F.any_value("canon").alias("canon")).select(F.col("shape").alias("root"), F.posexplode("canon").alias("at", "x"))
    small = reps.select("root", F.concat(F.lit("#"), F.col("at").cast("string")).alias("id"), "x.props", "x.parents")
    if not some:
        return Shapes(roots, small)
    own = F.concat(F.lit("="), F.col("root").cast("string"))
    roots = roots.unionByName(many.select("root", own.alias("shape"), F.lit(None).cast("array<string>").alias("gids")).where("root is not null"))
    big = rows.join(many, "root", "left_semi")
    return Shapes(roots, small.unionByName(big.select(own.alias("root"), "id", "props", "parents")))
