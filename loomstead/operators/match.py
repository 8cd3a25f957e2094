"""Property subsumption at scale: which instances meet which requirements, and what follows for transforms.

``instances`` has (id, props), ``requirements`` (transform, req_ix, props), ``products`` (transform, prod_ix,
props), ``targets`` (target_ix, props). Properties are arrays of strings.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Parts into which one side of a product is dealt; the other side goes to each.
SALTS = 32
#: More choices than this aren't listed without a scope.
MOST_CHOICES = 1_000_000_000


def product(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """All pairs of rows, as their result is asked for: ``a`` dealt by a hash of ``keys``, ``b`` given to every part."""
    dealt = a.withColumn("__part", F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int"))
    return dealt.join(b.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "__part").drop("__part")


def containment_join(instances: DataFrame, requirements: DataFrame, inst_keys: list[str], req_keys: list[str], inst_props: str = "props", req_props: str = "props") -> DataFrame:
    """(instance keys, requirement keys) of all pairs where the requirement's properties are among the instance's.

    An inverted index: both sides by property, equal properties joined, matches counted against the size of the
    requirement. Instances are first reduced to different property sets, and properties that no requirement has
    aren't moved; requirements without properties, which all instances meet, are joined to all of them. Result
    rows are as many as there are matches. Null property arrays are empty.
    """
    inst = instances.select(*(F.col(k).alias(f"__i_{k}") for k in inst_keys), F.array_sort(F.array_distinct(F.coalesce(inst_props, F.array().cast("array<string>")))).alias("__have"))
    req = requirements.select(*(F.col(k).alias(f"__r_{k}") for k in req_keys), F.array_sort(F.array_distinct(F.coalesce(req_props, F.array().cast("array<string>")))).alias("__need"))
    sets, needs = inst.select("__have").distinct(), req.select("__need").distinct()
    by_need = needs.select("__need", F.explode("__need").alias("__p"))
    by_have = sets.select("__have", F.explode("__have").alias("__p"))
    met = by_have.join(by_need, "__p").groupBy("__have", "__need").agg(F.count("*").alias("__n")).where(F.col("__n") == F.size("__need")).select("__have", "__need")
    rows = inst.join(met, "__have").join(req, "__need")
    free = req.where(F.size("__need") == 0)
    every = product(inst, free, [f"__i_{k}" for k in inst_keys])
    names = [*(F.col(f"__i_{k}").alias(k) for k in inst_keys), *(F.col(f"__r_{k}").alias(k) for k in req_keys)]
    return rows.select(*names).unionByName(every.select(*names))


def producers_of(products: DataFrame, targets: DataFrame) -> DataFrame:
    """(transform, target_ix): transforms with a product that is-a target."""
    return containment_join(products, targets, ["transform"], ["target_ix"]).distinct()


def candidates(requirements: DataFrame, instances: DataFrame) -> DataFrame:
    """(id, transform, req_ix) of all instances that meet a requirement."""
    return containment_join(instances, requirements, ["id"], ["transform", "req_ix"])


def applicable_transforms(requirements: DataFrame, instances: DataFrame) -> DataFrame:
    """Transforms each of whose requirements some instance meets."""
    met = candidates(requirements, instances).groupBy("transform").agg(F.count_distinct("req_ix").alias("met"))
    need = requirements.groupBy("transform").agg(F.count_distinct("req_ix").alias("need"))
    return need.join(met, "transform").where("met = need").select("transform")


def unsatisfied_requirements(requirements: DataFrame, instances: DataFrame) -> DataFrame:
    """(transform, req_ix) that no instance meets."""
    return requirements.select("transform", "req_ix").join(candidates(requirements, instances).select("transform", "req_ix").distinct(), ["transform", "req_ix"], "left_anti")


def satisfies_lineage(candidates_: DataFrame, protos: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Those candidates (id, need) all of whose parent prototypes some ancestor meets.

    protos: (need, proto, props), ancestors: (id, ancestor, props). A need without prototypes is met by all.
    Different property sets of ancestors are matched with prototypes, and candidates look their ancestors' sets up
    in what met: prototypes are never multiplied with the candidates of a hot need.
    """
    have = ancestors.select("id", F.array_sort(F.array_distinct(F.coalesce("props", F.array().cast("array<string>")))).alias("__set"))
    met = containment_join(have.select("__set").distinct(), protos, ["__set"], ["need", "proto"], inst_props="__set").distinct()
    has = candidates_.select("id", "need").distinct().join(have.distinct(), "id").join(met, ["need", "__set"]).groupBy("id", "need").agg(F.count_distinct("proto").alias("__met"))
    asked = protos.groupBy("need").agg(F.count_distinct("proto").alias("__asked"))
    both = candidates_.join(asked, "need", "left").join(has, ["id", "need"], "left")
    return both.where(F.coalesce("__met", F.lit(0)) >= F.coalesce("__asked", F.lit(0))).select(*candidates_.columns)


def lineage_acceptable(candidates_: DataFrame, bound: DataFrame, nearest: DataFrame) -> DataFrame:
    """Candidates (id) whose nearest ancestor for a prototype isn't another than the one bound to it.

    bound: (proto, ancestor), nearest: (id, proto, ancestor).
    """
    other = nearest.join(bound.select("proto", F.col("ancestor").alias("__bound")), "proto").where(F.col("ancestor") != F.col("__bound"))
    return candidates_.join(other.select("id").distinct(), "id", "left_anti")


def nearest_ancestor(edges: DataFrame, protos: DataFrame) -> DataFrame:
    """(child, proto, ancestor): the last-added ancestor that is-a prototype.

    edges: (child, ancestor, ord, props), protos: (proto, props).
    """
    fits = containment_join(edges, protos, ["child", "ancestor", "ord"], ["proto"])
    return fits.groupBy("child", "proto").agg(F.max_by("ancestor", F.struct("ord", "ancestor")).alias("ancestor"))


def lineage_join(children: DataFrame, edges: DataFrame, protos: DataFrame, bound: DataFrame) -> DataFrame:
    """(child, proto, ancestor) where the nearest conforming ancestor of a child is the one bound to the prototype."""
    nearest = nearest_ancestor(edges.join(children.select("child").distinct(), "child", "left_semi"), protos)
    return nearest.join(bound.select("proto", "ancestor").distinct(), ["proto", "ancestor"]).select("child", "proto", "ancestor")


def _check_choices(candidates_: DataFrame, free: list[int]) -> None:
    """Refuses requirements whose candidates multiply beyond ``MOST_CHOICES``; one number comes to the driver."""
    log = candidates_.where(F.col("req_ix").isin(free)).groupBy("req_ix").count().agg(F.sum(F.log10("count"))).first()[0]
    if log is not None and log > math.log10(MOST_CHOICES) + 1e-9:
        raise ValueError(f"without a scope there are more than {MOST_CHOICES} choices")


def bindings_all(candidates_: DataFrame, requirements: int, scope: list[str] | None = None, pinned: dict[int, str] | None = None) -> DataFrame:
    """Every choice of one candidate (id) for each requirement 0, 1, ...: columns ``b0``, ``b1``, ...

    Choices are made within ``scope`` columns, such as a root; ``pinned`` fixes some requirements' ids. The result
    is as large as the product of the candidates within a scope; without one, more than ``MOST_CHOICES`` are refused.
    """
    scope = scope or []
    if not scope:
        _check_choices(candidates_, [k for k in range(requirements) if k not in (pinned or {})])
    out = None
    for k in range(requirements):
        mine = candidates_.where(F.col("req_ix") == k)
        if pinned and k in pinned:
            mine = mine.where(F.col("id") == pinned[k])
        mine = mine.select(*scope, F.col("id").alias(f"b{k}"))
        out = mine if out is None else out.join(mine, scope) if scope else product(out, mine, out.columns)
    if out is None:
        raise ValueError("a transform without requirements has no bindings")
    return out.select(*scope, *(f"b{k}" for k in range(requirements)))


def bindings_valid(candidates_: DataFrame, parent_ix: dict[int, list[int]], nearest: DataFrame, requirements: int, scope: list[str] | None = None) -> DataFrame:
    """Choices with different ids for all requirements, where linked requirements agree in lineage.

    ``parent_ix`` names, for a requirement, those that must be bound to its ancestors; nearest: (child, proto,
    ancestor) with the parent's requirement number as proto. A linked requirement is joined on its ancestor, an
    equality, so no product is made over links. Requirements with neither links nor a scope multiply, and more than
    ``MOST_CHOICES`` of their choices are refused.
    """
    scope = scope or []
    if not scope:
        _check_choices(candidates_, [k for k in range(requirements) if not parent_ix.get(k)])
    out = None
    for k in range(requirements):
        mine = candidates_.where(F.col("req_ix") == k).select(*scope, F.col("id").alias(f"b{k}"))
        on = list(scope)
        for p in sorted(parent_ix.get(k, [])):
            if p >= k:
                raise ValueError("a requirement's parents come before it")
            up = nearest.where(F.col("proto") == p).select(F.col("child").alias(f"b{k}"), F.col("ancestor").alias(f"b{p}"))
            mine = mine.join(up, f"b{k}")
            on.append(f"b{p}")
        if out is None:
            out = mine
        else:
            out = out.join(mine, on) if on else product(out, mine, out.columns)
            for p in range(k):
                out = out.where(F.col(f"b{p}") != F.col(f"b{k}"))
    return out.select(*scope, *(f"b{k}" for k in range(requirements)))
