"""What can be derived from given instances by transforms, and by how few steps, for many roots at once.

Endpoints are given instances and what applications of transforms produce. In a round each carries ``anc``, the given ids
and transforms above it, ``above``, its ancestor endpoints in the order in which they were added, and ``apps``,
the applications of its derivation. A round matches with requirements only what the last one made, binds only
transforms that gained an input in a root, there in bindings that use something new, applies them, and keeps
what has a new (root, transform, product, anc). A transform doesn't apply where
it is above one of its inputs, so there are finitely many of these keys and cyclic transforms end.

Of endpoints with the same key the ``alternatives`` with the fewest applications, then the smallest ids, stay;
``Closure.cut`` names the roots in which others went. With one alternative, sums of shared sub-plans are taken as they
are found, so where several plans share steps another plan may be shorter; where nothing was cut, all are there.

Rounds go over *shapes*, roots that differ only in names (``plans.shapes``), so their arrays are as many as there are
different ways to be given something. What ``Closure`` returns for roots has rows of constant width: endpoints
without lineage, and lineage as edges. Bindings of all transforms are made together, one join for each requirement
number; linked requirements are joined on their nearest conforming ancestor. Requirements of a transform that aren't
linked multiply within a root.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.operators.match import containment_join
from loomstead.plans.rounds import settled
from loomstead.plans.shapes import Shapes, mattering, shapes_of

FIT = ["root", "transform", "req_ix", "id", "anc", "above", "apps"]
#: More links between requirements than this aren't declarations but data, and aren't collected.
MOST_LINKS = 100_000
#: So many requirements are matched within a row, without a join.
FEW = 200
ENDPOINT = ["root", "id", "transform", "prod_ix", "props", "anc", "above", "apps", "round"]
#: An endpoint and the application that made it.
MADE = [*ENDPOINT, "app", "uses"]


def _merged(*arrays: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*arrays)))


def given_endpoints(givens: DataFrame) -> DataFrame:
    """Endpoints of givens (root, id, props[, parents]): ``parents`` are given ids above, nearest last."""
    parents = F.coalesce("parents", F.array()).cast("array<string>") if "parents" in givens.columns else F.array().cast("array<string>")
    none = F.lit(None).cast("string")
    return givens.select("root", "id", none.alias("transform"), F.lit(None).cast("int").alias("prod_ix"), "props", _merged(F.array("id"), parents).alias("anc"), parents.alias("above"), F.array().cast("array<string>").alias("apps"), F.lit(0).alias("round"))


def fitting(endpoints: DataFrame, requirements: DataFrame) -> DataFrame:
    """(root, transform, req_ix, id, anc, above, apps): which endpoints meet which requirements."""
    fits = containment_join(endpoints, requirements, ["root", "id"], ["transform", "req_ix"])
    return fits.join(endpoints.select("root", "id", "anc", "above", "apps"), ["root", "id"]).select(*FIT)


def fitting_few(endpoints: DataFrame, requirements: list[tuple[str, int, list[str]]]) -> DataFrame:
    """``fitting`` with ``round``, for a few requirements: each endpoint looks them all through, and nothing moves."""
    asked = json.dumps([{"transform": t, "req_ix": k, "need": p or []} for t, k, p in requirements])
    each = F.from_json(F.lit(asked), "array<struct<transform: string, req_ix: int, need: array<string>>>")
    have = F.coalesce("props", F.array().cast("array<string>"))
    met = F.filter(each, lambda r: F.size(F.array_except(r["need"], have)) == 0)
    return endpoints.withColumn("__met", F.explode(met)).select("root", "__met.transform", "__met.req_ix", "id", "anc", "above", "apps", "round")


def bindings(fits: DataFrame, requirements: DataFrame, links: list[tuple[str, int, int]], depth: int) -> DataFrame:
    """(root, transform, uses, anc, above, apps): bindings of every transform that use a row of ``fits`` that is ``fresh``.

    ``fits`` is ``fitting`` of all endpoints with the mark; only transforms that have a fresh row in a root are bound
    there. A linked requirement, which comes after its parents, is joined by an equality on what its first parent got.
    """
    allowed = fits.where(~F.array_contains("anc", F.concat(F.lit("@"), "transform")))
    # A transform with a requirement that nothing in the root meets has no bindings there.
    need = requirements.groupBy("transform").agg(F.count("*").cast("int").alias("need"))
    full = allowed.groupBy("root", "transform").agg(F.size(F.collect_set("req_ix")).alias("met"), F.max("fresh").alias("any")).join(need, "transform").where("met = need and any").select("root", "transform", "need")
    able = allowed.join(full, ["root", "transform"]).withColumn("needs", F.array().cast("array<struct<parent: int, ancestor: string>>"))
    first: dict[str, int] = {}
    if links:
        parents: dict[tuple[str, int], list[int]] = {}
        for t, k, p in sorted(set(links)):
            parents.setdefault((t, k), []).append(p)
        first = {f"{k} {t}": ps[0] for (t, k), ps in parents.items()}
        linked = fits.sparkSession.createDataFrame([(t, k, ps) for (t, k), ps in parents.items()], "transform string, req_ix int, parents array<int>")
        rows = able.drop("needs").join(F.broadcast(linked), ["transform", "req_ix"], "left")
        at = ["root", "transform", "req_ix", "id"]
        up = rows.where("parents is not null").select(*at, F.explode("parents").alias("parent"), "above").select(*at, "parent", F.posexplode("above").alias("ord", "ancestor"))
        meets = fits.select("root", "transform", F.col("req_ix").alias("parent"), F.col("id").alias("ancestor"))
        near = up.join(meets, ["root", "transform", "parent", "ancestor"]).groupBy(*at, "parent").agg(F.max_by("ancestor", "ord").alias("ancestor"))
        needs = near.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("parent", "ancestor"))).alias("needs"))
        bound = rows.where("parents is not null").join(needs, at).where(F.size("needs") == F.size("parents"))
        able = rows.where("parents is null").drop("parents").withColumn("needs", F.array().cast("array<struct<parent: int, ancestor: string>>")).unionByName(bound.drop("parents"))
    if depth > 1:
        able = settled(able)
        # Only as many joins as the widest transform that can be bound now has requirements.
        depth = min(depth, able.agg(F.max("need")).first()[0] or 1)
    start = able.where("req_ix = 0").select("root", "transform", "need", F.array("id").alias("uses"), "anc", "above", "apps", "fresh")
    out, done = start, None
    for k in range(depth):
        if k:
            mine = able.where(F.col("req_ix") == k).select("root", "transform", F.coalesce(F.get("needs", F.lit(0))["ancestor"], F.lit("")).alias("on"), F.col("id").alias("i"), F.col("anc").alias("a"), F.col("above").alias("u"), F.col("apps").alias("p"), F.col("fresh").alias("f"), "needs")
            own = {t.split(" ", 1)[1]: p for t, p in first.items() if t.split(" ", 1)[0] == str(k)}
            parent = F.try_element_at(F.from_json(F.lit(json.dumps(own)), "map<string, int>"), F.col("transform"))
            both = out.where("need > size(uses)").withColumn("on", F.coalesce(F.get("uses", parent), F.lit(""))).join(mine, ["root", "transform", "on"])
            both = both.where(~F.array_contains("uses", F.col("i")) & F.forall("needs", lambda n: F.get("uses", n["parent"]) == n["ancestor"]))
            out = both.select("root", "transform", "need", F.concat("uses", F.array("i")).alias("uses"), _merged(F.col("anc"), F.col("a")).alias("anc"), F.concat("above", F.array_except("u", "above")).alias("above"), F.array_union("apps", "p").alias("apps"), (F.col("fresh") | F.col("f")).alias("fresh"))
            # Short plans: with many joins at once the engine's planning takes longer than they do.
            out = settled(out) if k % 2 and k + 1 < depth else out
        finished = out.where((F.size("uses") == F.col("need")) & F.col("fresh"))
        done = finished if done is None else done.unionByName(finished)
    return done.select("root", "transform", "uses", "anc", "above", "apps")


def apply_transform_rows(bound: DataFrame, products: DataFrame, round_: int) -> tuple[DataFrame, DataFrame]:
    """(produced endpoints with ``app`` and ``uses``, applications (root, app, transform, uses, round)) of bindings."""
    app = F.substring(F.sha2(F.concat_ws("|", F.col("root").cast("string"), "transform", F.array_join("uses", ",")), 256), 1, 16)
    apps = bound.withColumn("app", app)
    made = apps.join(products.select("transform", "prod_ix", "props"), "transform")
    # Inputs are above what they produce, after and instead of what they inherit.
    above = F.concat(F.array_except("above", "uses"), "uses")
    anc = _merged(F.col("anc"), F.array(F.concat(F.lit("@"), "transform")))
    out = made.select("root", F.concat_ws(":", "app", "prod_ix").alias("id"), "transform", "prod_ix", "props", anc.alias("anc"), above.alias("above"), F.array_sort(F.array_union("apps", F.array("app"))).alias("apps"), F.lit(round_).alias("round"), "app", "uses")
    return out, apps.select("root", "app", "transform", "uses", F.lit(round_).alias("round"))


def lineage_propagate(endpoints: DataFrame) -> DataFrame:
    """(root, child, ancestor, ord) edges of every endpoint to all its ancestors."""
    return endpoints.select("root", F.col("id").alias("child"), F.posexplode("above").alias("ord", "ancestor"))


def guarded(made: DataFrame, seen: DataFrame, alternatives: int = 1) -> DataFrame:
    """New endpoints with ``dropped``: of each key's, beyond those seen, the first by number of applications and id stay."""
    key = ["root", "transform", "prod_ix", "anc"]
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.size("apps"), "id"))
    known = seen.where("transform is not null").groupBy(*key).agg(F.count("*").alias("__known"))
    both = made.withColumn("__place", place).join(known, key, "left")
    return both.select(*made.columns, (F.col("__place") + F.coalesce("__known", F.lit(0)) > alternatives).alias("dropped"))


def cycle_guard(made: DataFrame, seen: DataFrame) -> DataFrame:
    """Of new endpoints the best one for each key that hasn't been seen: fewest applications, then smallest id."""
    return guarded(made, seen).where("not dropped").select(*ENDPOINT)


def rounds(givens: DataFrame, requirements: DataFrame, products: DataFrame, max_rounds: int = 64, alternatives: int = 1) -> tuple[DataFrame, DataFrame]:
    """(endpoints with their application, (root) in which alternatives were dropped), root by root as given.

    Transforms are few: their links and the number of requirements are read on the driver.
    """
    rows = requirements.select("transform", "req_ix", "props", "parent_ix").limit(MOST_LINKS + 1).collect()
    links = sorted({(t, k, p) for t, k, _, up in rows for p in up or ()})
    if max(len(rows), len(links)) > MOST_LINKS:
        raise ValueError(f"there are more than {MOST_LINKS} requirements or links between them")
    seen = new = settled(given_endpoints(givens).withColumn("app", F.lit(None).cast("string")).withColumn("uses", F.lit(None).cast("array<string>")))
    cut, known = seen.limit(0).select("root"), None
    if not rows:
        return seen, cut
    few = [(t, k, p) for t, k, p, _ in rows] if len(rows) <= FEW else None
    # Declared rows: they are in the plan, and no job is needed to count them.
    requirements = requirements.sparkSession.createDataFrame([(t, k) for t, k, _, _ in rows], "transform string, req_ix int") if few else requirements
    depth = 1 + max(k for _, k, _, _ in rows)
    for n in range(1, max_rounds + 1):
        if few:
            fits = fitting_few(seen, few).withColumn("fresh", F.col("round") == n - 1).drop("round")
        else:
            fresh = settled(fitting(new, requirements)).withColumn("fresh", F.lit(True))
            fits = fresh if known is None else known.unionByName(fresh)
            known = fits.withColumn("fresh", F.lit(False))
        made, _ = apply_transform_rows(bindings(fits, requirements, links, depth), products, n)
        marked = settled(guarded(made.select(*MADE), seen, alternatives))
        new = marked.where("not dropped").drop("dropped")
        cut = cut.unionByName(marked.where("dropped").select("root"))
        if new.isEmpty():
            return seen, cut.distinct()
        seen = seen.unionByName(new)  # all parts are checkpointed
    raise RuntimeError(f"derivation did not end in {max_rounds} rounds")


def applications_of(endpoints: DataFrame) -> DataFrame:
    """(root, app, transform, uses, round) of what made the endpoints, each once."""
    return endpoints.where("app is not null").select("root", "app", "transform", "uses", "round").dropDuplicates(["root", "app"])


@dataclass
class Closure:
    """What can be derived below each root: found shape by shape, given to roots by a join."""

    found: DataFrame
    cut: DataFrame
    shapes: Shapes
    source: DataFrame

    def endpoints(self) -> DataFrame:
        """(root, id, transform, prod_ix, props, round), givens included."""
        given = given_endpoints(self.source).select("root", F.col("id").cast("string").alias("id"), "transform", "prod_ix", "props", "round")
        made = self.shapes.to_roots(self.found.where("transform is not null").select(*given.columns))
        return given.unionByName(made)

    def lineage(self) -> DataFrame:
        """(root, child, ancestor, ord): an edge for each ancestor of an endpoint, nearer ones with larger ``ord``."""
        return self.shapes.to_roots(lineage_propagate(self.found), ids=["child", "ancestor"])

    def applications(self) -> DataFrame:
        """(root, app, transform, uses, round)."""
        return self.shapes.to_roots(applications_of(self.found), lists=["uses"])


def derive(givens: DataFrame, requirements: DataFrame, products: DataFrame, max_rounds: int = 64, alternatives: int = 1, asked: DataFrame | None = None) -> Closure:
    """The closure of givens (root, id, props[, parents]); ``asked``: targets (props) that will be looked for in it."""
    shapes = shapes_of(givens, mattering(*(df.select("props") for df in (requirements, asked) if df is not None)))
    found, cut = rounds(shapes.givens, requirements, products, max_rounds, alternatives)
    return Closure(found, cut, shapes, givens)


def derive_closure(givens: DataFrame, requirements: DataFrame, products: DataFrame, max_rounds: int = 64) -> tuple[DataFrame, DataFrame]:
    """(endpoints with the round they were first derived in, applications) of everything derivable from the givens.

    Endpoints carry their lineage in arrays, as ``derivation_plan`` reads them; ``derive`` has narrow ones.
    """
    closure = derive(givens, requirements, products, max_rounds)
    made = closure.shapes.to_roots(closure.found.where("transform is not null").select(*ENDPOINT), lists=["anc", "above"])
    return given_endpoints(givens).unionByName(made.withColumn("anc", F.array_sort("anc"))), closure.applications()


def derivation_plan(endpoints: DataFrame, applications: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(best endpoint of each (root, target_ix): id and n_steps, the plans' steps in order).

    steps: (root, target_ix, step, transform, app, uses); targets: (target_ix, props). A given that meets a target
    is a plan of no steps.
    """
    hits = containment_join(endpoints, targets, ["root", "id"], ["target_ix"])
    best = hits.join(endpoints.select("root", "id", "apps"), ["root", "id"]).groupBy("root", "target_ix").agg(F.min_by(F.struct("id", "apps"), F.struct(F.size("apps"), "id")).alias("b")).select("root", "target_ix", F.col("b.id").alias("id"), F.col("b.apps").alias("apps"))
    used = best.select("root", "target_ix", F.explode("apps").alias("app")).join(plan_consolidate(applications), ["root", "app"])
    ordered = used.groupBy("root", "target_ix").agg(F.array_sort(F.collect_list(F.struct("round", "transform", "app", "uses"))).alias("s"))
    steps = ordered.select("root", "target_ix", F.posexplode("s").alias("step", "s")).select("root", "target_ix", (F.col("step") + 1).alias("step"), "s.transform", "s.app", "s.uses")
    return best.select("root", "target_ix", "id", F.size("apps").alias("n_steps")), steps


def plan_consolidate(applications: DataFrame) -> DataFrame:
    """Each application once, at the first round in which it was made."""
    return applications.groupBy("root", "app").agg(F.min_by(F.struct("transform", "uses"), "round").alias("a"), F.min("round").alias("round")).select("root", "app", "a.transform", "a.uses", "round")


def batch_derivation(givens: DataFrame, requirements: DataFrame, products: DataFrame, target: list[str]) -> DataFrame:
    """(root, n_steps) of the shortest derivation of one target for each root that has one."""
    targets = givens.sparkSession.createDataFrame([(0, target)], "target_ix int, props array<string>")
    closure = derive(givens, requirements, products, asked=targets)
    best, _ = derivation_plan(closure.found, applications_of(closure.found), targets)
    return closure.shapes.to_roots(best.select("root", "n_steps"))
