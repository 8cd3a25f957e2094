"""Goals: several targets that are wanted together, some of them linked, and the plans that reach them.

A goal has targets (goal, target_ix, props, parent_ix); a target's parents are other targets of the goal, and the
endpoint chosen for a parent has to be the nearest conforming ancestor of the one chosen for the target. All
targets get different endpoints. A plan's steps are the applications above all its endpoints, shared ones once, and
the best plan has fewest.

Links make components of targets. Choices are joined within components, all components of all goals at once, in as
many joins as the largest component has targets: ``component`` is a column, and a linked target is joined by an
equality on its first parent's endpoint. So a goal of 512 targets in pairs takes two joins.

One choice for each component makes a plan, and shared steps decide which, so these are searched together, best
first: a partial plan is as good as its steps so far and the most that any open component must at least add,
which is never too much, so plans come out in the order of their number of steps, ties by the endpoints' names,
and the search ends with the ``k`` that are asked for. It is exact up to ``MOST_STATES`` partial plans and
``MOST_CHOICES`` choices of a component, for goals below one root; beyond these, and where the closure has dropped
alternatives, plans are marked with ``exact`` = false.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstead.plans.derive import FEW, MOST_LINKS, applications_of, bindings, derive, fitting, fitting_few
from loomstead.plans.rounds import settled

#: Partial plans of a root's goal, and choices of one of its components, up to which the search is exact.
MOST_STATES, MOST_CHOICES = 20_000, 2_000
TARGETS = "goal int, target_ix int, props array<string>, parent_ix array<int>"


@dataclass
class Place:
    """Where a target stands: in which component of its goal, and after how many of its targets."""

    component: int
    pos: int
    size: int
    parents: list[int]


def places_of(targets: list[tuple[int, int, list[int]]]) -> dict[tuple[int, int], Place]:
    """Places of targets (goal, target_ix, parents): components of the links, parents first, then by number."""
    up = {(g, t): sorted(set(p or ())) for g, t, p in targets}
    if len(up) < len(targets):
        raise ValueError("two targets of a goal have one number")
    beside = defaultdict(set)
    for (g, t), parents in up.items():
        for p in parents:
            if (g, p) not in up or p == t:
                raise ValueError(f"target {t} of goal {g} has no parent {p}")
            beside[g, t].add((g, p))
            beside[g, p].add((g, t))
    out: dict[tuple[int, int], Place] = {}
    number = defaultdict(int)
    for first in sorted(up):
        if first in out:
            continue
        mine, open_ = {first}, [first]
        while open_:
            new = beside[open_.pop()] - mine
            mine |= new
            open_ += new
        left, order = set(mine), []
        while left:
            ready = min(((g, t) for g, t in left if not any((g, p) in left for p in up[g, t])), default=None)
            if ready is None:
                raise ValueError(f"the parents of goal {first[0]} go in a circle")
            order.append(ready)
            left.remove(ready)
        at = {t: k for k, (_, t) in enumerate(order)}
        for g, t in order:
            out[g, t] = Place(number[first[0]], at[t], len(order), [at[p] for p in up[g, t]])
        number[first[0]] += 1
    return out


def choices(endpoints: DataFrame, targets: DataFrame) -> tuple[DataFrame, dict[tuple[int, int], Place]]:
    """(root, goal, component, uses, apps): endpoints for the targets of each component, in the order of their places.

    ``endpoints``: (root, id, props, anc, above, apps, round). Targets are declared, and read on the driver for their places.
    """
    rows = targets.select("goal", "target_ix", "props", "parent_ix").limit(MOST_LINKS + 1).collect()
    if len(rows) > MOST_LINKS:
        raise ValueError(f"there are more than {MOST_LINKS} targets")
    places = places_of([(r["goal"], r["target_ix"], r["parent_ix"]) for r in rows])
    spark = endpoints.sparkSession
    # A component is bound as a transform is, with its targets by their places as requirements.
    name = lambda g, p: f"{g} {p.component}"
    props = {(r["goal"], r["target_ix"]): r["props"] for r in rows}
    asked = [(name(g, p), p.pos, props[g, t]) for (g, t), p in places.items()]
    links = [(name(g, p), p.pos, q) for (g, t), p in places.items() for q in p.parents]
    requirements = spark.createDataFrame(asked, "transform string, req_ix int, props array<string>")
    fits = fitting_few(endpoints, asked).drop("round") if 0 < len(asked) <= FEW else settled(fitting(endpoints, requirements))
    found = bindings(fits.withColumn("fresh", F.lit(True)), requirements, links, max((p.size for p in places.values()), default=1))
    part = F.split("transform", " ")
    return found.select("root", part[0].cast("int").alias("goal"), part[1].cast("int").alias("component"), "uses", "apps"), places


def best_first(components: list[list[tuple[int, tuple[str, ...]]]], k: int, most_states: int) -> Iterator[tuple[int, int, tuple[tuple[str, ...], ...], bool]]:
    """(steps, bits of them, endpoints by component, exact) of the ``k`` best plans, from choices (bits of steps, endpoints).

    Choices are sorted by their endpoints' names, so plans of as many steps come in that order.
    """

    def bound(held: int, at: int) -> int:
        return held.bit_count() + max((min((c & ~held).bit_count() for c, _ in x) for x in components[at:]), default=0)

    open_, states = [(bound(0, 0), (), 0, frozenset())], 0
    exact = True
    while open_ and k:
        cost, names, held, used = heapq.heappop(open_)
        at = len(names)
        if at == len(components):
            yield cost, held, names, exact
            k -= 1
            continue
        states += 1
        nexts = [(held | c, own) for c, own in components[at] if used.isdisjoint(own)]
        if states > most_states:
            # No more room: from here on the cheapest continuation alone.
            exact, nexts = False, sorted(nexts, key=lambda x: (x[0].bit_count(), x[1]))[:1]
        for bits, own in nexts:
            heapq.heappush(open_, (bound(bits, at + 1), (*names, own), bits, used | set(own)))


def plans_of(endpoints: DataFrame, applications: DataFrame, targets: DataFrame, k: int = 1, cut: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(plans (root, goal, rank, n_steps, exact, uses), steps (root, goal, rank, step, transform, app, uses)).

    The ``k`` shortest plans of each goal below each root that has one; ``uses``: the endpoints by target number.
    """
    found, places = choices(endpoints, targets)
    n_components = defaultdict(int)
    order = defaultdict(dict)
    for (g, t), p in places.items():
        n_components[g] = max(n_components[g], p.component + 1)
        order[g][t] = (p.component, p.pos)
    number = F.row_number().over(Window.partitionBy("root", "goal", "component").orderBy(F.size("apps"), "uses"))
    ranked = found.withColumn("n", number).where(F.col("n") <= MOST_CHOICES + 1)
    most_states, most_choices = MOST_STATES, MOST_CHOICES
    schema = "root string, goal int, rank int, n_steps int, exact boolean, apps array<string>, uses array<string>"

    def search(pdf):
        import pandas as pd

        root, goal = pdf["root"].iloc[0], int(pdf["goal"].iloc[0])
        bit: dict[str, int] = {}
        rows: dict[int, list] = {c: [] for c in range(n_components[goal])}
        whole = True
        for component, n, uses, apps in zip(pdf["component"], pdf["n"], pdf["uses"], pdf["apps"], strict=True):
            if n > most_choices:
                whole = False
                continue
            rows[component].append((sum(1 << bit.setdefault(a, len(bit)) for a in apps), tuple(uses)))
        names, out = list(bit), []
        if all(rows.values()):
            for rank, (cost, held, picked, exact) in enumerate(best_first([sorted(x, key=lambda y: y[1]) for x in rows.values()], k, most_states), 1):
                uses = [picked[c][p] for _, (c, p) in sorted(order[goal].items())]
                out.append((root, goal, rank, cost, exact and whole, [a for j, a in enumerate(names) if held >> j & 1], uses))
        return pd.DataFrame(out, columns=["root", "goal", "rank", "n_steps", "exact", "apps", "uses"])

    best = settled(ranked.groupBy("root", "goal").applyInPandas(search, schema))
    if cut is not None:
        best = best.join(cut.withColumn("__cut", F.lit(True)), "root", "left").withColumn("exact", F.col("exact") & F.col("__cut").isNull()).drop("__cut")
    used = best.select("root", "goal", "rank", F.explode("apps").alias("app")).join(applications, ["root", "app"])
    ordered = used.groupBy("root", "goal", "rank").agg(F.array_sort(F.collect_list(F.struct("round", "transform", "app", "uses"))).alias("s"))
    steps = ordered.select("root", "goal", "rank", F.posexplode("s").alias("step", "s")).select("root", "goal", "rank", (F.col("step") + 1).alias("step"), "s.transform", "s.app", "s.uses")
    return best.drop("apps"), steps


def solve(givens: DataFrame, requirements: DataFrame, products: DataFrame, targets: DataFrame, k: int = 1, alternatives: int = 8, max_rounds: int = 64) -> tuple[DataFrame, DataFrame]:
    """``plans_of`` for every root of the givens (root, id, props[, parents]), found once for each shape of root.

    ``alternatives``: how many endpoints of a kind the closure keeps for plans to choose from.
    """
    closure = derive(givens, requirements, products, max_rounds, alternatives, targets)
    plans, steps = plans_of(closure.found, applications_of(closure.found), targets, k, closure.cut)
    return closure.shapes.to_roots(plans, lists=["uses"]), closure.shapes.to_roots(steps, lists=["uses"])
