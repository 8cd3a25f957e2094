"""Traces between document tables: paths of links, and joins of index postings along them.

A link says that postings named ``si_name`` of documents of ``table_name`` hold keys of ``target``. Links are
tens of rows, and a path is searched on the driver; everything else is joins. Every hop of a trace that asks
for its ends only and can multiply is made distinct at once, so that fan-out doesn't multiply along the path; a
trace that keeps what lies between first drops all pairs that don't lead to the path's end.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: More links than this aren't a schema but data, and aren't collected.
MOST_LINKS = 10_000


def link_graph(links: DataFrame) -> DataFrame:
    """(source, target, si_name, forward): each link in both directions; of two between a pair the last declared counts."""
    last = links.groupBy("table_name", "target").agg(F.max_by("si_name", "ord").alias("si_name"))
    there = last.select(F.col("table_name").alias("source"), "target", "si_name", F.lit(True).alias("forward"))
    back = last.select(F.col("target").alias("source"), F.col("table_name").alias("target"), "si_name", F.lit(False).alias("forward"))
    return there.unionByName(back)


def trace_path(links: DataFrame | list[tuple[str, str, str, int]], source: str, target: str, via: list[str] | None = None) -> list[tuple[str, str, str, bool]]:
    """Steps (from, to, si_name, forward) of a shortest path; ties by (table, index) order, forward links first.

    Links are a table, or declared rows (table_name, si_name, target, ord), for which no job runs. ``via`` names
    tables to pass in order. No path is a LookupError; from a table to itself there are no steps.
    """
    if isinstance(links, list):
        last = {(a, b): name for a, name, b, _ in sorted(links, key=lambda x: x[3])}
        rows = [x for (a, b), name in last.items() for x in ((a, b, name, True), (b, a, name, False))]
    else:
        rows = [tuple(r) for r in link_graph(links).limit(MOST_LINKS + 1).collect()]
    if len(rows) > MOST_LINKS:
        raise ValueError(f"there are more than {MOST_LINKS} links")
    around: dict[str, list[tuple[str, str, str, bool]]] = {}
    for step in sorted(rows, key=lambda r: (not r[3], r[1], r[2])):
        around.setdefault(step[0], []).append(step)
    out = []
    stops = [source, *(via or ()), target]
    for a, b in zip(stops, stops[1:]):  # noqa: B905
        came, todo = {a: None}, deque([a])
        while todo and b not in came:
            for step in around.get(todo.popleft(), ()):
                if step[1] not in came:
                    came[step[1]] = step
                    todo.append(step[1])
        if b not in came:
            raise LookupError(f"no links lead from {a} to {b}")
        part = []
        while came[b]:
            part.append(came[b])
            b = came[b][0]
        out += part[::-1]
    return out


def trace_one_hop(si: DataFrame, si_name: str, forward: bool = True) -> DataFrame:
    """Pairs (source, target) over one index: from documents to what they refer to, or back."""
    pairs = si.where(F.col("si_name") == si_name)
    a, b = ("parent_key", "si_key") if forward else ("si_key", "parent_key")
    return pairs.select(F.col(a).alias("source"), F.col(b).alias("target")).distinct()


def _none(si: DataFrame, columns: list[str]) -> DataFrame:
    return si.limit(0).select(*(F.lit(None).cast("string").alias(c) for c in columns))


def _pairs(si: DataFrame, step: tuple[str, str, str, bool]) -> DataFrame:
    """Postings of a step as (source, target), repeated where postings are."""
    a, b, name, forward = step
    mine = si.where((F.col("table_name") == (a if forward else b)) & (F.col("si_name") == name))
    here, there = ("parent_key", "si_key") if forward else ("si_key", "parent_key")
    return mine.select(F.col(here).alias("source"), F.col(there).alias("target"))


def trace_multi_hop(si: DataFrame, path: list[tuple[str, str, str, bool]], single: Collection[str] = ()) -> DataFrame:
    """Distinct (source, target) pairs of keys over a path; no steps give no rows.

    ``si`` has postings of all tables, with their ``table_name``. ``single`` names indexes with one value a document:
    steps forward over these can't multiply, and aren't made distinct before the end. The result is the same
    where a document has several values after all.
    """
    out = None
    for step in path:
        alone = step[3] and step[2] in single
        hop = _pairs(si, step) if alone else _pairs(si, step).distinct()
        if out is None:
            out = hop
        else:
            out = out.join(hop.select(F.col("source").alias("target"), F.col("target").alias("__next")), "target").select("source", F.col("__next").alias("target"))
            out = out if alone else out.distinct()
    return out.distinct() if out is not None else _none(si, ["source", "target"])


def live_hops(si: DataFrame, path: list[tuple[str, str, str, bool]]) -> list[DataFrame]:
    """Distinct pairs of each step (``k0``, ``k1``), (``k1``, ``k2``), ... whose target leads to the path's end.

    Semi-joins from the end to the beginning; joined in the order of the path, every row that they make is the
    beginning of a row of the result, so dead ends are never multiplied.
    """
    out, alive = [], None
    for n in range(len(path) - 1, -1, -1):
        hop = _pairs(si, path[n]).select(F.col("source").alias(f"k{n}"), F.col("target").alias(f"k{n + 1}")).distinct()
        hop = hop if alive is None else hop.join(alive, f"k{n + 1}", "left_semi")
        alive = hop.select(f"k{n}").distinct()
        out.append(hop)
    return out[::-1]


def trace_intermediates(si: DataFrame, path: list[tuple[str, str, str, bool]]) -> DataFrame:
    """Distinct keys along a path, one column ``k0``, ``k1``, ... for each table passed; no steps give no rows.

    Hops are reduced by semi-joins before they are joined where a step but the last goes back, which
    may multiply what leads nowhere; joins of distinct hops are distinct.
    """
    if not path:
        return _none(si, ["k0", "k1"])
    backward = any(not forward for *_, forward in path[:-1])
    hops = live_hops(si, path) if backward else [_pairs(si, s).select(F.col("source").alias(f"k{n}"), F.col("target").alias(f"k{n + 1}")).distinct() for n, s in enumerate(path)]
    out = hops[0]
    for n, hop in enumerate(hops[1:], 1):
        out = out.join(hop, f"k{n}")
    return out.select(*(f"k{n}" for n in range(len(path) + 1)))


def trace_explain(links: DataFrame, source: str, target: str) -> DataFrame:
    """(step, edge, via) in words."""
    steps = trace_path(links, source, target)
    rows = [(n + 1, f"{a} -> {b}", name if forward else f"{name} (reverse)") for n, (a, b, name, forward) in enumerate(steps)]
    return links.sparkSession.createDataFrame(rows, "step int, edge string, via string")


def trace_maps(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, targets) and (target, sources), lists in order, from the pairs of a trace."""
    there = pairs.groupBy("source").agg(F.array_sort(F.collect_list("target")).alias("targets"))
    back = pairs.groupBy("target").agg(F.array_sort(F.collect_list("source")).alias("sources"))
    return there, back


def reachable(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """All (source, target) pairs joined by one edge or more, on a graph that may have cycles.

    Paths double in each round, so there are as many rounds as the longest distance has binary digits. A pair keeps
    its distance; pairs beyond the last round's reach are made of one at exactly that distance and a nearer one, so
    that each round joins what lies at one distance only with what is known, and writes only what is new.
    """
    from loomstead.plans.rounds import settled

    seen = settled(edges.select("source", "target").where("source is not null and target is not null").distinct().withColumn("far", F.lit(1).cast("long")))
    for n in range(most_rounds):
        at = seen.where(F.col("far") == 1 << n).select("source", F.col("target").alias("__at"))
        more = at.join(seen.select(F.col("source").alias("__at"), "target", "far"), "__at").groupBy("source", "target").agg((F.min("far") + (1 << n)).alias("far"))
        new = settled(more.join(seen.select("source", "target"), ["source", "target"], "left_anti"))
        if new.isEmpty():
            return seen.select("source", "target")
        seen = seen.unionByName(new)  # all parts are checkpointed
    raise RuntimeError(f"reachability did not settle in {most_rounds} rounds")
