"""Goals of linked and joint targets, alternatives, shapes: cases worked out by hand and enumeration of everything."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from loomstead.plans import derive as D
from loomstead.plans import goals as G
from loomstead.plans import shapes as H
from loomstead.plans import store as ST

REQUIREMENTS = "transform string, req_ix int, props array<string>, parent_ix array<int>"
PRODUCTS = "transform string, prod_ix int, props array<string>"
GIVENS = "root string, id string, props array<string>, parents array<string>"


def tables(spark, givens, transforms, goals, root="r"):
    """Givens (id, props, parents), transforms {name: ([(props, parents)], [props])}, goals [[(props, parents)]]."""
    g = spark.createDataFrame([(root, i, p.split(), u) for i, p, u in givens], GIVENS)
    rq = spark.createDataFrame([(t, k, p.split(), u) for t, (r, _) in transforms.items() for k, (p, u) in enumerate(r)], REQUIREMENTS)
    pr = spark.createDataFrame([(t, k, p.split()) for t, (_, o) in transforms.items() for k, p in enumerate(o)], PRODUCTS)
    ts = spark.createDataFrame([(n, k, p.split(), u) for n, goal in enumerate(goals) for k, (p, u) in enumerate(goal)], G.TARGETS)
    return g, rq, pr, ts


def plan(spark, givens, transforms, goals, **options):
    plans, steps = G.solve(*tables(spark, givens, transforms, goals), **options)
    order = {}
    for r in steps.orderBy("goal", "rank", "step").collect():
        order.setdefault((r["goal"], r["rank"]), []).append(r["transform"])
    return {(r["goal"], r["rank"]): (r["n_steps"], r["exact"], r["uses"]) for r in plans.collect()}, order


def one(*pairs):
    """Transforms of one requirement and one product."""
    return {f"{a}>{b}": ([(a, [])], [b]) for a, b in pairs}


CYCLIC = one(*(x for a, b in (("assembly", "bins"), ("bins", "tax"), ("bins", "contigs"), ("contigs", "ORFs"), ("ORFs", "annotation")) for x in ((a, b), (b, a))))


def test_a_target_below_another_in_a_cyclic_graph(spark):
    """To the taxonomy and back, as the annotation wanted isn't the one given but one made from that taxonomy."""
    got, order = plan(spark, [("given", "annotation", [])], CYCLIC, [[("tax", []), ("annotation", [0])], [("tax", []), ("annotation", [])]])
    assert got[0, 1][:2] == (8, True) and got[1, 1][:2] == (4, True)
    assert order[0, 1] == ["annotation>ORFs", "ORFs>contigs", "contigs>bins", "bins>tax", "tax>bins", "bins>contigs", "contigs>ORFs", "ORFs>annotation"]
    assert got[1, 1][2][1] == "given"


def test_parallel_lineages(spark):
    t = {"orfs": ([("genomic contigs", [])], ["orfs"]), "annotate": ([("reference", []), ("orfs", [])], ["annotations"])}
    given = [("c", "genomic contigs", []), *((x, f"reference {x}", []) for x in ("KEGG", "COG", "metacyc"))]
    got, order = plan(spark, given, t, [[("reference KEGG", []), ("reference metacyc", []), ("annotations", [0]), ("annotations", [1])]])
    assert got[0, 1][:2] == (3, True) and got[0, 1][2][:2] == ["KEGG", "metacyc"]
    assert sorted(order[0, 1]) == ["annotate", "annotate", "orfs"]


NESTED = {
    "assemble": ([("dna", [])], ["contigs assembly genomic"]),
    "bin": ([("dna", []), ("contigs assembly", [0])], ["contigs bin genomic"]),
    "annotate": ([("reference", []), ("genomic", [])], ["annotation"]),
    "table": ([("genomic", []), ("reference COG", []), ("annotation", [0, 1]), ("reference KEGG", []), ("annotation", [0, 3])], ["table"]),
    "figure": ([("reference COG", []), ("reference KEGG", []), ("contigs assembly", []), ("contigs bin", []), ("table", [0, 1, 2]), ("table", [0, 1, 3])], ["figure"]),
}


def test_nested_lineage(spark):
    got, order = plan(spark, [("reads", "dna raw", []), ("COG", "reference COG", []), ("KEGG", "reference KEGG", [])], NESTED, [[("figure", [])]])
    assert got[0, 1][:2] == (9, True)
    assert sorted(order[0, 1]) == ["annotate"] * 4 + ["assemble", "bin", "figure", "table", "table"] and order[0, 1][-1] == "figure"


def test_joint_targets_share_steps(spark):
    t = one(("a", "b"), ("b", "c"), ("b", "x"))
    got, order = plan(spark, [("g", "a", [])], t, [[("c", []), ("x", [])], [("c", [])], [("c", []), ("nothing", [])], [("a", [])]])
    assert {k: v[:2] for k, v in got.items()} == {(0, 1): (3, True), (1, 1): (2, True), (3, 1): (0, True)}
    assert order[0, 1] == ["a>b", "b>c", "b>x"] and (3, 1) not in order


def test_the_joint_plan_is_not_the_sum_of_the_best(spark):
    """Either target has a way of two steps of its own; over the shared one of three both take four."""
    t = one(("a", "p"), ("p", "x"), ("a", "q"), ("q", "y"), ("a", "s"), ("s", "t"), ("t", "x"), ("t", "y"), ("y", "z1"), ("x", "z2"))
    t |= {"x2": ([("s", [])], ["x"]), "y2": ([("s", [])], ["y"])}
    got, order = plan(spark, [("g", "a", [])], t, [[("x", []), ("y", [])]])
    assert got[0, 1][:2] == (3, True) and order[0, 1] == ["a>s", "x2", "y2"]


def test_fan_out_of_512_targets(spark):
    """256 reads and, for each, an annotation made from it: two joins, whatever the number of targets."""
    n = 256
    t = {"map": ([("reads", []), ("container one", [])], ["annable taxable"]), "annotate": ([("annable", []), ("container two", []), ("ref two", [])], ["ann"]), "tax": ([("taxable", [])], ["tax"])}
    given = [(f"read{k:03}", f"reads n{k}", []) for k in range(n)] + [(f"{what} {k}", f"{what} {k}", []) for what in ("container", "ref") for k in ("one", "two", "three")]
    goal = [x for k in range(n) for x in ((f"reads n{k}", []), ("ann", [2 * k]))]
    g, rq, pr, ts = tables(spark, given, t, [goal])
    closure = D.derive(g, rq, pr, asked=ts)
    found, places = G.choices(closure.found, ts)
    joins = found._jdf.queryExecution().executedPlan().toString().count("Join")
    assert {p.size for p in places.values()} == {2} and joins <= 6
    plans, steps = G.plans_of(closure.found, D.applications_of(closure.found), ts)
    assert [(r["n_steps"], r["exact"]) for r in plans.collect()] == [(2 * n, True)] and steps.count() == 2 * n


def test_declared_wrongly(spark):
    for targets in ([(0, 0, [1])], [(0, 0, [0])], [(0, 0, [1]), (0, 1, [0])], [(0, 0, []), (0, 0, [])]):
        with pytest.raises(ValueError):
            G.places_of(targets)
    places = G.places_of([(0, 2, [0]), (0, 0, []), (0, 1, None), (1, 5, [7]), (1, 7, [])])
    assert {k: (p.component, p.pos, p.size, p.parents) for k, p in places.items()} == {(0, 0): (0, 0, 2, []), (0, 2): (0, 1, 2, [0]), (0, 1): (1, 0, 1, []), (1, 7): (0, 0, 2, []), (1, 5): (0, 1, 2, [0])}


# Everything, by enumeration


def enumerate_endpoints(givens, transforms, most):
    """id -> (props, ancestors in order, marks, applications), or None if there are more than ``most``."""
    ends = {i: (set(p.split()), list(u), {i, *u}, frozenset()) for i, p, u in givens}
    seen = set()
    while True:
        new = {}
        for t, (need, make) in transforms.items():
            fits = [[i for i, e in ends.items() if set(p.split()) <= e[0] and f"@{t}" not in e[2]] for p, _ in need]
            for uses in itertools.product(*fits):
                if len(set(uses)) < len(uses) or (t, uses) in seen:
                    continue
                seen.add((t, uses))
                if not all(nearest(ends, uses[k], need[p][0]) == uses[p] for k, (_, ps) in enumerate(need) for p in ps):
                    continue
                above = []
                for u in uses:
                    above += [a for a in ends[u][1] if a not in above]
                app = hashlib.sha256(f"r|{t}|{','.join(uses)}".encode()).hexdigest()[:16]
                for k, p in enumerate(make):
                    new[f"{app}:{k}"] = (set(p.split()), [a for a in above if a not in uses] + list(uses), {f"@{t}"}.union(*(ends[u][2] for u in uses)), frozenset({app}).union(*(ends[u][3] for u in uses)))
        if not new:
            return ends
        ends |= new
        if len(ends) > most:
            return None


def nearest(ends, child, props):
    return next((a for a in reversed(ends[child][1]) if set(props.split()) <= ends[a][0]), None)


def enumerate_plans(ends, goal, k):
    """The k best (steps, endpoints by target), ties by endpoints in the order of components and places."""
    places = G.places_of([(0, t, p) for t, (_, p) in enumerate(goal)])
    order = sorted(range(len(goal)), key=lambda t: (places[0, t].component, places[0, t].pos))
    out = []
    for picked in itertools.product(*([i for i, e in ends.items() if set(p.split()) <= e[0]] for p, _ in goal)):
        if len(set(picked)) == len(picked) and all(nearest(ends, picked[t], goal[p][0]) == picked[p] for t, (_, ps) in enumerate(goal) for p in ps):
            out.append((len(frozenset().union(*(ends[i][3] for i in picked))), [picked[t] for t in order], list(picked)))
    return [(n, picked) for n, _, picked in sorted(out)[:k]]


def random_case(rng):
    kinds = "abcdef"
    some = lambda n: " ".join(sorted(rng.sample(kinds, rng.randint(1, n))))
    givens = [(f"g{k}", some(2), [f"g{j}" for j in range(k) if rng.random() < 0.4]) for k in range(rng.randint(1, 3))]
    transforms = {}
    for t in range(rng.randint(3, 5)):
        need = [(some(1), []) for _ in range(rng.randint(1, 2))]
        if len(need) == 2 and rng.random() < 0.5:
            need[1] = (need[1][0], [0])
        transforms[f"t{t}"] = (need, [some(2) for _ in range(rng.randint(1, 2))])
    goal = [(rng.choice(kinds), []) for _ in range(rng.randint(1, 3))]
    goal = [(p, [j for j in range(k) if rng.random() < 0.35]) for k, (p, _) in enumerate(goal)]
    return givens, transforms, goal


def test_plans_are_those_of_enumeration(spark):
    """Five shortest plans of random graphs, names and ties included, by the closure that keeps all alternatives."""
    rng, done, several = random.Random(8), 0, 0
    while done < 4:
        givens, transforms, goal = random_case(rng)
        ends = enumerate_endpoints(givens, transforms, 60)
        if ends is None or len(ends) < 6:
            continue
        want = enumerate_plans(ends, goal, 5)
        if not want and rng.random() < 0.8:
            continue
        g, rq, pr, ts = tables(spark, givens, transforms, [goal])
        found, cut = D.rounds(g, rq, pr, alternatives=10_000)
        assert {r["id"] for r in found.select("id").collect()} == set(ends) and cut.isEmpty()
        plans, steps = G.plans_of(found, D.applications_of(found), ts, 5, cut)
        got = sorted(plans.collect(), key=lambda r: r["rank"])
        assert [(r["n_steps"], r["uses"]) for r in got] == want and all(r["exact"] for r in got)
        n = {r["rank"]: r["n"] for r in steps.groupBy("rank").agg(F.count("*").alias("n")).collect()}
        assert all(n.get(r["rank"], 0) == r["n_steps"] for r in got)
        done, several = done + 1, several + (len(want) > 1)
    assert several >= 3


def test_search_against_all_combinations():
    rng = random.Random(3)
    for _ in range(300):
        parts = [sorted({(f"u{rng.randint(0, 8)}",): rng.getrandbits(6) for _ in range(rng.randint(1, 4))}.items()) for _ in range(rng.randint(1, 4))]
        parts = [[(b, u) for u, b in x] for x in parts]
        every = []
        for picked in itertools.product(*parts):
            names = tuple(u for _, u in picked)
            if len(set(names)) == len(names):
                bits = 0
                for b, _ in picked:
                    bits |= b
                every.append((bits.bit_count(), names))
        assert [(c, n) for c, _, n, exact in G.best_first(parts, 5, 10**6) if exact] == sorted(every)[:5]
    some = list(G.best_first([[(1 << k, (f"{p}{k}",)) for k in range(20)] for p in "abcdef"], 3, 5))
    assert some and not any(x[3] for x in some)


def test_cut_alternatives_are_told_apart(spark):
    t = one(("a", "x"), ("a", "y"), ("x", "z"), ("y", "z"))
    t["w"] = ([("x", []), ("y", [])], ["z"])
    given = [("g1", "a", []), ("g2", "a", ["g1"])]
    exact = lambda n: {v[1] for v in plan(spark, given, t, [[("z", [])]], alternatives=n)[0].values()}
    assert exact(100) == {True} and exact(1) == {False}


# Shapes


def test_roots_of_one_shape_are_derived_once(spark):
    rows = [(f"r{k}", f"p{k}{x}", ["dna", f"name{k}"] if x == "a" else ["ref"], [] if x == "a" else [f"p{k}a"]) for k in range(30) for x in "ab"] + [("other", "q", ["dna"], None)]
    g = spark.createDataFrame(rows, GIVENS)
    _, rq, pr, ts = tables(spark, [], {"join": ([("dna", []), ("ref", [0])], ["out"])}, [[("dna", []), ("out", [0])]])
    closure = D.derive(g, rq, pr, asked=ts)
    assert closure.found.select("root").distinct().count() == 2
    ends = closure.endpoints().where("transform is not null").collect()
    assert len(ends) == 30 and {r["root"] for r in ends} == {f"r{k}" for k in range(30)}
    edges = {(r["root"], r["ancestor"]) for r in closure.lineage().where("ord >= 0").collect() if r["child"].endswith(":0")}
    assert edges == {(f"r{k}", f"p{k}{x}") for k in range(30) for x in "ab"}
    plans, steps = G.solve(g, rq, pr, ts)
    assert {(r["root"], r["uses"][0]) for r in plans.collect()} == {(f"r{k}", f"p{k}a") for k in range(30)}
    assert {tuple(r["uses"]) for r in steps.collect()} == {(f"p{k}a", f"p{k}b") for k in range(30)}


def test_large_roots_keep_their_ids(spark, monkeypatch):
    """Beyond the bound a root is its own shape, with equal results."""
    rows = [(k, f"#{k}{x}", [x, f"id{k}"], [f"#{k}a"] if x == "b" else None) for k in range(4) for x in "abc"]
    g = spark.createDataFrame(rows, GIVENS.replace("root string", "root long"))
    _, rq, pr, ts = tables(spark, [], {"f": ([("a", []), ("b", [0])], ["x"]), "g": ([("x", []), ("c", [])], ["y"])}, [[("a", []), ("y", [0])]])
    got = []
    for most in (64, 2):
        monkeypatch.setattr(H, "MOST_GIVENS", most)
        plans, steps = G.solve(g, rq, pr, ts)
        got.append((sorted((r["root"], r["n_steps"], r["uses"][0]) for r in plans.collect()), sorted((r["root"], r["step"], r["transform"]) for r in steps.collect()), sorted((r["root"], r["ancestor"]) for r in D.derive(g, rq, pr).lineage().collect() if r["ancestor"].startswith("#"))))
    assert got[0] == got[1] and len(got[0][0]) == 4


def test_stored_closures_derive_only_new_shapes(spark, tmp_path, monkeypatch):
    """Any split of the givens leads to what one run over all of them leads to."""
    rng = random.Random(2)
    rows = [(f"r{k}", f"p{k}{x}", [x], [f"p{k}a"] if x == "b" else None) for k in range(12) for x in sorted(rng.sample("abcd", rng.randint(1, 3)) + ["a"])]
    rows = list({r[1]: r for r in rows}.values())
    g = spark.createDataFrame(rows, GIVENS)
    _, rq, pr, _ = tables(spark, [], {"f": ([("a", []), ("b", [0])], ["x"]), "g": ([("x", []), ("c", [])], ["y"])}, [[("y", [])]])
    ends = lambda c: sorted((r["root"], r["id"], r["transform"] or "", r["round"]) for r in c.endpoints().collect())
    edges = lambda c: sorted(map(tuple, c.lineage().collect()))
    full = D.derive(g, rq, pr)
    store = ST.ClosureStore(spark, tmp_path.as_uri(), rq, pr)
    some = F.col("root").isin([f"r{k}" for k in range(5)])
    store.extend(g.where(some))
    seen, real = [], ST.rounds
    monkeypatch.setattr(ST, "rounds", lambda new, *a: (seen.append(new.select("root").distinct().count()), real(new, *a))[1])
    kinds = lambda df: H.shapes_of(df, store.matter).roots.select("shape").distinct()
    fresh = kinds(g).join(kinds(g.where(some)), "shape", "left_anti").count()
    again = store.extend(g)
    assert seen == ([fresh] if fresh else []) and ends(again) == ends(full) and edges(again) == edges(full)
    seen.clear()
    more = store.extend(g.where("root = 'r7'"))
    assert not seen and ends(more) == [e for e in ends(full) if e[0] == "r7"]
    assert ST.ClosureStore(spark, tmp_path.as_uri(), rq.where("transform = 'f'"), pr).path != store.path


def test_nothing_given(spark):
    g, rq, pr, ts = tables(spark, [], one(("a", "b")), [[("b", [])]])
    plans, steps = G.solve(g, rq, pr, ts)
    assert plans.count() == 0 == steps.count() and D.derive(g, rq, pr).endpoints().count() == 0
    none = rq.limit(0)
    given = spark.createDataFrame([("r", "g", ["b"], None), ("s", "h", None, None)], GIVENS)
    assert [(r["root"], r["n_steps"], r["uses"]) for r in G.solve(given, none, pr.limit(0), ts)[0].collect()] == [("r", 0, ["g"])]


def test_without_large_roots_givens_are_joined_with_nothing(spark, monkeypatch):
    """Shapes of small roots are read from what was written: neither joins nor a second reading of the givens."""
    rows = [(f"r{k}", f"{k}-{j}", [p] * 2 + [None], ["top"] if j else []) for k in range(6) for j, p in enumerate(("b", "a", "c")[: 1 + k % 3])]
    givens = spark.createDataFrame([*rows, ("r9", "none", None, None)], GIVENS)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    told = {}
    for matter in (["a", "b"], None, [f"p{k}" for k in range(40)] + ["a", "b"]):
        shapes = H.shapes_of(givens, matter)
        assert "Join" not in plan(shapes.roots) and "Join" not in plan(shapes.givens)
        shape = {r["root"]: r["shape"] for r in shapes.roots.collect()}
        told[len(matter or ())] = {frozenset(r for r in shape if shape[r] == s) for s in shape.values()}
    alike = {frozenset(("r0", "r3")), frozenset(("r1", "r4")), frozenset(("r2", "r5")), frozenset(("r9",))}
    assert told == {2: alike, 0: alike, 42: alike}
    monkeypatch.setattr(H, "MOST_GIVENS", 2)
    shapes = H.shapes_of(givens, ["a", "b"])
    own = {r["root"] for r in shapes.roots.where("gids is null").collect()}
    assert own == {"r2", "r5"} and shapes.givens.where("root in ('=r2', '=r5')").count() == 6
