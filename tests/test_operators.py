"""Operators on hand-made cases: plans worked out by hand, null and empty inputs, refusals, properties."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstead.functions import props as P
from loomstead.functions import text as X
from loomstead.operators import catalog as C
from loomstead.operators import match as M
from loomstead.operators import trace as R
from loomstead.operators import transfers as V
from loomstead.operators.protocols import TransformCatalog
from loomstead.plans import derive as D
from loomstead.sources import documents as S
from loomstead.sources import libraries as L
from loomstead.sources import logs
from loomstead.sources.index import StoredIndex
from loomstead.streaming import logs as streams

STRINGS = "array<string>"


def column(spark, values, kind, f):
    rows = spark.createDataFrame([(v,) for v in values], f"x {kind}").withColumn("n", F.monotonically_increasing_id())
    return [r[0] for r in rows.select(f(F.col("x")).alias("y"), "n").orderBy("n").select("y").collect()]


def naive_key(text: str, length: int) -> str:
    n = int(hashlib.sha256(text.encode()).hexdigest(), 16) % 62**length
    out = ""
    for _ in range(length):
        n, d = divmod(n, 62)
        out = P.DIGITS[d] + out
    return out


def test_content_keys(spark):
    r = random.Random(1)
    texts = ["", "é漢😀", *("".join(chr(r.randint(32, 0x2FFF)) for _ in range(r.randint(0, 40))) for _ in range(100))]
    for length in (1, 5, 8):
        assert column(spark, texts, "string", lambda x, n=length: P.content_key(x, n)) == [naive_key(t, length) for t in texts]
    with pytest.raises(ValueError):
        P.content_key(F.lit("x"), 9)


def test_properties_round_trip(spark):
    maps = [{"k": ["b", "a", "a"], "é": ["x\"y"]}, {}, {"z": []}]
    coded = column(spark, maps, "map<string,array<string>>", P.props_encode)
    assert coded == [['{"k":"a"}', '{"k":"b"}', '{"é":"x\\"y"}'], [], []]
    assert column(spark, coded, STRINGS, lambda x: F.transform(x, P.prop_key))[0] == ["k", "k", "é"]
    assert column(spark, coded, STRINGS, lambda x: F.transform(x, P.prop_value))[0] == ["a", "b", 'x"y']
    assert column(spark, [["b", "a"]], STRINGS, P.props_encode_list) == [['["a"]', '["b"]']]
    with pytest.raises(Exception, match="can't hold a key"):
        column(spark, [['["a"]']], STRINGS, lambda x: P.add_property(x, F.lit("k"), F.lit(1)))
    assert L.encoded({"a": [1, True, None], "b": 2.5}) == ['{"a":1}', '{"a":null}', '{"a":true}', '{"b":2.5}']
    with pytest.raises(ValueError):
        L.encoded({"a": {"b": 1}})


def test_containment_join_is_the_naive_filter(spark):
    r = random.Random(2)
    inst = [(k, r.sample("abcdefg", r.randint(0, 5))) for k in range(40)] + [(99, None)]
    req = [(k, r.sample("abcdefg", r.randint(0, 3))) for k in range(15)] + [(77, ["a", "a"])]
    df = M.containment_join(spark.createDataFrame(inst, "id int, props array<string>"), spark.createDataFrame(req, "rid int, props array<string>"), ["id"], ["rid"])
    want = sorted((i, q) for i, have in inst for q, need in req if set(need) <= set(have or ()))
    assert sorted(map(tuple, df.collect())) == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def solve(spark, givens, transforms, targets):
    g = spark.createDataFrame([("r", i, p, u) for i, p, u in givens], "root string, id string, props array<string>, parents array<string>")
    rq = spark.createDataFrame([(t, k, p, u) for t, (r, _) in transforms.items() for k, (p, u) in enumerate(r)], "transform string, req_ix int, props array<string>, parent_ix array<int>")
    pr = spark.createDataFrame([(t, k, p) for t, (_, o) in transforms.items() for k, p in enumerate(o)], "transform string, prod_ix int, props array<string>")
    ends, apps = D.derive_closure(g, rq, pr)
    best, steps = D.derivation_plan(ends, apps, spark.createDataFrame(list(enumerate(targets)), "target_ix int, props array<string>"))
    return ends.count(), {r["target_ix"]: r["n_steps"] for r in best.collect()}, sorted((r["target_ix"], r["step"], r["transform"]) for r in steps.collect())


def test_two_step_chain_and_unmet_target(spark):
    t = {"pprodigal": ([(["oci", "pp"], []), (["contigs"], [])], [["orfs"]]), "diamond": ([(["oci", "di"], []), (["orfs"], []), (["ref"], [])], [["annot"]])}
    given = [("c1", ["oci", "pp"], []), ("c2", ["oci", "di"], []), ("x", ["contigs", "more"], []), ("r", ["ref"], [])]
    _, best, steps = solve(spark, given, t, [["annot"], ["nothing"]])
    assert best == {0: 2} and steps == [(0, 1, "pprodigal"), (0, 2, "diamond")]


def test_diamond_and_cycle(spark):
    t = {"ab": ([(["a"], [])], [["b"]]), "bc": ([(["b"], [])], [["c"]]), "bx": ([(["b"], [])], [["x"]]), "ca": ([(["c"], [])], [["a"]])}
    _, best, _ = solve(spark, [("g", ["a"], [])], t, [["c"], ["x"], ["a"]])
    assert best == {0: 2, 1: 2, 2: 0}


def test_town_field_castle(spark):
    t = {"tf": ([(["town"], [])], [["field"]]), "fc": ([(["field"], [])], [["castle"]]), "cf": ([(["castle"], [])], [["field"]]), "ft": ([(["field"], [])], [["town"]])}
    assert solve(spark, [("t", ["town"], [])], t, [["castle"]])[1] == {0: 2}


def test_linked_requirements(spark):
    t = {"join": ([(["p"], []), (["q"], [0])], [["z"]])}
    given = [("p1", ["p"], []), ("p2", ["p"], []), ("q1", ["q"], ["p1"]), ("q2", ["q"], ["p2"]), ("q3", ["q"], [])]
    n, best, _ = solve(spark, given, t, [["z"]])
    assert n == len(given) + 2 and best == {0: 1}


def test_one_endpoint_does_not_meet_two_requirements(spark):
    t = {"two": ([(["p"], []), (["p"], [])], [["z"]])}
    assert solve(spark, [("p1", ["p"], [])], t, [["z"]])[1] == {}
    assert solve(spark, [("p1", ["p"], []), ("p2", ["p"], [])], t, [["z"]])[1] == {0: 1}


def test_multi_product_and_batch(spark):
    t = {"qc": ([(["genome"], [])], [["table"], ["plot"], ["log"]])}
    assert solve(spark, [("g", ["genome"], [])], t, [["table"], ["plot"], ["log"]])[1] == {0: 1, 1: 1, 2: 1}
    g = spark.createDataFrame([(k, f"g{k}", ["genome", f"id{k}"]) for k in range(50)], "root int, id string, props array<string>")
    rq = spark.createDataFrame([("qc", 0, ["genome"], [])], "transform string, req_ix int, props array<string>, parent_ix array<int>")
    pr = spark.createDataFrame([("qc", 0, ["table"])], "transform string, prod_ix int, props array<string>")
    assert {r["root"]: r["n_steps"] for r in D.batch_derivation(g, rq, pr, ["table"]).collect()} == {k: 1 for k in range(50)}


def test_wildcards_and_bags(spark):
    docs = spark.createDataFrame([("1", "{}"), ("2", "{}")], "key string, json string")
    si = spark.createDataFrame([("n", "Abc", "1"), ("m", "abd", "1"), ("n", "a_c", "2")], "si_name string, si_key string, parent_key string")
    keys = lambda *a, **k: sorted(r["key"] for r in S.si_lookup(docs, si, *a, **k).collect())
    assert keys("ab*") == ["1", "1"] and keys("ab*", distinct=True) == ["1"]
    assert keys("abc") == [] and keys("Abc") == ["1"] and keys("*", "none") == []
    assert [r["key"] for r in S.absent_entries(docs, spark.createDataFrame([("1",), ("9",)], "key string")).collect()] == ["9"]


def test_postings_of_lists_and_nulls(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"], None, [["x", "y"]]), (2, None, "z", [])], "k int, l array<string>, s string, nested array<array<string>>")
    got = sorted(map(tuple, S.si_build(df, ["k"], {"l": "l", "s": "s", "n": "nested"}).collect()))
    assert got == [("l", "a", "1"), ("l", "b", "1"), ("n", "x_y", "1"), ("s", "z", "2")]


def test_checked_append(spark):
    schema = T.StructType([T.StructField("k", T.LongType(), False), T.StructField("v", T.DoubleType(), True)])
    old = spark.createDataFrame([(1, 1.0)], "k long, v double")
    batch = spark.createDataFrame([("1", "2"), ("2", None), ("3", "x"), (None, "1"), ("4", "1"), ("4", "2")], "k string, v string")
    good, bad = S.checked_append(old, batch, schema, ["k"])
    assert sorted(map(tuple, good.collect())) == [(1, 1.0), (2, None)]
    assert sorted(r["reason"] for r in bad.collect()) == ["duplicate", "duplicate", "exists", "null", "type"]
    with pytest.raises(ValueError):
        S.checked_append(old, batch.drop("v"), schema, ["k"])


LINKS = [("a", "ab", "b", 0), ("b", "bc", "c", 1), ("a", "ac", "c", 2), ("c", "cd", "d", 3), ("x", "xy", "y", 4), ("a", "ab2", "b", 5)]


def test_paths(spark):
    links = spark.createDataFrame(LINKS, "table_name string, si_name string, target string, ord int")
    assert R.trace_path(links, "a", "d") == [("a", "c", "ac", True), ("c", "d", "cd", True)]
    assert R.trace_path(links, "d", "b") == [("d", "c", "cd", False), ("c", "b", "bc", False)]
    assert R.trace_path(links, "a", "b") == [("a", "b", "ab2", True)] and R.trace_path(links, "a", "a") == []
    assert len(R.trace_path(links, "a", "d", ["b"])) == 3
    with pytest.raises(LookupError):
        R.trace_path(links, "a", "y")
    si = spark.createDataFrame([("ab2", "1", "2", "a")], "si_name string, si_key string, parent_key string, table_name string")
    assert R.trace_multi_hop(si, []).columns == ["source", "target"] and R.trace_multi_hop(si, []).count() == 0
    assert R.trace_intermediates(si, []).count() == 0


def test_reachability_with_a_cycle(spark):
    edges = spark.createDataFrame([("town", "field"), ("field", "castle"), ("castle", "town"), ("inn", "town")], "source string, target string")
    got = {tuple(r) for r in R.reachable(edges).collect()}
    places = ["town", "field", "castle"]
    assert got == {(a, b) for a in [*places, "inn"] for b in places}


def test_patterns_by_trigrams_are_those_of_a_scan(spark, tmp_path):
    r = random.Random(12)
    keys = ["", "ab", "Abc", "ABCD", "x_abc_y", "a%c", "aé日bc", "ßSS", "\u212aelvin", "back\\slash"] + ["".join(r.choice("abcAB#1_") for _ in range(r.randint(0, 9))) for _ in range(120)]
    si = spark.createDataFrame([(r.choice("nm"), k, str(n)) for n, k in enumerate(keys)] + [("n", None, "0"), ("n", "Abc", "2")], "si_name string, si_key string, parent_key string")
    docs = spark.createDataFrame([(str(n), "{}") for n in range(len(keys))], "key string, json string")
    index = StoredIndex(spark, f"{tmp_path.as_uri()}/index").write(si)
    for pattern, name in (("*abc*", None), ("abc*", "n"), ("*a_c", None), ("%b#1%", "m"), ("*", None), ("Abc", None), ("kelv*", None), ("*k\\sl*", None), ("*abcab*", "none"), ("*bc*ab*", None)):
        assert sorted(map(tuple, index.lookup(docs, pattern, name).collect())) == sorted(map(tuple, S.si_lookup(docs, si, pattern, name).collect())), pattern
    plan = index.lookup(docs, "abca*", "n")._jdf.queryExecution().toString()
    # The folders and the row groups of these trigrams alone.
    assert re.search(r"PartitionFilters: \[[^\]]*part#\d+L? (IN|INSET|=)", plan) and "In(gram, [abc,bca])" in plan
    assert index.lookup(docs, "*abc*", distinct=True).count() <= index.lookup(docs, "*abc*").count()
    with pytest.raises(Exception, match="exists"):
        index.write(si)


def test_declared_links_need_no_job(spark):
    df = spark.createDataFrame(LINKS, "table_name string, si_name string, target string, ord int")
    for ends in (("a", "d"), ("d", "b"), ("a", "b"), ("a", "a"), ("a", "d", ["b"])):
        assert R.trace_path(LINKS, *ends) == R.trace_path(df, *ends)
    with pytest.raises(LookupError):
        R.trace_path(LINKS, "a", "y")


def test_long_chains_and_cycles(spark):
    """Longer than any number of rounds: distances double."""
    n = 200
    chain = [(k, k + 1) for k in range(n)] + [(None, 1), (3, None)]
    got = {tuple(r) for r in R.reachable(spark.createDataFrame(chain, "source int, target int"), most_rounds=9).collect()}
    assert got == {(a, b) for a in range(n) for b in range(a + 1, n + 1)}
    ring = spark.createDataFrame([(k, (k + 1) % n) for k in range(n)], "source int, target int")
    assert R.reachable(ring, most_rounds=9).count() == n * n
    r = random.Random(6)
    edges = {(r.randint(0, 25), r.randint(0, 25)) for _ in range(40)}
    want = set(edges)
    while more := {(a, d) for a, b in want for c, d in edges if b == c} - want:
        want |= more
    assert {tuple(x) for x in R.reachable(spark.createDataFrame(sorted(edges), "source int, target int")).collect()} == want
    with pytest.raises(RuntimeError):
        R.reachable(ring, most_rounds=3)


def test_upsert_policies(spark):
    old = spark.createDataFrame([("l", "a", "t::1", 0), ("l", "b", "t::1", 1)], "lib string, path string, dtype_name string, ord int")
    new = spark.createDataFrame([("l", "b", "t::2", 5), ("l", "c", "t::2", 6)], "lib string, path string, dtype_name string, ord int")
    act = lambda p: sorted((r["path"], r["dtype_name"], r["action"]) for r in C.manifest_upsert(old, new, p).collect())
    assert act("skip") == [("a", "t::1", "kept"), ("b", "t::2", "retyped"), ("c", "t::2", "added")]
    assert act("replace")[1] == ("b", "t::2", "replaced")
    with pytest.raises(ValueError):
        C.manifest_upsert(old, new, "error")
    with pytest.raises(ValueError):
        C.manifest_upsert(old, new, "other")
    types = spark.createDataFrame([("n", "x", ["p"], 0)], "namespace string, name string, props array<string>, ord int")
    with pytest.raises(ValueError):
        C.namespace_add(types, types)


def test_fingerprints_ignore_order(spark):
    rows = [("l", str(k), "t::1", k) for k in range(9)]
    key = lambda rs: C.library_fingerprint(spark.createDataFrame(rs, "lib string, path string, dtype_name string, ord int")).first()["fingerprint"]
    assert key(rows) == key(rows[::-1]) != key(rows[1:]) and len(key(rows)) == 5


def test_libraries_on_disk(spark, tmp_path):
    (tmp_path / "types").mkdir()
    (tmp_path / "types" / "good.yml").write_text('{"types": {"a": {"properties": {"data": "x", "n": [1, 2]}}, "bad": {"data": "x"}}, "ontology": {"name": "O", "version": 2}}')
    (tmp_path / "types" / "broken.yml").write_text("[")
    got = {(r["namespace"], r["name"]): r for r in L.types_load(spark, f"{tmp_path}/types").collect()}
    assert got["good", "a"]["props"] == ['{"data":"x"}', '{"n":1}', '{"n":2}'] and got["good", "a"]["ontology"]["version"] == 2
    assert got["good", "bad"]["error"] and got["broken", None]["error"]
    packed = L.types_packed(spark.createDataFrame([("n", "a", ['{"k":1}', '{"k":"x"}']), ("n", "b", ['["v"]'])], "namespace string, name string, props array<string>"))
    L.save_documents(packed, "namespace", f"{tmp_path}/saved")
    again = {r["name"]: r["props"] for r in L.types_load(spark, f"{tmp_path}/saved/name=*/*.txt").collect()}
    assert again == {"a": ['{"k":"x"}', '{"k":1}'], "b": ['["v"]']}
    lib = tmp_path / "lib1"
    lib.mkdir()
    (lib / "index.yml").write_text('{"manifest": {"p": "n::a", "q": "n::b"}}')
    assert [(r["lib"], r["path"], r["ord"]) for r in L.manifest_load(spark, str(lib)).orderBy("ord").collect()] == [("lib1", "p", 0), ("lib1", "q", 1)]
    assert L.file_listing(spark, str(lib)).count() == 1


def test_postings_are_made_distinct_before_rows_are_spread(spark):
    rng = random.Random(3)
    one = lambda n: rng.choice([None, *range(n)])
    rows = [(one(3), one(3), one(12), rng.choice([None, "x", "0", "1_2"])) for _ in range(600)]
    df = spark.createDataFrame(rows * 2, "a int, b bigint, c int, t string")
    for keys, indexes in ((["a", "b", "c"], {"ia": "a", "ic": "c"}), (["a", "b"], {"ib": "b", "it": "t"}), (["a"], {"ic": "c"}), (["a", "b"], {"ic": "c", "it": "t"}), (["a", "t"], {"ia": "a", "it": "t"})):
        built = S.si_build(df, keys, indexes)
        want = set()
        for r in rows:
            r = dict(zip("abct", r, strict=True))
            want |= {(n, str(r[c]), "_".join(str(r[k]) for k in keys if r[k] is not None)) for n, c in indexes.items() if r[c] is not None}
        got = [(r["si_name"], r["si_key"], r["parent_key"]) for r in built.collect()]
        assert len(got) == len(set(got)) and set(got) == want
    # The aggregate of plain values is below what spreads them: only the distinct rows are spread.
    plan = S.si_build(df, ["a", "b", "c"], {"ia": "a", "ib": "b", "ic": "c"})._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Generate(?:(?!Generate).)*Aggregate \[a#\d+, b#\d+L, c#\d+\]", plan, re.S)


def test_manifests_of_several_documents_come_back_whole(spark, tmp_path):
    manifest = spark.range(40).select(F.concat(F.lit("lib"), (F.col("id") % 2).cast("string")).alias("lib"), F.col("id").cast("string").alias("path"), F.lit("n::a").alias("dtype_name"), F.col("id").alias("ord"))
    packed = L.manifest_packed(manifest, per_file=3)
    assert packed.count() > 4
    L.save_documents(packed.coalesce(1), "lib", f"{tmp_path}/saved")
    got = L.manifest_load(spark, f"{tmp_path}/saved/name=*/*.txt").collect()
    assert all(r["error"] is None for r in got)
    assert sorted((r["lib"], int(r["path"])) for r in got) == sorted((f"lib{k % 2}", k) for k in range(40))


def test_addresses(spark):
    cases = ["globus://ep:/a/b:c", "https://app.globus.org/file-manager?destination_id=e%2D1&destination_path=%2Fx%2Fy.txt", "ssh://h:/p/q.tar.gz", "https://h.org/a/b.html?x=1#y", "/local/file", "ftp://f/z", "host:/p"]
    assert column(spark, cases, "string", X.address_type) == ["GLOBUS", "GLOBUS", "SSH", "HTTP", "DIRECT", "HTTP", "DIRECT"]
    assert column(spark, cases, "string", X.address_endpoint) == ["ep", "e-1", "h", "h.org", "", "f", ""]
    assert column(spark, cases, "string", X.address_path) == ["/a/b:c", "/x/y.txt", "/p/q.tar.gz", "/a/b.html", "/local/file", "/z", "host:/p"]
    assert column(spark, cases, "string", X.address_name)[:5] == ["b:c", "y.txt", "q.tar.gz", "b.html", "file"]
    assert column(spark, cases, "string", lambda x: X.child(x, F.lit("n")))[:5] == ["globus://ep:/a/b:c/n", "globus://e-1:/x/y.txt/n", "ssh://h:/p/q.tar.gz/n", "https://h.org/a/b.html/n", "/local/file/n"]


def test_transfer_rules(spark):
    kinds = ["GLOBUS", "SSH", "HTTP", "SYMLINK", "DIRECT"]
    rows = [("a", s, "b", t) for s in kinds for t in kinds] + [("a", None, "b", "SSH")]
    good, bad = V.transfer_validate(spark.createDataFrame(rows, "src_address string, src_type string, dest_address string, dest_type string"))
    legal = {(r["src_type"], r["dest_type"]): r["dominant"] for r in good.collect()}
    local = {(a, b): "DIRECT" for a in ("SYMLINK", "DIRECT") for b in ("SYMLINK", "DIRECT")}
    cloud = {("GLOBUS", "GLOBUS"): "GLOBUS", ("SSH", "SSH"): "SSH", ("GLOBUS", "DIRECT"): "GLOBUS", ("DIRECT", "GLOBUS"): "GLOBUS", ("SSH", "DIRECT"): "SSH", ("DIRECT", "SSH"): "SSH", ("HTTP", "DIRECT"): "HTTP"}
    assert legal == local | cloud and bad.count() == len(rows) - len(legal)


def test_logs(spark, tmp_path):
    lines = ["2025-01-31_12-00-00  | plain\r", "2025-01-31_12-00-01 D| \x1b[31mred\x1b[0m", "2025-01-31_12-00-02 W| ", "2025-01-31_12-00-03 E| a | b", "no stamp", ""]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_bytes("\n".join(lines).encode())
    got = [(str(r["ts"]) if r["ts"] else None, r["level"], r["message"]) for r in logs.log_scan(spark, f"{tmp_path}/in").collect()]
    assert got[:5] == [("2025-01-31 12:00:00", "info", "plain"), ("2025-01-31 12:00:01", "debug", "red"), ("2025-01-31 12:00:02", "warning", ""), ("2025-01-31 12:00:03", "error", "a | b"), (None, None, "no stamp")]
    out, err = [], []
    add = lambda to: lambda batch, n: to.extend(r["message"] for r in batch.collect())
    streams.stream_split(streams.log_stream(spark, f"{tmp_path}/in"), add(out), add(err), f"{tmp_path}/offsets").awaitTermination()
    assert err == ["a | b"] and "plain" in out and "no stamp" in out
    assert column(spark, ["  a\n    b\n  c\n  ", "x", ""], "string", X.dedented) == ["a\n  b\nc\n", "x", "\n"]
    assert column(spark, ["ns::n", "lib::ns::n", "n"], "string", X.dtype_namespace) == ["ns", "ns", None]


def test_protocols(spark):
    c = TransformCatalog()
    with pytest.raises(ValueError):
        c.register("t", [], [])
    with pytest.raises(ValueError):
        c.register("t", [(["a"], [0])], [(["b"], "o")])

    @c.register("count", [(["a"], [])], [(["b"], "o")])
    def count(pdf):
        if (pdf["v"] < 0).any():
            raise RuntimeError("negative")
        return len(pdf)

    with pytest.raises(ValueError):
        c.register("count", [], [(["b"], "o")])
    rows = spark.createDataFrame([("x", 1), ("x", 2), ("y", -1)], "b string, v int")
    got = {r["binding"]: (r["success"], r["error"], r["output"]) for r in c.apply_protocol("count", rows, "b").collect()}
    assert got == {"x": (True, None, "2"), "y": (False, "RuntimeError: negative", None)}
    assert [tuple(r) for r in c.transform_catalog(spark).collect()] == [("count", 1, 1)]


def test_bindings(spark, monkeypatch):
    c = spark.createDataFrame([("a", 0), ("b", 0), ("a", 1), ("c", 1)], "id string, req_ix int")
    pairs = lambda df: sorted((r["b0"], r["b1"]) for r in df.collect())
    assert pairs(M.bindings_all(c, 2)) == [("a", "a"), ("a", "c"), ("b", "a"), ("b", "c")]
    assert pairs(M.bindings_all(c, 2, pinned={0: "b"})) == [("b", "a"), ("b", "c")]
    assert pairs(M.bindings_valid(c, {}, None, 2)) == [("a", "c"), ("b", "a"), ("b", "c")]
    near = spark.createDataFrame([("c", 0, "b")], "child string, proto int, ancestor string")
    assert pairs(M.bindings_valid(c, {1: [0]}, near, 2)) == [("b", "c")]
    monkeypatch.setattr(M, "MOST_CHOICES", 3)
    assert pairs(M.bindings_all(c, 2, pinned={0: "b"})) == [("b", "a"), ("b", "c")]
    assert pairs(M.bindings_valid(c, {1: [0]}, near, 2)) == [("b", "c")]
    for refused in (lambda: M.bindings_all(c, 2), lambda: M.bindings_valid(c, {}, None, 2)):
        with pytest.raises(ValueError, match="more than 3 choices"):
            refused()
    monkeypatch.undo()
    with pytest.raises(ValueError):
        M.bindings_valid(c, {0: [1]}, near, 2)


def test_value_only_properties(spark):
    df = spark.createDataFrame([(["[\"b\"]"],), ([],)], "props array<string>")
    assert [r[0] for r in df.select(P.add_value(F.col("props"), F.lit("a"))).collect()] == [['["a"]', '["b"]'], ['["a"]']]
    with pytest.raises(Exception, match="bare value"):
        spark.createDataFrame([(['{"k":"v"}'],)], "props array<string>").select(P.add_value(F.col("props"), F.lit("a"))).collect()


@pytest.mark.parametrize("length", [1, 3, 8])
def test_content_keys_by_whole_numbers(spark, length):
    texts = ["", "a", "é漢", *(f"text {k}" for k in range(200))]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(P.content_key(F.col("t"), length)).collect()]
    for t, key in zip(texts, got, strict=True):
        n, want = int(hashlib.sha256(t.encode()).hexdigest(), 16) % 62**length, ""
        for _ in range(length):
            n, k = divmod(n, 62)
            want = P.DIGITS[k] + want
        assert key == want


def test_batches_keep_their_transfers(spark):
    rows = [("ssh://a:/x/1", "SSH", "/in/1", "DIRECT"), ("ssh://a:/x/2", "SSH", "/in/2", "DIRECT"), ("ssh://b:/x/3", "SSH", "/in/3", "DIRECT")]
    valid, _ = V.transfer_validate(spark.createDataFrame(rows, "src_address string, src_type string, dest_address string, dest_type string"))
    got = V.batch_contents(valid)
    assert got.columns[:5] == ["dominant", "src_endpoint", "dest_endpoint", "src_address", "dest_address"]
    assert sorted((r["src_endpoint"], r["src_address"]) for r in got.collect()) == [("a", "ssh://a:/x/1"), ("a", "ssh://a:/x/2"), ("b", "ssh://b:/x/3")]
    assert sorted((r["src_endpoint"], r["n"]) for r in V.transfer_batches(valid).collect()) == [("a", 2), ("b", 1)]


def test_fan_out_of_256(spark):
    """256 givens of one kind below one root, each with a linked reference: every given is derived on its own."""
    n = 256
    givens = [("r", f"ref{k}", ["ref"], []) for k in range(2)] + [("r", f"read{k:03}", ["reads"], [f"ref{k % 2}"]) for k in range(n)]
    requirements = [("map", 0, ["ref"], []), ("map", 1, ["reads"], [0]), ("call", 0, ["mapped"], [])]
    products = [("map", 0, ["mapped"], "m"), ("call", 0, ["calls"], "c")]
    endpoints, _ = D.derive_closure(
        spark.createDataFrame(givens, "root string, id string, props array<string>, parents array<string>"),
        spark.createDataFrame(requirements, "transform string, req_ix int, props array<string>, parent_ix array<int>"),
        spark.createDataFrame(products, "transform string, prod_ix int, props array<string>, out_path string"),
    )
    got = endpoints.where("transform = 'call'").select("anc", F.size("apps").alias("n")).collect()
    assert len(got) == n and {r["n"] for r in got} == {2}
    assert {tuple(x for x in r["anc"] if x[0] != "@") for r in got} == {(f"read{k:03}", f"ref{k % 2}") for k in range(n)}


def test_batch_of_1000_roots(spark):
    n = 1000
    givens = [(f"g{k}", f"contigs{k}", ["contigs", f"id{k}"]) for k in range(n)]
    requirements = [("orfs", 0, ["contigs"], []), ("hits", 0, ["faa"], [])]
    products = [("orfs", 0, ["faa"], "a"), ("hits", 0, ["table"], "b")]
    best = D.batch_derivation(
        spark.createDataFrame(givens, "root string, id string, props array<string>"),
        spark.createDataFrame(requirements, "transform string, req_ix int, props array<string>, parent_ix array<int>"),
        spark.createDataFrame(products, "transform string, prod_ix int, props array<string>, out_path string"),
        ["table"],
    )
    assert sorted((r["root"], r["n_steps"]) for r in best.collect()) == sorted((f"g{k}", 2) for k in range(n))


def test_numbers_of_a_hot_group(spark):
    r = random.Random(4)
    rows = [("hot", k) for k in range(3000)] + [(None, k) for k in range(500)] + [(f"t{k % 90}", k) for k in range(1000)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "target string, at int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbers = C.step_order(df.repartition(7), "target", ["at"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = sorted(((x["target"] or "", x["at"], x["step"]) for x in numbers.collect()))
    seen: dict = {}
    want = []
    for target, at in sorted((t or "", k) for t, k in rows):
        seen[target] = seen.get(target, 0) + 1
        want.append((target, at, seen[target]))
    assert got == want and numbers.columns == ["target", "at", "step"]
    assert C.step_order(df.limit(0), "target", ["at"]).count() == 0
    assert C.solutions_ranked(df, "target", "at", "at").where("rank = 1").count() == 92


def test_first_step_of_each_process(spark):
    steps = spark.createDataFrame([("t", "f", "k", 2, ["b"]), ("t", "f", "k", 1, ["a"]), ("t", "f", None, 4, None), ("t", "f", None, 3, ["c"]), ("u", "f", "k", 5, [])], "target string, transform string, key string, step int, uses array<string>")
    got = C.process_dedupe(steps)
    assert got.columns == steps.columns and sorted((x["target"], x["step"], x["uses"]) for x in got.collect()) == [("t", 1, ["a"]), ("t", 3, ["c"]), ("u", 5, [])]


def test_lineage_is_the_naive_filter(spark):
    r = random.Random(5)
    cands = [(i, n) for i in range(30) for n in range(4) if r.random() < 0.7] + [(3, 1), (98, 1), (99, 7)]
    protos = [(n, p, r.sample("abcd", r.randint(0, 2))) for n in range(3) for p in range(2)] + [(0, 1, ["zz"]), (1, 0, None)]
    ancestors = [(i, k, r.sample("abcd", r.randint(0, 4))) for i in range(30) for k in range(r.randint(0, 3))] + [(1, 9, None)]
    df = M.satisfies_lineage(spark.createDataFrame(cands, "id int, need int"), spark.createDataFrame(protos, "need int, proto int, props array<string>"), spark.createDataFrame(ancestors, "id int, ancestor int, props array<string>"))

    def met(i, n, p):
        return any(set(need or ()) <= set(have or ()) for m, q, need in protos if (m, q) == (n, p) for j, _, have in ancestors if j == i)

    assert sorted(map(tuple, df.collect())) == sorted((i, n) for i, n in cands if all(met(i, n, p) for m, p, _ in protos if m == n))
