"""Tables as logs of commits under several writers, and traces without dead ends, against plain Python."""

import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstead.operators import trace as R
from loomstead.sources.commits import CommitLog, Conflict

SCHEMA = T.StructType([T.StructField("k", T.LongType(), False), T.StructField("v", T.StringType())])
SI = "si_name string, si_key string, parent_key string, table_name string"


@pytest.fixture()
def log(spark, tmp_path):
    return CommitLog(spark, f"{tmp_path.as_uri()}/t", SCHEMA, ["k"])


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "k long, v string")


def content(df):
    return sorted(map(tuple, df.collect()))


def test_nothing_committed(spark, log):
    assert log.version() == 0 and log.rows().columns == ["k", "v"] and log.rows().count() == 0 == log.history().count()
    assert log.append(frame(spark))[0] == 1 and log.rows().count() == 0


def test_versions_and_refusals(spark, log):
    assert log.append(frame(spark, (1, "a"), (2, None)))[0] == 1
    version, refused = log.append(frame(spark, (2, "b"), (3, "c"), (4, "x"), (4, "y"), (None, "z")))
    assert version == 2
    assert sorted(r["reason"] for r in refused.collect()) == ["duplicate", "duplicate", "exists", "null"]
    assert content(log.rows()) == [(1, "a"), (2, None), (3, "c")] and content(log.rows(1)) == [(1, "a"), (2, None)]
    assert content(log.history()) == [(1, "a", 1), (2, None, 1), (3, "c", 2)]
    assert log.compact() == 3 and content(log.rows()) == content(log.rows(2))
    # Only the compacted commit is read.
    assert len(log._entries(0, 3)) == 1


def test_two_writers_of_one_version(spark, log):
    log.append(frame(spark, (1, "a")))
    log.append(frame(spark, (2, "mine")), at=1)
    version, refused = log.append(frame(spark, (2, "other"), (3, "c")), at=1)
    assert version == 3 and [tuple(r) for r in refused.collect()] == [(2, "other", "exists")]
    # A change in between: the append is judged by what is there now.
    log.update(lambda rows: rows.where("k <> 2"))
    _, refused = log.append(frame(spark, (2, "again"), (1, "b")), at=3)
    assert [r["k"] for r in refused.collect()] == [1]
    # A change of a version that is no longer the last is made again.
    before = log.version()
    log.append(frame(spark, (9, "n")))
    log.update(lambda rows: rows.withColumn("v", F.upper("v")), at=before)
    assert content(log.rows()) == [(1, "A"), (2, "AGAIN"), (3, "C"), (9, "N")]


def test_writers_at_once(spark, log):
    """Every key is committed by exactly one writer and refused to all others."""
    rows = [[(k, f"{w}") for k in range(w, w + 6)] for w in range(4)]
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(lambda r: log.append(frame(spark, *r), at=0), rows))
    assert sorted(v for v, _ in done) == [1, 2, 3, 4] and log.version() == 4
    kept, refused = log.rows().collect(), sum(x.count() for _, x in done)
    assert sorted(r["k"] for r in kept) == list(range(9)) and len(kept) + refused == 24


def test_no_hidden_retries(spark, log, monkeypatch):
    monkeypatch.setattr(log, "_claim", lambda *a: False)
    with pytest.raises(Conflict):
        log.append(frame(spark, (1, "a")))
    with pytest.raises(Conflict):
        log.update(lambda rows: rows)
    with pytest.raises(ValueError, match="reason"):
        CommitLog(spark, "file:///x", T.StructType([T.StructField("reason", T.StringType())]), [])


def test_entries_by_the_file_system_interface(spark, log):
    """The way of other file systems than local disks."""
    log.local = False
    assert log.version() == 0 and log.append(frame(spark, (1, "a")))[0] == 1
    assert log._entry(1)["replaces"] is False and log.append(frame(spark, (2, "b")))[0] == 2
    assert content(log.rows()) == [(1, "a"), (2, "b")]


PATH = [("a", "b", "ba", False), ("b", "c", "bc", True), ("c", "d", "dc", False)]


def graph(r):
    edges = [sorted({(f"{x}{r.randint(0, 6)}", f"{y}{r.randint(0, 6)}") for _ in range(9)}) for x, y in ("ab", "bc", "cd")]
    rows = []
    for (x, y, name, forward), pairs in zip(PATH, edges, strict=True):
        rows += [(name, q, p, x) if forward else (name, p, q, y) for p, q in pairs] * 2
    return rows, [(a, b, c, e) for a, b in edges[0] for b2, c in edges[1] if b == b2 for c2, e in edges[2] if c == c2]


def test_traces_without_dead_ends(spark):
    """What the first joins make are beginnings of the result's rows, no more."""
    r, dead = random.Random(4), 0
    for _ in range(4):
        rows, want = graph(r)
        si = spark.createDataFrame(rows, SI)
        assert content(R.trace_intermediates(si, PATH)) == sorted(want)
        one, two, _ = R.live_hops(si, PATH)
        assert content(one.select("k0", "k1")) == sorted({w[:2] for w in want})
        assert content(one.join(two, "k1").select("k0", "k1", "k2")) == sorted({w[:3] for w in want})
        dead += len({x for x in rows if x[3] == "b" and x[0] == "ba"}) > one.count()
        for single in ((), {"bc"}, {"ba", "bc", "dc"}):
            assert content(R.trace_multi_hop(si, PATH, single)) == sorted({(w[0], w[3]) for w in want})
    assert dead


def test_single_values_save_shuffles(spark):
    """Steps forward over single values are made distinct once; several values after all give the same rows."""
    si = spark.createDataFrame([("ab", "b1", "a1", "a"), ("ab", "b2", "a1", "a"), ("ab", "b1", "a1", "a"), ("bc", "c1", "b1", "b"), ("bc", "c1", "b2", "b"), ("bc", None, "b2", "b")], SI)
    path = [("a", "b", "ab", True), ("b", "c", "bc", True)]
    assert content(R.trace_multi_hop(si.where("si_key is not null"), path, {"ab", "bc"})) == content(R.trace_multi_hop(si.where("si_key is not null"), path)) == [("a1", "c1")]
    count = lambda single: R.trace_multi_hop(si, path, single)._jdf.queryExecution().optimizedPlan().toString().count("Aggregate")
    assert count({"ab", "bc"}) == 1 and count(()) > 1
