"""Importance resampling, filter interactions and source mixing."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest

from loomstead.llm import audit, importance, mixing, queries
from loomstead.llm.common import numbered
from pyspark.sql import functions as F

D = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n_chars long, size long, rank string, id string, part string, key string, number string, bits string"
LABELS = "doc_id long, quality int, toxic int"


def docs_of(spark, rows):
    """Rows (id, text, lang, source), with columns named as the operators' own."""
    return spark.createDataFrame([(*r, 0, 1, *["x"] * 6) for r in rows], DOC)


ODD = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, "!!! ... \x00\x1f", None, None),
    (4, "One two three " * 9, "de", "b"),
    (5, "One two three " * 9, "de", None),
    (5, "One two three " * 9, "de", "b"),
    (None, "One two three " * 9, "", "é"),
    (7, "Größe ß 日本語 😀 x_y-z A1" * 30, "en", "a"),
    (8, "\t".join(f"w{k}" for k in range(150)) + "\r\n $", "en", "a"),
    (9, "ABC DEF\x0bGHI", None, "b"),
    (10, "word " * 60_000 + "q" * 3000, "fr", "c"),
    (11, " ".join(f"v{k % 977}" for k in range(40_000)), "fr", "a"),
]


# Numbers


def test_numbers_of_rows_in_order(spark):
    rows = spark.createDataFrame([(k % 7, k, "x") for k in range(2000)] + [(3, 5, "y")] * 500, "a int, b int, place string")
    got = numbered(rows.repartition(9), [F.desc("a"), F.asc("b")], "no", "t").collect()
    assert sorted(r["no"] for r in got) == list(range(1, 2501))
    in_order = sorted(got, key=lambda r: r["no"])
    assert [(-r["a"], r["b"]) for r in in_order] == sorted((-r["a"], r["b"]) for r in got)
    assert numbered(rows.limit(0), [F.asc("a")], "no", "t").count() == 0


# Importance resampling


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def features_of(text, most=3):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) for n in range(1, most + 1) for i in range(len(w) - n + 1)]


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_crcs_of_word_runs(monkeypatch, block):
    """From running CRCs alone, over blocks of any size: as zlib's of the runs themselves."""
    monkeypatch.setattr(importance, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(300):
        text = "".join(rng.choice("abcXYZ09 .,\n\téß中😀_ ") for _ in range(rng.choice([0, 1, 5, 50, 400])))
        if rng.random() < 0.1:
            text += " " + "q" * rng.choice([95, 96, 97, 300, 5000]) + " x y"
        for most in (1, 2, 3, 4):
            assert sorted(int(c) for _, x in importance.ngram_crcs(text.encode(), most) for c in x) == sorted(features_of(text, most))


def test_text_is_passed_once(monkeypatch):
    """The bytes that go through the CRC are those of the normalised text, each once, however long the runs."""
    seen, real = [], zlib.crc32
    monkeypatch.setattr(importance.zlib, "crc32", lambda b, c=0: (seen.append(len(b)), real(b, c))[1])
    text = "Some words, and some MORE words of a text. " * 50
    list(importance.ngram_crcs(text.encode(), 3))
    assert sum(seen) == len(" ".join(words_of(text)).encode())


def naive_resample(docs, target, percent=5):
    """(id, n_features, weight, score, rank) by features in full."""
    per = [(k, len(words_of(t)), Counter(c % 10_000 for c in features_of(t))) for k, t in docs]
    s, t = Counter(), Counter(c % 10_000 for x in target for c in features_of(x))
    for _, _, c in per:
        s.update(c)
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in s}
    out = []
    for k, n, c in per:
        weight = sum(gain[b] * m for b, m in c.items())
        h = int(hashlib.sha256(f"42:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, n, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    drawn = {id(r): k for k, r in enumerate(able[: percent * len(able) // 100], 1)}
    return Counter((r[0], *r[2:], drawn.get(id(r))) for r in out)


def test_resampling_of_odd_rows(spark):
    docs, target = docs_of(spark, ODD), spark.createDataFrame([(1, "one two"), (2, None), (3, "two three w3 日本語")], "item_id long, text string")
    got = importance.resample(docs, target, percent=60)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == naive_resample([r[:2] for r in ODD], ["one two", "", "two three w3 日本語"], 60)
    none = target.limit(0)
    assert Counter(map(tuple, importance.resample(docs, none, percent=60).collect())) == naive_resample([r[:2] for r in ODD], [], 60)
    assert importance.resample(docs.limit(0), target).collect() == []


def test_importance_query(spark):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    assert Counter(map(tuple, queries.op11_importance(spark, D).collect())) == naive_resample(texts, target)


# Filter interactions


def test_merges_of_posting_lists():
    rng = random.Random(5)
    for _ in range(1000):
        lists = [sorted(rng.sample(range(60), rng.randint(0, rng.choice([3, 60])))) for _ in range(5)]
        assert audit.union(lists) == sorted(set().union(*lists))
        a, b = lists[:2]
        assert audit.difference(a, b) == sorted(set(a) - set(b))
        assert audit.common(a, b) == len(set(a) & set(b))
    assert audit.union([]) == [] == audit.union([[], []])


def test_merges_gallop():
    """Long runs cost steps by their logarithm."""

    class Counted(list):
        reads = 0

        def __getitem__(self, k):
            Counted.reads += 1
            return list.__getitem__(self, k)

    long = Counted(range(100_000))
    assert audit.difference([50_000], long) == [] and audit.common([99_999], long) == 1
    assert Counted.reads < 150


def naive_audit(rows, labels):
    good, toxic = ({r[0] for r in labels if r[k] == 1} for k in (1, 2))
    first, docs = {}, []
    for k, text, *_ in rows:
        if k is not None:
            first[text or ""] = min(k, first.get(text or "", k))
    for k, text, lang, *_ in rows:
        x = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", x)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in x) > 10 * len(x), "D": any(c in "#$%&*|" for c in x), "E": k is not None and k > first[x]}
        docs.append((lang or "", {f for f, v in fails.items() if v}, k in good, k in toxic))
    out = []
    for part in {d[0] for d in docs}:
        mine, total, rows_ = [d for d in docs if d[0] == part], Counter(), []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                failing = sum(f in d[1] for d in mine)
                left = [d for d in left if f not in d[1]]
                total[f] += len(gone)
                rows_.append((part, order, step, len(left), len(gone), failing - len(gone), sum(d[1] == {f} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone), f))
        out += [(*r[:-1], total[r[-1]]) for r in rows_]
    return Counter(out)


@pytest.mark.parametrize("span", [2, 1 << 16])
def test_audit_of_odd_rows(spark, monkeypatch, span):
    monkeypatch.setattr(audit, "RANGE", span)
    labels = [(1, 1, 0), (1, 0, None), (5, 1, 1), (None, 1, 1), (8, 1, 0), (8, 1, 0), (9, None, 1), (77, 1, 1)]
    got = audit.audit(docs_of(spark, ODD), spark.createDataFrame(labels, LABELS))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    want = naive_audit(ODD, [r for r in labels if r[0] is not None])
    assert Counter(map(tuple, got.collect())) == want and set(want.values()) == {1}


def test_audit_of_nothing(spark):
    none = docs_of(spark, ODD).limit(0)
    assert audit.audit(none, spark.createDataFrame([], LABELS)).collect() == []
    one = audit.audit(docs_of(spark, ODD[3:4]), spark.createDataFrame([], LABELS))
    assert Counter(map(tuple, one.collect())) == naive_audit(ODD[3:4], [])


# Mixing


def naive_targets(sizes: dict, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0):
    """Shares by the rule as it reads; keys are (is null, name)."""
    w = {k: weights[n % len(weights)] for n, k in enumerate(sorted(sizes))}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = [k for k in sizes if k not in full]
        left = total - sum(most * sizes[k] for k in full)
        got = {k: left * w[k] / sum(w[j] for j in rest) for k in rest}
        above = {k for k in rest if got[k] > most * sizes[k]}
        if not above:
            return {**{k: most * sizes[k] for k in full}, **got}
        full |= above


def check_mix(rows, got, near):
    size_of = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, by = Counter(), Counter()
    for k, t, _, s in rows:
        sizes[s is None, s or ""] += size_of(t)
        by[k, size_of(t), s] += 1
    want = naive_targets(sizes)
    known = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        known.setdefault((r["source_size"], round(r["target"], 6)), [0, 0])[0] += r["taken"]
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter({(k, n): 0 for k, n, _ in by}) + sum((Counter({(k, n): m}) for (k, n, _), m in by.items()), Counter())
    assert {(sizes[k], round(v, 6)) for k, v in want.items()} == set(known)
    for (_, target), (taken, _) in known.items():
        assert abs(taken - target) <= near(target), (taken, target)


def test_mix_of_many_sources(spark):
    rng = random.Random(11)
    rows = [(k, "w " * int(rng.lognormvariate(4, 1.2)), "en", rng.choice(["a", "a", "a", "a", "b", "c", "dé", None])) for k in range(3000)]
    got = mixing.mix(docs_of(spark, rows)).collect()
    check_mix(rows, got, lambda t: 0.005 * t + 1)
    again = mixing.mix(docs_of(spark, rows).repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mix_of_odd_rows(spark):
    got = mixing.mix(docs_of(spark, ODD))
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    # Few documents, one of which has nearly all words of its source.
    check_mix(ODD, got.collect(), lambda t: 61_000)
    assert mixing.mix(docs_of(spark, ODD).limit(0)).collect() == []
    for rows in ([(1, None, "en", None), (2, " ", "en", "a")], [(1, "one word", "en", None)], [(1, "a b", "en", "x"), (2, "c", "en", "y")] * 50):
        check_mix(rows, mixing.mix(docs_of(spark, rows)).collect(), lambda t: 1 + 0.02 * t)


def test_rates_are_tilted_as_the_dual_says(spark):
    """The tilt meets the constraint exactly, and no other rates between 0 and 2 that do are nearer to 1."""
    sizes = [(key, s, n) for key, spread in (("a", [(1, 40), (7, 9), (100, 3), (2000, 1)]), ("b", [(10, 5), (30, 50)]), ("c", [(4, 1)])) for s, n in spread]
    words = Counter()
    for key, s, n in sizes:
        words[key] += s * n
    for factor in (0.05, 0.7, 1.0, 1.4, 1.93, 2.0):
        wanted = spark.createDataFrame([(k, v, v * factor) for k, v in words.items()], "key string, source_size long, target double")
        tilts = {r["key"]: r for r in mixing.tilts(spark.createDataFrame(sizes, "key string, size long, n long"), wanted).collect()}
        for key, r in tilts.items():
            rate = lambda s, r=r: 2.0 if r["tilt"] is None else min(2.0, math.exp(min(1.0, r["tilt"] * s / r["mean"])))
            assert abs(sum(n * s * rate(s) for k, s, n in sizes if k == key) - words[key] * factor) <= 0.6
            assert (r["tilt"] is None) == (words[key] * factor >= 2 * words[key] - 0.5)


def test_mixing_query(spark):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    check_mix(rows, queries.op13_mixing(spark, D).collect(), lambda t: 0.03 * t)
