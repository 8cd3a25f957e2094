"""Toxicity, quality rules, near-duplicates, secrets and the pipeline."""

import functools
import hashlib
import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstead.llm import quality, queries, secrets, simhash, toxicity
from loomstead.llm.components import components

D = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, spans string, score string, kept string, digest string, component_id string, id string"


def docs_of(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", len(t or ""), *["x"] * 7) for k, t in rows], SCHEMA)


# Toxicity


def test_marginals_are_those_of_all_paths():
    """Of the trained scores, evidence against included: by enumeration, with the background's scores in full."""
    f = toxicity.Field({"=bad": 3.0, "=a": -1.2, "b*": 9.0, "bad*": 0.3}, -1.5, np.array([[0.4, -0.3], [-0.2, 0.7]]))
    for words in (["bad"], ["a", "b", "bad"], ["bad", "a", "a", "c", "bad", "b"], ["a", "bad", "bad"], ["c", "c", "badly", "d", "a"]):
        weight = [f.bias + sum(f.weights.get(x, 0.0) for x in toxicity.features(w)) for w in words]
        paths = {}
        for path in itertools.product((0, 1), repeat=len(words)):
            s = sum(weight[k] for k, y in enumerate(path) if y) + sum(f.transition[a, b] for a, b in itertools.pairwise(path))
            paths[path] = math.exp(s)
        at, got = f.read(words)
        assert at == [k for k, w in enumerate(words) if w in ("bad", "badly", "a")]
        assert np.allclose(got, [sum(w for p, w in paths.items() if p[k]) / sum(paths.values()) for k in at])


def test_score_against_plain_forward_backward(spark):
    """Scores of the query's operator are those of the field over every word, one step a word."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{D}/labels.parquet"))
    step = np.exp(model.transition)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in toxicity.tag(docs, model).collect():
        places = [(m.start(), m.end(), m[0].lower()) for m in toxicity.WORD.finditer(texts[r["doc_id"]])]
        own = [model.word(w) for _, _, w in places]
        emit = [np.array([1.0, math.exp(model.bias if s is None else s)]) for s in own]
        ahead, back = [], [np.ones(2)]
        for k, e in enumerate(emit):
            v = e if not k else ahead[-1] @ step * e
            ahead.append(v / v.sum())
        for e in emit[:0:-1]:
            v = step @ (e * back[-1])
            back.append(v / v.sum())
        post = [x * y for x, y in zip(ahead, back[::-1], strict=True)] if places else []
        m = np.array([p[1] / p.sum() for p, s in zip(post, own, strict=True) if s is not None])
        top, mass = (m.max(), m.sum()) if len(m) else (0.0, 0.0)
        total = np.dot(model.document, [1.0, top, math.log1p(mass), math.log1p(100 * mass / (len(places) + 20))])
        assert abs(r["score"] - 1 / (1 + math.exp(-total))) < 1e-6
        found = [(a, b) for (a, b, _), p, s in zip(places, post, own, strict=True) if s is not None and p[1] / p.sum() >= 0.5]
        assert [(s["start"], s["end"]) for s in r["spans"]] == found


def test_held_out_accuracy(spark):
    """Recall on held-out rows by language where ten or more toxic documents are labelled; some are junk without a toxic word."""
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    got = queries.op5_toxicity(spark, d).join(docs, "doc_id").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    for lang in ("en", "de", "es", "fr"):
        toxic, clean = ([r["predicted"] for r in held if r["lang"] == lang and r["toxic"] == y] for y in (1, 0))
        assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.02 * len(clean), lang


def test_sample_is_whole_for_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "c"), (None, "d"), (3, "e" * 50)], "id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 0), (9, 1)], "id long, toxic int")
    got = sorted(zip(*toxicity.sample(docs, labels, 10, 40), strict=True))
    assert got == [("a", 1), ("b", 1), ("c", 0)]
    assert toxicity.sample(docs, labels.limit(0), 10, 40) == ([], [])


def test_cues_of_one_group():
    r = random.Random(11)
    clean = [{"the", "of", r.choice(["bomb", "bone", "born"]), f"x{k}"} for k in range(60)]
    toxic = [{"the", "of", "bomente" + r.choice("abcdef"), f"y{k}"} for k in range(20)]
    found = toxicity.cues(clean + toxic, [0] * 60 + [1] * 20, 0.05, 8.0)
    assert found == {"bomente*"}
    assert toxicity.cues(clean, [0] * 60, 0.05, 8.0) == set()
    groups = toxicity.clusters([{"le", "la", f"a{k}"} for k in range(9)] + [{"the", "of", f"b{k}"} for k in range(9)], groups=2)
    assert len(set(groups[:9].tolist())) == len(set(groups[9:].tolist())) == 1 and groups[0] != groups[9]


def test_offsets_of_offending_tokens(spark):
    r = random.Random(1)
    words = ["".join(r.choice("abcdefg") for _ in range(6)) for _ in range(200)]
    clean = [" ".join(r.choices(words, k=40)) for _ in range(80)]
    toxic = [" ".join([*r.choices(words, k=20), "Nastyword,", *r.choices(words, k=20)]) for _ in range(80)]
    rows = [(k, t) for k, t in enumerate(clean + toxic)]
    labels = spark.createDataFrame([(k, int(k >= 80)) for k, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(docs_of(spark, rows), labels)
    new = docs_of(spark, [(1, "x é nastyword y"), (2, "x y"), (3, None), (4, ""), (5, "z " * 50_000 + "nastyword"), (None, "nastyword"), (1, "x é nastyword y")])
    got = toxicity.tag(new, model).collect()
    by = {r["doc_id"]: r for r in got}
    assert [(s["start"], s["end"]) for s in by[1]["spans"]] == [(4, 13)]
    assert [(s["start"], s["end"]) for s in by[5]["spans"]] == [(100_000, 100_009)]
    assert by[1]["score"] >= 0.5 > by[2]["score"] and by[3]["score"] == by[4]["score"] < 0.5 and by[None]["score"] >= 0.5
    assert toxicity.tag(new.limit(0), model).count() == 0 and len(got) == 7
    named = new.withColumnRenamed("score", "a.b")
    left = toxicity.keep_civil(named, model)
    assert left.columns == named.columns and sorted(r["text"] or "" for r in left.collect()) == ["", "", "x y"]
    none = toxicity.train(docs_of(spark, rows), labels.limit(0))
    assert all(r["score"] < 1e-9 for r in toxicity.tag(new, none).collect())


# Quality rules


def brute_counts(text: str) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    times = Counter(windows)
    in_repeat = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = len(lines) - len(set(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(in_repeat)


QUALITY = ["", "   ", "a b c d e f a b c d e g", "é漢 x\n\nx\ny\nx\n \n", "# * $ % & | < >", "a b c d e " * 3, "\x1cword\x85word w", "one\ntwo\none\r\ntwo", "w " * 9 + "z"]


def test_counts_against_brute_force():
    r = random.Random(2)
    for t in QUALITY + [" ".join(r.choices("abc", k=r.randint(0, 40))) for _ in range(60)]:
        assert quality.counted(t)[:5] == brute_counts(t), t


def test_binomial_bound_is_exact():
    for k, n, e in ((0, 50, 0.05), (3, 100, 0.01), (40, 41, 0.1), (5, 5, 0.1)):
        p = quality.upper_bound(k, n, e)
        tail = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
        assert k == n and p == 1 or abs(tail - e) < 1e-6
    assert quality.beta_cdf(2, 3, 0) == 0 and quality.beta_cdf(2, 3, 1) == 1


def test_thresholds_hold_the_risk(spark):
    r = random.Random(3)
    good = [(k, " ".join(r.choices(["word", "other", "thing", "more", "text", "x#"], [5, 5, 5, 5, 5, 0.05], k=60))) for k in range(1500)]
    bad = [(2000 + k, " ".join(r.choices(["w#$%&", "o**", "thing"], k=60))) for k in range(50)]
    labels = spark.createDataFrame([(k, int(k < 2000)) for k, _ in good + bad], "doc_id long, quality int")
    odd = [(5000, None), (5001, ""), (5002, "few words"), (None, "a b c d e f g h i j k")]
    got = quality.judge(docs_of(spark, good + bad + odd), labels).collect()
    by = {r_["doc_id"]: r_ for r_ in got}
    assert sum(not by[k]["kept"] and not by[k]["base_failed"] for k, _ in good) <= 0.05 * 1500
    assert sum(by[k]["kept"] for k, _ in bad) == 0
    assert by[5000]["base_failed"] and not by[5001]["kept"] and not by[5002]["kept"] and by[None]["kept"]
    none = quality.judge(docs_of(spark, bad), labels.limit(0)).collect()
    assert all(r_["kept"] != r_["base_failed"] for r_ in none)
    assert quality.judge(docs_of(spark, []), labels).count() == 0
    left = {r_["doc_id"] for r_ in quality.keep_good(docs_of(spark, good + bad), labels).collect()}
    assert not left & {k for k, _ in bad} and len(left) >= 1400


def test_quality_decides_rows(spark):
    """Verdicts are of rows: rows with one id, or none, have their own; columns may have any name."""
    rows = [(None, "one two three four five six seven eight nine ten"), (None, "bad"), (7, "bad"), (7, "one two three four five six seven eight nine ten")]
    docs = docs_of(spark, rows).withColumnRenamed("fp", "n_words").withColumnRenamed("spans", "a.b")
    got = quality.keep_good(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] or 0, len(r["text"].split())) for r in got.collect()) == [(0, 10), (7, 10)]


def test_copies_are_one_trial(spark):
    """50 good texts, each 40 times, certify no more than 50 good texts do."""
    r = random.Random(4)
    words = [f"w{k}" for k in range(500)]
    texts = [" ".join(r.choices(words, k=60)) for _ in range(50)]
    bad = [(9000 + k, " ".join(r.choices(["w#$%&", "o**", *words[:20]], k=60))) for k in range(50)]
    for n, more, rejects in ((1, 0, False), (40, 0, False), (1, 400, True)):
        good = [(k, texts[k % 50]) for k in range(50 * n)] + [(5000 + k, " ".join(r.choices(words, k=60))) for k in range(more)]
        labels = spark.createDataFrame([(k, int(k < 9000)) for k, _ in good + bad], "doc_id long, quality int")
        got = quality.judge(docs_of(spark, good + bad), labels)
        assert (got.where("not kept and not base_failed").count() > 0) == rejects


def test_many_strata_have_their_own_cutoffs(spark):
    r = random.Random(5)
    words = [f"w{k}" for k in range(500)]
    rows = [(k, " ".join(r.choices(words if k % 10 else ["w#$%&", "o**", *words], k=40)), str(k % 100) if k < 5000 else None) for k in range(10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(k % 10 > 0)) for k, *_ in rows], "doc_id long, quality int")
    by = {r_["lang"]: r_["n"] for r_ in quality.judge(docs, labels).where("not kept").groupBy(F.col("stratum").alias("lang")).agg(F.count("*").alias("n")).collect()}
    assert set(by) <= {None} and quality.judge(docs, labels).count() == len(rows)  # 45 good labels certify nothing, a null stratum's 4,500 may


def naive_verdicts(docs: dict, labels: list) -> dict:
    """doc_id -> kept, in plain Python: docs by id (text, lang), labels (doc_id, quality)."""
    import xxhash

    h = lambda k: xxhash.xxh64_intdigest(str(k).encode(), 42)
    counts, scores = {}, {}
    for k, (text, _) in docs.items():
        words, chars, symbols, dup, repeat = brute_counts(text)
        lines = len([x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])
        upper, marks = sum(c.isupper() for c in text), sum(c in "!?;:=~^@{}[]()\\/_-+\"'`" for c in text)
        over = lambda a, b: a / max(1, b)
        parts = [4 * over(symbols, chars), 40 * over(symbols, chars), 4 * over(marks, chars), 20 * over(marks, chars), 2 * over(upper, chars), over(dup, lines), 5 * over(repeat, words), over(chars, words) / 40]
        counts[k] = words < 10 or 100 * repeat > 20 * words, [min(1.0, x) for x in parts]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    sketches, groups = {}, {}
    for k, q in sorted(labels, key=lambda x: signed(h(x[0]))):
        if k in docs and not counts[k][0]:
            codes = [zlib.crc32(w) for w in docs[k][0].encode().split()]
            hashes = [functools.reduce(lambda x, c: (x * 0x9E3779B97F4A7C15 + c) % (1 << 64), codes[j : j + 8], 0) for j in range(len(codes) - 7)]
            sketches[k] = signed(min(hashes))
            groups.setdefault((docs[k][1], q, sketches[k]), (k, q))
    held = list(groups.values())
    in_fit = lambda k: signed(xxhash.xxh64_intdigest(struct.pack("<q", sketches[k]), 42)) % 4 == 0
    fit = [(k, q) for k, q in held if in_fit(k)]
    weights = quality.fitted([(bool(q), counts[k][1]) for k, q in sorted(fit, key=lambda x: signed(h(x[0])))])
    for k, (_, parts) in counts.items():
        scores[k] = round(1 / (1 + math.exp(-sum(w * x for w, x in zip(weights, [1.0, *parts], strict=True)))), 9)
    share = lambda of, cut: sum(scores[k] >= cut for k in of) / max(1, len(of))
    gain = [share([k for k, q in held if not q], c) - 10 * share([k for k, q in held if q], c) for c in quality.GRID]
    cuts = {}
    strata = {docs[k][1] for k, _ in held}
    for s in strata:
        good = [k for k, q in held if q and docs[k][1] == s and not in_fit(k)]
        n = 0
        for cut in quality.GRID:
            out = sum(scores[k] >= cut for k in good)
            tail = sum(math.comb(len(good), j) * 0.05**j * 0.95 ** (len(good) - j) for j in range(out + 1))
            if tail > 0.05 / len(strata):
                break
            n += 1
        if n and max(gain[:n]) > 0:
            cuts[s] = quality.GRID[gain.index(max(gain[:n]))]
    return {k: not failed and not scores[k] >= cuts.get(docs[k][1], 2) for k, (failed, _) in counts.items()}


def test_quality_query_against_brute_force(spark):
    d = "/root/testdata/sf0.1"
    docs = {r["doc_id"]: (r["text"] or "", r["lang"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{d}/labels.parquet").collect()]
    want = naive_verdicts(docs, labels)
    rows = queries.op6_quality(spark, d).collect()
    for r in rows:
        counts = brute_counts(docs[r["doc_id"]][0])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts
        assert r["base_failed"] == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0])
    assert {r["doc_id"]: r["kept"] for r in rows} == want
    failed = {r["doc_id"] for r in rows if r["base_failed"]}
    for lang in ("en", "de", "es", "fr"):
        good, bad = ([k for k, q in labels if q == y and docs[k][1] == lang and k not in failed] for y in (1, 0))
        assert sum(not want[k] for k in bad) > 0.8 * len(bad) and sum(not want[k] for k in good) <= 0.05 * len(good), lang


# Near-duplicates


def naive_fingerprint(text: str) -> int:
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    if not grams:
        return 0
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_fingerprints(spark):
    for t in ["", " ", "a", "A b", "one two three four", "É a b c d e f", "x " * 500 + "y"]:
        assert simhash.fingerprint(t) == naive_fingerprint(t)
        assert simhash.fingerprint(t, block=7) == naive_fingerprint(t)


@pytest.mark.parametrize("groups", [5, 7])
def test_links_against_all_pairs(spark, groups):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1]
    fps = set(base)
    for b in base:
        for n in (1, 2, 3, 4, 5, 6):
            fps.add(b ^ sum(1 << k for k in r.sample(range(64), n)))
    for _ in range(60):
        fps.add(base[0] ^ sum(1 << k for k in r.sample(range(64), 2)))
    fps = sorted(map(simhash.signed, fps))
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = sorted((x["a"], x["b"]) for x in simhash.link(df, 4, groups).collect())
    want = sorted((a, b) for a, b in itertools.combinations(fps, 2) if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4)
    assert got == want


def test_components(spark):
    r = random.Random(5)
    links = [(r.randint(0, 200), r.randint(0, 200)) for _ in range(150)] + [(300 + k, 301 + k) for k in range(40)] + [(7, 7)]
    want = union(links, {x for p in links for x in p})
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: want[n] for n in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_classes(rows):
    fps = {k: naive_fingerprint(t or "") for k, t in rows}
    pairs = [(a, b) for a, b in itertools.combinations(sorted(fps), 2) if (fps[a] ^ fps[b]).bit_count() <= 4]
    return fps, union(pairs, fps)


def test_simhash_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    fps, roots = brute_classes(rows)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op8_simhash(spark, d).collect()}
    assert got == {k: (f"{fps[k]:016x}", roots[k]) for k in fps}


def test_near_duplicates_of_odd_rows(spark):
    rows = [(5, None), (3, ""), (9, " \n"), (2, "a b c d e"), (8, "A B C D E"), (8, "A B C D E"), (None, "a b c d e")]
    got = sorted(((r["doc_id"] is None, r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs_of(spark, rows)).collect()), key=str)
    assert got == sorted([(False, 5, 3), (False, 3, 3), (False, 9, 3), (False, 2, 2), (False, 8, 2), (False, 8, 2), (True, None, None)], key=str)
    kept = simhash.first_of_each(docs_of(spark, rows)).collect()
    assert sorted((r["doc_id"] for r in kept), key=str) == [2, 3, None] and kept[0]["source"] == "s"
    twice = simhash.first_of_each(docs_of(spark, [(2, "t u v w"), (2, "t u v w"), (3, "t u v w"), (2, "x y z q")]).withColumnRenamed("fp", "a.b"))
    assert sorted((r["doc_id"], r["text"]) for r in twice.collect()) == [(2, "t u v w"), (2, "x y z q")] and twice.columns[5] == "a.b"
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


# Secrets


def naive_spans(text: str, kinds: int = 3):
    out = []
    rules = [("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8), ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32)]
    rules += [("bearer", r"gh[pousr]_[A-Za-z0-9]{36,}", bool), ("pem", r"-----BEGIN (?:[A-Z0-9 ]* )?PRIVATE KEY-----", bool)]
    for k, (_, pattern, fits) in enumerate(rules[:kinds]):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text, re.A) if fits(m)]
    return sorted(out)


KINDS = ["assign", "access", "hex", "bearer", "pem"]
SECRETS = [
    None, "", "nothing", "é漢😀 password = hunter2hunter2 and TOKEN:'abcdefgh'", "secret: api_key: longvalue123 ", "token=password=abcdefghijk", "passwd=short passwd=longenough1",
    "AKIAAAAA AKIA" + "A" * 12 + " AKIA" + "B" * 30, "f" * 31 + " " + "0" * 32 + "g" + "a1" * 40, "password=" + "ab" * 20, "x" * 3 + "token=12345678token=12345678", "Api_Key=\"A/b+c_d.e=f-g\" ghp_" + "a1B2" * 9,
    "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY----- -----BEGIN  A  PRIVATE KEY----- -----BEGIN XPRIVATE KEY-----", "tokeN = = abcdefgh", "secret:abcdefgh\nsecret:abcdefgh",
]


def test_spans_against_python(spark):
    df = docs_of(spark, list(enumerate(SECRETS)) + [(99, SECRETS[3])])
    got = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(df).collect()}
    for k, t in [*enumerate(SECRETS), (99, SECRETS[3])]:
        assert [(s["start"], s["kind"], s["end"]) for s in got[k]] == naive_spans(t or "", 5), t
    assert [s["kind"] for s in got[12]] == [4] and 3 in [s["kind"] for s in got[11]]
    assert secrets.find_secrets(df.limit(0)).count() == 0


def test_texts_with_many_matches_or_long_runs(spark):
    rows = [(1, "é password=abcdefgh1 " * 200_000), (2, "-----BEGIN " + "A " * 20_000), (3, "-----BEGIN " + "A " * 20_000 + "PRIVATE KEY-----"), (4, "secret" + " " * 100_000), (5, ("ab" * 20 + " token=x ") * 3_000)]
    got = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(docs_of(spark, rows)).collect()}
    for k, t in rows:
        assert [(s["start"], s["kind"], s["end"]) for s in got[k]] == naive_spans(t, 5)
    texts = {r["doc_id"]: r["text"] for r in secrets.mask_secrets(docs_of(spark, rows)).collect()}
    assert texts[1] == "é [SECRET] " * 200_000 and texts[5] == "[SECRET] token=x " * 3_000 and texts[2] == rows[1][1]


def test_ledger_scans_only_what_it_lacks(spark):
    ledger = secrets.Ledger(spark)
    one = docs_of(spark, [(1, "password=abcdefgh1"), (2, "password=abcdefgh1"), (3, "x")])
    secrets.find_secrets(one, ledger=ledger)
    assert ledger.rows().count() == 2
    two = docs_of(spark, [(4, "password=abcdefgh1"), (5, "token=abcdefgh2")])
    got = {r["doc_id"]: len(r["spans"]) for r in secrets.find_secrets(two, ledger=ledger).collect()}
    assert got == {4: 1, 5: 1}
    batches = spark.read.schema(secrets.LEDGER).parquet(f"{ledger.path}/batch-*")
    assert batches.count() == 3  # the old content was not scanned again
    newer = [(*secrets.RULES[0][:1], 2, *secrets.RULES[0][2:]), *secrets.RULES[1:]]
    got = {r["doc_id"]: [s["version"] for s in r["spans"]] for r in secrets.find_secrets(two, ledger=ledger, rules=newer).collect()}
    assert got == {4: [2], 5: [2]}
    assert sorted(spark.read.schema(secrets.LEDGER).parquet(f"{ledger.path}/batch-*").where("size(versions) = 1").select("versions").first()[0]) == ["assign@2"]


def test_scans_at_once_count_once(spark, monkeypatch):
    """Two scans that both saw an empty ledger, then the query's operator twice over it: nothing is doubled, nothing scanned anew."""
    ledger, docs = secrets.Ledger(spark), docs_of(spark, [(1, "password=abcdefgh1 token=abcdefgh2"), (2, None), (3, "x")])
    want = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(docs).collect()}
    with monkeypatch.context() as m:
        m.setattr(secrets.Ledger, "rows", lambda self: None)
        for _ in range(2):
            ledger.scan(docs.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.coalesce("text", F.lit("")).alias("text")))
    assert sorted(len(r["versions"]) for r in ledger.rows().collect()) == [len(secrets.RULES)] * 3
    assert sum(len(r["spans"]) for r in ledger.rows().collect()) == 2
    other = secrets.Ledger(spark)
    for _ in range(2):
        assert {r["doc_id"]: r["spans"] for r in secrets.find_secrets(docs, ledger=other).collect()} == want
    assert spark.read.schema(secrets.LEDGER).parquet(f"{other.path}/batch-*").count() == 3


def test_masks(spark):
    df = docs_of(spark, [(1, "é password=abcdefgh1 end"), (2, None), (3, "clean"), (4, "password=" + "ab" * 20)])
    got = {r["doc_id"]: (r["text"], r["source"]) for r in secrets.mask_secrets(df).collect()}
    assert got == {1: ("é [SECRET] end", "s"), 2: (None, "s"), 3: ("clean", "s"), 4: ("[SECRET]", "s")}
    odd = df.withColumnRenamed("source", "a.b").withColumnRenamed("text", "the text")
    again = secrets.mask_secrets(odd, "the text")
    assert again.columns == odd.columns and {r["doc_id"]: (r["the text"], r["a.b"]) for r in again.collect()} == got


@pytest.mark.parametrize("block", [1, 3, 256])
def test_masks_in_blocks(spark, block):
    r = random.Random(8)
    rows = []
    for n in range(60):
        text = "".join(r.choices("aé漢😀 ", k=r.randint(0, 30)))
        spans = sorted((a, r.randint(a + 1, len(text))) for a in (r.randrange(len(text)) for _ in range(r.randint(0, 5) if text else 0)))
        out, at = "", 0
        for a, b in spans:
            out += text[at:a] + "#" if a >= at else ""
            at = max(at, b)
        rows.append((n, text, [{"start": a, "end": b} for a, b in spans], out + text[at:]))
    df = spark.createDataFrame(rows, "n int, text string, spans array<struct<start:int,end:int>>, want string")
    for x in df.withColumn("got", secrets.masked(F.col("text"), F.col("spans"), "#", block)).collect():
        assert x["got"] == x["want"], x


def test_secrets_query(spark):
    d = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in queries.op9_secrets(spark, d).collect():
        want = naive_spans(docs[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == n for _, k, _ in want) for n in range(3)]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in want).encode()).hexdigest()
        assert r["spans"] == ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in naive_spans(docs[r["doc_id"]], 5))


def test_no_python_on_the_secret_path(spark):
    plan = queries.op9_secrets(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# Pipeline


def test_pipeline_against_its_stages(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    score = {r["doc_id"]: r["predicted"] for r in queries.op5_toxicity(spark, d).collect()}
    civil = docs.where(F.col("doc_id").isin([k for k, y in score.items() if not y]))
    verdict = quality.judge(civil, spark.read.parquet(f"{d}/labels.parquet")).where("kept").select("doc_id")
    rows = sorted((r["doc_id"], r["text"]) for r in civil.join(verdict, "doc_id").collect())
    fps, roots = brute_classes(rows)
    left = {k: t for k, t in rows if roots[k] == k}
    from tokenizers import Tokenizer

    words = Tokenizer.from_file(queries.public_tokenizers.path("word_bpe_49k.json"))
    masked = {}
    for k, t in left.items():
        spans = sorted([(a, b) for a, _, b in naive_spans(t)] + [m.span() for n in (3, 4) for m in re.finditer(secrets.RULES[n][2], t)])
        out, at = "", 0
        for a, b in spans:
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, b)
        masked[k] = out + t[at:]
    want = {k: len(words.encode(t, add_special_tokens=False).ids) + 1 for k, t in masked.items()}
    got = corpus_pipeline.run(spark, d)
    assert {r["doc_id"]: r["doc_tokens"] for r in got.collect()} == want
    assert {r["doc_id"]: r["n"] for r in got.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == want
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), d).columns == docs.columns, name
