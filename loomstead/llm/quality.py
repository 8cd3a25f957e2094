"""Quality of documents: one score whose cutoffs are certified on labelled holdouts, by exact binomial bounds.

A base verdict comes first (too few words, or too many in repeated windows). Beyond it each document has one
score: a logistic function of shares counted in its text (symbols, marks, capitals, repeated lines and words,
length of words), fitted on a part of the labelled documents, drawn by a hash of the text and bounded by
``most_fit`` rows, the only rows that come to the driver.

Copies aren't independent trials: of the documents of one stratum and label whose smallest hash of a window of
eight words is the same, one counts (that with the smallest hash of its id). That makes one of all exact copies, of
near copies as likely as their windows are alike (about 0.7 at five-word similarity 0.8), and hardly of any others;
what is made one is also on one side, in the fitting part or outside it.

The other labelled documents certify. In each stratum cutoffs are tested from the mildest on a fixed grid: one
is certified while the exact (Clopper-Pearson) upper bound of the rate at which it rejects documents labelled
good stays within ``risk``, at confidence 1 - ``error`` / strata (Bonferroni); testing stops at the first
failure, so the grid needs no further correction, and all certified cutoffs of all strata hold at once: with
probability 1 - ``error`` no stratum loses more than ``risk`` of its good documents. About 90 good labels that
stay certify a cutoff where there are four strata.

Of a stratum's certified cutoffs the one is used that gains most over all strata's labels: the share of bad
documents rejected less ``cost`` times the share of good ones. ``cost`` is a preference, not part of the
guarantee: a lost good document weighs as ten kept bad ones do. Where none gains, nothing is rejected.

Counts and cutoffs of the strata, of any number, are tables in Spark, joined back to the rows; null is a stratum
like others. The driver sees two rows of totals.

Null and empty texts have no words and fail the base verdict; every row has its own result, repeated and null
ids too; a document with both labels counts once for each; ids missing from the labels are judged like
others; an empty label table certifies nothing, so that all that pass the base verdict are kept; other columns
pass through ``keep_good`` as they are. Memory: one text a task.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.llm.common import beside, col_of, kept, per_batch

SYMBOLS, SPACE = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_marks long, sketch long"
NAMES = [c.split()[0] for c in COUNTS.split(", ")]
#: What the score is made of, as SQL over the counts; all lie between 0 and 1.
PARTS = {
    "symbols": "least(1, 4 * n_symbols / greatest(word_chars, 1))",
    "any_symbols": "least(1, 40 * n_symbols / greatest(word_chars, 1))",
    "marks": "least(1, 4 * n_marks / greatest(word_chars, 1))",
    "any_marks": "least(1, 20 * n_marks / greatest(word_chars, 1))",
    "upper_case": "least(1, 2 * n_upper / greatest(word_chars, 1))",
    "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "least(1, 5 * n_repeat_words / greatest(n_words, 1))",
    "long_words": "least(1, word_chars / greatest(n_words, 1) / 40)",
}
#: How many words the windows have whose smallest hash tells copies.
SKETCH = 8
#: Cutoffs of the score from mild to strict; a document is rejected from the cutoff on.
GRID = [k / 200 for k in range(199, 9, -1)]


def windows(codes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each window of ``size`` words, from 32-bit hashes of words."""
    n = max(0, len(codes) - size + 1)
    mixed = np.zeros(n, np.uint64)
    for k in range(size):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    return mixed


def repeated_words(words: list[bytes], hashes: np.ndarray, size: int = 5) -> int:
    """How many words are in windows of ``size`` words that are found twice or more."""
    if len(hashes) < 2:
        return 0
    _, back, times = np.unique(hashes, return_inverse=True, return_counts=True)
    maybe = np.flatnonzero(times[back] > 1)
    if not len(maybe):
        return 0
    seen: dict[tuple, int] = {}  # windows of equal hash, compared exactly
    for k in maybe.tolist():
        w = tuple(words[k : k + size])
        seen[w] = seen.get(w, 0) + 1
    mark = np.zeros(len(words) + 1, np.int64)
    for k in maybe.tolist():
        if seen[tuple(words[k : k + size])] > 1:
            mark[k] += 1
            mark[k + size] -= 1
    return int((np.cumsum(mark[:-1]) > 0).sum())


def counted(text: str) -> tuple[int, ...]:
    """The counts of a text, in the order of COUNTS."""
    raw = text.encode()
    bare = raw.translate(None, SPACE)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(SPACE)]
    plain = bare.translate(None, b"!?;:=~^@{}[]()\\/_-+\"'`")
    upper = sum(map(str.isupper, text)) if not text.isascii() else len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    codes = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    hashes = windows(codes, SKETCH)
    sketch = int(hashes.min().view(np.int64)) if len(hashes) else 0
    return len(words), len(text) - (len(raw) - len(bare)), len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words, windows(codes, 5)), len(lines), upper, len(bare) - len(plain), sketch


def _counter():
    def step(rows):
        got = list(zip(*(counted(t or "") for t in rows["text"]), strict=True)) or [()] * len(NAMES)
        return dict(zip(NAMES, map(list, got), strict=True))

    return step


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """id, stratum and the counts of every row."""
    rows = df.select(col_of(df, id_col).alias("id"), col_of(df, stratum_col).cast("string").alias("stratum"), col_of(df, text_col).alias("text"))
    return beside(rows, {"text": "text"}, _counter, COUNTS).drop("text")


def base_failed() -> Column:
    return F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")


def beta_cdf(a: float, b: float, x: float) -> float:
    """The regularized incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    total = d
    for m in range(1, 10_000):
        for f in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + f * d)
            c = 1 + f / c
            total *= c * d
        if abs(c * d - 1) < 1e-12:
            break
    return front * total


def upper_bound(k: int, n: int, error: float) -> float:
    """The exact upper confidence bound of a rate from k of n, at confidence 1 - error."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - beta_cdf(k + 1, n - k, mid) > error else (low, mid)
    return high


def certified(good: int, good_out: list[int], risk: float, error: float) -> int:
    """How many steps of the grid are certified, from how many good rows there are and how many each step rejects."""
    n = 0
    while n < len(good_out) and upper_bound(good_out[n], good, error) <= risk:
        n += 1
    return n


def fitted(rows: list[tuple[bool, list[float]]], ridge: float = 1.0, rounds: int = 30) -> list[float]:
    """Weights (the constant first) of a logistic regression of "bad" on the parts, both classes weighted alike."""
    bad = np.array([not good for good, _ in rows], float)
    if len(set(bad.tolist())) < 2:
        return [-20.0, *[0.0] * len(PARTS)]
    x = np.array([[1.0, *parts] for _, parts in rows])
    weight = np.where(bad == 1, 0.5 / bad.sum(), 0.5 / (1 - bad).sum()) * len(bad)
    w, shrink = np.zeros(x.shape[1]), np.diag([1e-6, *[ridge] * len(PARTS)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + shrink, x.T @ (weight * (p - bad)) + shrink @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def score(weights: list[float]) -> Column:
    """The score of counts, 0 to 1, rounded so that equal counts compare equal anywhere."""
    total = F.lit(weights[0])
    for w, part in zip(weights[1:], PARTS.values(), strict=True):
        total = total + F.lit(w) * F.expr(part)
    return F.round(1 / (1 + F.exp(-total)), 9)


def verdicts(rows: DataFrame, labels: DataFrame, id_col: str, risk: float, error: float, cost: float, most_fit: int) -> DataFrame:
    """Rows of counts (id, stratum, base_failed and others) with ``kept``, learned from those that are labelled."""
    stratum = F.coalesce(F.concat(F.lit("="), "stratum"), F.lit("null"))
    known = labels.where("quality in (0, 1)").select(col_of(labels, id_col).alias("id"), (F.col("quality") == 1).alias("good"))
    order = F.xxhash64(F.col("id").cast("string")).alias("order")
    labelled = rows.where(~F.col("base_failed")).select("id", stratum.alias("s"), *NAMES).join(known, "id").select("s", "good", F.struct(order, *NAMES).alias("row"))
    one = labelled.groupBy("s", "good", "row.sketch").agg(F.min("row").alias("row"))
    held = kept(one.select("s", "good", "row.*", (F.pmod(F.xxhash64("sketch"), F.lit(4)) == 0).alias("fit")), "labelled")
    fit = held.where("fit").select("good", F.array(*(F.expr(p).cast("double") for p in PARTS.values())).alias("parts"), "order").orderBy("order", "good", "parts").limit(most_fit)
    scored = held.withColumn("score", score(weights := fitted([(r["good"], r["parts"]) for r in fit.collect()])))
    counts = [F.count("*").alias("n"), F.array(*(F.count_if(F.col("score") >= cut) for cut in GRID)).alias("out")]
    gain = np.zeros(len(GRID))
    for r in scored.groupBy("good").agg(*counts).collect():
        gain += np.array(r["out"]) * (-cost if r["good"] else 1.0) / r["n"]
    share = error / max(1, scored.agg(F.count_distinct("s")).first()[0])

    def make():
        def step(rows):
            cuts = []
            for n, out in zip(rows["n"], rows["out"], strict=True):
                steps = certified(n, out, risk, share)
                cuts.append(GRID[int(gain[:steps].argmax())] if steps and gain[:steps].max() > 0 else None)
            yield {"s": rows["s"], "cut": cuts}

        return step

    cuts = kept(per_batch(scored.where("good and not fit").groupBy("s").agg(*counts), make, "s string, cut double"), "cutoffs")
    judged = rows.withColumn("s", stratum).join(cuts, "s", "left")
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(score(weights) < F.col("cut"), F.lit(True))).drop("s", "cut")


def judge(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", risk: float = 0.05, error: float = 0.05, cost: float = 10.0, most_fit: int = 20_000) -> DataFrame:
    """id, the counts, base_failed and kept for every row; ``labels`` has the id and quality (1: good, 0: bad)."""
    rows = kept(measures(df, id_col, text_col, stratum_col), "measures").withColumn("base_failed", base_failed())
    return verdicts(rows, labels, id_col, risk, error, cost, most_fit).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", risk: float = 0.05, error: float = 0.05, cost: float = 10.0, most_fit: int = 20_000) -> DataFrame:
    """``docs`` without the rows that are rejected, each by its own text; columns stay as they are."""
    plain = [f"c{k}" for k in range(len(docs.columns))]  # names that clash with none of the counts
    of = {c: col_of(docs, c) for c in docs.columns}
    rows = docs.select(*(of[c].alias(n) for c, n in zip(docs.columns, plain, strict=True)), of[id_col].alias("id"), of[stratum_col].cast("string").alias("stratum"))
    rows = kept(beside(rows, {"text": plain[docs.columns.index(text_col)]}, _counter, COUNTS), "measured").withColumn("base_failed", base_failed())
    good = verdicts(rows, labels, id_col, risk, error, cost, most_fit).where("kept")
    return good.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, plain, strict=True)))
