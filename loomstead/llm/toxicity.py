"""Toxic spans by a linear-chain conditional random field with two states; documents scored by its marginals.

Labels are of documents. Tokens of the training sample get theirs from tests of association: a word, or a
beginning of three to seven letters, is a cue if it is found in toxic documents so much more often than in
others that a likelihood-ratio statistic passes a level corrected for the number of tests, and the odds pass
``least_odds``. Tests compare documents of one group; groups are clusters of the sample's texts by their most
common words, so that the common words of a language with few toxic documents don't hide its cues. Cues are
taken one after another, the strongest first, each tested on what those before it leave unexplained; a token of
a toxic document is labelled toxic if it has a cue.

The field is trained on these tokens by full-batch gradient steps on the conditional likelihood. Its features
are words and beginnings that tokens labelled toxic have in at least ``least_docs`` documents; a word without
any has the background's score, in training as in use. So stretches of background words are one matrix power,
and forward-backward over a text takes only as many steps as it has other words.

A document's score is a logistic function of its largest marginal, of the expected number of toxic tokens, and of that number
for each word, fitted on the sample's labels. Offending offsets are code points of tokens whose marginal is at
least one half.

The sample is bounded: at most ``most_docs`` labelled documents of each class, taken in the order of a hash,
and ``most_chars`` code points in all; it is all that comes to the driver. Everything else runs over all rows.

Null and empty texts get the score of a text without toxic tokens; repeated rows score alike; rows with null or
repeated ids are scored each by its own text; without labels of both classes all scores are 0; other columns
aren't read. Memory: one text and a cache of units of bounded bytes.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.llm.common import TwoGenerations, beside, col_of, text_rows

WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (3, 4, 5, 6, 7)
CACHE_BYTES = 96 << 20
FOUND = "score double, spans array<struct<start:int,end:int>>"


def features(word: str) -> list[str]:
    """Features of a word in lower case: itself and its beginnings."""
    return ["=" + word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k)]


def clusters(docs: list[set[str]], groups: int = 8, common: int = 300, rounds: int = 10) -> np.ndarray:
    """A group number for each document: k-means over its common words, from documents far from each other."""
    times = Counter(w for d in docs for w in d)
    names = {w: k for k, (w, _) in enumerate(sorted(times.items(), key=lambda x: (-x[1], x[0]))[:common])}
    x = np.zeros((len(docs), len(names)), np.float32)
    for k, d in enumerate(docs):
        x[k, [names[w] for w in d if w in names]] = 1
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centres = x[[int(np.argmax(x.sum(1)))]]
    while len(centres) < min(groups, len(docs)):
        centres = np.vstack([centres, x[int(np.argmin((x @ centres.T).max(1)))]])
    for _ in range(rounds):
        of = np.argmax(x @ centres.T, axis=1)
        centres = np.array([x[of == k].mean(0) if (of == k).any() else centres[k] for k in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return np.argmax(x @ centres.T, axis=1)


def strength(a: int, b: int, nt: int, nc: int) -> float:
    """The likelihood-ratio statistic of being in a of nt toxic and b of nc other documents."""
    p = (a + b) / (nt + nc)
    cells = [(a, nt * p), (b, nc * p), (nt - a, nt * (1 - p)), (nc - b, nc * (1 - p))]
    return 2 * sum(x * math.log(x / e) for x, e in cells if x and e)


def cues(docs: list[set[str]], toxic: list[int], error: float, least_odds: float, least_docs: int = 4) -> set[str]:
    """Words and beginnings that tell toxic documents of one group, the strongest first, each from what is left."""
    nt, nc = sum(toxic), len(docs) - sum(toxic)
    if not nt or not nc:
        return set()
    times = Counter(f for k, d in enumerate(docs) if toxic[k] for f in {f for w in d for f in features(w)})
    frequent = {f for f, n in times.items() if n >= least_docs}
    del times
    #: feature -> document -> how many of its words have it, for toxic documents and for others
    inside: tuple[dict[str, Counter], dict[str, Counter]] = (defaultdict(Counter), defaultdict(Counter))
    for k, d in enumerate(docs):
        if toxic[k]:
            for w in d:
                for f in features(w):
                    if f in frequent:
                        inside[0][f][k] += 1
    words: dict[str, set[str]] = defaultdict(set)
    for k, d in enumerate(docs):
        for w in d:
            for f in features(w):
                if f in inside[0]:
                    words[f].add(w)
                    if not toxic[k]:
                        inside[1][f][k] += 1
    least = 2 * math.log(max(2, len(inside[0])) / error)

    def power(f: str) -> float:
        a, b = len(inside[0][f]), len(inside[1].get(f, ()))
        if a < least_docs or (a + 0.5) * (nc - b + 0.5) < least_odds * (b + 0.5) * (nt - a + 0.5):
            return 0.0
        return strength(a, b, nt, nc)

    powers = {f: p for f in inside[0] if (p := power(f)) >= least}
    out: set[str] = set()
    holders: dict[str, list[int]] = defaultdict(list)
    for k, d in enumerate(docs):
        for w in d:
            holders[w].append(k)
    while powers:
        best = max(powers, key=lambda f: (powers[f], len(f), f))
        out.add(best)
        touched = set()
        for w in words[best]:
            for f in features(w):
                for k in holders[w] if f in inside[0] else ():
                    of = inside[0 if toxic[k] else 1][f]
                    of[k] -= 1
                    if of[k] <= 0:
                        del of[k]
                touched.add(f)
            holders[w] = []
        for f in touched & powers.keys():
            powers[f] = power(f)
            if powers[f] < least:
                del powers[f]
        powers.pop(best, None)
    return out


@dataclass
class Field:
    """Weights of features, a bias, transition scores [from][to], and the document's logistic weights."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -4.0
    transition: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    document: tuple[float, ...] = (-50.0, 0.0, 0.0, 0.0)

    def __post_init__(self):
        self.powers: dict[int, tuple[np.ndarray, float]] = {}

    def word(self, word: str) -> float | None:
        """The emission score of state 1; None for a background word, whose score is the bias."""
        get = self.weights.get
        of = [w for f in features(word) if (w := get(f)) is not None]
        return self.bias + sum(of) if of else None

    def background(self, n: int) -> np.ndarray:
        """The product of n background steps, scaled; by squaring."""
        if n not in self.powers:
            step = np.exp(self.transition) * np.exp([0.0, self.bias])
            out, base, k = np.eye(2), step / step.max(), n
            while k:
                if k & 1:
                    out = out @ base
                    out /= out.max()
                base = base @ base
                base /= base.max()
                k >>= 1
            if len(self.powers) > 50_000:
                self.powers.clear()
            self.powers[n] = out
        return self.powers[n]

    def marginals(self, n_words: int, at: list[int], scores: list[float]) -> np.ndarray:
        """P(state 1) at the scored positions of a text of ``n_words`` words, the others being background."""
        if not at:
            return np.zeros(0)
        step = np.exp(self.transition)
        forward, before = np.ones(2), -1
        ahead = []
        for k, s in zip(at, scores, strict=True):
            if k == 0:
                forward = np.array([1.0, math.exp(min(s, 30.0))])
            else:
                gap = k - before - 1
                if before < 0:  # the text begins with background words
                    forward = np.array([1.0, math.exp(self.bias)]) @ self.background(gap - 1)
                else:
                    forward = forward @ self.background(gap)
                forward = forward @ step * [1.0, math.exp(min(s, 30.0))]
            forward = forward / forward.sum()
            ahead.append(forward)
            before = k
        backward, after = np.ones(2), n_words
        out = np.zeros(len(at))
        for i in range(len(at) - 1, -1, -1):
            backward = self.background(after - at[i] - 1) @ backward
            both = ahead[i] * backward
            out[i] = both[1] / both.sum()
            backward = step @ (np.array([1.0, math.exp(min(scores[i], 30.0))]) * backward)
            backward /= backward.sum()
            after = at[i]
        return out

    @staticmethod
    def summary(marginals: np.ndarray, n_words: int) -> tuple[float, ...]:
        top, mass = (float(marginals.max()), float(marginals.sum())) if len(marginals) else (0.0, 0.0)
        return 1.0, top, math.log1p(mass), math.log1p(100 * mass / (n_words + 20))

    def score(self, marginals: np.ndarray, n_words: int) -> float:
        total = sum(w * x for w, x in zip(self.document, self.summary(marginals, n_words), strict=True))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, total))))

    def read(self, words: list[str]) -> tuple[list[int], np.ndarray]:
        """Places of the words that aren't background, and their marginals."""
        scores = [self.word(w) for w in words]
        at = [k for k, s in enumerate(scores) if s is not None]
        return at, self.marginals(len(words), at, [scores[k] for k in at])


def train_field(sentences: list[list[str]], labels: list[list[int]], rounds: int = 60, rate: float = 0.5, l2: float = 1e-3, chunk: int = 128, least_docs: int = 2) -> Field:
    """A field from words and 0/1 labels of tokens; sequences are cut into chunks for the gradient only."""
    docs = Counter(f for s, y in zip(sentences, labels, strict=True) for f in {f for w in {w for w, mark in zip(s, y, strict=True) if mark} for f in features(w)})
    names = {f: k for k, f in enumerate(sorted(f for f, n in docs.items() if n >= least_docs))}
    rows = [(s[k : k + chunk], y[k : k + chunk]) for s, y in zip(sentences, labels, strict=True) for k in range(0, len(s), chunk)]
    n, width = len(rows), max((len(r[0]) for r in rows), default=1)
    of_word: dict[str, list[int]] = {}
    who, what = array("q"), array("q")
    gold, real = np.zeros((n, width), np.int8), np.zeros((n, width), bool)
    for i, (words, y) in enumerate(rows):
        gold[i, : len(y)], real[i, : len(y)] = y, True
        for j, w in enumerate(words):
            ids = of_word.get(w)
            if ids is None:
                ids = of_word[w] = [names[f] for f in features(w) if f in names]
            who.extend([i * width + j] * len(ids))
            what.extend(ids)
    who, what = np.array(who, np.int64), np.array(what, np.int64)  # from compact arrays: no list of numbers stands beside
    theta, bias, trans = np.zeros(len(names)), -3.0, np.zeros((2, 2))
    sums = [np.full(len(names), 1e-8), 1e-8, np.full((2, 2), 1e-8)]
    lengths, total = real.sum(1), max(1, int(real.sum()))
    pair_gold = np.zeros((2, 2))
    inner = real[:, 1:]
    for a in (0, 1):
        for b in (0, 1):
            pair_gold[a, b] = ((gold[:, :-1] == a) & (gold[:, 1:] == b) & inner).sum()
    for _ in range(rounds):
        emit = bias + np.bincount(who, weights=theta[what], minlength=n * width).reshape(n, width)
        e = np.exp(np.clip(emit, -30, 30))
        t = np.exp(trans)
        f, b = np.zeros((width, n, 2)), np.ones((width, n, 2))
        f[0] = np.stack([np.ones(n), e[:, 0]], 1)
        f[0] /= f[0].sum(1, keepdims=True)
        for j in range(1, width):
            f[j] = f[j - 1] @ t
            f[j, :, 1] *= e[:, j]
            f[j] /= f[j].sum(1, keepdims=True)
        for j in range(width - 2, -1, -1):
            nxt = b[j + 1].copy()
            nxt[:, 1] *= e[:, j + 1]
            nxt = nxt @ t.T
            nxt /= nxt.sum(1, keepdims=True)
            b[j] = np.where((j + 1 < lengths)[:, None], nxt, 1.0)
        post = f * b
        post = (post[..., 1] / post.sum(-1)).T
        error = np.where(real, post - gold, 0.0)
        pair = np.zeros((2, 2))
        for j in range(1, width):
            nxt = b[j].copy()
            nxt[:, 1] *= e[:, j]
            m = f[j - 1][:, :, None] * t[None] * nxt[:, None, :]
            m /= m.sum((1, 2), keepdims=True)
            pair += m[j < lengths].sum(0)
        grads = [np.bincount(what, weights=error.ravel()[who], minlength=len(names)) / total * 100 + l2 * theta, error.sum() / total * 100, (pair - pair_gold) / total * 100]
        for k, g in enumerate(grads):
            sums[k] = sums[k] + g * g
        theta = theta - rate * grads[0] / np.sqrt(sums[0])
        bias = float(bias - rate * grads[1] / np.sqrt(sums[1]))
        trans = trans - rate * grads[2] / np.sqrt(sums[2])
    return Field({f: float(theta[k]) for f, k in names.items()}, bias, trans)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression with both classes weighted alike, by Newton steps."""
    w = np.zeros(x.shape[1])
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return w


def fit(texts: list[str], toxic: list[int], error: float = 0.05, least_odds: float = 8.0) -> Field:
    """A field from texts and their 0/1 labels."""
    words = [[w.lower() for w in WORD.findall(t)] for t in texts]
    if len(set(toxic)) < 2:
        return Field()
    sets = [set(w) for w in words]
    groups, found = clusters(sets), []
    for g in range(groups.max() + 1):
        of = np.flatnonzero(groups == g).tolist()
        found.append(cues([sets[k] for k in of], [int(bool(toxic[k])) for k in of], error, least_odds))
    everywhere = set().union(*found)
    marks = [[int(bool(y) and not everywhere.isdisjoint(features(w))) for w in ws] for ws, y in zip(words, toxic, strict=True)]
    out = train_field(words, marks)
    seen = np.array([out.summary(out.read(ws)[1], len(ws)) for ws in words])
    out.document = tuple(float(w) for w in logistic(seen, np.array(toxic, float)))
    return out


def sample(docs: DataFrame, labels: DataFrame, most_docs: int, most_chars: int) -> tuple[list[str], list[int]]:
    """Texts and labels within the bounds, from docs (id, text) and labels (id, toxic), in the order of a hash of the id.

    Only ids and sizes are joined; texts are read for the ids that were picked. Of several labels of an id the
    largest counts; of several texts all count, each once, and all towards the bounds.
    """
    texts = docs.where("id is not null").select("id", F.char_length("text").alias("n"), F.xxhash64("text").alias("t")).join(labels.groupBy("id").agg(F.max("toxic").alias("toxic")), "id")
    sizes = texts.dropDuplicates(["id", "n", "t"]).groupBy("id", "toxic").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).withColumn("h", F.xxhash64(F.col("id").cast("string")))
    picked, chars = {}, 0
    for label in (1, 0):
        rows = 0
        for r in sizes.where(F.col("toxic") == label).orderBy("h", "id").limit(most_docs).collect():
            if rows + r["rows"] <= most_docs and chars + r["n"] <= most_chars * (1 if label == 0 else 0.5):
                chars += r["n"]
                rows += r["rows"]
                picked[r["id"]] = label
    if not picked:
        return [], []
    rows = docs.where(F.col("id").isin(list(picked))).distinct().orderBy("id", "text").collect()
    return [r["text"] for r in rows], [picked[r["id"]] for r in rows]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_docs: int = 800, most_chars: int = 6_000_000) -> Field:
    """A field from the labelled documents for which crc32(id) mod 5 is not 0; null labels don't count."""
    y = labels.select(col_of(labels, id_col).alias("id"), "toxic").where("toxic is not null and crc32(cast(id as string)) % 5 <> 0")
    return fit(*sample(text_rows(docs, id_col, text_col), y, most_docs, most_chars))


def _scorer(model: Field, threshold: float):
    def value(unit: str):
        """The number of words, or that and (index, score, start, end) of those that aren't background."""
        hits, n = [], 0
        for n, m in enumerate(WORD.finditer(unit), 1):
            s = model.word(m[0].lower())
            if s is not None:
                hits.append((n - 1, s, m.start(), m.end()))
        return (n, hits) if hits else n

    cache = TwoGenerations(value, CACHE_BYTES, each=0, entry=400)

    def one(text: str):
        units = text.split(" ")
        got = [cache[u] for u in units]
        n, at, scores, places, chars = 0, [], [], [], 0
        for u, v in zip(units, got, strict=True):
            if v.__class__ is int:
                n += v
            else:
                for k, s, a, b in v[1]:
                    at.append(n + k)
                    scores.append(s)
                    places.append((chars + a, chars + b))
                n += v[0]
            chars += len(u) + 1
        m = model.marginals(n, at, scores)
        return model.score(m, n), [{"start": a, "end": b} for (a, b), p in zip(places, m, strict=True) if p >= threshold]

    def step(rows):
        got = [one(t or "") for t in rows["text"]]
        return {"score": [g[0] for g in got], "spans": [g[1] for g in got]}

    return step


def tag(df: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The id column, ``score`` and ``spans``, the offsets of offending tokens, for every row."""
    rows = text_rows(df, id_col, text_col)
    return beside(rows, {"text": "text"}, lambda: _scorer(model, threshold), FOUND).select(F.col("id").alias(id_col), "score", "spans")


def keep_civil(docs: DataFrame, model: Field, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose score is ``least`` or more, each by its own text; columns stay as they are."""
    plain = [f"c{k}" for k in range(len(docs.columns))]
    rows = docs.select(*(col_of(docs, c).alias(n) for c, n in zip(docs.columns, plain, strict=True)))
    scored = beside(rows, {"text": plain[docs.columns.index(text_col)]}, lambda: _scorer(model, 0.5), FOUND)
    return scored.where(F.col("score") < least).select(*(F.col(n).alias(c) for c, n in zip(docs.columns, plain, strict=True)))
