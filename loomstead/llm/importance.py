"""Importance resampling of documents toward a target distribution of hashed n-grams.

A text is normalised once: ``A-Z`` lower-cased, every run of separators one space, none at the ends. It is
scanned once for the running CRC-32 at the start and the end of every word. The CRC of any run of words then
follows from two of these: with ``P[i]`` the CRC of the first ``i`` bytes, that of bytes ``i`` to ``j`` is
``P[j] ^ shift(P[i], j - i)``, where ``shift`` multiplies by x^(8 (j - i)) in GF(2) modulo the CRC's polynomial.
No run of words is ever built or read again.

Features are all runs of 1 to ``most_words`` words, hashed into ``buckets``. A document's features are written
once, two bytes each; counts of the buckets over all documents and all target texts, one number a bucket, come
to the driver, and the gains made of them go to tasks. A document's weight is the sum of its features' gains; its
score adds a Gumbel variate of its id, so that the highest scores are a sample without replacement, in proportion
to exp(weight / 1000). Ranks are numbers in the order of scores, over ranges of it.

Null and empty texts, and those without a word, have no features, weight 0 and no rank; repeated rows and ids are
rows of their own with the same score; a null id draws as the empty string does; very long texts are scanned in
blocks of ``BLOCK`` bytes, words longer than that whole; an empty table gives no rows, an empty target gains by
rarity alone; only the id and the text are read, so that other columns neither clash nor matter.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.llm.common import col_of, kept, numbered, per_batch

#: Letters to lower case; everything else in ASCII that is neither a letter nor a digit to a space.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: The CRC's polynomial, reflected.
POLYNOMIAL = 0xEDB88320
#: Bytes of normalised text that are words in memory at a time; lengths with a table of their own.
BLOCK, LENGTHS = 1 << 20, 96


def _step_table() -> np.ndarray:
    """What a byte's passing does to the register."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, c >> np.uint32(1) ^ np.uint32(POLYNOMIAL), c >> np.uint32(1))
    return c


STEP = _step_table()


def _zero_byte(c: np.ndarray) -> np.ndarray:
    return c >> np.uint32(8) ^ STEP[c & np.uint32(255)]


def _operator_tables(lengths: int) -> tuple[np.ndarray, np.ndarray]:
    """Tables (exponent, byte of the register, value): shifts by 0, 1, 2, ... bytes, and by powers of two of them."""
    unit = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * j) for j in range(4)])
    short = [unit]
    for _ in range(1, lengths):
        short.append(_zero_byte(short[-1]))
    power = [_zero_byte(unit)]
    for _ in range(1, 40):
        power.append(_through(power[-1], power[-1]))
    return np.stack(short), np.stack(power)


def _through(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    m = np.uint32(255)
    return table[0][c & m] ^ table[1][c >> np.uint32(8) & m] ^ table[2][c >> np.uint32(16) & m] ^ table[3][c >> np.uint32(24)]


SHORT, POWER = _operator_tables(LENGTHS)


def shift(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs (uint32) multiplied by x^(8 length) modulo the polynomial."""
    m, near = np.uint32(255), np.minimum(length, LENGTHS - 1)
    out = SHORT[near, 0, crc & m] ^ SHORT[near, 1, crc >> np.uint32(8) & m] ^ SHORT[near, 2, crc >> np.uint32(16) & m] ^ SHORT[near, 3, crc >> np.uint32(24)]
    far = np.flatnonzero(length >= LENGTHS)
    if len(far):
        c, rest = crc[far], length[far]
        for k in range(int(rest.max()).bit_length()):
            has = (rest >> k & 1).astype(bool)
            c[has] = _through(POWER[k], c[has])
        out[far] = c
    return out


def _blocks(data: bytes):
    """Lists of a normalised text's words, from at most ``BLOCK`` bytes at a time, or one word."""
    if len(data) <= BLOCK:
        yield data.split()
        return
    begin = 0
    while begin < len(data):
        end = begin + BLOCK
        if end < len(data):
            cut = data.rfind(b" ", begin, end)
            end = cut + 1 if cut >= begin else data.find(b" ", end) + 1 or len(data)
        yield data[begin:end].split()
        begin = end


def ngram_crcs(raw: bytes, most_words: int = 3):
    """(size, CRC-32 of all runs of so many words as uint32) of a UTF-8 text, for 1 to ``most_words``, block by block."""
    crc, at = 0, 0
    # Of the last words: the running CRC at their start and end, and the places of these.
    held = (np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))
    for words in _blocks(raw.translate(NORMAL)):
        if not words:
            continue
        n, crc32 = len(words), zlib.crc32
        first = words[0] if not at else b" " + words[0]
        crc = crc32(first, crc)
        ends = [crc, *(crc := crc32(w, crc32(b" ", crc)) for w in words[1:])]
        sizes = np.fromiter(map(len, words), np.int64, n)
        stops = np.cumsum(sizes + 1) - 1 + at + (at > 0)
        end = np.array(ends, np.uint32)
        before = np.concatenate([held[1][-1:] if at else np.zeros(1, np.uint32), end[:-1]])
        # The register is the complement of the CRC; a space passes through it.
        register = ~before
        start = ~(register >> np.uint32(8) ^ STEP[(register ^ np.uint32(32)) & np.uint32(255)])
        if not at:
            start[0] = 0
        at, fresh = int(stops[-1]), (start, end, stops - sizes, stops)
        s, e, b, z = (np.concatenate([x, y]) for x, y in zip(held, fresh, strict=True))
        old = len(s) - n
        for size in range(1, most_words + 1):
            low = max(old, size - 1)
            if low < len(s):
                i, j = slice(low - size + 1, len(s) - size + 1), slice(low, len(s))
                yield size, e[j] ^ shift(s[i], z[j] - b[i])
        held = tuple(x[-(most_words - 1) :] if most_words > 1 else x[-1:] for x in (s, e, b, z))


def hashed_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 10_000, most_words: int = 3) -> DataFrame:
    """(id, n_words, n_features, features) of every row; ``features``: buckets, little-endian unsigned 16-bit."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("there are 1 to 65536 buckets")
    rows = df.select(col_of(df, id_col).alias("id"), F.coalesce(col_of(df, text_col).cast("binary"), F.lit(b"")).alias("text"))

    def make():
        def step(got):
            out = {"id": got["id"], "n_words": [], "n_features": [], "features": []}
            for raw in got["text"]:
                found = list(ngram_crcs(bytes(raw), most_words))
                made = np.concatenate([np.zeros(0, "<u2"), *((c % np.uint32(buckets)).astype("<u2") for _, c in found)])
                out["n_words"].append(sum(len(c) for size, c in found if size == 1))
                out["n_features"].append(len(made))
                out["features"].append(made.tobytes())
            yield out

        return step

    return per_batch(rows, make, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_features long, features binary")


def bucket_counts(features: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """How often each bucket occurs in all rows of ``hashed_features``: ``buckets`` numbers."""

    class Count:
        def __init__(self):
            self.n = np.zeros(buckets, np.int64)

        def __call__(self, rows):
            for raw in rows["features"]:
                self.n += np.bincount(np.frombuffer(raw, "<u2"), minlength=buckets)
            return ()

        def finish(self):
            at = np.flatnonzero(self.n)
            yield {"bucket": at.tolist(), "n": self.n[at].tolist()}

    out = np.zeros(buckets, np.int64)
    for bucket, n in per_batch(features.select("features"), Count, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain: a thousand times the log ratio of its smoothed shares in the target and in the source, floored."""
    n, total, wanted = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (total + n) / ((s + 1) * (wanted + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight): the sums of gains."""

    def make():
        def step(got):
            yield {**{c: got[c] for c in ("id", "n_words", "n_features")}, "weight": [int(gain[np.frombuffer(raw, "<u2")].sum()) for raw in got["features"]]}

        return step

    return per_batch(features, make, f"id {features.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def resample(documents: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = 10_000, most_words: int = 3) -> DataFrame:
    """(id_col, n_features, weight, score, rank) of every document; rank: 1, 2, ... of those drawn, else null.

    Of the documents with at least ``least_words`` words, ``percent`` per cent with the highest scores are drawn,
    ties to the smaller id.
    """
    features = kept(hashed_features(documents, id_col, text_col, buckets, most_words), "features")
    wanted = bucket_counts(hashed_features(target, target.columns[0], target_text, buckets, most_words), buckets)
    gain = gains(bucket_counts(features, buckets), wanted)
    draw = (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    scored = weighed(features, gain).withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(draw))))
    able = F.col("n_words") >= least_words
    n = features.where(able).count()
    ranked = numbered(scored, [able.desc(), F.desc("score"), F.asc("id")], "rank", "ranked")
    rank = F.when(able & (F.col("rank") <= percent * n // 100), F.col("rank"))
    return ranked.select(F.col("id").alias(id_col), "n_features", "weight", "score", rank.alias("rank"))
