"""How filters interact: what each removes, alone, after others, and on average over all orders, for each part.

Each filter's failing documents are posting lists: sorted numbers of documents, for each part, kept for one range
of ids at a time. Whatever is asked about a set of filters is a union of lists, by a k-way merge that gallops over
runs of one list, and differences and intersections of two lists, galloping in the longer one. Sizes add up over
ranges, so ranges never meet: a task emits one row for each part, set of filters and further filter, and these are
summed. The 120 orders are looked up in the 80 pairs (filters before, filter) of a part; the Shapley value of a
filter weighs these by how many orders have just those filters before it.

Five filters here (``FLAGS``), as SQL over a text: under 100 words; less than 80 % of the words distinct; more than
10 % capitals; any of ``#$%&*|``; and text identical to that of a smaller id in the whole table, found by length
and digest, with a join whose both sides are shuffled, so that a large group of copies is split.

A row is a document, so repeated rows count each; a null id is no smaller than any and no copy of any, and has no
labels; null texts are empty texts, copies of each other; a null part is the empty string; an empty table gives no
rows; a document with several labels is good or toxic if one says so. Texts are read once, and only their flags and
digests are kept; other columns neither clash nor matter. Memory: ``RANGE`` documents a task.
"""

from __future__ import annotations

import heapq
import itertools
import math
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.llm.common import col_of, kept, per_batch

FILTERS = "ABCDE"
SPACE = "[ \\\\t-\\\\r]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What fails the filters of the text alone; ``words`` are its words.
FLAGS = {
    "A": "size(words) < 100",
    "B": "100L * size(array_distinct(words)) < 80L * size(words)",
    "C": f"100L * (char_length(text) - char_length(translate(text, '{CAPITALS}', ''))) > 10L * char_length(text)",
    "D": "text rlike '[#$%&*|]'",
}
#: Documents of a range of ids whose lists are merged at a time.
RANGE = 1 << 16
#: Filters before, as bits, and the filter after them.
PAIRS = [(before, f) for before in range(1 << len(FILTERS)) for f in range(len(FILTERS)) if not before >> f & 1]
COUNTS = ["documents", "united", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def gallop(ids: list[int], value: int, at: int) -> int:
    """The first place from ``at`` whose id isn't below ``value``: steps double, then the last one is halved."""
    step, n = 1, len(ids)
    while at + step < n and ids[at + step] < value:
        step <<= 1
    return bisect_left(ids, value, at + (step >> 1), min(at + step, n)) if at < n else n


def union(lists: list[list[int]]) -> list[int]:
    """The sorted union of sorted lists without repeats: runs of one list below all others' next ids are taken whole."""
    heads = [(x[0], k) for k, x in enumerate(lists) if x]
    heapq.heapify(heads)
    at, out = [0] * len(lists), []
    while heads:
        _, k = heapq.heappop(heads)
        mine, begin = lists[k], at[k]
        if not heads:
            out += mine[begin:]
            break
        # Up to the others' next id; where that is the same, the other list has it.
        at[k] = gallop(mine, heads[0][0], begin)
        out += mine[begin : at[k]]
        if at[k] < len(mine) and mine[at[k]] == heads[0][0]:
            at[k] += 1
        if at[k] < len(mine):
            heapq.heappush(heads, (mine[at[k]], k))
    return out


def difference(a: list[int], b: list[int]) -> list[int]:
    """What of ``a`` isn't in ``b``."""
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j = i + 1, j + 1
        elif a[i] < b[j]:
            end = gallop(a, b[j], i)
            out += a[i:end]
            i = end
        else:
            j = gallop(b, a[i], j)
    return out + a[i:]


def common(a: list[int], b: list[int]) -> int:
    """How many ids are in both."""
    n = i = j = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            n, i, j = n + 1, i + 1, j + 1
        elif a[i] < b[j]:
            i = gallop(a, b[j], i)
        else:
            j = gallop(b, a[i], j)
    return n


def interactions(lists: list[list[int]], documents: int, good: list[int], toxic: list[int]) -> list[tuple[int, ...]]:
    """COUNTS of each of PAIRS, from a part's posting lists of one range."""
    united = [union([x for f, x in enumerate(lists) if bits >> f & 1]) for bits in range(1 << len(lists))]
    every = len(united) - 1
    alone = [len(difference(x, united[every ^ 1 << f])) for f, x in enumerate(lists)]
    out = []
    for before, f in PAIRS:
        gone = difference(lists[f], united[before])
        out.append((documents, len(united[before]), len(gone), len(lists[f]) - len(gone), alone[f], common(gone, good), common(gone, toxic)))
    return out


class _Merger:
    """Posting lists of ranges of ids, as rows come sorted by id, and the sums of their sizes."""

    def __init__(self):
        self.part, self.bits, self.sums = [], [], {}

    def __call__(self, rows):
        self.part += rows["part"]
        self.bits += rows["bits"]
        if len(self.part) >= RANGE:
            self.close()
        return ()

    def close(self):
        names, part = np.unique(np.array(self.part, object), return_inverse=True) if self.part else ([], None)
        bits = np.array(self.bits, np.int64)
        for k, name in enumerate(names):
            mine = np.flatnonzero(part == k)
            lists = [mine[bits[mine] >> f & 1 == 1].tolist() for f in range(len(FILTERS) + 2)]
            got = np.array(interactions(lists[: len(FILTERS)], len(mine), *lists[len(FILTERS) :]), np.int64)
            self.sums[name] = self.sums[name] + got if name in self.sums else got
        self.part, self.bits = [], []

    def finish(self):
        self.close()
        for name, got in self.sums.items():
            yield {"part": [name] * len(PAIRS), "before": [b for b, _ in PAIRS], "filter": [f for _, f in PAIRS], **dict(zip(COUNTS, got.T.tolist(), strict=True))}


def flagged(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, bits) of every document: the filters that it fails, the first one's bit lowest."""
    rows = documents.select(col_of(documents, id_col).alias("id"), F.coalesce(col_of(documents, part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(col_of(documents, text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.expr(f"filter(split(text, '{SPACE}'), w -> w <> '')"))
    bits = sum((F.expr(FLAGS[f]).cast("int") * (1 << k) for k, f in enumerate(FILTERS[:-1])), F.lit(0))
    rows = kept(rows.select("id", "part", bits.alias("bits"), F.octet_length("text").alias("size"), F.unhex(F.sha2("text", 256)).alias("same")), "flags")
    # Written, so that the join shuffles both sides itself and can split a large group of copies.
    first = kept(rows.groupBy("size", "same").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "firsts")
    both = rows.join(first, ["size", "same"], "left")
    copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False)).cast("int") * (1 << (len(FILTERS) - 1))
    return both.select("id", "part", (F.col("bits") + copy).alias("bits"))


def pair_counts(flags: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, before, filter, COUNTS): for each part, every set of filters before and every filter after them."""
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    known = kept(labels.where(col_of(labels, id_col).isNotNull()).groupBy(col_of(labels, id_col).alias("id")).agg((says("quality") * 32 + says("toxic") * 64).alias("known")).where("known > 0"), "known")
    rows = flags.join(known, "id", "left").select("id", "part", (F.col("bits") + F.coalesce("known", F.lit(0))).alias("bits"))
    ranged = rows.repartitionByRange("id", "part", "bits").sortWithinPartitions("id")
    sums = per_batch(ranged.select("part", "bits"), _Merger, "part string, before int, filter int, " + ", ".join(f"{c} long" for c in COUNTS))
    return sums.groupBy("part", "before", "filter").agg(*(F.sum(c).alias(c) for c in COUNTS))


def orders(spark) -> DataFrame:
    """(filter_order, step, before, filter) of all steps of all orders: 600 rows."""
    rows = []
    for order in itertools.permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(FILTERS[k] for k in order), step, before, f))
            before |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, before int, filter int")


def audit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    counts = kept(pair_counts(flagged(documents, id_col, text_col, part_col), labels, id_col), "pairs")
    n = len(FILTERS)
    # So many orders have just these filters before.
    weight = F.create_map(*(F.lit(x) for k in range(n) for x in (k, math.factorial(k) * math.factorial(n - 1 - k))))[F.bit_count("before")]
    shapley = counts.groupBy("part", "filter").agg(F.sum(F.col("removed") * weight).alias("shapley"))
    out = counts.join(F.broadcast(orders(documents.sparkSession)), ["before", "filter"]).join(shapley, ["part", "filter"])
    kept_ = F.col("documents") - F.col("united") - F.col("removed")
    return out.select("part", "filter_order", "step", kept_.alias("kept"), "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
