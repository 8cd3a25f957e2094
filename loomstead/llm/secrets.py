"""Secret scans over an incremental ledger of contents, in DataFrame and SQL functions only.

Every version of every text is addressed by its SHA-256. A ledger in the shared folder (or a folder given)
holds which (content, rule version) pairs have been scanned and what was found; a scan reads the ledger, takes
only contents and versions that aren't in it, appends its findings, and joins findings back to all rows that
have the content. A ledger's batches are separate Parquet folders: a failed job leaves no half-written one.

Spans are code points, the end exclusive. A rule's matches are leftmost and don't overlap; matches too short
for the rule are dropped after matching, as they use up their text. The text is cut at the matches once; begins
and ends are running sums of the lengths of gaps and matches, so work grows with a text, not with its square.

Null texts are empty; repeated contents are scanned once; empty tables give no rows; other columns aren't
read. A content is one row's text, however often it occurs; the join back is split where one content is hot.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.llm.common import col_of, free_name, kept, shared_dir, text_rows

#: Kind, version, pattern (Java), group whose length counts, least length. The first three are
#: the base rules, in the order in which ties are listed; the others are added by this operator. Runs of one
#: class have their least length in the pattern: a run is taken whole, so that finds the same spans.
RULES = [
    ("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", 1, r"AKIA[A-Z0-9]{12,}", 0, 0),
    ("hex", 1, r"[0-9a-f]{32,}", 0, 0),
    ("bearer", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("pem", 2, r"-----BEGIN (?:[A-Z0-9 ]* )?PRIVATE KEY-----", 0, 0),
]
BASE = 3
SPAN = "array<struct<kind:int,version:int,start:int,end:int>>"
LEDGER = f"digest string, versions array<string>, spans {SPAN}"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, together: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array of longs, by doubling: as many passes as its size has bits."""
    steps = F.when(F.size(values) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(values))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))

    def double(acc: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(acc, lambda x, i: F.when(i >= back, together(x, F.get(acc, i - back))).otherwise(x))

    return F.aggregate(steps, values, double)


def spans_of(text: Column, kind: int, rule: tuple) -> Column:
    """Spans of one rule in a text."""
    _, version, pattern, group, least = rule
    lengths = lambda parts: F.transform(parts, lambda p: F.char_length(p).cast("long"))
    found = lambda g: F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(g))

    def placed(n: Column) -> Column:
        # Where the matches end; the part after the last match is of no use.
        gaps = F.slice(lengths(F.split(text, pattern, -1)), F.lit(1), F.size(n))
        return bound(F.zip_with(gaps, n, lambda g, k: g + k), lambda v: bound(running(v, lambda a, b: a + b), lambda ends: listed_(ends, n)))

    def listed_(ends: Column, n: Column) -> Column:
        rows = F.arrays_zip(ends.alias("end"), n.alias("n"), (lengths(found(1 + group)) if group else n).alias("enough"))
        return F.transform(F.filter(rows, lambda r: r["enough"] >= least), lambda r: F.struct(F.lit(kind).alias("kind"), F.lit(version).alias("version"), (r["end"] - r["n"]).cast("int").alias("start"), r["end"].cast("int").alias("end")))

    return F.when(F.regexp_like(text, F.lit(pattern)), bound(lengths(found(1)), placed)).otherwise(F.array().cast(SPAN))


def version_of(rule: tuple) -> str:
    return f"{rule[0]}@{rule[1]}"


class Ledger:
    """What has been scanned, as Parquet batches below one folder.

    Scans at once may both find a content that is in no batch yet; what they write is the same, and counts once.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or shared_dir(spark, "ledger")

    def rows(self) -> DataFrame | None:
        """One row for each content: versions scanned and spans found; None before the first scan."""
        try:
            read = self.spark.read.schema(LEDGER).parquet(f"{self.path}/batch-*")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return read.groupBy("digest").agg(F.array_distinct(F.flatten(F.collect_list("versions"))).alias("versions"), F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))

    def scan(self, texts: DataFrame, rules: list[tuple] = RULES) -> None:
        """Scan the contents of ``texts`` (digest, text) for those rule versions that the ledger lacks."""
        known, every = self.rows(), F.array(*(F.lit(version_of(r)) for r in rules))
        contents = texts.distinct()
        if known is None:
            todo = contents.withColumn("todo", every)
        else:
            todo = contents.join(known.select("digest", "versions"), "digest", "left")
            todo = todo.withColumn("todo", F.when(F.col("versions").isNull(), every).otherwise(F.array_except(every, "versions"))).where(F.size("todo") > 0)
        found = [F.when(F.array_contains("todo", version_of(r)), spans_of(F.col("text"), k, r)).otherwise(F.array().cast(SPAN)) for k, r in enumerate(rules)]
        out = todo.select("digest", F.col("todo").alias("versions"), F.concat(*found).alias("spans"))
        out.write.option("compression", "zstd").parquet(f"{self.path}/batch-{uuid.uuid4().hex}")


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: Ledger | None = None, rules: list[tuple] = RULES) -> DataFrame:
    """The id column and ``spans``: array of (kind index, version, start, end) by start, then kind, for every row."""
    ledger = ledger or Ledger(df.sparkSession)
    rows = text_rows(df, id_col, text_col).withColumn("digest", F.sha2("text", 256))
    ledger.scan(rows.select("digest", "text"), rules)
    current = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(r[1]).alias("version")) for k, r in enumerate(rules)))
    # Written, so that the join below shuffles both sides itself and can split a hot content's rows.
    found = ledger.rows().where(F.size("spans") > 0).select("digest", F.filter("spans", lambda s: F.array_contains(current, F.struct(s["kind"].alias("kind"), s["version"].alias("version")))).alias("spans"))
    found = kept(found, "findings")
    sorted_ = F.sort_array(F.transform(F.coalesce("spans", F.array().cast(SPAN)), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["version"].alias("version"))))
    return rows.select("id", "digest").join(found, "digest", "left").select(F.col("id").alias(id_col), sorted_.alias("spans"))


def listed(spans: Column, rules: list[tuple] = RULES) -> Column:
    """``kind:start:end`` of spans in their order, comma-joined."""
    names = F.array(*(F.lit(r[0]) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column, mask: str = "[SECRET]", block: int = 256) -> Column:
    """A text with its spans, sorted by start, replaced; overlapping spans by one mask.

    The text is cut into blocks, so that a part is found without a walk from the start.
    """

    def part(blocks: Column, a: Column, b: Column) -> Column:
        """Code points a to b, the end exclusive."""
        first, last = F.floor(a / block).cast("int"), F.floor(b / block).cast("int")
        head, tail = F.coalesce(F.get(blocks, first), F.lit("")), F.coalesce(F.get(blocks, last), F.lit(""))
        many = F.concat(F.substring(head, a % block + 1, F.lit(block)), F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(tail, F.lit(1), b % block))
        return F.when(first == last, F.substring(head, a % block + 1, b - a)).otherwise(many)

    def replaced(blocks: Column) -> Column:
        # A span that begins before the end of those before it continues their mask.
        reach = bound(F.transform(spans, lambda s: s["end"].cast("long")), lambda v: running(v, F.greatest))
        return bound(reach, lambda r: F.concat(F.array_join(F.transform(spans, lambda s, i: kept_part(blocks, s, r, i)), ""), part(blocks, F.element_at(r, -1).cast("int"), F.char_length(text))))

    def kept_part(blocks: Column, s: Column, reach: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(reach, i - 1)).otherwise(F.lit(0)).cast("int")
        return F.when(s["start"] >= before, F.concat(part(blocks, before, s["start"]), F.lit(mask))).otherwise(F.lit(""))

    return F.when(F.size(spans) == 0, text).otherwise(bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0)), replaced))


def mask_secrets(docs: DataFrame, text_col: str = "text", ledger: Ledger | None = None) -> DataFrame:
    """``docs`` with every span masked in its text; null texts stay null. Findings join on the content."""
    ledger = ledger or Ledger(docs.sparkSession)
    digest, found_name, text = free_name(docs, "digest"), free_name(docs, "spans"), col_of(docs, text_col)
    rows = docs.withColumn(digest, F.sha2(F.coalesce(text, F.lit("")), 256))
    ledger.scan(rows.select(F.col(digest).alias("digest"), F.coalesce(col_of(rows, text_col), F.lit("")).alias("text")))
    order = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    found = ledger.rows().where(F.size("spans") > 0).select(F.col("digest").alias(digest), order.alias(found_name))
    out = rows.join(kept(found, "findings"), digest, "left")
    new = F.when(F.col(found_name).isNotNull(), masked(col_of(out, text_col), F.col(found_name))).otherwise(col_of(out, text_col))
    return out.select(*((new if c == text_col else col_of(out, c)).alias(c) for c in docs.columns))
