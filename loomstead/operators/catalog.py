"""Catalogs: manifests (lib, path, dtype_name, ord) against types (namespace, name, props, ord) and file listings.

First-wins and last-wins rules are by the order columns, which must be unique within a library to be exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.functions import props as P
from loomstead.functions.text import dtype_name, dtype_namespace
from loomstead.plans.rounds import settled


def _typed(manifest: DataFrame) -> DataFrame:
    return manifest.withColumn("namespace", dtype_namespace(F.col("dtype_name"))).withColumn("name", dtype_name(F.col("dtype_name")))


def manifest_resolve(manifest: DataFrame, types: DataFrame) -> DataFrame:
    """Entries with the properties of their type."""
    return _typed(manifest).join(types.select("namespace", "name", "props"), ["namespace", "name"])


def manifest_unknown_types(manifest: DataFrame, types: DataFrame) -> DataFrame:
    """Entries whose type does not exist."""
    return _typed(manifest).join(types.select("namespace", "name").distinct(), ["namespace", "name"], "left_anti").select(*manifest.columns)


def manifest_existing(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Entries whose file is listed (lib, path)."""
    return manifest.join(files, ["lib", "path"], "left_semi")


def manifest_missing(manifest: DataFrame, files: DataFrame) -> DataFrame:
    return manifest.join(files, ["lib", "path"], "left_anti")


def name_last_wins(types: DataFrame) -> DataFrame:
    """(signature, name): the last registered name of each property set."""
    sig = P.signature(F.col("props"), F.array().cast("array<string>"))
    return types.groupBy(sig.alias("signature")).agg(F.max_by(F.concat_ws("::", "namespace", "name"), F.struct("ord", "namespace", "name")).alias("type_name"))


def type_name_of(instances: DataFrame, types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(instances with the name of their property set, instances of unknown sets)."""
    sig = P.signature(F.col("props"), F.array().cast("array<string>"))
    named = instances.withColumn("signature", sig)
    names = name_last_wins(types)
    return named.join(names, "signature").drop("signature"), named.join(names, "signature", "left_anti").drop("signature")


def mask_first_wins(rows: DataFrame, by: list[str | Column], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the first row of each group, the rows it masks), by ``order``. Groups only go by a running minimum and a join,
    so that a hot group isn't sorted in one task; ``order`` must tell the rows of a group apart."""
    keys = [F.col(b) if isinstance(b, str) else b for b in by]
    numbered = rows.withColumn("__k", F.struct(*(k.alias(f"c{n}") for n, k in enumerate(keys)))).withColumn("__o", F.struct(*order))
    first = numbered.groupBy("__k").agg(F.min("__o").alias("__first"))
    both = numbered.join(first, "__k")
    return both.where(F.col("__o") == F.col("__first")).select(*rows.columns), both.where(F.col("__o") != F.col("__first")).select(*rows.columns)


def library_union(libraries: list[DataFrame]) -> DataFrame:
    """Entries of all libraries, with ``lib_ord``, their place in the list."""
    out = None
    for k, lib in enumerate(libraries):
        one = lib.withColumn("lib_ord", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def manifest_upsert(manifest: DataFrame, items: DataFrame, on_exist: str = "error", files: DataFrame | None = None) -> DataFrame:
    """A manifest with items added; ``on_exist`` says what happens to those whose path is there already.

    ``skip`` keeps the file but takes the item's type (the entry counts as completed); ``replace`` takes the item;
    ``error`` raises if there is any. ``files`` lists what exists (default: what the manifest names). Returns the
    entries with ``action``: kept, added, retyped or replaced.
    """
    if on_exist not in ("skip", "replace", "error"):
        raise ValueError("on_exist is skip, replace or error")
    there = (files if files is not None else manifest).select("lib", "path").distinct()
    if on_exist == "error" and not items.join(there, ["lib", "path"], "left_semi").isEmpty():
        raise ValueError("some items are there already")
    known = items.join(there.withColumn("__there", F.lit(True)), ["lib", "path"], "left")
    action = F.when(F.col("__there"), "retyped" if on_exist == "skip" else "replaced").otherwise("added")
    new = known.withColumn("action", action).select(*manifest.columns, "action")
    old = manifest.join(items.select("lib", "path").distinct(), ["lib", "path"], "left_anti").withColumn("action", F.lit("kept"))
    return old.select(*manifest.columns, "action").unionByName(new)


def namespace_add(types: DataFrame, more: DataFrame) -> DataFrame:
    """Types with another namespace's; a namespace that is there already is refused."""
    if not more.join(types.select("namespace").distinct(), "namespace", "left_semi").isEmpty():
        raise ValueError("a namespace is there already")
    return types.unionByName(more)


def props_pack(rows: DataFrame, key: str, props: str = "props") -> DataFrame:
    """(key, packed): properties as a map from property key to its values, in order."""
    each = rows.select(key, F.explode(props).alias("p")).select(key, P.prop_key(F.col("p")).alias("k"), P.prop_value(F.col("p")).alias("v"))
    lists = each.groupBy(key, "k").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    return lists.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "vs")))).alias("packed"))


def library_fingerprint(manifest: DataFrame) -> DataFrame:
    """(lib, fingerprint): a five-digit key of each library's entries, independent of their order.

    Entries are digested one by one and their digests added up, so that a library's lines never meet in one row.
    """
    digest = F.conv(F.substring(F.sha2(F.concat_ws("=", "path", "dtype_name"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    sums = manifest.groupBy("lib").agg(F.sum(digest).alias("s"), F.count("*").alias("n"))
    return sums.select("lib", P.content_key(F.concat_ws(":", F.col("n").cast("string"), F.col("s").cast("string")), 5).alias("fingerprint"))


def fingerprint_of_lines(rows: DataFrame, key: str, line: Column) -> DataFrame:
    """(key, fingerprint): a five-digit key of a group's lines, sorted; groups are small, such as a plan's steps."""
    return rows.groupBy(key).agg(P.content_key(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 5).alias("fingerprint"))


def numbered(rows: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """Rows with ``name``, their 1-based number within ``by`` in the given order.

    Rows are dealt out in ranges of (by, order) and written, then numbered within a range: a hot group is spread
    over many tasks. What comes before a range's first group in earlier ranges is added to that group's numbers;
    there is at most one such row for each range.
    """
    placed = settled(rows.repartitionByRange(by, *order).withColumn("__range", F.spark_partition_id()))
    sizes = placed.groupBy(by, "__range").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    carried = sizes.select(F.struct(by).alias("__by"), F.col("__range").alias("__at"), before.alias("__before")).where("__before > 0")
    mine = placed.withColumn(name, F.row_number().over(Window.partitionBy(by, "__range").orderBy(*order)))
    both = mine.join(carried, (F.struct(by) == F.col("__by")) & (F.col("__range") == F.col("__at")), "left")
    return both.select(*rows.columns, (F.col(name) + F.coalesce("__before", F.lit(0))).cast("int").alias(name))


def step_order(steps: DataFrame, target: str, order: list[str]) -> DataFrame:
    """Steps with their 1-based number within a target's plan."""
    return numbered(steps, target, order, "step")


def process_dedupe(steps: DataFrame, target: str = "target") -> DataFrame:
    """The first step of each process (transform and key) in a plan."""
    process = [target, "transform", "key"]
    rest = [c for c in steps.columns if c not in process]
    first = steps.groupBy(*process).agg(F.min_by(F.struct(*rest), F.struct("step")).alias("__first"))
    return first.select(*(F.col(c) if c in process else F.col("__first").getField(c).alias(c) for c in steps.columns))


def plan_lengths(steps: DataFrame, target: str = "target") -> DataFrame:
    return steps.groupBy(target).agg(F.count("*").alias("n_steps"))


def solutions_ranked(solutions: DataFrame, target: str, cost: str, tie: str) -> DataFrame:
    """Alternatives of each target with their rank: fewest steps first, ties by name."""
    return numbered(solutions, target, [cost, tie], "rank")


def best_solution(targets: DataFrame, solutions: DataFrame, target: str, cost: str, tie: str) -> tuple[DataFrame, DataFrame]:
    """(the best alternative of each target, the targets that have none)."""
    best = solutions.groupBy(target).agg(F.min(F.struct(cost, tie)).alias("b")).select(target, f"b.{cost}", f"b.{tie}")
    return best, targets.join(solutions.select(target).distinct(), target, "left_anti")


def step_edges(steps: DataFrame, instances: DataFrame) -> DataFrame:
    """(target, step, role, ix, id, path): inputs and outputs of steps resolved to instances."""
    used = steps.select("target", "step", F.lit("use").alias("role"), F.posexplode("uses").alias("ix", "id"))
    made = steps.select("target", "step", F.lit("produce").alias("role"), F.posexplode("produces").alias("ix", "id"))
    return used.unionByName(made).join(instances.select("id", "path"), "id").select("target", "step", "role", "ix", "id", "path")


def publish_targets(products: DataFrame, targets: DataFrame) -> DataFrame:
    """Step products that are a plan's targets."""
    return products.join(targets.select("id").distinct(), "id", "left_semi")
