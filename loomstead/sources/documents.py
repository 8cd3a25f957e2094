"""Document tables (key, json), their secondary indexes (si_name, si_key, parent_key) and their registry.

A document is one row's JSON; an index posting says that a document (``parent_key``) has a value (``si_key``)
under an index. Postings are a set. Null values give no posting; null keys are refused by ``checked_append``.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstead.functions.text import index_value

POSTING = ["si_name", "si_key", "parent_key"]


def key_of(df: DataFrame, keys: list[str]) -> Column:
    """Several key columns joined by ``_``."""
    return F.concat_ws("_", *(df[k].cast("string") for k in keys))


def doc_import(df: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """(key, json) of rows; the document holds ``columns``, or all."""
    return df.select(key_of(df, keys).alias("key"), F.to_json(F.struct(*(columns or df.columns))).alias("json"))


def doc_scan(docs: DataFrame, schema: str) -> DataFrame:
    """Documents decoded: the key and the fields of ``schema``."""
    return docs.select("key", F.from_json("json", schema).alias("doc")).select("key", "doc.*")


def list_entries(docs: DataFrame) -> DataFrame:
    return docs.select("key")


def get_entry(docs: DataFrame, key: str) -> DataFrame:
    """The document of a key: no row if it is absent."""
    return docs.where(F.col("key") == key)


def absent_entries(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys asked for (column ``key``) that no document has."""
    return keys.join(docs, "key", "left_anti")


def si_rows(df: DataFrame, keys: list[str], indexes: dict[str, str]) -> DataFrame:
    """Postings of rows, from index name to column, in one pass and without a shuffle; equal rows give them again.

    Array columns give one posting a member; members that are arrays are joined by ``_``.
    """
    def posting(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("si_name"), value.alias("si_key"))

    def listed(name: str, column: str) -> Column:
        inner = isinstance(df.schema[column].dataType.elementType, T.ArrayType)
        values = F.transform(df[column], index_value) if inner else df[column].cast("array<string>")
        return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: posting(name, v))

    many = {n: c for n, c in indexes.items() if isinstance(df.schema[c].dataType, T.ArrayType)}
    # Plain columns need no function of members, so that they stay in generated code.
    plain = [posting(n, df[c].cast("string")) for n, c in indexes.items() if n not in many]
    each = [*([F.array(*plain)] if plain else []), *(listed(n, c) for n, c in many.items())]
    rows = df.select(key_of(df, keys).alias("parent_key"), F.inline(F.concat(*each) if many else each[0]))
    return rows.where("si_key is not null").select(*POSTING)


def si_build(df: DataFrame, keys: list[str], indexes: dict[str, str]) -> DataFrame:
    """Postings of rows, each once: ``si_rows`` as a set.

    Where different values give different postings, rows are made distinct as plain values before they are spread, so
    that fewer and shorter rows move: for keys of whole numbers, in rows where none is null (a null leaves no mark in a
    joined key), and for indexes over key columns and at most one other column. All else is made distinct as postings.
    """
    other = {n: c for n, c in indexes.items() if c not in keys}
    names = list(dict.fromkeys([*keys, *other.values()]))
    kinds = {f.name: f.dataType for f in df.schema}
    whole = lambda c: isinstance(kinds.get(c), T.IntegralType)
    if not keys or len(names) > len(set(keys)) + 1 or not all(map(whole, keys)) or not all(whole(c) or kinds.get(c) == T.StringType() for c in names):
        return si_rows(df, keys, indexes).dropDuplicates(POSTING)
    unmarked = reduce(or_, (df[k].isNull() for k in keys))
    full = df.where(~unmarked)
    # A joined key with a null has fewer parts than one without, so these postings are no others'.
    out = si_rows(df.where(unmarked), keys, indexes).dropDuplicates(POSTING)
    own = {n: c for n, c in indexes.items() if c in keys}
    for columns, some in ((list(dict.fromkeys(keys)), own), (names, other)):
        if some:
            out = out.unionByName(si_rows(full.select(*columns).distinct(), keys, some))
    return out


def key_catalog(docs: DataFrame, table_name: str) -> DataFrame:
    """(key, table_name): the top-level JSON keys that are seen."""
    return docs.select(F.explode(F.json_object_keys("json")).alias("key")).distinct().withColumn("table_name", F.lit(table_name))


def keys_of_table(catalog: DataFrame, table_name: str) -> DataFrame:
    return catalog.where(F.col("table_name") == table_name).select("key")


def keys_union(*catalogs: DataFrame) -> DataFrame:
    """The different keys of several catalogs."""
    out = catalogs[0].select("key")
    for c in catalogs[1:]:
        out = out.unionByName(c.select("key"))
    return out.distinct()


def si_names(si: DataFrame) -> DataFrame:
    return si.select("si_name").distinct()


def si_lookup(docs: DataFrame, si: DataFrame, key: str, si_name: str | None = None, distinct: bool = False) -> DataFrame:
    """Documents whose postings match a key: ``*`` and ``%`` are wildcards, then case doesn't count.

    A document found by two postings comes twice unless ``distinct``; an unknown index name gives no rows.
    """
    if "*" in key or "%" in key:
        hit = F.col("si_key").ilike(key.replace("\\", "\\\\").replace("*", "%"))
    else:
        hit = F.col("si_key") == key
    if si_name is not None:
        hit = hit & (F.col("si_name") == si_name)
    found = si.where(hit).select(F.col("parent_key").alias("key"))
    return docs.join(found.distinct() if distinct else found, "key")


def registry(tables: dict[str, tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """(name, type, fields) of named tables with their kind, frame and key columns; fields is a JSON array."""
    spark = next(iter(tables.values()))[1].sparkSession
    kinds = {"string": "TEXT", "double": "REAL", "float": "REAL"}
    rows = []
    for name, (kind, df, keys) in tables.items():
        fields = [f'{{"name":"{f.name}","is_pk":{str(f.name in keys).lower()},"dtype":"{kinds.get(f.dataType.simpleString(), "INTEGER" if isinstance(f.dataType, T.IntegralType) else "TEXT")}","not_null":{str(not f.nullable).lower()}}}' for f in df.schema]
        rows.append((name, kind, "[" + ",".join(fields) + "]"))
    return spark.createDataFrame(rows, "name string, type string, fields string")


FIELDS = "array<struct<name:string,is_pk:boolean,dtype:string,not_null:boolean>>"


def registry_types(reg: DataFrame) -> DataFrame:
    return reg.select("type").distinct()


def registry_tables(reg: DataFrame, kind: str | None = None, name: str | None = None) -> DataFrame:
    out = reg if kind is None else reg.where(F.col("type") == kind)
    return out if name is None else out.where(F.col("name") == name)


def registry_has(reg: DataFrame, names: DataFrame) -> DataFrame:
    """Those of the names asked for (column ``name``) that are registered."""
    return names.join(reg, "name", "left_semi")


def registry_fields(reg: DataFrame) -> DataFrame:
    """(table, position, name, is_pk, dtype, not_null) of every field."""
    return reg.select(F.col("name").alias("table"), F.posexplode(F.from_json("fields", FIELDS)).alias("position", "f")).select("table", "position", "f.*")


def info_table(values: DataFrame) -> DataFrame:
    """(key, val) metadata, from one row whose columns are the keys."""
    each = F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("val")) for c in values.columns))
    return values.select(F.inline(each))


def checked_rows(existing: DataFrame, batch: DataFrame, schema: T.StructType, keys: list[str]) -> DataFrame:
    """The rows of a batch in the declared types with ``reason``, why they can't be appended; null for good rows.

    Reasons, the first that holds: ``type`` (a value doesn't cast), ``null`` (a field that may not be null),
    ``duplicate`` (another row of the batch has the key), ``exists``.
    """
    if missing := {f.name for f in schema} ^ set(batch.columns):
        raise ValueError(f"the batch has other fields than declared: {sorted(missing)}")
    cast = batch.select(*(F.struct(F.col(f.name).alias("raw"), F.col(f.name).try_cast(f.dataType).alias("got")).alias(f.name) for f in schema))
    mistyped = F.lit(False)
    absent = F.lit(False)
    for f in schema:
        mistyped = mistyped | (F.col(f"{f.name}.raw").isNotNull() & F.col(f"{f.name}.got").isNull())
        absent = absent | (F.col(f"{f.name}.got").isNull() if not f.nullable or f.name in keys else F.lit(False))
    got = cast.select(*(F.col(f"{f.name}.got").alias(f.name) for f in schema), mistyped.alias("__mistyped"), absent.alias("__absent"))
    counted = got.join(got.where("not __mistyped and not __absent").groupBy(*keys).agg(F.count("*").alias("__n")), keys, "left")
    known = existing.select(*keys).distinct().withColumn("__known", F.lit(True))
    judged = counted.join(known, keys, "left")
    reason = F.when(F.col("__mistyped"), "type").when(F.col("__absent"), "null").when(F.col("__n") > 1, "duplicate").when(F.col("__known"), "exists")
    names = [f.name for f in schema]
    return judged.select(*names, reason.alias("reason"))


def checked_append(existing: DataFrame, batch: DataFrame, schema: T.StructType, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(table with the good rows, rejected rows with a reason) of appending a batch to a declared table."""
    judged = checked_rows(existing, batch, schema, keys)
    names = [f.name for f in schema]
    return existing.select(*names).unionByName(judged.where("reason is null").select(*names)), judged.where("reason is not null")
