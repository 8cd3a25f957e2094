"""Type libraries, manifests and plans as files: packed JSON documents (which are YAML too) or YAML.

YAML is read by PyYAML where that is installed; JSON always. One file is one document, read whole; files that
don't parse are rows with an error rather than failed jobs.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEM = r"([^/]*?)(?:\.[^./]*)?$"


def parsed(text: str):
    """A document, or ValueError."""
    try:
        return json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("it is not JSON, and PyYAML isn't installed") from e
        try:
            return yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise ValueError(str(e)) from e


def encoded(properties) -> list[str]:
    """Canonical property strings of a map or list of properties; ValueError if they hold more than lists of scalars."""
    compact = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))
    if isinstance(properties, list):
        if any(isinstance(v, (list, dict)) for v in properties):
            raise ValueError("a listed property is not a scalar")
        return sorted({compact([v]) for v in properties})
    if not isinstance(properties, dict):
        raise ValueError("properties are neither a map nor a list")
    out = set()
    for k, v in properties.items():
        for one in v if isinstance(v, list) else [v]:
            if isinstance(one, (list, dict)):
                raise ValueError("a property is not a scalar or a list of scalars")
            out.add(compact({str(k): one}))
    return sorted(out)


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of every file below a folder or glob."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


TYPES = "namespace string, name string, props array<string>, ontology struct<name:string,version:double,doi:string,strict:boolean>, error string"


def types_load(spark: SparkSession, path: str) -> DataFrame:
    """Types of every library file; the namespace is the file's ``name=`` folder, or else its stem. ``error`` says what is wrong, else null."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for namespace, text in zip(pdf["namespace"], pdf["text"], strict=True):
                try:
                    doc = parsed(text)
                    if not isinstance(doc, dict) or not isinstance(doc.get("types"), dict):
                        raise ValueError("it has no map of types")
                    o = doc.get("ontology") or {}
                    ontology = {"name": str(o.get("name", "EDAM")), "version": float(o.get("version", 1.25)), "doi": str(o.get("doi", "")), "strict": bool(o.get("strict", True))}
                except (ValueError, TypeError) as e:
                    rows.append((namespace, None, None, None, str(e)))
                    continue
                for name, body in doc["types"].items():
                    try:
                        if not isinstance(body, dict) or "properties" not in body:
                            raise ValueError("it has no properties")
                        rows.append((namespace, str(name), encoded(body["properties"]), ontology, None))
                    except ValueError as e:
                        rows.append((namespace, str(name), None, ontology, str(e)))
            yield pd.DataFrame(rows, columns=["namespace", "name", "props", "ontology", "error"])

    named = F.coalesce(F.nullif(F.url_decode(F.regexp_extract("file", r"/name=([^/]*)/", 1)), F.lit("")), F.regexp_extract("file", STEM, 1))
    files = whole_files(spark, path).select(named.alias("namespace"), "text")
    return files.mapInPandas(run, TYPES)


def types_packed(types: DataFrame) -> DataFrame:
    """(namespace, document): one JSON document a namespace, from (namespace, name, props[, ontology])."""
    ontology = F.min("ontology") if "ontology" in types.columns else F.struct(F.lit("EDAM").alias("name"), F.lit(1.25).alias("version"), F.lit("").alias("doi"), F.lit(True).alias("strict"))
    one = F.struct("name", "props")
    got = types.groupBy("namespace").agg(F.array_sort(F.collect_list(one)).alias("t"), ontology.alias("ontology"))
    # Property strings are JSON already: {"k":v} or [v].
    body = F.array_join(F.transform("t", lambda t: F.concat(F.regexp_replace(F.to_json(F.array(t["name"])), r"^\[|\]$", ""), F.lit(':{"properties":'), packed_props(t["props"]), F.lit("}"))), ",")
    return got.select("namespace", F.concat(F.lit('{"types":{'), body, F.lit('},"ontology":'), F.to_json("ontology"), F.lit("}")).alias("document"))


def packed_props(props):
    """Property strings as one JSON map from key to a list of values, or as a list in the list form."""
    listed = F.exists(props, lambda p: p.startswith("["))
    inner = lambda p: F.regexp_extract(p, r'^\{("(?:[^"\\]|\\.)*"):(.*)\}$', 2)
    key = lambda p: F.regexp_extract(p, r'^\{("(?:[^"\\]|\\.)*"):(.*)\}$', 1)
    keys = F.array_distinct(F.transform(F.array_sort(props), key))
    as_map = F.concat(F.lit("{"), F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit(":["), F.array_join(F.transform(F.filter(F.array_sort(props), lambda p: key(p) == k), inner), ","), F.lit("]"))), ","), F.lit("}"))
    as_list = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(props), lambda p: F.regexp_extract(p, r"^\[(.*)\]$", 1)), ","), F.lit("]"))
    return F.when(listed, as_list).otherwise(as_map)


def save_documents(documents: DataFrame, name_col: str, path: str) -> None:
    """One text file a document, below ``path/name=.../``; the document must have no line end.

    A task may hold several documents of a name: each still gets a file of its own, as files are read whole.
    """
    documents.select(F.col(name_col).alias("name"), F.col("document")).write.partitionBy("name").option("maxRecordsPerFile", 1).text(path)


def manifest_load(spark: SparkSession, path: str) -> DataFrame:
    """(lib, path, dtype_name, ord, error) of every index file; the library is the file's folder or ``name=`` part."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for lib, text in zip(pdf["lib"], pdf["text"], strict=True):
                try:
                    doc = parsed(text)
                    if not isinstance(doc, dict) or not isinstance(doc.get("manifest"), dict):
                        raise ValueError("it has no manifest")
                    rows += [(lib, str(p), str(t), k, None) for k, (p, t) in enumerate(doc["manifest"].items())]
                except ValueError as e:
                    rows.append((lib, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["lib", "path", "dtype_name", "ord", "error"]).astype({"ord": "Int64"})

    named = F.coalesce(F.nullif(F.url_decode(F.regexp_extract("file", r"/name=([^/]*)/", 1)), F.lit("")), F.regexp_extract("file", r"([^/]*)/[^/]*$", 1))
    return whole_files(spark, path).select(named.alias("lib"), "text").mapInPandas(run, "lib string, path string, dtype_name string, ord long, error string")


def manifest_packed(manifest: DataFrame, per_file: int = 10_000) -> DataFrame:
    """(lib, document): JSON indexes of a library, from (lib, path, dtype_name, ord), entries in their order.

    A library's entries are dealt to documents by a hash of their paths, about ``per_file`` to each, so that a
    large library is no single row: their number comes from a count.
    """
    sizes = manifest.groupBy("lib").agg(F.ceil(F.count("*") / per_file).alias("__files"))
    dealt = manifest.join(sizes, "lib").withColumn("__file", F.pmod(F.xxhash64("path"), F.col("__files")))
    entries = F.transform(F.array_sort(F.collect_list(F.struct("ord", "path", "dtype_name"))), lambda e: F.struct(e["path"].alias("key"), e["dtype_name"].alias("value")))
    return dealt.groupBy("lib", "__file").agg(F.to_json(F.struct(F.map_from_entries(entries).alias("manifest"))).alias("document")).select("lib", "document")


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified) of all files below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def plan_save(steps: DataFrame, path: str) -> None:
    """Plans, one row of nested steps a target, as Parquet."""
    step = F.struct("step", "transform", "uses", "produces")
    steps.groupBy("target").agg(F.array_sort(F.collect_list(step)).alias("steps")).write.parquet(path)


def plan_load(spark: SparkSession, path: str) -> DataFrame:
    """Steps of the plans saved at a path: (target, step, transform, uses, produces)."""
    return spark.read.parquet(path).select("target", F.inline("steps"))
