"""Stored indexes: postings by index name, and the trigrams of their keys for wildcard look-ups.

Postings lie in a folder for each index name, so that a look-up by name reads no others. Trigrams of different keys, in
lower case as the engine folds it, lie in ``GRAM_PARTS`` folders by a hash: a pattern reads the folders of its own
trigrams only, takes the keys that have all of them, and checks these with the pattern itself. Patterns without three
plain characters in a row read all postings. Null keys are no postings; an empty index gives no rows.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of trigrams.
GRAM_PARTS = 64


def grams_of(pattern: str) -> list[str]:
    """Trigrams that a key must have to match a pattern with the wildcards ``*``, ``%`` and ``_``; ASCII ones suffice."""
    runs = re.split(r"[*%_]", pattern)
    found = {r[k : k + 3] for r in runs for k in range(len(r) - 2)}
    return sorted({g.lower() for g in found if g.isascii()})


class StoredIndex:
    """An index (si_name, si_key, parent_key) as tables below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, si: DataFrame) -> StoredIndex:
        """Stores an index; a folder that has one is refused."""
        rows = si.select("si_name", "si_key", "parent_key").where("si_key is not null")
        rows.repartition("si_name", "si_key").write.partitionBy("si_name").option("compression", "zstd").parquet(f"{self.path}/postings")
        keys = self.postings().select("si_name", "si_key").distinct()
        low = F.lower("si_key")
        grams = F.when(F.char_length(low) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(low) - 2), lambda k: F.substring(low, k, F.lit(3)))))
        each = keys.select("si_name", "si_key", F.explode(grams).alias("gram")).withColumn("part", F.crc32("gram") % GRAM_PARTS)
        each.repartition("part", "gram").sortWithinPartitions("gram").write.partitionBy("part").option("compression", "zstd").parquet(f"{self.path}/grams")
        return self

    def postings(self) -> DataFrame:
        return self.spark.read.schema("si_key string, parent_key string, si_name string").parquet(f"{self.path}/postings")

    def grams(self) -> DataFrame:
        return self.spark.read.schema("si_name string, si_key string, gram string, part long").parquet(f"{self.path}/grams")

    def lookup(self, docs: DataFrame, key: str, si_name: str | None = None, distinct: bool = False) -> DataFrame:
        """``sources.documents.si_lookup`` over the stored index."""
        rows = self.postings() if si_name is None else self.postings().where(F.col("si_name") == si_name)
        if "*" in key or "%" in key:
            hit, grams = F.col("si_key").ilike(key.replace("\\", "\\\\").replace("*", "%")), grams_of(key)
            if grams:
                some = self.grams().where(F.col("part").isin(sorted({zlib.crc32(g.encode()) % GRAM_PARTS for g in grams})) & F.col("gram").isin(grams))
                if si_name is not None:
                    some = some.where(F.col("si_name") == si_name)
                keys = some.groupBy("si_name", "si_key").agg(F.count("*").alias("n")).where((F.col("n") == len(grams)) & hit).select("si_name", "si_key")
                rows = rows.join(keys, ["si_name", "si_key"], "left_semi")
            else:
                rows = rows.where(hit)
        else:
            rows = rows.where(F.col("si_key") == key)
        found = rows.select(F.col("parent_key").alias("key"))
        return docs.join(found.distinct() if distinct else found, "key")
