"""Closures that are kept: what has been derived once is looked up, only new shapes of roots are derived.

A store is a folder for one set of transforms, products and targets asked for; its fingerprint is part of the path, so
other transforms never meet a stored closure that isn't theirs. Each ``extend`` numbers the givens of its roots,
derives the shapes that no batch has, writes them as a batch, and returns the closure of those roots from
what is stored. A root that gained givens has another shape, which is derived or found as any other. Roots with many givens
are shapes of their own and are derived each time.

Two extensions at once may both derive a shape; what they write is the same and counts once. A batch is one table,
which is there or not once its job ends; a lost driver leaves nothing half-read.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.plans.derive import MADE, MOST_LINKS, Closure, rounds
from loomstead.plans.shapes import mattering, shapes_of

#: A batch: endpoints of shapes with their applications; ``cut`` marks shapes in which alternatives were dropped.
STORED = "root string, id string, transform string, prod_ix int, props array<string>, anc array<string>, above array<string>, apps array<string>, round int, app string, uses array<string>, cut boolean"


class ClosureStore:
    """Stored closures below ``path``, a folder that all machines share."""

    def __init__(self, spark: SparkSession, path: str, requirements: DataFrame, products: DataFrame, asked: DataFrame | None = None, alternatives: int = 1, max_rounds: int = 64):
        self.spark, self.requirements, self.products = spark, requirements, products
        self.alternatives, self.max_rounds = alternatives, max_rounds
        self.matter = mattering(*(df.select("props") for df in (requirements, asked) if df is not None))
        declared = [sorted(map(repr, df.limit(MOST_LINKS + 1).collect())) for df in (requirements.select("transform", "req_ix", "props", "parent_ix"), products.select("transform", "prod_ix", "props"))]
        if max(map(len, declared)) > MOST_LINKS:
            raise ValueError(f"there are more than {MOST_LINKS} requirements or products")
        mark = hashlib.sha256(json.dumps([declared, self.matter, alternatives, max_rounds]).encode()).hexdigest()[:16]
        self.path = f"{path.rstrip('/')}/closure-{mark}"

    def rows(self) -> DataFrame:
        """All stored endpoints of shapes, each once."""
        try:
            return self.spark.read.schema(STORED).parquet(f"{self.path}/batch-*").dropDuplicates(["root", "id"])
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], STORED)

    def extend(self, givens: DataFrame) -> Closure:
        """The closure of ``givens`` (root, id, props[, parents]), with what was stored before."""
        shapes = shapes_of(givens, self.matter)
        known = self.rows().select("root").distinct()
        new = shapes.givens.where(F.col("root").startswith("=")).unionByName(shapes.givens.where(~F.col("root").startswith("=")).join(known, "root", "left_anti"))
        own = None
        if not new.isEmpty():
            found, cut = rounds(new, self.requirements, self.products, self.max_rounds, self.alternatives)
            marked = found.select(*MADE).join(cut.withColumn("cut", F.lit(True)), "root", "left").withColumn("cut", F.coalesce("cut", F.lit(False)))
            own = marked.where(F.col("root").startswith("="))
            marked.where(~F.col("root").startswith("=")).write.option("compression", "zstd").parquet(f"{self.path}/batch-{uuid.uuid4().hex}")
        rows = self.rows() if own is None else self.rows().unionByName(own)
        rows = rows.join(shapes.roots.select(F.col("shape").alias("root")).distinct(), "root", "left_semi")
        return Closure(rows.drop("cut"), rows.where("cut").select("root").distinct(), shapes, givens)
