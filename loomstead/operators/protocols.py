"""Transforms as user functions: declared with their requirements and products, run on each binding.

A failing function is a row that says so, not a failed job.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = "binding string, success boolean, error string, output string"


@dataclass
class Declared:
    name: str
    function: Callable
    requirements: list[tuple[list[str], list[int]]]
    products: list[tuple[list[str], str]]


@dataclass
class TransformCatalog:
    """Registered transforms by name."""

    declared: dict[str, Declared] = field(default_factory=dict)

    def register(self, name: str, requirements: list[tuple[list[str], list[int]]], products: list[tuple[list[str], str]]):
        """A decorator: ``requirements`` are (props, parent numbers), ``products`` (props, output name).

        Every product has an output name of its own, and a requirement's parents come before it.
        """
        if name in self.declared:
            raise ValueError(f"{name} is registered already")
        if not products or not all(out for _, out in products) or len({out for _, out in products}) < len(products):
            raise ValueError("every product needs an output name of its own")
        if any(p >= k or p < 0 for k, (_, parents) in enumerate(requirements) for p in parents):
            raise ValueError("a requirement's parents come before it")

        def keep(function: Callable) -> Callable:
            self.declared[name] = Declared(name, function, requirements, products)
            return function

        return keep

    def requirements(self, spark: SparkSession) -> DataFrame:
        rows = [(d.name, k, sorted(set(p)), sorted(up)) for d in self.declared.values() for k, (p, up) in enumerate(d.requirements)]
        return spark.createDataFrame(rows, "transform string, req_ix int, props array<string>, parent_ix array<int>")

    def products(self, spark: SparkSession) -> DataFrame:
        rows = [(d.name, k, sorted(set(p)), out) for d in self.declared.values() for k, (p, out) in enumerate(d.products)]
        return spark.createDataFrame(rows, "transform string, prod_ix int, props array<string>, out_path string")

    def transform_catalog(self, spark: SparkSession) -> DataFrame:
        """(transform, n_requirements, n_products) of every registered transform."""
        need = self.requirements(spark).groupBy("transform").agg(F.count("*").alias("n_requirements"))
        make = self.products(spark).groupBy("transform").agg(F.count("*").alias("n_products"))
        return make.join(need, "transform", "left").select("transform", F.coalesce("n_requirements", F.lit(0)).alias("n_requirements"), "n_products")

    def apply_protocol(self, name: str, rows: DataFrame, binding: str) -> DataFrame:
        """(binding, success, error, output) of a function that takes a binding's rows, one pandas frame, and gives text.

        A binding's rows meet in one task, as its function takes them together.
        """
        function = self.declared[name].function

        def run(pdf):
            import pandas as pd

            key = str(pdf[binding].iloc[0])
            try:
                return pd.DataFrame([(key, True, None, str(function(pdf)))], columns=["binding", "success", "error", "output"])
            except Exception as e:  # the user's function may raise anything, and this reports it
                return pd.DataFrame([(key, False, f"{type(e).__name__}: {e}", None)], columns=["binding", "success", "error", "output"])

        return rows.groupBy(binding).applyInPandas(run, RESULT)
