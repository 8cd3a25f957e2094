"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next one.

Toxic documents go, then those that the quality rules reject, then all but one of each group of near-duplicates;
secrets are masked in the texts of what is left, and these are packed into sequences. Without the subpackage
``loomstead.llm``, which has the operators, importing this module is an ImportError.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomstead.llm.common import SCRATCH, clear, kept, table
from loomstead.llm.queries import STAGES

#: SQL can't express the field of the first stage; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what the stages keep."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        mark = len(SCRATCH)
        docs = kept(stage(spark, docs, sf_dir), name)
        # What the stage wrote for itself goes once its result is written.
        clear(spark, SCRATCH[mark:-1])
    return docs
