"""Transfer manifests (src_address, src_type, dest_address, dest_type): validate, batch, order, reconcile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.functions import text as X

CLOUD = ["GLOBUS", "SSH", "HTTP"]


def transfer_validate(transfers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(legal transfers with their dominant type, illegal ones with a reason).

    Nothing goes to HTTP; two cloud ends are of one platform; a cloud end and a local one are direct.
    """
    src, dest = F.col("src_type"), F.col("dest_type")
    cs, cd = src.isin(CLOUD), dest.isin(CLOUD)
    reason = (
        F.when(~src.isin(X.TYPES) | ~dest.isin(X.TYPES) | src.isNull() | dest.isNull(), "unknown type")
        .when(dest == "HTTP", "to HTTP")
        .when(cs & cd & (src != dest), "between platforms")
        .when((cs & (dest == "SYMLINK")) | (cd & (src == "SYMLINK")), "symlink to cloud")
    )
    dominant = F.when(cs, src).when(cd, dest).otherwise("DIRECT")
    judged = transfers.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason").withColumn("dominant", dominant), judged.where("reason is not null")


def transfer_batches(valid: DataFrame) -> DataFrame:
    """(dominant, src_endpoint, dest_endpoint, n): one session's work for each pair of endpoints; ``batch_contents`` has its transfers."""
    return with_batch(valid).groupBy("dominant", "src_endpoint", "dest_endpoint").agg(F.count("*").alias("n"))


def batch_contents(valid: DataFrame) -> DataFrame:
    """(dominant, src_endpoint, dest_endpoint, src_address, dest_address, ...): each transfer in its batch.

    A batch may hold a third of all transfers, so its transfers stay rows and are not gathered into a list.
    """
    rows = with_batch(valid)
    first = ["dominant", "src_endpoint", "dest_endpoint", "src_address", "dest_address"]
    return rows.select(*first, *(c for c in rows.columns if c not in first))


def with_batch(valid: DataFrame) -> DataFrame:
    """Transfers with the endpoints that make their batch."""
    return valid.withColumn("src_endpoint", X.address_endpoint(F.col("src_address"))).withColumn("dest_endpoint", X.address_endpoint(F.col("dest_address")))


def transfers_by_type(valid: DataFrame) -> DataFrame:
    return valid.groupBy("dominant").agg(F.count("*").alias("n"))


def transfer_priority(valid: DataFrame) -> DataFrame:
    """Transfers with ``priority``, the place of their dominant type in the order of execution, in that order."""
    return valid.withColumn("priority", X.priority(F.col("dominant"))).orderBy("priority", "src_address", "dest_address")


def transfer_reconcile(transfers: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(completed, failed) by whether the destination's address is listed (``path``)."""
    there = files.select(F.col("path").alias("dest_address")).distinct()
    return transfers.join(there, "dest_address", "left_semi"), transfers.join(there, "dest_address", "left_anti")
