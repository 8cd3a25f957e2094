"""Continuous log feeds: the batch parser on a stream, and separate listeners for errors and the rest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomstead.sources.logs import log_parse


def log_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """A stream of (ts, level, message) from text files that arrive in a folder."""
    return log_parse(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path))


def split_levels(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ordinary lines, error lines); lines without a level are ordinary."""
    error = F.coalesce(F.col("level") == "error", F.lit(False))
    return lines.where(~error), lines.where(error)


def stream_split(lines: DataFrame, on_out: Callable[[DataFrame, int], None], on_err: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Give each batch of a stream to two listeners by level; a batch is read once for both.

    Listeners may get a batch again after a failure, under the same number.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        out, err = split_levels(batch)
        on_out(out, number)
        on_err(err, number)
        batch.unpersist()

    writer = lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
