"""Run logs: lines of ``time L| message`` where L is a space, D, W or E."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.functions.text import parse_std_time, text_clean

#: What a line looks like and what its letter means.
LINE = r"^(\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2}) ([ DWE])\| ?(.*)$"
LEVELS = {" ": "info", "D": "debug", "W": "warning", "E": "error"}


def log_fields(line: Column) -> list[Column]:
    """ts, level and message of a line; a line of another form is a message with neither."""
    clean = text_clean(line)
    letter = F.regexp_extract(clean, LINE, 2)
    level = F.create_map(*(F.lit(x) for pair in LEVELS.items() for x in pair))[letter]
    return [
        parse_std_time(F.regexp_extract(clean, LINE, 1)).alias("ts"),
        F.when(letter != "", level).alias("level"),
        F.when(letter != "", F.regexp_extract(clean, LINE, 3)).otherwise(clean).alias("message"),
    ]


def log_parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines of a batch or stream parsed: the other columns, ts, level, message."""
    return lines.select(*(c for c in lines.columns if c != column), *log_fields(F.col(column)))


def log_scan(spark: SparkSession, path: str) -> DataFrame:
    """(ts, level, message) of log files."""
    return log_parse(spark.read.text(path))


def log_line(ts: Column, level: Column, message: Column) -> Column:
    """A line as logs have it."""
    from loomstead.functions.text import std_time

    letter = F.create_map(*(F.lit(x) for k, v in LEVELS.items() for x in (v, k)))[level]
    return F.concat(std_time(ts), F.lit(" "), letter, F.lit("| "), message)
