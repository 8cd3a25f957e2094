"""Shared helpers of the training-data operators: tables, shared folders, column names, unit caches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders that this process has named, in order.
SCRATCH: list[str] = []


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder name below the folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none, a temporary folder is made if all run on this machine, as in tests; on a
    cluster that is refused, as it would lose what other machines need.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomstead-")
        context.setCheckpointDir(base)
    SCRATCH.append(f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}")
    return SCRATCH[-1]


def clear(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders of ``SCRATCH`` that nothing needs any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        SCRATCH.remove(path)


def kept(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, tag)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def col_of(df: DataFrame, name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return df["`" + name.replace("`", "``") + "`"]


def text_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text (null: empty), so that other columns neither clash nor are read."""
    return df.select(col_of(df, id_col).alias("id"), F.coalesce(col_of(df, text_col), F.lit("")).alias("text"))


def per_batch(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], Iterable[dict[str, list]]]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches as dicts of Python lists; ``make`` is called once a task and returns the step.

    A step with a method ``finish`` is asked for more rows when the task's input ends.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        pack = lambda out: pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        for batch in batches:
            for rows in parts(batch):
                for out in step({n: c.to_pylist() for n, c in zip(rows.schema.names, rows.columns, strict=True)}):
                    yield pack(out)
        for out in step.finish() if hasattr(step, "finish") else ():
            yield pack(out)

    return df.mapInArrow(run, schema)


def beside(df: DataFrame, inputs: dict[str, str], make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str) -> DataFrame:
    """``df`` with new columns of its rows: verdicts travel with a row, so that repeated and null ids need no join.

    The step gets lists of the columns that ``inputs`` names (name in the step -> column) and returns lists of the
    new ones, whose names must be free. Other columns pass as Arrow arrays.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    new = _parse_datatype_string(schema)
    arrow = to_arrow_schema(new)
    at = {name: df.columns.index(column) for name, column in inputs.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for rows in parts(batch):
                got = step({name: rows.column(k).to_pylist() for name, k in at.items()})
                yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(got[f.name], f.type) for f in arrow)], names=[*rows.schema.names, *arrow.names])

    return df.mapInArrow(run, StructType([*df.schema.fields, *new.fields]))


#: Rows of an Arrow batch that are Python objects at a time, and bytes of their texts and lists.
ROWS, BYTES = 1000, 4 << 20


def parts(batch: pa.RecordBatch, rows: int = ROWS, most_bytes: int = BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ``rows`` rows and ``most_bytes`` of variable data, or one row where that has more."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            sizes += pc.binary_length(c).fill_null(0).to_numpy(zero_copy_only=False)
        elif pa.types.is_list(c.type):
            sizes += 8 * pc.list_value_length(c).fill_null(0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if k > begin and (held + size > most_bytes or k - begin >= rows):
            yield batch.slice(begin, k - begin)
            begin, held = k, 0
        held += size
    if begin < batch.num_rows:
        yield batch.slice(begin)


class TwoGenerations(dict):
    """A cache of at most ``most_bytes``: its older half is dropped; entries that are used again move to the newer one.

    Keys of more than ``longest`` code points are made anew each time, as are values that are None. What an entry
    holds is taken as ``entry`` bytes for its objects and their place in the table, four for each code point of
    its key, and ``each`` for every member of its value (0: ``entry`` has the value, too).
    """

    def __init__(self, make: Callable[[str], object], most_bytes: int, longest: int = 64, each: int = 1, entry: int = 190):
        super().__init__()
        self.make, self.most, self.longest, self.each, self.entry = make, most_bytes // 2, longest, each, entry
        self.old, self.held = {}, 0

    def __missing__(self, key: str) -> object:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if value is None or len(key) > self.longest:
                return value
        held = self.held + self.entry + 4 * len(key)
        if self.each:
            held += self.each * len(value)
        if held > self.most:
            self.old, held = dict(self), 0
            self.clear()
        self.held = held
        self[key] = value
        return value


def numbered(df: DataFrame, order: list[Column], name: str, tag: str) -> DataFrame:
    """``df`` with ``name``, the 1-based number (long) of each row in the given order over the whole table.

    Rows are dealt out in ranges of the order, sorted, and written with their place in the range; only the sizes
    of the ranges, one number for each, are added up. Rows equal in the order are numbered in either order.
    """
    place, part, n, before = (free_name(df, x) for x in ("place", "part", "n", "before"))
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id())
    rows = kept(dealt.withColumn(part, F.shiftright(place, 33).cast("int")).withColumn(place, F.col(place).bitwiseAND((1 << 33) - 1)), tag)
    sizes = {r[0]: r[1] for r in rows.groupBy(part).agg(F.count("*").alias(n)).collect()}
    total, starts = 0, []
    for k in sorted(sizes):
        starts.append((k, total))
        total += sizes[k]
    offsets = df.sparkSession.createDataFrame(starts, f"{part} int, {before} long")
    return rows.join(F.broadcast(offsets), part).withColumn(name, F.col(place) + F.col(before) + 1).select(*("`" + c.replace("`", "``") + "`" for c in df.columns), name)
