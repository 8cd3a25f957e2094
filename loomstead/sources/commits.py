"""Tables kept as a log of commits, so that several writers may append or change them at once.

A commit is a folder of Parquet rows and a numbered entry that names it; the entry makes it count. Entries are put in
place whole and never over another, so of two writers that read the same version one gets the next number and the other
looks at what was committed meanwhile: an append checks its rows against the new rows only, a change is made again.
Rows of a commit are never changed, so a reader of a version isn't disturbed, and a writer that is lost leaves a folder
that no entry names. Entries are linked (``file:``) or renamed, which the file system must refuse where the name is
taken, as local disks and HDFS do; object stores whose renames are copies aren't such.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstead.sources.documents import checked_rows

#: Entries since the last change that replaced all rows; ``compact`` makes them one.
MOST_ENTRIES = 10_000


class Conflict(Exception):
    """A commit lost its number to others more often than it may try."""


class CommitLog:
    """A table of ``schema`` with unique ``keys`` below ``path``, a folder that all machines share.

    Null keys are refused by ``append`` as any field that may not be null. No commits give an empty table.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], most_tries: int = 20):
        if "reason" in schema.names:
            raise ValueError("a field can't be called reason")
        self.spark, self.schema, self.keys, self.most_tries = spark, schema, keys, most_tries
        where, fs = self._hadoop(path.rstrip("/"))
        where = fs.makeQualified(where)
        self.path, self.folder, self.local = where.toString(), where.toUri().getPath(), where.toUri().getScheme() == "file"
        fields = [T.StructField(f.name, f.dataType) for f in schema]
        self.stored = T.StructType([*fields, T.StructField("reason", T.StringType())])

    # Entries

    def _hadoop(self, path: str):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _folder(self) -> str:
        return f"{self.folder}/log"

    def version(self) -> int:
        """The number of the last commit, 0 where there is none."""
        if self.local:
            names = os.listdir(self._folder()) if os.path.isdir(self._folder()) else []
        else:
            where, fs = self._hadoop(f"{self.path}/log")
            names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _entry(self, number: int) -> dict:
        if self.local:
            with open(f"{self._folder()}/{number:020d}", encoding="utf-8") as f:
                return json.load(f)
        where, fs = self._hadoop(f"{self.path}/log/{number:020d}")
        stream = fs.open(where)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _claim(self, number: int, entry: dict) -> bool:
        """Puts an entry in place; False where the number is taken."""
        if self.local:
            os.makedirs(self._folder(), exist_ok=True)
            handle, new = tempfile.mkstemp(prefix="new-", dir=self._folder())
            try:
                with os.fdopen(handle, "w", encoding="utf-8") as f:
                    json.dump(entry, f)
                os.link(new, f"{self._folder()}/{number:020d}")
            except FileExistsError:
                return False
            finally:
                os.unlink(new)
            return True
        new, fs = self._hadoop(f"{self.path}/log/new-{uuid.uuid4().hex}")
        final, _ = self._hadoop(f"{self.path}/log/{number:020d}")
        out = fs.create(new, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        if fs.rename(new, final):
            return True
        fs.delete(new, False)
        if not fs.exists(final):
            raise OSError(f"the commit entry {final} can't be written")
        return False

    # Reading

    def _entries(self, after: int, upto: int) -> list[tuple[int, dict]]:
        """Entries that make up the rows of ``upto`` and came after ``after``, from the last that replaced all on."""
        out = []
        for number in range(upto, after, -1):
            if len(out) == MOST_ENTRIES:
                raise ValueError(f"there are more than {MOST_ENTRIES} commits to read: compact the table")
            out.append((number, self._entry(number)))
            if out[-1][1]["replaces"]:
                break
        return out[::-1]

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.stored).drop("reason")
        return self.spark.read.schema(self.stored).parquet(*(f"{self.path}/{f}" for f in folders)).where("reason is null").drop("reason")

    def rows(self, version: int | None = None) -> DataFrame:
        """The table as of a version, the last one by default."""
        upto = self.version() if version is None else version
        return self._rows([e["folder"] for _, e in self._entries(0, upto)])

    def history(self, version: int | None = None) -> DataFrame:
        """Rows as of a version with ``version``, the commit that brought them as they are."""
        out = self._rows([]).withColumn("version", F.lit(0).cast("long"))
        for number, entry in self._entries(0, self.version() if version is None else version):
            out = out.unionByName(self._rows([entry["folder"]]).withColumn("version", F.lit(number).cast("long")))
        return out

    # Writing

    def _write(self, rows: DataFrame) -> str:
        folder = f"batch-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
        return folder

    def append(self, batch: DataFrame, at: int | None = None) -> tuple[int, DataFrame]:
        """(version, refused rows with their reason) of adding a batch by the rules of ``checked_append``.

        ``at`` is the version that the writer has read, the last one by default. Rows whose key was committed by another
        writer since are refused as ``exists``; they are looked up among the new rows only.
        """
        seen = self.version() if at is None else at
        folder = self._write(checked_rows(self.rows(seen), batch, self.schema, self.keys))
        for _ in range(self.most_tries):
            now = self.version()
            new = self._entries(seen, now)
            if any(e["replaces"] for _, e in new):
                folder = self._write(checked_rows(self.rows(now), batch, self.schema, self.keys))
            elif new:
                taken = self._rows([e["folder"] for _, e in new]).select(*self.keys).distinct().withColumn("__taken", F.lit(True))
                judged = self.spark.read.schema(self.stored).parquet(f"{self.path}/{folder}").join(taken, self.keys, "left")
                reason = F.coalesce("reason", F.when(F.col("__taken"), "exists"))
                folder = self._write(judged.select(*self.schema.names, reason.alias("reason")))
            seen = now
            if self._claim(now + 1, {"folder": folder, "replaces": False}):
                return now + 1, self.spark.read.schema(self.stored).parquet(f"{self.path}/{folder}").where("reason is not null")
        raise Conflict(f"{self.most_tries} commits came in between")

    def update(self, change: Callable[[DataFrame], DataFrame], at: int | None = None) -> int:
        """The version made by replacing all rows by what ``change`` makes of them; made again if others committed since."""
        seen = self.version() if at is None else at
        for _ in range(self.most_tries):
            rows = change(self.rows(seen)).select(*(F.col(f.name).cast(f.dataType) for f in self.schema), F.lit(None).cast("string").alias("reason"))
            folder = self._write(rows)
            if self._claim(seen + 1, {"folder": folder, "replaces": True}):
                return seen + 1
            seen = self.version()
        raise Conflict(f"{self.most_tries} commits came in between")

    def compact(self) -> int:
        """All rows as one commit."""
        return self.update(lambda rows: rows)

