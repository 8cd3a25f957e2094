"""WARC archives with an index first, and reads of selected records by coalesced byte ranges.

Writing: each task writes one archive file, a gzip member for each record, below a folder, under a name of its own attempt, and returns one
index row for each record: file, offset, length, URL, payload digest. The index is a Parquet table, committed
as a whole: a record of an attempt that was lost has no index row. Records with equal payloads are written
once; the others are ``revisit`` records that name the response and have no payload.

Reading: selected index rows are dealt out by file and offset in order; a task reads neighbouring records in
one range, as far as gaps are at most ``gap`` bytes and the range at most ``block`` bytes, and checks each
payload against its digest. A folder is any that pyarrow's file systems open, such as file:, hdfs: or s3:.

Nulls: a null payload is empty, a null URL is left out; rows that have both the payload and the id of a
response are responses too; empty tables give an empty index. Memory:
one range of ``block`` bytes, or one record where that is larger, a task.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.llm.common import col_of, per_batch, shared_dir

INDEX = "file string, offset long, length long, id string, url string, digest string, record_type string, refers_to string"
#: Compression of records: fast.
LEVEL = 1
DATE = "2024-01-01T00:00:00Z"


def opened(uri: str):
    """The file system of a URI and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record(kind: str, name: str, url: str | None, payload: bytes, digest: str, size: int, refers_to: str | None) -> bytes:
    """One record as a gzip member; ``payload`` is empty for a revisit, whose length is in a field of its own."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:loomstead:{name}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {' '.join(url.split())}"] if url else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:loomstead:{refers_to}>"] if kind == "revisit" else []),
        f"X-Payload-Length: {size}",
        "Content-Type: text/html",
        f"Content-Length: {len(payload)}",
    ]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n", LEVEL, mtime=0)


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and payload of a record; ValueError if it is not one, or its payload has another digest."""
    try:
        raw = gzip.decompress(raw)
    except (OSError, EOFError, zlib.error) as e:
        raise ValueError("not a gzip member") from e
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    payload = rest[: int(fields["Content-Length"])]
    if len(payload) != int(fields["Content-Length"]) or fields["WARC-Type"] == "response" and fields["WARC-Payload-Digest"] != "sha1:" + digest_of(payload):
        raise ValueError("a record's payload differs from its digest")
    return fields, payload


def write_archive(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write every row as a record below ``folder``; the index, read from its table there.

    Of rows with equal payloads of at least ``least_bytes``, that with the largest id is the response.
    """
    payload = F.coalesce(col_of(df, payload_col).cast("binary"), F.lit(b""))
    rows = df.select(col_of(df, id_col).alias("id"), col_of(df, url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload")).withColumn("same", F.sha2("payload", 256)).withColumn("size", F.length("payload"))
    large = F.col("size") >= least_bytes
    # Payloads are equal if their length and both digests are: a known SHA-1 collision is not enough.
    first = rows.where(large).groupBy("digest", "same", "size").agg(F.max("id").alias("first"))
    # Only the digests decide; the payloads move once, to the join that writes them.
    out = rows.join(first, ["digest", "same", "size"], "left")
    here = large & ~F.col("first").eqNullSafe(F.col("id"))
    out = out.select(F.col("id").cast("string").alias("id"), "url", F.when(here, F.lit(b"")).otherwise(F.col("payload")).alias("payload"), "size", "digest", F.when(here, F.col("first").cast("string")).alias("refers_to"), here.alias("revisit"))
    data = f"{folder}/archive"
    files, path = opened(data)
    files.create_dir(path, recursive=True)

    def make():
        return _Writer(data)

    index = per_batch(out, make, INDEX)
    at = f"{folder}/index"
    index.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(INDEX).parquet(at)


class _Writer:
    """Appends records to this attempt's file."""

    def __init__(self, folder: str):
        context = TaskContext.get()
        self.files, path = opened(folder)
        self.name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:12]}.warc.gz"
        self.path, self.out, self.at = f"{path}/{self.name}", None, 0

    def __call__(self, rows: dict[str, list]):
        if not rows["id"]:
            return
        if self.out is None:
            self.out = self.files.open_output_stream(self.path, compression=None)
        index: dict[str, list] = {c.split()[0]: [] for c in INDEX.split(", ")}
        for name, url, payload, size, sha1, revisit, refers_to in zip(*(rows[c] for c in ("id", "url", "payload", "size", "digest", "revisit", "refers_to")), strict=True):
            kind = "revisit" if revisit else "response"
            digest = base64.b32encode(bytes.fromhex(sha1)).decode()
            raw = record(kind, name, url, payload, digest, size, refers_to)
            self.out.write(raw)
            for k, v in zip(index.values(), (self.name, self.at, len(raw), name, url, digest, kind, refers_to), strict=True):
                k.append(v)
            self.at += len(raw)
        yield index

    def finish(self):
        if self.out is not None:
            self.out.close()
        return ()


READ = "id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def read_records(index: DataFrame, folder: str, with_payload: bool = False, block: int = 8 << 20, gap: int = 64 << 10, per_task: int = 64 << 20) -> DataFrame:
    """The records of selected index rows, by coalesced ranges; ``payload`` (binary) only if asked for."""
    data, schema = f"{folder}/archive", READ + (", payload binary" if with_payload else "")
    size = index.agg(F.sum("length")).first()[0] or 0
    ordered = index.select("file", "offset", "length").repartitionByRange(max(1, -(-size // per_task)), "file", "offset").sortWithinPartitions("file", "offset")

    def make():
        files, path = opened(data)

        def flush(name, spans):
            with files.open_input_file(f"{path}/{name}") as f:
                begin = spans[0][0]
                raw = f.read_at(spans[-1][0] + spans[-1][1] - begin, begin)
            out = {c.split()[0]: [] for c in schema.split(", ")}
            for offset, length in spans:
                fields, payload = parsed(raw[offset - begin : offset - begin + length])
                bare = lambda k: fields.get(k, "")[len("<urn:loomstead:") : -1] or None  # noqa: B023, E731
                got = (bare("WARC-Record-ID"), fields.get("WARC-Target-URI"), int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], bare("WARC-Refers-To"), payload)
                for k, v in zip(out.values(), got, strict=False):
                    k.append(v)
            return out

        def step(rows):
            name, spans = None, []
            for file, offset, length in zip(rows["file"], rows["offset"], rows["length"], strict=True):
                if spans and (file != name or offset - sum(spans[-1]) > gap or offset + length - spans[0][0] > block):
                    yield flush(name, spans)
                    spans = []
                name = file
                spans.append((offset, length))
            if spans:
                yield flush(name, spans)

        return step

    return per_batch(ordered, make, schema)


def payloads(records: DataFrame) -> DataFrame:
    """``records`` read with payloads, where a revisit gets the payload of its response."""
    found = records.where("record_type = 'response'").select(F.col("id").alias("refers_to"), F.col("payload").alias("of"))
    return records.join(found, "refers_to", "left").withColumn("payload", F.coalesce("of", "payload")).drop("of")


def new_folder(spark: SparkSession) -> str:
    return shared_dir(spark, "warc")
