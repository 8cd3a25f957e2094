"""Messages of feeds whose reads break anywhere."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomstead.streaming.frames import Feed, chunk_files, log_frames

TEXT = (
    "starting\n\n"
    "2024-01-02_03-04-05  | one\n"
    "\x1b[31m2024-01-02_03-04-06 E| two é\x1b[0m\r\n  at a\n\n  at 日本\n"
    "2024-01-02_03-04-07 D|\n"
    "2024-01-02_03-04-08 W| last\n  and more"
).encode()
WANT = [b"starting", b"", b"2024-01-02_03-04-05  | one", "\x1b[31m2024-01-02_03-04-06 E| two é\x1b[0m\r\n  at a\n\n  at 日本".encode(), b"2024-01-02_03-04-07 D|", b"2024-01-02_03-04-08 W| last\n  and more"]


def split(text: bytes, r: random.Random) -> list[bytes]:
    cuts = sorted(r.sample(range(1, len(text)), r.randint(0, 40)))
    return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]


def test_any_split_and_order_gives_the_same():
    r = random.Random(1)
    for _ in range(300):
        chunks = [*enumerate([*split(TEXT, r), b""])]
        chunks += r.choices(chunks, k=3)  # sent again
        r.shuffle(chunks)
        feed, got = Feed(), []
        while chunks:
            part, chunks = chunks[: (k := r.randint(1, 10))], chunks[k:]
            got += feed.take(dict(part))
            feed = Feed(feed.number, feed.sent, None if feed.lines is None else b"\n".join(feed.lines), feed.begun, feed.waiting)
        assert got == WANT and feed.sent == len(WANT) and not feed.waiting and feed.lines is None and feed.begun == b""


def test_silence_ends_a_message():
    feed = Feed()
    assert list(feed.take({0: TEXT, 2: b"later\n"})) == WANT[:-1]
    assert list(feed.end()) == WANT[-1:] and list(feed.end()) == []
    assert list(feed.take({1: b"now\n"})) == [b"now", b"later"]


def run(spark, source, out: Path, offsets: Path):
    stream = log_frames(source).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(offsets))
    stream.trigger(availableNow=True).start().awaitTermination()
    return [tuple(r) for r in spark.read.parquet(str(out)).select("feed", "number", F.date_format("ts", "HH:mm:ss"), "level", "message").orderBy("feed", "number").collect()]


def test_restart_loses_and_repeats_nothing(spark, tmp_path):
    r, folder = random.Random(2), tmp_path / "in"
    folder.mkdir()
    feeds = {f: split(TEXT, r) + [b""] for f in ("a.b", "c")}
    for step in (0, 1, 2):
        for f, chunks in feeds.items():
            for n, content in enumerate(chunks):
                if n % 3 == step:  # many come before their turn
                    (folder / (f"{f}.{n}" if content else f"{f}.{n}.end")).write_bytes(content or b"x")
        got = run(spark, chunk_files(spark, str(folder), 10), tmp_path / "out", tmp_path / "offsets")
    one = [(None, None, "starting"), (None, None, ""), ("03:04:05", "info", "one"), ("03:04:06", "error", "two é\n  at a\n\n  at 日本"), ("03:04:07", "debug", ""), ("03:04:08", "warning", "last\n  and more")]
    assert got == [(f, n, *x) for f in feeds for n, x in enumerate(one)]


def test_odd_chunks(spark, tmp_path):
    rows = [(None, 0, b"x\n"), ("f", 0, b"2024-01-02_03-04-05  | \xff"), ("f", 1, None), ("g", 0, None)]
    spark.createDataFrame(rows, "feed string, number long, content binary").withColumn("text", F.lit(1)).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("feed string, number long, content binary, text int").parquet(f"{tmp_path}/in")
    assert run(spark, source, tmp_path / "out", tmp_path / "offsets") == [(None, 0, None, None, "x"), ("f", 0, "03:04:05", "info", "�")]
    assert run(spark, source.where("false"), tmp_path / "none", tmp_path / "offsets2") == []
    with pytest.raises(Exception, match="no number"):
        run(spark, source.withColumn("number", F.lit(None).cast("long")), tmp_path / "bad", tmp_path / "offsets3")
