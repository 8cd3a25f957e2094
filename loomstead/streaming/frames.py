"""Messages of continuous feeds whose reads break anywhere: inside a line, a character or a message of several lines.

A feed is read in numbered chunks of bytes. A message begins at a line of the form of a log line and goes on to the
next such line; lines before a feed's first are messages of their own. What a chunk leaves unfinished is the feed's
state: the open message, the bytes of the line begun, and chunks that came before their turn. A chunk of no bytes
ends what is open, as does a feed's silence for ``quiet`` seconds where that is given; a chunk whose number has passed is a repetition and is
ignored, so that a source may send again after a failure. State is as large as one message and the chunks ahead of
their turn; a feed is in order, so one task reads it, and feeds are spread over tasks.

Null contents are chunks of no bytes; rows with a null feed are a feed; rows without a number are refused. Bytes that
are no UTF-8 become the replacement character. Other columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomstead.functions.text import text_clean
from loomstead.sources.logs import log_fields

#: How a message begins, with colours before it.
HEAD = re.compile(rb"(?:\x1b\[[0-9;]*m)*\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2} [ DWE]\|")
STATE = "next long, sent long, open binary, begun binary, numbers array<long>, contents array<binary>"
#: Rows given on at a time.
ROWS = 10_000


class Feed:
    """What a feed holds between two reads."""

    def __init__(self, number: int = 0, sent: int = 0, open_: bytes | None = None, begun: bytes = b"", waiting: dict[int, bytes] | None = None):
        self.number, self.sent, self.begun, self.waiting = number, sent, begun, waiting or {}
        self.lines = None if open_ is None else [open_]

    def take(self, chunks: dict[int, bytes]) -> Iterator[bytes]:
        """The messages that are complete once these chunks have come."""
        for n, content in chunks.items():
            if n >= self.number:
                self.waiting.setdefault(n, content)
        parts = [self.begun]
        while self.number in self.waiting:
            content = self.waiting.pop(self.number)
            self.number += 1
            if b"\n" in content:
                *whole, last = content.split(b"\n")
                for k, line in enumerate(whole):
                    yield from self._line(b"".join([*parts, line]) if k == 0 else line)
                parts = [last]
            elif content:
                parts.append(content)
            else:
                self.begun = b"".join(parts)
                yield from self.end()
                parts = [b""]
        self.begun = b"".join(parts)

    def _line(self, line: bytes) -> Iterator[bytes]:
        if self.lines is not None and not HEAD.match(line):
            self.lines.append(line)
            return
        if self.lines is not None:
            yield self._sent(b"\n".join(self.lines))
        self.lines = [line] if HEAD.match(line) else None
        if self.lines is None:
            yield self._sent(line)

    def end(self) -> Iterator[bytes]:
        """What is open, as it is."""
        if self.begun:
            line, self.begun = self.begun, b""
            yield from self._line(line)
        if self.lines is not None:
            yield self._sent(b"\n".join(self.lines))
            self.lines = None

    def _sent(self, message: bytes) -> bytes:
        self.sent += 1
        return message


def _step(quiet: float | None):
    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        feed = Feed()
        if state.exists:
            number, sent, open_, begun, numbers, contents = state.get
            feed = Feed(number, sent, None if open_ is None else bytes(open_), bytes(begun), dict(zip(numbers, map(bytes, contents), strict=True)))
        out: list[tuple] = []

        def rows():
            nonlocal out
            table = pd.DataFrame({"feed": [key[0]] * len(out), "number": [n for n, _ in out], "text": [t for _, t in out]}).astype({"number": "int64"})
            out = []
            return table

        def messages():
            if state.hasTimedOut:
                yield from feed.end()
                return
            chunks: dict[int, bytes] = {}
            for part in parts:
                for n, content in zip(part["number"], part["content"], strict=True):
                    chunks.setdefault(int(n), b"" if content is None else bytes(content))
            yield from feed.take(chunks)

        for message in messages():
            out.append((feed.sent - 1, message.decode(errors="replace")))
            if len(out) == ROWS:
                yield rows()
        held = sorted(feed.waiting)
        state.update((feed.number, feed.sent, None if feed.lines is None else b"\n".join(feed.lines), feed.begun, held, [feed.waiting[n] for n in held]))
        if quiet is not None and (feed.begun or feed.lines is not None):
            state.setTimeoutDuration(int(1000 * quiet))
        yield rows()

    return step


#: Names of files with chunks.
NAME = r"([^/]*)\.(\d+)(\.end)?$"


def chunk_files(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """A stream of (feed, number, content) from files named ``feed.number`` that arrive in a folder.

    Files without a byte are never read, so that a feed's end is a file ``feed.number.end`` with any content.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_batch).load(path)
    part = lambda k: F.regexp_extract("path", NAME, k)
    return files.select(part(1).alias("feed"), part(2).cast("long").alias("number"), F.when(part(3) == "", F.col("content")).alias("content"))


def message_fields(text: Column) -> list[Column]:
    """ts, level and message of a message; lines after its first are cleaned and follow as they are."""
    lines = F.split(text, "\n")
    ts, level, first = log_fields(lines[0])
    more = F.transform(F.slice(lines, 2, F.size(lines)), text_clean)
    return [ts, level, F.array_join(F.concat(F.array(first), more), "\n").alias("message")]


def log_frames(chunks: DataFrame, quiet: float | None = None) -> DataFrame:
    """A stream of (feed, number, ts, level, message) from a stream of (feed, number, content); number counts a feed's messages.

    ``quiet``, in seconds, is for queries that go on: with it a query that takes what is there and ends never would.
    """
    rows = chunks.select(F.col("feed").cast("string").alias("feed"), F.coalesce("number", F.raise_error(F.lit("a chunk has no number")).cast("long")).alias("number"), "content")
    timeout = GroupStateTimeout.NoTimeout if quiet is None else GroupStateTimeout.ProcessingTimeTimeout
    whole = rows.groupBy("feed").applyInPandasWithState(_step(quiet), "feed string, number long, text string", STATE, "append", timeout)
    return whole.select("feed", "number", *message_fields(F.col("text")))
