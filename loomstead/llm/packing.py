"""Packing of token streams into fixed windows: bounded-space best fit in each partition, then leftovers.

Every partition keeps at most ``open_windows`` windows. A document first gives whole windows; its rest goes
to the open window that it leaves fullest. Where it fits none and no window is free, its first tokens fill
the fullest window, which is emitted, and the rest is placed anew: no emitted window has padding. What is
open when a partition ends is merged there into full windows and one remainder of less than a window; the
remainders of all partitions, at most one window each, are merged by a second round of the same kind, and
what is left of that is cut into sequences whose lengths are powers of two.

Memory: ``open_windows`` windows and one document a task. Nulls and empty texts give the end mark alone;
every row is packed for itself, repeated ones and null ids too; an empty table gives no rows; columns other
than the id and the text aren't read. Long texts are tokenized unit by unit.
"""

from __future__ import annotations

import functools
import zlib

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.llm.common import kept, per_batch, text_rows
from loomstead.llm.units import UNIT_BYTES, TwoGenerations, coder, packed

PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"
#: Leftovers of so many partitions meet in one task of the second round.
MERGED = 64


class Packer:
    """Open windows as lists of (doc, start, ids as bytes, doc_tokens); ``emit`` takes a finished one."""

    def __init__(self, size: int, open_windows: int):
        self.size, self.most = size, open_windows
        self.open: list[list] = []  # [tokens, pieces]
        self.done: list[list[tuple]] = []

    def add(self, doc, start: int, ids: bytes, total: int) -> None:
        whole = 4 * self.size
        cut = 0
        while len(ids) - cut >= whole:
            self.done.append([(doc, start + cut // 4, ids[cut : cut + whole], total)])
            cut += whole
        if cut < len(ids):
            self._place((doc, start + cut // 4, ids[cut:], total))

    def _place(self, piece: tuple) -> None:
        doc, start, ids, total = piece
        n = len(ids) // 4
        fits = [w for w in self.open if w[0] + n <= self.size]
        if fits:
            self._put(max(fits, key=lambda w: w[0]), piece)
        elif len(self.open) < self.most:
            self._put(self._new(), piece)
        else:
            fullest = max(self.open, key=lambda w: w[0])
            gap = self.size - fullest[0]
            self._put(fullest, (doc, start, ids[: 4 * gap], total))
            self._place((doc, start + gap, ids[4 * gap :], total))

    def _new(self) -> list:
        self.open.append([0, []])
        return self.open[-1]

    def _put(self, window: list, piece: tuple) -> None:
        window[0] += len(piece[2]) // 4
        window[1].append(piece)
        if window[0] == self.size:
            self.done.append(window[1])
            self.open = [w for w in self.open if w is not window]

    def merge(self) -> list[tuple]:
        """The open windows merged, emptiest into fullest; pieces of the one that stays unfilled."""
        left = sorted(self.open, key=lambda w: -w[0])
        self.open = []
        while len(left) > 1:
            into, (_, pieces) = left[0], left.pop()
            for k, (doc, start, ids, total) in enumerate(pieces):
                gap = self.size - into[0]
                into[1].append((doc, start, ids[: 4 * gap], total))
                into[0] += min(gap, len(ids) // 4)
                if into[0] == self.size:
                    self.done.append(left.pop(0)[1])
                    rest = [(doc, start + gap, ids[4 * gap :], total)] * (len(ids) > 4 * gap) + pieces[k + 1 :]
                    if rest:
                        left.append([sum(len(p[2]) // 4 for p in rest), rest])
                        left.sort(key=lambda w: -w[0])
                    break
        return left[0][1] if left else []


def powers_of_two(pieces: list[tuple]) -> list[list[tuple]]:
    """Pieces of fewer tokens than a window, cut into sequences whose lengths are falling powers of two."""
    out: list[list[tuple]] = []
    n = sum(len(p[2]) // 4 for p in pieces)
    todo = pieces[::-1]
    for bit in range(n.bit_length() - 1, -1, -1):
        if need := n & (1 << bit):
            out.append([])
            while need:
                doc, start, ids, total = todo.pop()
                got = min(need, len(ids) // 4)
                out[-1].append((doc, start, ids[: 4 * got], total))
                if len(ids) > 4 * got:
                    todo.append((doc, start + got, ids[4 * got :], total))
                need -= got
    return out


class _Step:
    """Rows of finished sequences, with ids only for what a later round has to place."""

    def __init__(self, size: int, open_windows: int, base: int, last: bool):
        self.packer, self.last, self.base, self.count = Packer(size, open_windows), last, base, 0
        self.source = TaskContext.get().partitionId()

    def rows(self, sequences: list[list[tuple]], loose: bool = False) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in ("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "ids", "source")}
        for sequence in sequences:
            at, total = 0, sum(len(p[2]) // 4 for p in sequence)
            for doc, start, ids, tokens in sequence:
                n = len(ids) // 4
                for k, v in zip(out, (doc, start, n, zlib.crc32(ids), tokens, self.base + (self.source << 32) + self.count, at, total, ids if loose else None, self.source if loose else None), strict=True):
                    out[k].append(v)
                at += n
            self.count += 1
        return out

    def drained(self) -> dict[str, list]:
        done, self.packer.done = self.packer.done, []
        return self.rows(done)

    def finish(self):
        rest = self.packer.merge()
        yield self.drained()
        yield self.rows(powers_of_two(rest)) if self.last else self.rows([rest] if rest else [], loose=True)


@functools.lru_cache(maxsize=2)
def _units(path: str) -> TwoGenerations:
    """Ids of units, kept for all tasks of a Python worker. The vocabulary drops white space: every space is a cut."""
    code = coder(path)
    return TwoGenerations(lambda u: code.packed(u) if u else b"", UNIT_BYTES)


class _Texts(_Step):
    def __init__(self, path: str, end: int | None, **k):
        super().__init__(**k)
        self.unit, self.end = _units(path), packed([end]) if end is not None else b""

    def __call__(self, rows: dict[str, list]):
        for doc, text in zip(rows["id"], rows["text"], strict=True):
            ids = b"".join([*map(self.unit.__getitem__, text.split(" ")), self.end])
            self.packer.add(doc, 0, ids, len(ids) // 4)
        yield self.drained()


class _Pieces(_Step):
    def __call__(self, rows: dict[str, list]):
        for doc, start, ids, total in zip(rows["id"], rows["start"], rows["ids"], rows["doc_tokens"], strict=True):
            self.packer.add(doc, start, ids, total)
        yield self.drained()


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int | None = 1, open_windows: int = 64) -> DataFrame:
    """Pieces of documents in sequences of at most ``size`` tokens.

    ``tokenizer`` is the file of a vocabulary with an end-of-word mark. Returns the id column and start,
    length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens.
    """
    rows = text_rows(df, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, {PIECE}, ids binary, source int"
    first = kept(per_batch(rows, lambda: _Texts(tokenizer, end_id, size=size, open_windows=open_windows, base=0, last=False), schema), "packed")
    loose = first.where("ids is not null")
    tasks = -(-loose.select("source").distinct().count() // MERGED) or 1
    # In one order, and written: a task that runs again packs the same sequences.
    dealt = loose.repartition(tasks, "source").sortWithinPartitions("source", "id", "start", "ids_crc32", "offset")
    merged = per_batch(dealt, lambda: _Pieces(size=size, open_windows=open_windows, base=1 << 60, last=True), schema)
    out = first.where("ids is null").unionByName(kept(merged, "merged"))
    return out.select(F.col("id").alias(id_col), *(c.split()[0] for c in PIECE.split(", ")))
