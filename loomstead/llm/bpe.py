"""Byte-level BPE encoding and decoding; long unsplit text by tree concatenation.

A text of more than ``leaf_chars`` code points is cut into leaves of equal length, wherever that falls. Leaves
are encoded alone and joined pairwise: a window around the join is encoded
again and grows until, at either edge, its tokens agree with those of the side exactly, which holds where the
edge is a place that no piece crosses, or where the token there is the same inside one run of equal kind, as
every two neighbouring tokens of a piece are then merge-valid. Edges are where a whole character begins; tokens there
may be parts of characters, whose kinds are then looked at. Special strings stand alone in any case, so
the stretches between them are encoded each as such a tree.

Texts of more than ``spread_chars`` code points are dealt out as leaf rows, so that many tasks encode one
text; the leaves of a text (equal texts once) meet by its digest and are joined as the same tree.

Null texts encode as empty; every row has its own result; empty tables give no rows; other columns aren't
read. Memory: one text and its ids, and a cache of pieces of bounded bytes.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.llm.common import parts, per_batch, text_rows
from loomstead.llm.units import Coder, coder, packed, unpacked

LEAF_CHARS, SPREAD_CHARS = 1024, 65_536


@functools.lru_cache(maxsize=1 << 16)
def kind_of(c: str) -> str:
    """Letter, number, space or other, as the pre-tokenizer tells them apart."""
    import regex

    return "L" if regex.match(r"\p{L}", c) else "N" if regex.match(r"\p{N}", c) else "S" if regex.match(r"\s", c) or c.isspace() else "P"


def free_cut(text: str, at: int) -> bool:
    """Whether a piece always ends before ``at``, whatever stands around: the kind changes and no space or contraction joins."""
    a, b = text[at - 1], text[at]
    ka, kb = kind_of(a), kind_of(b)
    return ka != kb and ka != "S" and not (a == "'" and kb == "L")


class Tree:
    """Encodes texts by halves; ids are packed, as little-endian 32-bit numbers.

    ``leaf`` gives the ids of a short text. Nothing but the ids is looked at: they say what they stand for.
    """

    def __init__(self, code: Coder, leaf: Callable[[str], bytes], leaf_chars: int = LEAF_CHARS, window: int = 32):
        self.code, self.leaf, self.leaf_chars, self.window, self.joins = code, leaf, leaf_chars, window, 0
        self.token = code.bytes_of

    def encode(self, text: str) -> bytes:
        """The ids of a whole text: special strings stand alone, the text between them is halved."""
        parts = self.code.split_special(text)
        if len(parts) == 1:
            return self.halves(text)
        return b"".join(packed([self.code.special[t]]) if n % 2 else self.halves(t) for n, t in enumerate(parts))

    def halves(self, text: str) -> bytes:
        if len(text) <= self.leaf_chars:
            return self.leaf(text)
        # Leaves of equal length, joined pairwise.
        n = -(-len(text) // self.leaf_chars)
        edges = [len(text) * k // n for k in range(n + 1)]
        return self.together([self.leaf(text[a:b]) for a, b in itertools.pairwise(edges)])

    def together(self, ids: list[bytes]) -> bytes:
        """The ids of neighbouring parts of a text as those of the whole."""
        while len(ids) > 1:
            ids = [self.join(*ids[k : k + 2]) if k + 1 < len(ids) else ids[k] for k in range(0, len(ids), 2)]
        return ids[0] if ids else b""

    def join(self, left: bytes, right: bytes) -> bytes:
        """A window around the seam is encoded again, and grows until both sides agree with it."""
        if not left or not right:
            return left or right
        self.joins += 1
        n, m, size = len(left) // 4, len(right) // 4, self.window
        while True:
            i, before, free_left = self._back(left, n, size)
            j, after, free_right = self._ahead(right, m, size)
            ids = self.leaf((before + after).decode())
            if (free_left or self._agrees_left(left, i, ids)) and (free_right or self._agrees_right(right, j, m, ids)):
                return left[: 4 * i] + ids + right[4 * j :]
            size *= 2

    def _bytes(self, ids: bytes, a: int, b: int) -> bytes:
        return b"".join([self.token[t] for t in unpacked(ids[4 * a : 4 * b])])

    def _back(self, ids: bytes, n: int, size: int) -> tuple[int, bytes, bool]:
        """The last tokens with at least ``size`` bytes that begin with a whole character: their first place, their bytes, and whether no piece crosses there."""
        i = max(0, n - size - 16)
        known = [self.token[t] for t in unpacked(ids[4 * i :])]
        held, whole, spaced = 0, -1, -1
        for k in range(len(known) - 1, 0, -1):
            held += len(known[k])
            if held >= size and known[k][0] & 0xC0 != 0x80:
                whole = k if whole < 0 else whole
                # Before a space, after what is none, and where the kind changes: no piece crosses.
                if known[k][0] == 32 and 32 < known[k - 1][-1] < 127 or self._free(ids, i + k, n):
                    spaced = k
                    break
        k = spaced if spaced >= 0 else whole
        if k < 0:  # all of it; where there is more, it may only not begin with a whole character
            if i:
                return self._back(ids, n, 2 * size)
            k = 0
        return i + k, b"".join(known[k:]), spaced >= 0

    def _ahead(self, ids: bytes, m: int, size: int) -> tuple[int, bytes, bool]:
        """The first tokens of the kind, after which a whole character begins: the place after them, and the same."""
        j = min(m, size + 16)
        known = [self.token[t] for t in unpacked(ids[: 4 * j])]
        held, whole, spaced = 0, -1, -1
        for k in range(1, len(known)):
            held += len(known[k - 1])
            if held >= size and known[k][0] & 0xC0 != 0x80:
                whole = k if whole < 0 else whole
                if known[k][0] == 32 and 32 < known[k - 1][-1] < 127 or self._free(ids, k, m):
                    spaced = k
                    break
        k = spaced if spaced >= 0 else whole
        if k < 0:
            if j < m:
                return self._ahead(ids, m, 2 * size)
            k = m
        return k, b"".join(known[:k]), spaced >= 0

    def _near(self, ids: bytes, k: int, n: int) -> tuple[str, int]:
        """Four code points before and after the place before token k, where a whole character begins, and how many are before."""
        before = self._bytes(ids, max(0, k - 16), k).decode("utf-8", "ignore")[-4:]
        return before + self._bytes(ids, k, min(n, k + 16)).decode("utf-8", "ignore")[:4], len(before)

    def _free(self, ids: bytes, k: int, n: int) -> bool:
        near, before = self._near(ids, k, n)
        return 0 < before < len(near) and free_cut(near, before)

    def _same_run(self, ids: bytes, k: int, n: int, begins: bool) -> bool:
        """Whether token k, with the characters that it has a part of, and four code points on either side are a run of one kind without an apostrophe.

        The token begins (or else ends) where a whole character does; its other end may be inside one.
        """
        own = len(self.token[unpacked(ids[4 * k : 4 * k + 4])[0]])
        before, after = self._bytes(ids, max(0, k - 20), k + (not begins)), self._bytes(ids, k + (not begins), min(n, k + 21))
        before, after = before.decode("utf-8", "ignore"), after.decode("utf-8", "ignore")
        # As many code points as hold the token's bytes, on the side where they are.
        mine, held = 0, 0
        for c in after if begins else reversed(before):
            if held >= own:
                break
            mine, held = mine + 1, held + len(c.encode())
        text = before[-4 - (0 if begins else mine) :] + after[: 4 + (mine if begins else 0)]
        return held >= own and len(text) == 8 + mine and "'" not in text and len({kind_of(c) for c in text}) == 1

    def _agrees_left(self, left: bytes, i: int, ids: bytes) -> bool:
        if i == 0:
            return True
        n = len(left) // 4
        return self._free(left, i, n) or ids[:4] == left[4 * i : 4 * i + 4] and self._same_run(left, i, n, True)

    def _agrees_right(self, right: bytes, j: int, m: int, ids: bytes) -> bool:
        if j == m:
            return True
        return self._free(right, j, m) or ids[-4:] == right[4 * j - 4 : 4 * j] and self._same_run(right, j - 1, m, False)


@functools.lru_cache(maxsize=2)
def tree_of(path: str, leaf_chars: int) -> Tree:
    """One tree coder for each vocabulary and Python worker."""
    code = coder(path)
    return Tree(code, code.packed_text, leaf_chars)


def leaves(text: str, code: Coder, chars: int) -> list[tuple[str, int]]:
    """Parts of a text of at most ``chars`` code points, and the stretch between special strings that each is part of.

    A special string is a stretch of its own, with an odd number.
    """
    return [(t, n) if n % 2 else (t[k : k + chars], n) for n, t in enumerate(code.split_special(text)) for k in range(0, len(t), len(t) if n % 2 else chars)]


def _lists(flat: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(b) // 4 for b in flat)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(flat), "<i4"), pa.int32()))


def encode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = LEAF_CHARS, spread_chars: int = SPREAD_CHARS) -> DataFrame:
    """The id column and ``ids`` (array of int), as the tokenizers library encodes the texts without added tokens."""
    rows = text_rows(df, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()

    def short(batches):
        ids_of = tree_of(tokenizer, leaf_chars).encode
        for batch in batches:
            for part in parts(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), _lists([ids_of(t) for t in part.column(1).to_pylist()])], names=["id", "ids"])

    def spread():
        code = coder(tokenizer)

        def step(rows):
            for key, text in zip(rows["key"], rows["text"], strict=True):
                cut = leaves(text, code, max(leaf_chars, spread_chars // 8))
                yield {"key": [key] * len(cut), "at": list(range(len(cut))), "leaf": [p[0] for p in cut], "stretch": [p[1] for p in cut]}

        return step

    def leaf_ids():
        ids_of = tree_of(tokenizer, leaf_chars).encode

        def step(rows):
            yield {"key": rows["key"], "at": rows["at"], "stretch": rows["stretch"], "ids": [ids_of(t) for t in rows["leaf"]]}

        return step

    def meet(part: pa.Table) -> pa.Table:
        tree = tree_of(tokenizer, leaf_chars)
        got = sorted(zip(*(part[c].to_pylist() for c in ("at", "stretch", "ids")), strict=True))
        ids = b"".join(tree.together([x[2] for x in run]) for _, run in itertools.groupby(got, key=lambda x: x[1]))
        return pa.table({"key": part["key"][:1], "ids": _lists([ids])})

    few = rows.where(F.char_length("text") <= spread_chars).mapInArrow(short, f"id {kind}, ids array<int>")
    long = rows.where(F.char_length("text") > spread_chars).withColumn("key", F.sha2("text", 256))
    dealt = per_batch(long.select("key", "text").distinct(), spread, "key string, at int, leaf string, stretch int").repartition("key", "at")
    whole = per_batch(dealt, leaf_ids, "key string, at int, stretch int, ids binary").groupBy("key").applyInArrow(meet, "key string, ids array<int>")
    return few.unionByName(long.select("id", "key").join(whole, "key").select("id", "ids")).withColumnRenamed("id", id_col)


def decode(df: DataFrame, tokenizer: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids (special tokens kept, null for null); ``out_col`` must be a new name."""
    if out_col in df.columns:
        raise ValueError(f"there is a column {out_col} already")
    at = df.columns.index(ids_col)
    schema = df.schema.simpleString()[7:-1] + f",{out_col}:string"

    def run(batches):
        token = coder(tokenizer).bytes_of
        get = [token.get(i, b"") for i in range(max(token) + 1)].__getitem__
        for batch in batches:
            for part in parts(batch):
                lists = part.column(at)
                ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
                texts = [b"".join(map(get, flat[a:b].tolist())).decode("utf-8", "replace") if ok else None for a, b, ok in zip(ends, ends[1:], lists.is_valid().to_pylist())]  # noqa: B905
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, out_col])

    return df.mapInArrow(run, schema)
