"""Exact token counts of every prefix, by dynamic programming over merge-valid token pairs.

In a vocabulary whose tokens come from ranked merges, a token sequence is the encoding of its text exactly if
each two neighbours, encoded together, stay as they are. So the encoding of a prefix ends in the one token
that is a suffix of it and whose predecessor, the last token of the shorter prefix, may stand before it: the
count at a prefix is the count at the shorter one plus one. Pieces of the pre-tokenizer add up. Prefixes that
the pre-tokenizer would split otherwise than the whole text (inside white space, contractions and special
strings) are counted as the prefix alone is.

The table of a text holds the change of the count at each code point (16 bits each, zstd), so truncation and
budget questions are answered from it without encoding again.

Null texts count as empty; every row has its own result; empty tables give no rows; other columns aren't
read. Memory: a bounded cache of word units and one text.
"""

from __future__ import annotations

import functools
from array import array

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.llm.common import per_batch, text_rows
from loomstead.llm.units import PIECE_BYTES, PLAIN, Joined, TwoGenerations, coder


class PrefixCounts:
    """Counts at every code point of a text, for a byte-level vocabulary."""

    def __init__(self, path: str):
        import ahocorasick

        self.coder = coder(path)
        #: Finds every token that ends at a byte, the longest first.
        self.endings = ahocorasick.Automaton()
        for token, number in self.coder.ids.items():
            self.endings.add_word(token.decode("latin-1"), (len(token), number))
        self.endings.make_automaton()
        #: Whether the second token may follow the first; bounded by being emptied.
        self.valid: dict[int, bool] = {}
        self.piece = TwoGenerations(self._piece, PIECE_BYTES, each=40)

    def _valid(self, pair: int) -> bool:
        left, right = pair >> 20, pair & 0xFFFFF
        merged = self.coder.engine.encode_single_piece(self.coder.bytes_of[left] + self.coder.bytes_of[right])
        if len(self.valid) >= 500_000:
            self.valid.clear()
        self.valid[pair] = answer = [self.coder.of_rank[r] for r in merged] == [left, right]
        return answer

    def _piece(self, piece: str) -> list[int]:
        """Counts at the code points of one piece."""
        raw, known = piece.encode(), self.valid
        last, count = [-1] * (len(raw) + 1), [0] * (len(raw) + 1)
        for end, (n, token) in self.endings.iter(raw.decode("latin-1")):
            if last[end + 1] >= 0:
                continue
            if start := end + 1 - n:
                pair = last[start] << 20 | token
                may = known.get(pair)
                if not (self._valid(pair) if may is None else may):
                    continue
            last[end + 1] = token
            count[end + 1] = count[start] + 1
        if len(raw) == len(piece):
            return count[1:]
        ends, at = [], 0
        for c in piece:
            at += len(c.encode())
            ends.append(count[at])
        return ends

    def _plain(self, text: str) -> list[int]:
        """Counts at the code points of a text without whole special strings."""
        out: list[int] = []
        base = 0
        pieces = self.coder.pieces(text)
        k = 0
        while k < len(pieces):
            piece = pieces[k]
            ends = self.piece[piece]
            if piece[0] == "'" and len(piece) > 1 and piece[1:].isalpha():
                # A contraction: shorter prefixes are an apostrophe and a letter.
                ends = [1, *(1 + n for n in self.piece[piece[1:]][:-1]), ends[-1]]
            elif piece.isspace():
                # The space or the end of a run that goes to the next piece is still part of the run for a prefix.
                after = pieces[k + 1] if k + 1 < len(pieces) else ""
                run = len(after) - len(after.lstrip()) if after[:1].isspace() else 0
                if run:
                    inside = self.piece[piece + after[:run]]
                    out += [base + n for n in inside[: len(piece) + run]]
                    tail = self.piece[after]
                    base += ends[-1]
                    out += [base + n for n in tail[run:]]
                    base += tail[-1]
                    k += 2
                    continue
            out += [base + n for n in ends]
            base += ends[-1]
            k += 1
        return out

    def counts(self, text: str) -> list[int]:
        """The number of tokens of ``text[:k]`` for k = 1, 2, ..."""
        out: list[int] = []
        base = 0
        parts = self.coder.split_special(text)
        for head, special in zip(parts[::2], parts[1::2], strict=False):
            # Until its last character a special string is plain text.
            out += [base + n for n in self._plain(head + special[:-1])]
            base += (self._plain(head)[-1] if head else 0) + 1
            out.append(base)
        return out + [base + n for n in self._plain(parts[-1])]

    def changes(self, text: str) -> bytes:
        single = text[1:].isalpha() and text[0] == " " and PLAIN.fullmatch(text)
        counts = self._piece(text) if single else self.counts(text)
        return array("h", [b - a for a, b in zip([0, *counts], counts)]).tobytes()  # noqa: B905


@functools.lru_cache(maxsize=2)
def _changes(path: str) -> Joined:
    return Joined(PrefixCounts(path).changes)


def prefix_counts(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens (of the whole text) and prefix_counts, the table of the text."""

    def make():
        import zstandard

        changes, press = _changes(tokenizer), zstandard.ZstdCompressor(level=1)

        def step(rows):
            tables = [changes(t) for t in rows["text"]]
            yield {"id": rows["id"], "n_bytes": [len(t.encode()) for t in rows["text"]], "n_tokens": [int(np.frombuffer(x, "<i2").sum(dtype=np.int64)) for x in tables], "prefix_counts": [press.compress(x) for x in tables]}

        return step

    rows = text_rows(df, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return per_batch(rows, make, f"id {kind}, n_bytes long, n_tokens long, prefix_counts binary").withColumnRenamed("id", id_col)


def _answer(rule, returns: str):
    @F.pandas_udf(returns)
    def ask(tables, asked):
        import pandas as pd
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        totals = (np.cumsum(np.frombuffer(open_.decompress(t, max_output_size=1 << 31), "<i2"), dtype=np.int64) if t is not None else None for t in tables)
        return pd.Series([None if t is None or pd.isna(n) else rule(t, int(n)) for t, n in zip(totals, asked, strict=True)], dtype="Int64")

    return ask


def tokens_at(prefix_counts: Column, n_chars: Column) -> Column:
    """Tokens of the first ``n_chars`` code points (all, if the text is shorter; 0 for none)."""
    return _answer(lambda t, n: int(t[min(n, len(t)) - 1]) if n > 0 and len(t) else 0, "long")(prefix_counts, n_chars)


def longest_within(prefix_counts: Column, budget: Column) -> Column:
    """The most code points of the text from its start whose tokens, encoded alone, are within ``budget``."""
    return _answer(lambda t, n: int(np.flatnonzero(t <= n)[-1]) + 1 if n >= 0 and (t <= n).any() else 0, "long")(prefix_counts, budget)
