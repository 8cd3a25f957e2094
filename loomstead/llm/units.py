"""Word units for tokenizers that are cut where no vocabulary of the kind can join the two sides.

A space after a character that is not white space always begins a new piece, whatever follows, so a text
may be cut before such spaces and its units encoded alone. Units repeat a lot: each task keeps a bounded
cache of them. A unit of plain Latin characters goes through the merge engine of ``tiktoken`` with the
ranks read from the tokenizer's own file; every other unit goes through ``tokenizers`` itself.
"""

from __future__ import annotations

import functools
import json
import os
import re
import sys
from array import array

import numpy as np

from loomstead.llm.common import TwoGenerations

PLAIN = re.compile("[\t\n\x20-\x7e\xa1-\u012f\u0131-\u024f]*")
BIG = sys.byteorder == "big"
#: What pre-tokenizers cut text into, byte-level and with an end-of-word mark.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
POINTS = frozenset(".,;:!?")
GAP = re.compile(r"\s ")
#: Bounds of caches in bytes, each for one Python worker: pieces, and units of a whole.
PIECE_BYTES, UNIT_BYTES = 24 << 20, 96 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, inverted."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def units(text: str) -> list[str]:
    """``text`` cut before each space that follows no white space; joined they are the text again."""
    if GAP.search(text) or text.startswith(" "):
        return re.split(r"(?<=\S)(?= )", text)
    first, *rest = text.split(" ")
    return [first, *(" " + x for x in rest)]


class Coder:
    """Token ids of units, for byte-level vocabularies with or without an end-of-word mark."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        model, self.special = read["model"], {x["content"]: x["id"] for x in read["added_tokens"]}
        mark, alphabet = model["end_of_word_suffix"] or "", byte_alphabet()
        self.mark, self.lower = b"\xff" if mark else b"", bool(mark)

        def raw(token: str) -> bytes:
            ends = bool(mark) and token.endswith(mark)
            return bytes(alphabet[c] for c in (token[: -len(mark)] if ends else token)) + self.mark * ends

        self.ids = {raw(t): i for t, i in model["vocab"].items()}
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        joined = [raw(a) + raw(b) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        single = sorted(b for b in self.ids if len(b) == 1 or len(b) == 2 and b.endswith(self.mark or b"\0\0\0"))
        single += [bytes([b]) for b in range(256) if bytes([b]) not in self.ids]
        order = {b: n for n, b in enumerate(sorted(single, key=lambda b: (len(b), b)))}
        for b in joined:
            order.setdefault(b, len(order))
        self.of_rank = {n: self.ids.get(b, -1) for b, n in order.items()}
        self.pattern = regex.compile(WORD_PIECES if mark else PIECES)
        #: For whole plain texts; with an end-of-word mark there are only pieces.
        self.texts = None if mark else tiktoken.Encoding("texts", pat_str=PIECES, mergeable_ranks=order, special_tokens={})._core_bpe
        self.id_of_rank = np.array([self.of_rank[n] for n in range(len(order))], "<i4")
        self.engine = tiktoken.Encoding("ranks", pat_str=r"\S+", mergeable_ranks=order, special_tokens={})._core_bpe
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.piece = TwoGenerations(self._piece, PIECE_BYTES)

    def split_special(self, text: str) -> list[str]:
        """A text cut at its special strings, the leftmost and of these the longest first: text, special, text, ..."""
        return self.specials.split(text) if self.special else [text]

    def pieces(self, text: str) -> list[str]:
        """What the pre-tokenizer makes of plain text without special strings."""
        return self.pattern.findall(text.lower() if self.lower else text)

    def _piece(self, piece: str) -> bytes:
        return packed(map(self.of_rank.__getitem__, self.engine.encode_single_piece(piece.encode() + self.mark)))

    def packed(self, unit: str) -> bytes:
        """The ids that the library gives for ``unit`` alone, as ``packed``: bytes cost the collector nothing."""
        if unit:
            head, tail = (unit[:-1], unit[-1]) if unit[-1] in POINTS else (unit, "")
            if (head[1:].isalpha() and (head[0] == " " or head[0].isalpha()) or len(head) == 1 and head.isalpha()) and PLAIN.fullmatch(head):
                # A word, and maybe a point after it: no pattern is needed.
                word = self.piece[head.strip(" ").lower() if self.lower else head]
                return word + self.piece[tail] if tail else word
        if not PLAIN.fullmatch(unit) or "<|" in unit:
            return packed(self.library.encode(unit, add_special_tokens=False).ids)
        return b"".join([self.piece[p] for p in self.pieces(unit)])

    def encode(self, unit: str) -> list[int]:
        """The ids that the library gives for ``unit`` alone."""
        return unpacked(self.packed(unit))

    def packed_text(self, text: str) -> bytes:
        """The ids of a text, as ``packed``: plain ones as a whole, others unit by unit."""
        if self.texts and "<|" not in text and PLAIN.fullmatch(text):
            ranks = np.frombuffer(self.texts.encode_to_tiktoken_buffer(text, set()), "u4")
            return self.id_of_rank[ranks].tobytes()
        return b"".join([self.packed(u) for u in units(text)])

    def encode_text(self, text: str) -> list[int]:
        return unpacked(self.packed_text(text))

    def __reduce__(self):
        raise TypeError("a coder stays in its worker; send the path")

    def decode(self, ids: list[int]) -> str:
        """As the library's byte-level decoder with special tokens kept."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def coder(path: str) -> Coder:
    """One coder for each vocabulary file and Python worker."""
    return Coder(path)


def packed(ids) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    a = array("I", ids)
    if BIG:
        a.byteswap()
    return a.tobytes()


def unpacked(raw: bytes) -> list[int]:
    a = array("I", raw)
    if BIG:
        a.byteswap()
    return a.tolist()


class Joined:
    """What ``make`` gives for each unit of a text as bytes, joined; units come from caches of bounded bytes."""

    def __init__(self, make, most_bytes: int = UNIT_BYTES):
        self.whole = TwoGenerations(make, most_bytes // 4)
        self.after = TwoGenerations(lambda u: None if not u or u[-1].isspace() else make(" " + u), most_bytes // 4 * 3)

    def __call__(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if rest and (not first or first[-1].isspace()):
            return b"".join([self.whole[u] for u in units(text)])
        try:  # a unit that is empty or ends in white space has no value: the plain split may not cut there
            return b"".join([self.whole[first], *map(self.after.__getitem__, rest)])
        except TypeError:
            return b"".join([self.whole[u] for u in units(text)])
