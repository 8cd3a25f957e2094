"""Media columns: Netpbm and BMP decoded to numpy arrays, area-resized by integral images, kept as NPY tiles.

``decode`` reads PBM, PGM and PPM (plain and raw, up to 8 bits a sample) and uncompressed BMP (8, 24, 32
bits). ``tiled`` cuts an image into tiles of equal size, its edges padded, as one NPY array (tiles, rows,
columns[, channels]); ``untiled`` puts it together. ``resized`` averages exact areas, with fractional edges,
by an integral image. ``difference_hash`` compares neighbours of a 9 x 8 area-resized grey image.

Undecodable or null media give null rows; every row has its own result; empty tables give no rows. Memory:
one image a task, several times over; a text stored as samples has one byte a sample.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.llm.common import col_of, kept, per_batch, text_rows

UNIT = 576
SIDE = 24


def decode(raw: bytes) -> np.ndarray:
    """Samples (rows, columns) or (rows, columns, 3) of a Netpbm or BMP file; ValueError if it is neither."""
    if raw[:1] == b"P" and raw[1:2] in b"123456" and len(raw) > 2:
        return _netpbm(raw)
    if raw[:2] == b"BM":
        return _bmp(raw)
    raise ValueError("neither Netpbm nor BMP")


def _netpbm(raw: bytes) -> np.ndarray:
    kind, at, head = raw[1] - 48, 2, []
    need = 2 if kind in (1, 4) else 3
    while len(head) < need:
        m = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*(\d+)").match(raw, at)
        if not m:
            raise ValueError("bad Netpbm header")
        head.append(int(m[1]))
        at = m.end()
    wide, high = head[:2]
    most = head[2] if need == 3 else 1
    if not (0 < most < 256 and wide > 0 and high > 0):
        raise ValueError("unsupported Netpbm size or depth")
    shape = (high, wide, 3) if kind in (3, 6) else (high, wide)
    n = int(np.prod(shape))
    if kind > 3:
        body = memoryview(raw)[at + 1 :]
        if kind == 4:
            rows = np.frombuffer(body, np.uint8, high * -(-wide // 8)).reshape(high, -1)
            return (1 - np.unpackbits(rows, axis=1)[:, :wide]) * np.uint8(255)
        out = np.frombuffer(body, np.uint8, n)
    elif kind == 1:
        bits = np.frombuffer(re.sub(rb"[^01]", b"", re.sub(rb"#[^\n\r]*", b"", raw[at:])), np.uint8)[:n] - 48
        out = (1 - bits) * np.uint8(255)
    else:
        out = np.array(re.sub(rb"#[^\n\r]*", b"", raw[at:]).split()[:n], dtype=np.uint8)
    if len(out) < n:
        raise ValueError("Netpbm data end early")
    out = out.reshape(shape)
    return out if most in (1, 255) and kind != 2 or most == 255 else (out.astype(np.uint32) * 255 // most).astype(np.uint8)


def _bmp(raw: bytes) -> np.ndarray:
    try:
        begin, size, wide, high, _, bits, packing = struct.unpack_from("<10xIIiiHHI", raw)
        colours = struct.unpack_from("<I", raw, 46)[0]
    except struct.error as e:
        raise ValueError("bad BMP header") from e
    if bits not in (8, 24, 32) or packing not in (0, 3) or wide <= 0 or high == 0:
        raise ValueError("unsupported BMP")
    stride = (wide * bits // 8 + 3) // 4 * 4
    if len(raw) < begin + stride * abs(high):
        raise ValueError("BMP data end early")
    rows = np.frombuffer(raw, np.uint8, stride * abs(high), begin).reshape(abs(high), stride)[:: 1 if high < 0 else -1]
    if bits == 8:
        palette = np.frombuffer(raw, np.uint8, 4 * (colours or 256), 14 + size).reshape(-1, 4)[:, 2::-1]
        out = palette[rows[:, :wide]]
        return np.ascontiguousarray(out[..., 0]) if (palette == palette[:, :1]).all() else out
    return np.ascontiguousarray(rows[:, : wide * bits // 8].reshape(abs(high), wide, bits // 8)[..., 2::-1])


def pgm(samples: np.ndarray) -> bytes:
    """A grey image as a raw PGM file."""
    return b"P5\n%d %d\n255\n" % samples.shape[::-1] + samples.tobytes()


def tiled(image: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Tiles of an image in reading order; edges are padded by 255."""
    high, wide = image.shape[:2]
    pad = [(0, -high % side), (0, -wide % side)] + [(0, 0)] * (image.ndim - 2)
    full = np.pad(image, pad, constant_values=255) if any(p[1] for p in pad) else image
    rows, cols = full.shape[0] // side, full.shape[1] // side
    return full.reshape(rows, side, cols, side, *image.shape[2:]).swapaxes(1, 2).reshape(rows * cols, side, side, *image.shape[2:])


def untiled(tiles: np.ndarray, high: int, wide: int) -> np.ndarray:
    side = tiles.shape[1]
    rows, cols = -(-high // side), -(-wide // side)
    full = tiles.reshape(rows, cols, side, side, *tiles.shape[3:]).swapaxes(1, 2)
    return full.reshape(rows * side, cols * side, *tiles.shape[3:])[:high, :wide]


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def from_npy(raw: bytes) -> np.ndarray:
    return np.load(io.BytesIO(raw), allow_pickle=False)


def resized(image: np.ndarray, high: int, wide: int) -> np.ndarray:
    """Mean of the exact area of each of ``high`` x ``wide`` cells, as floats, from an integral image."""
    whole = np.zeros((image.shape[0] + 1, image.shape[1] + 1, *image.shape[2:]))
    np.cumsum(image, axis=0, dtype=np.float64, out=whole[1:, 1:])
    np.cumsum(whole[1:, 1:], axis=1, out=whole[1:, 1:])

    def at(table: np.ndarray, n: int, cells: int) -> np.ndarray:
        """The table at fractional rows, linear between them: areas with fractional edges are exact."""
        edge = np.linspace(0, n, cells + 1)
        low = np.minimum(edge.astype(np.int64), n - 1)
        part = (edge - low).reshape(-1, *[1] * (table.ndim - 1))
        return table[low] * (1 - part) + table[low + 1] * part

    rows = at(whole, image.shape[0], high)
    both = at(rows.swapaxes(0, 1), image.shape[1], wide).swapaxes(0, 1)
    area = (image.shape[0] / high) * (image.shape[1] / wide)
    return (both[1:, 1:] - both[:-1, 1:] - both[1:, :-1] + both[:-1, :-1]) / area


def difference_hash(image: np.ndarray) -> str:
    """64 bits, as 16 hex digits: whether a cell of the 9 x 8 grey image is brighter than its left neighbour."""
    grey = image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])
    small = resized(grey, 8, 9).round(6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def media_tiles(df: DataFrame, media_col: str, id_col: str = "doc_id", side: int = SIDE) -> DataFrame:
    """The id column, height, width and ``tiles`` (an NPY file) of Netpbm or BMP files in a binary column."""

    def make():
        def step(rows):
            out = {"id": rows["id"], "height": [], "width": [], "tiles": []}
            for raw in rows["media"]:
                try:
                    image = decode(raw) if raw is not None else None
                except ValueError:
                    image = None
                out["height"].append(None if image is None else image.shape[0])
                out["width"].append(None if image is None else image.shape[1])
                out["tiles"].append(None if image is None else npy(tiled(image, side)))
            yield out

        return step

    rows = df.select(col_of(df, id_col).alias("id"), col_of(df, media_col).alias("media"))
    return per_batch(rows, make, f"id {rows.schema['id'].dataType.simpleString()}, height int, width int, tiles binary").withColumnRenamed("id", id_col)


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as grey PGM files ``SIDE`` samples wide: UTF-8, then 255 up to a positive multiple of UNIT; with n_bytes."""

    def make():
        def step(rows):
            out = {"id": rows["id"], "n_bytes": [], "media": []}
            for text in rows["text"]:
                raw = text.encode()
                padded = raw + b"\xff" * (-len(raw) % UNIT or (0 if raw else UNIT))
                out["n_bytes"].append(len(raw))
                out["media"].append(pgm(np.frombuffer(padded, np.uint8).reshape(-1, SIDE)))
            yield out

        return step

    rows = text_rows(df, id_col, text_col)
    return per_batch(rows, make, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def stored_features(stored: DataFrame, tiles_col: str = "tiles", id_col: str = "doc_id", carry: tuple[str, ...] = ("height", "width", "n_bytes")) -> DataFrame:
    """Features of tiles read back: sizes and digests of payload and stored form, and the difference hash."""

    def make():
        def step(rows):
            out = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for raw, high, wide in zip(rows["tiles"], rows["height"], rows["width"], strict=True):
                if raw is None:
                    for v in out.values():
                        v.append(None)
                    continue
                image = untiled(from_npy(raw), high, wide)
                payload = image.tobytes()
                for v, x in zip(out.values(), (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), difference_hash(image)), strict=True):
                    v.append(x)
            yield {"id": rows["id"], **{c: rows[c] for c in carry}, **out}

        return step

    rows = stored.select(col_of(stored, id_col).alias("id"), *carry, col_of(stored, tiles_col).alias("tiles"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in carry)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, {kinds}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return per_batch(rows, make, schema).withColumnRenamed("id", id_col)


def text_tiles(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as media, decoded and written as NPY tiles to the shared folder, and the table of them read again."""

    def make():
        def step(rows):
            images = [decode(m) for m in rows["media"]]
            yield {"id": rows["id"], "n_bytes": rows["n_bytes"], "height": [i.shape[0] for i in images], "width": [i.shape[1] for i in images], "tiles": [npy(tiled(i)) for i in images]}

        return step

    media = text_media(df, id_col, text_col).withColumnRenamed(id_col, "id")
    out = per_batch(media, make, f"id {media.schema['id'].dataType.simpleString()}, n_bytes long, height int, width int, tiles binary")
    return kept(out, "tiles").withColumnRenamed("id", id_col)
