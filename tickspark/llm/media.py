"""Media columns: Netpbm and BMP as numpy arrays, area resize by integral images, NPY tiles, difference hashes.

Rows without bytes, or with bytes that are no such image, give no pixels (decode() raises ValueError for
them; media_tiles() returns one row with a null tile). Empty tables give empty results, repeated rows
repeated results, and other columns of the input don't matter.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickspark.llm.common import slices

#: Width of the pictures that hold texts: 64 pixels of 3 samples are 192 bytes a row.
WIDTH, ROW = 64, 192


def encode_ppm(pixels: np.ndarray) -> bytes:
    """P6 Netpbm of an (h, w, 3) array of bytes."""
    h, w, _ = pixels.shape
    return b"P6\n%d %d\n255\n" % (w, h) + pixels.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """24-bit BMP, rows from the bottom, blue first, each padded to 4 bytes."""
    h, w, _ = pixels.shape
    body = np.zeros((h, (3 * w + 3) // 4 * 4), np.uint8)
    body[:, : 3 * w] = pixels[::-1, :, ::-1].reshape(h, 3 * w)
    head = b"BM" + (54 + body.size).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little")
    info = b"".join(x.to_bytes(n, "little", signed=True) for x, n in ((40, 4), (w, 4), (h, 4), (1, 2), (24, 2), (0, 4), (body.size, 4), (2835, 4), (2835, 4), (0, 4), (0, 4)))
    return head + info + body.tobytes()


def decode(data: bytes) -> np.ndarray:
    """(h, w, 3) bytes of a P2, P3, P5 or P6 Netpbm of up to 8 bits or of a 24-bit BMP; else ValueError."""
    if data[:2] == b"BM" and len(data) >= 54:
        start, w, h = (int.from_bytes(data[a : a + 4], "little", signed=True) for a in (10, 18, 22))
        if int.from_bytes(data[28:30], "little") != 24 or data[30:34] != bytes(4) or w <= 0 or h == 0:
            raise ValueError("only plain 24-bit BMP")
        step = (3 * w + 3) // 4 * 4
        if len(data) < start + step * abs(h):
            raise ValueError("BMP is cut off")
        rows = np.frombuffer(data, np.uint8, step * abs(h), start).reshape(abs(h), step)[:, : 3 * w].reshape(abs(h), w, 3)[:, :, ::-1]
        return rows[::-1] if h > 0 else rows
    if not (head := re.match(rb"P([2356])((?:\s|#[^\n]*\n)+)(\d+)((?:\s|#[^\n]*\n)+)(\d+)((?:\s|#[^\n]*\n)+)(\d+)\s", data)):
        raise ValueError("neither Netpbm nor BMP")
    kind, w, h, top = int(head[1]), int(head[3]), int(head[5]), int(head[7])
    depth = 3 if kind in (3, 6) else 1
    if not w or not h or not 0 < top < 256:
        raise ValueError("empty or deeper than 8 bits")
    if kind in (5, 6):
        if len(data) < head.end() + w * h * depth:
            raise ValueError("Netpbm is cut off")
        flat = np.frombuffer(data, np.uint8, w * h * depth, head.end())
    else:
        flat = np.array(data[head.end() :].split()[: w * h * depth], np.int64)
        if flat.size < w * h * depth:
            raise ValueError("Netpbm is cut off")
        if flat.min() < 0 or flat.max() > top:
            raise ValueError("a sample above the maximum")
        flat = flat.astype(np.uint8)
    flat = flat if top == 255 else (flat.astype(np.uint32) * 255 // top).astype(np.uint8)
    return np.broadcast_to(flat.reshape(h, w, depth), (h, w, 3))


def resize_area(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over the area that each target pixel covers, fractions of source pixels included, in doubles.

    The integral over x is interpolated at the target's borders first, so the summed table has
    h * (width + 1) entries, whatever the source's width.
    """
    h, w = pixels.shape[:2]

    def between(summed: np.ndarray, n: int, parts: int) -> np.ndarray:
        at = np.arange(parts + 1) * (n / parts)
        low = np.minimum(at.astype(np.int64), n - 1)
        edge = summed[low] + (summed[low + 1] - summed[low]) * (at - low).reshape(-1, *[1] * (summed.ndim - 1))
        return np.diff(edge, axis=0) * (parts / n)

    across = np.zeros((w + 1, h, *pixels.shape[2:]))
    np.cumsum(np.moveaxis(pixels, 1, 0), axis=0, out=across[1:])
    down = np.zeros((h + 1, width, *pixels.shape[2:]))
    np.cumsum(np.moveaxis(between(across, w, width), 0, 1), axis=0, out=down[1:])
    return between(down, h, height)


def grey(pixels: np.ndarray) -> np.ndarray:
    return pixels @ np.array([0.299, 0.587, 0.114])


def difference_hash(pixels: np.ndarray) -> str:
    """16 hex digits: for 8 rows of 9 area means, whether each is darker than its right neighbour."""
    small = np.round(grey(resize_area(pixels, 8, 9)), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    np.save(out := io.BytesIO(), np.ascontiguousarray(tile))
    return out.getvalue()


def tiles(pixels: np.ndarray, side: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Row, column and pixels of each square; the last ones of a row or column are smaller."""
    for y in range(0, pixels.shape[0], side):
        for x in range(0, pixels.shape[1], side):
            yield y // side, x // side, pixels[y : y + side, x : x + side]


def media_tiles(df: DataFrame, key: str, column: str, side: int = 64) -> DataFrame:
    """(key, tile_row, tile_col, npy, dhash) of each image in column: squares of side pixels as NPY files.

    What is null, cut off or no image gives one row with nulls. Tiles are cut one after the other, so a
    task holds one picture at a time.
    """
    schema = f"{key} {dict(df.dtypes)[key]}, tile_row int, tile_col int, npy binary, dhash string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column, 4 << 20):
            kind = batch.schema.field(0).type
            for k, data in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    pixels = decode(data.as_py() or b"")
                    found = [(y, x, npy(t), difference_hash(t)) for y, x, t in tiles(pixels, side)]
                except ValueError:
                    found = [(None, None, None, None)]
                columns = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(found), kind), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True))], [key, "tile_row", "tile_col", "npy", "dhash"])

    return df.select(key, column).mapInArrow(cut, schema)


def text_picture(text: bytes) -> bytes:
    """The text, padded with spaces to full rows, as a P6 picture of 64 pixels a row."""
    payload = text + b" " * (max(ROW, -(-len(text) // ROW) * ROW) - len(text))
    return encode_ppm(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 3))


def text_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media) of each whole text as a picture; null is empty."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 4 << 20):
            raw = [(x or "").encode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array(map(text_picture, raw), pa.binary())], [key, "n_bytes", "media"])

    return docs.select(key, text).mapInArrow(store, f"{key} {dict(docs.dtypes)[key]}, n_bytes long, media binary")


def media_facts(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """What the stored pictures hold: digests of the media, which are decoded and cut into NPY tiles; payload and hashes are read back from those.

    n_tiles and tiles_sha256 (of all tiles' files, in order) stand for the tiles, tile_hashes for their difference hashes.
    """
    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_tiles", "tiles_sha256", "tile_hashes"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", 4 << 20):
            rows = []
            for data in batch.column(2).to_pylist():
                files = [npy(t) for _, _, t in tiles(decode(data), WIDTH)]  # as wide as the picture, so they lie below each other
                parts = [np.load(io.BytesIO(f)) for f in files]
                payload = (pixels := np.concatenate(parts)).tobytes()
                whole, hashes = difference_hash(pixels), [difference_hash(p) for p in parts] if len(parts) > 1 else None
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), whole, len(files), hashlib.sha256(b"".join(files)).hexdigest(), ",".join(hashes or [whole])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    return media.select(key, "n_bytes", "media").mapInArrow(read, f"{key} {dict(media.dtypes)[key]}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_tiles long, tiles_sha256 string, tile_hashes string")
