"""Media columns: Netpbm and BMP decoded to numpy arrays, area-resized by integral images, NPY tiles, difference hashes.

Decoders take whole byte strings and give ``(height, width)`` or ``(height, width, 3)`` arrays of 8-bit samples.
:func:`media_row` stores a payload losslessly as a binary graymap or a BMP, reads the stored bytes back and computes
features from what was read. :func:`write_tiles` writes one NPY tile for each distinct payload into a shared folder.

Defined results: null or empty payloads become one block of 64 zero bytes; equal payloads give equal values;
repeated rows are kept; null ids are kept; ids must be whole numbers or texts of such; an empty table gives an empty
result. ``decode`` raises ``ValueError`` for what it can't read."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import written

WIDTH = 64


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 with at most 8 bits a sample; samples are scaled to 0..255 if the maximum is another."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm file")
    at, numbers = 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)").match(data, at)
        if not m:
            raise ValueError("bad Netpbm header")
        numbers.append(int(m[1]))
        at = m.end()
    width, height, most = (*numbers, 1)[:3]
    if not (0 < most < 256 and width > 0 and height > 0):
        raise ValueError("unsupported Netpbm size or depth")
    planes = 3 if kind in (b"P3", b"P6") else 1
    n = width * height * planes
    if kind in (b"P5", b"P6"):
        flat = np.frombuffer(data, np.uint8, offset=at + 1) if len(data) > at + 1 else np.zeros(0, np.uint8)
    elif kind == b"P4":
        row = (width + 7) // 8
        packed = np.frombuffer(data, np.uint8, offset=at + 1)
        if len(packed) < row * height:
            raise ValueError("short Netpbm data")
        flat = 1 - np.unpackbits(packed[: row * height].reshape(height, row), axis=1)[:, :width].ravel()
    else:
        body = re.sub(rb"#[^\n]*\n?", b" ", data[at:])
        flat = np.array(list(body.translate(None, b" \t\r\n\v\f")), np.int64) - 48 if kind == b"P1" else np.array(body.split(), dtype=np.int64)
        flat = 1 - flat[:n] if kind == b"P1" else flat
    if len(flat) < n:
        raise ValueError("short Netpbm data")
    flat = flat[:n]
    if most != 255:
        flat = (flat.astype(np.int64) * 255 + most // 2) // most
    image = flat.astype(np.uint8).reshape((height, width, 3) if planes == 3 else (height, width))
    return image


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits, bottom-up or top-down."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP file")
    offset, size, width, height = struct.unpack_from("<I", data, 10)[0], *struct.unpack_from("<Iii", data, 14)
    bits, packing = struct.unpack_from("<HI", data, 28)
    used = struct.unpack_from("<I", data, 46)[0]
    if packing != 0 or bits not in (8, 24, 32) or width <= 0 or height == 0:
        raise ValueError("unsupported BMP")
    row = (width * bits // 8 + 3) // 4 * 4
    if len(data) < offset + row * abs(height):
        raise ValueError("short BMP data")
    rows = np.frombuffer(data, np.uint8, row * abs(height), offset).reshape(abs(height), row)[:: -1 if height > 0 else 1]
    if bits == 8:
        colours = np.frombuffer(data, np.uint8, 4 * (used or 256), 14 + size).reshape(-1, 4)[:, 2::-1]
        picked = rows[:, :width]
        if len(picked) and picked.max() >= len(colours):
            raise ValueError("BMP palette too short")
        image = colours[picked]
        grey = (image[..., 0] == image[..., 1]).all() and (image[..., 1] == image[..., 2]).all()
        return np.ascontiguousarray(image[..., 0] if grey else image)
    return np.ascontiguousarray(rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[..., 2::-1])


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_pgm(image: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + np.ascontiguousarray(image, np.uint8).tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """8-bit BMP with a grey palette, or 24-bit for three planes."""
    height, width = image.shape[:2]
    grey = image.ndim == 2
    row = (width * (1 if grey else 3) + 3) // 4 * 4
    rows = np.zeros((height, row), np.uint8)
    rows[:, : width * (1 if grey else 3)] = image[::-1] if grey else image[::-1, :, ::-1].reshape(height, -1)
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1) * np.array([1, 1, 1, 0], np.uint8) if grey else np.zeros((0, 4), np.uint8)
    start = 54 + palette.size
    head = b"BM" + struct.pack("<IHHIIiiHHIIiiII", start + rows.size, 0, 0, start, 40, width, height, 1, 8 if grey else 24, 0, rows.size, 2835, 2835, 256 if grey else 0, 0)
    return head + palette.tobytes() + rows.tobytes()


def _edges(table: np.ndarray, n: int) -> np.ndarray:
    """Values of an integral table (along axis 0, one longer than its source) at n + 1 evenly spaced real edges."""
    at = np.arange(n + 1) * ((len(table) - 1) / n)
    low = np.minimum(at.astype(np.int64), len(table) - 2)
    part = (at - low).reshape(-1, *[1] * (table.ndim - 1))
    return table[low] * (1 - part) + table[low + 1] * part


#: Rows of an image whose integral is held at once.
STRIPE = 4096


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each target cell's area, from an integral image; whole and fractional cells alike.

    The integral is taken stripe by stripe and kept only at the target's rows of cells, so that a tall image needs no table of its size."""
    n = image.shape[0]
    at = np.arange(height + 1) * (n / height)
    low = np.minimum(at.astype(np.int64), n - 1)
    rows, above = np.zeros((height + 1, image.shape[1] + 1)), np.zeros(image.shape[1] + 1)
    for start in range(0, n, STRIPE):
        part = image[start : start + STRIPE]
        integral = np.zeros((len(part) + 1, image.shape[1] + 1))
        np.cumsum(np.cumsum(part.mean(axis=2) if part.ndim == 3 else part, axis=0, dtype=np.float64), axis=1, out=integral[1:, 1:])
        integral += above
        own = np.flatnonzero((low >= start) & (low < start + len(part)))
        share = (at[own] - low[own])[:, None]
        rows[own] = integral[low[own] - start] * (1 - share) + integral[low[own] - start + 1] * share
        above = integral[-1]
    cells = np.diff(np.diff(_edges(rows.T, width).T, axis=0), axis=1)
    return cells / ((n / height) * (image.shape[1] / width))


def npy_tile(cells: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(cells), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def difference_hash(image: np.ndarray) -> str:
    """64 bits: whether each cell of 8 rows of 9 is darker than its right neighbour."""
    small = np.rint(area_resize(image, 8, 9) * 256)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def media_row(text: str | None) -> tuple[int, bytes, bytes, str, bytes]:
    """Unpadded length, stored media, payload read back, feature, NPY tile.

    The stored form follows from the payload: a graymap, or a BMP if the payload's CRC is odd."""
    n, payload = payload_of(text)
    encode = encode_bmp if zlib.crc32(payload) & 1 else encode_pgm
    media = encode(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH))
    image = decode(media)
    tile = npy_tile(area_resize(image, 16, 16))
    return n, media, image.tobytes(), f"{difference_hash(image)}:{hashlib.sha256(tile).hexdigest()[:16]}", tile


def _batches(column: pa.Array, rows: int) -> Iterator[tuple[int, list]]:
    for i in range(0, len(column), rows):
        yield i, column.slice(i, rows).to_pylist()


def media_table(docs: DataFrame, *, key: Column, text: Column, with_media: bool = True) -> DataFrame:
    """key, n_bytes, media (stored form; null without ``with_media``), tile (NPY bytes), feature for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, texts in _batches(batch.column(1), 256):
                made = [media_row(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, len(texts)), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] if with_media else None for m in made], pa.binary()), pa.array([m[4] for m in made], pa.binary()), pa.array([m[3] for m in made], pa.string())],
                    ["key", "n_bytes", "media", "tile", "feature"],
                )

    chosen = docs.select(key.cast("long").alias("key"), text.cast("string").alias("text"))
    return chosen.mapInArrow(run, "key long, n_bytes long, media binary, tile binary, feature string")


def media_digest(docs: DataFrame, *, key: Column, text: Column) -> DataFrame:
    """The contract's columns: digests of the stored form and of the payload read back from it. Tiles are written to the shared folder as
    NPY bytes; a row's feature is its difference hash and the digest of its tile, read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, texts in _batches(batch.column(1), 256):
                out: dict[str, list] = {c: [] for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "hash", "tile")}
                for t in texts:
                    n, media, payload, feature, tile = media_row(t)
                    for c, v in zip(out, (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature.split(":")[0], tile), strict=True):
                        out[c].append(v)
                kinds = {int: pa.int64(), str: pa.string(), bytes: pa.binary()}
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(texts)), *[pa.array(v, kinds[type(v[0])]) for v in out.values()]], ["doc_id", *out])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, hash string, tile binary"
    stored = written(docs.select(key.cast("long").alias("key"), text.cast("string").alias("text")).mapInArrow(run, schema), "media-tiles")
    return stored.withColumn("feature", F.concat_ws(":", "hash", F.substring(F.sha2("tile", 256), 1, 16))).drop("hash", "tile")


def write_tiles(docs: DataFrame, path: str, *, text: Column) -> DataFrame:
    """Write the tiles as a Parquet table of NPY bytes, one row for each distinct payload: feature, tile; gives it read back."""
    made = media_table(docs, key=F.lit(None), text=text, with_media=False).groupBy("feature").agg(F.min("tile").alias("tile"))
    made.write.parquet(path)
    return docs.sparkSession.read.schema(made.schema).parquet(path)
