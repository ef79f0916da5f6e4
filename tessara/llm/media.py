"""Media columns: Netpbm and BMP decoded to numpy, area-resized by integral images, tiled as NPY with difference hashes.

A payload of text becomes an image, is decoded, and its NPY tiles are written to
a table in the shared folder; what is reported comes from the tiles as read back.

Defined cases: null and empty payloads are one tile of padding; any bytes round
trip; equal payloads give equal values; an empty table gives an empty result;
other columns are ignored, and columns of images keep their names only where no
new one has that name.  decode() raises ValueError for a malformed or truncated
image; media_columns() gives it nulls and says why in `error`.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import kernels as K
from .common import small_batches, staged, table

UNIT, WIDTH, TILE = 576, 24, 24


def encode_pgm(pixels: np.ndarray) -> bytes:
    """8-bit grey (h, w) or RGB (h, w, 3) as binary Netpbm."""
    h, w = pixels.shape[:2]
    return b"P%d\n%d %d\n255\n" % (6 if pixels.ndim == 3 else 5, w, h) + pixels.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """8-bit grey (h, w) or RGB (h, w, 3) as an uncompressed bottom-up BMP."""
    h, w = pixels.shape[:2]
    depth = 24 if pixels.ndim == 3 else 8
    palette = b"" if depth == 24 else b"".join(bytes((i, i, i, 0)) for i in range(256))
    row = (w * depth // 8 + 3) // 4 * 4
    body = np.zeros((h, row), np.uint8)
    flat = pixels[::-1, :, ::-1].reshape(h, -1) if depth == 24 else pixels[::-1]
    body[:, : flat.shape[1]] = flat
    at = 54 + len(palette)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", at + body.size, 0, 0, at, 40, w, h, 1, depth, 0, body.size, 2835, 2835, len(palette) // 4, 0) + palette + body.tobytes()


def _decode_netpbm(data: bytes) -> np.ndarray:
    kind = data[1] - 48
    fields, at = [], 2
    token = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)")
    while len(fields) < (2 if kind in (1, 4) else 3):
        m = token.match(data, at)
        if not m:
            raise ValueError("malformed Netpbm header")
        fields.append(int(m[1]))
        at = m.end()
    w, h, most = (*fields, 1)[:3]
    if not (0 < w < 1 << 31 and 0 < h < 1 << 31 and 0 < most < 1 << 16):
        raise ValueError(f"Netpbm of {w} x {h}, values up to {most}")
    planes = 3 if kind in (3, 6) else 1
    if kind == 4:
        raw = np.frombuffer(data, np.uint8, offset=at + 1, count=(w + 7) // 8 * h).reshape(h, -1)
        out = 1 - np.unpackbits(raw, axis=1)[:, :w]
    elif kind == 1:
        out = 1 - np.array([c - 48 for c in re.sub(rb"#[^\n]*|\s", b"", data[at:])[: w * h]], np.uint8).reshape(h, w)
    elif kind in (2, 3):
        out = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[: w * h * planes], np.int64)
    else:
        out = np.frombuffer(data, ">u2" if most > 255 else np.uint8, offset=at + 1, count=w * h * planes)
    out = out.reshape((h, w, 3) if planes == 3 else (h, w))
    return out.astype(np.uint8) if most == 255 else (out.astype(np.int64) * 255 // most).astype(np.uint8)


def _decode_bmp(data: bytes) -> np.ndarray:
    at, head, w, h, _, depth, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if packing or depth not in (1, 4, 8, 24, 32):
        raise ValueError(f"BMP depth {depth}, compression {packing}")
    row = (w * depth + 31) // 32 * 4
    body = np.frombuffer(data, np.uint8, offset=at, count=row * abs(h)).reshape(abs(h), row)
    if h > 0:
        body = body[::-1]
    if depth >= 24:
        return np.ascontiguousarray(body[:, : w * depth // 8].reshape(abs(h), w, depth // 8)[:, :, 2::-1])
    if depth < 8:
        bits = np.unpackbits(body, axis=1).reshape(abs(h), -1, depth)
        body = np.packbits(np.pad(bits, ((0, 0), (0, 0), (8 - depth, 0))), axis=2)[:, :, 0]
    used = struct.unpack_from("<I", data, 46)[0] or 1 << depth
    palette = np.frombuffer(data, np.uint8, offset=14 + head, count=used * 4).reshape(-1, 4)[:, 2::-1]
    out = palette[body[:, :w]]
    return np.ascontiguousarray(out[:, :, 0]) if (palette == palette[:, :1]).all() else out


def decode(data: bytes) -> np.ndarray:
    """uint8 (h, w) or (h, w, 3) of a Netpbm (P1-P6) or BMP image."""
    try:
        if data[:2] == b"BM":
            return _decode_bmp(data)
        if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
            return _decode_netpbm(data)
    except (struct.error, IndexError, ValueError, OverflowError, MemoryError, TypeError) as e:
        raise ValueError(f"malformed image: {e}") from e
    raise ValueError("neither Netpbm nor BMP")


def grey(pixels: np.ndarray) -> np.ndarray:
    return pixels if pixels.ndim == 2 else (pixels @ np.array([299, 587, 114])) / 1000


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each output cell's exact (fractional) area, by one integral image."""
    h, w = pixels.shape
    total = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(pixels, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])

    def at(edges: np.ndarray, table_: np.ndarray) -> np.ndarray:
        low = np.minimum(np.floor(edges).astype(int), table_.shape[0] - 2)
        part = (edges - low)[:, None]
        return table_[low] * (1 - part) + table_[low + 1] * part

    cells = np.diff(np.diff(at(np.linspace(0, w, width + 1), at(np.linspace(0, h, height + 1), total).T).T, axis=0), axis=1)
    return cells / ((h / height) * (w / width))


def difference_hash(pixels: np.ndarray, side: int = 8) -> str:
    """Hex of whether each cell of a side x (side + 1) thumbnail is darker than its right neighbour."""
    small = np.round(area_resize(grey(pixels), side, side + 1), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tiles(pixels: np.ndarray, tile: int = TILE) -> bytes:
    """One NPY array (tiles, tile, tile[, 3]) of the image, edges padded with 255."""
    h, w = pixels.shape[:2]
    pad = [(0, -h % tile), (0, -w % tile)] + [(0, 0)] * (pixels.ndim - 2)
    p = np.pad(pixels, pad, constant_values=255)
    p = p.reshape(p.shape[0] // tile, tile, p.shape[1] // tile, tile, *p.shape[2:]).swapaxes(1, 2)
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(p.reshape(-1, tile, tile, *p.shape[4:])), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def untile(data: bytes) -> np.ndarray:
    return np.lib.format.read_array(io.BytesIO(data), allow_pickle=False)


def media_columns(images: DataFrame, column: str = "image") -> DataFrame:
    """Every row of images plus width, height, thumbnail (9x8 area means), difference_hash, tiles (NPY bytes) and error; null stays null."""
    new_columns = T.StructType.fromDDL("width int, height int, thumbnail array<double>, difference_hash string, tiles binary, error string")
    kept = [f for f in images.schema.fields if f.name not in new_columns.names or f.name == column]
    schema = T.StructType([*kept, *(f for f in new_columns.fields if f.name != column)])
    at = [f.name for f in kept].index(column)

    def described(value: pa.Scalar) -> dict:
        data = value.as_py()
        if data is None:
            return {}
        try:
            p = decode(bytes(data))
        except ValueError as e:
            return {"error": str(e)}
        return {"width": p.shape[1], "height": p.shape[0], "thumbnail": area_resize(grey(p), 8, 9).ravel().tolist(), "difference_hash": difference_hash(p), "tiles": npy_tiles(p)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"width": pa.int32(), "height": pa.int32(), "thumbnail": pa.list_(pa.float64()), "difference_hash": pa.string(), "tiles": pa.binary(), "error": pa.string()}
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                found = [described(v) for v in part.column(at)]
                new = [pa.array([f.get(name) for f in found], kind) for name, kind in kinds.items() if name != column]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], schema.names)

    return small_batches(images).select(*(f"`{f.name}`" for f in kept)).mapInArrow(run, schema)


def as_image(payload: bytes) -> bytes:
    """A payload of n * 576 bytes as an image of 24 columns: odd n as PGM, even n as BMP."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return encode_pgm(pixels) if len(payload) // UNIT % 2 else encode_bmp(pixels)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_bytes, image_sha256 and the NPY tiles of each text."""
    for batch in batches:
        for rows in K.slices(batch.column(1)):
            blob, cut, out = rows.data.tobytes(), rows.offsets.tolist(), []
            for a, b in zip(cut, cut[1:], strict=False):
                text = blob[a:b]
                image = as_image(text + b"\xff" * (-len(text) % UNIT if text else UNIT))
                out.append((len(text), hashlib.sha256(image).hexdigest(), npy_tiles(decode(image))))
            ids = batch.column(0).slice(rows.first, len(rows))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c) for c in zip(*out, strict=True))], ["doc_id", "n_bytes", "image_sha256", "tiles"])


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "image_sha256"]
    for batch in batches:
        out = []
        for value in batch.column(3):
            stored = value.as_py()
            tiles = untile(stored)
            payload = tiles.tobytes()
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), difference_hash(tiles.reshape(-1, WIDTH))))
        if out:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c) for c in zip(*out, strict=True)), batch.column(2)], names)


def op9_media_columns(spark, sf_dir: str) -> DataFrame:
    """One row per document: its bytes as an image, decoded, stored as NPY tiles, and described from the tiles as read back."""
    docs = small_batches(table(spark, sf_dir, "documents")).select("doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]
    stored = staged(docs.mapInArrow(_store, f"doc_id {kind}, n_bytes long, image_sha256 string, tiles binary"), "tiles")
    return small_batches(stored).select("doc_id", "n_bytes", "image_sha256", "tiles").mapInArrow(_read_back, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, image_sha256 string")
