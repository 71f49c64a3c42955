"""Netpbm and BMP images as arrays, area-resized by integral images, kept as NPY tiles.

``decode`` reads P1 to P6 (plain and raw) and uncompressed BMP of 1, 4, 8, 24 or 32 bits
into arrays of shape (rows, columns) or (rows, columns, 3). ``tiles`` cuts an array into
NPY files (format 1.0) of at most ``TILE`` rows and columns, each with its difference
hash; ``untile`` puts them together again, to the byte. An area resize takes the mean of
the source under each target cell, from the corners' values in an integral image; strips
of rows are summed one after another, so that the integral image of a tall picture is
never held whole.

Nulls: a null image or text gives null columns, or for payloads the empty text. An empty
table gives an empty result. Equal contents give equal values; repeated rows are kept.
Broken images raise ValueError in ``decode`` and give a null array in ``media_columns``.
"""

from __future__ import annotations

import ast
import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarind.llm.common import map_batches, small_batches, utf8
from tamarind.session import stage

TILE = 256
STRIP = 256
#: A payload's picture is this wide; payloads are filled up to a multiple of it.
WIDTH = 64
HASH_ROWS, HASH_COLS = 8, 9

# --- Netpbm and BMP ---------------------------------------------------------------------

_TOKEN = re.compile(rb"(?:\s|#[^\r\n]*[\r\n])*([^\s#]+)")


def _pnm(data: bytes) -> np.ndarray:
    kind, at, numbers = data[1] - 48, 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        if not (m := _TOKEN.match(data, at)):
            raise ValueError("netpbm header ends early")
        numbers.append(int(m[1]))
        at = m.end()
    cols, rows = numbers[:2]
    top = numbers[2] if len(numbers) == 3 else 1
    if not 0 < top < 65536 or cols < 1 or rows < 1:
        raise ValueError("netpbm size or maximum out of range")
    depth = 3 if kind in (3, 6) else 1
    n = rows * cols * depth
    if kind == 1:
        flat = np.frombuffer(re.sub(rb"#[^\r\n]*|\s", b"", data[at:]), np.uint8)[:n] - 48
    elif kind in (2, 3):
        flat = np.array(re.sub(rb"#[^\r\n]*", b"", data[at:]).split()[:n], dtype=np.int64)
        if len(flat) and not 0 <= flat.min() <= flat.max() <= top:
            raise ValueError("netpbm sample out of range")
    elif kind == 4:
        wide = -(-cols // 8)
        bits = np.frombuffer(data, np.uint8, rows * wide, at + 1).reshape(rows, wide)
        flat = np.unpackbits(bits, axis=1)[:, :cols].ravel()
    else:
        flat = np.frombuffer(data, np.uint8 if top < 256 else ">u2", n, at + 1)
    if len(flat) != n:
        raise ValueError("netpbm samples end early")
    if kind in (1, 4):
        flat = (1 - flat) * 255  # 1 is black
    out = flat.astype(np.uint8 if top < 256 else np.uint16)
    return out.reshape((rows, cols, 3) if depth == 3 else (rows, cols))


def _bmp(data: bytes) -> np.ndarray:
    start, header, cols, rows, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if header < 40 or packed not in (0,) or bits not in (1, 4, 8, 24, 32) or cols < 1 or not rows:
        raise ValueError("BMP kind not supported")
    down, rows = rows < 0, abs(rows)
    stride = -(-cols * bits // 32) * 4
    if len(data) < start + rows * stride:
        raise ValueError("BMP samples end early")
    lines = np.frombuffer(data, np.uint8, rows * stride, start).reshape(rows, stride)
    if bits >= 24:
        out = lines[:, : cols * bits // 8].reshape(rows, cols, bits // 8)[:, :, 2::-1]
    else:
        places = np.unpackbits(lines, axis=1).reshape(rows, -1, bits) @ (1 << np.arange(bits)[::-1])
        used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
        colours = np.frombuffer(data, np.uint8, 4 * used, 14 + header).reshape(-1, 4)[:, 2::-1]
        out = colours[places[:, :cols]]
        if (colours == colours[:, :1]).all():
            out = out[:, :, 0]
    return np.ascontiguousarray(out if down else out[::-1])


def decode(data: bytes) -> np.ndarray:
    try:
        if re.match(rb"P[1-6]\s", data):
            return _pnm(data)
        if data[:2] == b"BM":
            return _bmp(data)
    except (struct.error, IndexError, OverflowError) as broken:
        raise ValueError("image is broken") from broken
    raise ValueError("neither Netpbm nor BMP")


def encode_pgm(samples: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


# --- resize and hash --------------------------------------------------------------------


def _corners(strip: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """The integral of a strip from its corner to fractional (y, x): bilinear in the integral image."""
    table = np.zeros((strip.shape[0] + 1, strip.shape[1] + 1))
    table[1:, 1:] = strip.cumsum(0, dtype=np.float64).cumsum(1)
    y, x = np.minimum(ys.astype(int), strip.shape[0] - 1), np.minimum(xs.astype(int), strip.shape[1] - 1)
    fy, fx = (ys - y)[:, None], (xs - x)[None, :]
    a, b = table[y][:, x], table[y][:, x + 1]
    c, d = table[y + 1][:, x], table[y + 1][:, x + 1]
    return (a * (1 - fx) + b * fx) * (1 - fy) + (c * (1 - fx) + d * fx) * fy


def area_resize(image: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Means of a (rows, columns) image over a grid of equal cells, as doubles."""
    ys, xs = np.arange(rows + 1) * (image.shape[0] / rows), np.arange(cols + 1) * (image.shape[1] / cols)
    total = np.zeros((rows + 1, cols + 1))
    for top in range(0, image.shape[0], STRIP):
        strip = image[top : top + STRIP]
        total += _corners(strip, np.clip(ys - top, 0, strip.shape[0]), xs)
    sums = np.diff(np.diff(total, axis=0), axis=1)
    return sums * (rows * cols / (image.shape[0] * image.shape[1]))


def difference_hash(image: np.ndarray) -> str:
    """64 bits, as 16 hex digits: whether each cell of an 8 by 9 resize is darker than the next."""
    grey = image if image.ndim == 2 else image.mean(axis=2)
    cells = np.round(area_resize(grey, HASH_ROWS, HASH_COLS), 6)
    return np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()


# --- NPY tiles --------------------------------------------------------------------------


def to_npy(array: np.ndarray) -> bytes:
    shape = "(%s,)" % array.shape[0] if array.ndim == 1 else "(%s)" % ", ".join(map(str, array.shape))
    kind = array.dtype.newbyteorder("<").str
    head = "{'descr': '%s', 'fortran_order': False, 'shape': %s, }" % (kind, shape)
    head += " " * (-(len(head) + 11) % 64) + "\n"
    return b"\x93NUMPY\x01\x00" + struct.pack("<H", len(head)) + head.encode() + array.astype(kind, order="C").tobytes()


def from_npy(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """The array whose NPY file begins at ``at``, and where that file ends."""
    if data[at : at + 8] != b"\x93NUMPY\x01\x00":
        raise ValueError("not an NPY file")
    start = at + 10 + struct.unpack_from("<H", data, at + 8)[0]
    head = ast.literal_eval(data[at + 10 : start].decode())
    kind, n = np.dtype(head["descr"]), int(np.prod(head["shape"]))
    array = np.frombuffer(data, kind, n, start).reshape(head["shape"])
    return array, start + array.nbytes


def tiles(image: np.ndarray, size: int = TILE) -> list[dict]:
    """``{"row", "col", "npy", "hash"}`` of each tile, row by row."""
    out = []
    for top in range(0, image.shape[0], size):
        for left in range(0, image.shape[1], size):
            part = image[top : top + size, left : left + size]
            out.append({"row": top, "col": left, "npy": to_npy(part), "hash": difference_hash(part)})
    return out


def untile(made: list[dict]) -> np.ndarray:
    parts = [(t["row"], t["col"], from_npy(t["npy"])[0]) for t in made]
    rows, cols = (max(p[k] + p[2].shape[k] for p in parts) for k in (0, 1))
    out = np.zeros((rows, cols, *parts[0][2].shape[2:]), parts[0][2].dtype)
    for top, left, part in parts:
        out[top : top + part.shape[0], left : left + part.shape[1]] = part
    return out


TILES_TYPE = "array<struct<row:int,col:int,npy:binary,hash:string>>"


def media_columns(images: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """``(id, rows, cols, hash, tiles)`` of encoded images; nulls where they can't be decoded."""
    small_batches(images.sparkSession, 64)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for data in batch.column(1).to_pylist():
            try:
                image = decode(data or b"")
            except ValueError:
                rows.append({})
                continue
            rows.append({"rows": image.shape[0], "cols": image.shape[1], "hash": difference_hash(image), "tiles": tiles(image)})
        names = ("rows", "cols", "hash", "tiles")
        cols = [pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *cols], ["id", *names])

    tile = pa.struct([("row", pa.int32()), ("col", pa.int32()), ("npy", pa.binary()), ("hash", pa.string())])
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.list_(tile))
    source = images.select(F.col(id_col).alias("id"), F.col(data_col).cast("binary").alias("data"))
    id_type = source.schema["id"].dataType.simpleString()
    return map_batches(source, one, f"id {id_type}, rows int, cols int, hash string, tiles {TILES_TYPE}")


# --- the query --------------------------------------------------------------------------


def payload_picture(text: bytes) -> np.ndarray:
    """A payload as a picture of 8-bit samples, ``WIDTH`` wide, by way of PGM."""
    payload = text + bytes(-len(text) % WIDTH if text else WIDTH)
    return decode(encode_pgm(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)))


def store_payloads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, tiles)``: each whole text's picture in NPY tiles, written to the shared folder and read from there."""
    small_batches(docs.sparkSession)
    tile = pa.struct([("row", pa.int32()), ("col", pa.int32()), ("npy", pa.binary()), ("hash", pa.string())])

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or b"" for t in utf8(batch.column(1))]
        made = pa.array([tiles(payload_picture(t)) for t in texts], pa.list_(tile))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), made], ["doc_id", "n_bytes", "tiles"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stage(map_batches(rows, one, f"doc_id long, n_bytes long, tiles {TILES_TYPE}"), "media-tiles")


def payload_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each whole text stored as a picture's NPY tiles and read back; see ``op4_media_tiles``."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for made in batch.column(2).to_pylist():
            image, stored = untile(made), b"".join([t["npy"] for t in made])
            back = image.tobytes()
            sha = [hashlib.sha256(x).hexdigest() for x in (back, stored)]
            rows.append((len(back), sha[0], zlib.crc32(back[-64:]), len(stored), sha[1], difference_hash(image)))
        cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], *cols], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    schema = T.StructType([T.StructField(n, T.LongType()) for n in names[:2]] + [T.StructField(n, T.StringType() if pa.types.is_string(k) else T.LongType()) for n, k in zip(names[2:], kinds, strict=True)])
    return map_batches(store_payloads(docs, id_col, text_col), one, schema)


def op4_media_tiles(spark, sf_dir: str) -> DataFrame:
    """Every document's payload as NPY tiles, read back, with digests and its difference hash."""
    return payload_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
