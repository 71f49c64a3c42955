"""Token files in patched frame-of-reference blocks.

A file holds whole documents in ascending id order:

    "PFR1"  version bytes
    uint32  documents, uint64 ids, uint32 blocks
    int64   document ids, uint8 whether an id is given, uint64 ids before each document's end
    uint64  block starts, relative to the first block (the index)
    blocks  of 128 ids: uint32 minimum, uint8 width, uint8 exceptions, 2 bytes zero;
            128 offsets of ``width`` bits from the minimum; uint8 places of the exceptions;
            uint32 what exceeds the width there

All numbers are little-endian. ``width`` is what ``PERCENTILE`` of a block's offsets need;
larger ones keep their low bits in place and their high bits in the exception list. The
last block is filled up with its own last id. A block is found by the index alone, so any
id can be read without the ones before it.

A task writes files of about ``FILE_IDS`` ids, with whole documents, into the shared folder,
each under a name of its attempt's own, written beside and then renamed. A Parquet manifest
beside them, committed by Spark's writer, lists the files that count: those of a lost or
repeated attempt are never read. Documents are range-partitioned by id; rows of one id, or
without one, are spread by a hash of the text and a number of their own, so that no id is a
task of its own. Files are numbered in that order.

Nulls: a null text is empty (its one id is the end id); null ids come first. Repeated rows
are kept, side by side in no set order. An empty table gives an empty result. Other columns
are neither read nor returned.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarind.llm import tokens
from tamarind.llm.common import map_batches, small_batches
from tamarind.session import shared_dir

BLOCK = 128
PERCENTILE = 90
FILE_IDS = 1 << 20
END_ID = 1
MAGIC = b"PFR1"


def _bits_needed(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def _packed(offsets: np.ndarray, width: int) -> np.ndarray:
    """(n, 128) offsets of ``width`` bits to (n, 16 * width) bytes."""
    cols = np.ascontiguousarray(offsets.T.astype(np.uint64))
    out = np.zeros((2 * width, len(offsets)), np.uint64)
    for i in range(BLOCK):
        word, bit = divmod(i * width, 64)
        out[word] |= cols[i] << np.uint64(bit)
        if bit + width > 64:
            out[word + 1] |= cols[i] >> np.uint64(64 - bit)
    return np.ascontiguousarray(out.T).astype("<u8").view(np.uint8)


def _unpacked(data: np.ndarray, width: int) -> np.ndarray:
    words = np.ascontiguousarray(np.ascontiguousarray(data).view("<u8").T)
    out = np.empty((BLOCK, data.shape[0]), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(BLOCK):
        word, bit = divmod(i * width, 64)
        x = words[word] >> np.uint64(bit)
        if bit + width > 64:
            x = x | (words[word + 1] << np.uint64(64 - bit))
        out[i] = x & mask
    return out.T


def encode_blocks(ids: np.ndarray, percentile: int = PERCENTILE) -> tuple[np.ndarray, bytes]:
    """Block starts and the blocks of unsigned 32-bit ids."""
    if not len(ids):
        return np.empty(0, np.uint64), b""
    full = np.concatenate([ids, np.full(-len(ids) % BLOCK, ids[-1], np.uint32)]).reshape(-1, BLOCK)
    least = full.min(axis=1)
    offsets = full - least[:, None]
    at = max(0, -(-BLOCK * percentile // 100) - 1)
    width = _bits_needed(np.partition(offsets, at, axis=1)[:, at])
    high = (offsets.astype(np.uint64) >> width[:, None].astype(np.uint64)).astype(np.uint32)
    row, place = np.nonzero(high)
    many = np.bincount(row, minlength=len(full))
    size = 8 + 16 * width + 5 * many
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    head = np.zeros((len(full), 8), np.uint8)
    head[:, :4] = least.astype("<u4").view(np.uint8).reshape(-1, 4)
    head[:, 4], head[:, 5] = width, many
    out[start[:, None] + np.arange(8)] = head
    for w in np.unique(width):
        if w:
            of = np.flatnonzero(width == w)
            low = offsets[of] & np.uint32((1 << int(w)) - 1)
            out[(start[of] + 8)[:, None] + np.arange(16 * w)] = _packed(low, int(w))
    nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    tail = start + 8 + 16 * width
    out[tail[row] + nth] = place
    values = np.ascontiguousarray(high[row, place].astype("<u4")).view(np.uint8).reshape(-1, 4)
    out[(tail[row] + many[row] + 4 * nth)[:, None] + np.arange(4)] = values
    return start.astype(np.uint64), out.tobytes()


def decode_blocks(start: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The ids of whole blocks that begin at ``start`` in the bytes ``data``."""
    start = start.astype(np.int64)
    head = data[start[:, None] + np.arange(8)]
    least = np.ascontiguousarray(head[:, :4]).view("<u4")[:, 0]
    width, many = head[:, 4].astype(np.int64), head[:, 5].astype(np.int64)
    out = np.zeros((len(start), BLOCK), np.uint64)
    for w in np.unique(width):
        if w:
            of = np.flatnonzero(width == w)
            out[of] = _unpacked(data[(start[of] + 8)[:, None] + np.arange(16 * w)], int(w))
    row = np.repeat(np.arange(len(start)), many)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    tail = start + 8 + 16 * width
    place = data[tail[row] + nth]
    values = np.ascontiguousarray(data[(tail[row] + many[row] + 4 * nth)[:, None] + np.arange(4)]).view("<u4")
    high = values.astype(np.uint64)[:, 0] if len(row) else np.empty(0, np.uint64)
    out[row, place] |= high << width[row].astype(np.uint64)
    return (out + least[:, None]).astype(np.uint32)


def to_image(doc_ids: list, ids: list[bytes]) -> bytes:
    """The bytes of a file of documents, given as ids in bytes."""
    ends = np.cumsum([len(x) // 4 for x in ids], dtype=np.uint64)
    every = np.frombuffer(b"".join(ids), "<u4").astype(np.uint32)
    start, blocks = encode_blocks(every)
    known = np.array([x is not None for x in doc_ids], np.uint8)
    numbers = np.array([x or 0 for x in doc_ids], "<i8")
    sizes = np.array([len(doc_ids)], "<u4").tobytes() + np.array([len(every)], "<u8").tobytes() + np.array([len(start)], "<u4").tobytes()
    return b"".join([MAGIC, sizes, numbers.tobytes(), known.tobytes(), ends.astype("<u8").tobytes(), start.astype("<u8").tobytes(), blocks])


class Image:
    """Reads a file's bytes; ``ids`` gives any span of ids from the blocks that hold it."""

    def __init__(self, image: bytes):
        if image[:4] != MAGIC:
            raise ValueError("not a token file")
        docs, self.n_ids, blocks = (int(np.frombuffer(image, t, 1, at)[0]) for t, at in (("<u4", 4), ("<u8", 8), ("<u4", 16)))
        at = 20
        parts = []
        for kind, n in (("<i8", docs), ("u1", docs), ("<u8", docs), ("<u8", blocks)):
            parts.append(np.frombuffer(image, kind, n, at))
            at += parts[-1].nbytes
        numbers, known, self.ends, self.index = parts
        self.doc_ids = [int(x) if k else None for x, k in zip(numbers, known, strict=True)]
        self.blocks = np.frombuffer(image, np.uint8, offset=at)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if start >= stop:
            return np.empty(0, np.uint32)
        first = start // BLOCK
        found = decode_blocks(self.index[first : -(-stop // BLOCK)], self.blocks).ravel()
        return found[start - first * BLOCK : stop - first * BLOCK]


def put_file(folder: str, name: str, data: bytes) -> None:
    """Write a file of the shared folder in one step: whole, or not there."""
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_output_stream(f"{root}/.{name}") as out:
        out.write(data)
    store.move(f"{root}/.{name}", f"{root}/{name}")


def get_file(folder: str, name: str) -> bytes:
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{root}/{name}") as held:
        return held.read()


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, vocabulary: str | None = None) -> None:
    """Write token files to the folder ``path`` (a URI that all executors reach), in ascending id order.

    ``path/manifest`` lists them: ``(part, file_no, n_ids, name)``.
    """
    small_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()
    vocabulary, leading = tokens.word_bpe(vocabulary)
    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        owners, ids, held = [], [], 0

        def file() -> pa.RecordBatch:
            name = f"{part:06}-{number:06}-{uuid.uuid4().hex}.pfr"
            put_file(path, name, to_image(owners, ids))
            cols = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([held], pa.int64()), pa.array([name])]
            return pa.RecordBatch.from_arrays(cols, ["part", "file_no", "n_ids", "name"])

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            encoded = tokens.encoder(vocabulary, leading).encode(texts)
            for owner, x in zip(batch.column(0).to_pylist(), encoded, strict=True):
                owners.append(owner)
                ids.append(x + end)
                held += len(x) // 4 + 1
                if held >= FILE_IDS:
                    yield file()
                    owners, ids, held, number = [], [], 0, number + 1
        if owners:
            yield file()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = ["doc_id", "_hash", "_own"]
    spread = rows.withColumns({"_hash": F.xxhash64("text"), "_own": F.monotonically_increasing_id()})
    ordered = spread.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    ordered.mapInArrow(run, "part int, file_no int, n_ids long, name string").write.parquet(f"{path}/manifest")


def read_tokens(spark, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32, ids)`` from the files at ``path``; ids as an array.

    ``start`` is the number of ids before the document, over all files.
    """
    return _read(spark, path, with_ids=True)


def _read(spark, path: str, with_ids: bool) -> DataFrame:
    small_batches(spark)
    files = spark.read.schema("part int, file_no int, n_ids long, name string").parquet(f"{path}/manifest")
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row for each task that wrote
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier.orderBy("part")), F.lit(0)).alias("part_base"))
    within = F.coalesce(F.sum("n_ids").over(earlier.partitionBy("part").orderBy("file_no")), F.lit(0))
    placed = files.withColumn("within", within).join(parts, "part").select("name", (F.col("within") + F.col("part_base")).alias("base"))
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                image = Image(get_file(path, name))
                every = image.ids(0, image.n_ids).astype("<u4")
                ends = image.ends.astype(np.int64)
                starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
                raw = memoryview(every.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                arrays = [pa.array(c, pa.int64()) for c in (image.doc_ids, starts + base, ends - starts, crc)]
                if with_ids:
                    offsets = pa.array(np.concatenate((starts, ends[-1:])), pa.int32())
                    arrays.append(pa.ListArray.from_arrays(offsets, pa.array(every.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return placed.repartition("name").mapInArrow(run, schema)


def op8_token_blocks(spark, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from its token file."""
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return _read(spark, path, with_ids=False)
