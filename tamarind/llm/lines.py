"""Line dedup: lines found in many documents go, by way of a sharded minimal perfect hash.

1. Every line's key (stripped, A-Z lower-cased) is hashed to 128 bits; a batch of
   documents hands over each key once, with the number of its documents that hold it.
   Spark sums these numbers over the corpus, exactly.
2. All distinct keys are dealt to shards of about ``SHARD_KEYS``. A task gives each shard a
   minimal perfect hash (levels of bit arrays: a key stays at the first level where no
   other key has its bit; its index is the bit's rank) and, by index, compact arrays of
   64-bit fingerprints and of counts.
3. Documents probe the arrays; lines are never joined with lines. A document's key hashes,
   not its text, go to the shards that hold them, and it gets back the hashes whose count is
   ``min_docs`` or more. The counts tell how many probes a shard gets: beyond
   ``SHARD_PROBES`` the shard's arrays are sent to several tasks and the probes are dealt
   among them, so a line that most documents hold is no task of its own. The index may
   outgrow any machine's memory; nothing is broadcast that is not small by Spark's own check.
4. Documents drop the lines whose hashes have come back. Equal texts share them: a document
   is known by two 64-bit hashes of its text.

Nulls: a null text is one empty line, and its result the empty text. A key shorter than
``min_chars`` code points is never dropped. Repeated rows are documents of their own. An
empty table gives an empty result. All columns stay; ``n_lines`` and ``n_dropped`` replace
columns of those names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarind.llm.common import free_name, map_batches, small_batches, utf8, whole_groups
from tamarind.session import stage

SHARD_KEYS = 1 << 15
SHARD_PROBES = 400_000
#: Fixed values of a 64-bit mixing function (splitmix64).
STEP, MIX_A, MIX_B = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def slot_of(hashes: np.ndarray, level: int) -> np.ndarray:
    """A level's own hash of (n, 2) key hashes."""
    return mixed(hashes[:, 0] ^ mixed(hashes[:, 1] + np.uint64(STEP * (level + 1) % 2**64)))


def fingerprint_of(hashes: np.ndarray) -> np.ndarray:
    return mixed(hashes[:, 1] + mixed(hashes[:, 0]))


def build_shard(hashes: np.ndarray, counts: np.ndarray) -> dict:
    """The minimal perfect hash of distinct key hashes with its arrays, as bytes."""
    sizes, words, left, rank = [], [], np.arange(len(hashes)), 0
    order = np.empty(len(hashes), np.int64)
    while len(left):
        if len(sizes) == 200:
            raise ValueError("key hashes are not distinct")
        size = -(-2 * len(left) // 64) * 64
        slot = slot_of(hashes[left], len(sizes)) % np.uint64(size)
        found, first, many = np.unique(slot, return_index=True, return_counts=True)
        alone = many == 1
        bits = np.zeros(size, np.uint8)
        bits[found[alone]] = 1
        order[rank : rank + alone.sum()] = left[first[alone]]  # np.unique sorts: by bit position
        rank += int(alone.sum())
        sizes.append(size)
        words.append(np.packbits(bits, bitorder="little").view("<u8"))
        stay = np.ones(len(left), bool)
        stay[first[alone]] = False
        left = left[stay]
    every = np.concatenate(words) if words else np.empty(0, "<u8")
    return {
        "n": len(hashes),
        "sizes": sizes,
        "words": every.tobytes(),
        "prints": fingerprint_of(hashes[order]).astype("<u8").tobytes(),
        "counts": np.minimum(counts[order], 2**32 - 1).astype("<u4").tobytes(),
    }


class Shard:
    """Probes a shard's arrays."""

    def __init__(self, sizes: list[int], words: bytes, prints: bytes, counts: bytes):
        self.sizes, self.start = sizes, (np.cumsum([0, *sizes]) // 64).tolist()
        self.words, self.prints, self.counts = np.frombuffer(words, "<u8"), np.frombuffer(prints, "<u8"), np.frombuffer(counts, "<u4")
        # one set bit for each key, level after level: a bit's rank is the key's index
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def count(self, hashes: np.ndarray) -> np.ndarray:
        """Documents with each key; 0 for keys that are not in the shard."""
        out, left = np.zeros(len(hashes), np.int64), np.arange(len(hashes))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            slot = (slot_of(hashes[left], level) % np.uint64(size)).astype(np.int64)
            word, bit = self.start[level] + slot // 64, (slot % 64).astype(np.uint64)
            held = self.words[word]
            here = (held >> bit) & np.uint64(1) == 1
            lower = held[here] & ((np.uint64(1) << bit[here]) - np.uint64(1))
            index = self.before[word[here]] + np.bitwise_count(lower)
            same = self.prints[index] == fingerprint_of(hashes[left[here]])
            out[left[here][same]] = self.counts[index[same]]
            left = left[~here]
        return out


def line_hashes(lines: list[bytes], min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, 2) hashes of the lines' keys, and whether each key is long enough to count."""
    keys = [x.strip().lower() for x in lines]  # bytes: just the six ASCII spaces, and A-Z only
    digest = xxhash.xxh3_128_digest
    hashes = np.frombuffer(b"".join([digest(k) for k in keys]), "<u8").reshape(-1, 2)
    if min_chars <= 1:
        return hashes, np.array([len(k) >= min_chars for k in keys], bool)
    return hashes, np.array([len(k) >= min_chars and len(k.decode()) >= min_chars for k in keys], bool)


def own_hashes(text: bytes | None, min_chars: int) -> np.ndarray:
    """(n, 2) hashes of a document's different keys that count."""
    hashes, counts = line_hashes((text or b"").split(b"\n"), min_chars)
    return np.unique(hashes[counts], axis=0) if len(hashes) > 1 else hashes[counts]


def _columns(hashes: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(hashes[:, k]).view(np.int64)) for k in (0, 1)]


def line_counts(docs: DataFrame, text_col: str, min_chars: int) -> DataFrame:
    """``(h0, h1, docs)``: the number of documents that hold each line key."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [own_hashes(text, min_chars) for text in utf8(batch.column(0))]
        found, many = np.unique(np.concatenate(parts), axis=0, return_counts=True)
        return pa.RecordBatch.from_arrays([*_columns(found), pa.array(many.astype(np.int64))], ["h0", "h1", "n"])

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    return map_batches(texts, one, "h0 long, h1 long, n long").groupBy("h0", "h1").agg(F.sum("n").alias("docs"))


def _shard_of(n_shards: int) -> F.Column:
    return F.pmod(F.shiftrightunsigned("h1", 1), F.lit(n_shards)).cast("int")


def build_index(counts: DataFrame) -> tuple[DataFrame, int]:
    """The shards of staged ``(h0, h1, docs)``, staged, and their number."""
    n_shards = max(1, -(-counts.count() // SHARD_KEYS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "shard", SHARD_KEYS):
            shard = group.column("shard").to_numpy()
            hashes = np.stack([group.column(c).to_numpy() for c in ("h0", "h1")], axis=1).view(np.uint64)
            counts = group.column("docs").to_numpy()
            ends = [*np.flatnonzero(np.diff(shard)) + 1, len(shard)]
            for a, b in zip([0, *ends], ends, strict=False):
                yield pa.RecordBatch.from_pylist([{"shard": int(shard[a]), "probes": int(counts[a:b].sum()), **build_shard(hashes[a:b], counts[a:b])}], schema=made)

    made = pa.schema([("shard", pa.int32()), ("n", pa.int64()), ("probes", pa.int64()), ("sizes", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("words", "prints", "counts"))])
    dealt = counts.withColumn("shard", _shard_of(n_shards)).repartition("shard").sortWithinPartitions("shard")
    kinds = "shard int, n long, probes long, sizes array<long>, words binary, prints binary, counts binary"
    return stage(dealt.select("shard", "h0", "h1", "docs").mapInArrow(run, kinds), "line-shards"), n_shards


def frequent_lines(docs: DataFrame, shards: DataFrame, n_shards: int, text_col: str, min_docs: int, min_chars: int) -> DataFrame:
    """``(t0, t1, lines)``: for texts that hold any, the hashes of their lines in ``min_docs`` documents or more."""

    def hashes(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [own_hashes(text, min_chars) for text in utf8(batch.column(2))]
        row = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
        every = np.concatenate(found)
        return pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *_columns(every)], ["t0", "t1", "h0", "h1"])

    def probe(arrays: pa.Table, asked: pa.Table) -> pa.Table:
        hit = np.empty(0, np.int64)
        if arrays.num_rows and asked.num_rows:
            held = arrays.to_pylist()[0]
            keys = np.stack([asked.column(c).to_numpy() for c in ("h0", "h1")], axis=1).view(np.uint64)
            hit = np.flatnonzero(Shard(*(held[c] for c in ("sizes", "words", "prints", "counts"))).count(keys) >= min_docs)
        return asked.select(["t0", "t1", "h0", "h1"]).take(pa.array(hit))

    asked = map_batches(docs.select(*_text_keys(text_col)), hashes, "t0 long, t1 long, h0 long, h1 long")
    parts = stage(shards.select("shard", F.ceil(F.col("probes") / SHARD_PROBES).cast("int").alias("parts")), "line-parts")
    dealt = asked.withColumn("shard", _shard_of(n_shards)).join(parts.filter("parts > 1"), "shard", "left")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("t0", "h0", F.monotonically_increasing_id()), F.coalesce("parts", F.lit(1))).cast("int"))
    sent = shards.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    left = sent.select("shard", "part", "sizes", "words", "prints", "counts").groupBy("shard", "part")
    right = dealt.select("shard", "part", "t0", "t1", "h0", "h1").groupBy("shard", "part")
    marks = left.cogroup(right).applyInArrow(probe, "t0 long, t1 long, h0 long, h1 long")
    return marks.groupBy("t0", "t1").agg(F.collect_set(F.struct("h0", "h1")).alias("lines"))


def _text_keys(text_col: str) -> list[F.Column]:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("t0"), F.xxhash64(F.lit(1), text).alias("t1"), text.alias("text")]


def drop_frequent_lines(docs: DataFrame, text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with the lines of frequent keys taken out of ``text_col``, and ``n_lines``, ``n_dropped``."""
    small_batches(docs.sparkSession)
    shards, n_shards = build_index(stage(line_counts(docs, text_col, min_chars), "line-counts"))
    found = stage(frequent_lines(docs, shards, n_shards, text_col, min_docs, min_chars), "line-marks")
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    t0, t1, lines = (free_name(docs, c) for c in ("_t0", "_t1", "_lines"))
    keys = _text_keys(text_col)
    keyed = docs.select(*kept, keys[0].alias(t0), keys[1].alias(t1)).withColumn(text_col, keys[2])
    marked = keyed.join(found.select(F.col("t0").alias(t0), F.col("t1").alias(t1), F.col("lines").alias(lines)), [t0, t1], "left")
    at = kept.index(text_col)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, n_lines, n_dropped = [], [], []
        for text, marks in zip(utf8(batch.column(at)), batch.column(len(kept)), strict=True):
            split = text.split(b"\n")
            n_lines.append(len(split))
            if marks.is_valid:
                gone = {(h["h0"], h["h1"]) for h in marks.as_py()}
                own = line_hashes(split, 0)[0].view(np.int64).tolist()
                split = [x for x, h in zip(split, own, strict=True) if (h[0], h[1]) not in gone]
            n_dropped.append(n_lines[-1] - len(split))
            texts.append(b"\n".join(split))
        cols = list(batch.columns[: len(kept)])
        cols[at] = pa.array(texts, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*kept, "n_lines", "n_dropped"])

    kinds = T.StructType([T.StructField(f.name, f.dataType, True) for f in keyed.select(*kept).schema])
    return map_batches(marked.select(*kept, lines), one, kinds.add("n_lines", "long").add("n_dropped", "long"))


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = drop_frequent_lines(docs)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_KEY = f"translate(trim(line, {_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP7_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT r, i, parts[i] AS line FROM (SELECT r, parts, unnest(range(1, len(parts) + 1)) AS i FROM docs)),
keyed AS (SELECT r, i, line, {_KEY} AS k FROM lines),
frequent AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10),
kept AS (
  SELECT r, count(*) AS n_lines, count(f.k) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.k IS NULL), '') AS text
  FROM keyed LEFT JOIN frequent f USING (k) GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM kept JOIN docs USING (r)
"""
