"""Best-fit packing after Martello-Toth dominance reduction, on counts of lengths.

How documents are packed depends on their lengths alone, and there are at most
``capacity`` different ones. The driver gets the number of pieces of each length, plans
with these counts, and never sees a piece. Pieces find their place by length and rank.

Reduction. For an item j, ``room = capacity - j`` and k the largest item that still fits,
a set with j is fixed for good where it dominates every other set with j, that is, where
what any of those holds can be swapped for it:

1. nothing fits with j: {j};
2. j + k fills the sequence: {j, k};
3. no two items fit with j: {j, k};
4. no three items fit with j, and no two of them fill more than k does: {j, k}.

Each rule stays true while equal items go, so equal items are fixed together. All sizes are
tried, longest first, until a whole pass fixes nothing. What is left is packed best-fit,
longest first.

Nulls: a null text is empty (its one token is the end id); a null id is kept as it is.
Repeated rows are packed each. An empty table gives an empty result. Other columns are
neither read nor returned.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarind.llm import tokens
from tamarind.llm.common import dense_index, map_batches, small_batches
from tamarind.session import stage

CAPACITY = 2048
END_ID = 0


class Plan:
    """Places for items, in runs: ``(size, first rank, items, items a bin, first bin, offset)``."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = dict(counts)
        self.sizes = sorted(s for s, n in counts.items() if n)
        self.rank = dict.fromkeys(counts, 0)
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.bins = 0
        self.fixed = 0

    def place(self, size: int, items: int, a_bin: int, first: int, offset: int) -> None:
        self.runs.append((size, self.rank[size], items, a_bin, first, offset))
        self.rank[size] += items
        self.left[size] -= items
        if not self.left[size]:
            del self.sizes[bisect_left(self.sizes, size)]

    def fix(self, sizes: tuple[int, ...], bins: int) -> None:
        offset = 0
        for s in sizes:
            self.place(s, bins, 1, self.bins, offset)
            offset += s
        self.bins += bins
        self.fixed += bins

    def largest(self, room: int, but: int) -> int:
        """The largest size of at most ``room``, one item of size ``but`` aside; 0 if there is none."""
        at = bisect_left(self.sizes, room + 1) - 1
        if at >= 0 and self.sizes[at] == but and self.left[but] < 2:
            at -= 1
        return self.sizes[at] if at >= 0 else 0

    def smallest(self, but: int, n: int = 3) -> list[int]:
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(n - len(out), self.left[s] - (s == but))
            if len(out) == n:
                break
        return out

    def best_pair(self, room: int, but: int) -> int:
        """The most that two items fill of ``room``, one item of size ``but`` aside."""
        best = 0
        for a in self.sizes:
            have = self.left[a] - (a == but)
            if have < 1 or 2 * a > room:
                continue
            at = bisect_left(self.sizes, room - a + 1) - 1
            while at >= 0:
                b = self.sizes[at]
                if self.left[b] - (b == but) - (b == a) > 0:
                    best = max(best, a + b)
                    break
                at -= 1
        return best

    def pair(self, j: int, k: int) -> None:
        self.fix((j, k), self.left[j] // 2 if j == k else min(self.left[j], self.left[k]))

    def reduce(self) -> None:
        for j in list(self.sizes):  # rule 2, for any j
            k = self.capacity - j
            if k >= j and self.left.get(j, 0) and self.left.get(k, 0) > (j == k):
                self.pair(k, j)
        before = -1
        while before < self.fixed:  # every fix uses up a size, so passes end
            before = self.fixed
            for j in reversed(list(self.sizes)):
                while self.left[j] and self._settle(j):
                    pass

    def _settle(self, j: int) -> bool:
        """Fix sets with items of size ``j`` if a rule allows it."""
        room = self.capacity - j
        k = self.largest(room, j)
        if not k:
            self.fix((j,), self.left[j] if 2 * j > self.capacity else 1)
            return True
        low = [*self.smallest(j), *[self.capacity + 1] * 3]
        if low[0] + low[1] > room or (sum(low[:3]) > room and self.best_pair(room, j) <= k):
            self.pair(j, k)
            return True
        return False

    def best_fit(self) -> None:
        open_bins: dict[int, list[tuple[int, int]]] = {}
        rooms: list[int] = []

        def add(room: int, first: int, bins: int) -> None:
            if room and bins:
                if room not in open_bins:
                    open_bins[room] = []
                    insort(rooms, room)
                open_bins[room].append((first, bins))

        def fill(size: int, room: int, first: int, bins: int) -> None:
            """Put items into bins that all have ``room``; what stays open is added again."""
            each, offset = room // size, self.capacity - room
            if whole := min(bins, self.left[size] // each):
                self.place(size, whole * each, each, first, offset)
                add(room - each * size, first, whole)
            if whole < bins and (n := self.left[size]):
                self.place(size, n, n, first + whole, offset)
                add(room - n * size, first + whole, 1)
                whole += 1
            add(room, first + whole, bins - whole)

        for size in list(reversed(self.sizes)):
            while self.left[size]:
                at = bisect_left(rooms, size)
                if at == len(rooms):
                    new = -(-self.left[size] // (self.capacity // size))
                    self.bins += new
                    fill(size, self.capacity, self.bins - new, new)
                    continue
                room = rooms[at]
                first, bins = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    del rooms[at]
                fill(size, room, first, bins)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    if any(not 1 <= s <= capacity for s in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    made = Plan(counts, capacity)
    made.reduce()
    made.best_fit()
    return made


def pack(pieces: DataFrame, length: str, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to staged ``pieces`` whose ``length`` is 1 to ``capacity``."""
    counts = {r[length]: r["n"] for r in pieces.groupBy(length).agg(F.count("*").alias("n")).collect()}
    made = plan(counts, capacity)
    ranked = dense_index(pieces, [length], order, "_rank", n=sum(counts.values()))
    base = np.zeros(capacity + 2, np.int64)
    for s, n in counts.items():
        base[s + 1] = n
    base = np.cumsum(base)
    runs = np.array(sorted(made.runs), np.int64).reshape(-1, 6)
    first = base[runs[:, 0]] + runs[:, 1] if len(runs) else np.empty(0, np.int64)
    kept = pieces.columns
    names = [*kept, "sequence_id", "offset"]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        size = batch.column(length).to_numpy().astype(np.int64)
        rank = batch.column("_rank").to_numpy()
        run = runs[np.searchsorted(first, base[size] + rank, "right") - 1]
        inside = rank - run[:, 1]
        bins, at = run[:, 4] + inside // run[:, 3], run[:, 5] + inside % run[:, 3] * size
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(bins), pa.array(at)], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return map_batches(ranked, one, f"{kinds}, sequence_id long, offset long")


def token_pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: documents with their end id, long ones cut.

    All pieces of a cut document have ``capacity`` tokens but the first, which may be shorter.
    """
    small_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()
    path, leading = tokens.byte_bpe(path)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        owner, piece, start, length, crc = [], [], [], [], []
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for row, ids in enumerate(tokens.encoder(path, leading).encode(texts)):
            ids += end
            n = len(ids) // 4
            at, stop, k = 0, (n - 1) % capacity + 1, 0
            while at < n:
                owner.append(row)
                piece.append(k)
                start.append(at)
                length.append(stop - at)
                crc.append(zlib.crc32(ids[4 * at : 4 * stop]))
                at, stop, k = stop, stop + capacity, k + 1
        cols = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, one, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    pieces = stage(token_pieces(docs, **options), "pieces")
    order = ["doc_id", "piece", "ids_crc32"]
    return pack(pieces, "length", order, options.get("capacity", CAPACITY))


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequence and offset there."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
