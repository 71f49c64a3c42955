"""SimHash near-duplicates: BK-trees over fingerprints, one tree for each shard.

A shard holds fingerprints that may be near each other; its BK-tree keys children by
their integer Hamming distance to the parent, and a search follows only edges within the
radius of the distance found. Trees are not sent to every task: all fingerprints together
grow with the corpus, so each tree is built where its shard's rows are, and a shard's
members are its queries.

Shards lose no link. For a fingerprint of 64 bits at radius 3 the bits form four blocks,
and two fingerprints within the radius agree in a whole block: (block, value) is a shard.
A shard with more than ``SHARD_ROWS`` members is cut again by the bits left, in four
blocks, and so on, which ends by itself as members differ. Where there are so many
fingerprints that all shards of a level would be hot, that level is left out.

For similarity of shingle sets (``near_duplicates``) shards are the least shingle hashes
under eight permutations: sets of similarity 0.8 share one with a chance above
1 - 0.2**8. A shard that stays too large is compared in blocks of bounded size. There the
trees only name candidates: a link is a pair whose sets, compared whole, are similar enough.

Nulls: a null text is an empty one; a null id takes part and is never a component's id.
Empty texts and texts without words have fingerprint zero and are linked like any others.
Repeated rows are rows of their own. An empty table gives an empty result. Other columns,
whatever their names, are neither read nor returned.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarind.llm.common import free_name, map_batches, small_batches, utf8, whole_groups, with_maybe
from tamarind.operators.graph import connected_components
from tamarind.session import stage

#: Members of a shard beyond which it is cut again.
SHARD_ROWS = 4096
#: Node visits that a search holds in memory at once.
VISITS = 2_000_000
SEED = 42
#: Permutations that deal shingle sets to shards, and how often a hot shard is dealt anew.
ANCHORS, LEVELS = 8, 3
#: Bits beyond the expected distance within which a pair of sets is a candidate.
SLACK = 41


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 of the shingles of ``words`` words, repeats included; one for a shorter text, none for no words."""
    found = (text or b"").lower().split()  # bytes: A-Z only, and exactly the six ASCII spaces
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    width = min(words, len(found))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(found) - width + 1].tolist()
    hashed = xxhash.xxh64_intdigest
    spans = zip(starts, ends[width - 1 :].tolist(), strict=True)
    return np.fromiter((hashed(joined[a:b], SEED) for a, b in spans), np.uint64, len(starts))


def majority_bits(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = np.ascontiguousarray(hashes[i : i + (1 << 15)], dtype="<u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(id, fp)``: the 64-bit fingerprint of each whole text, as a long."""
    small_batches(docs.sparkSession)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([majority_bits(shingle_hashes(t, words)) for t in utf8(batch.column(1))], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, one, "id long, fp long")


# --- BK-trees ---------------------------------------------------------------------------


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class Forest:
    """The BK-trees of many shards, built together level by level.

    ``shard`` numbers each row's shard from 0; the first row of a shard is its root. The
    first row that reaches an empty edge becomes the node there, as when rows are put in
    one after another. ``bits`` is an (n, words) array of distinct rows within a shard.
    """

    def __init__(self, shard: np.ndarray, bits: np.ndarray):
        self.bits, n, self.span = bits, len(bits), 64 * bits.shape[1] + 1
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        root = np.full(int(shard.max()) + 1 if n else 0, -1, np.int64)
        slots, first = np.unique(shard, return_index=True)
        root[slots] = first
        going = np.setdiff1d(np.arange(n), first)
        at = root[shard[going]]
        while len(going):
            far = distance(bits[going], bits[at])
            same = far == 0  # equal rows need no node: they hang on their twin's
            parent[going[same]], edge[going[same]] = at[same], 0
            going, at, far = going[~same], at[~same], far[~same]
            _, first, slot = np.unique(at * self.span + far, return_index=True, return_inverse=True)
            parent[going[first]], edge[going[first]] = at[first], far[first]
            node = going[first][slot]
            left = np.ones(len(going), bool)
            left[first] = False
            going, at = going[left], node[left]
        self.root = root[shard] if n else root
        child = np.flatnonzero(parent >= 0)
        key = parent[child] * self.span + edge[child]
        order = np.argsort(key, kind="stable")
        self.key, self.child = key[order], child[order]

    def near(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query row, row) within the radius, in the query's own shard."""
        found_q, found_n = [], []
        todo = [(queries, self.root[queries])]
        while todo:
            q, node = todo.pop()
            far = distance(self.bits[q], self.bits[node])
            hit = (far <= radius) & (q != node)
            found_q.append(q[hit])
            found_n.append(node[hit])
            low = np.searchsorted(self.key, node * self.span + np.maximum(far - radius, 0), "left")
            high = np.searchsorted(self.key, node * self.span + np.minimum(far + radius, self.span - 1), "right")
            many = high - low
            ends = np.cumsum(many)
            cut = 0
            while cut < len(q):  # in parts, so that what is held stays bounded
                upto = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + VISITS, "right")))
                m = many[cut:upto]
                if total := int(m.sum()):
                    step = np.arange(total) - np.repeat(np.cumsum(m) - m, m)
                    todo.append((np.repeat(q[cut:upto], m), self.child[np.repeat(low[cut:upto], m) + step]))
                cut = upto
        return np.concatenate(found_q), np.concatenate(found_n)


def joined_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union the classes of a[i] and b[i]: every row's label becomes its class's least row."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart]))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def near_parts(forest: Forest, shard: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of ``forest.near``, for as many query rows at a time as ``VISITS`` allows."""
    ends = np.cumsum(np.bincount(shard)[shard])
    start = 0
    while start < len(shard):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + VISITS, "right")))
        yield forest.near(np.arange(start, stop), radius)
        start = stop


def star_links(
    shard: np.ndarray, bits: np.ndarray, radius: int, size: np.ndarray | None = None, similarity: float = 0.0
) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, least row of its class in the shard): one for each row, not one for each pair.

    With ``size``, pairs of sets too unlike in size for ``similarity`` are no links.
    """
    label = np.arange(len(bits))
    for a, b in near_parts(Forest(shard, bits), shard, radius):
        if size is not None:
            fits = np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b])
            a, b = a[fits], b[fits]
        label = joined_labels(label, a, b)
    row = np.flatnonzero(label != np.arange(len(bits)))
    return row, label[row]


def shard_links(rows: DataFrame, radius: int, bits: list[str]) -> DataFrame:
    """``(a, b)`` links of ``id`` among the rows ``(shard, id, *bits)`` of each shard."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "shard"):
            _, shard = np.unique(group.column("shard").to_numpy(), return_inverse=True)
            words = np.stack([group.column(c).to_numpy() for c in bits], axis=1).view(np.uint64)
            ids = group.column("id").to_numpy()
            a, b = star_links(shard, words, radius)
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    return (
        rows.select("shard", "id", *bits)
        .repartition("shard")
        .sortWithinPartitions("shard", "id")
        .mapInArrow(run, "a long, b long")
    )


def hot_shards(rows: DataFrame) -> DataFrame:
    return stage(
        rows.groupBy("shard").agg(F.count("*").alias("members")).filter(F.col("members") > SHARD_ROWS), "hot-shards"
    )


# --- fingerprints at a small radius -----------------------------------------------------


def blocks_of(mask: int, parts: int) -> list[int]:
    """The set bits of ``mask`` in ``parts`` blocks of nearly equal size, as masks."""
    bits = [i for i in range(64) if mask >> i & 1]
    size, more = divmod(len(bits), parts)
    out, at = [], 0
    for k in range(parts):
        upto = at + size + (k < more)
        out.append(sum(1 << i for i in bits[at:upto]))
        at = upto
    return [m for m in out if m]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def levels_for(fingerprints: int, radius: int) -> int:
    """How often bits are cut before members are counted: until evenly filled shards hold a quarter of ``SHARD_ROWS``."""
    levels, bits = 1, 64 // (radius + 1)
    while fingerprints >> bits > SHARD_ROWS // 4 and bits < 64:
        levels, bits = levels + 1, bits + max(1, (64 - bits) // (radius + 1))
    return levels


def fingerprint_links(distinct: DataFrame, radius: int = 3, levels: int | None = None) -> DataFrame:
    """``(a, b)``: links that join distinct fingerprints ``fp`` at ``radius`` bits or fewer.

    Transitively they join just what all pairs within the radius would.
    """
    full = (1 << 64) - 1

    def dealt(rows: DataFrame, done: int) -> list[tuple[int, DataFrame]]:
        left = full & ~done
        return [
            (done | m, rows.select("fp", F.xxhash64(F.lit(signed(done | m)), F.col("fp").bitwiseAND(F.lit(signed(done | m)))).alias("shard")))
            for m in blocks_of(left, radius + 1)
        ]

    def together(parts: list[tuple[int, DataFrame]]) -> DataFrame:
        out = None
        for m, rows in parts:
            x = rows.withColumn("mask", F.lit(signed(m)))
            out = x if out is None else out.union(x)
        return out

    parts = dealt(distinct.select("fp"), 0)
    for _ in range((levels or levels_for(distinct.count(), radius)) - 1):
        parts = [p for m, rows in parts for p in dealt(rows, m)]
    links, now = None, together(parts)
    while True:
        hot = hot_shards(now)
        none = hot.isEmpty()
        cold = now if none else now.join(hot, "shard", "left_anti")
        found = stage(shard_links(cold.withColumn("id", F.col("fp")), radius, ["fp"]), "fp-links")
        links = found if links is None else links.union(found)
        if none:
            return links
        still = stage(now.join(hot.select("shard"), "shard").select("fp", "mask"), "hot-rows")
        masks = [r["mask"] & full for r in still.select("mask").distinct().collect()]  # at most four to the level's power
        now = together([p for m in masks for p in dealt(still.filter(F.col("mask") == signed(m)), m)])


def near_duplicate_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3
) -> DataFrame:
    """``(id, fp, component_id)`` for every row; component_id is the least id reachable over links."""
    prints = stage(fingerprints(docs, id_col, text_col, words), "fingerprints")
    classes = stage(prints.groupBy("fp").agg(F.min("id").alias("least")), "fp-classes")
    links = fingerprint_links(classes, radius)
    return prints.join(_least_of(classes, links), "fp").select("id", "fp", "component_id")


def _least_of(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``(fp, component_id)``: classes joined over links, each with the least id of its component."""
    roots = connected_components(links, "a", "b").select(F.col("node").alias("fp"), "root")
    rooted = stage(classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "fp-roots")
    least = stage(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "fp-least")
    return rooted.join(least, "root").select("fp", "component_id")


# --- shingle sets at a similarity -------------------------------------------------------


def set_sketch(distinct: np.ndarray, salts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """256 majority bits of the distinct shingles, and their least value under each salt's permutation."""
    if not len(distinct):
        return np.zeros(4, np.uint64), np.zeros(len(salts), np.uint64)
    bits, least = [], np.empty(len(salts), np.uint64)
    for k, salt in enumerate(salts):
        mixed = distinct * salt
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        least[k] = mixed.min()
        if k < 4:
            bits.append(majority_bits(mixed))
    return np.array(bits, np.uint64), least


def radius_for(similarity: float, bits: int = 256) -> int:
    """Differing bits expected of two sets of one size with this share of common shingles."""
    cosine = 2 * similarity / (1 + similarity)
    return int(np.arccos(cosine) / np.pi * bits + 0.5)


class Sets:
    """Sets of shingle hashes, one after another, each counted against many others at once."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.fromiter(map(len, sets), np.int64, len(sets))
        self.ends = np.cumsum(self.size)
        names, flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.flat, self.marked = flat.astype(np.int32), np.zeros(len(names), bool)

    def alike(self, row: int, others: np.ndarray, similarity: float) -> np.ndarray:
        """Which of ``others`` have a Jaccard similarity of at least this with ``row``."""
        own = self.flat[self.ends[row] - self.size[row] : self.ends[row]]
        self.marked[own] = True
        common = np.fromiter(
            (np.count_nonzero(self.marked[self.flat[self.ends[o] - self.size[o] : self.ends[o]]]) for o in others),
            np.int64, len(others),
        )
        self.marked[own] = False
        return common >= similarity * (self.size[row] + self.size[others] - common)


def confirmed_links(bits: np.ndarray, sets: list[np.ndarray], radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, least row of its class) over the pairs within the radius whose sets are alike.

    A pair is counted unless earlier ones have joined its ends already: a class of like
    sets takes about one count for each row.
    """
    held, label = Sets(sets), np.arange(len(bits))
    one = np.zeros(len(bits), np.int64)
    for q, n in near_parts(Forest(one, bits), one, radius):
        fits = (n < q) & (np.minimum(held.size[q], held.size[n]) >= similarity * np.maximum(held.size[q], held.size[n]))
        q, n = q[fits], n[fits]
        order = np.lexsort((n, q))
        q, n = q[order], n[order]
        rows, starts = np.unique(q, return_index=True)
        for row, others in zip(rows.tolist(), np.split(n, starts[1:]), strict=True):
            while len(others := others[label[others] != label[row]]):
                _, first = np.unique(label[others], return_index=True)  # one of each class at a time
                tried = others[first]
                like = label[tried[held.alike(row, tried, similarity)]]
                if len(like):
                    joined = np.append(like, label[row])
                    label[np.isin(label, joined)] = joined.min()
                others = np.delete(others, first)
    row = np.flatnonzero(label != np.arange(len(bits)))
    return row, label[row]


def shard_clusters(rows: DataFrame, radius: int, bits: list[str], similarity: float) -> DataFrame:
    """``(cluster, id)``: the rows ``(shard, id, size, *bits)`` that candidate links join within a shard.

    A cluster is named by its members, so that shards with the same one name it alike.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "shard"):
            _, shard = np.unique(group.column("shard").to_numpy(), return_inverse=True)
            words = np.stack([group.column(c).to_numpy() for c in bits], axis=1).view(np.uint64)
            ids = group.column("id").to_numpy()
            row, least = star_links(shard, words, radius, group.column("size").to_numpy(), similarity)
            heads = np.unique(least)
            member, of = np.concatenate([heads, row]), np.concatenate([heads, least])
            order = np.lexsort((member, of))
            member = ids[member[order]]
            counts = np.unique(of, return_counts=True)[1]
            names = [xxhash.xxh64_intdigest(m.tobytes(), SEED) for m in np.split(member, np.cumsum(counts)[:-1])] if len(of) else []
            cluster = np.repeat(np.array(names, np.uint64).view(np.int64), counts)
            yield pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(member)], ["cluster", "id"])

    return (
        rows.select("shard", "id", "size", *bits)
        .repartition("shard")
        .sortWithinPartitions("shard", "id")
        .mapInArrow(run, "cluster long, id long")
    )


def cluster_links(rows: DataFrame, radius: int, bits: list[str], words: int, similarity: float) -> DataFrame:
    """``(a, b)`` links of ``id`` among the rows ``(cluster, id, packed, *bits)`` of each cluster, by whole sets.

    Compressed texts are sent, a fraction of their shingles' hashes, and hashed where their cluster is.
    """

    def of(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        group = pa.Table.from_batches(batches)
        ids = group.column("id").to_numpy()
        prints = np.stack([group.column(c).to_numpy() for c in bits], axis=1).view(np.uint64)
        sets = [np.unique(shingle_hashes(zlib.decompress(t.as_py()), words)) for t in group.column("packed")]
        a, b = confirmed_links(prints, sets, radius, similarity)
        return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            keys = batch.column("cluster").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for at, stop in zip(cuts, cuts[1:], strict=False):
                if at == stop:
                    continue
                if held and keys[at] != last:
                    yield of(held)
                    held = []
                held.append(batch.slice(at, stop - at))
                last = keys[at]
        if held:
            yield of(held)

    return (
        rows.select("cluster", "id", "packed", *bits)
        .repartition("cluster")
        .sortWithinPartitions("cluster", "id")
        .mapInArrow(run, "a long, b long")
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8
) -> DataFrame:
    """``(id, component_id)``: documents whose sets of word shingles are alike, joined transitively."""
    sketch, classes, links = _near_classes(docs, id_col, text_col, words, similarity)
    return sketch.select("doc", "fp").join(_least_of(classes.select("fp", F.col("first.doc").alias("least")), links), "fp").select(
        F.col("doc").alias("id"), "component_id"
    )


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8
) -> DataFrame:
    """``docs`` with one row of each component of ``near_duplicates``: of the least id, null last.

    A row is known by its id and a hash of its text. Of rows that are equal in both, one stays;
    they come from a partial aggregate, so that no group of them is gathered.
    """
    sketch, classes, links = _near_classes(docs, id_col, text_col, words, similarity)
    roots = connected_components(links, "a", "b").select(F.col("node").alias("fp"), "root")
    rooted = classes.select("fp", "first").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    chosen = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc").alias("c_doc"), F.col("first.key").alias("c_key"))
    rows = sketch.groupBy("doc", "key").agg(F.count("*").alias("n"))
    held = rows.join(chosen, rows["doc"].eqNullSafe(F.col("c_doc")) & (rows["key"] == F.col("c_key")), "left")
    marks = stage(held.select("doc", "key", F.col("c_key").isNotNull().alias("kept"), "n").filter("not kept or n > 1"), "set-marks")
    doc, key, maybe = free_name(docs, "_doc"), free_name(docs, "_key"), free_name(docs, "_maybe")
    keyed = docs.withColumns({doc: F.col(id_col).cast("long"), key: _text_key(text_col)})
    keyed = with_maybe(keyed, [doc, key], marks, ["doc", "key"], maybe)
    marked = keyed.filter(maybe)  # only these are shuffled with their texts

    def named(some: DataFrame, how: str) -> DataFrame:
        return marked.join(some, marked[key].eqNullSafe(some["key"]) & marked[doc].eqNullSafe(some["doc"]), how)

    once = keyed.filter(~F.col(maybe)).unionByName(named(marks.select("doc", "key"), "left_anti")).select(*docs.columns)
    again = marks.filter("kept").select("doc", "key")
    if again.isEmpty():
        return once
    first = named(again, "left_semi").groupBy(doc, key).agg(F.first(F.struct(*docs.columns)).alias("row"))
    return once.unionByName(first.select("row.*"))


def _text_key(text_col: str) -> F.Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def _near_classes(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows ``(doc, key, fp, ..)``, classes of equal sets ``(fp, first, ..)`` and links ``(a, b)`` of classes.

    Only texts that stand for a class of a candidate cluster are read a second time, for their sets.

    Sets are alike at a Jaccard similarity of ``similarity`` or more, counted on the whole
    sets. 256-bit SimHash fingerprints name the candidates. At 0.8 a distance of 39 bits is
    expected, with a standard error of 5.8; the radius of 80 leaves room for seven of them,
    and for five where majority ties push sets furthest apart (four shingles against the
    same and one more: 47 bits, error 6.2). Equal sets are one class and count once. A task
    holds the sets of one candidate cluster, which is at most a shard's.
    """
    small_batches(docs.sparkSession)
    salts = np.random.default_rng(7).integers(1, 1 << 63, ANCHORS * LEVELS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    radius = radius_for(similarity) + SLACK
    names = ["b0", "b1", "b2", "b3"]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(shingle_hashes(t, words)) for t in utf8(batch.column(2))]
        made = [set_sketch(s, salts) for s in sets]
        bits = np.stack([m[0] for m in made]).view(np.int64)
        least = np.stack([m[1] for m in made]).view(np.int64)
        anchors = pa.ListArray.from_arrays(
            pa.array(np.arange(0, least.size + 1, least.shape[1], dtype=np.int32)), pa.array(least.ravel())
        )
        fp = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
        cols = [*batch.columns[:2], pa.array(fp), pa.array([len(s) for s in sets], pa.int64())]
        cols += [*(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(4)), anchors]
        return pa.RecordBatch.from_arrays(cols, ["doc", "key", "fp", "size", *names, "anchors"])

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [zlib.compress(t or b"", 1) for t in utf8(batch.column(2))]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(made, pa.binary())], ["doc", "key", "packed"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), _text_key(text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    schema = "doc long, key long, fp long, size long, b0 long, b1 long, b2 long, b3 long, anchors array<long>"
    sketch = stage(map_batches(rows, one, schema), "set-sketches")
    classes = stage(
        sketch.groupBy("fp").agg(
            F.min(F.struct(F.isnull("doc").alias("none"), "doc", "key")).alias("first"),
            F.first("anchors").alias("anchors"),
            *(F.min(c).alias(c) for c in ["size", *names]),
        ),
        "set-classes",
    )

    def candidates(shards: DataFrame) -> DataFrame:
        return stage(shard_clusters(shards.withColumn("id", F.col("fp")), radius, names, similarity), "set-candidates")

    found, now = None, classes.select("fp", "size", *names, "anchors", F.lit(0).cast("long").alias("within"))
    for level in range(LEVELS):
        dealt = now.select(
            "fp", "size", *names, "anchors", "within", F.posexplode(F.slice("anchors", level * ANCHORS + 1, ANCHORS)).alias("k", "v")
        ).withColumn("shard", F.xxhash64("within", "k", "v"))
        hot = hot_shards(dealt)
        none = hot.isEmpty()
        cold = dealt if none else dealt.join(hot, "shard", "left_anti")
        found = candidates(cold) if found is None else found.union(candidates(cold))
        if none:
            break
        warm = dealt.join(hot, "shard")
        now = stage(warm.select("fp", "size", *names, "anchors", F.col("shard").alias("within"), "members"), "hot-rows")
        if level == LEVELS - 1:  # compared in blocks of two parts each: bounded tasks, every pair in one of them
            parts = F.ceil(F.col("members") * 2 / SHARD_ROWS).cast("int")
            own = F.pmod(F.xxhash64("fp"), parts).cast("int")
            blocks = now.select("fp", "size", *names, "within", own.alias("i"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("j"))
            blocks = blocks.withColumn("shard", F.xxhash64("within", F.least("i", "j"), F.greatest("i", "j")))
            found = found.union(candidates(blocks))
    clusters = stage(found.distinct().withColumnRenamed("id", "fp"), "set-clusters")
    of = classes.select("fp", F.col("first.doc").alias("doc"), F.col("first.key").alias("key"), *names)
    needed = stage(of.join(clusters.select("fp").distinct(), "fp"), "set-needed")
    who = needed.select("fp", F.col("doc").alias("n_doc"), F.col("key").alias("n_key"))
    read = with_maybe(rows, ["doc", "key"], needed, ["doc", "key"], "maybe").filter("maybe").drop("maybe")
    packed = map_batches(read, pack, "doc long, key long, packed binary")
    found_in = packed.join(who, packed["key"].eqNullSafe(who["n_key"]) & packed["doc"].eqNullSafe(who["n_doc"]))
    texts = found_in.groupBy("fp").agg(F.first("packed").alias("packed"))  # rows may repeat
    members = clusters.join(needed.select("fp", *names), "fp").join(texts, "fp").withColumn("id", F.col("fp"))
    links = stage(cluster_links(members, radius, names, words, similarity), "set-links")
    return sketch, classes, links


# --- the query --------------------------------------------------------------------------


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicate_components(docs)
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
