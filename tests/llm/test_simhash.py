import random
import re

import numpy as np
import pytest
import xxhash

from tamarind.llm import simhash as S


def plain_fingerprint(text, words=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, radius):
    ids = list(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def check(spark, rows):
    got = S.near_duplicate_components(spark.createDataFrame(rows, "doc_id long, text string, fp int, id string")).collect()
    prints = {r[0]: plain_fingerprint(r[1]) for r in rows}
    assert {r["id"]: r["fp"] & (2**64 - 1) for r in got} == prints
    assert {r["id"]: r["component_id"] for r in got} == plain_components(prints, 3)
    assert len(got) == len(rows)


def sample():
    rng = random.Random(3)
    vocab = ["w%d" % i for i in range(400)]
    base = [" ".join(rng.choices(vocab, k=rng.randrange(1, 300))) for _ in range(40)]
    for i in range(40):
        w = base[i].split(" ")
        w[rng.randrange(len(w))] = "x%d" % i
        base.append(" ".join(w))
    base += [base[0].upper(), base[1], "", None, " \t\n", "one", "one two", "é É x"]
    return [(i * 7, t, 1, "clash") for i, t in enumerate(base)]


def test_fingerprints_and_components(spark):
    check(spark, sample())


def test_hot_shards_are_cut_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_ROWS", 3)
    check(spark, sample())


def test_levels_that_are_left_out_lose_no_link(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = {x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for x in base for _ in range(6)}
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    both = []
    for levels in (1, 2):
        found = S.connected_components(S.fingerprint_links(df, levels=levels), "a", "b")
        both.append({r["node"]: r["root"] for r in found.collect()})
    assert both[0] == both[1] and len(both[0]) > 40
    assert [S.levels_for(n, 3) for n in (0, 10**7, 10**9, 10**12)] == [1, 1, 2, 3]


def test_empty_table(spark):
    assert S.near_duplicate_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_forest_finds_all_pairs():
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    bits = centre[rng.integers(0, 6, 300)]
    for _ in range(4):
        bits ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    shard = np.sort(rng.integers(0, 5, 300))
    for words in (bits[:, None], np.stack([bits, bits >> np.uint64(3)], axis=1)):
        for radius in (0, 3, 9):
            q, n = S.Forest(shard, words).near(np.arange(300), radius)
            want = {
                (i, j) for i in range(300) for j in range(300)
                if i != j and shard[i] == shard[j] and np.bitwise_count(words[i] ^ words[j]).sum() <= radius
            }
            assert set(zip(q.tolist(), n.tolist())) == want


def test_near_duplicates_by_similarity(spark, monkeypatch):
    rng = random.Random(11)
    rows, i = [], 0
    for g in range(12):
        w = ["v%d_%d" % (g, rng.randrange(500)) for _ in range(400)]
        for _ in range(5):
            x = list(w)
            x[rng.randrange(10, 390)] = "new%d" % i
            rows.append((i, " ".join(x)))
            i += 1
    rows += [(i, " ".join("u%d" % rng.randrange(10**6) for _ in range(80))) for i in range(100, 140)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (4096, 3):
        monkeypatch.setattr(S, "SHARD_ROWS", size)
        got = {r["id"]: r["component_id"] for r in S.near_duplicates(df).collect()}
        assert got == {i: (i // 5 * 5 if i < 60 else i) for i, _ in rows}


def grams(text, words=5):
    w = text.lower().split()
    return {" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}


def similarity(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b)


def test_documents_below_the_similarity_are_no_copies(spark, monkeypatch):
    """Short texts that differ in the last word: near in bits, but below 0.8."""
    rows = []
    for g in range(40):
        w = ["t%d_%d" % (g, k) for k in range(9 + g % 3)]
        rows += [(10 * g + k, " ".join([*w, "end%d" % k])) for k in range(3)]
    assert all(0.7 < similarity(rows[i][1], rows[i + 1][1]) < 0.8 for i in range(0, len(rows), 3))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (4096, 3):
        monkeypatch.setattr(S, "SHARD_ROWS", size)
        assert {r["id"]: r["component_id"] for r in S.near_duplicates(df).collect()} == {i: i for i, _ in rows}


def test_confirmed_links_are_those_of_all_pairs():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.permutation(60)[: rng.integers(48, 61)]], base[:40]])) for _ in range(60)]
    sets += [np.unique(rng.integers(0, 1 << 63, 30, dtype=np.uint64)) for _ in range(5)]
    bits = np.arange(len(sets), dtype=np.uint64)[:, None]
    for at_least in (0.7, 0.85, 0.95):
        label = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if both >= at_least * (len(sets[i]) + len(sets[j]) - both):
                    x, y = label[i], label[j]
                    label = [min(x, y) if v in (x, y) else v for v in label]
        a, b = S.confirmed_links(bits, sets, 64, at_least)
        assert dict(zip(a.tolist(), b.tolist())) == {i: v for i, v in enumerate(label) if i != v}


@pytest.mark.parametrize("size", [4096, 3])
def test_pairs_about_the_similarity(spark, monkeypatch, size):
    """Pairs at 0.80 to 0.85 are all found, pairs at 0.70 to 0.79 are none; alike where every shard is hot."""
    monkeypatch.setattr(S, "SHARD_ROWS", size)
    rows, want = [], {}
    shapes = [(80, 10), (82, 9), (34, 3), (160, 20), (8, 1), (78, 11), (70, 15), (79, 11), (37, 5), (150, 20)]
    for g in range(300):
        shared, own = shapes[g % len(shapes)]
        base = ["p%d_%d" % (g, k) for k in range(shared + 4)]
        pair = [" ".join([*base, *("q%d_%d_%d" % (g, side, k) for k in range(own))]) for side in (0, 1)]
        alike = similarity(*pair)
        assert 0.8 <= alike <= 0.85 if g % 10 < 5 else 0.7 <= alike < 0.8
        rows += [(2 * g, pair[0]), (2 * g + 1, pair[1])]
        want |= {2 * g: 2 * g, 2 * g + 1: 2 * g + (alike < 0.8)}
    rows += [(1000 + k, " ".join("s%d" % i for i in range(8 + k))) for k in range(2)]  # four shingles and five
    want |= {1000: 1000, 1001: 1000}
    got = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["id"]: r["component_id"] for r in got} == want
