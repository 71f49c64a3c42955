import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tamarind.llm import lines as L

SPACES = " \t\n\x0b\x0c\r"


def lower(x):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in x)


def plain(texts, min_docs=10, min_chars=1):
    split = [(t or "").split("\n") for t in texts]
    keys = [[lower(x.strip(SPACES)) for x in lines] for lines in split]
    many = Counter(k for ks in keys for k in set(ks))
    out = []
    for lines, ks in zip(split, keys, strict=True):
        kept = [x for x, k in zip(lines, ks, strict=True) if not (len(k) >= min_chars and many[k] >= min_docs)]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def sample():
    rng = random.Random(2)
    common = ["Cookie banner", " cookie BANNER\t", "É all", "é all", "ab", "", "  ", "\x0bab\x0c", "line %d"]
    texts = ["\n".join(rng.choice([*common, "own %d" % rng.randrange(10**6)]) for _ in range(rng.randrange(1, 8))) for _ in range(150)]
    return [*texts, None, "", "\n\n", "x" * 100_000 + "\nab\n", "same\nsame"] + ["nine"] * 9 + ["ten"] * 10


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("min_chars", [1, 3])
def test_against_plain(spark, monkeypatch, small, min_chars):
    if small:
        monkeypatch.setattr(L, "SHARD_KEYS", 2)
        monkeypatch.setattr(L, "SHARD_PROBES", 7)
    texts = sample()
    rows = [(i, t, 5, "c", "N", 1.5) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, shard string, h0 string, _t0 double").repartition(3)
    got = L.drop_frequent_lines(df, min_chars=min_chars).collect()
    want = plain(texts, min_chars=min_chars)
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in got} == dict(enumerate(want))
    assert all(r["shard"] == "c" and r["h0"] == "N" and r["_t0"] == 1.5 for r in got) and len(got) == len(rows)


def test_empty_table(spark):
    assert L.drop_frequent_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_minimal_perfect_hash():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 63, (5000, 2), dtype=np.uint64)
    hashes[1, 0] = hashes[0, 0]
    counts = np.arange(1, 5001)
    counts[7] = 2**40  # counts stop at what 32 bits hold
    built = L.build_shard(hashes, counts)
    index = L.Shard(*(built[c] for c in ("sizes", "words", "prints", "counts")))
    assert (index.count(hashes) == np.minimum(counts, 2**32 - 1)).all()
    assert len(index.prints) == 5000 == index.before[-1]
    assert not index.count(rng.integers(0, 1 << 63, (50_000, 2), dtype=np.uint64)).any()


def test_every_distinct_key_is_indexed(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(sample())], "doc_id long, text string")
    keys = {lower(x.strip(SPACES)) for t in sample() for x in (t or "").split("\n")} - {""}
    shards, _ = L.build_index(L.line_counts(df, "text", 1))
    assert sum(r["n"] for r in shards.collect()) == len(keys)


def test_query_columns(spark, sf_dir):
    got = L.op7_line_dedup(spark, sf_dir)
    assert got.dtypes == [("doc_id", "bigint"), ("n_lines", "bigint"), ("n_dropped", "bigint"), ("kept_sha256", "string")]
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = plain([r["text"] for r in rows])
    digest = {r["doc_id"]: (n, d, hashlib.sha256(t.encode()).hexdigest()) for r, (n, d, t) in zip(rows, want, strict=True)}
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == digest
