"""The registered queries over the whole test tables: contract columns and values against plain versions."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from tamarind.llm import media, nbest, packing, pfor, queries, sharding, simhash


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_simhash(spark, sf_dir, docs):
    got = simhash.op1_simhash(spark, sf_dir)
    assert got.dtypes == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]

    def plain(text):
        words = text.encode().lower().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        votes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in votes) > len(votes))

    prints = {i: plain(t) for i, t in docs.items()}
    label = {i: i for i in docs}
    near = [(i, j) for i in docs for j in docs if i < j and (prints[i] ^ prints[j]).bit_count() <= 3]
    changed = True
    while changed:
        changed = False
        for i, j in near:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got.collect()} == {i: (f"{prints[i]:016x}", label[i]) for i in docs}


def test_packing(spark, sf_dir, docs):
    got = packing.op2_best_fit_packing(spark, sf_dir)
    assert got.dtypes == [("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*t.encode(x, add_special_tokens=False).ids, 0] for i, x in docs.items()}
    pieces, places = defaultdict(list), defaultdict(list)
    for r in got.collect():
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == ids.keys()
    for i, own in pieces.items():
        at = 0
        for k, (piece, start, length, digest) in enumerate(sorted(own)):
            assert (piece, start) == (k, at) and 0 < length <= 2048 and (k == 0 or length == 2048)
            assert digest == crc(ids[i][at : at + length])
            at += length
        assert at == len(ids[i]) and (len(ids[i]) > 2048 or len(own) == 1)
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= 1.01 * -(-sum(map(len, ids.values())) // 2048) + 1


def test_sharding(spark, sf_dir, docs):
    got = sharding.op3_balanced_sharding(spark, sf_dir)
    assert got.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]
    rows = got.collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in rows} == {i: (len(t.encode()) + 16, zlib.crc32(t.encode()), "rows", None) for i, t in docs.items()}
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) <= set(range(40)) and max(counts.values()) - min(counts.get(s, 0) for s in range(40)) <= 1
    for s, n in counts.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))


def test_media(spark, sf_dir, docs):
    got = media.op4_media_tiles(spark, sf_dir)
    assert [n for n, _ in got.dtypes] == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for r in got.collect():
        raw = docs[r["doc_id"]].encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        picture = np.frombuffer(payload, np.uint8).reshape(-1, 64)
        stored = b"".join(media.to_npy(picture[top : top + 256]) for top in range(0, len(picture), 256))
        assert tuple(r)[1:7] == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
        cells = np.array([[b.mean() for b in np.array_split(a, 9, axis=1)] for a in np.array_split(np.kron(picture, np.ones((8, 9))), 8)])
        assert r["feature"] == np.packbits(np.round(cells, 6)[:, 1:] > np.round(cells, 6)[:, :-1]).tobytes().hex()


def test_pieces(spark, sf_dir, docs):
    got = nbest.op6_nbest_pieces(spark, sf_dir)
    assert got.dtypes[0] == ("doc_id", "bigint")
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows.keys() == docs.keys()
    for i, r in rows.items():
        assert r["round_trip"] and r["decoded_sha256"] == hashlib.sha256(docs[i].encode()).hexdigest()
        assert r["score"] == r["nbest_scores"][0] and r["nbest_scores"] == sorted(r["nbest_scores"], reverse=True) and len(set(r["nbest_crc32"])) == len(r["nbest_scores"])


def test_token_files(spark, sf_dir, docs):
    got = pfor.op8_token_blocks(spark, sf_dir)
    assert got.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    at, want = 0, {}
    for i in sorted(docs):
        ids = [*t.encode(docs[i], add_special_tokens=False).ids, 1]
        want[i] = (at, len(ids), crc(ids))
        at += len(ids)
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == want


def test_registry():
    assert list(queries.QUERIES) == [q for q in queries.QUERIES if q.split("_")[0] in {f"op{n}" for n in range(1, 11)}] and len(queries.QUERIES) == 10
