import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tamarind.llm import pfor


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 2**32 - 1), st.integers(0, 300)), max_size=700), st.integers(1, 100))
def test_blocks_round_trip(ids, percentile):
    ids = np.array(ids, np.uint32)
    start, data = pfor.encode_blocks(ids, percentile)
    back = pfor.decode_blocks(start, np.frombuffer(data, np.uint8)).ravel()[: len(ids)]
    assert (back == ids).all()


def test_spans_read_by_the_index():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50_000, 5000).astype(np.uint32)
    ids[::97] = 2**32 - 1
    image = pfor.Image(pfor.to_image([5, None, -3], [ids[:10].tobytes(), b"", ids[10:].tobytes()]))
    assert image.doc_ids == [5, None, -3]
    assert image.ends.tolist() == [10, 10, 5000]
    for a, b in [(0, 5000), (127, 129), (128, 256), (4990, 5000), (7, 7)]:
        assert (image.ids(a, b) == ids[a:b]).all()


@pytest.mark.parametrize("file_ids", [pfor.FILE_IDS, 50])
def test_documents_round_trip(spark, tmp_path, monkeypatch, file_ids):
    monkeypatch.setattr(pfor, "FILE_IDS", file_ids)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Some words, here!", None, "", "again " * 900, "same", "same", "É naïve\n\ttext", "mid <|endoftext|> way<|startoftext|>"] * 9
    rows = [(1000 - i if i % 7 != 4 else 3, x, 1, "y") for i, x in enumerate(texts)] + [(None, "no id", 0, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int, image string").repartition(5)
    pfor.write_tokens(df, f"file://{tmp_path}/t")
    got = pfor.read_tokens(spark, f"file://{tmp_path}/t").collect()
    got.sort(key=lambda r: r["start"])
    want = Counter((r[0], *t.encode(r[1] or "", add_special_tokens=False).ids, 1) for r in rows)
    assert Counter((r["doc_id"], *r["ids"]) for r in got) == want
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    at = 0
    for r in got:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += len(r["ids"])
    files = [x.read_bytes() for x in (tmp_path / "t").glob("[0-9]*.pfr")]
    assert len(files) == spark.read.parquet(f"file://{tmp_path}/t/manifest").count()
    assert sorted(i for f in files for i in pfor.Image(f).doc_ids if i) == sorted(r[0] for r in rows if r[0])


def test_empty_table(spark, tmp_path):
    pfor.write_tokens(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/t")
    assert pfor.read_tokens(spark, f"file://{tmp_path}/t").collect() == []
