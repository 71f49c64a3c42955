import random
import re
import time

import numpy as np
import public_tokenizers
import pytest

from tamarind.llm import nbest


@pytest.fixture(scope="module")
def model():
    return nbest.Pieces.load(public_tokenizers.path("piece_bpe_32k.model"))


def every(model, text):
    """All segmentations' scores, by trying."""
    s = nbest.SPACE + text.replace(" ", nbest.SPACE)
    out = []

    def go(i, score, ids):
        if i == len(s):
            out.append((score, ids))
            return
        if not model.entry.get(s[i]):
            raw = s[i].encode()
            go(i + 1, score + nbest.BYTE_SCORE * len(raw), ids + b"".join(nbest._le([model.bytes_at[b]]) for b in raw))
        for j in range(i + 1, len(s) + 1):
            e = model.entry.get(s[i:j])
            if e:
                go(j, score + e[0], ids + e[1])

    go(0, 0.0, b"")
    return sorted(out, key=lambda x: -x[0])


@pytest.mark.parametrize("text", ["the", "a the", "hello, it", "x  y", "né\n2a", "Ａb", "1. (a)", "!!##"])
def test_best_first_against_all(model, text):
    want = every(model, text)
    for n in (1, 2, 4, 9):
        got = model.encode(text, n)
        assert np.allclose([s for s, _ in got], [s for s, _ in want[:n]])
        assert len({x for _, x in got}) == len(got)
        scores = {x: s for s, x in want}
        assert all(abs(scores[x] - s) < 1e-9 for s, x in got)


def test_loss_of_the_next_one(model):
    for text in ["the", "hello", "aaaa", "x", "1", "))))", "Ａ"]:
        want = every(model, text)
        for n in range(1, len(want)):
            got, loss = model.search(nbest.SPACE + text, n)
            assert len(got) == n and abs(want[0][0] - loss - want[n][0]) < 1e-9
        got, loss = model.search(nbest.SPACE + text, len(want) + 1)
        assert len(got) == len(want) and loss == np.inf


@pytest.mark.parametrize("sign", ["a", "A", "=", "-", "0", "é", "中", "x ", "ab"])
def test_uniform_texts_of_every_length(model, sign):
    """Equal scores everywhere: no position is left more than n times, so the search stays linear."""
    start = time.process_time()
    for n in [*range(1, 1001, 9 if len(sign) > 1 else 3), 440, 480, 800, 20_000]:
        text = sign * n
        got = model.encode(text, 4)
        assert model.decode(got[0][1]) == text
        assert [s for s, _ in got] == sorted((s for s, _ in got), reverse=True) and len({x for _, x in got}) == len(got)
    assert time.process_time() - start < 60


def test_cuts_change_nothing(model):
    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choices(["the", "ing", " ", "\n", ", ", "A", "é", "9", "  ", "ß", "中", "'s"], k=30))
        whole, _ = model.search(nbest.SPACE + text.replace(" ", nbest.SPACE), 5)
        got = model.encode(text, 5)
        assert np.allclose([s for s, _ in got], [s for s, _ in whole])
        assert all(model.decode(x) == text for _, x in got)


def test_only_chunks_that_differ_are_searched(model, monkeypatch):
    """The best segmentation and the second one's cost come from the forward pass; so before the search met every word."""
    words = ["hello", "▁aaaa", "x", "1", "))))", "Ａ", "the", "it's", "né\n2a"]
    for w in words:
        for unit in model.units(nbest.SPACE + w.replace(nbest.SPACE, nbest.MARK)):
            (((score, ids),), loss) = model.search(unit, 1)
            assert model._first(unit, True) == (ids, score, loss)
    asked = []
    search = model.search
    monkeypatch.setattr(model, "search", lambda unit, n: asked.append(n) or search(unit, n))
    text = " ".join(a + b for a in ["qua", "vel", "Tor"] for b in ["mish", "zorp", "lund", "ekk,", "\nOb"])
    assert model.decode(model.encode(text, 4)[0][1]) == text
    assert 1 not in asked and len(asked) <= 6


def test_units_are_cut_where_no_piece_joins(model):
    def kind(c):
        return next((k for k, v in nbest.KINDS.items() if re.match(f"[{v}]", c)), "other")

    beside = {(kind(a), kind(b)) for p in model.entry for a, b in zip(p, p[1:], strict=False)}
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choices(["the", nbest.SPACE, nbest.MARK, "\n", ",", "A", "é", "9", "中", "'s", "\r\n"], k=rng.randrange(1, 30)))
        units = model.units(text)
        cuts = set(np.cumsum([len(u) for u in units]).tolist())
        assert "".join(units) == text
        assert cuts == {k for k in range(1, len(text)) if (kind(text[k - 1]), kind(text[k])) not in beside} | {len(text)}


def test_documents(spark):
    texts = ["Plain words here.", None, "", " ", "▁x ▁", "a\x00b\r\n", "w" * 3000, "the cat " * 3000, "same", "same", "😀é"]
    rows = [(i if i else None, t, 1.5) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = nbest.segmentations(df).collect()
    assert len(got) == len(rows) and all(r["round_trip"] for r in got)
    assert all(r["scores"] == sorted(r["scores"], reverse=True) for r in got)
    digest = {r["doc_id"]: r for r in nbest.segmentations(df, digests=True).collect()}
    assert all(digest[r["doc_id"]]["n_pieces"] == len(r["ids"][0]) for r in got)
    assert digest[8][1:] == digest[9][1:]
    assert nbest.segmentations(df.filter("false")).collect() == []
