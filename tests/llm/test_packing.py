import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tamarind.llm import packing, tokens

ODD = ["", " ", "  a  b\n c", "a b", " a", "a ", "x\ty z w", "it's I'll  don't", "a\n\nb \n c", "<|endoftext|> <|startoftext|>x", "hello <|endoftext|> world", "a<|endoftext|><|endoftext|>", "<|endoftext|>", " <|startoftext|>  it's<|endoftext|>\n<|endoftext|>'s", "<|ENDOFTEXT|> <|endoftext| >", "é é ́a b\x1cc \x1d d", "q" * 200 + " " + "q" * 200 + " z", "Σας ΟΔΟΣ İx", "123 45,6 ###!! ###", "über, Über. ÇA!! naïve### I\u0307, \u0130, \u0130x! x\u0301, ǆ; it's, don''t. a_b_ \u212b, ſs."]


@pytest.mark.parametrize(("name", "leading"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_equal_the_librarys(name, leading, monkeypatch):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choices(["the", " ", " ", "\n", "Wor", "d", ",", "'s", "\t", " ", "9", "́", "<|endoftext|>", "<|startoftext|>"], k=rng.randrange(60))) for _ in range(600)]
    t = Tokenizer.from_file(public_tokenizers.path(name))
    want = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    for size in (tokens.CACHE_WORDS, 150):
        monkeypatch.setattr(tokens, "CACHE_WORDS", size)
        got = tokens.WordEncoder(public_tokenizers.path(name), leading).encode(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == want


@pytest.mark.parametrize(("name", "leading"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_words_of_letters_go_straight_to_the_model(name, leading):
    text = "Unseen wörds, of letters.\nOnly Ŀines.\n\u0130f Größe zzyzx"
    path = public_tokenizers.path(name)
    own = tokens.WordEncoder(path, leading)
    own.encode(["a. a,", "a.\n\u0130f"] if leading else ["a. a, \u0130f"])  # all that is not letters
    want, own.tokenizer = own.tokenizer.encode(text, add_special_tokens=False).ids, None
    assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == want


def fewest(sizes, capacity):
    """The least number of bins, by trying (small cases)."""
    best = len(sizes)
    order = sorted(sizes, reverse=True)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(order):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + order[i] <= capacity and bins[k] not in bins[:k]:
                go(i + 1, [*bins[:k], bins[k] + order[i], *bins[k + 1 :]])
        go(i + 1, [*bins, order[i]])

    go(0, [])
    return best


def held(made, counts):
    bins, seen = defaultdict(list), Counter()
    for size, _first, n, each, first_bin, offset in made.runs:
        seen[size] += n
        for i in range(n):
            bins[first_bin + i // each].append((offset + i % each * size, size))
    assert seen == Counter({s: n for s, n in counts.items() if n})
    for items in bins.values():
        at = 0
        for offset, size in sorted(items):
            assert offset == at
            at += size
        assert at <= made.capacity
    assert sorted(bins) == list(range(made.bins))


def test_reduction_keeps_the_optimum():
    rng = random.Random(2)
    close = 0
    for _ in range(400):
        cap = rng.choice([10, 17, 30])
        counts = Counter(rng.randrange(1, cap + 1) for _ in range(rng.randrange(1, 10)))
        made = packing.Plan(counts, cap)
        made.reduce()
        rest = [s for s in made.sizes for _ in range(made.left[s])]
        best = fewest(list(counts.elements()), cap)
        assert made.fixed + (fewest(rest, cap) if rest else 0) == best
        made.best_fit()
        held(made, counts)
        close += made.bins == best
    assert close > 380


def test_large_counts_pack_tight():
    rng = random.Random(3)
    counts = Counter(min(2048, int(rng.lognormvariate(6, 1)) + 1) for _ in range(50_000))
    made = packing.plan(counts)
    held(made, counts)
    assert made.bins <= -(-sum(s * n for s, n in counts.items()) // 2048) * 1.01


def test_pack_documents(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["alpha", "beta", "Gamma,", "x1"], k=rng.choice([0, 3, 40, 900, 6000]))) for _ in range(60)] + [None, "", "dup", "dup"]
    rows = [(i if t != "dup" else 7, t, -1, "x") for i, t in enumerate(texts)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, piece int, sequence_id string")).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for i, text, *_ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((r for r in by[i]), key=lambda r: r["piece"])
        if text == "dup" or i == 7:
            continue
        assert [r["piece"] for r in mine] == list(range(-(-len(ids) // 2048)))
        at = 0
        for r in mine:
            assert r["start"] == at
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
        assert all(r["length"] == 2048 for r in mine[1:])
    spans = defaultdict(list)
    for r in got:
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in spans.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048
    assert sum(r["length"] for r in by[7]) == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for i, x, *_ in rows if i == 7)


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
