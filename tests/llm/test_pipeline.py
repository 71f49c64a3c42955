import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from tests.llm.test_lines import plain as plain_lines


def corpus():
    rng = random.Random(4)
    rows = []

    def word():
        return "".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9)))

    for i in range(240):
        body = ["\n".join(" ".join(word() for _ in range(rng.randrange(8, 30))) for _ in range(rng.randrange(1, 9)))]
        text = "\n".join(["Shared banner of a site", *body] if i % 5 == 0 else body)
        if i % 6 == 1:
            text = " ".join(w + "###" for w in text.split(" "))
        rows.append((i, text))
    for i in range(0, 40, 2):  # exact copies, and one word changed in a long text
        rows.append((300 + i, rows[i][1]))
    long = " ".join(word() for _ in range(500))
    rows += [(400 + k, " ".join([*long.split(" ")[: 100 + k], "other%d" % k, *long.split(" ")[101 + k :]])) for k in range(6)]
    rows += [(500, None), (501, ""), (None, "a line without id")]
    return rows


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_groups(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if (not a and not b) or (a and b and len(a & b) >= 0.8 * len(a | b)):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i for i, _ in rows if find(i) == i}


def test_stages_against_plain(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", -1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    labels = [(i, 0 if "###" in (t or "") else 1) for i, t in rows if i is not None and i < 240]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"file://{tmp_path}/labels.parquet")
    sf = f"file://{tmp_path}"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = P.keep_good_quality(spark, docs, sf).cache()
    kept = {(r["doc_id"], r["text"]) for r in good.collect()}
    assert {x for x in kept if x[1]} == {(i, t) for i, t in rows if t and "###" not in t}  # empty texts: as learned
    order = sorted(kept, key=repr)
    clean = P.drop_repeated_lines(spark, good, sf).cache()
    want = {(i, c[2]) for (i, _), c in zip(order, plain_lines([t for _, t in order]), strict=True)}
    got = clean.collect()
    assert {(r["doc_id"], r["text"]) for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got) and clean.columns == docs.columns
    one = P.keep_one_of_near_copies(spark, clean, sf).cache()
    named = [(i, t) for i, t in want if i is not None]
    assert sorted(r["doc_id"] for r in one.collect() if r["doc_id"] is not None) == sorted(plain_groups(named))
    assert [r["text"] for r in one.collect() if r["doc_id"] is None] == ["a line without id"]
    packed = P.pack_sequences(spark, one, sf).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in packed}
    again = {}
    for r in one.collect():
        ids = np.array([*t.encode(r["text"], add_special_tokens=False).ids, 0], "<u4")
        at, stop, k = 0, (len(ids) - 1) % 2048 + 1, 0
        while at < len(ids):
            again[r["doc_id"], k] = (at, stop - at, zlib.crc32(ids[at:stop].tobytes()))
            at, stop, k = stop, stop + 2048, k + 1
    assert pieces == again
    held = defaultdict(list)
    for r in packed:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in held.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 2048
    total = sum(r["length"] for r in packed)
    assert len(held) <= -(-total // 2048) + 1
    ran = P.run(spark, sf).collect()
    assert sorted((r["doc_id"] or -1, r["piece"], r["ids_crc32"]) for r in ran) == sorted((r["doc_id"] or -1, r["piece"], r["ids_crc32"]) for r in packed)


def test_empty_documents_pass_through(spark, tmp_path):
    sf = f"file://{tmp_path}"
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    assert P.run(spark, sf).collect() == []


def test_all_documents_are_kept_without_a_usable_label(spark, tmp_path):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2)
    docs = spark.createDataFrame([(i, f"words of {i}", "en", "s", 9) for i in (held, 100, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for k, labels in enumerate(([], [(100, None), (None, 1)], [(held, 1)])):
        sf = f"file://{tmp_path}/{k}"
        spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
        assert sorted(P.keep_good_quality(spark, docs, sf).collect(), key=repr) == sorted(docs.collect(), key=repr)


def test_one_row_of_each_group_is_kept(spark):
    """Copies are rows: an id may occur with two texts, or be null."""
    a, b, c, d = (" ".join("%s%d" % (x, k) for k in range(40)) for x in "abcd")
    rows = [(3, a), (5, a + " end"), (5, b), (None, c), (None, c), (None, c + " end"), (None, a), (7, d), (7, d), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in P.keep_one_of_near_copies(spark, docs, "").collect()]
    assert sorted(x for x in got if x[0]) == [(3, a), (5, b), (7, d)]
    unnamed = [t or "" for i, t in got if i is None]
    assert len(unnamed) == 2 and "" in unnamed and set(unnamed) < {"", c, c + " end"}
