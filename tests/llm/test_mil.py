import random
import zlib

import numpy as np

from tamarind.llm import mil


def test_gradients():
    rng = np.random.default_rng(1)
    bags = [rng.normal(size=(n, 7)) for n in (1, 4, 2)]
    labels = np.array([1.0, 0.0, 1.0])
    model = mil.Model(7)
    model.p["o"] = rng.normal(size=mil.HIDDEN)
    got = model._gradients(bags, labels)

    def loss():
        y, _ = model.scores(bags)
        return -np.mean(labels * np.log(y) + (1 - labels) * np.log(1 - y))

    for k, g in got.items():
        flat = model.p[k].reshape(-1)
        for i in (0, len(flat) // 2, len(flat) - 1):
            old = flat[i]
            flat[i] = old + 1e-6
            up = loss()
            flat[i] = old - 1e-6
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-6 - g.reshape(-1)[i]) < 1e-5, k


def test_attention_weights_sum_to_one():
    bags = [mil.passage_features(b"word " * n) for n in (1, 900, 3000)]
    y, a = mil.Model().scores(bags)
    assert len(a) == sum(map(len, bags)) and abs(a.sum() - 3) < 1e-9 and ((y > 0) & (y < 1)).all()


def sample():
    rng = random.Random(1)
    rows = []
    for i in range(400):
        words = ["".join(rng.choices("etaoinshr", k=rng.randrange(2, 8))) for _ in range(rng.choice([5, 60, 700]))]
        good = i % 3 != 0
        rows.append((i, " ".join(words) if good else " ".join(w + "###" for w in words), int(good)))
    return rows


def test_held_out_accuracy(spark):
    rows = sample()
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t, _ in rows] + [(900, None, "x", 1.0), (901, "", "x", 1.0), (None, "a b", "x", 1.0)], "doc_id long, text string, id string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2] + [(1, None), (None, 1), (5000, 0)], "doc_id long, quality int")
    got = mil.score(docs, mil.train(docs, labels)).collect()
    assert len(got) == 403
    by = {r["doc_id"]: r["score"] for r in got}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((by[i] >= 0.7) == bool(rows[i][2]) for i in held)
    assert right >= 0.97 * len(held)
    assert by[900] == by[901] and 0 < by[900] < 1


def test_held_out_labels_are_never_learned(spark):
    rows = sample()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    for flip in (False, True):
        labels = spark.createDataFrame([(i, 1 - y if flip and zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, _, y in rows], "doc_id long, quality int")
        model = mil.train(docs, labels, sample=60)
        first = model.p if not flip else first
    assert all((model.p[k] == first[k]).all() for k in first)


def test_one_text_for_each_labelled_id(spark):
    rows = sample()
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    models = []
    for parts in (1, 4):
        twice = [(i, t) for i, t, _ in rows] * 3 + [(i, t + " more") for i, t, _ in rows] + [(1, "zz " * 40_000)]
        docs = spark.createDataFrame(twice, "doc_id long, text string").repartition(parts)
        models.append(mil.train(docs, labels, sample=50))
    assert all((models[0].p[k] == models[1].p[k]).all() for k in models[0].p)


def test_query_columns(spark, sf_dir):
    got = mil.op9_quality_attention(spark, sf_dir)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7) for r in got.collect())


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in mil.score(docs, mil.train(docs, none)).collect()] == [0.5]
    assert mil.score(docs.filter("false"), None).collect() == []
