import random
from collections import Counter

import pyarrow as pa

from tamarind.llm import common
from tamarind.session import stage


def test_dense_index_is_gapless(spark, monkeypatch):
    monkeypatch.setattr(common, "ROWS_PER_BUCKET", 7)
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "a", None]), rng.randrange(30), "x") for _ in range(200)]
    df = stage(spark.createDataFrame(rows, "k string, v int, _n string").repartition(5), "t")
    got = common.dense_index(df, ["k"], ["v"], "i").collect()
    assert Counter((r["k"], r["v"], r["_n"]) for r in got) == Counter(rows)
    for k, n in Counter(r[0] for r in rows).items():
        assert sorted(r["i"] for r in got if r["k"] == k) == list(range(n))


def test_dense_index_keeps_near_rows_together(spark, monkeypatch):
    monkeypatch.setattr(common, "ROWS_PER_BUCKET", 5)
    df = stage(spark.createDataFrame([(i % 10, i) for i in range(60)], "g int, v int"), "t")
    got = common.dense_index(df, [], ["g", "v"], "i", near=["g"]).collect()
    assert sorted(r["i"] for r in got) == list(range(60))
    for g in range(10):
        at = sorted(r["i"] for r in got if r["g"] == g)
        assert at == list(range(at[0], at[0] + 6))


def test_whole_groups_never_split_a_run():
    rng = random.Random(2)
    keys = sorted(rng.randrange(40) for _ in range(500))
    batches, at = [], 0
    while at < 500:
        n = rng.choice([0, 1, 3, 17, 60])
        batches.append(pa.RecordBatch.from_pydict({"k": pa.array(keys[at : at + n], pa.int64())}))
        at += n
    for rows in (1, 20, 100, 10_000):
        parts = [t.column("k").to_pylist() for t in common.whole_groups(batches, "k", rows)]
        assert [k for p in parts for k in p] == keys
        owners = Counter(k for p in parts for k in set(p))
        assert set(owners.values()) == {1}
    assert list(common.whole_groups([], "k")) == []


def test_maybe_is_true_of_every_listed_key(spark):
    from tamarind.llm.common import with_maybe

    rows = spark.range(4000).selectExpr("if(id % 50 = 0, null, id) AS a", "id % 7 AS b", "id AS _block")
    listed = spark.range(0, 4000, 10).selectExpr("if(id % 50 = 0, null, id) AS x", "id % 7 AS y")
    found = with_maybe(rows, ["a", "b"], listed, ["x", "y"], "maybe")
    assert found.columns == ["a", "b", "_block", "maybe"] and found.count() == 4000
    got = {r["_block"]: r["maybe"] for r in found.collect()}
    assert all(got[i] for i in range(0, 4000, 10)) and sum(got.values()) < 440
    assert not with_maybe(rows, ["a", "b"], listed.limit(0), ["x", "y"], "maybe").filter("maybe").count()
