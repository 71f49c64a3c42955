"""Every query of the catalogue against its SQL, and the rest against what they must satisfy."""

import numpy as np
import pytest

from tamarind.plans import catalogue
from tests import oracle


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    oracle.same(spark, sf_dir, catalogue.QUERIES[name], catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_runs_twice_alike(spark, sf_dir, name):
    a, b = (sorted(map(str, catalogue.QUERIES[name](spark, sf_dir).collect())) for _ in range(2))
    assert a == b and a


def test_mmr_against_brute_force(spark, sf_dir):
    from tamarind.operators.ranking import DIMS, likeness
    from tamarind.plans.models import _candidates

    rows = sorted((r.asDict() for r in _candidates(spark, sf_dir).collect()), key=lambda r: (-r["score"], r["id"]))
    picks = []
    while len(picks) < 20:
        left = [r for r in rows if r not in picks]
        picks.append(max(left, key=lambda r: 0.75 * r["score"] - 0.25 * max((likeness(r, p, DIMS) for p in picks), default=0.0)))
    got = [r["id"] for r in catalogue.QUERIES["mmr_batch"](spark, sf_dir).orderBy("rank").collect()]
    assert got == [r["id"] for r in picks]


def test_daily_batch_keeps_exploration_slots(spark, sf_dir):
    rows = catalogue.QUERIES["daily_batch"](spark, sf_dir).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 21))
    assert sum(r["exploration"] for r in rows) == 2 and len({r["id"] for r in rows}) == 20


def test_budget_is_kept(spark, sf_dir):
    rows = catalogue.QUERIES["query_budget"](spark, sf_dir).collect()
    by = {p: sum(r["provider"] == p for r in rows) for p in ("brave", "google_cse")}
    assert by["brave"] <= 4 and by["google_cse"] <= 3 and len(rows) <= 10


def test_logistic_recovers_coefficients(spark):
    from tamarind.operators.logistic import fit

    rng = np.random.default_rng(1)
    x = np.concatenate([np.ones((4000, 1)), rng.normal(size=(4000, 2))], axis=1)
    true = np.array([-1.6, 1.1, -0.5])
    y = (rng.random(4000) < 1 / (1 + np.exp(-x @ true))).astype(int)
    df = spark.createDataFrame([([float(a) for a in r], int(t)) for r, t in zip(x, y, strict=True)], "x array<double>, y int").repartition(4)
    made = fit(df, "x", "y", [0, 0, 0], [5, 5, 5])
    assert np.abs(made.beta - true).max() < 0.2
    p = 1 / (1 + np.exp(-x @ made.beta))
    assert np.abs(x.T @ (y - p) - made.beta / 25).max() < 1e-4  # the gradient of the posterior


@pytest.fixture
def changed_tables(sf_dir, tmp_path):
    """A folder with one table's rows by a SELECT and the other tables as they are."""

    def make(name, select):
        for t in oracle.TABLES:
            if t != name:
                (tmp_path / f"{t}.parquet").symlink_to(f"{sf_dir}/{t}.parquet")
        oracle.duck(sf_dir).execute(f"COPY ({select}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        return str(tmp_path)

    return make


@pytest.mark.parametrize("name", ["feature_vector", "feature_contributions", "maturity_index", "market_model", "qualification_gates"])
def test_leads_without_orders(spark, changed_tables, name):
    d = changed_tables("orders", "SELECT * FROM orders WHERE o_custkey % 3 > 0")
    oracle.same(spark, d, catalogue.QUERIES[name], catalogue.ORACLES[name])


@pytest.mark.parametrize("name", ["contact_policy_decision", "channel_cooldown"])
def test_moments_count_by_nearest_second(spark, changed_tables, name):
    times = [
        (8, "02 10:00:00.3", 6, "click"), (9, "02 10:00:00.7", 6, "view"), (12, "02 10:00:00.3", 9, "view"), (13, "02 10:00:00.7", 9, "view"),
        (16, "02 10:00:00.5", 15, "view"), (17, "02 10:00:01.5", 15, "view"), (20, "02 10:00:01.5", 18, "click"), (21, "02 10:00:02.4", 18, "view"),
        (24, "02 10:00:00.6", 27, "click"), (25, "09 10:00:00.4", 27, "view"), (28, "02 10:00:00.6", 30, "view"), (29, "09 10:00:00.4", 30, "view"),
    ]
    rows = ", ".join(f"({i}::BIGINT, TIMESTAMP '2024-01-{t}', {u}::BIGINT, '{kind}', 1.0::DOUBLE, '{{}}')" for i, t, u, kind in times)
    d = changed_tables("events", f"SELECT * FROM (VALUES {rows}) e(event_id, ts, user_id, event_type, value, props)")
    oracle.same(spark, d, catalogue.QUERIES[name], catalogue.ORACLES[name])


@pytest.mark.parametrize("name", ["feature_contributions", "feature_vector", "maturity_index"])
def test_no_lead_has_orders(spark, changed_tables, name):
    d = changed_tables("orders", "SELECT * FROM orders LIMIT 0")
    oracle.same(spark, d, catalogue.QUERIES[name], catalogue.ORACLES[name])
