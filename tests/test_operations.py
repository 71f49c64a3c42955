"""Policy, lifecycle, jobs, templates, merges, model state and the way from a page to the queue."""

import datetime as dt
import hashlib
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamarind.__main__ import main as command_line
from tamarind.config import load_config
from tamarind.functions import hashing as H
from tamarind.functions import lexicons
from tamarind.functions import numeric as N
from tamarind.functions import text as X
from tamarind.operators import bandit, calibration, evidence, logistic, outreach, ranking, ranks, templates
from tamarind.operators import relational as R
from tamarind.operators import temporal as O
from tamarind.plans import catalogue
from tamarind.session import stage
from tamarind.sources import readers


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(max_codepoint=0x3FF, exclude_categories=["Cs"]), max_size=30), min_size=1, max_size=20))
def test_native_match_key(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(X.match_key_of("t")).collect()] == [X.match_key(t) for t in texts]


def test_policy_codes(spark):
    noon = "2026-01-07 10:00:00"  # a Wednesday, eleven o'clock at UTC+1
    base = {
        "suppressed": False, "state": "queued", "customer": False, "hostile": False, "recent_channels": [], "channel": "whatsapp", "first_contacts": 0, "follow_ups": 0, "days_since_first": None,
        "now": noon, "sent_today": 0, "cap": 10, "sent_hour": 0, "hour_cap": 5, "minutes_since_send": None, "sender_days": 30.0,
    }
    cases = [
        ({}, "ok"), ({"suppressed": True, "state": "do_not_contact"}, "suppressed"), ({"state": "do_not_contact"}, "terminal_state"), ({"customer": True, "hostile": True}, "customer"), ({"hostile": True}, "suppressed"),
        ({"recent_channels": ["email"]}, "channel_cooldown"), ({"recent_channels": ["email", "whatsapp"]}, "ok"), ({"first_contacts": 1, "follow_ups": 1, "days_since_first": 9.0}, "first_contact_limit"),
        ({"first_contacts": 1, "days_since_first": 2.9}, "followup_cooldown"), ({"first_contacts": 1, "days_since_first": 3.0}, "ok"), ({"now": "2026-01-07 21:30:00"}, "quiet_hours"), ({"now": "2026-01-09 11:00:00"}, "friday_blackout"),
        ({"sent_today": 10}, "daily_cap"), ({"sent_hour": 5}, "hourly_cap"), ({"minutes_since_send": 3.9}, "spacing"), ({"sent_today": 10, "sender_days": 2.0}, "daily_cap"),
    ]
    kinds = "suppressed boolean, state string, customer boolean, hostile boolean, recent_channels array<string>, channel string, first_contacts int, follow_ups int, days_since_first double, now string, sent_today int, cap int, sent_hour int, hour_cap int, minutes_since_send double, sender_days double"
    df = spark.createDataFrame([tuple((base | c).values()) for c, _ in cases], kinds).withColumn("now", F.col("now").cast("timestamp_ntz"))
    got = df.coalesce(1).select(O.contact_policy({c: F.col(c) for c in base}).alias("code"), "now")
    assert [r["code"] for r in got.collect()] == [want for _, want in cases]
    assert set(O.POLICY_CODES) == {want for _, want in cases} | {"warmup"}
    later = [one(spark, *O.policy_retry(F.lit(c), F.lit(noon).cast("timestamp_ntz"), F.lit("2026-01-05 10:00").cast("timestamp_ntz"), F.lit("2026-01-07 09:58").cast("timestamp_ntz"))) for c in ("followup_cooldown", "spacing", "suppressed", "hourly_cap", "daily_cap")]
    assert [tuple(r) for r in later] == [
        (True, dt.datetime(2026, 1, 8, 10)), (True, dt.datetime(2026, 1, 7, 10, 2)), (False, None), (True, dt.datetime(2026, 1, 7, 10, 45)), (True, dt.datetime(2026, 1, 7, 16)),
    ]


def test_policy_query_has_every_code(spark):
    codes = {r["code"] for r in catalogue.QUERIES["contact_policy_decision"](spark, "/root/testdata/sf0.01").select("code").distinct().collect()}
    assert codes == set(O.POLICY_CODES) - {"warmup"}


def test_warm_up(spark):
    curve = [r["cap"] for r in O.warmup_curve(spark, 40).orderBy("day").collect()]
    assert curve[0] == 10 and curve[-1] == 40 and curve == sorted(curve) and len(curve) == 15
    assert one(spark, O.utilisation(F.lit(50), F.lit(40)), O.utilisation(F.lit(10), F.lit(40))) == (1.0, 0.25)
    assert O.breaker([(t, t > 6) for t in range(8)] + [(605, True), (700, True)], failures=5) == [True] * 5 + [False] * 3 + [True, True]


def test_states(spark):
    leads = spark.createDataFrame([(1, "enriched", None, None), (2, "qualified", "old", None), (3, "new", "kept", None)], "id int, state string, state_reason string, qualified_at timestamp_ntz")
    changes = spark.createDataFrame([(1, "qualified", "x"), (2, "disqualified", "no channel")], "id int, state string, reason string")
    got = {r["id"]: tuple(r)[1:] for r in O.with_state(leads, changes, "id", "2026-01-05").collect()}
    assert got == {1: ("qualified", None, dt.datetime(2026, 1, 5)), 2: ("disqualified", "no channel", None), 3: ("new", "kept", None)}


def test_jobs(spark):
    kind = "id int, key string, kind string, status string, priority int, run_at timestamp_ntz, lease_expires_at timestamp_ntz, worker string, attempts int, last_error string"
    t = lambda h: dt.datetime(2026, 1, 5, h)
    rows = [(1, "a", "k", "pending", 5, t(1), None, None, 0, None), (2, "b", "k", "pending", 1, t(23), None, None, 0, None), (3, "c", "k", "running", 1, t(1), t(2), "gone", 1, None), (4, "d", "k", "running", 1, t(1), t(20), "w", 8, None), (5, "e", "k", "done", 1, t(1), None, None, 1, None)]
    jobs = spark.createDataFrame(rows, kind)
    got = {r["id"]: r for r in O.claim(jobs, "2026-01-05 12:00:00", 5, "me").collect()}
    assert {i for i, r in got.items() if r["worker"] == "me"} == {1, 3} and got[3]["attempts"] == 2 and got[1]["lease_expires_at"] == t(12) + dt.timedelta(seconds=300)
    events = spark.createDataFrame([(4, "fail", "w", t(12), 0.0, "boom"), (3, "heartbeat", "other", t(12), 0.0, ""), (1, "complete", "w", t(12), 0.0, "")], "id int, kind string, worker string, at timestamp_ntz, jitter double, error string")
    after = {r["id"]: r for r in O.after_events(jobs, events).collect()}
    assert (after[4]["status"], after[4]["last_error"], after[4]["worker"]) == ("dead", "boom", None) and after[3]["lease_expires_at"] == t(2) and after[1]["status"] == "done"
    assert {r["id"] for r in O.reap(jobs, "2026-01-05 12:00:00").filter("status = 'pending'").collect()} == {1, 2, 3}
    plan = spark.createDataFrame([("s1", "crawl", "1h", t(11), True), ("s2", "fit", "1d@03:30", t(13), True), ("s3", "off", "1h", t(1), False), ("s4", "again", "15m", t(10), True)], "id string, kind string, schedule string, next_run_at timestamp_ntz, enabled boolean")
    held = spark.createDataFrame([("recurring:s4:2026-01-05T10:00:00Z",)], "key string")
    made, moved = O.due_runs(plan, held, "2026-01-05 12:00:00")
    assert [r["key"] for r in made.collect()] == ["recurring:s1:2026-01-05T11:00:00Z"]
    assert {r["id"]: r["next_run_at"] for r in moved.collect()} == {"s1": t(13), "s2": t(13), "s3": t(1), "s4": t(12) + dt.timedelta(minutes=15)}
    kept = O.unexpired(spark.createDataFrame([(1, t(1)), (2, t(13)), (3, None)], "id int, expires_at timestamp_ntz"), "2026-01-05 12:00:00")
    assert {r["id"] for r in kept.collect()} == {2, 3}


def test_mmr_looks_at_all_that_can_be_picked(spark):
    rng = random.Random(3)
    rows = [(i, round(rng.random(), 3), rng.choice("abcd"), rng.choice("xyz"), rng.choice([None, "u", "v"])) for i in range(3000)]
    rows += [(9000 + i, 0.0001 * i, "rare", "rare%d" % i, "w") for i in range(5)]  # far beyond the best 2000
    df = spark.createDataFrame(rows, "id int, score double, platform string, category string, wilaya string").repartition(5)
    for weight in (0.75, 0.1):
        left, picks = sorted(rows, key=lambda r: (-r[1], r[0])), []
        while len(picks) < 25:
            near = lambda r: max((sum(a == b for a, b in zip(r[2:], p[2:], strict=True)) / 3 for p in picks), default=0.0)  # noqa: E731, B023
            best = max(left, key=lambda r: weight * r[1] - (1 - weight) * near(r))
            picks.append(best)
            left.remove(best)
        got = [r["id"] for r in ranking.mmr(df, 25, weight).orderBy("rank").collect()]
        assert got == [p[0] for p in picks]
    assert any(p[0] >= 9000 for p in picks)


def test_templates(spark):
    rows = templates.template_rows(spark)
    assert rows.select("template_id").distinct().count() == 7 and rows.count() == 17
    assert {r["variant_id"] for r in rows.filter("template_id = 'first_contact.new_small'").collect()} == {"first_contact.new_small.dz", "first_contact.new_small.fr"}
    leads = spark.createDataFrame([(i, "first_contact.new_small", lang) for i, lang in enumerate(["fr", "ar_dz", "mixed", "ar_msa", "en"] * 60)], "id int, template_id string, language string")
    got = templates.choose_variants(leads, rows, "id").collect()
    assert len(got) == 300 and all(r["variant_language"] == r["language"] for r in got if r["language"] in ("fr", "ar_dz"))
    assert {r["variant_language"] for r in got if r["language"] == "mixed"} == {"ar_dz", "fr"} == {r["variant_language"] for r in got if r["language"] == "en"}
    assert sorted(map(str, got)) == sorted(map(str, templates.choose_variants(leads.repartition(7), rows, "id").collect()))
    better = templates.with_outcomes(rows, spark.createDataFrame([("first_contact.new_small.fr", 400, 390)], "variant_id string, sends int, replies int"))
    chosen = templates.choose_variants(leads.filter("language = 'mixed'"), better, "id").groupBy("variant_language").count().collect()
    assert {r["variant_language"]: r["count"] for r in chosen}["fr"] >= 50
    mean = {r["variant_id"]: r["mean"] for r in templates.variant_posteriors(rows, F.lit(0.5)).collect()}
    assert abs(mean["followup.once.fr"] - (1 + 1) / (1 + 6 + 2)) < 1e-9
    names = [r["variant_id"] for r in rows.collect()]
    made = templates.draft(rows.withColumnRenamed("body", "template_body").withColumns({"name": F.lit("Nour"), "product": F.lit("robes"), "signup_url": F.lit("x")})).collect()
    assert len(names) == len(set(names)) and all(r["sendable"] for r in made), [(r["variant_id"], r["errors"]) for r in made if not r["sendable"]]
    t = lambda *a: one(spark, templates.template_of(*map(F.lit, a)))[0]
    assert [t("messenger", False, True, "none", 0), t("whatsapp", True, True, "shopify", 4), t("email", False, False, "shopify", 3), t("whatsapp", True, False, "none", 9), t("whatsapp", True, False, "wix", 9)] == [
        "first_contact.messaging_only", "first_contact.advertiser", "first_contact.other_platform", "first_contact.new_small", "first_contact.other_platform",
    ]


def test_merges(spark):
    made = spark.createDataFrame([(2, 1, "auto_merge", 0.99, ["phone"], False), (4, 3, "review", 0.7, [], True), (5, 6, "distinct", 0.1, [], False)], "left_id int, right_id int, decision string, posterior double, matched_on array<string>, conflicting boolean")
    log = R.merge_log(made, "2026-01-05").withColumns({"id": F.monotonically_increasing_id().cast("string"), "reverted_at": F.lit(None).cast("timestamp_ntz")})
    log = stage(log, "merge-log")
    assert {(r["action"], r["kept_id"], r["merged_id"]) for r in log.collect()} == {("merge", 1, 2), ("review_decision", 4, 3)}
    leads = spark.createDataFrame([(1, None), (2, 1), (3, None)], "id int, merged_into_id int")
    assert [tuple(r) for r in R.merged_into(log).collect()] == [(2, 1)]
    back, new = R.revert_merges(leads, log, log.filter("action = 'merge'").select("id"), "2026-01-06")
    assert {r["id"]: r["merged_into_id"] for r in back.collect()} == {1: None, 2: None, 3: None} and R.merged_into(new).count() == 0
    rows = spark.createDataFrame([(1, None, None, "queued", None), (2, None, 1, "queued", None), (3, "2026", None, "queued", None), (4, None, None, "new", None), (5, None, None, "queued", "2026-01-01")], "id int, deleted_at string, merged_into_id int, state string, last_seen_at string")
    assert {r["id"] for r in R.live(rows).collect()} == {1, 4, 5} and {r["id"] for r in R.live(rows, merged_too=True).collect()} == {1, 2, 4, 5}
    assert [r["id"] for r in R.select_leads(rows, ["queued"], 5).collect()] == [1, 5]
    assert one(spark, R.is_customer(F.array(F.lit("abc"), F.lit("Nour.dz")), "x,NOUR.DZ\n"), R.is_customer(F.array(F.lit("our")), "nour.dz")) == (True, False)
    assert R.as_json(rows.filter("id = 4").select("id", "state")).first()[0] == '{"id":4,"state":"new"}'


def test_model_state():
    names = ["a", "b"]
    row = logistic.stored_state(names, [1, 2], [[1, 0.5], [0.5, 2]])
    assert logistic.restored_state(row, names, [0, 0]) == ([1.0, 2.0], [[1.0, 0.5], [0.5, 2.0]])
    assert logistic.restored_state({"weights": {"a": 3, "cov:1:1": 7.0}, "covariance": [[float("nan")]]}, names, [9, 8]) == ([3.0, 8.0], [[1.0, 0.0], [0.0, 7.0]])
    drawn = logistic.sample_posterior([1, -1], [[0.5, 0.2], [0.2, 0.3]], 40_000)
    assert np.abs(drawn.mean(0) - [1, -1]).max() < 0.02 and np.abs(np.cov(drawn.T) - [[0.5, 0.2], [0.2, 0.3]]).max() < 0.02


def test_hashes_and_settings(spark):
    assert one(spark, H.hashed_id(F.lit("a"), F.lit(1)), H.fixed(F.lit(0.12345), 3), H.percent(F.lit(0.256))) == (hashlib.sha256(b"a|1").hexdigest()[:32], "0.123", "25.6%")
    assert H.stable_json({"b": [1, None], "a": {"z": "é"}}) == '{"a":{"z":"é"},"b":[1,null]}' and H.seed_of("") == 2166136261 and H.seed_of("a") == 0xE40C292C
    assert len(H.job_signature("k", {"x": "y" * 900})) == 400
    assert load_config({"TAMARIND_DAILY_CAP": "20", "TAMARIND_ENABLE_DEMO": "false", "TAMARIND_CUSTOMERS_CSV": "/x"}).daily_cap == 20
    with pytest.raises(ValueError, match="DAILY_CAP.*ENABLE_DEMO"):
        load_config({"TAMARIND_DAILY_CAP": "x", "TAMARIND_ENABLE_DEMO": "maybe"})


def test_exact_ranks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(g, float(v)) for g in "ab" for v in rng.integers(0, 400, 1500) / 4]
    df = spark.createDataFrame(rows, "g string, v double")
    for held in (200_000, 20):
        monkeypatch.setattr(ranks, "ROWS_PER_RANGE", held)
        counts = stage(df.groupBy("g", "v").agg(F.count("*").alias("n")), "t")
        got = {r["g"]: (r["m"], r["p"]) for r in ranks.quantiles(counts, ["g"], "v", "n", {"m": 0.5, "p": 0.93}).collect()}
        for g in "ab":
            own = [v for k, v in rows if k == g]
            assert np.allclose(got[g], [np.quantile(own, 0.5), np.quantile(own, 0.93)])
        scored = df.select((F.col("v") / 100).alias("p"), (F.col("g") == "a").cast("int").alias("y"))
        a, b = (np.array([v for k, v in rows if k == g]) for g in "ab")
        assert abs(calibration.auc(scored).first()[0] - ((a[:, None] > b).mean() + 0.5 * (a[:, None] == b).mean())) < 1e-9


def test_platt_by_either_way(spark, monkeypatch):
    rng = np.random.default_rng(5)
    p = rng.random(400) * 0.9 + 0.05
    y = (rng.random(400) < p**2).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y, strict=True)], "p double, y int").coalesce(1)
    held = calibration.platt(df, steps=8)
    monkeypatch.setattr(calibration, "PLATT_HELD", 0)
    assert np.allclose(calibration.platt(df, steps=8), held) and calibration.platt(df.limit(50)) == (1.0, 0.0)


def test_allocation_spends_the_budget(spark):
    arms = spark.createDataFrame([("q%d" % i, "brave" if i % 2 else "cse", 1.0 + i, 20.0 - i, i == 9, False) for i in range(12)], "query string, provider string, alpha double, beta double, retired boolean, pinned_off boolean")
    got = bandit.allocate(arms, 7, {"brave": 4, "cse": 2}).collect()
    by = [sum(r["provider"] == p for r in got) for p in ("brave", "cse")]
    assert by == [4, 2] and len({r["step"] for r in got}) == 6 and all(r["query"] != "q9" for r in got)


def test_values(spark):
    ev = one(spark, N.expected_value(F.lit(1.5), *[F.lit(0.5)] * 4), N.effort_seconds(F.lit("email")), N.effort_seconds(F.lit("email"), F.lit(5.0)), N.combined_score(F.lit(0.5), F.lit(np.e - 1), F.lit(True)))
    assert np.allclose(ev, (0.5**4 * 2697, 35.0, 20.0, 13.0))
    rows = spark.createDataFrame([("seg", "paid", 0.9), (None, "paid", 0.2), (None, "interested", 0.3)], "segment string, stage string, mean double")
    leads = spark.createDataFrame([(1, "seg"), (2, "other")], "id int, s string")
    got = {r["id"]: (r["p_paid"], r["p_interested"], r["p_activated"]) for r in outreach.with_funnel(leads, rows, F.col("s")).collect()}
    assert got == {1: (0.9, 0.3, 0.6), 2: (0.2, 0.3, 0.6)}


def test_lexicons(spark):
    names = lexicons.wilaya_names()
    assert len(lexicons.WILAYAS) == 58 and names["oum el bouaghi"] == 4 and names["bejaia"] == 6 and names["وهران"] == 31 and names["m sila"] == names["msila"] == 28
    assert sum(len(v) for by in lexicons.CATEGORY_LEXICONS.values() for v in by.values()) > 200 and list(lexicons.CATEGORY_LEXICONS) == list(evidence.CATEGORY_PRIORS)
    key = X.match_key("Livraison à Oran, Wahran, Sétif et M'Sila. Cash on delivery")
    assert sorted(one(spark, evidence.wilayas_in(F.lit(key)))[0]) == [19, 28, 31]


PAGE = """<html><head><title>Boutique Nour</title><script>fbq('init','1'); connect.facebook.net/en/fbevents.js</script><link href="https://cdn.shopify.com/a.css"><script>Shopify.theme = {}</script></head>
<body><a href="https://wa.me/213550123456">WhatsApp</a><a href="https://www.instagram.com/nour.dz">ig</a><h1>Robes et abaya</h1><p>Vetements, robe, pantalon. Paiement à la livraison. Livraison Oran Alger Blida Batna Sétif. 2500 DA, 3500 DA</p>
<button>Ajouter au panier</button><a href="/checkout">Commander</a></body></html>"""


def test_from_page_to_queue(spark):
    """What a shop's page says leads through facts, gates, features and scores to a drafted message."""
    pages = spark.createDataFrame([(1, "https://nour.dz/", PAGE, 40), (2, "https://blog.example.net/", "<html><body>nothing sold here</body></html>", None)], "page_id long, url string, html string, n int")
    none = F.array().cast("array<double>")
    catalog = F.when(F.col("n").isNotNull(), U_catalog(F.col("n"), none))
    facts = outreach.site_facts(pages.withColumn("catalog", catalog), catalog="catalog", now=F.lit("2026-01-10").cast("timestamp"))
    got = {r["page_id"]: r for r in outreach.qualified(facts, F.lit(False), F.lit(False), F.lit(True)).collect()}
    shop, blog = got[1], got[2]
    assert (shop["platform"], shop["category"], shop["currency"], shop["language"], shop["products"], shop["median_price"]) == ("shopify", "fashion", "DZD", "fr", 40, 3000.0)
    assert sorted(shop["wilayas"]) == [5, 9, 16, 19, 31] and shop["cart"] and shop["checkout"] and shop["dz_host"] and shop["cod_weight"] == 3.6 and shop["channels"] == ["whatsapp", "instagram"]
    z = np.log(0.12 / 0.88) + 1.7 + 3.6 + 2.1 + (1.1 + 0.45) + 1.8 + 0.4
    assert abs(shop["p_market"] - 1 / (1 + np.exp(-min(8, z)))) < 1e-9 and shop["qualified"] and shop["reasons"] == ["all hard gates passed"] and shop["maturity"] > 40
    assert not blog["qualified"] and blog["reasons"][:2] == ["no contactable channel", "outside the market"]
    seen = {r["name"]: r["value"] for r in outreach.signals(facts).filter("page_id = 1").collect()}
    assert seen["contact:whatsapp"] == "+213550123456" and seen["market:wilaya_coverage"] == "5" and seen["platform:shopify"] == "shopify" and seen["adtech:meta_pixel"] == "meta_pixel"
    lead = facts.filter("page_id = 1").select(
        F.col("page_id").alias("id"), F.lit("Nour").alias("name"), F.lit(0.5).alias("sampled_p"), "platform", "category", F.lit("Oran").alias("wilaya"), ranking.preferred_channel(F.col("contacts")).alias("channel"),
        F.col("contacts")[0]["value"].alias("target"), F.array_contains("ad_tech", "meta_pixel").alias("advertiser"), "products", "language", F.array_contains("channels", "whatsapp").alias("has_whatsapp"), "maturity", "cod_weight",
    )
    features = evidence.feature_array(
        {
            "advertiser": F.col("advertiser"), "days_since_seen": F.lit(None).cast("double"), "ad_count": F.lit(0), "sells_cod": F.col("cod_weight") > 0, "whatsapp": F.col("has_whatsapp"), "channel": F.col("channel"), "platform": F.col("platform"),
            "category": F.col("category"), "maturity": F.col("maturity"), "products": F.col("products"), "pixel_meta": F.col("advertiser"), "pixel_tiktok": F.lit(False), "language": F.col("language"), "hour": F.lit(12), "warmup": F.lit(1.0),
        }
    )
    means = [m for _, m, _ in evidence.FEATURES]
    cov = [[s * s if i == j else 0.0 for j in range(len(means))] for i, (_, _, s) in enumerate(evidence.FEATURES)]
    scored = outreach.score(lead.withColumn("x", features), means, cov, 0, N.effort_seconds(F.col("channel"))).withColumn("score", F.col("ucb")).withColumn("policy", F.lit("ok"))
    row = outreach.work_queue(scored, 5).first()
    assert row["template_id"] == "first_contact.advertiser" and row["variant_id"].endswith(".fr") and row["sendable"] and row["link"].startswith("https://wa.me/213550123456?text=Bonjour%20Nour")
    assert len(row["explanation"]) == 4 and row["explanation"][0].startswith("P(reply)=0.")


def U_catalog(count, prices):
    return F.struct(count.alias("product_count"), F.lit(None).cast("double").alias("median_price"), F.lit(None).cast("string").alias("currency"), F.lit("2026-01-01").cast("timestamp").alias("latest"), F.lit("products_json").alias("source"))


def test_summaries(spark, capsys, sf_dir):
    got = one(spark, evidence.gate_summary(F.array(F.lit("suppressed"), F.lit("contact policy"))))[0].split("\n")
    assert [x[0] for x in got] == list("✓✓✓✗✓✗✓") and got[0] == "✓ contactable_channel"
    ways = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(v).alias("value"), F.lit(c).alias("confidence")) for k, v, c in [("email", "a", 0.5), ("email", "b", 0.6), ("phone", "c", 0.9)]))
    assert one(spark, ranking.best_of_kind(ways, "email"), ranking.best_of_kind(ways, "tiktok")) == ("b", None)
    facts = spark.createDataFrame([(1, 1, "k", "old", 0.5), (1, 2, "k", "new", 0.4), (2, 1, "k", "x", 0.4)], "lead_id int, observed_at int, key string, value string, confidence double")
    assert [[o["value"] for o in r["observations"]] for r in R.observations_of(facts, spark.createDataFrame([(1,), (1,), (3,)], "lead_id int")).collect()] == [["new", "old"]]
    assert command_line(["list"]) == 0 and "funnel_counts" in capsys.readouterr().out and command_line(["sources"]) == 0 and "manual_add" in capsys.readouterr().out


def test_demo_end_to_end(spark):
    """A synthetic population is ingested, and again: the second time makes no lead."""
    people = readers.demo_population(spark, 30)
    none = F.array().cast("array<string>")
    cand = people.select((F.col("id") + 1).alias("seq"), F.concat(F.lit("https://"), "domain").alias("url"), F.col("domain").alias("name"), F.array("phone").alias("phones"), none.alias("emails"), F.array().cast("array<struct<network:string,value:string>>").alias("handles"))
    first = readers.ingest(spark, cand, None, "demo_seed", "2026-01-05 10:00:00")
    assert first["leads"].filter("is_new").count() == 30
    known = first["observations"].filter("key like 'identity:%'").select("lead_id", F.substring("key", 10, 20).alias("type"), "value").distinct()
    again = readers.ingest(spark, cand, known, "demo_seed", "2026-01-06 10:00:00")
    assert again["leads"].filter("is_new").count() == 0 and again["leads"].count() == 30
