"""Worked numbers and edge cases of single operators."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamarind.functions import messaging as M
from tamarind.functions import numeric as N
from tamarind.functions import text as X
from tamarind.functions import web as U
from tamarind.operators import bandit, calibration, evidence, funnel, resolve, temporal
from tamarind.sources import readers


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_numeric(spark):
    low, high, _ = N.wilson(F.lit(1), F.lit(10))
    assert np.allclose(one(spark, low, high), (0.017876, 0.404150), atol=1e-6)
    assert one(spark, *N.wilson(F.lit(0), F.lit(0))) == (0.0, 1.0, 0.5)
    a, b = N.pooled(F.lit(5.0), F.lit(10.0), F.lit(0.2), F.lit(20.0))
    assert abs(one(spark, N.beta_mean(a, b))[0] - 0.306452) < 1e-6
    assert one(spark, N.clamp(F.lit(float("nan")), 0.0, 1.0), N.clamp(F.lit(None).cast("double"), 0.0, 1.0)) == (0.0, None)
    ev = N.expected_value(*(F.lit(p) for p in (0.12, 0.5, 0.4, 0.6, 0.3)))
    assert np.allclose(one(spark, ev, N.priority(ev, F.lit(12.0))), (11.65104, 0.970920))
    assert np.allclose(one(spark, N.softmax(F.array(F.lit(0.0), F.lit(float("inf")), F.lit(0.0))))[0], [0.5, 0.0, 0.5])
    assert [round(one(spark, N.ucb(F.lit(0.0), F.lit(1.0), F.lit(float(n))))[0], 6) for n in (0, 30, 300)] == [1.0, 0.707107, 0.301511]


def test_beta_quantile():
    assert abs(N.beta_quantile(0.05, 1, 1) - 0.05) < 1e-9
    assert abs(N.beta_quantile(0.5, 3, 3) - 0.5) < 1e-9
    for a, b in ((2, 5), (0.5, 0.5), (300, 20)):
        assert abs(N.beta_cdf(N.beta_quantile(0.05, a, b), a, b) - 0.05) < 1e-9


@pytest.mark.parametrize(("wins", "want"), [((5, 50, 95), 0.25), ((50, 51, 49), 0.0)])
def test_kappa(spark, wins, want):
    df = spark.createDataFrame([(w, 100) for w in wins], "s int, n int")
    p = sum(wins) / 300
    between = np.var([w / 100 for w in wins], ddof=1) - p * (1 - p) / 100
    got = df.agg(funnel.kappa(df, F.col("s"), F.col("n")).alias("k")).first()["k"]
    assert abs(got - (p * (1 - p) / between - 1 if between > 1e-9 else 0)) < 1e-9
    assert round(got, 2) == want


def test_daily_cap(spark):
    rows = spark.range(15).select(temporal.daily_cap(F.col("id"), 40).alias("c")).collect()
    assert [r["c"] for r in rows] == [10, 10, 10, 11, 12, 15, 19, 24, 30, 34, 36, 38, 39, 39, 40]


def test_cusum_equals_the_fold(spark):
    rng = np.random.default_rng(3)
    rows = [("a", f"d{i:02}", int(rng.integers(0, 9)), int(rng.integers(0, 4))) for i in range(40)]
    got = temporal.cusum(spark.createDataFrame(rows, "g string, d string, s int, r int"), ["g"], "d", "s", "r", 0.4).orderBy("d").collect()
    s, alarm, want = 0.0, False, []
    for _, d, n, r in rows:
        if n:
            s = max(0.0, s + (0.4 - r / n) / 0.4 - 0.25)
            alarm |= s > 2.0
            want.append((d, s, alarm))
    assert [(r["d"], r["alarm"]) for r in got] == [(d, a) for d, _, a in want]
    assert np.allclose([r["cusum"] for r in got], [x for _, x, _ in want])


def test_fusion(spark):
    keys = spark.createDataFrame([(1,), (2,)], "k int")
    rows = spark.createDataFrame([(1, "shopify", 4.6, "header"), (1, "shopify", 4.6, "header"), (1, "unknown", 9.0, "x")], "k int, hypothesis string, log_lr double, cluster string")
    got = {r["k"]: r for r in evidence.fuse(rows, "k", evidence.PLATFORM_PRIORS, {"wordpress": -2.3}, keys=keys).collect()}
    assert got[1]["best"] == "shopify" and abs(got[1]["probability"] - 0.978675) < 2e-3
    assert got[2]["best"] == "shopify" and got[2]["abstained"] and abs(got[2]["probability"] - 0.337672) < 2e-3
    assert abs(sum(got[1]["probabilities"]) - 1) < 1e-9


def test_weights():
    want = {"domain": (7.088788, -1.128695), "phone": (8.366322, -0.725647), "whatsapp": (7.799282, -0.633454), "email": (8.536247, -0.507249), "handle": (7.562242, -0.772288), "name": (0.822002, -0.511714), "wilaya": (1.781360, -0.900464), "category": (1.584963, -1.0)}
    for k, v in want.items():
        assert np.allclose(resolve.weights(k), v, atol=1e-5)


def test_resolution_quality(spark):
    rows, truth = [], []
    for i in range(20):
        base = dict(name=f"Boutique Nour {i}x", domain=f"nour{i}.dz", phones=[f"+2135500000{i:02}", f"+2135600000{i:02}"], wilaya="Oran", category="fashion")
        rows += [(2 * i, base["name"], base["domain"], base["phones"], [], [], "Oran", "fashion"), (2 * i + 1, base["name"].upper(), base["domain"], base["phones"], [], [], "Oran", "fashion")]
        truth.append((2 * i, 2 * i + 1))
    rows += [(100 + i, f"Solo Magasin{i}", f"solo{i}.com", [f"+2136600000{i:02}"], [], [], "Alger", "auto") for i in range(20)]
    df = spark.createDataFrame(rows, "id long, name string, domain string, phones array<string>, emails array<string>, handles array<string>, wilaya string, category string")
    made, groups = resolve.resolve(df)
    merged = made.filter("decision = 'auto_merge'")
    q = calibration.pair_quality(merged, spark.createDataFrame(truth, "left_id long, right_id long")).first()
    assert q["precision"] >= 0.95 and q["recall"] >= 0.90
    assert groups.groupBy("cluster_id").count().count() == 20
    rebrand = spark.createDataFrame([(1, "Old Name Shop", "old.dz", ["+213550000001", "+213550000002"], ["a@b.dz"], [], None, None), (2, "Old Name Shop", "new.dz", ["+213550000001", "+213550000002"], ["a@b.dz"], [], None, None)], df.schema)
    assert [r["decision"] for r in resolve.resolve(rebrand)[0].collect()] == ["review"]


def test_urls_and_phones(spark):
    assert U.canonical_url("https://WWW.Example.COM/Product/1/?utm_source=fb&fbclid=abc&b=2&a=1#section") == "https://example.com/Product/1?a=1&b=2"
    assert U.canonical_url("ftp://x") is None and U.canonical_url("/a//b", "http://h.dz:80/") == "http://h.dz/a/b"
    assert U.registrable("a.b.shop.com.dz") == "shop.com.dz"
    spelled = ["0550123456", "+213 550 12 34 56", "00213550123456", "213550123456", "٠٥٥٠١٢٣٤٥٦", "0550-12.34(56)"]
    df = spark.createDataFrame([(s,) for s in [*spelled, "12345", "+33612345678", None]], "s string")
    assert [r[0] for r in df.select(U.phone(F.col("s"), mobile=True)).collect()] == ["+213550123456"] * 6 + [None] * 3
    assert U.handle("https://instagram.com/Shop.dz/") == ("instagram", "shop.dz") and U.handle("https://instagram.com/p/abc") is None
    assert U.blocked_ip("10.1.2.3") and U.blocked_ip("::1") and U.blocked_ip("x") and not U.blocked_ip("8.8.8.8")


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_normalisation_is_idempotent(text):
    assert X.match_key(X.match_key(text)) == X.match_key(text)
    assert X.normalize_text(X.normalize_text(text)) == X.normalize_text(text)


@settings(max_examples=150, deadline=None)
@given(st.from_regex(r"https?://[a-z]{1,8}\.(com|dz)(/[a-zA-Z0-9 _-]{0,5}){0,3}(\?[a-z]{1,3}=[a-zA-Z0-9]{0,3}(&[a-z]{1,3}=[a-z%0-9]{0,3})?)?", fullmatch=True))
def test_canonical_url_is_idempotent(url):
    made = U.canonical_url(url)
    assert made is not None and U.canonical_url(made) == made


def test_text(spark):
    assert X.match_key("  École  Nº1, «Café»! ") == "ecole no1 «cafe»"
    assert X.match_key("مَتْجَرُ الأحذيةِ ٣") == "متجر الاحذيه 3"
    assert abs(X.jaro_winkler("abcdefgh", "abcdxyzw") - 0.8) < 1e-9 and X.jaro_winkler("", "a") == 0 and X.jaro_winkler("a", "a") == 1
    df = spark.createDataFrame([("واش راك بزاف تاع",), ("bonjour merci pour la livraison",), ("hello thanks for the order",), ("",)], "t string")
    rows = X.with_language(df.withColumn("k", X.match_key_of("t")), "t", "k").collect()
    assert [r["language"] for r in rows] == ["ar_dz", "fr", "en", "mixed"]


def test_html():
    page = """<html><head><title>Shop</title><meta name='description' content='Best'><script>var t='0660 11 22 33'</script></head><body><header><a href="https://wa.me/213550123456">chat</a></header><h1>Hello</h1>""" + "x" * 900
    page += """<a href='/product/1'>Robe</a><p>mail a@b.dz noreply@b.dz<b>broken<div class="chat-widget"><a href="tel:0550 99 88 77">t</a></div><a href="https://www.instagram.com/My.Shop/">i</a>see https://www.facebook.com/thepage<footer><a href="mailto:X@y.dz?s=1">m</a></footer></body>"""
    got = U.contacts(page)
    assert got == [
        ("whatsapp", "+213550123456", 0.95, "header"), ("instagram", "my.shop", 0.85, "body"), ("phone", "+213550998877", 0.8, "floating"), ("facebook", "thepage", 0.75, "body"),
        ("phone", "+213660112233", 0.7, "body"), ("email", "x@y.dz", 0.6, "footer"), ("email", "a@b.dz", 0.55, "body"),
    ]
    assert U.text_corpus(page).split("\n")[:3] == ["Shop", "Best", "Hello"]
    assert U.contacts(None) == [] and U.text_corpus("") == ""


def test_handles():
    assert U.handle("https://m.facebook.com/profile.php?id=1234567") == ("facebook", "page_id:1234567") and U.handle("https://facebook.com/pages/Shop/9") == ("facebook", "shop")
    assert U.handle("https://api.whatsapp.com/send?phone=213550123456") == ("whatsapp", "+213550123456") and U.handle("https://chat.whatsapp.com/abc") is None
    assert U.handle("https://tiktok.com/@A.b") == ("tiktok", "a.b") and U.handle("https://instagram.com/tv") is None and U.handle("https://instagr.am/x") == ("instagram", "x")
    assert U.handle("@shop.dz", "instagram") == ("instagram", "shop.dz") and U.handle("m.me/99887766") == ("messenger", "99887766") and U.handle("https://x.dz/a") is None
    assert U.profile_url("facebook", "page_id:123456") == "https://www.facebook.com/profile.php?id=123456" and U.profile_url("tiktok", "a") == "https://www.tiktok.com/@a"


def test_url_parts():
    assert U.canonical_url("http://a.dz/?source=shop&si=1&trk=2&b=1&igsh=3&campaign=4") == "http://a.dz/?b=1&source=shop&trk=2"
    assert U.canonical_url("http://a.dz/é/../b c?q=a b~*") == "http://a.dz/b%20c?q=a+b%7E*" and U.canonical_url("http://a b.dz/") is None
    assert U.urls_of("see shop.dz/x and https://b.com/?ref=1). Also https://b.com/") == ["https://b.com/", "https://shop.dz/x"]
    assert U.same_site("http://www.a.dz/x", "https://a.dz") and not U.same_site("http://b.a.dz", "http://a.dz") and U.same_registrable("http://b.a.dz", "http://a.dz") and not U.same_site("x", "x")
    assert U.shop_subdomain("nour.youcan.shop") and not U.shop_subdomain("youcan.shop") and len(U.TRACKING) == 34


def test_catalogues(spark):
    shop = '{"products":[{"updated_at":"2026-01-02T00:00:00+01:00","variants":[{"price":"1500.0"},{"price":"0"}]},{"published_at":"2026-02-01T00:00:00Z","variants":[{"price":"20"}]}]}'
    woo = '[{"prices":{"price":"350000","currency_code":"DZD"},"date_created":"2026-01-01T10:00:00"},{"price":"450000","date_modified":"a"}]'
    xml = "<url><loc>https://s.dz/product/1</loc></url><url><loc>https://s.dz/about</loc></url><url><loc> https://s.dz/boutique/2 </loc></url><loc>https://s.dz/products.json</loc><lastmod>2026-01-02</lastmod>"
    a, b, c, d = one(spark, U.first_json_catalog(F.lit(shop)), U.woo_catalog(F.lit(woo)), U.sitemap_products(F.lit(xml)), U.sitemap_catalog(F.lit(xml)))
    assert (a["count"], a["prices"], a["currency"], a["latest"]) == (2, [1500.0, 20.0], "DZD?", dt.datetime(2026, 2, 1))
    assert (b["count"], b["prices"], b["currency"], b["latest"]) == (2, [350000.0, 450000.0], "DZD", dt.datetime(2026, 1, 1, 10))
    assert c == ["https://s.dz/product/1", "https://s.dz/boutique/2"] and (d["count"], d["latest"]) == (2, dt.datetime(2026, 1, 2))
    assert one(spark, U.first_json_catalog(F.lit('{"x": 1}')), U.first_json_catalog(F.lit("no"))) == (None, None)
    html = "<b>2 500 DA</b> 3.900 دج, 50 da, 600000 DZD, 1250,50 dinars dalle"
    assert one(spark, U.html_prices(F.lit(html)))[0] == [2500.0, 3900.0, 1250.5]
    made = one(spark, U.merged_catalog({"json": F.when(F.lit(False), U.html_catalog(F.lit(""))), "woo": U.woo_catalog(F.lit(woo)), "html": U.html_catalog(F.lit(html))}), U.merged_catalog({"html": U.html_catalog(F.lit("nothing"))}))
    assert made[0].asDict() == {"product_count": 2, "median_price": 400000.0, "currency": "DZD", "latest": dt.datetime(2026, 1, 1, 10), "source": "woo"}
    assert made[1]["source"] == "none" and made[1]["median_price"] is None
    days = one(spark, U.freshness_days(F.lit("2026-01-01").cast("timestamp"), F.lit("2026-01-11 12:00:00").cast("timestamp")), U.freshness_days(F.lit(None).cast("timestamp"), F.lit("2026-01-01").cast("timestamp")))
    assert days == (10.5, None)


def test_messages(spark):
    df = spark.createDataFrame([("Salut {nom}? ok?",), ("voir https://x.dz",), ("Cliquez ici promo",), ("Bonjour",)], "b string")
    errors, warnings = M.lint(F.col("b"), X.match_key_of("b"), F.lit(True))
    rows = [(list(r[0]), list(r[1])) for r in df.select(errors, warnings).collect()]
    assert rows[0][0] == ["unresolved slots", "more than one question"] and rows[1][0] == ["URL in first contact"]
    assert rows[2] == (["blocked: cliquez ici"], ["check: promo"]) and rows[3] == ([], [])
    assert one(spark, M.percent_encoded(F.lit(" !'()*~-._é")))[0] == "%20!'()*~-._%C3%A9"
    assert one(spark, M.render(F.lit("{Name} costs {p} {x}"), {"name": F.lit("A$1\\"), "p": F.lit(None)}))[0] == "A$1\\ costs {p} {x}"


def test_policy_and_time(spark):
    friday = F.lit("2026-01-09 12:00:00").cast("timestamp_ntz")
    assert one(spark, temporal.friday_blackout(friday), temporal.quiet_hours(F.lit("2026-01-09 21:30:00").cast("timestamp_ntz"))) == (True, True)
    nxt = one(spark, temporal.next_run_at(F.lit("1d@03:30"), F.lit("2026-01-05 10:00:00").cast("timestamp_ntz")))[0]
    assert nxt == dt.datetime(2026, 1, 6, 2, 30)
    assert temporal.token_bucket([0, 0, 0, 0]) == [0, 0, 2, 4]


def test_bandit(spark):
    assert one(spark, bandit.dead(F.lit(60), F.lit(0), F.lit(False)), bandit.dead(F.lit(61), F.lit(0), F.lit(False)), bandit.dead(F.lit(1), F.lit(1), F.lit(True))) == (False, True, True)
    a = spark.range(50).select(bandit.draw(F.lit(2.0), F.lit(3.0), F.col("id"), 1).alias("x")).collect()
    b = spark.range(50).repartition(7).orderBy("id").select(bandit.draw(F.lit(2.0), F.lit(3.0), F.col("id"), 1).alias("x")).collect()
    assert a == b and 0.3 < np.mean([r["x"] for r in a]) < 0.5


def test_sources(spark, tmp_path):
    rows, ragged = readers.parse_csv('URL,Name\nhttp://a.dz,"A, B"\nbad\n\nhttp://b.dz,C\n')
    assert rows == [{"url": "http://a.dz", "name": "A, B"}, {"url": "http://b.dz", "name": "C"}] and ragged == 1
    (tmp_path / "x.csv").write_text("Website,Tel\nhttp://a.dz,0550\n")
    assert [tuple(r) for r in readers.csv_imported(spark, str(tmp_path / "x.csv")).collect()] == [("http://a.dz", None, "0550", None, None)]
    blob = spark.createDataFrame([("see https://a.dz/x and https://b.dz call 0550 12 34 56",), ("only me@shop.dz",)], "text string")
    got = readers.pasted(blob).collect()
    assert sorted((r["url"] or "", tuple(r["phones"]), tuple(r["emails"])) for r in got) == [("https://a.dz/x", ("+213550123456",), ()), ("https://b.dz/", ("+213550123456",), ()), ("https://shop.dz/", (), ("me@shop.dz",))]
    social = readers.pasted(spark.createDataFrame([("Nour | boutique nour.dz https://www.instagram.com/nour.dz",), ("nothing",)], "text string")).collect()
    assert {r["url"]: [tuple(h) for h in r["handles"]] for r in social}["https://nour.dz/"] == [("instagram", "nour.dz")] and {r["url"]: r["name"] for r in social}["https://nour.dz/"].startswith("Nour")
    assert [r["url"] for r in social if r["url"] is None] == [None]
    by_hand = readers.added(spark, "http://www.a.dz/?ref=1", "A", ["0550 12 34 56", "x"], ["M@a.dz"], [("instagram", "a")]).first()
    assert (by_hand["url"], by_hand["phones"], by_hand["emails"]) == ("http://a.dz/", ["+213550123456"], ["m@a.dz"])
    assert [r["url"] for r in readers.fixed_results(spark, [("https://www.jumia.com.dz/x", "j"), ("https://a.dz/?utm_x=1", "a"), ("https://a.dz/", "b")]).collect()] == ["https://a.dz/"]
    assert readers.demo_population(spark, 5).collect() == readers.demo_population(spark, 5).collect()
    with pytest.raises(KeyError):
        readers.source("nope")
    assert len(readers.REGISTRY) == 11 and any("disabled" in x for x in readers.described())
    site = [("http://a.dz/", "<a href='/x'>x</a><a href='/y'>y</a><a href='http://c.dz/'>out</a><a href='https://linktr.ee/a'>b</a><a href='https://instagram.com/a_shop'>i</a>"), ("http://a.dz/x", "<a href='/deep'>d</a><a href='https://facebook.com/afb'>f</a><a href='https://instagram.com/A_shop'>i</a>"), ("https://linktr.ee/a", "<a href='https://tiktok.com/@at'>t</a>")]
    pages = spark.createDataFrame(site, "url string, html string")
    found, socials = readers.crawl(spark.createDataFrame([("http://a.dz",)], "url string"), pages)
    assert {r["url"] for r in found.filter("depth = 1").collect()} == {"http://a.dz/contact", "http://a.dz/contact-us", "http://a.dz/pages/contact", "http://a.dz/x", "http://a.dz/y", "http://a.dz/sitemap.xml", "https://linktr.ee/a"}
    assert {(r["network"], r["value"], r["url"]) for r in socials.collect()} == {("instagram", "a_shop", "http://a.dz/"), ("facebook", "afb", "http://a.dz/x"), ("tiktok", "at", "https://linktr.ee/a")}


def test_saved_responses(spark):
    one_row = lambda body: spark.createDataFrame([(body,)], "body string")
    brave = one_row('{"web":{"results":[{"url":"https://a.dz/?utm_source=x","title":"A"},{"url":"https://www.amazon.com/x","title":"no"}]}}')
    assert [tuple(r) for r in readers.search_results(brave, "brave").collect()] == [("https://a.dz/", "A")]
    held = one_row('{"places":[{"websiteUri":"http://a.dz","displayName":{"text":"A"},"nationalPhoneNumber":"0550 12 34 56"}]}')
    assert [tuple(r) for r in readers.places(held).collect()] == [("http://a.dz/", "A", ["+213550123456"])]
    ads = one_row('{"data":[{"page_id":"1","page_name":"P","ad_delivery_start_time":"2026-01-01"},{"page_id":"1","page_name":"P"},{"page_name":"none"}]}')
    assert [tuple(r) for r in readers.ad_library(ads, "2026-02-01").collect()] == [("1", "P", 2, dt.datetime(2026, 1, 1))]
    with pytest.raises(Exception, match="expired"):
        readers.ad_library(one_row('{"error":{"message":"expired"}}'), "2026-02-01").collect()
    queries = spark.createDataFrame([(i, f"q{i}") for i in range(5)], "n int, query string")
    assert sorted((r["provider"], r["n"]) for r in readers.affordable(queries, {"brave": 2, "cse": 0}, ["n"]).collect()) == [("brave", 0), ("brave", 1)]
    places = spark.createDataFrame([("Oran",), ("Alger",)], "wilaya string")
    made = readers.generate_queries(spark, ["fr"], places, {"fr": ["robe", "jean", "sac"]}, most=6, footprint="youcan.shop", extra=["own"], first_terms=2)
    assert sorted(r["query"] for r in made.collect()) == ["jean Alger", "jean Alger inurl:youcan.shop", "robe Alger", "robe Alger inurl:youcan.shop", "robe Oran", "robe Oran inurl:youcan.shop"]


def test_ingest(spark):
    rows = [(1, "https://www.a.dz/?utm_x=1", "A", ["0550123456", "021 12 34 56"], ["M@a.dz"], [("instagram", "Shop")], {"is_advertiser": True, "vip": False}), (2, None, "B", ["0550123456"], [], [], None), (3, None, "none", [], [], [], None)]
    df = spark.createDataFrame(rows, "seq long, url string, name string, phones array<string>, emails array<string>, handles array<struct<network:string,value:string>>, annotations map<string,boolean>")
    made = readers.ingest(spark, df, None, "manual_paste", "2026-01-05 10:00:00")
    assert {r["seq"]: (r["lead_id"], r["is_new"]) for r in made["leads"].collect()} == {1: (1, True), 2: (1, False)}
    seen = [(r["key"], r["value"], r["confidence"]) for r in made["observations"].collect()]
    assert sorted(seen) == sorted([
        ("identity:domain", "a.dz", 0.85), ("identity:etld1", "a.dz", 0.6), ("identity:whatsapp", "+213550123456", 0.9), ("identity:phone", "+21321123456", 0.9), ("identity:email", "m@a.dz", 0.9),
        ("identity:instagram", "shop", 0.8), ("url:primary", "https://www.a.dz/?utm_x=1", 0.95), ("advertiser:flag", "true", 0.9), ("annotation:vip", "false", 0.9), ("advertiser:first_seen", "2026-01-05 10:00:00", 0.9),
        ("identity:whatsapp", "+213550123456", 0.9),
    ])
    assert made["audit"].count() == 2


def test_upsert_in_order(spark):
    cand = [(1, [("domain", "a.dz"), ("phone", "1")]), (2, [("phone", "1"), ("email", "e")]), (3, [("email", "e")]), (4, [("domain", "k.dz"), ("phone", "9")]), (5, [("phone", "9")]), (6, []), (7, [("domain", "a.dz"), ("domain", "k.dz")])]
    df = spark.createDataFrame(cand, "seq long, identities array<struct<type:string,value:string>>")
    known = spark.createDataFrame([(-50, "domain", "k.dz")], "lead_id long, type string, value string")
    got = {r["seq"]: (r["lead_id"], r["is_new"]) for r in readers.upsert_candidates(spark, df, known).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (1, False), 4: (-50, False), 5: (-50, False), 7: (1, False)}
