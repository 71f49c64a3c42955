from pyspark.sql import functions as F

from tamarind.functions import fingerprints as P
from tamarind.operators import outreach
from tamarind.plans.register import register


def test_rules_compile_and_find(spark):
    assert len(P.PLATFORM_RULES) == 46 and len(P.AD_RULES) == 13
    shop = "<html><title>Boutique</title><script src='https://cdn.shopify.com/x.js'></script><script>Shopify.theme={}; fbq('init','1')</script><body>Paiement à la livraison 2500 DA <a href='https://wa.me/213550123456'>w</a>"
    woo = '<meta name="generator" content="WooCommerce 8.1"><link href="/wp-content/plugins/woocommerce/a.css">'
    pages = spark.createDataFrame([(1, "https://a.dz/", shop, {}), (2, "https://b.dz/", woo, {}), (3, "https://c.dz/", "", {"x-wix-request-id": "9"}), (4, None, None, None)], "page_id int, url string, html string, headers map<string,string>")
    got = {r["page_id"]: r for r in outreach.site_facts(pages, headers="headers").collect()}
    assert (got[1]["platform"], got[1]["currency"], got[1]["ad_tech"], got[1]["contacts"][0]["value"]) == ("shopify", "DZD", ["meta_pixel"], "+213550123456")
    assert got[1]["cod_weight"] == 3.6 and got[2]["platform"] == "woocommerce" and got[3]["platform"] == "wix" and got[4]["platform"] == "none"


def test_registered_functions(spark):
    names = register(spark)
    assert "match_key" in names
    row = spark.sql("SELECT match_key('Éa!') AS k, canonical_url('http://WWW.a.dz/?utm_x=1') AS u, round(beta_quantile(0.05D, 1D, 1D), 6) AS q").first()
    assert tuple(row) == ("ea", "http://a.dz/", 0.05)
    assert spark.sql("SELECT value FROM page_contacts('<a href=\"mailto:a@b.dz\">x</a>')").first()[0] == "a@b.dz"
    assert spark.sql("SELECT cells['b'] FROM csv_rows('a,b\n1,2')").first()[0] == "2"


def test_simulation_beats_uniform():
    made = outreach.simulate(sends=400, merchants=200)
    assert made["uplift"] > 1 and made == outreach.simulate(sends=400, merchants=200)


def test_streams_equal_folds(spark, tmp_path):
    from tamarind.operators.temporal import fold_states, token_bucket
    from tamarind.streaming.counters import bucket_stream, lifecycle_stream

    rows = [(i % 7, i, ["replied", "lost", "interested", "paid", "stop"][(i * 3) % 5]) for i in range(60)]
    df = spark.createDataFrame(rows, "lead int, k int, stage string")
    df.orderBy(F.desc("k")).write.parquet(f"{tmp_path}/o")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/o")
    run = lifecycle_stream(stream, "lead", "stage", ["k"]).writeStream.outputMode("update").format("memory").queryName("life").trigger(availableNow=True).start()
    run.awaitTermination()
    want = {r["lead"]: r["state"] for r in fold_states(df, "lead", "stage", ["k"]).collect()}
    assert {r["lead"]: r["state"] for r in spark.table("life").collect()} == want
    asks = spark.createDataFrame([("a", 0.0), ("a", 0.0), ("a", 0.5), ("b", 1.0)], "domain string, at double")
    asks.write.parquet(f"{tmp_path}/r")
    run = bucket_stream(spark.readStream.schema(asks.schema).parquet(f"{tmp_path}/r"), "domain", "at").writeStream.outputMode("append").format("memory").queryName("go").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(r["go"] for r in spark.table("go").filter("domain = 'a'").collect()) == token_bucket([0.0, 0.0, 0.5])
