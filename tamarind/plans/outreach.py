"""Composite queries: site facts, the scored work queue and what outcomes change."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamarind.functions import fingerprints as P
from tamarind.functions import numeric as N
from tamarind.operators import evidence, outreach
from tamarind.plans import models
from tamarind.plans import tables as T

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query()
def site_facts(spark, d):
    found = outreach.site_facts(T.read(spark, d, "pages"))
    return found.select(
        "page_id", "platform", F.round("platform_probability", 6).alias("probability"), F.array_join("ad_tech", " ").alias("ad_tech"), F.size("contacts").alias("contacts"), "language", "currency",
        F.round("p_market", 6).alias("p_market"), F.round("p_sells", 6).alias("p_sells"), "category", "maturity", "n_chars",
    )


@query()
def page_qualification(spark, d):
    """Pages from facts through market, category and maturity to the gates."""
    facts = outreach.site_facts(T.read(spark, d, "pages"))
    no = F.lit(False)
    made = outreach.qualified(facts, no, no, F.lit(True))
    return made.select("page_id", "qualified", F.array_join("reasons", "; ").alias("reasons"))


_ADS = " || ' ' || ".join("CASE WHEN regexp_matches(html, '(?i)" + p.replace("'", "''") + f"') THEN '{i}' ELSE '' END" for i, p, _ in P.AD_RULES)


@query(f"SELECT page_id, trim(regexp_replace({_ADS}, ' +', ' ', 'g')) AS ad_tech FROM pages")
def ad_tech(spark, d):
    ads = F.filter(F.array(*(F.when(F.col("html").rlike(f"(?i){p}"), F.lit(i)) for i, p, _ in P.AD_RULES)), lambda x: x.isNotNull())
    return T.read(spark, d, "pages").select("page_id", F.array_join(ads, " ").alias("ad_tech"))


def _queue(spark, d):
    profile = models._profile(spark, d).select("id", "name", F.col("lead_platform").alias("platform"), F.col("lead_category").alias("category"), "wilaya", "channel", F.coalesce("products", F.lit(0)).alias("products"), "x")
    names = [m for _, m, _ in evidence.FEATURES]
    cov = [[s * s if i == j else 0.0 for j in range(len(names))] for i, (_, _, s) in enumerate(evidence.FEATURES)]
    scored = outreach.score(profile, names, cov, 0, N.effort_seconds(F.col("channel")))
    i = F.col("id")
    return scored.withColumns(
        {
            "score": F.col("ucb"), "sampled_p": F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0, "advertiser": i % 4 == 0, "language": F.when(i % 3 == 0, "fr").when(i % 3 == 1, "ar_dz").otherwise("mixed"), "has_whatsapp": F.col("channel") == "whatsapp",
            "target": F.when(F.col("channel") == "whatsapp", F.concat(F.lit("+2135"), F.lpad((i % 100_000_000).cast("string"), 8, "0"))).when(F.col("channel") == "email", F.concat(F.lit("m"), i, F.lit("@shop.dz"))).otherwise(F.concat(F.lit("shop"), i)),
        }
    )


@query()
def work_queue(spark, d):
    """Twenty leads with rank, priority, template, message and link."""
    made = outreach.work_queue(_queue(spark, d), 20)
    return made.select("rank", "id", F.round("priority", 6).alias("priority"), "exploration", "template_id", "variant_id", "body", "link", "sendable")


@query(f"""WITH s AS (SELECT lead_id, CASE WHEN id % 97 = 0 THEN 'stop' ELSE stage END AS stage FROM ({T.OUTCOMES_SQL}))
SELECT 'lead' AS type, lead_id::VARCHAR AS value, 'stop' AS reason FROM s WHERE stage = 'stop' GROUP BY lead_id
UNION ALL SELECT 'phone', '+213' || lead_id, 'stop' FROM s WHERE stage = 'stop' GROUP BY lead_id""")
def outcome_suppressions(spark, d):
    rows = T.outcomes(spark, d).withColumns({"stage": F.when(F.col("id") % 97 == 0, "stop").otherwise(F.col("stage")), "variant_id": F.col("id") % 5})
    ids = rows.select("lead_id").distinct().select("lead_id", F.lit("phone").alias("type"), F.concat(F.lit("+213"), "lead_id").alias("value"))
    return outreach.after_outcomes(rows, ids)["suppression"]
