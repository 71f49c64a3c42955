"""Relational, funnel and erasure queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamarind.functions import numeric as N
from tamarind.operators import funnel, ranks, relational as R
from tamarind.plans import tables as T
from tamarind.session import stage

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"SELECT stage, count(*) AS n FROM ({T.OUTCOMES_SQL}) GROUP BY stage")
def funnel_counts(spark, d):
    return R.count_by(T.outcomes(spark, d), "stage")


@query(f"""SELECT s.status, count(a.id) AS n FROM (VALUES ('drafted'), ('sent_by_human'), ('skipped'), ('failed'), ('queued')) s(status)
LEFT JOIN ({T.ATTEMPTS_SQL}) a ON a.status = s.status GROUP BY s.status""")
def lead_state_counts_zero_fill(spark, d):
    return R.count_by(T.attempts(spark, d), "status", ["drafted", "sent_by_human", "skipped", "failed", "queued"])


@query(f"SELECT lead_id, stage, id, value FROM (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY occurred_at DESC, id DESC) k FROM ({T.OUTCOMES_SQL})) WHERE k = 1")
def latest_event_per_user(spark, d):
    rows = T.outcomes(spark, d).select("lead_id", "stage", "id", "value", "occurred_at")
    return R.latest_per_key(rows, ["lead_id"], [F.col("occurred_at"), F.col("id")]).drop("occurred_at")


@query(f"SELECT id, name, priority FROM ({T.LEADS_SQL}) ORDER BY priority DESC NULLS FIRST, id LIMIT 50")
def top_leads_by_priority(spark, d):
    rows = T.leads(spark, d).select("id", "name", "priority")
    return R.top(rows, [F.desc_nulls_first("priority"), F.col("id")], 50)


@query(f"""SELECT template_id, count(*) FILTER (WHERE status = 'drafted') AS drafted, count(*) FILTER (WHERE status = 'sent_by_human') AS sent
FROM (SELECT * FROM ({T.ATTEMPTS_SQL}) ORDER BY created_at DESC, id DESC LIMIT 200) GROUP BY template_id""")
def attempt_template_stats(spark, d):
    last = R.top(T.attempts(spark, d), [F.desc("created_at"), F.desc("id")], 200)
    return last.groupBy("template_id").agg(F.count_if(F.col("status") == "drafted").alias("drafted"), F.count_if(F.col("status") == "sent_by_human").alias("sent"))


@query(f"SELECT id, lead_id, stage FROM ({T.OUTCOMES_SQL}) WHERE occurred_at >= (SELECT max(ts) - INTERVAL 7 DAY FROM events)")
def outcomes_since(spark, d):
    rows = T.outcomes(spark, d)
    since = rows.agg((F.max("occurred_at") - F.expr("INTERVAL '7' DAY")).alias("m")).first()["m"]
    return rows.filter(F.col("occurred_at") >= F.lit(since).cast("timestamp_ntz")).select("id", "lead_id", "stage")


SUPPRESSED = f"SELECT DISTINCT lead_id AS id FROM ({T.ATTEMPTS_SQL}) WHERE status = 'skipped'"


def _suppressed(spark, d):
    return T.attempts(spark, d).filter("status = 'skipped'").select(F.col("lead_id").alias("id"))


@query(f"SELECT id, name FROM ({T.LEADS_SQL}) WHERE id IN ({SUPPRESSED})")
def suppressed_semi(spark, d):
    return R.matching(T.leads(spark, d).select("id", "name"), _suppressed(spark, d), ["id"])


@query(f"SELECT id, name FROM ({T.LEADS_SQL}) WHERE id NOT IN ({SUPPRESSED})")
def unsuppressed_anti(spark, d):
    return R.matching(T.leads(spark, d).select("id", "name"), _suppressed(spark, d), ["id"], keep=False)


@query(f"""SELECT o.id, o.lead_id, o.stage, coalesce(l.platform, 'none') AS platform, coalesce(l.category, 'other') AS category, coalesce(o.channel, 'whatsapp') AS channel
FROM ({T.OUTCOMES_SQL}) o JOIN ({T.LEADS_SQL}) l ON o.lead_id = l.id""")
def outcome_lead_join(spark, d):
    return _joined(spark, d).select("id", "lead_id", "stage", "platform", "category", "channel")


def _joined(spark, d):
    leads = T.leads(spark, d).select(F.col("id").alias("lead_id"), "platform", "category")
    return T.outcomes(spark, d).join(leads, "lead_id").withColumns(
        {"platform": F.coalesce("platform", F.lit("none")), "category": F.coalesce("category", F.lit("other")), "channel": F.coalesce("channel", F.lit("whatsapp"))}
    )


@query("SELECT o_orderkey AS lead_id, l_linenumber AS line, l_discount AS feature, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P'")
def training_fanout_join(spark, d):
    o, x = T.read(spark, d, "orders"), T.read(spark, d, "lineitem")
    rows = o.filter("o_orderstatus <> 'P'").select("o_orderkey", "o_orderstatus").join(x.select("l_orderkey", "l_linenumber", "l_discount"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select(F.col("o_orderkey").alias("lead_id"), F.col("l_linenumber").alias("line"), F.col("l_discount").alias("feature"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))


@query("""SELECT lead_id, feature, y FROM (SELECT o_orderkey AS lead_id, l_discount AS feature, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y,
row_number() OVER (PARTITION BY o_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_discount DESC) k
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P') WHERE k = 1""")
def training_latest_join(spark, d):
    """The join without fan-out: only the latest score row of a lead."""
    x = T.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("lead_id"), F.col("l_discount").alias("feature"), "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
    latest = R.latest_per_key(x, ["lead_id"], [F.col(c) for c in ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "feature")])
    o = T.read(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("lead_id"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return o.join(latest.select("lead_id", "feature"), "lead_id").select("lead_id", "feature", "y")


KEYS = ["click", "error", "purchase", "signup", "view"]
_BEST = ", ".join(f"max(CASE WHEN key = '{k}' THEN v END) AS \"{k}\"" for k in KEYS)


@query(f"""SELECT lead_id, {_BEST} FROM (SELECT user_id AS lead_id, event_type AS key, props AS v,
row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, ts DESC, event_id DESC) k FROM events) WHERE k = 1 GROUP BY lead_id""")
def fact_pivot(spark, d):
    facts = T.outcomes(spark, d).select("lead_id", F.col("event_type").alias("key"), F.col("props").alias("value"), F.col("value").alias("confidence"), F.col("occurred_at").alias("observed_at"), "id")
    return R.pivot_facts(facts, "lead_id", KEYS)


_RANK = "CASE stage " + " ".join(f"WHEN '{s}' THEN {r}" for s, r in funnel.STAGE_RANK.items()) + " ELSE 0 END"
_REACHED = ", ".join(f"count(*) FILTER (WHERE max_rank >= {r}) AS reached_{r}" for r in range(5, 11))
SEGMENTS_SQL = f"""SELECT platform || '|' || category || '|' || channel AS segment, {_REACHED} FROM (
SELECT o.lead_id, max({_RANK}) AS max_rank, min(l.platform) AS platform, min(l.category) AS category, min(o.channel) AS channel
FROM ({T.OUTCOMES_SQL}) o JOIN ({T.LEADS_SQL}) l ON o.lead_id = l.id GROUP BY o.lead_id) WHERE max_rank >= 5 GROUP BY 1"""


def _segments(spark, d):
    dims = ["platform", "category", "channel"]
    return funnel.segments(funnel.max_rank(_joined(spark, d), "lead_id", "stage", dims), dims)


@query(SEGMENTS_SQL)
def funnel_segments(spark, d):
    return _segments(spark, d)


_STEPS = " UNION ALL ".join(f"SELECT '{n}' AS stage, coalesce(sum(reached_{a}), 0)::DOUBLE AS n, coalesce(sum(reached_{b}), 0)::DOUBLE AS s FROM seg" for n, a, b in funnel.STEPS)
RATES_SQL = f"""WITH seg AS ({SEGMENTS_SQL}), st AS ({_STEPS}),
w AS (SELECT *, s / n AS p, {N.Z95} * {N.Z95} AS zz FROM st)
SELECT stage, n::BIGINT AS n, s::BIGINT AS successes, round((s + 1) / (n + 2), 6) AS mean,
round(CASE WHEN n <= 0 THEN 0 ELSE greatest(0, (p + zz / (2 * n)) / (1 + zz / n) - {N.Z95} / (1 + zz / n) * sqrt(p * (1 - p) / n + zz / (4 * n * n))) END, 6) AS wilson_low,
round(CASE WHEN n <= 0 THEN 1 ELSE least(1, (p + zz / (2 * n)) / (1 + zz / n) + {N.Z95} / (1 + zz / n) * sqrt(p * (1 - p) / n + zz / (4 * n * n))) END, 6) AS wilson_high FROM w"""


@query(RATES_SQL)
def funnel_rates_wilson(spark, d):
    rates = funnel.stage_rates(_segments(spark, d))
    return rates.select("stage", "n", "successes", *(F.round(c, 6).alias(c) for c in ("mean", "wilson_low", "wilson_high")))


_KAPPA = " UNION ALL ".join(
    f"SELECT '{n}' AS stage, count(*) AS c, coalesce(var_samp(r), 0) AS v, sum(s) / sum(n) AS p, avg(n) AS m FROM (SELECT reached_{b}::DOUBLE AS s, reached_{a}::DOUBLE AS n, reached_{b}::DOUBLE / reached_{a} AS r FROM seg WHERE reached_{a} > 0)"
    for n, a, b in funnel.STEPS
)
KAPPA_SQL = f"""WITH seg AS ({SEGMENTS_SQL}), k AS ({_KAPPA})
SELECT stage, CASE WHEN c < 2 OR p IS NULL OR v - p * (1 - p) / greatest(m, 1) <= 1e-9 THEN 0.0
ELSE least(5000, greatest(0, p * (1 - p) / (v - p * (1 - p) / greatest(m, 1)) - 1)) END AS kappa FROM k"""


@query(f"SELECT stage, round(kappa, 6) AS kappa FROM ({KAPPA_SQL})")
def funnel_kappa(spark, d):
    return funnel.stage_kappas(_segments(spark, d)).select("stage", F.round("kappa", 6).alias("kappa"))


_EACH = " UNION ALL ".join(f"SELECT segment, '{n}' AS stage, reached_{a}::DOUBLE AS n, reached_{b}::DOUBLE AS s FROM seg" for n, a, b in funnel.STEPS)


@query(f"""WITH seg AS ({SEGMENTS_SQL}), e AS ({_EACH}),
r AS (SELECT stage, CASE WHEN sum(s) > 0 THEN sum(s) / sum(n) ELSE 0.1 END AS raw FROM e GROUP BY stage),
q AS (SELECT e.*, least(0.9999, greatest(0.0001, raw)) AS rate, kappa FROM e JOIN r USING (stage) JOIN ({KAPPA_SQL}) USING (stage))
SELECT segment, stage, round((kappa * rate + s + 0.5) / (kappa + n + 1), 6) AS mean FROM q""")
def segment_posterior_mean(spark, d):
    return funnel.segment_posteriors(_segments(spark, d)).select("segment", "stage", F.round("mean", 6).alias("mean"))


@query()
def beta_lower_bound(spark, d):
    return funnel.with_lower_bound(funnel.stage_rates(_segments(spark, d))).select("stage", "n", "successes", F.round("lower", 9).alias("lower"))


@query("SELECT l_returnflag AS segment, median(l_extendedprice) AS median_price, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90, round(coalesce(avg(l_discount), 0), 9) AS mean_discount FROM lineitem GROUP BY 1")
def median_price(spark, d):
    """Exact quantiles from counts of values; the mean from the same counts."""
    rows = T.read(spark, d, "lineitem").select(F.col("l_returnflag").alias("segment"), F.col("l_extendedprice").alias("price"), "l_discount")
    counts = stage(rows.groupBy("segment", "price").agg(F.count("*").alias("n"), F.sum("l_discount").alias("discount")), "price-counts")
    found = ranks.quantiles(counts, ["segment"], "price", "n", {"median_price": 0.5, "p90": 0.9})
    means = counts.groupBy("segment").agg(F.round(F.coalesce(F.sum("discount") / F.sum("n"), F.lit(0.0)), 9).alias("mean_discount"))
    return found.join(means, "segment").withColumn("p90", F.round("p90", 6))


@query()
def stage_posteriors(spark, d):
    """Every segment's pooled rates with the 5 % and 95 % points of their distributions."""
    made = funnel.segment_posteriors(_segments(spark, d), bounds=True)
    return made.select("segment", "stage", "n", "successes", *(F.round(c, 9).alias(c) for c in ("mean", "lower", "upper")))


_CHAIN = "least(1, greatest(0, (priority + 1000) / 11000))"


@query(f"""SELECT id, round({_CHAIN} * 0.5 * 0.4 * 0.6 * 0.3 * 2697, 6) AS ev,
round({_CHAIN} * 0.5 * 0.4 * 0.6 * 0.3 * 2697 / CASE id % 3 WHEN 0 THEN 12 WHEN 1 THEN 20 ELSE 35 END, 6) AS priority FROM ({T.LEADS_SQL})""")
def expected_value_priority(spark, d):
    p = N.clamp((F.col("priority") + 1000) / 11000, 0.0, 1.0)
    ev = N.expected_value(p, F.lit(0.5), F.lit(0.4), F.lit(0.6), F.lit(0.3))
    effort = F.when(F.col("id") % 3 == 0, 12.0).when(F.col("id") % 3 == 1, 20.0).otherwise(35.0)
    return T.leads(spark, d).select("id", F.round(ev, 6).alias("ev"), F.round(N.priority(ev, effort), 6).alias("priority"))


@query(f"""SELECT lead_id, id, cost, spent FROM (SELECT *, sum(cost::DECIMAL(18,2)) OVER (PARTITION BY lead_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING)::DOUBLE AS spent
FROM ({T.ATTEMPTS_SQL})) WHERE spent <= 300000""")
def budget_prefix(spark, d):
    rows = T.attempts(spark, d).withColumn("money", F.col("cost").cast("decimal(18,2)"))
    held = R.within_budget(rows, ["lead_id"], [F.col("created_at"), F.col("id")], "money", 300000)
    return held.select("lead_id", "id", "cost", F.col("spent").cast("double").alias("spent"))


@query("""WITH e AS (SELECT user_id AS lead_id, strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d') AS day, event_type FROM events)
SELECT day, count(*) FILTER (WHERE event_type = 'view') AS sent, count(*) FILTER (WHERE event_type = 'click') AS replies FROM e GROUP BY day""")
def upsert_counters(spark, d):
    """Two batches of events, the second added to what the first has left."""
    from tamarind.operators.temporal import day_key

    rows = T.outcomes(spark, d).select(day_key(F.col("occurred_at")).alias("day"), (F.col("stage") == "sent").cast("long").alias("sent"), (F.col("stage") == "replied").cast("long").alias("replies"), (F.col("id") % 2).alias("batch"))
    first = rows.filter("batch = 0").groupBy("day").agg(F.sum("sent").alias("sent"), F.sum("replies").alias("replies"))
    return R.add_counters(first, rows.filter("batch = 1").select("day", "sent", "replies"), ["day"], ["sent", "replies"])


@query(f"""WITH a AS (SELECT lead_id, template_id, min(id) AS id FROM ({T.ATTEMPTS_SQL}) WHERE status = 'sent_by_human' GROUP BY ALL),
b AS (SELECT lead_id, template_id, min(id) AS id FROM ({T.ATTEMPTS_SQL}) WHERE status <> 'sent_by_human' GROUP BY ALL)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.lead_id = b.lead_id AND a.template_id = b.template_id)""")
def insert_ignore(spark, d):
    rows = T.attempts(spark, d).select("lead_id", "template_id", "id", "status")
    old = rows.filter("status = 'sent_by_human'").groupBy("lead_id", "template_id").agg(F.min("id").alias("id"))
    return R.insert_ignore(old, rows.filter("status <> 'sent_by_human'").drop("status"), ["lead_id", "template_id"], [F.col("id")])


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderdate < TIMESTAMP '1997-06-01' - INTERVAL 540 DAY) AS purged, (SELECT count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01' - INTERVAL 540 DAY) AS kept")
def retention_purge(spark, d):
    kept, purged = R.purge(T.attempts(spark, d), "created_at", "1997-06-01 00:00:00")
    return purged.crossJoin(kept.agg(F.count("*").alias("kept")))


@query(f"SELECT id, lead_id FROM ({T.OUTCOMES_SQL}) WHERE lead_id NOT IN ({SUPPRESSED})")
def erase_lead(spark, d):
    tables = {"outcomes": (T.outcomes(spark, d).select("id", "lead_id"), "lead_id"), "attempts": (T.attempts(spark, d), "lead_id")}
    return R.erase(tables, _suppressed(spark, d).distinct(), "id")["outcomes"]


@query(f"""SELECT l.id, (SELECT count(*) FROM ({T.OUTCOMES_SQL}) o WHERE o.lead_id = l.id) AS outcomes, (SELECT least(5, count(*)) FROM ({T.ATTEMPTS_SQL}) a WHERE a.lead_id = l.id) AS attempts FROM ({T.LEADS_SQL}) l""")
def export_bundle(spark, d):
    """The bundle's documents; the check counts what they hold."""
    parts = {"outcomes": (T.outcomes(spark, d), "lead_id", ["occurred_at", "id", "stage"], None), "attempts": (T.attempts(spark, d), "lead_id", ["created_at", "id", "status"], 5)}
    made = R.export_bundle(T.leads(spark, d).select("id"), "id", parts)
    kinds = "outcomes array<struct<id:long>>, attempts array<struct<id:long>>"
    held = made.withColumn("b", F.from_json("bundle", kinds))
    return held.select("id", F.size("b.outcomes").cast("long").alias("outcomes"), F.size("b.attempts").cast("long").alias("attempts"))


@query(f"SELECT id, kind, created, active FROM (SELECT id, template_id AS kind, strftime(created_at, '%Y-%m-%d') AS created, row_number() OVER (PARTITION BY template_id ORDER BY created_at DESC, id DESC) = 1 AS active FROM ({T.ATTEMPTS_SQL}))")
def active_model_version(spark, d):
    rows = T.attempts(spark, d).select("id", F.col("template_id").alias("kind"), "created_at")
    return R.single_active(rows, "kind", ["created_at", "id"]).select("id", "kind", F.date_format("created_at", "yyyy-MM-dd").alias("created"), "active")


@query(f"""SELECT id, coalesce(np, platform) AS platform, CASE WHEN hit THEN nw ELSE wilaya END AS wilaya FROM ({T.LEADS_SQL}) LEFT JOIN
(SELECT o_custkey AS k, true AS hit, CASE WHEN count(*) % 2 = 0 THEN 'shopify' END AS np, CASE WHEN count(*) % 3 = 0 THEN 'Oran' END AS nw FROM orders GROUP BY o_custkey) ON k = id""")
def update_lead_facts(spark, d):
    n = T.attempts(spark, d).groupBy(F.col("lead_id").alias("id")).agg(F.count("*").alias("n"))
    new = n.select("id", F.when(F.col("n") % 2 == 0, "shopify").alias("platform"), F.when(F.col("n") % 3 == 0, "Oran").alias("wilaya"))
    return R.overwrite(T.leads(spark, d).select("id", "platform", "wilaya"), new, "id", ["platform"])


@query(f"SELECT day, n FROM (SELECT strftime(occurred_at + INTERVAL 1 HOUR, '%Y-%m-%d') AS day, count(*) AS n FROM ({T.OUTCOMES_SQL}) GROUP BY 1) ORDER BY day DESC LIMIT 9")
def last_entries(spark, d):
    from tamarind.operators.temporal import day_key

    days = T.outcomes(spark, d).groupBy(day_key(F.col("occurred_at")).alias("day")).agg(F.count("*").alias("n"))
    return R.last_rows(days.withColumn("one", F.lit(1)), ["one"], [F.desc("day")], 9).drop("one")
