"""Calendar, policy, lifecycle and queue queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tamarind.operators import temporal as O
from tamarind.plans import tables as T

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


LOCAL = "(occurred_at + INTERVAL 1 HOUR)"
SENT = f"SELECT * FROM ({T.OUTCOMES_SQL}) WHERE stage = 'sent'"


def _sent(spark, d):
    return T.outcomes(spark, d).filter("stage = 'sent'")


@query(f"SELECT strftime({LOCAL}, '%Y-%m-%d') AS day, count(*) AS n FROM ({SENT}) GROUP BY 1")
def daily_sender_counts(spark, d):
    return O.counts_by(_sent(spark, d), "occurred_at", O.day_key).withColumnRenamed("key", "day")


@query(f"SELECT strftime({LOCAL}, '%Y-%m-%dT%H') AS hour, count(*) AS n FROM ({SENT}) GROUP BY 1")
def hourly_sender_counts(spark, d):
    return O.counts_by(_sent(spark, d), "occurred_at", O.hour_key).withColumnRenamed("key", "hour")


DAYS = f"SELECT channel, strftime({LOCAL}, '%Y-%m-%d') AS day, count(*) FILTER (WHERE stage = 'sent') AS sends, count(*) FILTER (WHERE stage = 'replied') AS replies FROM ({T.OUTCOMES_SQL}) GROUP BY ALL"
W = "OVER (PARTITION BY channel ORDER BY day ROWS UNBOUNDED PRECEDING)"


@query(f"""WITH s AS (SELECT *, sum((1.1 - replies / sends) / 1.1 - 0.25) {W} AS p FROM ({DAYS}) WHERE sends > 0),
c AS (SELECT *, p - least(0, min(p) {W}) AS c FROM s)
SELECT channel, day, sends, replies, round(c, 6) AS cusum, max((c > 2.0)::INT) {W} = 1 AS alarm FROM c""")
def cusum_reply_rate(spark, d):
    days = T.outcomes(spark, d).groupBy("channel", O.day_key(F.col("occurred_at")).alias("day")).agg(
        F.count_if(F.col("stage") == "sent").alias("sends"), F.count_if(F.col("stage") == "replied").alias("replies")
    )
    return O.cusum(days, ["channel"], "day", "sends", "replies", 1.1).withColumn("cusum", F.round("cusum", 6))


@query(f"""SELECT lead_id, id FROM (SELECT *, epoch_us(occurred_at) - lag(epoch_us(occurred_at)) OVER (PARTITION BY lead_id ORDER BY occurred_at, id) AS gap FROM ({T.OUTCOMES_SQL}))
WHERE gap / 60e6 < 240""")
def min_spacing_violations(spark, d):
    """Outcomes less than four hours after the lead's one before (events are hours apart)."""
    return O.gaps(T.outcomes(spark, d), ["lead_id"], "occurred_at", "id").filter("gap_minutes < 240").select("lead_id", "id")


ROTATED = f"SELECT id, lead_id, occurred_at, CASE id % 4 WHEN 0 THEN 'email' ELSE channel END AS channel FROM ({SENT})"


_EARLIER = f"SELECT 1 FROM ({ROTATED}) b WHERE b.lead_id = a.lead_id AND epoch(b.occurred_at)::BIGINT < epoch(a.occurred_at)::BIGINT AND epoch(b.occurred_at)::BIGINT > epoch(a.occurred_at)::BIGINT - 7 * 86400"


@query(f"SELECT a.id, a.lead_id, a.channel, EXISTS ({_EARLIER}) AND NOT EXISTS ({_EARLIER} AND b.channel = a.channel) AS blocked FROM ({ROTATED}) a")
def channel_cooldown(spark, d):
    """Sends to leads that of late were contacted on other channels only."""
    rows = _sent(spark, d).select("id", "lead_id", F.col("occurred_at").alias("at"), F.when(F.col("id") % 4 == 0, "email").otherwise(F.col("channel")).alias("channel"))
    found = O.recent_channels(rows, "lead_id", "channel", "at")
    return found.select("id", "lead_id", "channel", O.channel_cooldown(F.col("recent_channels"), F.col("channel")).alias("blocked"))


QUIET = f"(hour({LOCAL}) >= 22 OR hour({LOCAL}) < 8)"
FRIDAY = f"(dayofweek({LOCAL}) = 5 AND hour({LOCAL}) * 60 + minute({LOCAL}) >= 690 AND hour({LOCAL}) * 60 + minute({LOCAL}) < 870)"


@query(f"SELECT id, {QUIET} AS quiet, {FRIDAY} AS friday FROM ({T.OUTCOMES_SQL})")
def quiet_hours_friday(spark, d):
    at = F.col("occurred_at")
    return T.outcomes(spark, d).select("id", O.quiet_hours(at).alias("quiet"), O.friday_blackout(at).alias("friday"))


@query(f"""SELECT id, strftime((SELECT min(t) FROM (SELECT unnest(range(0, 193)) AS k) x, LATERAL (SELECT o.occurred_at + k * INTERVAL 30 MINUTE AS t) WHERE NOT
((hour(t + INTERVAL 1 HOUR) >= 22 OR hour(t + INTERVAL 1 HOUR) < 8) OR (dayofweek(t + INTERVAL 1 HOUR) = 5 AND hour(t + INTERVAL 1 HOUR) * 60 + minute(t + INTERVAL 1 HOUR) BETWEEN 690 AND 869))), '%Y-%m-%d %H:%M') AS next_at
FROM ({T.OUTCOMES_SQL}) o""")
def next_allowed_send(spark, d):
    rows = T.outcomes(spark, d)
    return rows.select("id", F.date_format(O.next_allowed(F.col("occurred_at")), "yyyy-MM-dd HH:mm").alias("next_at"))


RAMP = "(1 / (1 + exp(-10 * (least(days / 14.0, 1) - 0.5))) - 1 / (1 + exp(5.0))) / (1 - 1 / (1 + exp(5.0)))"


@query(f"SELECT days, CASE WHEN days >= 14 THEN 40 ELSE greatest(1, floor(10 + 30 * {RAMP})) END::INT AS cap, greatest(1, floor(CASE WHEN days >= 14 THEN 40 ELSE 10 + 30 * {RAMP} END * 0.5))::INT AS throttled FROM (SELECT unnest(range(0, 20)) AS days)")
def daily_cap_ramp(spark, d):
    return spark.range(20).select(F.col("id").alias("days"), O.daily_cap(F.col("id"), 40).alias("cap"), O.daily_cap(F.col("id"), 40, F.lit(True)).alias("throttled"))


_LEAD = "PARTITION BY lead_id ORDER BY occurred_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_RECENT = "FROM e b WHERE b.lead_id = e.lead_id AND epoch(b.occurred_at)::BIGINT < epoch(e.occurred_at)::BIGINT AND epoch(b.occurred_at)::BIGINT > epoch(e.occurred_at)::BIGINT - 7 * 86400 AND b.stage = 'replied'"


@query(f"""WITH e AS (SELECT id, lead_id, stage, occurred_at, CASE id % 4 WHEN 0 THEN 'email' ELSE channel END AS channel, lead_id // 25 AS sender FROM ({T.OUTCOMES_SQL})), h AS (SELECT *,
count(*) FILTER (WHERE stage = 'lost') OVER ({_LEAD}) AS lost, count(*) FILTER (WHERE stage = 'sent') OVER ({_LEAD}) AS firsts,
max(CASE WHEN stage = 'sent' THEN epoch_us(occurred_at) END) OVER ({_LEAD}) AS first_at,
epoch_us(occurred_at) - lag(epoch_us(occurred_at)) OVER (PARTITION BY sender ORDER BY occurred_at, id) AS gap,
row_number() OVER (PARTITION BY sender, strftime({LOCAL}, '%Y-%m-%d') ORDER BY occurred_at, id) - 1 AS today,
row_number() OVER (PARTITION BY sender, strftime({LOCAL}, '%Y-%m-%dT%H') ORDER BY occurred_at, id) - 1 AS this_hour,
EXISTS (SELECT 1 {_RECENT}) AND NOT EXISTS (SELECT 1 {_RECENT} AND b.channel = e.channel) AS elsewhere FROM e)
SELECT id, CASE WHEN lead_id % 50 = 3 THEN 'suppressed' WHEN lead_id % 41 = 4 THEN 'terminal_state' WHEN lead_id % 7 = 5 THEN 'customer' WHEN lost >= 25 THEN 'suppressed' WHEN elsewhere THEN 'channel_cooldown'
WHEN firsts > 0 AND firsts >= 12 THEN 'first_contact_limit' WHEN firsts > 0 AND (epoch_us(occurred_at) - first_at) / 864e8 < 0.5 THEN 'followup_cooldown'
WHEN {QUIET} THEN 'quiet_hours' WHEN {FRIDAY} THEN 'friday_blackout' WHEN today >= 40 THEN 'daily_cap' WHEN this_hour >= 3 THEN 'hourly_cap' WHEN gap / 6e7 < 4 THEN 'spacing' ELSE 'ok' END AS code FROM h""")
def contact_policy_decision(spark, d):
    """A decision for every event, as if it asked to contact its lead: each 25 leads have a sender."""
    e = T.outcomes(spark, d).select("id", "lead_id", "stage", "occurred_at", F.when(F.col("id") % 4 == 0, "email").otherwise(F.col("channel")).alias("channel"), F.floor(F.col("lead_id") / 25).alias("sender"))
    past = Window.partitionBy("lead_id").orderBy("occurred_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    at, stage = F.col("occurred_at"), F.col("stage")
    nth = lambda key: F.row_number().over(Window.partitionBy("sender", key).orderBy("occurred_at", "id")) - 1
    rows = O.recent_channels(e.withColumn("_on", F.when(stage == "replied", F.col("channel"))), "lead_id", "_on", "occurred_at")
    rows = O.gaps(rows, ["sender"], "occurred_at", "id").withColumns(
        {
            "lost": F.count_if(stage == "lost").over(past), "firsts": F.count_if(stage == "sent").over(past), "first_at": F.max(F.when(stage == "sent", at)).over(past),
            "today": nth(O.day_key(at)), "this_hour": nth(O.hour_key(at)),
        }
    )
    since = F.expr("timestampdiff(MICROSECOND, first_at, occurred_at)") / 864e8
    code = O.contact_policy(
        {
            "suppressed": F.col("lead_id") % 50 == 3, "state": F.when(F.col("lead_id") % 41 == 4, "do_not_contact").otherwise("sent"), "customer": F.col("lead_id") % 7 == 5, "hostile": F.col("lost") >= 25,
            "recent_channels": F.col("recent_channels"), "channel": F.col("channel"), "first_contacts": F.col("firsts"), "follow_ups": F.col("firsts"),
            "days_since_first": F.when(since < 0.5, 0.0).otherwise(99.0), "now": at, "sent_today": F.col("today"), "cap": F.lit(40),
            "sent_hour": F.col("this_hour"), "hour_cap": F.lit(3), "minutes_since_send": F.col("gap_minutes"), "sender_days": F.lit(99.0),
        },
        max_follow_ups=12,
    )
    return rows.select("id", code.alias("code"))


_CASES = "CASE id % 14 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(O.TRANSITIONS)) + " END"
_TO = "CASE id // 14 % 14 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(O.TRANSITIONS)) + " END"
_ALLOWED = " OR ".join(f"s = '{a}' AND t IN ({', '.join(repr(b) for b in bs)})" for a, bs in O.TRANSITIONS.items() if bs)


@query(f"""WITH x AS (SELECT id, {_CASES} AS s, {_TO} AS t, id % 2 = 0 AS observed, id % 3 > 0 AS contactable, id % 5 > 0 AS qualified, id % 11 = 0 AS suppressed, id % 4 > 0 AS drafted, id % 6 > 0 AS policy FROM ({T.OUTCOMES_SQL}))
SELECT id, s AS state, t AS target, CASE WHEN s = t THEN '' WHEN NOT ({_ALLOWED}) THEN 'not in the table'
WHEN t = 'enriched' AND NOT observed THEN 'nothing observed' WHEN t IN ('qualified', 'queued') AND NOT qualified THEN 'gates not passed'
WHEN t IN ('qualified', 'queued') AND suppressed THEN 'suppressed' WHEN t IN ('qualified', 'queued') AND NOT contactable THEN 'no contactable channel'
WHEN t = 'drafted' AND NOT drafted THEN 'no draft' WHEN t = 'sent' AND NOT policy THEN 'contact policy' WHEN t = 'sent' AND suppressed THEN 'suppressed' ELSE '' END AS reasons FROM x""")
def lifecycle_guards(spark, d):
    """Whether made-up leads may pass from state to state, with the reasons against it."""
    i = F.col("id")
    states = F.array(*map(F.lit, O.TRANSITIONS))
    rows = T.outcomes(spark, d).select("id", F.element_at(states, (i % 14 + 1).cast("int")).alias("state"), F.element_at(states, (F.floor(i / 14) % 14 + 1).cast("int")).alias("target"))
    c = {"observed": i % 2 == 0, "contactable": i % 3 > 0, "qualified": i % 5 > 0, "suppressed": i % 11 == 0, "drafted": i % 4 > 0, "policy_ok": i % 6 > 0}
    return rows.withColumn("reasons", F.array_join(O.transition_reasons(F.col("state"), F.col("target"), c), "; "))


@query(f"""WITH s AS (SELECT lead_id // 25 AS sender, occurred_at, stage FROM ({T.OUTCOMES_SQL})), n AS (SELECT TIMESTAMP '2024-01-20 15:00:00' AS t),
c AS (SELECT sender, count(*) FILTER (WHERE stage = 'sent' AND strftime({LOCAL}, '%Y-%m-%d') = '2024-01-20') AS sent_today, count(*) FILTER (WHERE stage = 'sent' AND strftime({LOCAL}, '%Y-%m-%dT%H') = '2024-01-20T16') AS sent_hour,
max(CASE WHEN stage = 'lost' THEN occurred_at END) + INTERVAL 7 DAY AS throttle_until FROM s, n WHERE occurred_at <= t GROUP BY sender HAVING count(*) FILTER (WHERE stage = 'sent') > 0),
k AS (SELECT *, greatest(1, floor(40 * CASE WHEN throttle_until > t THEN 0.5 ELSE 1 END))::INT AS cap FROM c, n)
SELECT sender, sent_today, sent_hour, coalesce(throttle_until > t, false) AS throttled, cap, round(least(1, sent_today / cap), 6) AS utilisation FROM k""")
def sender_snapshot(spark, d):
    """Every sender's counters, cap and utilisation at one moment; lost leads count as blocks."""
    rows = T.outcomes(spark, d).withColumn("sender", F.floor(F.col("lead_id") / 25))
    ends = rows.withColumn("stage", F.when(F.col("stage") == "lost", "blocked").otherwise(F.col("stage")))
    found = O.sender_snapshot(rows.filter("stage = 'sent'"), ends, "2024-01-20 15:00:00", "2023-12-01 00:00:00", 40, 5, ["sender"])
    return found.select("sender", "sent_today", "sent_hour", "throttled", "cap", F.round("utilisation", 6).alias("utilisation"))


_NEXT = " ".join(f"WHEN s.state || '>' || w.want = '{a}>{b}' THEN '{b}'" for a, bs in O.TRANSITIONS.items() for b in bs)


@query(f"""WITH RECURSIVE w AS (SELECT lead_id, row_number() OVER (PARTITION BY lead_id ORDER BY occurred_at, id) AS k, stage AS want FROM ({T.OUTCOMES_SQL}) WHERE stage <> 'sent'),
s AS (SELECT DISTINCT lead_id, 0::BIGINT AS k, 'sent' AS state FROM ({T.OUTCOMES_SQL})
UNION ALL SELECT s.lead_id, s.k + 1, CASE {_NEXT} ELSE s.state END FROM s JOIN w ON w.lead_id = s.lead_id AND w.k = s.k + 1)
SELECT lead_id, max_by(state, k) AS state FROM s GROUP BY lead_id""")
def lifecycle_fold(spark, d):
    """``sent`` is no outcome (it asks for no state); the others follow the transition table."""
    return O.fold_states(T.outcomes(spark, d), "lead_id", "stage", ["occurred_at", "id"])


JOBS = "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'running' ELSE 'done' END AS status, o_orderpriority AS priority, o_orderdate AS run_at, o_orderdate + INTERVAL 30 DAY AS lease_expires_at, (o_orderkey % 12)::INT AS attempts FROM orders"


def _jobs(spark, d):
    status = F.expr("CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'running' ELSE 'done' END")
    return T.read(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("run_at"),
        (F.col("o_orderdate") + F.expr("INTERVAL '30' DAY")).alias("lease_expires_at"), (F.col("o_orderkey") % 12).cast("int").alias("attempts"),
    )


@query(f"""SELECT id, status, priority FROM ({JOBS}) WHERE status = 'pending' AND run_at <= TIMESTAMP '1996-01-01' OR status = 'running' AND lease_expires_at < TIMESTAMP '1996-01-01'
ORDER BY priority, run_at, id LIMIT 25""")
def job_claim(spark, d):
    return O.claimable(_jobs(spark, d), F.lit("1996-01-01").cast("timestamp_ntz"), 25).select("id", "status", "priority")


@query(f"""SELECT count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'done') AS done, 0 AS failed, 0 AS dead,
count(*) FILTER (WHERE status = 'pending' AND run_at <= TIMESTAMP '1996-01-01') AS due, coalesce(max(CASE WHEN status = 'pending' AND run_at <= TIMESTAMP '1996-01-01' THEN date_diff('second', run_at, TIMESTAMP '1996-01-01') END), 0) AS oldest_seconds
FROM (SELECT id, run_at, CASE WHEN status = 'running' AND lease_expires_at <= TIMESTAMP '1996-01-01' THEN 'pending' ELSE status END AS status FROM ({JOBS}))""")
def job_stats(spark, d):
    """The queue once jobs with a lease that ran out wait again."""
    jobs = _jobs(spark, d).withColumn("worker", F.lit("w"))
    return O.job_stats(O.reap(jobs, "1996-01-01 00:00:00"), "1996-01-01 00:00:00")


@query(f"""WITH e AS (SELECT id, CASE id % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'fail' ELSE 'heartbeat' END AS kind FROM ({JOBS}) WHERE status = 'running' AND id % 4 > 0)
SELECT id, CASE kind WHEN 'complete' THEN 'done' WHEN 'fail' THEN CASE WHEN attempts >= 8 THEN 'dead' ELSE 'pending' END ELSE status END AS status,
strftime(CASE WHEN kind = 'fail' AND attempts < 8 THEN TIMESTAMP '1996-01-01' + to_microseconds((greatest(0.25, 0.5 * least(1800, 2 * 2 ** attempts)) * 1000000)::BIGINT) ELSE run_at END, '%Y-%m-%d %H:%M:%S') AS run_at,
strftime(CASE WHEN kind = 'heartbeat' THEN TIMESTAMP '1996-01-01' + INTERVAL 300 SECOND WHEN kind IS NULL THEN lease_expires_at END, '%Y-%m-%d %H:%M:%S') AS lease
FROM ({JOBS}) LEFT JOIN e USING (id)""")
def job_events(spark, d):
    """Jobs after their workers' last heartbeats, completions and failures."""
    jobs = _jobs(spark, d).withColumns({"worker": F.lit("w"), "last_error": F.lit(None).cast("string")})
    kind = F.when(F.col("id") % 3 == 0, "complete").when(F.col("id") % 3 == 1, "fail").otherwise("heartbeat")
    now = F.lit("1996-01-01 00:00:00").cast("timestamp_ntz")
    ran = jobs.filter("status = 'running' and id % 4 > 0")
    old = ran.select("id", F.lit("fail").alias("kind"), F.lit("w").alias("worker"), F.lit("1995-12-31").cast("timestamp_ntz").alias("at"), F.lit(1.0).alias("jitter"), F.lit("x").alias("error"))
    new = ran.select("id", kind.alias("kind"), F.lit("w").alias("worker"), now.alias("at"), F.lit(0.5).alias("jitter"), F.lit("x").alias("error"))
    made = O.after_events(jobs, old.union(new))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias
    return made.select("id", "status", text("run_at")("run_at"), text("lease_expires_at")("lease"))


@query(f"SELECT id, 0.5 * least(1800, 2 * 2 ** attempts) AS delay, CASE WHEN attempts + 1 >= 8 THEN 'dead' ELSE 'pending' END AS status FROM ({JOBS})")
def job_backoff(spark, d):
    a = F.col("attempts")
    return _jobs(spark, d).select("id", O.backoff_seconds(a, F.lit(0.5)).alias("delay"), O.after_failure(a, F.lit(8)).alias("status"))


@query(f"""SELECT id, k AS schedule, strftime(CASE k WHEN '15m' THEN run_at + INTERVAL 15 MINUTE WHEN '1h' THEN run_at + INTERVAL 1 HOUR
WHEN '1d@03:30' THEN date_trunc('day', run_at + INTERVAL 25 HOUR) + INTERVAL 150 MINUTE END, '%Y-%m-%d %H:%M') AS next_at
FROM ({JOBS}), (VALUES ('15m'), ('1h'), ('1d@03:30'), ('soon')) s(k)""")
def next_run_at(spark, d):
    schedules = F.explode(F.array(*map(F.lit, ["15m", "1h", "1d@03:30", "soon"])))
    rows = _jobs(spark, d).withColumn("schedule", schedules)
    return rows.select("id", "schedule", F.date_format(O.next_run_at(F.col("schedule"), F.col("run_at")), "yyyy-MM-dd HH:mm").alias("next_at"))


@query(f"SELECT id, round(pow(2, -greatest(0, date_diff('second', occurred_at, TIMESTAMP '2024-03-01') / 86400.0) / 21), 6) AS freshness FROM ({T.OUTCOMES_SQL})")
def decay_half_life(spark, d):
    from tamarind.functions.numeric import decay

    seconds = F.expr("timestampdiff(SECOND, date_trunc('second', occurred_at), timestamp_ntz'2024-03-01')")
    return T.outcomes(spark, d).select("id", F.round(decay(seconds / 86400.0, 21.0), 6).alias("freshness"))


@query()
def stream_daily_counts(spark, d):
    """The daily counts again, by Structured Streaming over the events file."""
    from tamarind.streaming.counters import daily_counts

    return daily_counts(spark, d)


ORACLES["stream_daily_counts"] = "SELECT strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL"
