"""The driver's tables in the roles of the lead relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


STAGE_OF = {"view": "sent", "click": "replied", "signup": "signed_up", "purchase": "paid", "error": "lost"}
STAGE_SQL = "CASE event_type WHEN 'view' THEN 'sent' WHEN 'click' THEN 'replied' WHEN 'signup' THEN 'signed_up' WHEN 'purchase' THEN 'paid' WHEN 'error' THEN 'lost' END"
CHANNEL_SQL = "CASE user_id % 3 WHEN 0 THEN 'whatsapp' WHEN 1 THEN 'instagram' ELSE 'email' END"
STATUS_SQL = "CASE o_orderstatus WHEN 'F' THEN 'sent_by_human' WHEN 'O' THEN 'drafted' ELSE 'skipped' END"


def outcomes(spark, sf_dir) -> DataFrame:
    """lead_id, stage, channel, occurred_at, value, id: events as outcomes."""
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("lead_id"), F.expr(STAGE_SQL).alias("stage"), F.expr(CHANNEL_SQL).alias("channel"),
        F.col("ts").alias("occurred_at"), "value", "props", "event_type",
    )


OUTCOMES_SQL = f"SELECT event_id AS id, user_id AS lead_id, {STAGE_SQL} AS stage, {CHANNEL_SQL} AS channel, ts AS occurred_at, value, props, event_type FROM events"


def leads(spark, sf_dir) -> DataFrame:
    """id, name, platform, category, wilaya, priority: customers as leads."""
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lower("c_mktsegment").alias("platform"), F.lower("r_name").alias("category"),
        F.col("n_name").alias("wilaya"), F.col("c_acctbal").alias("priority"),
    )


LEADS_SQL = """SELECT c_custkey AS id, c_name AS name, lower(c_mktsegment) AS platform, lower(r_name) AS category, n_name AS wilaya, c_acctbal AS priority
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def attempts(spark, sf_dir) -> DataFrame:
    """id, lead_id, status, template_id, created_at: orders as outreach attempts."""
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("lead_id"), F.expr(STATUS_SQL).alias("status"),
        F.col("o_orderpriority").alias("template_id"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("cost"),
    )


ATTEMPTS_SQL = f"SELECT o_orderkey AS id, o_custkey AS lead_id, {STATUS_SQL} AS status, o_orderpriority AS template_id, o_orderdate AS created_at, o_totalprice AS cost FROM orders"

#: A text's match key, for Latin texts.
KEY_SQL = r"""trim(regexp_replace(regexp_replace(replace(strip_accents(lower({0})), 'ß', 'ss'), '[!"#$%&''()*+,./:;<=>?@\[\\\]^_`{{|}}~]', ' ', 'g'), '\s+', ' ', 'g'))"""
