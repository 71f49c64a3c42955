"""Sender counters as streams: tumbling local days, and a token bucket for each domain."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarind.session import shared_dir

LATE = "2 days"


def day_windows(events: DataFrame, ts: str, key: str) -> DataFrame:
    """``(start, key, n)``: counts by calendar day at UTC+1, with late rows of two days taken in."""
    timed = events.withColumn("_t", F.to_timestamp(F.col(ts)))
    days = F.window("_t", "1 day", startTime="23 hours")
    return timed.withWatermark("_t", LATE).groupBy(days.alias("w"), F.col(key)).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)


def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run the stream over all there is, into a table in the shared folder, and read the last count of each day."""
    base = f"{shared_dir(spark)}/daily-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    counts = day_windows(events_stream(spark, sf_dir), "ts", "event_type")
    run = counts.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    run.awaitTermination()
    kept = spark.read.parquet(f"{base}/out")
    last = kept.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))
    return last.select(F.date_format(F.col("start") + F.expr("INTERVAL '1' HOUR"), "yyyy-MM-dd").alias("day"), "event_type", "n")


def lifecycle_stream(outcomes: DataFrame, lead: str, stage: str, order: list[str]) -> DataFrame:
    """``(lead, state)`` updates: each lead's state, folded over its outcomes as they arrive, in ``order`` within a batch."""
    import pandas as pd

    from tamarind.operators.temporal import OUTCOME_STATE, TRANSITIONS

    def fold(key, batches, state):
        now = state.get[0] if state.exists else "sent"
        for want in pd.concat(list(batches)).sort_values(order)[stage]:
            target = OUTCOME_STATE.get(want)
            now = target if target in TRANSITIONS[now] else now
        state.update((now,))
        yield pd.DataFrame({lead: [key[0]], "state": [now]})

    kind = outcomes.schema[lead].dataType.simpleString()
    return outcomes.groupBy(lead).applyInPandasWithState(fold, f"{lead} {kind}, state string", "state string", "update", "NoTimeout")


def bucket_stream(requests: DataFrame, domain: str, at: str, rate: float = 0.5, burst: float = 2.0) -> DataFrame:
    """``(domain, at, go)``: when each request (seconds) may go, with tokens kept for each domain."""
    import pandas as pd

    def fold(key, batches, state):
        tokens, last = state.get if state.exists else (burst, None)
        times = sorted(t for rows in batches for t in rows[at])
        go = []
        for t in times:
            now = t if last is None else max(t, last)
            tokens = burst if last is None else min(burst, tokens + (now - last) * rate)
            wait = max(0.0, (1 - tokens) / rate)
            last = now + wait
            tokens = tokens + wait * rate - 1
            go.append(last)
        state.update((tokens, last))
        yield pd.DataFrame({domain: [key[0]] * len(go), at: times, "go": go})

    return requests.groupBy(domain).applyInPandasWithState(fold, f"{domain} string, {at} double, go double", "tokens double, last double", "append", "NoTimeout")
