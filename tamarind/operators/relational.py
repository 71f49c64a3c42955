"""Filters, latest rows, pivots, upserts and erasure over lead relations, as set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_by(df: DataFrame, key: str, domain: list | None = None) -> DataFrame:
    """``(key, n)``; with ``domain`` exactly its values, zero-filled."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    if domain is None:
        return counts
    dim = df.sparkSession.createDataFrame([(d,) for d in domain], f"{key} {df.schema[key].dataType.simpleString()}")
    return F.broadcast(dim).join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def latest_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One whole row for each key, the greatest by ``order``: a partial aggregate, not a window."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*key, *(F.col(f"_row.{c}").alias(c) for c in rest))


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def matching(df: DataFrame, listed: DataFrame, on: list[str], keep: bool = True) -> DataFrame:
    """Rows whose ``on`` is listed (``keep``) or isn't: existence, never a fan-out."""
    return df.join(listed.select(*on).distinct(), on, "left_semi" if keep else "left_anti")


def live(leads: DataFrame, merged_too: bool = False) -> DataFrame:
    """Leads that are neither deleted nor merged into another; the work queue reads merged ones too."""
    kept = leads.filter("deleted_at is null")
    return kept if merged_too else kept.filter("merged_into_id is null")


def select_leads(leads: DataFrame, states: list[str], n: int) -> DataFrame:
    """Live leads in the given states, last seen first, those never seen before all."""
    return live(leads).filter(F.col("state").isin(*states)).orderBy(F.desc_nulls_first("last_seen_at"), "id").limit(n)


def is_customer(values: Column, customers: str) -> Column:
    """Whether one of an array's values, of more than three characters, stands in a customers' file."""
    held = F.lit(customers.lower())
    return F.exists(values, lambda v: (F.length(v) > 3) & F.contains(held, F.lower(v)))


def observations_of(facts: DataFrame, leads: DataFrame, key: str = "lead_id") -> DataFrame:
    """``(lead_id, observations)``: all facts of the given leads, newest first. A lead's facts are few by their keys."""
    rows = F.sort_array(F.collect_list(F.struct("observed_at", "key", "value", "confidence")), asc=False)
    return facts.join(leads.select(key).distinct(), key, "left_semi").groupBy(key).agg(rows.alias("observations"))


def append(log: DataFrame, path: str) -> None:
    """Add rows to a log: observations, scores, attempts, outcomes, audit or merges."""
    log.write.mode("append").parquet(path)


def merge_log(decisions: DataFrame, now: str) -> DataFrame:
    """``(action, kept_id, merged_id, decision, at)`` of resolution: merges keep the lesser id, reviews both as they stand."""
    merges = F.col("decision") == "auto_merge"
    kept, gone = F.least("left_id", "right_id"), F.greatest("left_id", "right_id")
    detail = F.to_json(F.struct("posterior", "matched_on", "conflicting"))
    rows = decisions.filter(F.col("decision").isin("auto_merge", "review"))
    return rows.select(F.when(merges, "merge").otherwise("review_decision").alias("action"), F.when(merges, kept).otherwise(F.col("left_id")).alias("kept_id"), F.when(merges, gone).otherwise(F.col("right_id")).alias("merged_id"), detail.alias("decision"), F.lit(now).cast("timestamp_ntz").alias("at"))


def merged_into(log: DataFrame) -> DataFrame:
    """``(id, merged_into_id)`` after a log's merges that aren't taken back: the latest of a lead holds."""
    held = log.filter((F.col("action") == "merge") & F.col("reverted_at").isNull())
    return held.groupBy(F.col("merged_id").alias("id")).agg(F.max_by("kept_id", F.struct("at", "kept_id")).alias("merged_into_id"))


def revert_merges(leads: DataFrame, log: DataFrame, merge_ids: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Leads and log after the merges ``(id)`` are taken back: their leads stand alone again."""
    named = merge_ids.select("id").distinct().withColumn("_hit", F.lit(True))
    new = log.join(named, "id", "left").withColumn("reverted_at", F.when(F.col("_hit") & F.col("merged_id").isNotNull(), F.lit(now).cast("timestamp_ntz")).otherwise(F.col("reverted_at")))
    freed = new.filter("_hit and merged_id is not null").select(F.col("merged_id").alias("id")).distinct().withColumn("_free", F.lit(True))
    back = leads.join(freed, "id", "left").withColumn("merged_into_id", F.when(F.col("_free").isNull(), F.col("merged_into_id"))).select(*leads.columns)
    return back, new.select(*log.columns)


def as_json(df: DataFrame) -> DataFrame:
    """Every row as a JSON document, for the outputs that ask for it."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def substring_listed(text: Column, parts: list[str]) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, (low.contains(p) for p in parts), F.lit(False))


def pivot_facts(facts: DataFrame, entity: str, keys: list[str], confidence: str = "confidence", newest: str = "observed_at", tie: str = "id") -> DataFrame:
    """A column for each key with the value of the best fact: most confident, then newest."""
    best = [
        F.max_by(F.when(F.col("key") == k, F.col("value")), F.when(F.col("key") == k, F.struct(confidence, newest, tie))).alias(k) for k in keys
    ]
    return facts.groupBy(entity).agg(*best)


def add_counters(existing: DataFrame, delta: DataFrame, key: list[str], counters: list[str]) -> DataFrame:
    """Upsert by addition."""
    return existing.unionByName(delta).groupBy(*key).agg(*(F.sum(c).alias(c) for c in counters))


def insert_ignore(existing: DataFrame, new: DataFrame, key: list[str], first: list[Column]) -> DataFrame:
    """``existing`` and those new rows whose key it lacks, the first of each key."""
    order = Window.partitionBy(*key).orderBy(*first)
    one = new.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    return existing.unionByName(one.join(existing.select(*key), key, "left_anti").select(*existing.columns))


def overwrite(existing: DataFrame, new: DataFrame, key: str, keep_old: list[str]) -> DataFrame:
    """Facts replace old ones; in ``keep_old`` a null leaves the old value."""
    e, n = existing.alias("e"), new.withColumn("_hit", F.lit(True)).alias("n")
    cols = []
    for c in existing.columns:
        if c == key or c not in new.columns:
            cols.append(F.col(f"e.{c}"))
        elif c in keep_old:
            cols.append(F.coalesce(f"n.{c}", f"e.{c}").alias(c))
        else:
            cols.append(F.when(F.col("n._hit"), F.col(f"n.{c}")).otherwise(F.col(f"e.{c}")).alias(c))
    return e.join(n, F.col(f"e.{key}") == F.col(f"n.{key}"), "left").select(*cols)


def purge(df: DataFrame, at: str, now: str, days: int = 540) -> tuple[DataFrame, DataFrame]:
    """Rows that stay, and the number of rows older than the retention, as a one-row frame."""
    cutoff = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    old = F.col(at).cast("timestamp_ntz") < cutoff
    return df.filter(~old | F.col(at).isNull()), df.agg(F.count_if(old).alias("purged"))


def erase(tables: dict[str, tuple[DataFrame, str]], erased: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the erased entities; tables not named (suppression) stay as they are."""
    return {n: df.join(erased.select(F.col(key).alias(own)), own, "left_anti") for n, (df, own) in tables.items()}


def export_bundle(leads: DataFrame, key: str, parts: dict[str, tuple[DataFrame, str, list[str], int | None]]) -> DataFrame:
    """``(key, bundle)``: a JSON document with the entity's rows of every part, newest first by the part's first column.

    A part's limit is met before its rows are gathered.
    """
    out = leads.select(key)
    for name, (df, own, cols, most) in parts.items():
        if most:
            df = last_rows(df, [own], [F.desc(c) for c in cols], most)
        rows = F.sort_array(F.collect_list(F.struct(*cols)), asc=False)
        out = out.join(df.groupBy(F.col(own).alias(key)).agg(rows.alias(name)), key, "left")
    kept = {n: F.coalesce(n, F.array()) for n in parts}
    return out.withColumns(kept).select(key, F.to_json(F.struct(*parts)).alias("bundle"))


def within_budget(df: DataFrame, group: list[str], order: list[Column], cost: str, budget: float) -> DataFrame:
    """The leading rows of each group whose running cost stays within the budget."""
    running = F.sum(cost).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("spent", running).filter(F.col("spent") <= budget)


def last_rows(df: DataFrame, group: list[str], order: list[Column], n: int = 90) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def single_active(versions: DataFrame, kind: str, newest: list[str]) -> DataFrame:
    """Only the newest version of a kind, by the columns ``newest`` without ties, is active.

    The newest come from a partial aggregate; kinds of models are a handful, a row each.
    """
    best = versions.groupBy(kind).agg(F.max(F.struct(*newest)).alias("_best"))
    return versions.join(F.broadcast(best), kind).withColumn("active", F.struct(*newest) == F.col("_best")).drop("_best").select(*versions.columns, "active")
