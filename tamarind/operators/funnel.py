"""Funnel counts, rates with bounds, and empirical-Bayes pooling of segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarind.functions import numeric as N
from tamarind.session import stage

#: Ranks of lead states, and the funnel's transitions from one rank to the next.
STAGE_RANK = {
    "new": 0, "enriched": 1, "qualified": 2, "disqualified": 2, "queued": 3, "drafted": 4, "sent": 5, "replied": 6,
    "interested": 7, "signed_up": 8, "activated": 9, "paid": 10, "lost": 3, "do_not_contact": 99,
}
STEPS = [("replied", 5, 6), ("interested", 6, 7), ("signed_up", 7, 8), ("activated", 8, 9), ("paid", 9, 10)]


def rank_of(stage: Column, ranks: dict[str, int] | None = None) -> Column:
    """Unknown stages rank 0."""
    out = F.lit(0)
    for name, rank in (ranks or STAGE_RANK).items():
        out = F.when(stage == name, rank).otherwise(out)
    return out


def max_rank(outcomes: DataFrame, lead: str, stage: str, dims: list[str], ranks: dict[str, int] | None = None) -> DataFrame:
    """A lead's furthest rank; its dimensions are those of its least values, so they don't depend on row order."""
    return outcomes.groupBy(lead).agg(F.max(rank_of(F.col(stage), ranks)).alias("max_rank"), *(F.min(d).alias(d) for d in dims))


def segments(leads: DataFrame, dims: list[str]) -> DataFrame:
    """Leads that were sent at least, and how many reached each rank from 5 to 10, by segment."""
    reached = [F.count_if(F.col("max_rank") >= r).alias(f"reached_{r}") for r in range(5, 11)]
    return leads.filter("max_rank >= 5").groupBy(F.concat_ws("|", *dims).alias("segment")).agg(*reached)


def stage_rates(segs: DataFrame) -> DataFrame:
    """For each step: trials, successes, posterior mean and Wilson bounds over all segments."""
    totals = segs.agg(*(F.coalesce(F.sum(f"reached_{r}"), F.lit(0)).alias(f"r{r}") for r in range(5, 11)))
    stack = ", ".join(f"'{name}', r{a}, r{b}" for name, a, b in STEPS)
    rows = totals.selectExpr(f"stack({len(STEPS)}, {stack}) AS (stage, n, successes)")
    low, high, _ = N.wilson(F.col("successes"), F.col("n"))
    mean = N.beta_mean(F.col("successes") + 1.0, F.col("n") - F.col("successes") + 1.0)
    return rows.withColumns({"mean": mean, "wilson_low": low, "wilson_high": high})


def with_lower_bound(rates: DataFrame, q: float = 0.05) -> DataFrame:
    """The one-sided lower bound of the posterior: its ``q`` quantile."""
    return rates.withColumn("lower", N.beta_quantile_column(F.col("successes") + 1, F.col("n") - F.col("successes") + 1, q))


def kappa(segs: DataFrame, successes: Column, trials: Column) -> Column:
    """Strength of pooling from the spread of segments' rates, as one aggregate.

    0 with fewer than two segments or without more spread than chance explains.
    """
    used = trials > 0
    rate = F.when(used, successes / trials)
    p = F.sum(F.when(used, successes)) / F.sum(F.when(used, trials))
    between = F.var_samp(rate) - p * (1 - p) / F.greatest(F.avg(F.when(used, trials)), F.lit(1.0))
    return F.when((F.count(rate) < 2) | (between <= 1e-9), 0.0).otherwise(N.clamp(p * (1 - p) / between - 1, 0.0, 5000.0))


def stage_kappas(segs: DataFrame) -> DataFrame:
    out = segs.agg(*(F.coalesce(kappa(segs, F.col(f"reached_{b}"), F.col(f"reached_{a}")), F.lit(0.0)).alias(name) for name, a, b in STEPS))
    return out.selectExpr(f"stack({len(STEPS)}, {', '.join(f"'{n}', {n}" for n, _, _ in STEPS)}) AS (stage, kappa)")


def segment_posteriors(segs: DataFrame, bounds: bool = False) -> DataFrame:
    """``(segment, stage, n, successes, mean)``: every segment's rate, shrunk to the stage's rate; with ``bounds``
    also ``lower`` and ``upper``, the 5 % and 95 % points of its Beta distribution."""
    segs = stage(segs, "funnel-segments")  # read three times below
    stack = ", ".join(f"'{name}', reached_{a}, reached_{b}" for name, a, b in STEPS)
    rows = segs.selectExpr("segment", f"stack({len(STEPS)}, {stack}) AS (stage, n, successes)")
    rates = stage_rates(segs).select("stage", F.when(F.col("successes") > 0, F.col("successes") / F.col("n")).otherwise(0.1).alias("rate"))
    both = rows.join(F.broadcast(rates), "stage").join(F.broadcast(stage_kappas(segs)), "stage")
    a, b = N.pooled(F.col("successes"), F.col("n"), F.col("rate"), F.col("kappa"))
    kept = ["segment", "stage", "n", "successes"]
    if not bounds:
        return both.select(*kept, N.clamp(N.beta_mean(a, b), 0.0, 1.0).alias("mean"))
    made = both.select(*kept, "kappa", a.alias("alpha"), b.alias("beta"))
    low, high = (N.beta_quantile_column(F.col("alpha"), F.col("beta"), q) for q in (0.05, 0.95))
    return made.withColumns({"mean": N.beta_mean(F.col("alpha"), F.col("beta")), "lower": low, "upper": high})
