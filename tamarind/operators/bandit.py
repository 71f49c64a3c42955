"""Bandits over search queries and message variants."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarind.functions import numeric as N

#: When a query counts as dead, and when a variant does.
MIN_CALLS, UPPER_FLOOR, VARIANT_MIN_SENDS, EXPLORE = 8, 0.06, 40, 0.10


def updated(alpha: Column, beta: Column, calls: Column, wins: Column, target: float = 1.0) -> tuple[Column, Column]:
    """Posterior after calls: rewards are wins per target; what calls lack of rewards are failures."""
    rewards = wins / max(target, 1e-6)
    return alpha + rewards, beta + F.greatest(F.lit(0.0), calls - rewards)


def dead(calls: Column, wins: Column, pinned_off: Column) -> Column:
    _, upper, _ = N.wilson(F.least(wins, calls), F.greatest(calls, F.lit(1)))
    return pinned_off | ((calls >= MIN_CALLS) & (upper < UPPER_FLOOR))


def variant_dead(sends: Column, replies: Column, baseline_sends: Column, baseline_replies: Column) -> Column:
    """Enough sends, and even the upper bound lies below the baseline's lower bound."""
    return (sends >= VARIANT_MIN_SENDS) & (N.wilson(replies, sends)[1] < N.wilson(baseline_replies, baseline_sends)[0])


def query_prior(text: Column) -> Column:
    return 0.15 + 0.2 * N.clamp(F.size(F.split(text, r"\s+")) / 12.0, 0.0, 1.0)


def draw(alpha: Column, beta: Column, key: Column, seed: int) -> Column:
    """A Beta sample that depends on the row's key and the seed alone, not on partitions."""

    @F.pandas_udf("double")
    def of(a: pd.Series, b: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng([seed, int(x) & 0xFFFFFFFF]).beta(u, v) for u, v, x in zip(a, b, k, strict=True)])

    return of(alpha.cast("double"), beta.cast("double"), F.xxhash64(key))


def allocate(queries: DataFrame, total: int, per_provider: dict[str, int], seed: int = 20260101) -> DataFrame:
    """``(step, provider, query, sampled)``: each unit of budget goes to the best fresh sample with budget left.

    Every query draws a sample for every step where it is, and each step keeps the best of a
    provider; only these, at most steps times providers rows, meet in one task, which spends
    the budget. A provider that is used up drops out, so the best of the others holds.
    """
    live = queries.filter(~F.coalesce("retired", F.lit(False)) & ~F.coalesce("pinned_off", F.lit(False))).filter(F.col("provider").isin(*per_provider))
    steps = live.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(total - 1)))) if total > 0 else live.withColumn("step", F.lit(0)).filter("false")
    drawn = steps.withColumn("sampled", draw(F.col("alpha"), F.col("beta"), F.concat_ws(":", "provider", "query", "step"), seed))
    best = drawn.groupBy("step", "provider").agg(F.max(F.struct("sampled", "query")).alias("b")).select("step", "provider", "b.query", "b.sampled")

    def spend(rows: pd.DataFrame) -> pd.DataFrame:
        left, out = dict(per_provider), []
        for step, some in rows.sort_values(["step", "sampled", "provider"], ascending=[True, False, True]).groupby("step"):
            for r in some.itertuples():
                if left.get(r.provider, 0) > 0:
                    left[r.provider] -= 1
                    out.append((int(step), r.provider, r.query, float(r.sampled)))
                    break
        return pd.DataFrame(out, columns=["step", "provider", "query", "sampled"])

    return best.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(spend, "step int, provider string, query string, sampled double")


def regret(df: DataFrame, order: str, rate: str, best: float, group: list[str]) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("regret", F.sum(F.greatest(F.lit(0.0), best - F.col(rate))).over(w))
