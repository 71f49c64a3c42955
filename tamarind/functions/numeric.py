"""Numeric building blocks as columns. NaN never passes a clamp: Spark orders it above every number."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two-sided 95 % normal quantile, and the smallest probability that is kept.
Z95, EPSILON = 1.959964, 1e-9


def num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def clamp(x: Column, low: float, high: float) -> Column:
    """NaN becomes ``low``; a null stays null (``least`` and ``greatest`` would skip it)."""
    inside = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.nanvl(x.cast("double"), F.lit(float(low)))))
    return F.when(x.isNotNull(), inside)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def finite_or(x: Column, other: float) -> Column:
    """``x`` where it is a finite number (an infinity times zero is NaN), else ``other``."""
    return F.coalesce(F.nanvl(x * 0.0 + x, F.lit(float(other))), F.lit(float(other)))


def safe_prob(p: Column) -> Column:
    return clamp(finite_or(p, 0.5), EPSILON, 1 - EPSILON)


def logit(p: Column) -> Column:
    q = safe_prob(p)
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def softmax(scores: Column) -> Column:
    """Of an array; entries that are not finite get probability zero."""

    def shares(x: Column) -> Column:
        top = F.array_max(x)
        raised = let(top, lambda t: F.transform(x, lambda s: F.when(s <= -1e300, F.lit(0.0)).otherwise(F.exp(s - t))))
        return let(raised, lambda r: let(F.aggregate(r, F.lit(0.0), lambda a, b: a + b), lambda n: F.transform(r, lambda e: e / n)))

    return let(F.transform(scores, lambda s: finite_or(s, -1e300)), shares)


def wilson(successes: Column, trials: Column, z: float = Z95) -> tuple[Column, Column, Column]:
    """Lower, upper and centre; (0, 1, 0.5) without trials."""
    n = trials.cast("double")
    s = F.greatest(F.lit(0.0), F.least(successes.cast("double"), n))
    p, zz = s / n, z * z
    centre = (p + zz / (2 * n)) / (1 + zz / n)
    half = z / (1 + zz / n) * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    none = n <= 0
    return (
        F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half)),
        F.when(none, 1.0).otherwise(F.least(F.lit(1.0), centre + half)),
        F.when(none, 0.5).otherwise(centre),
    )


def beta_mean(a: Column, b: Column) -> Column:
    return F.when(a + b <= 0, 0.5).otherwise(a / (a + b))


def beta_variance(a: Column, b: Column) -> Column:
    t = a + b
    return F.when(t <= 0, 0.0).otherwise(a * b / (t * t * (t + 1)))


def pooled(successes: Column, trials: Column, rate: Column, kappa: Column, extra: float = 0.0) -> tuple[Column, Column]:
    """Alpha and beta of a segment's rate, shrunk towards ``rate`` with strength ``kappa``."""
    r, k = clamp(rate, 1e-4, 1 - 1e-4), kappa + extra
    return k * r + successes + 0.5, k * (1 - r) + (trials - successes) + 0.5


def decay(days: Column, half_life: float) -> Column:
    return F.when(days.isNotNull(), F.pow(F.lit(2.0), -F.greatest(days, F.lit(0)).cast("double") / half_life))


def shrunk_median(observed: Column, prior: Column) -> Column:
    return F.coalesce((observed * 10 + prior * 10) / 20, prior)


#: Seconds that a message takes on each channel; what a paying customer is worth (a month, share, months) and a free one.
EFFORT_SECONDS = {"whatsapp": 12, "messenger": 20, "instagram": 20, "facebook": 20, "tiktok": 25, "email": 35, "phone": 45}
VALUE_PAID, MARGIN, HORIZON, VALUE_FREE = 899.0, 1, 3, 0.0


def effort_seconds(channel: Column, observed: Column | None = None) -> Column:
    """A channel's seconds, shrunk half way to what was observed where that is above 0."""
    prior = F.create_map(*(F.lit(x) for kv in EFFORT_SECONDS.items() for x in kv))[channel].cast("double")
    return prior if observed is None else F.when(observed > 0, shrunk_median(observed, prior)).otherwise(prior)


def expected_value(p_reply: Column, p_interest: Column, p_sign: Column, p_activate: Column, p_pay: Column, value: float = VALUE_PAID * MARGIN * HORIZON, free: float = VALUE_FREE) -> Column:
    """A chain of probabilities times what a customer, paying or not, is worth."""
    reply, interest, sign, activate, pay = (clamp(p, 0.0, 1.0) for p in (p_reply, p_interest, p_sign, p_activate, p_pay))
    return reply * interest * sign * activate * (pay * value + (1 - pay) * free)


def combined_score(bound: Column, value: Column, exploration: Column) -> Column:
    """Upper bound and expected value in one number for ranking."""
    return F.log1p(F.greatest(value, F.lit(0.0))) * 10 + F.when(exploration, 0.6).otherwise(0.4) * bound * 10


def priority(value: Column, seconds: Column) -> Column:
    return value / F.when(seconds <= 0, 1.0).otherwise(seconds)


def ucb(p: Column, variance: Column, n: Column, kappa0: float = 1.0, n0: float = 30.0) -> Column:
    kappa = kappa0 / F.sqrt(1 + n / n0)
    return clamp(p + kappa * F.sqrt(F.greatest(variance, F.lit(0.0))), 0.0, 1.0)


# --- the incomplete beta function, for workers and the driver ---------------------------


def _continued(x: float, a: float, b: float) -> float:
    """Lentz's method for the continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    out = d
    for m in range(1, 401):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            out *= c * d
        if abs(c * d - 1) < 3e-14:
            break
    return out


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _continued(x, a, b) / a
    return 1 - front * _continued(1 - x, b, a) / b


def beta_quantile(q: float, a: float, b: float) -> float:
    """By 80 bisections; ``q`` is kept off 0 and 1 by a millionth."""
    q, low, high = min(max(q, 1e-6), 1 - 1e-6), 0.0, 1.0
    for _ in range(80):
        mid = (low + high) / 2
        if beta_cdf(mid, a, b) < q:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def beta_quantile_column(a: Column, b: Column, q: float) -> Column:
    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if u != u or v != v else beta_quantile(q, u, v) for u, v in zip(x, y, strict=True)], dtype="float64")

    return of(a.cast("double"), b.cast("double"))
