"""Calibration and discrimination of probabilities ``p`` against labels ``y``, as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarind.functions import numeric as N
from tamarind.operators import ranks
from tamarind.session import stage

#: Different scores up to which a calibration is fitted on the driver; beyond, by an aggregate for each step.
PLATT_HELD = 500_000


def bin_of(p: Column, bins: int) -> Column:
    """Bins are closed below, the last also above; edges are the doubles i / bins."""
    q = N.clamp(p, 0.0, 1.0)
    edges = F.array(*(F.lit(i / bins) for i in range(1, bins)))
    return F.size(F.filter(edges, lambda e: e <= q))


def reliability(df: DataFrame, bins: int = 10) -> DataFrame:
    """One row for each bin, empty ones included."""
    found = df.groupBy(bin_of(F.col("p"), bins).alias("bin")).agg(F.count("*").alias("count"), F.avg("p").alias("mean_predicted"), F.avg("y").alias("observed_rate"))
    dim = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return dim.join(F.broadcast(found), "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("count"), zero("mean_predicted"), zero("observed_rate"))


def losses(df: DataFrame, weight: Column | None = None) -> DataFrame:
    """Weighted Brier score and log loss, mean absolute error; 0 for no rows."""
    w, y = weight if weight is not None else F.lit(1.0), F.col("y").cast("double")
    p = N.clamp(F.col("p"), 1e-12, 1 - 1e-12)
    mean = lambda x: F.coalesce(F.sum(w * x) / F.sum(w), F.lit(0.0))
    return df.agg(
        mean(F.pow(N.clamp(F.col("p"), 0.0, 1.0) - y, 2)).alias("brier"),
        mean(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"),
        mean(F.abs(F.col("p") - y)).alias("mae"),
    )


def expected_error(df: DataFrame, bins: int = 10) -> DataFrame:
    rows = reliability(df, bins)
    return rows.agg(F.coalesce(F.sum(F.col("count") * F.abs(F.col("mean_predicted") - F.col("observed_rate"))) / F.sum("count"), F.lit(0.0)).alias("ece"))


def auc(df: DataFrame) -> DataFrame:
    """By rank sums over distinct scores: a window over counts, never over rows or pairs. 0.5 for one class."""
    by = stage(df.groupBy("p").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.sum(1 - F.col("y").cast("long")).alias("neg")), "auc-counts")
    rows = ranks.running(by, [], "p", ["neg"])
    won = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return rows.agg(F.when(pairs > 0, won / pairs).otherwise(0.5).alias("auc"))


def platt(df: DataFrame, steps: int = 500, rate: float = 0.05, least: int = 200) -> tuple[float, float]:
    """Slope and offset on the logit by gradient descent; (1, 0) below ``least`` rows.

    The logits stay as they are. Rows are first summed by their score and staged; each step is
    one aggregate over that table, which no driver holds.
    """
    z = N.logit(F.col("p")).alias("z")
    sums = stage(df.groupBy(z).agg(F.count("*").cast("double").alias("n"), F.sum("y").cast("double").alias("y")), "platt-sums")
    total = sums.agg(F.sum("n")).first()[0] or 0.0
    if total < least:
        return 1.0, 0.0
    if sums.count() <= PLATT_HELD:  # a bounded table: the steps run here
        import numpy as np

        held = sums.toPandas()
        x, n, y = (held[c].to_numpy(float) for c in ("z", "n", "y"))
        a, b = 1.0, 0.0
        for _ in range(steps):
            miss = n / (1 + np.exp(-(a * x + b))) - y
            a, b = a - rate * (miss @ x) / total, b - rate * miss.sum() / total
        return float(a), float(b)
    a, b = 1.0, 0.0
    for _ in range(steps):
        miss = F.col("n") * N.sigmoid(F.col("z") * a + b) - F.col("y")
        ga, gb = sums.agg(F.sum(miss * F.col("z")), F.sum(miss)).first()
        a, b = a - rate * ga / total, b - rate * gb / total
    return float(a), float(b)


def apply_platt(p: Column, a: float, b: float) -> Column:
    return N.sigmoid(N.logit(p) * a + b)


def pair_quality(decisions: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision and recall of predicted pairs ``(left_id, right_id)`` in any order, with TP, FP and FN."""
    norm = lambda df: df.select(F.least("left_id", "right_id").alias("l"), F.greatest("left_id", "right_id").alias("r")).distinct()
    both = norm(decisions).withColumn("d", F.lit(1)).join(norm(truth).withColumn("t", F.lit(1)), ["l", "r"], "full")
    n = both.agg(F.count_if((F.col("d") == 1) & (F.col("t") == 1)).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("d").isNull()).alias("fn"))
    part = lambda a, b: F.when(F.col(a) + F.col(b) == 0, 0.0).otherwise(F.col(a) / (F.col(a) + F.col(b)))
    return n.withColumn("precision", part("tp", "fp")).withColumn("recall", part("tp", "fn"))
