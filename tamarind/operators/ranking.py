"""Diversity-aware ranking of a bounded batch, and reports on it."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIMS = ["platform", "category", "wilaya"]


def likeness(a: dict, b: dict, dims: list[str] = DIMS) -> float:
    return sum(a[d] == b[d] for d in dims) / len(dims)


def mmr_order(scores: np.ndarray, codes: np.ndarray, n: int, weight: float) -> list[int]:
    """Greedy picks: weight * score - (1 - weight) * greatest likeness to a pick; ties keep score order."""
    order = np.argsort(-scores, kind="stable")
    left, near, picks = list(order), np.zeros(len(scores)), []
    while left and len(picks) < n:
        values = weight * scores[left] - (1 - weight) * near[left]
        pick = left.pop(int(np.argmax(values)))
        picks.append(int(pick))
        near = np.maximum(near, (codes == codes[pick]).mean(axis=1))
    return picks


def mmr(candidates: DataFrame, n: int, weight: float = 0.75, group: str | None = None, id_col: str = "id", score: str = "score", dims: list[str] = DIMS) -> DataFrame:
    """``(group,) id, rank``: re-ranked picks.

    Rows of one combination of ``dims`` are alike to any pick, so they are picked in order
    of their scores: only the ``n`` best of each combination can be among n picks. No other
    row is looked at, and none that could be picked is left out.
    """
    grouped = candidates.withColumn("_g", F.col(group) if group else F.lit(0))
    within = Window.partitionBy("_g", *dims).orderBy(F.desc(score), id_col)
    best = grouped.withColumn("_n", F.row_number().over(within)).filter(F.col("_n") <= n)  # Spark cuts before it shuffles
    kind = candidates.schema[id_col].dataType.simpleString()
    g_kind = candidates.schema[group].dataType.simpleString() if group else "int"

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([score, id_col], ascending=[False, True], ignore_index=True)
        codes = np.stack([pd.factorize(rows[d], use_na_sentinel=False)[0] for d in dims], axis=1)
        at = mmr_order(rows[score].to_numpy(float), codes, n, weight)
        return pd.DataFrame({"_g": rows["_g"].iloc[at], id_col: rows[id_col].iloc[at], "rank": np.arange(1, len(at) + 1)})

    made = best.select("_g", id_col, score, *dims).groupBy("_g").applyInPandas(pick, f"_g {g_kind}, {id_col} {kind}, rank int")
    return made.withColumnRenamed("_g", group) if group else made.drop("_g")


def daily_batch(candidates: DataFrame, n: int, rate: float = 0.1, weight: float = 0.75, sampled: str = "sampled_p", id_col: str = "id") -> DataFrame:
    """``(id, rank, exploration)``: MMR picks first, then the rest with the greatest sampled chances."""
    total, n = candidates.count(), max(1, n)
    slots = max(1, math.floor(n * rate + 0.5))
    first = mmr(candidates, max(1, min(max(1, n - slots), total - slots)), weight, id_col=id_col).withColumn("exploration", F.lit(False))
    rest = candidates.join(F.broadcast(first.select(id_col)), id_col, "left_anti").orderBy(F.desc(sampled), id_col).limit(slots)  # first: n rows
    base = first.agg(F.max("rank").alias("m"))
    order = F.row_number().over(Window.orderBy(F.desc(sampled), id_col))
    more = rest.crossJoin(F.broadcast(base)).select(id_col, (order + F.col("m")).cast("int").alias("rank"), F.lit(True).alias("exploration"))
    return first.unionByName(more).filter(F.col("rank") <= n)


def diversity(df: DataFrame, dims: list[str] = DIMS) -> DataFrame:
    """Distinct values of each dimension, and the mean distance of two different rows, from counts alone."""
    n = F.count("*").cast("double")
    out = df.agg(F.count("*").alias("n"), *(F.countDistinct(d).alias(f"distinct_{d}") for d in dims))
    for d in dims:  # pairs of rows that agree: the sum of c * (c - 1) / 2
        same = df.groupBy(d).agg(n.alias("c")).agg(F.sum(F.col("c") * (F.col("c") - 1)).alias(f"_{d}"))
        out = out.crossJoin(F.broadcast(same))
    alike = reduce(lambda a, b: a + b, (F.col(f"_{d}") for d in dims))
    pairs = F.col("n").cast("double") * (F.col("n") - 1)
    mean = F.when(pairs > 0, 1 - alike / (pairs * len(dims))).otherwise(0.0)
    return out.withColumn("mean_distance", mean).drop(*(f"_{d}" for d in dims))


def preferred_channel(channels: Column) -> Column:
    """Of an array of (kind, confidence): the first kind in the fixed order, then the most confident."""
    order = ["whatsapp", "messenger", "instagram", "facebook", "tiktok", "email", "phone"]
    place = F.create_map(*(F.lit(x) for i, k in enumerate(order) for x in (k, i)))
    ranked = F.transform(channels, lambda c: F.struct(F.coalesce(place[c["kind"]], F.lit(99)).alias("p"), (-c["confidence"]).alias("c"), c["kind"].alias("kind")))
    return F.array_min(ranked)["kind"]


def best_of_kind(channels: Column, kind: str) -> Column:
    """The most confident value of one kind among an array of (kind, value, confidence); null without any."""
    own = F.transform(F.filter(channels, lambda c: c["kind"] == kind), lambda c: F.struct(c["confidence"].alias("c"), c["value"].alias("v")))
    return F.array_max(own)["v"]
