"""Exact ranks over distributed values: running counts without sorting all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Different values that one window holds, on average, and the most ranges that values are cut into.
ROWS_PER_RANGE, MOST_RANGES = 200_000, 2048


def cut_points(counts: DataFrame, value: str) -> list[float]:
    """Bounds that cut staged ``counts``' values into ranges of like size; none for few values. A bounded list."""
    ranges = min(MOST_RANGES, counts.count() // ROWS_PER_RANGE + 1)
    if ranges == 1:
        return []
    found = counts.stat.approxQuantile(value, [i / ranges for i in range(1, ranges)], 0.25 / ranges)
    return sorted(set(found))


def range_of(value: str, bounds: list[float]) -> Column:
    """The number of the range that holds a value, by the count of bounds at or below it."""
    if not bounds:
        return F.lit(0)
    held = F.split(F.lit(" ".join(map(repr, bounds))), " ").cast("array<double>")
    return F.size(F.filter(held, lambda b: b <= F.col(value)))


def running(counts: DataFrame, group: list[str], value: str, sums: list[str]) -> DataFrame:
    """Adds ``before_<sum>``: the totals of ``sums`` over the smaller values of the group.

    ``counts`` is staged, one row for each group and value. Values are cut into ranges; a
    window holds one range, and the earlier ranges' totals, one row each, are added.
    """
    ranged = counts.withColumn("_r", range_of(value, cut_points(counts, value)))
    below = Window.partitionBy(*group).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*group, "_r").agg(*(F.sum(s).alias(f"_t_{s}") for s in sums))
    base = totals.select(*group, "_r", *(F.coalesce(F.sum(f"_t_{s}").over(below), F.lit(0)).alias(f"_b_{s}") for s in sums))
    inside = Window.partitionBy(*group, "_r").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.withColumns({f"_i_{s}": F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums})
    both = rows.join(base, [*group, "_r"])
    return both.withColumns({f"before_{s}": F.col(f"_b_{s}") + F.col(f"_i_{s}") for s in sums}).select(*counts.columns, *(f"before_{s}" for s in sums))


def quantiles(counts: DataFrame, group: list[str], value: str, n: str, wanted: dict[str, float]) -> DataFrame:
    """``(*group, *wanted)``: exact quantiles, interpolated between neighbours, from staged counts of values."""
    rows = running(counts, group, value, [n])
    total = counts.groupBy(*group).agg(F.sum(n).alias("_all"))  # one row a group
    rows = rows.join(total, group)
    picked, out = [], {}
    for name, q in wanted.items():
        at = (F.col("_all") - 1) * q
        for k, place in enumerate((F.floor(at), F.ceil(at))):
            here = (F.col(f"before_{n}") <= place) & (place < F.col(f"before_{n}") + F.col(n))
            picked.append(F.max(F.when(here, F.col(value))).alias(f"_{name}_{k}"))
        out[name] = F.col(f"_{name}_0") + (F.col(f"_{name}_1") - F.col(f"_{name}_0")) * (at - F.floor(at))
    held = rows.groupBy(*group).agg(F.max("_all").alias("_all"), *picked)
    return held.select(*group, *(c.alias(k) for k, c in out.items()))
