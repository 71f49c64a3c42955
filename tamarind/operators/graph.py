"""Connected components of an edge list by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarind.session import release, stage, staged


def _print_of(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stage(
        both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least"
    )
    return (
        both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = stage(down.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
    kept = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node on an edge; root is the component's least node.

    Only min-aggregations and joins: no component is ever gathered in one task.
    Null ends and self loops are ignored. Every round is written to the shared
    folder, and the one before deleted. Raises if the rounds run out (they grow with the log of a chain's length).
    """
    mark = staged()
    now = stage(
        edges.select(F.col(left).alias("u"), F.col(right).alias("v"))
        .filter("u is not null and v is not null and u <> v")
        .distinct(),
        "cc-edges",
    )
    before = _print_of(now)
    if before[0] == 0:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_rounds):
        now = stage(_small_star(stage(_large_star(now), "cc-large")), "cc-edges")
        release(now.sparkSession, mark, kept=1)
        after = _print_of(now)
        if after == before:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
        before = after
    raise RuntimeError(f"connected components did not settle in {max_rounds} rounds")
