"""Shards by balanced label propagation: linked documents gather under row quotas.

Documents and hubs form a bipartite graph; the members of a hub are linked with each
other, without a row for each pair. Law ``rows``: shard sizes differ by one row at most.

Linked documents start side by side with their hub's (a document of several hubs, with one
of them) and are cut into equal runs, one for each shard: only hubs at a cut, or larger
than ``ROWS_PER_BUCKET``, start split, also where no shard has room. In each round (Spark
joins between documents, hubs and labels) a hub counts its members' shards, and members
move towards the shard that holds most of them, of those with room. A shard takes in no
more than its quota leaves free for linked documents, so no quota is ever broken; hubs
larger than a shard fill one shard after another. Rounds end when no document moves, or
when hubs are no more together than before (documents of several hubs could move to and
fro). Documents without links then fill the shards up to their quotas.

Nulls: a null text is an empty one, of no bytes; all of these are equal texts; a null id is
kept. Repeated rows are documents of their own. An empty table gives an empty result.
Other columns are neither read nor returned.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarind.llm.common import ROWS_PER_BUCKET, dense_index
from tamarind.session import release, stage, staged

SHARDS = 40
ROW_BYTES = 16


def quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _at(values: list[int], index) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), index + 1)


def _run_of(position: str, sizes: list[int]) -> F.Column:
    """The number of the run, of these sizes one after another, that holds a position."""
    return F.size(F.filter(F.array(*map(F.lit, accumulate(sizes))), lambda e: e <= F.col(position)))


def _round(state: DataFrame, members: DataFrame, room: list[int]) -> DataFrame:
    """``(node, to)``: the moves that are granted."""
    held = members.join(state, "node")
    votes = stage(held.groupBy("hub", "shard").agg(F.count("*").alias("n")), "shard-votes")
    best = (
        votes.filter(_at(room, F.col("shard")) > 0)
        .groupBy("hub")
        .agg(F.max(F.struct("n", (-F.col("shard")).alias("s"))).alias("best"))
        .select("hub", (-F.col("best.s")).alias("to"), F.col("best.n").alias("to_n"))
    )
    leaving = stage(  # staged, so that a hot hub's rows can be split in the join below
        votes.join(best, "hub")
        .filter((F.col("to_n") > F.col("n")) | (F.col("to_n") == F.col("n")) & (F.col("to") < F.col("shard")))
        .select("hub", "shard", "to", "to_n", "n"),
        "shard-leaving",
    )
    wishes = held.join(leaving, ["hub", "shard"]).withColumn("gain", F.col("to_n") - F.col("n"))
    chosen = (
        wishes.groupBy("node")
        .agg(F.max_by(F.struct("to", "hub", "hub_rows"), F.struct("gain", "hub")).alias("w"))
        .select("node", "w.to", "w.hub", "w.hub_rows")
    )
    part = F.pmod("node", F.ceil(F.col("hub_rows") / ROWS_PER_BUCKET))
    wished = stage(chosen.select("node", "to", "hub", part.alias("part")), "shard-wishes")
    ranked = dense_index(wished, ["to"], ["hub", "node"], "rank", near=["hub", "part"])
    return ranked.filter(F.col("rank") < _at(room, F.col("to"))).select("node", "to")


def propagate(nodes: DataFrame, members: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``(node, shard)`` for staged ``nodes (node long)`` and ``members (node, hub)``.

    ``node`` must be unique. Members of a hub are linked; hubs of one member link nothing.
    """
    n = nodes.count()
    quota = quotas(n, shards)
    sizes = stage(members.groupBy("hub").agg(F.count("*").alias("hub_rows")).filter("hub_rows > 1"), "shard-hubs")
    members = stage(members.join(sizes, "hub").select("node", "hub", "hub_rows"), "shard-members")
    own = members.groupBy("node").agg(F.min(F.struct("hub", "hub_rows")).alias("h")).select("node", "h.*")
    part = F.pmod("node", F.ceil(F.col("hub_rows") / ROWS_PER_BUCKET))
    linked = stage(own.select("node", "hub", part.alias("part")), "shard-linked")
    count = linked.count()
    start = dense_index(linked, [], ["hub", "part", "node"], "i", n=count, near=["hub", "part"])
    state = stage(start.select("node", _run_of("i", quotas(count, shards)).alias("shard")), "shard-state")
    together, mark = -1, staged()
    while True:
        votes = members.join(state, "node").groupBy("hub", "shard").agg(F.count("*").alias("n"))
        now = votes.agg(F.sum(F.col("n").cast("decimal(38,0)") * F.col("n"))).first()[0] or 0
        if now <= together:
            break
        together = now
        load = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        room = [quota[s] - load.get(s, 0) for s in range(shards)]
        moves = stage(_round(state, members, room), "shard-moves")
        if moves.isEmpty():
            break
        moved = state.join(moves, "node", "left").select("node", F.coalesce("to", "shard").cast("int").alias("shard"))
        state = stage(moved, "shard-state")
        release(state.sparkSession, mark, kept=1)
    load = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    free = dense_index(stage(nodes.join(linked, "node", "left_anti"), "shard-free"), [], ["node"], "i")
    left = [quota[s] - load.get(s, 0) for s in range(shards)]
    return state.union(free.select("node", _run_of("i", left).alias("shard")))


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)``; equal texts are linked."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("hub"),
    )
    rows = stage(dense_index(stage(rows, "shard-docs"), [], ["doc_id", "hub"], "node"), "shard-nodes")
    placed = propagate(rows.select("node"), rows.select("node", "hub"), shards)
    found = stage(rows.join(placed, "node").drop("hub"), "shard-rows")
    return dense_index(found, ["shard"], ["node"], "slot").drop("node")


def op3_balanced_sharding(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document."""
    found = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
