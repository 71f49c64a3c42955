"""What the operators of this package share: batches, dense positions, rows of one group."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarind.session import stage

#: Texts that go to a Python worker at once. Bounds a worker's memory when texts are long.
BATCH_ROWS = 512
#: Rows that one task numbers in one window, on average.
ROWS_PER_BUCKET = 20_000
#: Blocks of 512 bits in a Bloom filter at most (16 MB), and keys for each of them: about one other key in a thousand passes.
BLOOM_BLOCKS, BLOOM_KEYS, BLOOM_WORDS = 1 << 18, 32, 8


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches of whole texts small, so that long ones don't fill a worker.

    Results are lazy, so the session's setting has to stay lowered; it is never raised.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores in front where ``df`` has a column called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def utf8(column: pa.Array) -> list:
    """The values of a string column as bytes; null stays None."""
    return column.cast(pa.binary()).to_pylist()


def map_batches(df: DataFrame, one: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``one`` to every Arrow batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield one(batch)

    return df.mapInArrow(run, schema)


def whole_groups(batches: Iterable[pa.RecordBatch], key: str, rows: int = 50_000) -> Iterator[pa.Table]:
    """Tables that hold whole runs of equal ``key``, of about ``rows`` rows.

    The rows must come sorted by ``key``. Memory is bounded by ``rows`` plus the longest run.
    """
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if count >= rows:
            keys = batch.column(key)
            last = held[-1].column(key)[-1].as_py()
            at = int(np.searchsorted(np.asarray(keys), last, side="right"))
            if at < batch.num_rows:
                yield pa.Table.from_batches([*held, batch.slice(0, at)] if at else held)
                held, count = [batch.slice(at)], batch.num_rows - at
                continue
        held.append(batch)
        count += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def with_maybe(rows: DataFrame, own: list[str], listed: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Add ``out``: false only where no row of ``listed`` has in ``keys`` what a row has in ``own`` (nulls are equal).

    A blocked Bloom filter of bounded size is broadcast, so that rows which an exact join would
    pass over needn't be shuffled for it. With more keys than it holds more rows pass. ``listed`` must be staged.
    """
    n, blocks = listed.count(), 1
    while blocks < BLOOM_BLOCKS and blocks * BLOOM_KEYS < n:
        blocks *= 2
    block_name, words_name = free_name(rows, "_block"), free_name(rows, "_words")

    def block(cols: list[str]) -> Column:
        return F.pmod(F.xxhash64(*cols), F.lit(blocks)).cast("int")

    def masks(cols: list[str]) -> list[Column]:
        bits = F.xxhash64(F.lit(1), *cols)
        at = [F.shiftrightunsigned(bits, 6 * k).bitwiseAND(F.lit(63)).cast("int") for k in range(BLOOM_WORDS)]
        return [F.call_function("shiftleft", F.lit(1).cast("long"), i) for i in at]

    words = F.struct(*(F.bit_or(m).alias(f"w{k}") for k, m in enumerate(masks(keys))))
    held = listed.groupBy(block(keys).alias(block_name)).agg(words.alias(words_name))
    hits = ((F.col(f"{words_name}.w{k}").bitwiseAND(m) == m) for k, m in enumerate(masks(own)))
    hit = F.coalesce(reduce(lambda a, b: a & b, hits), F.lit(False))
    return rows.join(F.broadcast(held), block(own) == F.col(block_name), "left").withColumn(out, hit).drop(block_name, words_name)


def dense_index(df: DataFrame, keys: list[str], order: list[str], out: str, n: int | None = None, near: list[str] | None = None) -> DataFrame:
    """Add ``out``: each row's gapless position, from 0, among the rows of its ``keys``.

    A hot key is no task of its own: rows are dealt to buckets by a hash of ``order`` and of
    a number of their own, numbered inside a bucket, and moved up by the sizes of the earlier
    buckets; the buckets are staged. Rows that are equal in ``near`` share a bucket, where it
    is given, and so get adjacent positions; the caller bounds how many are. ``df`` must be
    stable (staged). Rows that are equal in ``order`` may swap places.
    """
    buckets = max(1, -(-(df.count() if n is None else n) // ROWS_PER_BUCKET))
    if buckets == 1:
        dealt = df.withColumn("_b", F.lit(0))
    elif near:
        dealt = df.withColumn("_b", F.pmod(F.xxhash64(*near), F.lit(buckets)).cast("int"))
    else:
        own = F.xxhash64(*order, F.monotonically_increasing_id())
        dealt = stage(df.withColumn("_b", F.pmod(own, F.lit(buckets)).cast("int")), "dealt")
    at = [*keys, "_b"]
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        dealt.groupBy(*at)
        .agg(F.count("*").alias("_n"))
        .select(*at, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    )
    inside = F.row_number().over(Window.partitionBy(*at).orderBy(*order)) - 1
    same = reduce(lambda a, b: a & b, (F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in at))
    left = dealt.withColumn("_i", inside).alias("l")
    return left.join(base.alias("r"), same).select(
        *(F.col(f"l.{c}").alias(c) for c in df.columns), (F.col("_i") + F.col("_base")).cast("long").alias(out)
    )
