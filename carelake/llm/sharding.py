"""Contiguous shards of nearly equal byte size, cut on global prefix sums.

Rows are range-partitioned in the asked order. Each task sums the sizes of its
own rows; the totals of the tasks, one row each, give every task the bytes and
rows that lie before it. So each row knows its global byte offset without one
task ever seeing all rows, and the shards are cut where the offsets pass equal
targets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from carelake.llm.common import staged_at

_OWN = ("_tie", "_part", "_row", "_before")


def _running(size_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, total = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            sizes = batch.column(size_column).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = total + np.cumsum(sizes)
            n = len(sizes)
            columns = [*batch.columns, pa.array(np.full(n, part, np.int32)),
                       pa.array(np.arange(row, row + n, dtype=np.int64)), pa.array(ends - sizes)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_part", "_row", "_before"])
            row, total = row + n, total + int(sizes.sum())
    return run


def byte_shards(rows: DataFrame, size: str, order: list[str], shards: int) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards - 1) and ``slot`` (0, 1, ... inside each shard).

    ``size`` names a long column without nulls and below zero nowhere. A row
    belongs to the shard in whose share of the bytes its middle byte lies, so
    shards are contiguous in ``order`` and differ by at most one row's size
    from the target. Equal rows may take each other's places; a null in
    ``order`` comes first; an empty table gives an empty result; a shard stays
    empty where one row is larger than a whole share. Other columns pass
    through; names with a leading underscore out of ``_tie``, ``_part``,
    ``_row`` and ``_before`` are refused. Rows without any bytes all go to
    shard 0.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    if taken := {"shard", "slot", *_OWN} & set(rows.columns):
        raise ValueError(f"these column names are taken: {sorted(taken)}")
    # The tie keeps a row that repeats very often from filling one range.
    placed = rows.withColumn("_tie", F.monotonically_increasing_id())
    placed = placed.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    schema = StructType([*placed.schema.fields, StructField("_part", IntegerType()), StructField("_row", LongType()),
                         StructField("_before", LongType())])
    spark = rows.sparkSession
    placed = spark.read.schema(schema).parquet(staged_at(placed.mapInArrow(_running(size), schema), "shards"))
    # One row per range partition: small, whatever the table holds.
    totals = placed.groupBy("_part").agg(F.sum(size).alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "_part", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_part_bytes"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_part_rows"),
        F.sum("_bytes").over(everything).alias("_total"))
    # Twice the middle byte against twice the total, in whole numbers past 64 bits.
    share = (f"cast(2 * (_part_bytes + _before) + {_quoted(size)} as decimal(24, 0)) * {shards} "
             "div cast(2 * _total as decimal(24, 0))")
    cut = (placed.join(F.broadcast(totals), "_part")
           .withColumn("shard", F.when(F.col("_total") > 0, F.least(F.expr(share), F.lit(shards - 1)))
                       .otherwise(0).cast("int"))
           .withColumn("_row", F.col("_part_rows") + F.col("_row")))
    firsts = cut.groupBy("shard").agg(F.min("_row").alias("_first"))  # one row per shard
    return cut.join(F.broadcast(firsts), "shard").select(
        *rows.columns, "shard", (F.col("_row") - F.col("_first")).alias("slot"))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
