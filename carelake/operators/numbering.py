"""Row numbers and fixed-size chunks without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carelake.session import cut_lineage

_LOCAL_BITS = 33  # monotonically_increasing_id: partition above, position below


def number_rows(df: DataFrame, order: list[str], group: list[str], name: str = "row_no") -> DataFrame:
    """Number rows from 0 along ``order`` inside each ``group``.

    Rows are range-partitioned by group and order, so a huge group spans many
    tasks. Each partition knows the positions of its own rows; the offset of a
    group in a partition is the count of its rows in the partitions before.
    The placement is written once, as both passes must see the same one.
    """
    placed = cut_lineage(
        df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
        .withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.withColumns({
        "_part": F.shiftright("_id", _LOCAL_BITS),
        "_at": F.col("_id").bitwiseAND((1 << _LOCAL_BITS) - 1)})
    runs = placed.groupBy(*group, "_part").agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    return (placed.join(offsets, [*group, "_part"])
            .withColumn(name, F.col("_before") + F.col("_at") - F.col("_first"))
            .drop("_id", "_part", "_at", "_first", "_before"))


def numbered_chunks(df: DataFrame, size: int, order: list[str], group: list[str]) -> DataFrame:
    """Chunks of ``size`` rows, numbered from 0 inside each group."""
    numbered = number_rows(df, order, group, "_row")
    return numbered.withColumn("chunk", F.floor(F.col("_row") / F.lit(size))).drop("_row")
