"""Where rows sit and how often an expression runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TASK_BYTES = 128 * 1024 * 1024


def with_once(df: DataFrame, **values: Column) -> DataFrame:
    """Add columns that are worked out once per row.

    The optimizer copies a cheap-looking expression into every filter and
    projection that uses it. It does not do so past a generator, so a page is
    parsed, or a text searched, one time.
    """
    row = F.struct(*[v.alias(n) for n, v in values.items()])
    return df.select("*", F.inline(F.array(row)))


def planned_bytes(df: DataFrame) -> int:
    """Size the optimizer expects; for rows read from files, the size of the files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """Spread a small input with costly rows over all cores; leave a large one as it is.

    A file of one row group is one task, however long each row takes. Input
    that fills the cores anyway is never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if planned_bytes(df) < cores * TASK_BYTES else df
