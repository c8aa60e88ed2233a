"""Tables as numbered snapshots, append-only logs and relational scans.

A snapshot is written to a folder of its own and is complete once Spark's
``_SUCCESS`` marker is there. Nothing is overwritten in place, so a lost job
leaves the previous snapshot readable and can simply run again.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake.operators.vectors import (
    BLOCK_ROWS, RESULT, Clusters, cluster, ranked, routed, search_clusters, visited_clusters)
from carelake.session import staged


def _folder(base: str, version: int) -> str:
    return f"{base.rstrip('/')}/v={version:010d}"


def write_snapshot(rows: DataFrame, base: str, version: int) -> None:
    """Full refresh: one complete overwrite of this version's folder."""
    rows.write.mode("overwrite").parquet(_folder(base, version))


def read_snapshot(spark: SparkSession, base: str, version: int) -> DataFrame:
    return spark.read.parquet(_folder(base, version))


def latest_version(spark: SparkSession, base: str) -> int | None:
    """Highest complete version below ``base``."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/v=*/_SUCCESS")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    versions = [int(s.getPath().getParent().getName()[2:]) for s in (found or [])]
    return max(versions, default=None)


def append_log(rows: DataFrame, path: str, batch: str, at: str = "created_at", unit: str = "day") -> None:
    """Append the log rows of one batch, one folder per day (or month, or year).

    A batch has a folder of its own, named by ``batch``: a job that runs again
    after a lost driver writes the same folder again, so no row is there twice.
    Rebalancing gathers a period into few files, and splits a period that
    holds most of the rows over many tasks.
    """
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch):
        raise ValueError(f"no name of a batch: {batch!r}")
    dated = rows.withColumn("log_date", F.to_date(F.date_trunc(unit, at)))
    dated.hint("rebalance", "log_date").write.mode("overwrite").partitionBy("log_date").parquet(
        f"{path.rstrip('/')}/batch={batch}")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all finished batches, with ``batch`` and ``log_date``; a batch that is being written is not among them."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/batch=*/_SUCCESS")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    done = sorted(s.getPath().getParent().toString() for s in (found or []))
    if not done:
        raise ValueError(f"no finished batch at {path}")
    return spark.read.option("basePath", path).parquet(*done)


def scan(spark: SparkSession, path: str, query: str, columns: list[str] | None = None, **args) -> DataFrame:
    """Run ``query`` over the table at ``path``, named ``{rows}`` in it, with bound ``:name`` values."""
    rows = spark.read.parquet(path)
    return spark.sql(query, args=args, rows=rows.select(*columns) if columns else rows)


def scan_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int,
              **options: str) -> DataFrame:
    """The same from a database, when its driver is on the class path: ``parts`` ranges of ``column``, one task each."""
    return spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts,
        **options).load()


def write_vector_index(documents: DataFrame, path: str, metric: str = "l2sq") -> None:
    """Documents with ``vec_id`` and ``embedding`` in one folder per cluster, and the clusters beside them.

    A cluster is split by its measured size, so a large one is no single file.
    """
    placed, clusters = cluster(documents.select("vec_id", "embedding"), metric)
    rows = documents.drop("embedding").join(placed.drop("off"), "vec_id").withColumn(
        "_piece", F.pmod(F.xxhash64("vec_id"), clusters.blocks(BLOCK_ROWS)) if len(clusters.held) else F.lit(0))
    rows.repartition("cluster", "_piece").drop("_piece").write.mode("overwrite").partitionBy("cluster").parquet(
        f"{path}/vectors")
    told = [(i, [float(x) for x in clusters.centres[i]], int(n), float(clusters.radius[i]), metric)
            for i, n in enumerate(clusters.held)]
    documents.sparkSession.createDataFrame(
        told, "cluster int, centre array<double>, n bigint, radius double, metric string").write.mode(
        "overwrite").parquet(f"{path}/clusters")


def read_vector_index(spark: SparkSession, path: str) -> DataFrame:
    """The documents of an index with their cluster."""
    return spark.read.parquet(f"{path}/vectors")


def search_vector_index(spark: SparkSession, path: str, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, distance, rank`` from a stored index; only the folders that some query must visit are read."""
    told = spark.read.parquet(f"{path}/clusters").orderBy("cluster").collect()  # the root of the catalogue's size
    if not told:
        return ranked(spark.createDataFrame([], RESULT), k)
    clusters = Clusters(np.array([r["centre"] for r in told]), np.array([r["n"] for r in told]),
                        np.array([r["radius"] for r in told]), told[0]["metric"])
    asked = staged(routed(queries, clusters, k), "routed")
    visited = visited_clusters(asked)
    index = read_vector_index(spark, path).where(F.col("cluster").isin(visited)) if visited else \
        read_vector_index(spark, path).limit(0)
    return ranked(search_clusters(asked, index, clusters, k, asked.count()), k)
