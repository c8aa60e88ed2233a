"""Exact top-k inner products by distributed histogram selection.

A block of queries is scored against every vector. No score is kept: each task
counts its scores into histograms, one per query, and the summed histograms
tell in which bin the k-th highest score lies. That bin is cut into bins again
until it is one score wide, which is then the exact k-th score. A last pass
keeps what reaches it and breaks ties by the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carelake.operators.numbering import number_rows
from carelake.session import scratch_path

#: Queries scored at once: their vectors are what each task is sent.
BLOCK_QUERIES = 1024
#: Bins of one histogram of one query.
BINS = 1024
#: Scores held at once in a task.
_CELLS = 1 << 19
_EXACT = 1 << 53


def _whole(batch: pa.RecordBatch, factor: int):
    """Per width: positions, ids and the vectors as whole numbers; unusable vectors are left out."""
    ids, lists = batch.column(0), batch.column(1)
    flat = lists.flatten()
    widths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    ends = np.cumsum(widths)
    scaled = np.floor(values * factor)
    good_value = np.isfinite(scaled)
    bad_before = np.concatenate([[0], np.cumsum(~good_value)])
    good = (bad_before[ends] == bad_before[ends - widths]) & (widths > 0)
    good &= ids.is_valid().to_numpy(zero_copy_only=False)
    keys = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for width in np.unique(widths[good]):
        rows = np.flatnonzero(good & (widths == width))
        at = (ends - widths)[rows][:, None] + np.arange(width)
        yield int(width), rows, keys[rows], scaled[at]


def whole_vectors(vectors: DataFrame, factor: int) -> DataFrame:
    """``vec_id, v``: floor(factor * x) of each component, without the vectors that take no part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, ids, v in _whole(batch, factor):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(list(v.astype(np.int64)), pa.list_(pa.int64()))], names=["vec_id", "v"])
    return vectors.mapInArrow(run, "vec_id long, v array<long>")


class _Block:
    """The queries of one block and where the k-th score of each can still lie."""

    def __init__(self, rows: list, factor: int, k: int, largest: dict[int, int]):
        self.factor, self.k = factor, k
        self.row = np.array([r["row_no"] for r in rows], np.int64)
        self.id = np.array([r["vec_id"] for r in rows], np.int64)
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for width in sorted({len(r["v"]) for r in rows}):
            at = np.array([i for i, r in enumerate(rows) if len(r["v"]) == width])
            self.by_width[width] = at, np.array([rows[i]["v"] for i in at], np.float64)
        reach = np.zeros(len(rows), object)
        for width, (at, q) in self.by_width.items():
            reach[at] = [int(x) * largest.get(width, 0) for x in np.abs(q).sum(axis=1)]
        if any(x >= _EXACT for x in reach):
            raise ValueError("scores past 2^53 cannot be told apart exactly; use a smaller factor")
        reach = reach.astype(np.int64)
        self.low, self.span = -reach, 2 * reach + 1  # the k-th score is in [low, low + span)
        self.above = np.zeros(len(rows), np.int64)  # scores already known to lie above that
        self.step = self.steps()

    def steps(self) -> np.ndarray:
        return -(-self.span // BINS)

    def scores(self, batch: pa.RecordBatch):
        """Per width and slice of candidates: query positions, candidate ids, scores, and who may pair."""
        for width, _, ids, v in _whole(batch, self.factor):
            if width not in self.by_width:
                continue
            at, q = self.by_width[width]
            size = max(1, _CELLS // len(at))
            for i in range(0, len(ids), size):
                own = ids[None, i:i + size] == self.id[at][:, None]
                yield at, ids[i:i + size], (q @ v[i:i + size].T).astype(np.int64), ~own


def _histograms(block: _Block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(block.id)
        counts = np.zeros((n, BINS), np.int64)
        for batch in batches:
            for at, _, scores, other in block.scores(batch):
                bins = (scores - block.low[at][:, None]) // block.step[at][:, None]
                use = other & (bins >= 0) & (scores < (block.low + block.span)[at][:, None])
                cells = (at[:, None] * BINS + bins)[use]
                counts += np.bincount(cells, minlength=n * BINS).reshape(n, BINS)
        # Bins below those that hold k scores of this task alone cannot hold the k-th of all.
        higher = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        q, b = np.nonzero((counts > 0) & (higher < block.k))
        yield pa.RecordBatch.from_arrays(
            [pa.array(q.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(counts[q, b])], names=["q", "b", "n"])
    return run


def _best(block: _Block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            for at, ids, scores, other in block.scores(batch):
                q, j = np.nonzero(other & (scores >= block.low[at][:, None]))
                held = [np.concatenate(x) for x in zip(held, (at[q], -scores[q, j], ids[j]))]
                order = np.lexsort((held[2], held[1], held[0]))
                held = [x[order] for x in held]
                first = np.searchsorted(held[0], held[0])  # only k of each query can be among the k best of all
                held = [x[np.arange(len(first)) - first < block.k] for x in held]
        yield pa.RecordBatch.from_arrays(
            [pa.array(block.row[held[0]]), pa.array(block.id[held[0]]), pa.array(held[2]), pa.array(-held[1])],
            names=["row_no", "query_id", "vec_id", "score"])
    return run


def _refine(vectors: DataFrame, block: _Block) -> None:
    """Narrow every query's interval until it is one score wide."""
    while (block.span > 1).any():
        block.step = block.steps()
        down = Window.partitionBy("q").orderBy(F.desc("b"))
        bins = (vectors.mapInArrow(_histograms(block), "q long, b long, n long")
                .groupBy("q", "b").agg(F.sum("n").alias("n"))
                .withColumn("upto", F.sum("n").over(down)))
        need = F.element_at(F.lit(np.maximum(block.k - block.above, 1).tolist()), (F.col("q") + 1).cast("int"))
        found = bins.where((F.col("upto") >= need) & (F.col("upto") - F.col("n") < need)).select(
            "q", "b", (F.col("upto") - F.col("n")).alias("higher"))
        seen = np.zeros(len(block.id), bool)
        for r in found.collect():  # one row per query of the block
            q = r["q"]
            seen[q] = True
            block.above[q] += r["higher"]
            low = block.low[q] + r["b"] * block.step[q]
            block.span[q] = min(block.step[q], block.low[q] + block.span[q] - low)
            block.low[q] = low
        block.span[~seen] = 1  # fewer than k candidates: all of them, from the lowest score on


def top_k(vectors: DataFrame, queries: DataFrame, k: int, factor: int = 256,
          block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest inner products of each query, ties to the smaller id.

    ``vectors`` and ``queries`` begin with an integer id and an array of
    numbers; further columns are not read. Components become
    floor(factor * x) and scores are exact. Every vector with another id than
    the query's is a candidate; fewer than k give fewer rows. Vectors that are
    null, empty or hold null or non-finite components, and rows without an
    id, take no part; vectors of different width have no score. Rows that
    repeat an id are candidates of their own, and a repeated query gives its
    rows again. No queries or no vectors give no rows.

    Queries go in blocks of ``block_queries``; a block is what tasks are sent.
    """
    def named(df):
        return df.select(df[df.columns[0]].cast("long").alias("vec_id"),
                         df[df.columns[1]].cast("array<double>").alias("v"))
    spark = vectors.sparkSession
    vectors, queries = named(vectors), named(queries)
    asked = number_rows(whole_vectors(queries, factor), ["vec_id", "v"], [])
    path = scratch_path(spark, "topk-queries")
    asked.withColumn("block", F.floor(F.col("row_no") / block_queries)).write.parquet(path)
    asked = spark.read.parquet(path)
    blocks = [r["block"] for r in asked.select("block").distinct().orderBy("block").toLocalIterator()]

    def extremes(batches):
        most: dict[int, float] = {}
        for batch in batches:
            for width, _, _, v in _whole(batch, factor):
                most[width] = max(most.get(width, 0), np.abs(v).max())
        yield pa.RecordBatch.from_arrays([pa.array(most.keys(), pa.int64()),
                                          pa.array(most.values(), pa.float64())], names=["width", "most"])
    schema = "row_no long, query_id long, vec_id long, score long"
    out = scratch_path(spark, "topk")
    spark.createDataFrame([], schema).write.parquet(out)
    if blocks:
        widths = asked.select(F.size("v").alias("width")).distinct()
        largest = {r["width"]: int(r["most"]) for r in
                   vectors.mapInArrow(extremes, "width long, most double").groupBy("width").agg(
                       F.max("most").alias("most")).join(widths, "width", "left_semi").collect()}
        for b in blocks:
            rows = asked.where(F.col("block") == b).orderBy("row_no").collect()  # at most block_queries
            block = _Block(rows, factor, k, largest)
            _refine(vectors, block)
            vectors.mapInArrow(_best(block), schema).write.mode("append").parquet(out)
    best = Window.partitionBy("row_no").orderBy(F.desc("score"), "vec_id")
    return (spark.read.schema(schema).parquet(out).withColumn("rank", F.row_number().over(best))
            .where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
