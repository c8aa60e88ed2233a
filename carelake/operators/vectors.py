"""Exact top-k by vector distance; lower is closer for every metric.

Few queries go to the data: each task scans its part of the catalogue once and
returns k rows per query. Many queries meet the catalogue in blocks of bounded
size, and a query only visits the clusters that can still hold one of its k
nearest. Both sides are packed into blocks once; tasks read the pairs of blocks
that have to meet and return k rows per query, never all pairs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("l2sq", "cosine", "dot")
FEW_QUERIES = 2048          # query vectors held by every task
BLOCK_ROWS = 20_000         # vectors of one side in one block
BLOCK_BYTES = 1 << 21       # of the vectors of one block
HELD_BYTES = 1 << 25        # of the vectors of the catalogue that one task holds
SLICE = 128                 # queries whose distances to a block are held at once
CELLS = 1 << 20             # distances to centres that are held at once
PAIRS = 1 << 13             # pairs of vectors whose precise distances are worked out at once
RESULT = "query_id bigint, vec_id bigint, distance double"


def _matrix(column) -> np.ndarray:
    arrays = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(arrays) == 0:
        return np.zeros((0, 0))
    widths = np.unique(arrays.value_lengths().to_numpy(zero_copy_only=False))
    if len(widths) > 1:
        raise ValueError(f"embeddings of different widths: {widths.tolist()}")
    return arrays.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(arrays), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
    return m / np.where(norm == 0, 1, norm)


def _rough(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """All distances of two blocks, up to rounding."""
    if metric == "l2sq":
        return (np.einsum("ij,ij->i", q, q)[:, None] - 2 * q @ v.T
                + np.einsum("ij,ij->i", v, v)[None, :])
    if metric == "cosine":
        return 1 - _unit(q) @ _unit(v).T
    return -(q @ v.T)


def _slack(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """More than twice what rounding can change in the rough distances, per query."""
    unit = 16 * np.finfo(np.float64).eps * (q.shape[1] + 8)
    if metric == "cosine":
        return np.full(len(q), 4 * unit)
    own = np.einsum("ij,ij->i", q, q)
    most = np.einsum("ij,ij->i", v, v).max(initial=0)
    return unit * (own + most) if metric == "l2sq" else unit * np.sqrt(own * most)


def _precise(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Distances of one query, or of one for each row; equal vectors give equal values, so ids break ties."""
    if metric == "l2sq":
        d = v - q
        return np.einsum("ij,ij->i", d, d)
    q = np.broadcast_to(q, v.shape)
    dot = np.einsum("ij,ij->i", v, q)
    if metric == "dot":
        return -dot
    norm = np.sqrt(np.einsum("ij,ij->i", v, v) * np.einsum("ij,ij->i", q, q))
    return 1 - dot / np.where(norm == 0, 1, norm)


def _k_best(row: np.ndarray, vid: np.ndarray, dist: np.ndarray, k: int):
    """The k best of each row, in order of row, distance and id, and the place of each within its row."""
    order = np.lexsort((vid, dist, row))
    row, vid, dist = row[order], vid[order], dist[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    some = place < k
    return row[some], vid[some], dist[some], place[some]


def _nearest(q: np.ndarray, v: np.ndarray, vids: np.ndarray, k: int, metric: str, bound: np.ndarray | None = None):
    """``row, id, distance`` of the k best of each query row in the block, some rows at a time; none beyond its ``bound``.

    Distances do not change when both sides move, but their rounding does: it
    grows with the norms. So the block is moved to its own centre first.
    """
    centre = v.mean(axis=0) if metric == "l2sq" and len(v) else 0
    near, there = q - centre, v - centre
    for start in range(0, len(q), SLICE):
        rough = _rough(near[start:start + SLICE], there, metric)
        margin = _slack(near[start:start + SLICE], there, metric)
        edge = np.full(len(rough), np.inf) if bound is None else bound[start:start + SLICE] + margin
        if not np.isfinite(edge).all() or np.count_nonzero(rough <= edge[:, None]) > 8 * k * len(rough):
            most = np.partition(rough, k - 1, axis=1)[:, k - 1] if len(v) > k else rough.max(axis=1)
            edge = np.minimum(edge, most + margin)
        row, at = np.nonzero(rough <= edge[:, None])
        row += start
        dist = [_precise(q[row[i:i + PAIRS]], v[at[i:i + PAIRS]], metric) for i in range(0, len(row), PAIRS)]
        yield _k_best(row, vids[at], np.concatenate([np.empty(0), *dist]), k)[:3]


def block_best(q: np.ndarray, v: np.ndarray, vids: np.ndarray, k: int, metric: str):
    """Per query row, the ids and distances of its k best in the block."""
    start = 0
    for row, vid, dist in _nearest(q, v, vids, k, metric):
        stop = min(start + SLICE, len(q))
        ends = np.searchsorted(row, np.arange(start, stop + 1))
        for i in range(start, stop):
            own = slice(ends[i - start], ends[i - start + 1])
            yield i, vid[own], dist[own]
        start = stop


def _result(qids, vids, dist) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(qids, pa.int64()), pa.array(vids, pa.int64()), pa.array(dist, pa.float64())],
        names=["query_id", "vec_id", "distance"])


def _scan_few(qids: np.ndarray, q: np.ndarray, k: int, metric: str):
    def scan(batches):
        best_ids = [np.empty(0, np.int64)] * len(qids)
        best = [np.empty(0)] * len(qids)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            for i, vid, d in block_best(q, _matrix(batch.column("embedding")), ids, k, metric):
                vid, d = np.concatenate([best_ids[i], vid]), np.concatenate([best[i], d])
                pick = np.lexsort((vid, d))[:k]
                best_ids[i], best[i] = vid[pick], d[pick]
        if len(qids):
            yield _result(np.repeat(qids, [len(b) for b in best]), np.concatenate(best_ids),
                          np.concatenate(best))
    return scan


def _slices(rows: int, centres: int) -> list[slice]:
    """Rows whose distances to all centres may be held at once."""
    step = max(1, CELLS // max(1, centres))
    return [slice(i, i + step) for i in range(0, rows, step)]


def _assign(centres: np.ndarray, unit: bool):
    """Nearest centre and distance to it, for each row."""
    middle = centres.mean(axis=0)

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("embedding"))
            own = _unit(v) if unit else v
            near = np.concatenate([_rough(own[some] - middle, centres - middle, "l2sq").argmin(axis=1)
                                   for some in _slices(len(own), len(centres))])
            gap = own - centres[near]  # any near centre will do, but the distance to it must be right
            dist = np.sqrt(np.einsum("ij,ij->i", gap, gap)) * (1 + 1e-9)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("embedding"),
                 pa.array(near, pa.int32()), pa.array(dist, pa.float64())],
                names=["vec_id", "embedding", "cluster", "off"])
    return assign


def _reach(q: np.ndarray, centres: np.ndarray, radius: np.ndarray, metric: str):
    """Least and most distance of each query to the vectors of each cluster.

    By the triangle inequality for lengths, and by that of Cauchy and Schwarz
    for products; rounding is allowed for on both sides.
    """
    if metric == "dot":
        product = q @ centres.T
        give = np.sqrt(np.einsum("ij,ij->i", q, q))[:, None] * radius + _slack(q, centres, metric)[:, None]
        return -product - give, -product + give
    own = _unit(q) if metric == "cosine" else q
    middle = centres.mean(axis=0)
    square = _rough(own - middle, centres - middle, "l2sq")
    slack = _slack(own - middle, centres - middle, "l2sq")[:, None]
    low, high = np.sqrt(np.maximum(square - slack, 0)), np.sqrt(np.maximum(square + slack, 0))
    return low - radius, high + radius


def _route(centres: np.ndarray, radius: np.ndarray, held: np.ndarray, k: int, metric: str):
    """The clusters each query must visit: those that may hold something as near as k vectors surely are."""
    def visits(q):
        least, far = _reach(q, centres, radius, metric)
        order = np.argsort(far, axis=1)
        total = np.cumsum(held[order], axis=1)
        at = np.minimum((total < k).sum(axis=1), len(held) - 1)
        bound = np.take_along_axis(far, order, 1)[np.arange(len(at)), at]
        bound = np.where(total[:, -1] < k, np.inf, bound)
        return order[:, 0], (least <= bound[:, None] + 1e-12 * np.abs(bound[:, None])) & (held > 0)

    def route(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column("embedding"))
            for some in _slices(len(q), len(centres)):
                near, visit = visits(q[some])
                bits = pa.array([row.tobytes() for row in np.packbits(visit, axis=1)], pa.binary())
                own = batch.slice(some.start, len(near))
                yield pa.RecordBatch.from_arrays(
                    [own.column("query_id"), own.column("embedding"), pa.array(near, pa.int32()), bits],
                    names=["query_id", "embedding", "cluster", "visits"])
    return route


def _pack(id_name: str, rows: int):
    """One row per block of so many vectors, in the order they come, with the clusters they lie in or visit."""
    def block(held):
        table = pa.Table.from_batches(held)
        ids, vectors = table.column(id_name).to_numpy(), _matrix(table.column("embedding"))
        if "visits" in table.column_names:
            bits = b"".join(table.column("visits").to_pylist())
            clusters = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(
                np.frombuffer(bits, np.uint8).reshape(len(ids), -1), axis=0)))
        else:
            bits, clusters = b"", np.unique(table.column("cluster").to_numpy())
        return pa.RecordBatch.from_arrays(
            [pa.array([ids.astype(np.int64).tobytes()], pa.binary()), pa.array([vectors.tobytes()], pa.binary()),
             pa.array([bits], pa.binary()), pa.array([clusters.astype(np.int32)], pa.list_(pa.int32()))],
            names=["ids", "vectors", "visits", "clusters"])

    def pack(batches):
        held, count = [], 0
        for batch in batches:
            while batch.num_rows:
                some = batch.slice(0, rows - count)
                batch, count = batch.slice(some.num_rows), count + some.num_rows
                held.append(some)
                if count == rows:
                    yield block(held)
                    held, count = [], 0
        if held:
            yield block(held)
    return pack


def _blocks(df: DataFrame, id_name: str, rows: int, parts: int) -> DataFrame:
    """``ids, vectors, visits, clusters`` of blocks, dealt over ``parts`` partitions; neighbours come together."""
    return df.sortWithinPartitions("cluster").mapInArrow(
        _pack(id_name, rows), "ids binary, vectors binary, visits binary, clusters array<int>").repartition(parts)


def _meet(k: int, metric: str):
    """Pairs of blocks, those of one block of queries behind each other: the k best of each query in all of these."""
    def meet(batches):
        last, best, bound = None, None, None
        for batch in batches:
            for ids, vectors, visits, vids, others, clusters in zip(*(batch.column(i) for i in range(6))):
                if last is None or not last.equals(ids):
                    if last is not None:
                        yield _result(qids[best[0]], best[1], best[2])
                    last, qids = ids, np.frombuffer(ids.as_buffer(), np.int64)
                    q = np.frombuffer(vectors.as_buffer(), np.float64).reshape(len(qids), -1)
                    bits = np.frombuffer(visits.as_buffer(), np.uint8).reshape(len(qids), -1)
                    best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
                    bound = np.full(len(qids), np.inf)
                there = clusters.values.to_numpy()
                use = np.flatnonzero((bits[:, there >> 3] & (128 >> (there & 7)).astype(np.uint8)).any(axis=1))
                vids = np.frombuffer(vids.as_buffer(), np.int64)
                v = np.frombuffer(others.as_buffer(), np.float64).reshape(len(vids), -1)
                found = [best] + [(use[row], vid, d) for row, vid, d in _nearest(q[use], v, vids, k, metric, bound[use])]
                *best, place = _k_best(*map(np.concatenate, zip(*found)), k)
                bound[best[0][place == k - 1]] = best[2][place == k - 1]
        if last is not None:
            yield _result(qids[best[0]], best[1], best[2])
    return meet


def _vector_rows(df: DataFrame, id_name: str) -> DataFrame:
    """Ids and vectors; rows without a vector, or with a gap in it, take no part."""
    whole = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", F.isnull)
    return df.where(whole).select(F.col(id_name).cast("bigint").alias(id_name),
                     F.col("embedding").cast("array<double>").alias("embedding"))


def _driver_vectors(df: DataFrame, id_name: str) -> tuple[np.ndarray, np.ndarray]:
    rows = df.toArrow()
    return rows.column(id_name).to_numpy(), _matrix(rows.column("embedding"))


def similar(queries: DataFrame, catalogue: DataFrame, k: int = 10, metric: str = "l2sq",
            few: int = FEW_QUERIES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``queries(query_id, embedding)`` against ``catalogue(vec_id, embedding)``.

    Returns ``query_id, vec_id, distance, rank``. Filter the catalogue before
    the call, so that only eligible rows compete for the k places.
    """
    if metric not in METRICS:
        raise ValueError(metric)
    queries, catalogue = _vector_rows(queries, "query_id"), _vector_rows(catalogue, "vec_id")
    qids, q = _driver_vectors(queries.limit(few + 1), "query_id")
    if len(qids) <= few:
        found = catalogue.mapInArrow(_scan_few(qids, q, k, metric), RESULT)
    else:
        found = _in_blocks(queries, catalogue, k, metric, block_rows)
    return ranked(found, k)


def centres_of(catalogue: DataFrame, wanted: int) -> np.ndarray:
    """Pivots: the vectors with the smallest id hashes, a fixed number of them."""
    picked = catalogue.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted)
    return _driver_vectors(picked, "vec_id")[1]


def clustered(catalogue: DataFrame, centres: np.ndarray, unit: bool = False) -> DataFrame:
    """Catalogue rows with their nearest centre and the distance to it."""
    return catalogue.mapInArrow(
        _assign(_unit(centres) if unit else centres, unit),
        "vec_id bigint, embedding array<double>, cluster int, off double")


@dataclass
class Clusters:
    """Centres of a clustered catalogue, how many vectors each holds, and how far the farthest lies."""

    centres: np.ndarray
    held: np.ndarray
    radius: np.ndarray
    metric: str

    def blocks(self, block_rows: int) -> Column:
        """Pieces of about ``block_rows`` vectors that the cluster in column ``cluster`` has."""
        return F.get(F.array(*[F.lit(max(1, math.ceil(int(n) / block_rows))) for n in self.held]), F.col("cluster"))


def cluster(catalogue: DataFrame, metric: str = "l2sq") -> tuple[DataFrame, Clusters]:
    """``vec_id, embedding, cluster, off`` of a catalogue around as many centres as the root of its size."""
    catalogue = _vector_rows(catalogue, "vec_id")
    centres = centres_of(catalogue, max(1, math.isqrt(catalogue.count())))
    if metric == "cosine":
        centres = _unit(centres)
    if not len(centres):
        return catalogue.withColumns({"cluster": F.lit(0), "off": F.lit(0.0)}).limit(0), \
            Clusters(np.zeros((0, 1)), np.zeros(0, np.int64), np.zeros(0), metric)
    placed = clustered(catalogue, centres, metric == "cosine")
    held, radius = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for row in placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("off").alias("r")).collect():
        held[row["cluster"]], radius[row["cluster"]] = row["n"], row["r"]
    return placed, Clusters(centres, held, radius, metric)


def routed(queries: DataFrame, clusters: Clusters, k: int) -> DataFrame:
    """``query_id, embedding, cluster, visits``: the cluster next to each query, and one bit for each that it must visit."""
    return _vector_rows(queries, "query_id").mapInArrow(
        _route(clusters.centres, clusters.radius, clusters.held, k, clusters.metric),
        "query_id bigint, embedding array<double>, cluster int, visits binary")


def visited_clusters(asked: DataFrame) -> list[int]:
    """The clusters that any of the ``routed`` queries must visit."""
    def joined(batches):
        for batch in batches:
            if batch.num_rows:
                bits = np.frombuffer(b"".join(batch.column("visits").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bits, axis=0))),
                                                           pa.int32())], names=["cluster"])
    return [r["cluster"] for r in asked.select("visits").mapInArrow(joined, "cluster int").distinct().collect()]


def search_clusters(queries: DataFrame, placed: DataFrame, clusters: Clusters, k: int, asked: int,
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k nearest of each of ``asked`` ``routed`` queries among ``placed(vec_id, embedding, cluster)``, ranked per task only.

    Each side is shuffled once, in blocks. A task streams some blocks of
    queries past ``HELD_BYTES`` or so of the catalogue, so memory does not grow
    with the number of pairs, and vectors are not shuffled once per pair.
    """
    each = 8 * max(1, clusters.centres.shape[1])
    rows = max(1, min(block_rows, BLOCK_BYTES // each))
    there = math.ceil(int(clusters.held.sum()) * each / HELD_BYTES)
    cores = placed.sparkSession.sparkContext.defaultParallelism
    here = min(math.ceil(asked / rows), max(math.ceil(4 * cores / max(1, there)), math.ceil(asked * each / HELD_BYTES)))
    left = _blocks(queries, "query_id", rows, max(1, here)).toDF("ids", "vectors", "visits", "visited")
    right = _blocks(placed.select("vec_id", "embedding", "cluster"), "vec_id", rows, max(1, there)).drop("visits").toDF(
        "vids", "others", "clusters")
    pairs = left.join(right.hint("shuffle_replicate_nl"), F.arrays_overlap("visited", "clusters"))
    return pairs.drop("visited").mapInArrow(_meet(k, clusters.metric), RESULT)


def _in_blocks(queries: DataFrame, catalogue: DataFrame, k: int, metric: str,
               block_rows: int) -> DataFrame:
    placed, clusters = cluster(catalogue, metric)
    if not len(clusters.held):
        return catalogue.sparkSession.createDataFrame([], RESULT)
    return search_clusters(routed(queries, clusters, k), placed, clusters, k, queries.count(), block_rows)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query with their rank; ties to the smaller id."""
    best = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
