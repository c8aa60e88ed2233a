"""SimHash near-duplicates found by covering locality-sensitive hashing.

Every bit position is given a non-zero vector of ``radius + 1`` bits. Each
non-zero vector v makes one table: its mask keeps the positions whose vector
has an odd product with v. For two fingerprints that differ in at most
``radius`` positions, some v is orthogonal to the vectors of all of them (fewer
equations than unknowns), so their masked values agree in that table: no pair
within the radius is missed, which random bit samples cannot promise.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import and_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import map_text, refuse_names, utf8
from carelake.llm.components import components
from carelake.session import staged

SEED = 42
#: A bucket with more distinct fingerprints is split by a second covering of its free bits.
LARGE_BUCKET = 256
_BITS = 64
_CHUNK = 1 << 16


def _simhash(words: list[bytes], width: int) -> int:
    """64 bits, as a signed number; each set in over half of the shingles' hashes."""
    if not words:
        return 0
    parts = [words[i:] for i in range(width)] if len(words) >= width else [[w] for w in words]
    n = len(parts[-1]) if len(words) >= width else 1
    return majority(np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*parts)), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """64 bits, as a signed number; each set in over half of the hashes. None give 0."""
    n = len(hashes)
    ones = np.zeros(_BITS, np.int64)
    for at in range(0, n, _CHUNK):
        piece = hashes[at:at + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(piece, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def _fingerprint_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_simhash(text.lower().split(), width) for text in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])
    return run


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, fp``: the SimHash of each text over shingles of ``width`` words.

    A-Z are lowered, words end at ASCII white space. A text of fewer words is
    one shingle; a text without words, or null, has fingerprint 0.
    """
    return map_text(docs.select(F.col("doc_id").cast("long"), "text"), _fingerprint_rows(width),
                    "doc_id long, fp long")


@lru_cache
def masks(radius: int, turn: int = 0) -> tuple[int, ...]:
    """One bit mask per table, as signed 64-bit numbers; ``turn`` 1 gives the positions other vectors.

    Of the ways to deal the vectors out in even steps, the one is taken whose
    lightest mask keeps most bits, as short keys make large buckets.
    """
    vectors = (1 << radius + 1) - 1
    odd = np.array([[(a & b).bit_count() % 2 for b in range(1, vectors + 1)] for a in range(1, vectors + 1)])
    steps = sorted((-int(odd[:, _dealt(step, vectors)].sum(axis=1).min()), step) for step in range(1, vectors))
    kept = np.ascontiguousarray(odd[:, _dealt(steps[min(turn, len(steps) - 1)][1], vectors)])
    return tuple(int(x) for x in np.ascontiguousarray(np.packbits(kept.astype(np.uint8), axis=1, bitorder="little")).view("<i8").ravel())


def _dealt(step: int, vectors: int) -> np.ndarray:
    at = np.arange(_BITS)
    return (at * step + at // vectors) % vectors


def _keyed(rows: DataFrame, radius: int, turn: int, name: str) -> DataFrame:
    cases = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(m).alias("m")) for i, m in enumerate(masks(radius, turn))])
    return rows.withColumn(name, F.explode(cases))


def _pairs(keyed: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Links inside buckets; the distance is tested in the join itself, so no other pair is made."""
    left = keyed.select(*keys, F.col("fp").alias("a"))
    right = keyed.select(*keys, F.col("fp").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]
    return left.alias("l").join(right.alias("r"), reduce(and_, same, near)).select("a", "b")


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """``a, b``: all pairs of different fingerprints in ``fps.fp`` that differ in 1 to ``radius`` bits."""
    keyed = _keyed(fps.select("fp").distinct(), radius, 0, "c").select(
        F.col("c.t").alias("t"), F.col("c.m").alias("m"), F.col("fp").bitwiseAND(F.col("c.m")).alias("k"), "fp")
    sizes = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keyed = staged(keyed.join(sizes, ["t", "k"]), "buckets")
    plain = _pairs(keyed.where(F.col("n") <= LARGE_BUCKET), ["t", "k"], radius)
    # Inside a bucket only the bits outside its mask can differ: cover those again.
    split = _keyed(keyed.where(F.col("n") > LARGE_BUCKET), radius, 1, "c").select(
        "t", F.col("c.t").alias("t2"), F.col("fp").bitwiseAND(F.col("m").bitwiseOR(F.col("c.m"))).alias("k"), "fp")
    return plain.unionByName(_pairs(split, ["t", "t2", "k"], radius)).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """``doc_id, fp, component_id``: one row per row of ``docs``.

    Fingerprints that differ in at most ``radius`` bits are linked;
    ``component_id`` is the smallest doc_id that a chain of links reaches,
    the document's own included. Null and empty texts share fingerprint 0 and
    are linked like any other; equal texts need no pair, as they share the
    fingerprint. Rows with a null doc_id are linked too but name no component.
    Other columns of ``docs`` are not read; an empty table gives no rows.
    """
    prints = staged(fingerprints(docs, width), "fingerprints")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = staged(components(links(least, radius)), "roots")
    groups = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    named = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(groups.join(named, "root").select("fp", "component_id"), "fp").select(
        "doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, as ``one_of_each`` says."""
    return one_of_each(docs, near_duplicates(docs, width, radius))


def one_of_each(docs: DataFrame, named: DataFrame) -> DataFrame:
    """``docs`` with one document of each group, of ``named.doc_id, component_id``: that of the smallest doc_id.

    Rows that repeat a doc_id are versions of one document: it stays if any of
    them is the first of its group, as the version with the smallest text.
    Rows without a doc_id cannot be named and all stay. Columns named
    ``__rows`` or ``__first`` are refused.
    """
    refuse_names(docs, "__rows", "__first")
    kept = named.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("__rows"), F.bool_or(F.col("component_id") == F.col("doc_id")).alias("__first"))
    found = docs.join(kept.where("__first").drop("__first"), "doc_id")
    whole = F.struct(F.coalesce("text", F.lit("")).alias("t"), F.struct(*docs.columns).alias("r"))
    once = found.where("__rows = 1").select(*docs.columns)
    again = found.where("__rows > 1").groupBy("doc_id").agg(F.min(whole).alias("m")).select("m.r.*")
    return once.unionByName(again).unionByName(docs.where("doc_id IS NULL"))
