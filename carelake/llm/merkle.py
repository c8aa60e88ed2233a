"""A Merkle manifest of a dataset: a tree per group, one tree over the groups' roots, and a proof for every row.

Rows of a tree are numbered in order and cut into aligned blocks of
``fanout ** BLOCK_LEVELS`` leaves. A task hashes a block up to its top node.
What lies above is a butterfly exchange: in round ``r`` the blocks that differ
only in digit ``r`` of their number, written to the base of the fanout, meet
and swap the nodes that they have reached. Each then hashes the same parent
for itself and keeps the siblings it was sent. So after the last round every
block knows its root and its whole upper proof, and nothing is ever sent back
down. Where the last subtree of a level has fewer blocks than its neighbours,
its blocks answer for the missing ones as well, in turn, so a round sends at
most ``fanout`` nodes for each block.

The roots of the groups are the leaves of one more tree, built the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.operators.numbering import number_rows
from carelake.session import staged

FANOUT = 3
#: Levels inside a block: what one task hashes by itself, ``fanout ** BLOCK_LEVELS`` leaves at most.
BLOCK_LEVELS = 6

_PATH = "array<struct<before:string,after:string>>"


def digest(parts) -> str:
    """Lowercase hex sha256 of hex digests (or other ASCII text), one after the other."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def row_digest(columns: list[Column]) -> Column:
    """One digest of a row: each value as its UTF-8 byte count, a colon and itself, or ``-`` if null."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
                             for c in text]), 256)


def levels_of(nodes: list[str], fanout: int, further: int | None) -> list[list[str]]:
    """All levels from the leaves up: so many further ones, or with None up to the one root."""
    levels = [nodes]
    while len(levels[-1]) > 1 if further is None else len(levels) <= further:
        last = levels[-1]
        levels.append([digest(last[i:i + fanout]) for i in range(0, len(last), fanout)])
    return levels


def steps_of(levels: list[list[str]], at: int, fanout: int) -> list[tuple[str, str]]:
    """The siblings before and after a leaf's ancestor, level by level up to the top of ``levels``."""
    steps = []
    for level in levels[:-1]:
        run = at // fanout * fanout
        steps.append(("".join(level[run:at]), "".join(level[at + 1:run + fanout])))
        at //= fanout
    return steps


def _blocks(leaves: DataFrame, fanout: int, block_levels: int) -> DataFrame:
    """``tree, block, members``: aligned blocks of the numbered leaves."""
    size = fanout ** block_levels
    numbered = number_rows(leaves.withColumn("tie", F.monotonically_increasing_id()), ["key", "leaf", "tie"], ["tree"], "pos")
    return staged(numbered.groupBy("tree", F.expr(f"pos div {size}").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "key", "leaf", "given"))).alias("members")), "merkle-blocks")


def _tops(blocks: DataFrame, fanout: int, block_levels: int) -> DataFrame:
    """``tree, block, blocks, node``: the top node of each block, and the number of blocks of its tree.

    A block alone in its tree ends at its one root, others at their last level;
    which of both it is, is told once the narrow rows have met their tree's count.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2).to_pylist()
            ends = [pa.array([levels_of(leaves, fanout, further)[-1][0] for leaves in rows], pa.string())
                    for further in (None, block_levels)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *ends], names=["tree", "block", "alone", "node"])
    tops = staged(blocks.select("tree", "block", "members.leaf").mapInArrow(
        run, "tree string, block long, alone string, node string"), "merkle-tops")
    counts = tops.groupBy("tree").agg((F.max("block") + 1).alias("blocks"))
    return tops.join(counts, "tree").select(
        "tree", "block", "blocks", F.when(F.col("blocks") == 1, F.col("alone")).otherwise(F.col("node")).alias("node"))


def butterfly(tops: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``tree, block, blocks, node, path``: every block's root, and the siblings above the block, by exchange in rounds."""
    most = tops.agg(F.max("blocks")).first()[0] or 1
    state, span = tops.withColumn("path", F.array().cast(_PATH)), 1
    while span < most:
        node_no, low = F.expr(f"block div {span}"), F.col("block") % span
        # Blocks below the node that this one has reached: fewer than span at the ragged end, which then answer in turn.
        held = F.least(F.lit(span), F.col("blocks") - node_no * span)
        to = F.when(F.col("blocks") > span, F.sequence(low, F.lit(span - 1).cast("long"), held)).otherwise(F.array(low))
        sent = state.withColumns({"at": node_no, "own": low}).withColumn("to", F.explode(to))
        own = F.when(F.col("to") == F.col("own"), F.struct("block", "blocks", "path"))
        met = sent.groupBy("tree", F.expr(f"at div {fanout}").alias("run"), "to").agg(
            F.sort_array(F.collect_list(F.struct("at", "node", own.alias("mine")))).alias("met"))
        each = met.select("tree", "met", F.explode("met").alias("me")).where("me.mine IS NOT NULL")

        def nodes(keep):
            return F.array_join(F.transform(F.filter("met", keep), lambda e: e["node"]), "")
        step = F.struct(nodes(lambda e: e["at"] < F.col("me.at")).alias("before"),
                        nodes(lambda e: e["at"] > F.col("me.at")).alias("after"))
        still = F.col("me.mine.blocks") > span
        state = each.select(
            "tree", "me.mine.block", "me.mine.blocks",
            F.when(still, F.sha2(nodes(lambda e: F.lit(True)), 256)).otherwise(F.col("me.node")).alias("node"),
            F.when(still, F.concat("me.mine.path", F.array(step))).otherwise(F.col("me.mine.path")).alias("path"))
        span *= fanout
    return state


def _paths(blocks: DataFrame, fanout: int, block_levels: int) -> DataFrame:
    """``key, root, path``: the whole proof of every leaf, for a tree whose leaves are few."""
    above = butterfly(_tops(blocks, fanout, block_levels), fanout).withColumnRenamed("node", "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members, n, root, path in zip(*(batch.column(i).to_pylist() for i in range(4))):
                levels = levels_of([m["leaf"] for m in members], fanout, None if n == 1 else block_levels)
                whole = [[{"before": a, "after": b} for a, b in steps_of(levels, i, fanout)] + path for i in range(len(members))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([m["key"] for m in members], batch.column(0).type.value_type.field("key").type),
                     pa.array([root] * len(members), pa.string()),
                     pa.array(whole, pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))],
                    names=["key", "root", "path"])
    return blocks.join(above, ["tree", "block"]).select("members", "blocks", "root", "path").mapInArrow(
        run, f"key string, root string, path {_PATH}")


def manifest(rows: DataFrame, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """``key, leaf, subroot, root, proof_sha256, folded_root, verified``: one row per row of ``rows``.

    ``rows`` holds ``tree`` (text, whose rows form one tree), ``key`` (the
    order inside it), ``leaf`` (the row's digest) and ``given`` (the digest of
    the row as it was handed over later, null where that is the leaf itself).
    ``proof_sha256`` is the digest of all siblings from the leaf to the root;
    ``folded_root`` is what ``given`` and these siblings hash to.

    A null tree is a tree of its own and comes first, the others follow by
    their UTF-8 bytes; a null key comes first in its tree; rows of one key are
    ordered by their digest, and rows alike in both may stand for each other.
    A leaf alone in its tree is the subroot, and a subroot alone the root, with
    a proof of nothing. Empty tables give no rows; other columns are not read.
    """
    named = rows.select(F.coalesce(F.concat(F.lit("="), F.col("tree")), F.lit("")).alias("tree"), "key", "leaf", "given")
    blocks = _blocks(named, fanout, block_levels)
    roots = staged(butterfly(_tops(blocks, fanout, block_levels), fanout).withColumnRenamed("node", "subroot"), "merkle-roots")
    # One leaf per tree: numbered over range partitions, as the trees may be many.
    subroots = roots.where("block = 0").select(
        F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("subroot").alias("leaf"),
        F.lit(None).cast("string").alias("given"))
    upper = _paths(_blocks(subroots, fanout, block_levels), fanout, block_levels).select(F.col("key").alias("tree"), "root", F.col("path").alias("top"))
    above = roots.join(upper, "tree").select("tree", "block", "blocks", "subroot", "root", F.concat("path", "top").alias("path"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            member = batch.column(0).type.value_type
            for members, n, subroot, root, path in zip(*(batch.column(i).to_pylist() for i in range(5))):
                levels = levels_of([m["leaf"] for m in members], fanout, None if n == 1 else block_levels)
                path = [(p["before"], p["after"]) for p in path]
                proofs, folded = [], []
                for i, m in enumerate(members):
                    steps = steps_of(levels, i, fanout) + path
                    proofs.append(digest(a + b for a, b in steps))
                    node = m["given"] or m["leaf"]
                    for a, b in steps:
                        node = digest((a, node, b))
                    folded.append(node)
                count = len(members)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([m["key"] for m in members], member.field("key").type),
                     *(pa.array(c, pa.string()) for c in (
                         [m["leaf"] for m in members], [subroot] * count, [root] * count, proofs, folded)),
                     pa.array([f == root for f in folded])],
                    names=["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
    return blocks.join(above, ["tree", "block"]).select("members", "blocks", "subroot", "root", "path").mapInArrow(
        run, f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
