"""End of every redirect chain, cycles included, by contraction.

A page redirects to at most one target. As long as there are more pointers
than one task takes, a round sets a share of the pages aside: those whose end
is known, and, of the others, each page that drew a 0 and points to one that
drew a 1. What pointed to a page that was set aside points on to its target.
So about a quarter of any chain or cycle goes per round, however long it is,
and a round is one join. What is left is followed to its ends inside one task.
Then the rounds are undone from the last to the first: a page that was set
aside ends where the page it pointed to ends, and it lies on a cycle if the
pointer that was led past it does.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from carelake.session import staged

#: Pointers that one task follows by itself.
LOCAL_ROWS = 1 << 18


def _follow(edges: dict) -> dict:
    """(end, whether on a cycle) of every source: a chain's last target, where a tail enters a cycle, or a cycle's member."""
    ends: dict = {}
    for first in edges:
        walk, place, at = [], {}, first
        while at in edges and at not in ends and at not in place:
            place[at] = len(walk)
            walk.append(at)
            at = edges[at]
        if at in place:  # the walk has closed a cycle
            for page in walk[place[at]:]:
                ends[page] = page, True
            walk = walk[:place[at]]
        end = ends[at][0] if at in ends else at
        for page in walk:
            ends[page] = end, False
    return ends


def _followed(state: DataFrame) -> DataFrame:
    """``src, ptr, on_cycle`` of a bounded number of pointers, in one task."""
    kind, page = state.schema["src"].dataType.simpleString(), to_arrow_schema(state.select("src").schema).field("src").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = {}
        for batch in batches:
            edges.update(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        found = _follow(edges)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), page), pa.array([e for e, _ in found.values()], page),
             pa.array([c for _, c in found.values()], pa.bool_())], names=["src", "ptr", "on_cycle"])
    return state.select("src", "ptr").coalesce(1).mapInArrow(run, f"src {kind}, ptr {kind}, on_cycle boolean")


def _contract(edges: DataFrame, local_rows: int):
    """Rounds until at most ``local_rows`` pointers are left: gives these, and what each round did (``src, ptr, via, fate``)."""
    state, left, rounds = edges, edges.count(), []
    if left > local_rows:
        known = edges.select(F.col("src").alias("ptr"), F.lit(True).alias("known"))
        state = staged(edges.join(known, "ptr", "left").select("src", "ptr", F.col("known").isNull().alias("done")), "pointers")
    while left > local_rows:
        def drew(page, n=len(rounds)):
            return F.xxhash64(page, F.lit(n)).bitwiseAND(1)
        via = state.select(F.col("src").alias("via"), F.col("ptr").alias("next"), F.col("done").alias("next_done"),
                           drew("src").alias("its"), drew("ptr").alias("onward"))
        met = state.join(via, state["ptr"] == via["via"], "left")
        past = ~F.col("next_done") & (F.col("its") == 0) & (F.col("onward") == 1)  # its target is set aside now
        fate = (F.when(F.col("src") == F.col("ptr"), "loop")  # a cycle of which one page is left
                .when(F.col("done") | F.coalesce("next_done", F.lit(True)), "ended").when(past, "past")
                .when((drew("src") == 0) & (F.col("its") == 1), "aside").otherwise("stays"))
        moved = F.when(~F.col("done") & (F.coalesce("next_done", F.lit(False)) | past), F.col("next")).otherwise(F.col("ptr"))
        done = staged(met.select("src", moved.alias("ptr"), F.col("ptr").alias("via"), fate.alias("fate")), "contracted")
        rounds.append(done)
        state = done.where("fate IN ('past', 'stays')").select("src", "ptr", F.lit(False).alias("done"))
        left = state.count()
    return state, rounds


def _ends(state: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """``src, ptr``: the end of every page, where there are no cycles.

    A page that ended in a round may point to one that ended before it.
    """
    ends = None
    for found in [*(r.where("fate = 'ended'").select("src", "ptr") for r in rounds), _followed(state).select("src", "ptr")]:
        if ends is not None:
            last = ends.select(F.col("src").alias("at"), F.col("ptr").alias("end"))
            found = ends.unionByName(found.join(last, found["ptr"] == last["at"], "left").select(
                "src", F.coalesce("end", "ptr").alias("ptr")))
        ends = staged(found, "ends")
    for done in reversed(rounds):
        aside = done.where("fate = 'aside'").select(F.col("src").alias("page"), F.col("ptr").alias("at"))
        ends = staged(ends.unionByName(aside.join(ends, aside["at"] == ends["src"]).select(
            F.col("page").alias("src"), "ptr")), "ends")
    return ends


def _on_cycles(state: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """``src``: the pages on cycles."""
    last = [r.where("fate = 'loop'").select("src") for r in rounds]
    found = staged(reduce(DataFrame.unionByName, [_followed(state).where("on_cycle").select("src"), *last]), "cycles")
    for done in reversed(rounds):
        past = done.where("fate = 'past'").select("src", "via")
        found = staged(found.unionByName(past.join(found, "src").select(F.col("via").alias("src")).distinct()), "cycles")
    return found


def resolve_chains(redirects: DataFrame, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """``(src, tgt)`` -> ``(src, tgt, canonical, on_cycle)``; ``src`` is unique.

    A chain ends at a title that does not redirect. A title on a cycle is its
    own end, and a tail ends where it enters the cycle.
    """
    edges = staged(redirects.select("src", F.col("tgt").alias("ptr")), "redirects")
    state, rounds = _contract(edges, local_rows)
    if not rounds:
        resolved = _followed(state)
    else:
        # With the cycles cut open their members are ends, so only chains are left.
        cycle = _on_cycles(state, rounds)
        tails = staged(edges.join(cycle, "src", "left_anti"), "tails")
        resolved = _ends(*_contract(tails, local_rows)).withColumn("on_cycle", F.lit(False)).unionByName(
            cycle.select("src", F.col("src").alias("ptr"), F.lit(True).alias("on_cycle")))
    return edges.withColumnRenamed("ptr", "tgt").join(resolved, "src").select(
        "src", "tgt", F.col("ptr").alias("canonical"), "on_cycle")
