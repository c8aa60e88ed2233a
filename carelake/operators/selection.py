"""From ranked candidates to the few that are recommended."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carelake.functions.replies import SHOWN, chosen_ranks


def rank_again(candidates: DataFrame, order: list[str], keep: int = SHOWN) -> DataFrame:
    """Number the surviving candidates of a request from 1 and show the first ones."""
    w = Window.partitionBy("request_id").orderBy(*order)
    return candidates.withColumn("shown_rank", F.row_number().over(w)).where(F.col("shown_rank") <= keep)


def select_drugs(shown: DataFrame, replies: DataFrame) -> DataFrame:
    """The drugs a reply names by rank, in its order; the first three without a usable reply.

    ``shown(request_id, shown_rank, ...)`` has at most ten rows per request,
    ``replies(request_id, reply)`` at most one. Adds ``place``, from 0.
    """
    sizes = shown.groupBy("request_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    picks = sizes.join(replies, "request_id", "left").select(
        "request_id", F.posexplode(chosen_ranks(F.col("reply"), F.col("n"))).alias("place", "shown_rank"))
    return picks.join(shown, ["request_id", "shown_rank"])
