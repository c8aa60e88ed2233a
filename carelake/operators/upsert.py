"""Keyed upsert, compare-and-upsert, delete and patch as snapshot rewrites.

Each function takes the current rows and returns the next ones; writing them
is the caller's step (``sources.snapshots``). Keys are unique in ``existing``.
Duplicates inside a batch are resolved by a mandatory ordinal, newest wins,
and the ranking keeps one row per key and task before it shuffles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelake.operators.filters import split_required

STAMPS = ("created_at", "updated_at")


def newest(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The row with the highest ordinal per key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(ordinal))
    return rows.withColumn("_at", F.row_number().over(w)).where("_at = 1").drop("_at")


def _differs(columns: list[str]) -> Column:
    """Null-safe difference in any column. Wide tables are spelled as SQL text, parsed in one go."""
    return F.expr(" OR ".join(["false", *[f"NOT (old.`{c}` <=> new.`{c}`)" for c in columns]]))


def compare_and_upsert(existing: DataFrame, incoming: DataFrame, keys: list[str],
                       compared: list[str], ordinal: str, as_of: Column,
                       force: bool = False) -> DataFrame:
    """The next rows with an ``action``: saved, updated, skipped, or kept when not incoming.

    Absent keys are inserted; present ones are overwritten when a compared
    column differs (null-safe) or ``force`` is set. ``created_at`` survives.
    Table and batch meet in one full outer join; of a stored table only the
    buckets that the batch touches need to come (``sources.keyed``).
    """
    valid, _ = split_required(incoming, keys)
    fresh = newest(valid, keys, ordinal).drop(ordinal, *STAMPS)
    values = [c for c in existing.columns if c not in keys and c not in STAMPS]
    old = existing.withColumn("_old", F.lit(True)).alias("old")
    new = fresh.withColumn("_new", F.lit(True)).alias("new")
    on = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys]
    is_old, is_new = F.col("old._old").isNotNull(), F.col("new._new").isNotNull()
    action = (F.when(~is_new, "kept").when(~is_old, "saved")
              .when(F.lit(force) | _differs(compared), "updated").otherwise("skipped"))
    write, given = "action IN ('saved', 'updated')", set(fresh.columns)

    def value(c):
        return f"if({write}, new.`{c}`, old.`{c}`) AS `{c}`" if c in given else f"old.`{c}`"

    return (old.join(new, on, "full_outer")
            .withColumns({"action": action, "_as_of": as_of})
            .selectExpr(*[f"coalesce(old.`{k}`, new.`{k}`) AS `{k}`" for k in keys],
                        *[value(c) for c in values],
                        "coalesce(old.created_at, _as_of) AS created_at",
                        f"if({write}, _as_of, old.updated_at) AS updated_at", "action"))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], ordinal: str,
           as_of: Column) -> DataFrame:
    """Overwrite every non-key column of the keys that arrive; insert the new ones."""
    return compare_and_upsert(existing, incoming, keys, [], ordinal, as_of, force=True).drop("action")


def save_counts(existing: DataFrame, incoming: DataFrame, keys: list[str], compared: list[str],
                ordinal: str, force: bool = False) -> DataFrame:
    """One row: total, saved, updated, skipped, error, and superseded duplicates."""
    valid, rejected = split_required(incoming, keys)
    new = newest(valid, keys, ordinal).alias("new")
    old = existing.withColumn("_old", F.lit(True)).alias("old")
    joined = new.join(old, [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys], "left")
    action = (F.when(F.col("old._old").isNull(), "saved")
              .when(F.lit(force) | _differs(compared), "updated").otherwise("skipped"))
    parts = [joined.select(action.alias("action")).groupBy("action").count(),
             rejected.agg(F.lit("error").alias("action"), F.count(F.lit(1)).alias("count")),
             incoming.agg(F.lit("total").alias("action"), F.count(F.lit(1)).alias("count"))]

    def of(name):
        return F.coalesce(F.sum(F.when(F.col("action") == name, F.col("count"))),
                          F.lit(0)).alias(f"{name}_count")
    counts = reduce(DataFrame.unionByName, parts).agg(
        *[of(n) for n in ("total", "saved", "updated", "skipped", "error")])
    return counts.withColumn("superseded_count", F.expr(
        "total_count - saved_count - updated_count - skipped_count - error_count"))


def delete(existing: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return existing.join(gone.select(*keys).distinct(), keys, "left_anti")


def patch(existing: DataFrame, patches: DataFrame, keys: list[str], columns: list[str],
          as_of: Column) -> DataFrame:
    """Set only the columns a patch carries.

    A patch carries a column when it is not null, or, where null is a value to
    set, when a boolean ``set_<column>`` beside it is true. A patch that
    carries nothing changes nothing. Patch keys must be unique.
    """
    def carried(c):
        flag = f"set_{c}"
        present = F.col(f"p.{c}").isNotNull()
        return (present | F.coalesce(F.col(f"p.{flag}"), F.lit(False))) if flag in patches.columns \
            else present
    old, new = existing.alias("o"), patches.alias("p")
    any_set = reduce(Column.__or__, [carried(c) for c in columns])
    joined = old.join(new, [F.col(f"o.{k}") == F.col(f"p.{k}") for k in keys], "left")

    def value(c):
        if c in columns:
            return F.when(carried(c), F.col(f"p.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
        if c == "updated_at":
            return F.when(any_set, as_of).otherwise(F.col("o.updated_at")).alias(c)
        return F.col(f"o.{c}")
    return joined.select(*[value(c) for c in existing.columns])


def unmatched(existing: DataFrame, patches: DataFrame, keys: list[str]) -> DataFrame:
    """Patches or deletes whose key does not exist: the caller's not-found errors."""
    return patches.join(existing.select(*keys), keys, "left_anti")


def append(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """Plain batch insert."""
    return existing.unionByName(rows, allowMissingColumns=True)
