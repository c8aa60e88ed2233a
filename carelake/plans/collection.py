"""Feed collection: landed pages to keyed tables, with counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake import schemas
from carelake.functions import checks
from carelake.operators.upsert import compare_and_upsert, save_counts, upsert
from carelake.session import staged
from carelake.sources import envelope, keyed

ORDINAL, FAILED = "ordinal", "failed"


def typed_rows(normalised: DataFrame, table: str, unwrap: bool = False,
               stop_rule: bool = True) -> DataFrame:
    """Typed rows of ``table`` with an ordinal, and ``failed``: the checks (type, allowed values, range) that a row fails.

    ``stop_rule`` takes the pages a paged fetch would have taken; without it
    every readable page counts, as when pages land in pieces. The ordinal is
    the landing time, if the pages have one, then page and item, then the
    content, so that equal places give the same row on every run.
    """
    stamps = ("created_at", "updated_at")
    names = [c for c in schemas.column_names(table) if c not in stamps]
    types = {f.name: f.dataType.simpleString() for f in schemas.schema(table)}
    rows = envelope.item_rows(normalised, unwrap, pages=True)
    place = [*(["landed"] if "landed" in rows.columns else []), "page_no", "item_no"]
    page = [f"_{c}" for c in ("source", *envelope.PAGE)]
    raw = envelope.fields(rows, names, [*place, *[F.col(c[1:]).alias(c) for c in page]])
    content = ", ".join(f"`{c}`" for c in names)
    typed = [f"try_cast(`{c}` AS {types[c]}) AS `{c}`" for c in names]
    # Written once, with what their pages say: the stop rule and the rows both come from here.
    made = staged(raw.selectExpr(
        *typed, f"struct({', '.join(place)}, xxhash64({content}) AS content) AS {ORDINAL}",
        f"{checks.failed_checks(table, {c: types[c] for c in names})} AS {FAILED}", *page), f"typed-{table}")
    found = made.where(f"{ORDINAL}.item_no IS NOT NULL")
    if stop_rule:
        pages = made.select(*[F.col(c).alias(c[1:]) for c in page], *[f"{ORDINAL}.{c}" for c in place])
        plan = envelope.page_plan(envelope.ledger(envelope.first_rows(pages))).select(F.col("source").alias("_source"), "last_page")
        found = found.join(plan, "_source").where(F.col(f"{ORDINAL}.page_no").between(1, F.col("last_page")))
    return found.select(*names, ORDINAL, FAILED)


def readable(rows: DataFrame) -> DataFrame:
    """The rows that may be written: a value that cannot be read or is not allowed must not overwrite one that is."""
    return rows.where(F.size(FAILED) == 0).drop(FAILED)


def quarantined_values(rows: DataFrame, table: str) -> DataFrame:
    """``table_name``, the key columns, ``name, check, text`` of each value of ``typed_rows`` that fails a check."""
    return rows.select(F.lit(table).alias("table_name"), *schemas.KEYS[table], F.inline(FAILED))


def incoming_rows(normalised: DataFrame, table: str, unwrap: bool = False,
                  stop_rule: bool = True) -> DataFrame:
    """The typed rows of ``table`` that may be written, with their ordinal."""
    return readable(typed_rows(normalised, table, unwrap, stop_rule))


def collect(existing: DataFrame, normalised: DataFrame, table: str, as_of: Column,
            force: bool = False, unwrap: bool = False, stop_rule: bool = True) -> DataFrame:
    """Next rows of ``table``; facility tables are compared first and carry an ``action``.

    The typed rows of the batch are written once and meet the rows of the table
    in one full outer join; ``collect_into`` brings only the buckets of a stored
    table that the batch touches.
    """
    rows, keys = incoming_rows(normalised, table, unwrap, stop_rule), schemas.KEYS[table]
    if table in schemas.COMPARED:
        return compare_and_upsert(existing, rows, keys, schemas.COMPARED[table], ORDINAL, as_of, force)
    return upsert(existing, rows, keys, ORDINAL, as_of)


def collect_into(spark: SparkSession, base: str, normalised: DataFrame, table: str, as_of: Column, cycle: str,
                 force: bool = False, unwrap: bool = False, stop_rule: bool = True) -> list[int]:
    """The same into the keyed table at ``base``; gives the buckets that were rewritten."""
    rows = incoming_rows(normalised, table, unwrap, stop_rule)
    return keyed.merge(spark, base, rows, schemas.KEYS[table], schemas.COMPARED.get(table, []), ORDINAL, as_of, cycle,
                       force or table not in schemas.COMPARED)


def collection_counts(existing: DataFrame, normalised: DataFrame, table: str,
                      force: bool = False, unwrap: bool = False) -> DataFrame:
    """Counts by outcome; rows that fail a check are errors, as those without a key are."""
    rows = typed_rows(normalised, table, unwrap)
    counts = save_counts(existing, readable(rows), schemas.KEYS[table], schemas.COMPARED.get(table, []), ORDINAL,
                         force or table not in schemas.COMPARED)
    broken = F.count(F.when(F.size(FAILED) > 0, 1))
    none = F.lit(0).cast("long")
    errors = rows.agg(*[(broken if c in ("total_count", "error_count") else none).alias(c) for c in counts.columns])
    return counts.unionByName(errors).agg(*[F.sum(c).alias(c) for c in counts.columns])


def error_counts(rows: DataFrame, table: str) -> DataFrame:
    """``check, n``: rows of ``typed_rows`` that fail each kind of check; ``required`` are those without a key."""
    keyless = [F.coalesce(F.col(k).cast("string"), F.lit("")) == "" for k in schemas.KEYS[table]]
    required = F.when(reduce(Column.__or__, keyless), F.array(F.lit("required"))).otherwise(F.array().cast("array<string>"))
    kinds = F.array_distinct(F.concat(F.transform(FAILED, lambda f: f["check"]), required))
    return rows.select(F.explode(kinds).alias("check")).groupBy("check").agg(F.count(F.lit(1)).alias("n"))
