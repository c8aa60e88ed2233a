"""Selections, lookups, ordering and pages over one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def active_drugs(drugs: DataFrame, otc_code: str, status: str | None) -> DataFrame:
    """Over-the-counter drugs still on the market; ``status`` None means no status is set."""
    alive = F.col("cancel_name").isNull() if status is None else F.col("cancel_name") == status
    return drugs.where((F.col("etc_otc_code") == otc_code) & alive)


def otc_catalogue(drugs: DataFrame, otc_code: str = "일반의약품", status: str | None = "정상",
                  limit: int | None = None) -> DataFrame:
    ordered = active_drugs(drugs, otc_code, status).orderBy("item_name", "item_seq")
    return ordered.limit(limit) if limit else ordered


def keyword_search(drugs: DataFrame, keywords: list[str], limit: int = 50,
                   otc_code: str = "02", status: str | None = None) -> DataFrame:
    """Any keyword in name, material or class, ignoring case; no keywords, no rows."""
    tests = [F.col(c).ilike(f"%{word}%") for word in keywords
             for c in ("item_name", "material_name", "class_no")]
    hit = reduce(Column.__or__, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(False))
    return active_drugs(drugs, otc_code, status).where(hit).orderBy("item_name", "item_seq").limit(limit)


def same_value(column: Column, value) -> Column:
    """Equal; text without regard to letter case, as the source database compares it."""
    return F.lower(column) == F.lower(F.lit(value)) if isinstance(value, str) else column == F.lit(value)


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(same_value(F.col(key), value))


def lookup_all(df: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """Point lookups for a whole frame of keys; text keys without regard to letter case."""
    text = dict(df.dtypes)[key] == "string"
    keys = wanted.select((F.lower(wanted_key) if text else F.col(wanted_key)).alias("_wanted")).distinct()
    own = F.lower(df[key]) if text else df[key]
    return df.join(keys, own == keys["_wanted"], "left_semi")  # repeated keys collapse before the shuffle


def by_region(df: DataFrame, province: str | None = None, district: str | None = None) -> DataFrame:
    """A district alone selects nothing less than everything, as it needs its province."""
    if province:
        df = df.where(same_value(F.col("sido_cd_nm"), province))
        if district:
            df = df.where(same_value(F.col("sggu_cd_nm"), district))
    return df


def containing(df: DataFrame, column: str, text: str) -> DataFrame:
    return df.where(F.col(column).ilike(f"%{text}%"))


def linked_to(df: DataFrame, hospital_id: str, column: str = "hira_ykiho") -> DataFrame:
    return df.where(same_value(F.col(column), hospital_id))


def with_position(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    return df.where(F.col(lon).isNotNull() & F.col(lat).isNotNull())


def updated_after(column: Column, days: int, as_of: Column) -> Column:
    return column > as_of - F.make_interval(days=F.lit(days))


def updated_within(df: DataFrame, days: int, as_of: Column, column: str = "updated_at") -> DataFrame:
    return df.where(updated_after(F.col(column), days, as_of))


def matching(df: DataFrame, conditions: dict) -> DataFrame:
    """AND of the conditions: null and '' are skipped, ``%`` means LIKE, a list means IN; letter case never counts."""
    for name, value in conditions.items():
        if value is None or value == "":
            continue
        if isinstance(value, str) and "%" in value:
            df = df.where(F.col(name).ilike(value))
        elif isinstance(value, (list, tuple)):
            df = df.where(reduce(Column.__or__, [same_value(F.col(name), v) for v in value], F.lit(False)))
        else:
            df = df.where(same_value(F.col(name), value))
    return df


def any_match(df: DataFrame, conditions: dict) -> DataFrame:
    """One row, ``exists_flag``; the scan stops at the first hit."""
    return matching(df, conditions).limit(1).agg((F.count(F.lit(1)) > 0).alias("exists_flag"))


def split_required(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with every key present, and the others."""
    present = reduce(Column.__and__, [
        F.coalesce(F.col(k).cast("string") != "", F.lit(False)) for k in keys])
    return df.where(present), df.where(~present)


def ordered(df: DataFrame, column: str, direction: str = "ASC", tie: str | None = None) -> DataFrame:
    keys = [F.desc(column) if direction.upper() == "DESC" else F.asc(column)]
    return df.orderBy(*keys, *([F.asc(tie)] if tie else []))


def page(df: DataFrame, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of an ordered frame."""
    return df.offset((number - 1) * size).limit(size)
