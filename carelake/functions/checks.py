"""Checks of values before they are written: one expression gives all that fail in a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake import schemas

FAILED = "array<struct<name:string,check:string,text:string>>"


def _listed(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def conditions(table: str, types: dict[str, str]) -> list[tuple[str, str, str]]:
    """(column, check, SQL condition under which the value fails) of a table; a null value fails nothing.

    ``type``: the text is no value of its type, or one that does not fit it;
    ``allowed``: it is none of the allowed values; ``range``: the number lies
    outside; ``length``: the text is too short or too long.
    """
    found = []
    for c, kind in types.items():
        value = f"`{c}`"
        if kind != "string":
            found.append((c, "type", f"{value} IS NOT NULL AND try_cast({value} AS {kind}) IS NULL"))
        if allowed := schemas.ALLOWED.get((table, c)):
            found.append((c, "allowed", f"{value} NOT IN ({_listed(allowed)})"))
        if limits := schemas.RANGES.get((table, c)):
            found.append((c, "range", f"try_cast({value} AS double) NOT BETWEEN {limits[0]} AND {limits[1]}"))
        if limits := schemas.LENGTHS.get((table, c)):
            found.append((c, "length", f"char_length({value}) NOT BETWEEN {limits[0]} AND {limits[1]}"))
    return found


def failed_checks(table: str, types: dict[str, str]) -> str:
    """SQL text of the failed checks of a row: an array of (name, check, text), empty where all hold."""
    cells = [f"if({condition}, struct('{c}' AS name, '{check}' AS check, CAST(`{c}` AS string) AS text), NULL)"
             for c, check, condition in conditions(table, types)]
    return f"array_compact(array({', '.join(cells)}))" if cells else f"CAST(array() AS {FAILED})"


def failing(rows: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """``table_name``, the key columns, ``name, check, text``: one row per failed check of typed or text columns."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.select(*keys, F.expr(failed_checks(table, types)).alias("_failed")).select(
        F.lit(table).alias("table_name"), *keys, F.inline("_failed"))


def holds(table: str, types: dict[str, str]) -> Column:
    """True where no check of the row fails."""
    return F.size(F.expr(failed_checks(table, types))) == 0
