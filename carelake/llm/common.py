"""What several operators share: text in tasks, staging, and the registry."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake.session import scratch_path, write_staged

#: Rows of one Arrow batch where rows hold whole texts: bounds what a task holds at once.
TEXT_ROWS = 256

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def query(name: str, sql: str | None = None):
    """Register ``f(spark, sf_dir)`` under ``name`` with its SQL, where SQL can say it."""
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f
    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_KEEP = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_SPACED = bytes(b if b in _KEEP else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of ASCII digits and letters, the latter lowered, and of all other characters past ASCII."""
    return text.lower().translate(_SPACED).split()


def map_text(df: DataFrame, f: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """``mapInArrow`` with small batches, as each row may hold a very long text."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    return df.mapInArrow(f, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column; a null text is an empty one."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def staged_at(df: DataFrame, label: str) -> str:
    """Write ``df`` once to the shared folder; gives the path."""
    path = scratch_path(df.sparkSession, label)
    write_staged(df, path)
    return path


def lower_ascii(text):
    """A-Z to lower case, nothing else; a null text is an empty one."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def refuse_names(df: DataFrame, *names: str) -> None:
    """Raise where ``df`` has a column that an operator needs the name of."""
    if taken := sorted(set(names) & {c.lower() for c in df.columns}):
        raise ValueError(f"these column names are taken: {taken}")
