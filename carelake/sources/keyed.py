"""Keyed tables in buckets: a batch rewrites only the buckets its keys fall into, and rows only move forward.

Below ``base``, ``data/version=V/key_bucket=B`` holds bucket ``B`` as commit
``V`` wrote it, and ``manifest/v=V`` says for each bucket which version is
current after commit ``V``. A commit writes its buckets first and its manifest
last; what has no manifest is not there, so a lost job leaves the table as it
was and can simply run again. One writer at a time; readers may read on.
``vacuum`` removes bucket versions that no kept manifest names.

``merge`` keeps beside each row a last-writer register: the version (landing
time, page, item, content) that the row was last decided by, and the row as it
was before the current cycle. A version that is not newer than the register is
ignored, and a newer one is compared with the row before the cycle, never with
what an earlier batch of the same cycle happened to leave. So the rows after a
cycle depend on the versions that came in it, not on their order or on how
they were cut into batches, and a batch that runs twice changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from carelake.operators.filters import split_required
from carelake.operators.upsert import STAMPS, newest
from carelake.sources.snapshots import latest_version, read_snapshot, write_snapshot

#: Buckets of a new table. Choose so many that one holds a few hundred MB: it is what a single key rewrites.
BUCKETS = 64
BUCKET = "key_bucket"
#: What ``merge`` stores beside the columns of the table.
REGISTER = ("_won", "_cycle", "_action", "_before")


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _folder(base: str, version: int) -> str:
    return f"{base.rstrip('/')}/data/version={version:010d}"


def _children(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder; none if it is not there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []


def manifest(spark: SparkSession, base: str, version: int | None = None) -> tuple[int, list]:
    """The version of a table and its manifest: one row (bucket, version, schema) per bucket, whatever the table holds."""
    version = latest_version(spark, f"{base}/manifest") if version is None else version
    if version is None:
        raise ValueError(f"no table at {base}")
    return version, read_snapshot(spark, f"{base}/manifest", version).orderBy("bucket").collect()


def _commit(spark: SparkSession, base: str, rows: DataFrame, version: int, current: dict[int, int | None], touched) -> None:
    """Write ``rows`` (with their bucket) as the new content of the buckets ``touched``, then the manifest."""
    path = _folder(base, version)
    rows.hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)
    written = {int(name.partition("=")[2]) for name in _children(spark, path) if name.startswith(f"{BUCKET}=")}
    now = current | {b: version if b in written else None for b in touched}
    kind = rows.drop(BUCKET).schema.json()
    told = spark.createDataFrame([(b, v, kind) for b, v in now.items()], "bucket int, version long, schema string")
    write_snapshot(told.coalesce(1), f"{base}/manifest", version)


def create(rows: DataFrame, base: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """A new table of ``rows``, whose keys are unique, or a full refresh of the one that is there."""
    spark = rows.sparkSession
    last = latest_version(spark, f"{base}/manifest")
    _commit(spark, base, rows.withColumn(BUCKET, _bucket(keys, buckets)), 0 if last is None else last + 1,
            dict.fromkeys(range(buckets)), range(buckets))


def read(spark: SparkSession, base: str, buckets=None, version: int | None = None) -> DataFrame:
    """All that is stored, or that of some buckets; only the files of the current versions are listed and read."""
    _, rows = manifest(spark, base, version)
    return _read(spark, base, rows, buckets)


def _read(spark: SparkSession, base: str, rows: list, buckets) -> DataFrame:
    schema = StructType.fromJson(json.loads(rows[0]["schema"]))
    wanted = None if buckets is None else set(buckets)
    paths = [f"{_folder(base, r['version'])}/{BUCKET}={r['bucket']}" for r in rows
             if r["version"] is not None and (wanted is None or r["bucket"] in wanted)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def table(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """The rows of the table, without the register."""
    return read(spark, base, None, version).drop(*REGISTER)


def rewrite(spark: SparkSession, base: str, batch: DataFrame, keys: list[str],
            change: Callable[[DataFrame], DataFrame]) -> list[int]:
    """Replace the buckets that the keys of ``batch`` fall into by ``change`` of their rows; gives these buckets.

    ``change`` may touch, add and drop rows of these keys only. ``batch`` is
    read more than once: stage it if it is costly. A batch without rows
    commits nothing.
    """
    version, rows = manifest(spark, base)
    place = _bucket(keys, len(rows))
    touched = sorted(r[0] for r in batch.select(place).distinct().collect())  # as many as there are buckets at most
    if touched:
        after = change(_read(spark, base, rows, touched)).withColumn(BUCKET, place)
        _commit(spark, base, after, version + 1, {r["bucket"]: r["version"] for r in rows}, touched)
    return touched


def delete(spark: SparkSession, base: str, gone: DataFrame, keys: list[str]) -> list[int]:
    """Remove rows by key."""
    gone = gone.select(*keys).distinct()
    return rewrite(spark, base, gone, keys, lambda rows: rows.join(gone, keys, "left_anti"))


def vacuum(spark: SparkSession, base: str, keep: int = 1) -> int:
    """Remove manifests but the newest ``keep``, and what only these named; gives how many bucket versions went."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    last = latest_version(spark, f"{base}/manifest")
    known = sorted((int(n[2:]) for n in _children(spark, f"{base}/manifest") if n.startswith("v=")), reverse=True)
    kept = [v for v in known if last is not None and v <= last][:max(1, keep)]
    used = {(r["version"], r["bucket"]) for v in kept for r in manifest(spark, base, v)[1]}

    def remove(path):
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(conf).delete(at, True)
    for v in known:
        if kept and v < kept[-1]:
            remove(f"{base}/manifest/v={v:010d}")
    gone = 0
    for name in _children(spark, f"{base}/data"):
        v = int(name.partition("=")[2])
        if last is None or v > last:
            continue  # a commit that is being written
        below = [n for n in _children(spark, f"{base}/data/{name}") if n.startswith(f"{BUCKET}=")]
        old = [n for n in below if (v, int(n.partition("=")[2])) not in used]
        if len(old) == len(below):
            remove(f"{base}/data/{name}")
        else:
            for n in old:
                remove(f"{base}/data/{name}/{n}")
        gone += len(old)
    return gone


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def merge(spark: SparkSession, base: str, incoming: DataFrame, keys: list[str], compared: list[str], ordinal: str,
          as_of: Column, cycle: str, force: bool = False) -> list[int]:
    """Compare-and-upsert ``incoming`` into the table; gives the buckets that were rewritten.

    Of the versions of a key the one with the greatest ``ordinal`` counts, in
    this batch and over all batches. It replaces the row that stood before the
    ``cycle`` if a compared column differs (null-safe), if ``force`` is set or
    if there was none; otherwise that row stands again. ``cycle`` names the
    collection that a batch belongs to: all its batches carry the same name
    and the same ``as_of``. Rows without a key are left out.
    """
    valid, _ = split_required(incoming, keys)
    fresh = newest(valid, keys, ordinal).drop(*STAMPS)
    return rewrite(spark, base, fresh, keys,
                   lambda rows: _moved(_with_register(rows, fresh, ordinal), fresh, keys, compared, ordinal, as_of, cycle, force))


def _with_register(rows: DataFrame, fresh: DataFrame, ordinal: str) -> DataFrame:
    """Rows of a table that was made without a register: nothing has decided them yet."""
    if "_won" in rows.columns:
        return rows
    values = F.struct(*[c for c in rows.columns])
    return rows.withColumns({
        "_won": F.lit(None).cast(fresh.schema[ordinal].dataType), "_cycle": F.lit(None).cast("string"),
        "_action": F.lit("kept"), "_before": F.when(F.lit(False), values)})


def _moved(rows: DataFrame, fresh: DataFrame, keys: list[str], compared: list[str], ordinal: str, as_of: Column,
           cycle: str, force: bool) -> DataFrame:
    """The next rows of the touched buckets, with the register moved on."""
    columns = [c for c in rows.columns if c not in REGISTER]
    given = set(fresh.columns)
    old = rows.withColumn("_old", F.lit(True)).alias("old")
    new = fresh.withColumn("_new", F.lit(True)).alias("new")
    both = old.join(new, [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys], "full_outer").withColumn("_as_of", as_of)
    here = f"old._cycle <=> {_text(cycle)}"
    # The row before the cycle: what is shown, unless this cycle has shown another; none if this cycle made the row.
    shown = ", ".join(f"old.`{c}` AS `{c}`" for c in columns)
    stood = both.selectExpr(
        "*", f"CASE WHEN old._old IS NULL OR {here} AND old._action = 'saved' THEN NULL "
             f"WHEN {here} AND old._action = 'updated' THEN old._before ELSE struct({shown}) END AS stood")
    changes = "true" if force or not compared else " OR ".join(f"NOT (stood.`{c}` <=> new.`{c}`)" for c in compared)
    decided = stood.selectExpr(
        "*", f"CASE WHEN new._new IS NULL OR NOT coalesce(new.`{ordinal}` > old._won, true) THEN 'none' "
             f"WHEN stood IS NULL THEN 'saved' WHEN {changes} THEN 'updated' ELSE 'skipped' END AS decision")

    def value(c):
        if c in keys:
            return f"coalesce(old.`{c}`, new.`{c}`) AS `{c}`"
        if c == "created_at":
            return "coalesce(old.created_at, _as_of) AS created_at"
        taken = "_as_of" if c == "updated_at" else f"new.`{c}`" if c in given else f"coalesce(stood.`{c}`, old.`{c}`)"
        return (f"CASE decision WHEN 'none' THEN old.`{c}` WHEN 'skipped' THEN stood.`{c}` ELSE {taken} END AS `{c}`")
    moved = "decision <> 'none'"
    return decided.selectExpr(
        *[value(c) for c in columns], f"if({moved}, new.`{ordinal}`, old._won) AS _won",
        f"if({moved}, {_text(cycle)}, old._cycle) AS _cycle", f"if({moved}, decision, old._action) AS _action",
        f"CASE WHEN decision = 'updated' THEN stood WHEN {moved} THEN NULL ELSE old._before END AS _before")


def outcomes(spark: SparkSession, base: str, cycle: str) -> DataFrame:
    """``action, n``: how many rows of the table a cycle has saved, updated or left as they were (skipped)."""
    return read(spark, base).where(F.col("_cycle") == cycle).groupBy(F.col("_action").alias("action")).agg(
        F.count(F.lit(1)).alias("n"))
