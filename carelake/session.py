"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Paths that ``scratch_path`` gave out.
_SCRATCH: list[str] = []

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split hot join partitions even when that costs one more shuffle later.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "carelake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local master, as in tests, may fall back to a folder of its own.
    """
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not known:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        known = tempfile.mkdtemp(prefix="carelake-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(known)
    return known


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; ``clean_scratch`` removes it."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def clean_scratch(spark: SparkSession) -> int:
    """Remove what this program wrote below the shared folder; call it when no result that reads it is needed any more."""
    jvm, conf, gone = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


@contextmanager
def session_setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session that holds for what is run inside, whatever it was before."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def write_staged(df, path: str) -> None:
    """Write ``df`` as Parquet; the shuffle files it took go with the write.

    Else they stay until the driver happens to collect its garbage, and those of
    one step after the other stand beside each other on the executors' disks.
    """
    with session_setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)


def staged(df, label: str):
    """``df`` written once to the shared folder and read back, with its true size known."""
    path = scratch_path(df.sparkSession, label)
    write_staged(df, path)
    return df.sparkSession.read.parquet(path)


def cut_lineage(df):
    """Reliable checkpoint of ``df``; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
