"""Scheduled re-collection: landed pages in, a keyed table moved on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake.plans.collection import collect_into
from carelake.session import session_setting
from carelake.sources.envelope import normalise

#: Rows that a Parquet reader holds at once, and how many when these are whole pages: a payload may take megabytes.
READ_ROWS, PAGES_AT_ONCE = "spark.sql.parquet.columnarReaderBatchSize", 16
PAGE_SCHEMA = "source string, page_no bigint, batch_size bigint, payload string, landed timestamp"


def run(spark: SparkSession, landing: str, base: str, table: str, as_of: Column, cycle: str, progress: str,
        files_per_run: int = 1000, force: bool = False, unwrap: bool = False, source: str | None = None) -> None:
    """Take the pages that landed since the last call into the keyed table at ``base``, and stop.

    Each micro-batch rewrites the buckets that its keys fall into. Of the
    versions of a key the one that landed last wins, whichever batch or call it
    comes in, so the rows depend neither on ``files_per_run`` nor on the order
    of the files, and a batch that runs again changes nothing. Calls that
    finish one collection carry one ``cycle`` and one ``as_of``; the next
    collection compares with what that one left. Every readable page counts, as
    the pages of a source may land in different runs. The clock that calls this
    is the caller's; ``source`` takes the pages of one source. Pages are read
    a few at a time, however many a file holds.
    """
    usual = spark.conf.get(READ_ROWS)
    pages = (spark.readStream.schema(PAGE_SCHEMA).option("maxFilesPerTrigger", files_per_run)
             .parquet(landing))
    if source is not None:
        pages = pages.where(F.col("source") == source)

    def apply(batch: DataFrame, run_no: int) -> None:
        with session_setting(batch.sparkSession, READ_ROWS, usual):  # the pages' reader is made by now; the rest reads narrow rows
            collect_into(batch.sparkSession, base, normalise(batch), table, as_of, cycle, force, unwrap, stop_rule=False)

    writer = pages.writeStream.foreachBatch(apply).option("checkpointLocation", progress).trigger(availableNow=True)
    with session_setting(spark, READ_ROWS, str(PAGES_AT_ONCE)):
        writer.start().awaitTermination()
