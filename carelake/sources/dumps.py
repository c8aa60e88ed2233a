"""JSON-lines dumps of wiki pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.functions.markup import snapshot_tag
from carelake.functions.text import strip


def read_dump(spark: SparkSession, path: str, title_key: str = "title",
              text_key: str = "text") -> DataFrame:
    """``title, text, ordinal, snapshot``; blank, broken and empty lines are skipped.

    Plain and gzip files are told apart by their extension. ``ordinal`` is a
    struct that grows along each file and from file to file by path, however
    Spark packs the files into tasks.
    """
    schema = T.StructType([T.StructField(title_key, T.StringType()),
                           T.StructField(text_key, T.StringType())])
    rows = (spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
            .select(strip(F.col(title_key)).alias("title"), strip(F.col(text_key)).alias("text"),
                    F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                             F.monotonically_increasing_id().alias("row")).alias("ordinal"),
                    snapshot_tag(F.input_file_name()).alias("snapshot")))
    return rows.where("title <> '' AND text <> ''")


def write_dump(pages: DataFrame, path: str) -> None:
    """Gzip JSON lines of the pages that have both a title and a text."""
    (pages.where("title <> '' AND text <> ''").select("title", "text")
     .write.mode("overwrite").option("compression", "gzip").json(path))


def write_ndjson(records: DataFrame, path: str) -> None:
    """One JSON object per line, characters kept as they are."""
    records.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
