"""Table statistics, diagnosis log and its roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from carelake.operators import filters, rollups
from carelake.plans import recommendation
from carelake.registry import query
from carelake.registry.standins import standin, table, with_sql
from carelake.session import scratch_path
from carelake.sources.snapshots import append_log, read_log

AS_OF = "2024-01-30 00:00:00"


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


def _stats(source, column, where="TRUE"):
    return f"""SELECT count(*) AS total_count,
  count(*) FILTER (WHERE {column} > TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY) AS updated_today,
  count(*) FILTER (WHERE {column} > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS updated_this_week,
  epoch_us(max({column})) AS last_updated FROM {source} WHERE {where}"""


@query("table_stats", _stats("events", "ts"))
def table_stats(spark, sf):
    return rollups.table_stats(table(spark, sf, "events"), _as_of(), "ts").withColumn(
        "last_updated", F.unix_micros(F.col("last_updated").cast("timestamp")))


EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


@query("dashboard", " UNION ALL ".join(
    _stats("events", "ts", f"event_type = '{t}'").replace("SELECT", f"SELECT '{t}' AS source,", 1)
    for t in EVENT_TYPES))
def dashboard(spark, sf):
    events = table(spark, sf, "events")
    tables = {t: events.where(F.col("event_type") == t) for t in EVENT_TYPES}
    return rollups.dashboard(tables, _as_of(), "ts").withColumn("last_updated", F.unix_micros(F.col("last_updated").cast("timestamp")))


@query("row_counts", """
SELECT 'all' AS asked, count(*) AS "count" FROM lineitem
UNION ALL SELECT 'returned', count(*) FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus IN ('O', 'F')""")
def row_counts(spark, sf):
    lines = table(spark, sf, "lineitem")
    some = rollups.row_count(lines, {"l_returnflag": "R", "l_linestatus": ["O", "F"]})
    return rollups.row_count(lines).select(F.lit("all").alias("asked"), "count").union(
        some.select(F.lit("returned"), "count"))


@query("recently_updated", f"SELECT event_id FROM events WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 3 DAY")
def recently_updated(spark, sf):
    return filters.updated_within(table(spark, sf, "events"), 3, _as_of(), "ts").select("event_id")


@query("log_rollups", with_sql("logs") + """
SELECT epoch_us(date_trunc('day', created_at)) AS period, recommendation, predicted_disease, region_label, severity_score,
  CAST(GROUPING(date_trunc('day', created_at), recommendation, predicted_disease, region_label, severity_score) AS BIGINT)
    AS grouping_key, count(*) AS log_count FROM logs
GROUP BY GROUPING SETS ((date_trunc('day', created_at)), (date_trunc('day', created_at), recommendation),
  (date_trunc('day', created_at), predicted_disease), (date_trunc('day', created_at), region_label),
  (date_trunc('day', created_at), severity_score))""")
def log_rollups(spark, sf):
    return rollups.log_rollups(standin(spark, sf, "logs")).withColumn("period", F.unix_micros(F.col("period").cast("timestamp")))


@query("feedback_rate", with_sql("logs") + f"""
SELECT count(*) AS feedback_count, count(*) FILTER (WHERE helpful) AS helpful_count,
  round(avg(helpful::INT), 6) AS helpful_rate FROM logs WHERE created_at > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY""")
def feedback_rate(spark, sf):
    return rollups.feedback_rate(standin(spark, sf, "logs"), _as_of()).withColumn(
        "helpful_rate", F.round("helpful_rate", 6))


_LOGGED = """SELECT o_orderkey AS log_id, substr(t.texts, 1, 1000) AS symptom_text, 'D' || CAST(o_custkey AS VARCHAR) AS predicted_disease,
  CASE WHEN o_totalprice > 250000 THEN 'HOSPITAL' ELSE 'PHARMACY' END AS recommendation,
  CASE WHEN o_totalprice > 250000 THEN NULL ELSE 'drug ' || o_orderpriority END AS drug_suggested,
  CASE WHEN o_totalprice > 250000 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) END AS item_seq,
  CASE WHEN o_totalprice > 250000 THEN NULL
    ELSE '[{"item_seq":"' || CAST(o_orderkey AS VARCHAR) || '","item_name":"drug ' || o_orderpriority || '"}]' END AS recommended_drugs,
  CASE WHEN o_totalprice > 250000 THEN '[{"name":"H"}]' END AS nearby_hospitals,
  CASE WHEN o_orderstatus <> 'P' THEN '0.0' END AS latitude, strftime(o_orderdate, '%Y-%m-01') AS log_date
FROM orders JOIN (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_name ELSE repeat(c_mktsegment, 120) || ' end' END AS texts
  FROM customer) t ON o_custkey = c_custkey"""


@query("diagnosis_log", _LOGGED)
def diagnosis_log(spark, sf):
    """Log rows of every order as a diagnosis, appended by month and read back."""
    people = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("symptom_text"),
        F.array(F.struct(F.lit("user").alias("role"), F.repeat("c_mktsegment", 120).alias("content")),
                F.struct(F.lit("assistant").alias("role"), F.lit("?").alias("content")),
                F.struct(F.lit("user").alias("role"), F.lit("end").alias("content"))).alias("messages"))
    hospital = F.col("o_totalprice") > 250000
    drug = F.struct(F.col("o_orderkey").cast("string").alias("item_seq"),
                    F.concat(F.lit("drug "), "o_orderpriority").alias("item_name"))
    place = F.array(F.struct(F.lit("H").alias("name")))
    diagnoses = table(spark, sf, "orders").join(people, "o_custkey").select(
        F.col("o_orderkey").alias("log_id"), "symptom_text", "messages", "o_orderdate",
        F.concat(F.lit("D"), F.col("o_custkey").cast("string")).alias("disease"),
        F.when(hospital, "HOSPITAL").otherwise("PHARMACY").alias("recommendation"),
        F.lit(5).alias("severity_score"), F.lit("r").alias("reason"),
        F.when(hospital, F.array().cast("array<struct<item_seq:string,item_name:string>>"))
        .otherwise(F.array(drug)).alias("drugs"),
        F.when(hospital, place).alias("hospitals"), F.when(~hospital, place).alias("pharmacies"),
        F.lit(None).cast("array<struct<id:string>>").alias("suspected"),
        F.when(F.col("o_orderstatus") != "P", F.struct(F.lit(0.0).alias("latitude"), F.lit(127.5).alias("longitude")))
        .alias("location"))
    path = scratch_path(spark, "log")
    append_log(recommendation.diagnosis_log(diagnoses, F.col("o_orderdate")), path, "orders-1", unit="month")
    return spark.read.parquet(path).select(
        "log_id", "symptom_text", "predicted_disease", "recommendation", "drug_suggested", "item_seq",
        "recommended_drugs", "nearby_hospitals", "latitude", F.col("log_date").cast("string").alias("log_date"))


@query("log_written_twice", with_sql("logs") + """
SELECT log_id, predicted_disease, recommendation, severity_score, strftime(created_at, '%Y-%m-%d') AS log_date,
  CASE WHEN log_id % 3 = 0 THEN 'night' ELSE 'day' END AS batch FROM logs""")
def log_written_twice(spark, sf):
    """Two batches of log rows of which each job runs twice, as after a lost driver."""
    rows, path = standin(spark, sf, "logs"), scratch_path(spark, "twice")
    for batch, part in (("day", "log_id % 3 <> 0"), ("night", "log_id % 3 = 0"), ("day", "log_id % 3 <> 0"), ("night", "log_id % 3 = 0")):
        append_log(rows.where(part), path, batch)
    return read_log(spark, path).select(
        "log_id", "predicted_disease", "recommendation", "severity_score", F.col("log_date").cast("string").alias("log_date"), "batch")
