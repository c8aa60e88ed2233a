"""The engine's tables, derived from the given ones.

Every stand-in is a list of select expressions that Spark and plain SQL read
alike, so a query and its SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake.operators.layout import spread, with_once


def _title(k: str) -> str:
    return f"'T' || CAST({k} AS VARCHAR(20)) || CASE WHEN {k} % 7 = 0 THEN '증후군' ELSE '' END"


# The marked-up body of a section, and the page by kind (doc_id % 5).
MARKED = ("repeat(chr(39), 3) || 'note' || repeat(chr(39), 3) || "
          "' [[page|shown]] and [[link]]<ref name=x>gone</ref>{{{#!wiki x}}}{{box}} "
          "[https://example.org/a label]' || chr(9) || chr(10) || chr(10) || chr(10) || text")
_REDIRECT = (f"CASE doc_id % 3 WHEN 0 THEN '#redirect [[' || {{t}} || ']]' WHEN 1 THEN ' # 넘겨주기 [[ ' || {{t}} || ' ]]' "
             f"ELSE '#REDIRECT ' || {{t}} END")
_HEAD = "CASE doc_id % 3 WHEN 0 THEN '== 증상 ==' WHEN 1 THEN '=== 임상  증상 ===' ELSE '== 주요 증상==' END"
_PAGE = (
    "CASE doc_id % 5 "
    f"WHEN 0 THEN '[[분류:희귀 질환]]' || chr(10) || '== 개요 ==' || chr(10) || text || chr(10) || "
    f"CASE WHEN lang = 'fr' THEN '' ELSE {_HEAD} || chr(10) || {MARKED} || chr(10) END || '== 여담 ==' || chr(10) || 'x' "
    f"WHEN 1 THEN {_REDIRECT.format(t=_title('CAST(floor(doc_id / 3) AS BIGINT)'))} "
    f"WHEN 2 THEN {_HEAD} || chr(10) || {MARKED} "
    f"WHEN 3 THEN '[[분류:질병]][[Category: 한국 영화 ]]' || chr(10) || {_HEAD} || chr(10) || {MARKED} || chr(10) || "
    f"CASE WHEN doc_id % 2 = 0 THEN '== 원인 ==' || chr(10) || 'c' ELSE '== 기타 ==' END "
    f"ELSE {_REDIRECT.format(t=_title('((doc_id * doc_id + 1) % 1009)'))} END")

EXPRESSIONS: dict[str, tuple[str, list[str]]] = {
    # Query points over the capital area; facilities on the same square.
    "points": ("customer", [
        "c_custkey AS point_id", "126.5e0 + (c_custkey * 53 % 1000) / 1000e0 AS lon",
        "37.2e0 + (c_custkey * 17 % 1000) / 1000e0 AS lat"]),
    "facilities": ("supplier", [
        "s_suppkey AS facility_id",
        "CASE WHEN s_acctbal >= 0 THEN 126.5e0 + (s_suppkey * 37 % 1000) / 1000e0 END AS lon",
        "37.2e0 + (s_suppkey * 91 % 1000) / 1000e0 AS lat",
        "CASE s_suppkey % 4 WHEN 0 THEN '상급종합' WHEN 1 THEN '종합병원' WHEN 2 THEN '병원' "
        "ELSE '의원' END AS kind"]),
    # People, one per customer.
    "people": ("customer", [
        "c_custkey AS id", "c_name AS name", "'u' || CAST(c_custkey AS VARCHAR(20)) || '@example.org' AS email",
        "CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE CAST(c_custkey % 91 AS INT) END AS user_age",
        "CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment = 'HOUSEHOLD' END AS is_pregnant"]),
    # Drug catalogue and its rules.
    "drugs": ("part", [
        "p_partkey AS vec_id", "CAST(p_partkey AS VARCHAR(20)) AS item_seq", "p_name AS item_name",
        "p_brand AS entp_name",
        "CASE WHEN p_size >= 40 THEN NULL ELSE 'M' || CAST(p_size AS VARCHAR(20)) END AS material_name",
        "p_type AS class_no",
        "CASE WHEN p_type IN ('ECONOMY', 'STANDARD', 'SMALL') THEN '02' ELSE '01' END AS etc_otc_code",
        "CASE WHEN p_brand = 'Brand#7' THEN '취하' END AS cancel_name",
        "CASE WHEN p_size % 3 = 0 THEN '' ELSE 'E' || CAST(p_size AS VARCHAR(20)) END AS ee_doc_id"]),
    "pregnancy_rules": ("part WHERE p_size <= 12", [
        "CAST(p_partkey AS VARCHAR(20)) AS item_seq", "'임부금기' AS type_name",
        "'P' || CAST(p_size AS VARCHAR(20)) AS prohbt_content"]),
    "elderly_rules": ("part WHERE p_size BETWEEN 8 AND 20", [
        "CAST(p_partkey AS VARCHAR(20)) AS item_seq", "'노인주의' AS type_name",
        "'E' || CAST(p_size AS VARCHAR(20)) AS prohbt_content"]),
    "age_rules": ("part WHERE p_size BETWEEN 18 AND 24", [
        "CAST(p_partkey AS VARCHAR(20)) AS item_seq", "p_brand AS prohbt_content"]),
    "dose_rules": ("part WHERE p_size BETWEEN 22 AND 30", [
        "CAST(p_partkey AS VARCHAR(20)) AS item_seq", "p_type AS prohbt_content"]),
    "duration_rules": ("part WHERE p_size BETWEEN 28 AND 36", [
        "CAST(p_partkey AS VARCHAR(20)) AS item_seq", "p_name AS prohbt_content"]),
    "split_rules": ("part WHERE p_type = 'LARGE'", [
        "CAST(p_partkey AS VARCHAR(20)) AS item_seq", "p_name AS prohbt_content"]),
    "pair_rules": ("part", [
        "CAST(p_partkey AS VARCHAR(20)) AS item_seq",
        "CAST(p_partkey + p_size AS VARCHAR(20)) AS mixture_item_seq"]),
    "effects": ("part", ["CAST(p_partkey AS VARCHAR(20)) AS item_seq", "p_type AS effect_name"]),
    # Prescription lines.
    "lines": ("lineitem", ["l_orderkey AS rx_id", "CAST(l_partkey AS VARCHAR(20)) AS item_seq"]),
    # Wiki pages built around whole documents: articles of three kinds, and redirects.
    "dump": ("documents", [
        f"{_title('doc_id')} AS title", "doc_id AS ordinal", f"{_PAGE} AS text"]),
    # Chat messages.
    "messages": ("conversations", [
        "conv_id AS session_id", "turn", "role", "text AS content"]),
    # Diagnosis log.
    "logs": ("events", [
        "event_id AS log_id", "ts AS created_at", "event_type AS predicted_disease",
        "CASE WHEN event_type IN ('purchase', 'view') THEN 'PHARMACY' ELSE 'HOSPITAL' END AS recommendation",
        "CAST(1 + event_id % 10 AS INT) AS severity_score",
        "'R' || CAST(user_id % 5 AS VARCHAR(20)) AS region_label", "value >= 10 AS helpful"]),
}


def table(spark: SparkSession, sf_dir: str, name: str, costly: bool = False) -> DataFrame:
    """A given table; ``costly`` when the query does heavy work on each row."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if costly else rows


def standin(spark: SparkSession, sf_dir: str, name: str, costly: bool = False) -> DataFrame:
    source, expressions = EXPRESSIONS[name]
    base, _, condition = source.partition(" WHERE ")
    rows = table(spark, sf_dir, base, costly)
    return (rows.where(condition) if condition else rows).selectExpr(*expressions)


def wiki_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dump, each page put together once."""
    columns = dict(reversed(e.rsplit(" AS ", 1)) for e in EXPRESSIONS["dump"][1])
    pages = table(spark, sf_dir, "documents", costly=True)
    made = with_once(pages.select("doc_id", "text", "lang").withColumnRenamed("text", "source_text"),
                     text=F.expr(columns["text"].replace("text", "source_text")))
    return made.select(F.expr(columns["title"]).alias("title"), F.col("doc_id").alias("ordinal"), "text")


def standin_sql(name: str) -> str:
    source, expressions = EXPRESSIONS[name]
    return f"SELECT {', '.join(expressions)} FROM {source}"


def with_sql(*names: str, **extra: str) -> str:
    """``WITH`` clause of the named stand-ins, then the extra common tables."""
    parts = [f"{n} AS ({standin_sql(n)})" for n in names]
    parts += [f"{n} AS ({body})" for n, body in extra.items()]
    return "WITH " + ",\n".join(parts) + "\n"


def haversine_km(lat1: str, lon1: str, lat2: str, lon2: str, radius_m: str = "6370986e0") -> str:
    return (f"2 * {radius_m} * asin(sqrt(least(1e0, "
            f"sin(radians({lat2} - {lat1}) / 2) * sin(radians({lat2} - {lat1}) / 2) + "
            f"cos(radians({lat1})) * cos(radians({lat2})) * "
            f"sin(radians({lon2} - {lon1}) / 2) * sin(radians({lon2} - {lon1}) / 2)))) / 1000")
