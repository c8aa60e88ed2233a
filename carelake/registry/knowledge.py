"""Wiki markup, redirects and the disease master table."""

from __future__ import annotations

from pyspark.sql import functions as F

from carelake.functions import markup
from carelake.operators.layout import with_once
from carelake.operators.redirects import resolve_chains
from carelake.plans import disease
from carelake.registry import query
from carelake.registry.standins import MARKED, _title, standin, table, wiki_dump, with_sql
from carelake.session import scratch_path
from carelake.sources import dumps

_TARGET = (f"CASE doc_id % 5 WHEN 1 THEN {_title('CAST(floor(doc_id / 3) AS BIGINT)')} "
           f"WHEN 4 THEN {_title('((doc_id * doc_id + 1) % 1009)')} END")
_TITLE = _title("doc_id")
_SECTIONED = "(doc_id % 5 IN (2, 3) OR (doc_id % 5 = 0 AND lang <> 'fr'))"
_DISEASE = ("(doc_id % 5 = 0 OR (doc_id % 5 = 2 AND doc_id % 7 = 0) OR "
            "(doc_id % 5 = 3 AND (doc_id % 2 = 0 OR doc_id % 7 = 0)))")


_BLANKS = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))"


def _sql_clean(expression: str) -> str:
    """The cleaning steps in the other engine's pattern dialect."""
    # The patterns, in their order.
    steps = [(r"<ref[^>]*>.*?</ref>", "", "gsi"), (r"\{\{\{.*?\}\}\}", "", "gs"), (r"\{\{.*?\}\}", "", "gs"),
             (r"\[\[([^|\]]+)\|([^\]]+)\]\]", r"\2", "g"), (r"\[\[([^\]]+)\]\]", r"\1", "g"),
             (r"\[(?:https?|ftp)://[^\s\]]+\s+([^\]]+)\]", r"\1", "g"),
             ("''''+", "", "g")]  # two quotes or more, doubled inside an SQL literal
    for pattern, keep, options in steps:
        expression = f"regexp_replace({expression}, '{pattern}', '{keep}', '{options}')"
    expression = f"replace(replace({expression}, chr(9), ' '), chr(13), '')"
    expression = f"regexp_replace({expression}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return _BLANKS.format(expression)


_CLEAN = _sql_clean(MARKED)


@query("redirect_targets", f"SELECT doc_id AS ordinal, {_TARGET} AS target FROM documents")
def redirect_targets(spark, sf):
    return wiki_dump(spark, sf).select("ordinal", markup.redirect_target(F.col("text")).alias("target"))


@query("page_sections", """
SELECT doc_id AS ordinal, n, title, level FROM (
  SELECT doc_id, unnest(range(0, len(h))) AS n, unnest(h).t AS title, unnest(h).l AS level FROM (
    SELECT doc_id, list_concat(
      CASE WHEN doc_id % 5 = 0 THEN [{'t': '개요', 'l': 2}] ELSE [] END,
      CASE WHEN doc_id % 5 IN (2, 3) OR (doc_id % 5 = 0 AND lang <> 'fr') THEN
        [CASE doc_id % 3 WHEN 0 THEN {'t': '증상', 'l': 2} WHEN 1 THEN {'t': '임상  증상', 'l': 3}
         ELSE {'t': '주요 증상', 'l': 2} END] ELSE [] END,
      CASE WHEN doc_id % 5 = 0 THEN [{'t': '여담', 'l': 2}] WHEN doc_id % 5 <> 3 THEN []
           WHEN doc_id % 2 = 0 THEN [{'t': '원인', 'l': 2}] ELSE [{'t': '기타', 'l': 2}] END) AS h
    FROM documents))""")
def page_sections(spark, sf):
    return wiki_dump(spark, sf).select(
        "ordinal", F.posexplode(markup.sections(F.col("text"))).alias("n", "s")).select(
        "ordinal", "n", "s.title", "s.level")


@query("symptom_sections", f"""
SELECT doc_id AS ordinal, {_CLEAN} AS symptom_text FROM documents WHERE {_SECTIONED}""")
def symptom_sections(spark, sf):
    parts = with_once(wiki_dump(spark, sf), parts=markup.sections(F.col("text")))
    body = markup.pick_section(F.col("parts"), markup.SYMPTOM_TITLES)
    return parts.withColumn("body", body).where("body IS NOT NULL").select(
        "ordinal", markup.clean_markup(F.col("body")).alias("symptom_text"))


@query("page_categories", """
SELECT doc_id AS ordinal, CASE doc_id % 5 WHEN 0 THEN '희귀 질환' WHEN 3 THEN '질병|한국 영화' ELSE '' END AS categories,
  doc_id % 5 IN (0, 3) AS disease_category, doc_id % 5 = 3 AS other_category FROM documents""")
def page_categories(spark, sf):
    found = wiki_dump(spark, sf).select("ordinal", markup.categories(F.col("text")).alias("found"))
    return found.select("ordinal", F.array_join("found", "|").alias("categories"),
                        markup.any_category(F.col("found"), markup.DISEASE_CATEGORIES).alias("disease_category"),
                        markup.any_category(F.col("found"), markup.OTHER_CATEGORIES).alias("other_category"))


@query("disease_articles", f"""
SELECT {_TITLE} AS title, doc_id AS ordinal, CASE WHEN {_SECTIONED} THEN {_CLEAN} END AS symptom_text
FROM documents WHERE {_DISEASE}""")
def disease_articles(spark, sf):
    return disease.disease_articles(wiki_dump(spark, sf))


# The walk of the redirects, hop by hop, as the other engine's check.
def _walk(edges: str) -> str:
    return f"""WITH RECURSIVE e AS ({edges}),
walk AS (SELECT src, src AS cur, [src] AS seen, FALSE AS closed FROM e
  UNION ALL SELECT w.src, e.tgt, list_append(w.seen, e.tgt), list_contains(w.seen, e.tgt)
  FROM walk w JOIN e ON e.src = w.cur WHERE NOT w.closed),
ends AS (SELECT src, arg_max(cur, len(seen)) AS canonical, bool_or(closed AND cur = src) AS on_cycle
  FROM walk GROUP BY src)"""


@query("redirect_chains", _walk("SELECT doc_id AS src, (doc_id * doc_id + 1) % 1009 AS tgt FROM documents") +
       " SELECT src, tgt, canonical, on_cycle FROM e JOIN ends USING (src)")
def redirect_chains(spark, sf):
    """Every document redirects: chains, long tails and cycles."""
    edges = table(spark, sf, "documents").selectExpr("doc_id AS src", "(doc_id * doc_id + 1) % 1009 AS tgt")
    return resolve_chains(edges)


_ALIASES = _walk(f"SELECT {_TITLE} AS src, {_TARGET} AS tgt FROM documents WHERE doc_id % 5 IN (1, 4)") + f""",
aliases AS (SELECT CASE WHEN on_cycle THEN tgt ELSE canonical END AS canonical_title, src AS alias
            FROM e JOIN ends USING (src)),
d AS (SELECT {_TITLE} AS canonical_title, doc_id, CASE WHEN {_SECTIONED} THEN {_CLEAN} ELSE '' END AS symptom_text
      FROM documents WHERE {_DISEASE})
"""


@query("disease_aliases", _ALIASES + "SELECT canonical_title, alias FROM aliases SEMI JOIN d USING (canonical_title)")
def disease_aliases(spark, sf):
    return disease.disease_titles(wiki_dump(spark, sf))[1]


@query("alias_sets", _ALIASES + """
SELECT canonical_title, string_agg(alias, '|' ORDER BY alias) AS aliases FROM aliases GROUP BY 1""")
def alias_sets(spark, sf):
    """Aliases of every end title."""
    edges = resolve_chains(disease.redirect_edges(wiki_dump(spark, sf)))
    sets = disease.alias_sets(disease.alias_chunks(disease.alias_rows(edges), 3))
    return sets.select("canonical_title", F.array_join("aliases", "|").alias("aliases"))


@query("disease_master", _ALIASES + """
SELECT canonical_title, common_name, coalesce(alias_count, 0) AS alias_count, coalesce(aliases, '') AS aliases, symptom_text,
  1 AS source_titles_count, 'wiki' AS source_provider, '20240115' AS source_snapshot
FROM d LEFT JOIN (SELECT canonical_title, min(alias) AS common_name, count(*) AS alias_count,
                  string_agg(alias, '|' ORDER BY alias) AS aliases
                  FROM aliases GROUP BY 1) USING (canonical_title)""".replace(
    "SELECT canonical_title, common_name", "SELECT d.canonical_title, common_name"))
def disease_master(spark, sf):
    found, chunks = disease.disease_master(wiki_dump(spark, sf), "wiki", "20240115")
    shown = disease.alias_sets(chunks).select("canonical_title", F.array_join("aliases", "|").alias("aliases"))
    return found.drop("alias_chunks").join(shown, "canonical_title", "left").fillna("", "aliases")


@query("alias_chunks", _ALIASES + """,
n AS (SELECT canonical_title, alias, row_number() OVER (PARTITION BY canonical_title ORDER BY alias) - 1 AS i FROM aliases)
SELECT canonical_title, i // 2 AS chunk, string_agg(alias, '|' ORDER BY alias) AS aliases FROM n GROUP BY ALL""")
def alias_chunks(spark, sf):
    """Aliases of every end title as they are stored, two a row."""
    edges = resolve_chains(disease.redirect_edges(wiki_dump(spark, sf)))
    return disease.alias_chunks(disease.alias_rows(edges), 2).withColumn("aliases", F.array_join("aliases", "|"))


@query("title_keys", f"""
SELECT canonical_title FROM (SELECT {_TITLE} AS canonical_title FROM documents WHERE {_DISEASE}
UNION SELECT {_TARGET} FROM documents WHERE doc_id % 5 IN (1, 4)) ORDER BY 1""")
def title_keys(spark, sf):
    pages = wiki_dump(spark, sf)
    articles = disease.disease_articles(pages).select(F.col("title").alias("canonical_title"))
    targets = disease.redirect_edges(pages).select(F.col("tgt").alias("canonical_title"))
    return disease.title_keys(articles, targets)


@query("dump_round_trip", f"""
SELECT {_TITLE} AS title, length(text) AS n_chars, md5(text) AS digest, '20240115' AS snapshot
FROM ({with_sql('dump').strip()} SELECT ordinal AS doc_id, {_BLANKS.format('text')} AS text FROM dump)""")
def dump_round_trip(spark, sf):
    """The dump written as gzip JSON lines and read again."""
    path = scratch_path(spark, "dump") + "/wiki_20240115.jsonl"
    dumps.write_dump(wiki_dump(spark, sf), path)
    return dumps.read_dump(spark, path).select("title", F.length("text").alias("n_chars"),
                                               F.md5("text").alias("digest"), "snapshot")


@query("ndjson_round_trip", with_sql("drugs") + "SELECT item_seq, item_name, cancel_name FROM drugs")
def ndjson_round_trip(spark, sf):
    path = scratch_path(spark, "ndjson")
    dumps.write_ndjson(standin(spark, sf, "drugs").select("item_seq", "item_name", "cancel_name"), path)
    return spark.read.schema("item_seq string, item_name string, cancel_name string").json(path)
