"""Drug catalogue, vector search, safety rules and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from carelake.functions import advice
from carelake.operators import drug_safety, filters, selection, vectors
from carelake.plans import recommendation
from carelake.registry import query
from carelake.registry.standins import haversine_km, standin, table, with_sql
from carelake.session import scratch_path
from carelake.sources.snapshots import append_log, read_vector_index, search_vector_index, write_vector_index


@query("keyword_search", with_sql("drugs") + """
SELECT item_seq, item_name, material_name, class_no FROM drugs
WHERE etc_otc_code = '02' AND cancel_name IS NULL AND
 (item_name ILIKE '%RING%' OR material_name ILIKE '%RING%' OR class_no ILIKE '%RING%' OR
  item_name ILIKE '%m1_%' OR material_name ILIKE '%m1_%' OR class_no ILIKE '%m1_%')
ORDER BY item_name, item_seq LIMIT 50""")
def keyword_search(spark, sf):
    return filters.keyword_search(standin(spark, sf, "drugs"), ["RING", "m1_"]).select(
        "item_seq", "item_name", "material_name", "class_no")


@query("otc_catalogue", with_sql("drugs") + """
SELECT item_seq, item_name FROM drugs WHERE etc_otc_code = '02' AND cancel_name IS NULL ORDER BY item_name, item_seq""")
def otc_catalogue(spark, sf):
    return filters.otc_catalogue(standin(spark, sf, "drugs"), "02", None).select("item_seq", "item_name")


_DOCUMENT = """'약품명: ' || item_name || chr(10) || '제조사: ' || entp_name || chr(10) || '성분: ' ||
 coalesce(material_name, '') || chr(10) || '분류: ' || class_no || chr(10) || '효능: ' ||
 CASE WHEN ee_doc_id = '' THEN '정보 없음' ELSE ee_doc_id END"""


def _document():
    return advice.drug_document({c: F.col(c) for c in advice.DOCUMENT_LABELS}).alias("content")


@query("drug_documents", with_sql("drugs") + f"""
SELECT item_seq, {_DOCUMENT} AS content, coalesce(cancel_name, '') AS cancel_name FROM drugs""")
def drug_documents(spark, sf):
    return standin(spark, sf, "drugs").select(
        "item_seq", _document(), advice.metadata_default(F.col("cancel_name")).alias("cancel_name"))


def profiles(spark, sf):
    """Ten query vectors: the mean embedding of each label, over the whole table."""
    cells = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = cells.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(
        F.sort_array(F.collect_list(F.struct("i", "x")))["x"].alias("embedding"))


def catalogue(spark, sf):
    """Over-the-counter drugs that have an embedding."""
    drugs = filters.active_drugs(standin(spark, sf, "drugs"), "02", None)
    return drugs.join(table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id")


_PROFILES = """SELECT CAST(label AS BIGINT) AS query_id, list(x ORDER BY i) AS q FROM (
  SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) t(i) GROUP BY label, i)
  GROUP BY label"""
_CATALOGUE = """SELECT d.*, CAST(e.embedding AS DOUBLE[]) AS v FROM drugs d JOIN embeddings e USING (vec_id)
  WHERE etc_otc_code = '02' AND cancel_name IS NULL"""
_HITS = """SELECT query_id, vec_id, item_seq, item_name, entp_name, pow(list_distance(q, v), 2) AS distance,
  row_number() OVER (PARTITION BY query_id ORDER BY list_distance(q, v), vec_id) AS rank
  FROM profiles, catalogue QUALIFY rank <= 20"""


@query("similar_drugs", with_sql("drugs", profiles=_PROFILES, catalogue=_CATALOGUE, hits=_HITS) + """
SELECT query_id, item_seq, round(distance, 6) AS distance, rank FROM hits""")
def similar_drugs(spark, sf):
    drugs = catalogue(spark, sf)
    hits = vectors.similar(profiles(spark, sf), drugs, 20)
    return hits.join(drugs.select("vec_id", "item_seq"), "vec_id").select(
        "query_id", "item_seq", F.round("distance", 6).alias("distance"), "rank")


@query("similar_by_cosine", f"""WITH profiles AS ({_PROFILES})
SELECT query_id, vec_id, round(list_cosine_distance(q, CAST(embedding AS DOUBLE[])), 6) AS distance,
  row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_distance(q, CAST(embedding AS DOUBLE[])), vec_id) AS rank
FROM profiles, embeddings QUALIFY rank <= 10""")
def similar_by_cosine(spark, sf):
    hits = vectors.similar(profiles(spark, sf), table(spark, sf, "embeddings"), 10, "cosine")
    return hits.withColumn("distance", F.round("distance", 6))


@query("nearest_neighbours", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.vec_id AS query_id, b.vec_id, round(pow(list_distance(a.v, b.v), 2), 6) AS distance,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS rank
FROM e a, e b QUALIFY rank <= 5""")
def nearest_neighbours(spark, sf):
    """Every vector asks: more queries than a task should hold, so they meet in blocks."""
    rows = table(spark, sf, "embeddings")
    asked = rows.select(F.col("vec_id").alias("query_id"), "embedding")
    hits = vectors.similar(asked, rows, 5, few=128, block_rows=1000)
    return hits.withColumn("distance", F.round("distance", 6))


@query("products_of_neighbours", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.vec_id AS query_id, b.vec_id, round(-list_inner_product(a.v, b.v), 6) AS distance,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY -list_inner_product(a.v, b.v), b.vec_id) AS rank
FROM e a, e b QUALIFY rank <= 5""")
def products_of_neighbours(spark, sf):
    """The same by inner product, from an index that is stored first."""
    rows, path = table(spark, sf, "embeddings"), scratch_path(spark, "product-index")
    write_vector_index(rows.select("vec_id", "embedding"), path, "dot")
    hits = search_vector_index(spark, path, rows.select(F.col("vec_id").alias("query_id"), "embedding"), 5)
    return hits.withColumn("distance", F.round("distance", 6))


@query("vector_index", with_sql("drugs") + f"""
SELECT vec_id, item_seq, {_DOCUMENT} AS content, count(*) OVER () AS index_size
FROM drugs JOIN embeddings USING (vec_id) WHERE etc_otc_code = '02' AND cancel_name IS NULL""")
def vector_index(spark, sf):
    """The index as written and read back, with its size."""
    documents, path = catalogue(spark, sf), scratch_path(spark, "index")
    write_vector_index(documents.select("vec_id", "item_seq", _document(), "embedding"), path)
    index = read_vector_index(spark, path)
    size = index.agg(F.count(F.lit(1))).scalar()
    return index.select("vec_id", "item_seq", "content", size.alias("index_size"))


# ---- safety -------------------------------------------------------------------------------------

_CANDIDATES = """SELECT l_orderkey AS request_id, CAST(l_partkey AS VARCHAR) AS item_seq, user_age, is_pregnant
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN people ON o_custkey = id"""


def candidates(spark, sf):
    """Every line as a candidate drug of its order's customer."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("id"))
    facts = orders.join(standin(spark, sf, "people").select("id", "user_age", "is_pregnant"), "id")
    lines = standin(spark, sf, "lines").withColumnRenamed("rx_id", "request_id")
    return lines.join(facts.drop("id"), "request_id")


def _rules(spark, sf):
    return standin(spark, sf, "pregnancy_rules"), standin(spark, sf, "elderly_rules")


def _safety_sql(body):
    return with_sql("people", "pregnancy_rules", "elderly_rules", candidates=_CANDIDATES) + body


@query("safe_candidates", _safety_sql("""
SELECT request_id, item_seq FROM candidates c WHERE
  NOT (coalesce(is_pregnant, FALSE) AND item_seq IN (SELECT item_seq FROM pregnancy_rules)) AND
  NOT (coalesce(user_age >= 65, FALSE) AND item_seq IN (SELECT item_seq FROM elderly_rules))"""))
def safe_candidates(spark, sf):
    return drug_safety.safe_candidates(candidates(spark, sf), *_rules(spark, sf)).select("request_id", "item_seq")


@query("candidate_warnings", _safety_sql("""
SELECT request_id, c.item_seq, 'pregnancy' AS kind, type_name, prohbt_content
FROM candidates c JOIN pregnancy_rules r ON c.item_seq = r.item_seq WHERE is_pregnant
UNION ALL SELECT request_id, c.item_seq, 'elderly', type_name, prohbt_content
FROM candidates c JOIN elderly_rules r ON c.item_seq = r.item_seq WHERE user_age >= 65"""))
def candidate_warnings(spark, sf):
    return drug_safety.warning_rows(candidates(spark, sf), *_rules(spark, sf))


@query("warning_counts", _safety_sql("""
SELECT request_id, item_seq, pregnancy_warnings, elderly_warnings,
       pregnancy_warnings + elderly_warnings > 0 AS has_warnings
FROM (SELECT request_id, item_seq,
  CASE WHEN is_pregnant THEN (SELECT count(*) FROM pregnancy_rules r WHERE r.item_seq = c.item_seq) ELSE 0 END
    AS pregnancy_warnings,
  CASE WHEN user_age >= 65 THEN (SELECT count(*) FROM elderly_rules r WHERE r.item_seq = c.item_seq) ELSE 0 END
    AS elderly_warnings FROM candidates c)"""))
def warning_counts(spark, sf):
    return drug_safety.warning_counts(candidates(spark, sf), *_rules(spark, sf)).drop("user_age", "is_pregnant")


@query("missing_facts", _safety_sql("""
SELECT request_id, concat_ws(',', CASE WHEN a THEN 'age' END, CASE WHEN p THEN 'pregnancy' END) AS missing,
       NOT a AND NOT p AS all_info_provided
FROM (SELECT request_id,
  bool_or(user_age IS NULL AND item_seq IN (SELECT item_seq FROM elderly_rules)) AS a,
  bool_or(is_pregnant IS NULL AND item_seq IN (SELECT item_seq FROM pregnancy_rules)) AS p
  FROM candidates GROUP BY request_id)"""))
def missing_facts(spark, sf):
    found = drug_safety.missing_facts(candidates(spark, sf), *_rules(spark, sf))
    return found.withColumn("missing", F.array_join("missing", ","))


@query("pair_interactions", with_sql("lines", "pair_rules") + """
, f AS (SELECT DISTINCT least(item_seq, mixture_item_seq) AS a, greatest(item_seq, mixture_item_seq) AS b
        FROM pair_rules),
t AS (SELECT DISTINCT rx_id, item_seq FROM lines)
SELECT x.rx_id, a AS item_seq, b AS mixture_item_seq
FROM t x JOIN t y ON x.rx_id = y.rx_id JOIN f ON a = x.item_seq AND b = y.item_seq""")
def pair_interactions(spark, sf):
    return drug_safety.pair_interactions(standin(spark, sf, "lines"), standin(spark, sf, "pair_rules"))


@query("rule_hits", with_sql("lines", "age_rules", "dose_rules", "duration_rules", "split_rules") + """
, r AS (SELECT *, 'age' AS kind FROM age_rules UNION ALL SELECT *, 'dose' FROM dose_rules
  UNION ALL SELECT *, 'duration' FROM duration_rules UNION ALL SELECT *, 'split' FROM split_rules)
SELECT DISTINCT rx_id, lines.item_seq, kind, prohbt_content FROM lines JOIN r ON lines.item_seq = r.item_seq""")
def rule_hits(spark, sf):
    rules = {k: standin(spark, sf, f"{k}_rules") for k in ("age", "dose", "duration", "split")}
    return drug_safety.rule_hits(standin(spark, sf, "lines"), rules)


@query("therapeutic_duplication", with_sql("lines", "effects") + """
SELECT rx_id, effect_name, count(DISTINCT lines.item_seq) AS item_count
FROM lines JOIN effects ON lines.item_seq = effects.item_seq GROUP BY ALL HAVING item_count >= 2""")
def therapeutic_duplication(spark, sf):
    return drug_safety.therapeutic_duplication(standin(spark, sf, "lines"), standin(spark, sf, "effects"))


# Replies of the selector: plain, fenced in nothing, with ranks out of range, repeated, or broken.
_REPLY = """CASE request_id % 6 WHEN 0 THEN '[2, 1, 3]' WHEN 1 THEN '[0, 11, 2, 1]' WHEN 2 THEN 'none'
 WHEN 3 THEN '[1, 1]' WHEN 4 THEN '[99]' ELSE '[3, 2]' END"""
_PICKS = """CASE WHEN request_id % 6 = 0 THEN [2, 1, 3] WHEN request_id % 6 = 1 THEN [2] WHEN request_id % 6 = 3
 THEN [1, 1] WHEN request_id % 6 = 5 THEN [3, 2] ELSE [] END"""
_CHOSEN = f"""SELECT request_id, CASE WHEN len(list_filter({_PICKS}, lambda r: r <= n)) > 0
   THEN list_filter({_PICKS}, lambda r: r <= n) ELSE range(1, least(3, n) + 1) END AS ranks FROM sizes"""


@query("selected_drugs", _safety_sql(f""", distinct_candidates AS (SELECT DISTINCT request_id, item_seq FROM candidates),
shown AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY item_seq) AS shown_rank
  FROM distinct_candidates QUALIFY shown_rank <= 10),
sizes AS (SELECT request_id, count(*) AS n FROM shown GROUP BY 1),
chosen AS ({_CHOSEN}),
picks AS (SELECT request_id, CAST(unnest(ranks) AS BIGINT) AS shown_rank, unnest(range(0, len(ranks))) AS place FROM chosen)
SELECT request_id, place, item_seq FROM picks JOIN shown USING (request_id, shown_rank)"""))
def selected_drugs(spark, sf):
    shown = selection.rank_again(candidates(spark, sf).select("request_id", "item_seq").distinct(), ["item_seq"])
    replies = table(spark, sf, "orders").select(F.col("o_orderkey").alias("request_id")).withColumn("reply", F.expr(_REPLY))
    return selection.select_drugs(shown, replies).select("request_id", "place", "item_seq")


# ---- the whole way from a request to its answer -------------------------------------------------

_SEVERITY = """CASE c_mktsegment
 WHEN 'AUTOMOBILE' THEN '```json' || chr(10) || '{"severity_score": 9, "recommendation": "HOSPITAL", "reason": "urgent"}' || chr(10) || '```'
 WHEN 'FURNITURE' THEN '{"severity_score": 8, "recommendation": "HOSPITAL", "reason": "see a doctor"}'
 WHEN 'MACHINERY' THEN 'I cannot say'
 ELSE '{"severity_score": 3, "recommendation": "PHARMACY", "reason": "mild"}' END"""


def requests(spark, sf):
    people, points = standin(spark, sf, "people"), standin(spark, sf, "points")
    customers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("request_id"), F.concat(F.lit("D"), F.col("c_nationkey").cast("string")).alias("disease_name"),
        (F.col("c_custkey") % 10).alias("query_id"), F.expr(_SEVERITY).alias("severity_reply"))
    return (customers.join(people.select(F.col("id").alias("request_id"), "user_age", "is_pregnant"), "request_id")
            .join(points.withColumnRenamed("point_id", "request_id"), "request_id")
            .withColumn("rank_reply", F.expr(_REPLY)))


_NEAR_COUNT = f"""SELECT point_id AS request_id, least(10, count(*) FILTER (WHERE km <= 3)) AS near3,
   least(10, count(*) FILTER (WHERE km <= 5)) AS near5,
   string_agg(facility_id, ',' ORDER BY r) FILTER (WHERE km <= 3 AND r <= 10) AS ids3,
   string_agg(facility_id, ',' ORDER BY r) FILTER (WHERE km <= 5 AND r <= 10) AS ids5
   FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY km, facility_id) AS r FROM (
   SELECT point_id, facility_id, {haversine_km('p.lat', 'p.lon', 'f.lat', 'f.lon')} AS km
   FROM points p JOIN facilities f ON f.lon IS NOT NULL)) GROUP BY 1"""

_RECOMMEND = with_sql(
    "people", "points", "facilities", "drugs", "pregnancy_rules", "elderly_rules",
    profiles=_PROFILES, catalogue=_CATALOGUE, hits=_HITS, near=_NEAR_COUNT,
    requests="""SELECT c_custkey AS request_id, 'D' || CAST(c_nationkey AS VARCHAR) AS disease, c_custkey % 10 AS query_id,
      c_mktsegment AS seg, user_age, is_pregnant, CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'FURNITURE') THEN 'HOSPITAL'
      ELSE 'PHARMACY' END AS recommendation,
      CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 9 WHEN 'FURNITURE' THEN 8 WHEN 'MACHINERY' THEN 4 ELSE 3 END AS score
      FROM customer JOIN people ON c_custkey = id""",
    c="""SELECT request_id, rank, item_seq, item_name, entp_name, user_age, is_pregnant,
      item_seq IN (SELECT item_seq FROM pregnancy_rules) AS pr, item_seq IN (SELECT item_seq FROM elderly_rules) AS er
      FROM requests JOIN hits USING (query_id) WHERE recommendation = 'PHARMACY'""",
    asked="""SELECT request_id, bool_or(user_age IS NULL AND er) AS a, bool_or(is_pregnant IS NULL AND pr) AS p
      FROM c GROUP BY 1""",
    shown="""SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rank) AS shown_rank FROM c
      WHERE NOT (coalesce(is_pregnant, FALSE) AND pr) AND NOT (coalesce(user_age >= 65, FALSE) AND er)
      QUALIFY shown_rank <= 10""",
    sizes="SELECT request_id, count(*) AS n FROM shown GROUP BY 1", chosen=_CHOSEN,
    picks="""SELECT request_id, CAST(unnest(ranks) AS BIGINT) AS shown_rank, unnest(range(0, len(ranks))) AS place
      FROM chosen""",
    drugs_of="""SELECT request_id, count(*) AS drug_count, arg_min(item_name, place) AS first_drug,
      string_agg(item_seq, ',' ORDER BY place) AS drug_ids,
      string_agg(CAST(place + 1 AS VARCHAR) || '. ' || item_name || ' (' || entp_name || ')' || chr(10), '' ORDER BY place)
        AS listed FROM picks JOIN shown USING (request_id, shown_rank) GROUP BY 1""",
    e="""SELECT r.*, a, p, drug_count, first_drug, listed, drug_ids, ids3, ids5, coalesce(near3, 0) AS near3, coalesce(near5, 0) AS near5
      FROM requests r LEFT JOIN asked USING (request_id) LEFT JOIN drugs_of USING (request_id)
      LEFT JOIN near USING (request_id)""") + """
SELECT request_id, recommendation, score AS severity_score, seg <> 'MACHINERY' AS parse_ok,
  CASE WHEN recommendation = 'HOSPITAL' THEN 'recommendation' WHEN a IS NULL THEN 'text' WHEN a OR p THEN 'info_request'
    WHEN drug_count IS NULL THEN 'text' ELSE 'recommendation' END AS message_type,
  CASE WHEN recommendation = 'HOSPITAL' OR a IS NULL OR a OR p THEN 0 ELSE coalesce(drug_count, 0) END AS drug_count,
  CASE WHEN recommendation = 'HOSPITAL' OR a IS NULL OR a OR p THEN NULL ELSE first_drug END AS first_drug,
  CASE WHEN recommendation = 'HOSPITAL' THEN near5 WHEN a IS NULL OR a OR p OR drug_count IS NULL THEN 0 ELSE near3 END
    AS facilities,
  CASE WHEN recommendation = 'HOSPITAL' THEN ids5 WHEN a IS NULL OR a OR p OR drug_count IS NULL THEN NULL ELSE ids3 END AS places,
  CASE WHEN recommendation = 'HOSPITAL' OR a IS NULL OR a OR p OR drug_count IS NULL THEN NULL ELSE drug_ids END AS drugs,
  CASE WHEN recommendation = 'HOSPITAL' THEN
    CASE WHEN score >= 9 THEN '⚠️ **' || disease || '**은 응급 상황입니다!' || chr(10) || chr(10) || '심각도: 9/10점 (응급)' || chr(10) ||
      '사유: urgent' || chr(10) || chr(10) || '🚨 **즉시 119에 전화하거나 가까운 응급실을 방문하세요!**' || chr(10) || chr(10)
    ELSE '⚠️ **' || disease || '**은 병원 진료가 필요합니다.' || chr(10) || chr(10) || '심각도: 8/10점' || chr(10) ||
      '사유: see a doctor' || chr(10) || chr(10) || '🏥 일반의약품으로는 치료가 어렵습니다. 병원을 방문하세요.' || chr(10) || chr(10) END
    || CASE WHEN near5 > 0 THEN '📍 가까운 병원 ' || CAST(near5 AS VARCHAR) || '곳을 확인하세요.' ELSE '' END
  WHEN a IS NULL THEN '적합한 일반의약품을 찾을 수 없습니다. 약사와 상담하시길 권장합니다.'
  WHEN a AND p THEN '안전한 약품 추천을 위해 다음 정보를 알려주세요:' || chr(10) || chr(10) || '• 나이' || chr(10) ||
    '• 임신 여부 (임신 중이신가요?)'
  WHEN a THEN '안전한 약품 추천을 위해 나이를 알려주시겠어요?'
  WHEN p THEN '안전한 약품 추천을 위해 임신 여부 (임신 중이신가요?)를 알려주시겠어요?'
  WHEN drug_count IS NULL THEN '사용자 정보상 금기사항이 있어 추천할 약품이 없습니다. 의사와 상담하세요.'
  ELSE '**' || disease || '** 추천 약품:' || chr(10) || chr(10) || listed || chr(10) ||
    CASE WHEN near3 > 0 THEN '가까운 약국 ' || CAST(near3 AS VARCHAR) || '곳을 확인하세요.' || chr(10) || chr(10) ELSE '' END ||
    '💊 약품 구매 전 약사와 상담을 권장합니다.' END AS message
FROM e"""


@query("recommendations", _RECOMMEND)
def recommendations(spark, sf):
    places = standin(spark, sf, "facilities")
    found = recommendation.recommend(requests(spark, sf), profiles(spark, sf), catalogue(spark, sf),
                                     *_rules(spark, sf), places, places)
    return found.withColumns({"places": F.array_join(F.transform("places", lambda p: p["facility"]["facility_id"].cast("string")), ","),
                              "drugs": F.array_join("drugs.item_seq", ",")})


@query("logged_recommendations", f"""
SELECT request_id AS log_id, 'D' || CAST(c_nationkey AS VARCHAR) AS predicted_disease, recommendation,
  first_drug AS drug_suggested, severity_score, CAST(request_id % 50 AS INTEGER) AS gps_accuracy_m,
  CASE WHEN recommendation = 'HOSPITAL' THEN 0 ELSE facilities END AS pharmacies,
  CASE WHEN recommendation = 'HOSPITAL' THEN facilities ELSE 0 END AS hospitals
FROM ({_RECOMMEND}) JOIN customer ON c_custkey = request_id""")
def logged_recommendations(spark, sf):
    """The answers, appended to the log and read back."""
    places, asked = standin(spark, sf, "facilities"), requests(spark, sf).withColumn("accuracy", F.col("request_id") % 50)
    answers = recommendation.recommend(asked, profiles(spark, sf), catalogue(spark, sf), *_rules(spark, sf), places, places)
    path = scratch_path(spark, "answer-log")
    append_log(recommendation.answer_log(asked, answers, F.lit("2024-01-01 00:00:00").cast("timestamp")), path, "answers-1")

    def listed(column):
        return F.coalesce(F.json_array_length(column), F.lit(0)).alias(column.removeprefix("nearby_"))
    return spark.read.parquet(path).select(
        "log_id", "predicted_disease", "recommendation", "drug_suggested", "severity_score", "gps_accuracy_m",
        listed("nearby_pharmacies"), listed("nearby_hospitals"))
