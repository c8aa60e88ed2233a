"""Facility search, regions, lookups and people."""

from __future__ import annotations

from pyspark.sql import functions as F

from carelake.functions import clock, geo
from carelake.operators import filters, nearby, parties
from carelake.registry import query
from carelake.registry.standins import haversine_km, standin, standin_sql, table, with_sql

_NEAR = with_sql("points", "facilities", near=f"""
  SELECT point_id, facility_id, kind,
         {haversine_km('p.lat', 'p.lon', 'f.lat', 'f.lon')} AS km,
         CASE WHEN kind LIKE '%상급종합%' THEN 1 WHEN kind LIKE '%종합병원%' THEN 2
              WHEN kind LIKE '%병원%' THEN 3 ELSE 4 END AS tier
  FROM points p JOIN facilities f ON f.lon IS NOT NULL AND f.lat IS NOT NULL
   AND {haversine_km('p.lat', 'p.lon', 'f.lat', 'f.lon')} <= 5""")


@query("nearby_facilities", _NEAR + """
SELECT point_id, facility_id, round(km, 6) AS distance_km,
       row_number() OVER (PARTITION BY point_id ORDER BY km, facility_id) AS rank
FROM near QUALIFY rank <= 10""")
def nearby_facilities(spark, sf):
    found = nearby.nearby_facilities(standin(spark, sf, "points"), standin(spark, sf, "facilities"), 5.0, 10)
    return found.select("point_id", "facility_id", F.round("distance_km", 6).alias("distance_km"), "rank")


@query("nearby_by_tier", _NEAR + """
SELECT point_id, facility_id, tier, round(km, 6) AS distance_km,
       row_number() OVER (PARTITION BY point_id ORDER BY tier, km, facility_id) AS rank
FROM near QUALIFY rank <= 3""")
def nearby_by_tier(spark, sf):
    found = nearby.nearby_facilities(standin(spark, sf, "points"), standin(spark, sf, "facilities"),
                                     5.0, 3, order="tier")
    return found.select("point_id", "facility_id", "tier", F.round("distance_km", 6).alias("distance_km"), "rank")


# Request times of the points, spread over two weeks; Seoul is nine hours ahead all year.
_ASKED_S = "1704412800 + point_id * 2220"


@query("open_facilities", _NEAR + f""",
ranked AS (
  SELECT point_id, facility_id, kind,
         row_number() OVER (PARTITION BY point_id ORDER BY km, facility_id) AS rank,
         make_timestamp(({_ASKED_S} + 32400) * 1000000) AS local_ts
  FROM near QUALIFY rank <= 10),
timed AS (SELECT *, isodow(local_ts) AS dow, hour(local_ts) * 60 + minute(local_ts) AS m FROM ranked),
marked AS (SELECT *, CASE WHEN dow = 7 THEN kind <> '의원'
    WHEN dow = 6 THEN m BETWEEN 540 AND 780
    ELSE m >= 540 AND m < CASE WHEN kind = '의원' THEN 1140 ELSE 1080 END END AS is_open FROM timed)
SELECT point_id, facility_id, rank, is_open FROM marked
QUALIFY is_open OR (NOT max(is_open) OVER (PARTITION BY point_id) AND rank <= 3)""")
def open_facilities(spark, sf):
    """Clinics keep pharmacy hours here, all other kinds hospital hours."""
    facilities = standin(spark, sf, "facilities")
    found = nearby.nearby_facilities(standin(spark, sf, "points"), facilities, 5.0, 10)
    asked = F.timestamp_seconds(F.expr(_ASKED_S))
    is_open = F.when(F.col("kind") == "의원", clock.pharmacy_open(asked)).otherwise(clock.hospital_open(asked))
    timed = found.join(facilities.select("facility_id", "kind"), "facility_id").withColumn("is_open", is_open)
    return nearby.prefer_open(timed).select("point_id", "facility_id", "rank", "is_open")


@query("opening_hours", """
WITH t AS (SELECT event_id, ts + INTERVAL 9 HOUR AS l FROM events),
m AS (SELECT event_id, isodow(l) AS dow, hour(l) * 60 + minute(l) AS m FROM t)
SELECT event_id,
  CASE WHEN dow = 7 THEN FALSE WHEN dow = 6 THEN m BETWEEN 540 AND 780
       ELSE m >= 540 AND m < 1140 END AS pharmacy_open,
  CASE WHEN dow = 7 THEN TRUE WHEN dow = 6 THEN m BETWEEN 540 AND 780
       ELSE m >= 540 AND m < 1080 END AS hospital_open
FROM m""")
def opening_hours(spark, sf):
    ts = F.col("ts")
    return table(spark, sf, "events").select(
        "event_id", clock.pharmacy_open(ts).alias("pharmacy_open"), clock.hospital_open(ts).alias("hospital_open"))


@query("region_labels", with_sql("points") + """
SELECT point_id, CASE WHEN lat BETWEEN 37.4e0 AND 37.7e0 AND lon BETWEEN 126.8e0 AND 127.2e0 THEN '서울특별시'
  WHEN lat BETWEEN 35 AND 39 AND lon BETWEEN 126 AND 130 THEN '대한민국' ELSE '위치 확인 불가' END AS region
FROM (SELECT point_id, lat - CASE WHEN point_id % 9 = 0 THEN 20 ELSE 0 END AS lat, lon FROM points)""")
def region_labels(spark, sf):
    lat = F.col("lat") - F.when(F.col("point_id") % 9 == 0, 20).otherwise(0)
    return standin(spark, sf, "points").select(
        "point_id", geo.region_label(lat, F.col("lon")).alias("region"))


@query("distance_labels", with_sql("points", d=f"""
  SELECT point_id, lon, lat,
    round({haversine_km('37.5665e0', '126.978e0', 'lat', 'lon', '6371000e0')} * 1000) AS metres FROM points""") + """
SELECT point_id, CAST(metres AS BIGINT) AS metres,
  CASE WHEN metres = 0 THEN '' WHEN metres < 1000 THEN CAST(CAST(metres AS BIGINT) AS VARCHAR) || 'm'
       ELSE CAST(CAST(floor((CAST(metres AS BIGINT) + 50) / 100) AS BIGINT) // 10 AS VARCHAR) || '.' ||
            CAST(CAST(floor((CAST(metres AS BIGINT) + 50) / 100) AS BIGINT) % 10 AS VARCHAR) || 'km' END AS label
FROM d""")
def distance_labels(spark, sf):
    """Distance to the city hall on the client's sphere, with its label."""
    metres = F.round(geo.great_circle_m(F.lit(37.5665), F.lit(126.978), F.col("lat"), F.col("lon"),
                                        geo.CLIENT_SPHERE_M)).cast("bigint")
    points = standin(spark, sf, "points").withColumn("metres", metres)
    return points.select("point_id", "metres", geo.distance_label(F.col("metres")).alias("label"))


@query("wkt_points", with_sql("points") + """
SELECT point_id, 'POINT(' || CAST(lon AS VARCHAR) || ' ' || CAST(lat AS VARCHAR) || ')' AS wkt FROM points""")
def wkt_points(spark, sf):
    return standin(spark, sf, "points").select(
        "point_id", geo.wkt_point(F.col("lon"), F.col("lat")).alias("wkt"))


@query("missing_positions", with_sql("facilities") + """
SELECT kind, count(*) AS located, 0 + (SELECT count(*) FROM supplier) AS all_rows
FROM facilities WHERE lon IS NOT NULL AND lat IS NOT NULL GROUP BY kind""")
def missing_positions(spark, sf):
    facilities = standin(spark, sf, "facilities")
    total = facilities.agg(F.count(F.lit(1))).scalar()
    return filters.with_position(facilities).groupBy("kind").agg(
        F.count(F.lit(1)).alias("located"), F.first(total).alias("all_rows"))


def _registry(spark, sf):
    """Facility registry rows with region and name."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    place = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey"), F.col("n_name").alias("sggu_cd_nm"), F.col("r_name").alias("sido_cd_nm"))
    rows = table(spark, sf, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("yadm_nm"), "sido_cd_nm", "sggu_cd_nm",
                       F.concat("sggu_cd_nm", F.lit(" "), "c_mktsegment").alias("addr"))


_REGISTRY = """WITH registry AS (
  SELECT c_custkey AS id, c_name AS yadm_nm, r_name AS sido_cd_nm, n_name AS sggu_cd_nm,
         n_name || ' ' || c_mktsegment AS addr
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


@query("facilities_by_region", _REGISTRY + """
SELECT 'all' AS picked, id, yadm_nm FROM registry
UNION ALL SELECT 'province', id, yadm_nm FROM registry WHERE sido_cd_nm = 'ASIA'
UNION ALL SELECT 'district', id, yadm_nm FROM registry WHERE sido_cd_nm = 'ASIA' AND sggu_cd_nm = 'NATION_2'
UNION ALL SELECT 'district_only', id, yadm_nm FROM registry""")
def facilities_by_region(spark, sf):
    rows = _registry(spark, sf)
    picks = {"all": (None, None), "province": ("Asia", None), "district": ("asia", "Nation_2"),
             "district_only": (None, "NATION_2")}
    parts = [filters.by_region(rows, *p).select(F.lit(n).alias("picked"), "id", "yadm_nm") for n, p in picks.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("facilities_by_text", _REGISTRY + """
SELECT 'name' AS picked, id FROM registry WHERE yadm_nm ILIKE '%customer#%77%'
UNION ALL SELECT 'address', id FROM registry WHERE addr ILIKE '%_2 build%'""")
def facilities_by_text(spark, sf):
    rows = _registry(spark, sf)
    return filters.containing(rows, "yadm_nm", "customer#%77").select(F.lit("name").alias("picked"), "id").union(
        filters.containing(rows, "addr", "_2 build").select(F.lit("address"), "id"))


_CENTRES = """WITH centres AS (
  SELECT o_orderkey AS hpid, CAST(o_custkey % 150 AS VARCHAR) AS hira_ykiho FROM orders),
hospitals AS (SELECT CAST(s_suppkey AS VARCHAR) AS ykiho, s_name AS yadm_nm FROM supplier)
"""


def _centres(spark, sf):
    centres = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("hpid"), (F.col("o_custkey") % 150).cast("string").alias("hira_ykiho"))
    hospitals = table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("ykiho"), F.col("s_name").alias("yadm_nm"))
    return centres, hospitals


@query("centres_with_hospital", _CENTRES + """
SELECT hpid, hira_ykiho, yadm_nm AS hospital_name, yadm_nm IS NOT NULL AS parent_found
FROM centres LEFT JOIN hospitals ON hira_ykiho = ykiho""")
def centres_with_hospital(spark, sf):
    return parties.with_parent(*_centres(spark, sf)).select("hpid", "hira_ykiho", "hospital_name", "parent_found")


@query("centres_of_hospital", _CENTRES + "SELECT hpid FROM centres WHERE hira_ykiho = '42'")
def centres_of_hospital(spark, sf):
    return filters.linked_to(_centres(spark, sf)[0], "42").select("hpid")


@query("key_lookup", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def key_lookup(spark, sf):
    """A lookup for every key that the orders name."""
    return filters.lookup_all(table(spark, sf, "customer"), "c_custkey", table(spark, sf, "orders"),
                              "o_custkey").select("c_custkey", "c_name")


@query("user_by_email", with_sql("people") + "SELECT id, name, email FROM people WHERE email = 'u77@example.org'")
def user_by_email(spark, sf):
    return filters.lookup(standin(spark, sf, "people"), "email", "U77@Example.ORG").select("id", "name", "email")


@query("condition_map", """
SELECT p_partkey, p_name FROM part
WHERE p_type = 'ECONOMY' AND p_name ILIKE '%ring%' AND p_size IN (5, 11, 17, 23, 29)""")
def condition_map(spark, sf):
    conditions = {"p_type": "Economy", "p_name": "%ring%", "p_size": [5, 11, 17, 23, 29], "p_brand": "",
                  "p_retailprice": None}
    return filters.matching(table(spark, sf, "part"), conditions).select("p_partkey", "p_name")


@query("row_exists", """
SELECT 'hit' AS asked, count(*) > 0 AS exists_flag FROM part WHERE p_brand = 'Brand#3' AND p_size = 7
UNION ALL SELECT 'miss', count(*) > 0 FROM part WHERE p_brand = 'Brand#99'""")
def row_exists(spark, sf):
    part = table(spark, sf, "part")
    hit = filters.any_match(part, {"p_brand": "Brand#3", "p_size": 7})
    miss = filters.any_match(part, {"p_brand": "Brand#99"})
    return hit.select(F.lit("hit").alias("asked"), "exists_flag").union(miss.select(F.lit("miss"), "exists_flag"))


@query("table_page", "SELECT c_custkey, c_name FROM customer ORDER BY c_name DESC, c_custkey LIMIT 25 OFFSET 50")
def table_page(spark, sf):
    rows = filters.ordered(table(spark, sf, "customer"), "c_name", "DESC", tie="c_custkey")
    return filters.page(rows, 3, 25).select("c_custkey", "c_name")


_ASSESSED = """WITH a AS (
  SELECT o_orderkey AS id, o_orderpriority AS title, o_custkey AS patient_id, o_orderkey % 12 AS doctor_id,
         o_orderdate AS created_at FROM orders),
u AS (SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN '' ELSE c_name END AS name,
             'u' || CAST(c_custkey AS VARCHAR) || '@example.org' AS email FROM customer WHERE c_custkey <> 7),
j AS (SELECT a.id, a.title, a.patient_id, a.doctor_id, a.created_at,
   CASE WHEN p.name <> '' THEN p.name END AS patient_name, CASE WHEN p.name <> '' THEN p.email END AS patient_email,
   CASE WHEN d.name <> '' THEN d.name END AS doctor_name, CASE WHEN d.name <> '' THEN d.email END AS doctor_email
 FROM a LEFT JOIN u p ON a.patient_id = p.id LEFT JOIN u d ON a.doctor_id = d.id)
"""


def _assessed(spark, sf):
    assessments = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"),
        F.col("o_custkey").alias("patient_id"), (F.col("o_orderkey") % 12).alias("doctor_id"),
        F.col("o_orderdate").alias("created_at"))
    customer = table(spark, sf, "customer").where("c_custkey <> 7")  # one doctor is unknown
    users = customer.select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_name")).alias("name"),
        F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@example.org")).alias("email"))
    return parties.with_parties(assessments, users)


def _flat(joined):
    return joined.select("id", "title", F.col("patient.name").alias("patient_name"),
                         F.col("patient.email").alias("patient_email"),
                         F.col("doctor.name").alias("doctor_name"), F.col("doctor.email").alias("doctor_email"))


@query("assessments_with_parties", _ASSESSED + """
SELECT id, title, patient_name, patient_email, doctor_name, doctor_email FROM j ORDER BY created_at DESC, id""")
def assessments_with_parties(spark, sf):
    return _flat(parties.newest_first(_assessed(spark, sf)))


@query("assessments_of_person", _ASSESSED + """
SELECT 'patient' AS role, id, doctor_name AS other FROM j WHERE patient_id = 42
UNION ALL SELECT 'doctor', id, patient_name FROM j WHERE doctor_id = 5""")
def assessments_of_person(spark, sf):
    joined = _assessed(spark, sf)
    return parties.of_person(joined, "patient", 42).select(
        F.lit("patient").alias("role"), "id", F.col("doctor.name").alias("other")).union(
        parties.of_person(joined, "doctor", 5).select(F.lit("doctor"), "id", "patient.name"))
