"""From a chosen disease to drugs, facilities, advice and a log row, for many requests at once.

``requests(request_id, disease_name, symptoms, query_id, user_age, is_pregnant,
lat, lon, severity_reply, rank_reply)``. Model replies are input columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.functions import advice, records
from carelake.functions.replies import severity_decision
from carelake.operators.drug_safety import missing_facts, safe_candidates
from carelake.operators.nearby import nearby_facilities
from carelake.operators.selection import rank_again, select_drugs
from carelake.operators.vectors import similar
from carelake.session import cut_lineage

# Search sizes and answers.
CANDIDATES, PHARMACY_KM, HOSPITAL_KM, FACILITIES = 20, 3.0, 5.0, 10
NONE_FOUND = "적합한 일반의약품을 찾을 수 없습니다. 약사와 상담하시길 권장합니다."
NONE_SAFE = "사용자 정보상 금기사항이 있어 추천할 약품이 없습니다. 의사와 상담하세요."


def decided(requests: DataFrame) -> DataFrame:
    """Requests with the severity decision read from the reply."""
    decision = severity_decision(F.col("severity_reply"))
    return requests.withColumn("decision", decision).select("*", "decision.*").drop("decision")


def candidate_drugs(requests: DataFrame, query_vectors: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The nearest drugs of each request; each distinct query vector is searched once."""
    hits = cut_lineage(similar(query_vectors, catalogue, CANDIDATES))  # few rows, used twice
    named = hits.join(catalogue.select("vec_id", "item_seq", "item_name", "entp_name"), "vec_id")
    slim = requests.select("request_id", "query_id", "user_age", "is_pregnant")
    return slim.join(named, "query_id").drop("query_id", "vec_id")


def _places(requests: DataFrame, facilities: DataFrame, radius_km: float) -> DataFrame:
    """The nearest facilities of each request, at most ten, as the table has them, with rank and distance."""
    points = requests.select(F.col("request_id").alias("point_id"), "lon", "lat")
    near = nearby_facilities(points, facilities, radius_km, FACILITIES).select(
        "point_id", "facility_id", "distance_km", "rank")
    known = facilities.select("facility_id", F.struct(*facilities.columns).alias("facility"))
    place = F.struct("rank", "distance_km", "facility")
    return near.join(known, "facility_id").groupBy(F.col("point_id").alias("request_id")).agg(
        F.sort_array(F.collect_list(place)).alias("places"))


def hospital_answers(requests: DataFrame, hospitals: DataFrame) -> DataFrame:
    """Answers of the requests that must see a doctor."""
    chosen = requests.where("recommendation = 'HOSPITAL'")
    joined = chosen.join(_places(chosen, hospitals, HOSPITAL_KM), "request_id", "left")
    near = F.coalesce(F.size("places"), F.lit(0))
    return joined.select(
        "request_id", F.lit("recommendation").alias("message_type"), F.lit(0).alias("drug_count"),
        F.lit(None).cast("string").alias("first_drug"), near.alias("facilities"), "places",
        advice.hospital_message(F.col("disease_name"), F.col("severity_score"), F.col("reason"), near)
        .alias("message"))


def pharmacy_answers(requests: DataFrame, query_vectors: DataFrame, catalogue: DataFrame,
                     pregnancy: DataFrame, elderly: DataFrame, pharmacies: DataFrame) -> DataFrame:
    """Answers of the others: a question, drugs, or the reason why there are none."""
    chosen = requests.where("recommendation <> 'HOSPITAL'")
    candidates = candidate_drugs(chosen, query_vectors, catalogue)
    asked = missing_facts(candidates, pregnancy, elderly)
    safe = rank_again(safe_candidates(candidates, pregnancy, elderly), ["rank"])
    picked = select_drugs(safe, chosen.select("request_id", F.col("rank_reply").alias("reply")))
    drug = F.struct("place", "item_seq", "item_name", "entp_name")
    drugs = picked.groupBy("request_id").agg(F.sort_array(F.collect_list(drug)).alias("drugs"))
    joined = (chosen.join(asked, "request_id", "left").join(drugs, "request_id", "left")
              .join(_places(chosen, pharmacies, PHARMACY_KM), "request_id", "left"))
    near = F.coalesce(F.size("places"), F.lit(0))
    unknown = F.size("missing") > 0
    kind = (F.when(F.col("missing").isNull(), "text").when(unknown, "info_request")
            .when(F.col("drugs").isNull(), "text").otherwise("recommendation"))
    done = F.col("message_type") == "recommendation"
    text = (F.when(F.col("missing").isNull(), NONE_FOUND)
            .when(unknown, advice.info_request(F.col("missing")))
            .when(F.col("drugs").isNull(), NONE_SAFE)
            .otherwise(advice.pharmacy_message(F.col("disease_name"), F.col("drugs"), near)))
    return joined.withColumn("message_type", kind).select(
        "request_id", "message_type", F.when(done, F.size("drugs")).otherwise(0).alias("drug_count"),
        F.when(done, records.first_drug(F.col("drugs"), "item_name")).alias("first_drug"),
        F.when(done, near).otherwise(0).alias("facilities"), F.when(done, F.col("places")).alias("places"),
        F.when(done, F.col("drugs")).alias("drugs"), text.alias("message"))


def recommend(requests: DataFrame, query_vectors: DataFrame, catalogue: DataFrame, pregnancy: DataFrame,
              elderly: DataFrame, pharmacies: DataFrame, hospitals: DataFrame) -> DataFrame:
    """One answer per request, with its drugs and places as arrays; null where the answer has none."""
    ready = decided(requests)
    answers = hospital_answers(ready, hospitals).unionByName(
        pharmacy_answers(ready, query_vectors, catalogue, pregnancy, elderly, pharmacies), allowMissingColumns=True)
    slim = ready.select("request_id", "recommendation", "severity_score", "parse_ok")
    return slim.join(answers, "request_id")


def diagnosis_log(diagnoses: DataFrame, at: Column) -> DataFrame:
    """Log rows of finished diagnoses, ready to append.

    ``diagnoses(log_id, symptom_text, messages, disease, severity_score, reason,
    recommendation, drugs, pharmacies, hospitals, suspected, location)``.
    ``location`` holds latitude, longitude and, where the device told it, accuracy in metres.
    """
    drugs, place = F.col("drugs"), F.col("location")
    told = "accuracy" in diagnoses.schema["location"].dataType.names
    accuracy = F.round(place["accuracy"]) if told else F.lit(None)
    return diagnoses.select(
        "log_id", records.symptom_text(F.col("symptom_text"), F.col("messages")).alias("symptom_text"),
        F.col("disease").alias("predicted_disease"), "recommendation",
        records.first_drug(drugs, "item_name").alias("drug_suggested"),
        records.first_drug(drugs, "item_seq").alias("item_seq"),
        records.first_drug(drugs, "item_name").alias("item_name"),
        records.json_or_null(F.col("suspected")).alias("suspected_diseases"), "severity_score",
        F.col("reason").alias("llm_analysis"), records.json_or_null(drugs).alias("recommended_drugs"),
        records.json_or_null(F.col("pharmacies")).alias("nearby_pharmacies"),
        records.json_or_null(F.col("hospitals")).alias("nearby_hospitals"),
        records.coordinate_text(place["latitude"]).alias("latitude"),
        records.coordinate_text(place["longitude"]).alias("longitude"), accuracy.cast("int").alias("gps_accuracy_m"),
        at.alias("created_at"))


def answer_log(requests: DataFrame, answers: DataFrame, at: Column) -> DataFrame:
    """Log rows of the answers of ``recommend``, one per request, ready to append."""
    seen = decided(requests)
    text = F.col("symptoms") if "symptoms" in requests.columns else F.lit(None).cast("string")
    accuracy = F.col("accuracy") if "accuracy" in requests.columns else F.lit(None)
    location = F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
                        accuracy.cast("double").alias("accuracy"))
    asked = seen.select("request_id", text.alias("symptom_text"), F.col("disease_name").alias("disease"), "reason",
                        location.alias("location"))
    hospital = F.col("recommendation") == "HOSPITAL"
    none = F.array().cast("array<struct<role:string,content:string>>")
    return diagnosis_log(asked.join(answers, "request_id").select(
        F.col("request_id").alias("log_id"), "symptom_text", none.alias("messages"), "disease", "severity_score", "reason",
        "recommendation", "drugs", F.when(~hospital, F.col("places")).alias("pharmacies"),
        F.when(hospital, F.col("places")).alias("hospitals"), F.array().cast("array<string>").alias("suspected"),
        "location"), at)
