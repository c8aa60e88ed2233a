"""Advice texts and triage bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from carelake.functions.text import default_if_empty, first_non_empty, strip

# Wording.
UNKNOWN = "정보 없음"
AGE_QUESTION = "나이"
PREGNANCY_QUESTION = "임신 여부 (임신 중이신가요?)"
PHARMACIST_NOTE = "💊 약품 구매 전 약사와 상담을 권장합니다."
EMERGENCY_NOTE = "🚨 **즉시 119에 전화하거나 가까운 응급실을 방문하세요!**\n\n"
SEVERE_NOTE = "🏥 일반의약품으로는 치료가 어렵습니다. 병원을 방문하세요.\n\n"
MODERATE_NOTE = "💊 약국에서 약을 구매하되, 증상이 지속되면 병원을 방문하세요.\n\n"

# Labels of the drug document.
DOCUMENT_LABELS = {"item_name": "약품명", "entp_name": "제조사", "material_name": "성분",
                   "class_no": "분류", "ee_doc_id": "효능"}


def triage_band(score: Column) -> Column:
    return (F.when(score <= 5, "PHARMACY").when(score <= 7, "PHARMACY_AND_VISIT")
            .otherwise("HOSPITAL"))


def message_tone(score: Column) -> Column:
    return F.when(score >= 9, "EMERGENCY").when(score >= 8, "SEVERE").otherwise("MODERATE")


def drug_document(drug: dict[str, Column]) -> Column:
    """Search text of one drug: five labelled lines, nulls blank, efficacy with a default."""
    lines = []
    for name, label in DOCUMENT_LABELS.items():
        blank = UNKNOWN if name == "ee_doc_id" else ""
        lines.append(F.concat(F.lit(f"{label}: "), default_if_empty(drug[name], blank)))
    return strip(F.concat_ws("\n", *lines))


def query_text(symptoms: Column, separator: str = " ") -> Column:
    return F.array_join(symptoms, separator)


def age_label(age: Column) -> Column:
    return F.when(age.isNull(), UNKNOWN).otherwise(F.concat(age.cast("string"), F.lit("세")))


def pregnancy_label(pregnant: Column) -> Column:
    return F.when(pregnant.isNull(), UNKNOWN).when(pregnant, "예").otherwise("아니오")


def metadata_default(value: Column) -> Column:
    return F.coalesce(first_non_empty(value), F.lit(""))


def info_request(missing: Column) -> Column:
    """Question for the missing facts: one sentence for one fact, a list for more."""
    asked = F.transform(missing, lambda m: F.when(m == "age", AGE_QUESTION)
                        .otherwise(PREGNANCY_QUESTION))
    one = F.concat(F.lit("안전한 약품 추천을 위해 "), F.get(asked, F.lit(0)), F.lit("를 알려주시겠어요?"))
    many = F.concat(F.lit("안전한 약품 추천을 위해 다음 정보를 알려주세요:\n\n"),
                    F.array_join(F.transform(asked, lambda q: F.concat(F.lit("• "), q)), "\n"))
    return F.when(F.size(missing) == 0, F.lit(None)).when(F.size(missing) == 1, one).otherwise(many)


def pharmacy_message(disease: Column, drugs: Column, pharmacies: Column) -> Column:
    """``drugs`` is ``array<struct<item_name,entp_name>>``; ``pharmacies`` a count. A null name is a blank, not a lost line."""
    lines = F.transform(drugs, lambda d, i: F.concat(
        (i + 1).cast("string"), F.lit(". "), metadata_default(d["item_name"]), F.lit(" ("),
        metadata_default(d["entp_name"]), F.lit(")\n")))
    listed = F.when(F.size(drugs) > 0, F.concat(F.array_join(lines, ""), F.lit("\n"))).otherwise("")
    near = F.when(pharmacies > 0, F.concat(F.lit("가까운 약국 "), pharmacies.cast("string"),
                                           F.lit("곳을 확인하세요.\n\n"))).otherwise("")
    return F.concat(F.lit("**"), metadata_default(disease), F.lit("** 추천 약품:\n\n"), listed, near,
                    F.lit(PHARMACIST_NOTE))


def hospital_message(disease: Column, score: Column, reason: Column, hospitals: Column) -> Column:
    def text(head, tail, suffix, note):
        return F.concat(F.lit(head), metadata_default(disease), F.lit(tail), F.lit("심각도: "), score.cast("string"),
                        F.lit(f"/10점{suffix}\n사유: "), metadata_default(reason), F.lit("\n\n" + note))
    body = (F.when(score >= 9, text("⚠️ **", "**은 응급 상황입니다!\n\n", " (응급)", EMERGENCY_NOTE))
            .when(score >= 8, text("⚠️ **", "**은 병원 진료가 필요합니다.\n\n", "", SEVERE_NOTE))
            .otherwise(text("**", "** 증상 확인이 필요합니다.\n\n", "", MODERATE_NOTE)))
    near = F.when(hospitals > 0, F.concat(F.lit("📍 가까운 병원 "), hospitals.cast("string"),
                                          F.lit("곳을 확인하세요."))).otherwise("")
    return F.concat(body, near)
