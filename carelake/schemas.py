"""Tables, columns, keys and compared columns.

Fixed values: column names in table order. ``int:``, ``long:``, ``double:``
and ``ts:`` give the type of a column; the others are text.
"""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"int": T.IntegerType(), "long": T.LongType(), "ts": T.TimestampType(),
          "d7": T.DecimalType(10, 7), "d13": T.DecimalType(16, 13), "d3": T.DecimalType(10, 3),
          "byte": T.ByteType()}

PLACE = "cl_cd cl_cd_nm sido_cd sido_cd_nm sggu_cd sggu_cd_nm"
STAMPS = "ts:created_at ts:updated_at"
STAFF = ("dr_tot_cnt mdept_gdr_cnt mdept_intn_cnt mdept_resdnt_cnt mdept_sdr_cnt dety_gdr_cnt "
         "dety_intn_cnt dety_resdnt_cnt dety_sdr_cnt cmdc_gdr_cnt cmdc_intn_cnt cmdc_resdnt_cnt "
         "cmdc_sdr_cnt pnurs_cnt")
_STAFF = " ".join(f"int:{c}" for c in STAFF.split())
_TIMES = " ".join(f"duty_time{day}{edge}" for day in range(1, 9) for edge in "sc")
_KIOSK = " ".join(f"m_kiosk_ty{n}" for n in (25, *range(1, 12)))
_BEDS = " ".join(f"int:{c}" for c in "hpbdn hpccuyn hpcuyn hperyn hpgryn hpicuyn hpnicuyn hpopyn".split())


def _centre(trauma_column: str) -> str:
    rooms = " ".join(f"int:{c}" for c in f"hvec hvoc hvcc hvncc hvccc hvicc {trauma_column}".split())
    return (f"hpid duty_name duty_addr duty_tel1 duty_tel3 post_cdn1 post_cdn2 d7:wgs84_lon d7:wgs84_lat "
            f"duty_inf duty_mapimg byte:duty_eryn byte:duty_hayn int:duty_hano {rooms} {_TIMES} {_KIOSK} "
            f"dgid_id_name {_BEDS} hira_ykiho {STAMPS}")


_INGREDIENT = "long:dur_seq type_name mix_type ingr_code ingr_eng_name ingr_name mix_ingr ori_ingr"
_NOTICE = "notification_date prohbt_content remark"
_ITEM_RULE = ("item_seq type_name mix_type ingr_code ingr_eng_name ingr_name mix_ingr form_name item_name "
              "item_permit_date entp_name chart class_code class_name etc_otc_name main_ingr "
              f"{_NOTICE} ingr_eng_name_full change_date {STAMPS}")

COLUMNS = {
    "hospital": f"ykiho yadm_nm telno hosp_url {PLACE} addr emdong_nm post_no d7:x_pos d7:y_pos {_STAFF} "
                f"estb_dd d3:distance {STAMPS}",
    "pharmacy": f"ykiho yadm_nm {PLACE} emdong_nm post_no addr telno estb_dd d13:x_pos d13:y_pos {STAMPS}",
    "emergency": _centre("hvgc"),
    "trauma": _centre("h_vgc"),
    "dur_mix_contraindication":
        "type_name mix_type ingr_code ingr_eng_name ingr_kor_name mix ori class mixture_mix_type "
        "mixture_ingr_code mixture_ingr_eng_name mixture_ingr_kor_name mixture_mix mixture_ori "
        f"mixture_class {_NOTICE} del_yn {STAMPS}",
    "dur_pregnancy_contraindication": f"{_INGREDIENT} class_name form_name grade {_NOTICE} del_yn {STAMPS}",
    "dur_dose_caution": f"{_INGREDIENT} class_name form_name max_qty {_NOTICE} del_yn {STAMPS}",
    "dur_duration_caution": f"{_INGREDIENT} class_name form_name max_dosage_term {_NOTICE} del_yn {STAMPS}",
    "dur_elderly_caution": f"{_INGREDIENT} form_name {_NOTICE} del_yn {STAMPS}",
    "dur_age_contraindication": f"{_INGREDIENT} class_name form_name {_NOTICE} del_yn age_base {STAMPS}",
    "dur_therapeutic_duplication": f"{_INGREDIENT} class_name effect_code {_NOTICE} sers_name {STAMPS}",
    "item_dur_info":
        "item_seq item_name entp_name item_permit_date etc_otc_code class_no chart bar_code material_name "
        "ee_doc_id ud_doc_id nb_doc_id insert_file storage_method valid_term reexam_target reexam_date "
        f"pack_unit edi_code cancel_date cancel_name type_code type_name change_date bizrno {STAMPS}",
    "item_mix_contraindication":
        "long:dur_seq type_code type_name mix ingr_code ingr_kor_name ingr_eng_name mix_ingr item_seq "
        "item_name entp_name chart form_code etc_otc_code class_code form_name etc_otc_name class_name "
        "main_ingr long:mixture_dur_seq mixture_mix mixture_ingr_code mixture_ingr_kor_name "
        "mixture_ingr_eng_name mixture_item_seq mixture_item_name mixture_entp_name mixture_form_code "
        "mixture_etc_otc_code mixture_class_code mixture_form_name mixture_etc_otc_name mixture_class_name "
        f"mixture_main_ingr {_NOTICE} item_permit_date mixture_item_permit_date mixture_chart change_date "
        f"mixture_change_date bizrno {STAMPS}",
    "item_elderly_caution": _ITEM_RULE,
    "item_age_contraindication": _ITEM_RULE,
    "item_dose_caution": _ITEM_RULE,
    "item_duration_caution": _ITEM_RULE,
    "item_therapeutic_duplication":
        "long:dur_seq effect_name type_name ingr_code ingr_name ingr_eng_name form_code_name mix mix_ingr "
        "item_seq item_name item_permit_date chart entp_name form_code form_name etc_otc_code etc_otc_name "
        f"class_code class_name main_ingr {_NOTICE} ingr_eng_name_full change_date bizrno sers_name {STAMPS}",
    "item_sustained_release_split_caution":
        "item_seq type_name item_name item_permit_date form_code_name entp_name chart class_code class_name "
        f"etc_otc_name mix main_ingr prohbt_content remark change_date bizrno {STAMPS}",
    "item_pregnancy_contraindication": _ITEM_RULE,
    "symptom_logs":
        "long:log_id symptom_text sub_symptoms predicted_disease recommendation drug_suggested item_seq "
        "item_name dur_flags region_label longitude latitude int:gps_accuracy_m ts:created_at medical_terms "
        "suspected_diseases llm_analysis int:severity_score recommended_drugs nearby_pharmacies nearby_hospitals",
    "disease_master":
        "canonical_title common_name long:alias_count symptom_text long:source_titles_count "
        "source_provider source_snapshot",
    "users": "long:id name email password role ts:created_at ts:updated_at",
    "assessments":
        "long:id title description type status questionnaire responses results doctor_notes "
        "long:patient_id long:doctor_id ts:created_at ts:updated_at",
}

KEYS = {
    "hospital": ["ykiho"], "pharmacy": ["ykiho"], "emergency": ["hpid"], "trauma": ["hpid"],
    "dur_mix_contraindication": ["ingr_code", "mixture_ingr_code"],
    "item_mix_contraindication": ["dur_seq", "item_seq", "mixture_item_seq"],
    "item_therapeutic_duplication": ["dur_seq"],
    "users": ["id"], "assessments": ["id"], "symptom_logs": ["log_id"],
    "disease_master": ["canonical_title"],
}
KEYS |= {t: ["dur_seq"] for t in COLUMNS if t.startswith("dur_") and t not in KEYS}
KEYS |= {t: ["item_seq"] for t in COLUMNS if t.startswith("item_") and t not in KEYS}

# Tables that are overwritten by key, without comparing.
UPSERTED = [t for t in COLUMNS if t.startswith(("dur_", "item_"))]

COMPARED = {
    "hospital": f"yadm_nm telno hosp_url {PLACE} addr emdong_nm post_no x_pos y_pos {STAFF} estb_dd".split(),
    "pharmacy": f"yadm_nm {PLACE} emdong_nm post_no addr telno estb_dd x_pos y_pos".split(),
    "emergency": "duty_name duty_addr duty_tel1 wgs84_lon wgs84_lat".split(),
    "trauma": "duty_name duty_addr duty_tel1 wgs84_lon wgs84_lat".split(),
}

# What a column may hold. ``functions.checks`` makes one expression of them; every write goes through it.
ALLOWED = {("symptom_logs", "recommendation"): ("PHARMACY", "HOSPITAL")}
ALLOWED |= {(t, c): ("Y", "N") for t in ("emergency", "trauma") for c in _KIOSK.split()}
RANGES = {("people", "user_age"): (0, 150), ("options", "confidence"): (0.0, 1.0)}
LENGTHS = {("messages", "content"): (1, 1000)}


def column_names(table: str) -> list[str]:
    return [c.split(":")[-1] for c in COLUMNS[table].split()]


def schema(table: str) -> T.StructType:
    fields = []
    for entry in COLUMNS[table].split():
        kind, _, name = entry.rpartition(":")
        fields.append(T.StructField(name, _TYPES.get(kind, T.StringType()), name not in KEYS[table]))
    return T.StructType(fields)
