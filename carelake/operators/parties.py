"""Assessments with the people they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.functions.records import party


def with_parties(assessments: DataFrame, users: DataFrame) -> DataFrame:
    """Left joins to patient and doctor; unknown people stay null.

    No join hint: the optimizer broadcasts the people only when they are
    small, and otherwise splits a patient or doctor that owns very many rows.
    """
    def side(role):
        return users.select(F.col("id").alias(f"{role}_id"), F.col("name").alias(f"{role}_name"),
                            F.col("email").alias(f"{role}_email"))
    joined = (assessments.join(side("patient"), "patient_id", "left")
              .join(side("doctor"), "doctor_id", "left"))
    for role in ("patient", "doctor"):
        joined = joined.withColumn(role, party(
            F.col(f"{role}_id"), F.col(f"{role}_name"), F.col(f"{role}_email")))
    return joined.drop("patient_name", "patient_email", "doctor_name", "doctor_email")


def newest_first(assessments: DataFrame) -> DataFrame:
    return assessments.orderBy(F.desc("created_at"), F.asc("id"))


def of_person(assessments: DataFrame, role: str, person_id) -> DataFrame:
    """Assessments of one patient or one doctor, newest first."""
    return newest_first(assessments.where(F.col(f"{role}_id") == F.lit(person_id)))


def with_parent(centres: DataFrame, hospitals: DataFrame, key: str = "hira_ykiho") -> DataFrame:
    """Centre with its hospital; a missing parent gives nulls and ``parent_found`` false."""
    parents = hospitals.select(F.col("ykiho").alias(key), F.col("yadm_nm").alias("hospital_name"),
                               F.lit(True).alias("parent_found"))
    return (centres.join(parents, key, "left")
            .withColumn("parent_found", F.coalesce("parent_found", F.lit(False))))
