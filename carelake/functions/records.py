"""Building stored records from nested columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from carelake.functions.text import non_empty

SYMPTOM_TEXT_CHARS = 1000  # width of the stored column


def party(id_: Column, name: Column, email: Column) -> Column:
    """The person as a struct, null when no name is known."""
    return F.when(non_empty(name).isNotNull(),
                  F.struct(id_.alias("id"), name.alias("name"), email.alias("email")))


def json_or_null(items: Column) -> Column:
    """JSON text of a non-empty array, else null."""
    return F.when(F.size(items) > 0, F.to_json(items))


def symptom_text(given: Column, messages: Column) -> Column:
    """The given text, else all user messages joined, cut to the stored width."""
    spoken = F.array_join(
        F.transform(F.filter(messages, lambda m: m["role"] == "user"), lambda m: m["content"]), " ")
    return F.substring(F.coalesce(non_empty(given), non_empty(spoken)), 1, SYMPTOM_TEXT_CHARS)


def first_drug(drugs: Column, field: str) -> Column:
    return F.try_element_at(drugs, F.lit(1))[field]


def coordinate_text(value: Column) -> Column:
    """Stored as text; zero is a position like any other."""
    return value.cast("string")
