"""Reading model replies that arrive as a text column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from carelake.functions.text import strip

# The decision taken when a reply cannot be read.
DEFAULT_SCORE = 4
DEFAULT_RECOMMENDATION = "PHARMACY"
DEFAULT_REASON = "일반적인 증상으로 판단됩니다. 증상이 심해지면 병원을 방문하세요."

SHOWN, CHOSEN = 10, 3


def reply_body(reply: Column) -> Column:
    """The reply without a surrounding code fence and its ``json`` tag."""
    text = strip(reply)
    fenced = F.get(F.split(text, "```", -1), F.lit(1))
    untagged = F.when(fenced.startswith("json"), strip(F.substr(fenced, F.lit(5)))).otherwise(fenced)
    return F.when(text.startswith("```"), untagged).otherwise(text)


def severity_decision(reply: Column) -> Column:
    """``struct<severity_score,recommendation,reason,parse_ok>``; the mild default on failure."""
    parsed = F.try_parse_json(reply_body(reply))
    score = F.try_variant_get(parsed, "$.severity_score", "int")
    choice = F.try_variant_get(parsed, "$.recommendation", "string")
    ok = score.isNotNull() & choice.isNotNull()
    return F.struct(
        F.when(ok, score).otherwise(DEFAULT_SCORE).alias("severity_score"),
        F.when(ok, choice).otherwise(DEFAULT_RECOMMENDATION).alias("recommendation"),
        F.coalesce(F.when(ok, F.try_variant_get(parsed, "$.reason", "string")), F.lit(DEFAULT_REASON)).alias("reason"),
        ok.alias("parse_ok"))


def info_answer(reply: Column) -> Column:
    """``struct<age,is_pregnant,success>`` read from the reply; success false when unreadable."""
    parsed = F.try_parse_json(reply)
    return F.struct(
        F.try_variant_get(parsed, "$.age", "int").alias("age"),
        F.try_variant_get(parsed, "$.is_pregnant", "boolean").alias("is_pregnant"),
        F.coalesce(F.try_variant_get(parsed, "$.success", "boolean"), F.lit(False)).alias("success"))


DISEASES = "array<struct<id:string,name:string,confidence:double,symptoms:array<string>>>"


def disease_options(reply: Column) -> Column:
    """Suspected diseases of a reply with confidences between 0 and 1; null when unreadable."""
    found = F.try_variant_get(F.try_parse_json(reply_body(reply)), "$.diseases", DISEASES)
    return rescale_confidence(found)


def rescale_confidence(diseases: Column) -> Column:
    """A confidence above 1 is a percentage."""
    def fixed(d):
        return d.withField("confidence", F.when(d["confidence"] > 1, d["confidence"] / 100.0)
                           .otherwise(d["confidence"]))
    return F.transform(diseases, fixed)


def pick_by_id(items: Column, wanted: Column) -> Column:
    """First struct of the array whose ``id`` is the wanted one."""
    return F.get(F.filter(items, lambda d: d["id"] == wanted), F.lit(0))


def chosen_ranks(reply: Column, shown: Column) -> Column:
    """Up to three 1-based ranks named in the reply; the first three when none is usable."""
    named = F.slice(F.from_json(reply, "array<int>"), 1, CHOSEN)
    limit = F.least(F.lit(SHOWN), shown)
    usable = F.filter(named, lambda r: (r >= 1) & (r <= limit))
    broken = F.coalesce(F.exists(named, lambda r: r.isNull()), F.lit(True))
    first = F.when(shown > 0, F.sequence(F.lit(1), F.least(F.lit(CHOSEN), shown).cast("int"))) \
        .otherwise(F.array().cast("array<int>"))
    return F.when(broken | (F.size(usable) == 0), first).otherwise(usable)
