"""Safety rules on candidate drugs and on prescriptions.

``candidates`` carry ``request_id, item_seq, user_age, is_pregnant`` (plus
anything else); rule tables carry ``item_seq`` and their texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ELDERLY_AGE = 65


def _at_risk() -> tuple[Column, Column]:
    """Unknown facts never exclude a drug here; ``missing_facts`` asks for them first."""
    pregnant = F.coalesce(F.col("is_pregnant"), F.lit(False))
    elderly = F.coalesce(F.col("user_age") >= ELDERLY_AGE, F.lit(False))
    return pregnant, elderly


def rule_flags(pregnancy: DataFrame, elderly: DataFrame) -> DataFrame:
    """One row per ruled drug. Many rules on one drug collapse before the shuffle."""
    tagged = (pregnancy.select("item_seq", F.lit(True).alias("p"), F.lit(False).alias("e"))
              .unionByName(elderly.select("item_seq", F.lit(False).alias("p"), F.lit(True).alias("e"))))
    return tagged.groupBy("item_seq").agg(F.bool_or("p").alias("pregnancy_rule"),
                                          F.bool_or("e").alias("elderly_rule"))


def flagged(candidates: DataFrame, pregnancy: DataFrame, elderly: DataFrame) -> DataFrame:
    """Candidates with both rule flags: a single join serves every check."""
    joined = candidates.join(rule_flags(pregnancy, elderly), "item_seq", "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(False))
                               for c in ("pregnancy_rule", "elderly_rule")})


def safe_candidates(candidates: DataFrame, pregnancy: DataFrame, elderly: DataFrame) -> DataFrame:
    """Drop drugs with a pregnancy rule for the pregnant and an elderly rule from 65 on."""
    pregnant, old = _at_risk()
    kept = flagged(candidates, pregnancy, elderly).where(
        ~((pregnant & F.col("pregnancy_rule")) | (old & F.col("elderly_rule"))))
    return kept.drop("pregnancy_rule", "elderly_rule")


def warning_rows(candidates: DataFrame, pregnancy: DataFrame, elderly: DataFrame) -> DataFrame:
    """One row per warning that applies: the whole list, however long."""
    pregnant, old = _at_risk()

    def matched(rules, applies, kind):
        texts = rules.select("item_seq", "type_name", "prohbt_content")
        return (candidates.where(applies).join(texts, "item_seq")
                .select("request_id", "item_seq", F.lit(kind).alias("kind"), "type_name",
                        "prohbt_content"))
    return matched(pregnancy, pregnant, "pregnancy").unionByName(matched(elderly, old, "elderly"))


def warning_counts(candidates: DataFrame, pregnancy: DataFrame, elderly: DataFrame) -> DataFrame:
    """Every candidate with its number of warnings by kind.

    The rules are counted per drug first, so no warning is multiplied out.
    """
    pregnant, old = _at_risk()

    def per_drug(rules, name):
        return rules.groupBy("item_seq").agg(F.count(F.lit(1)).alias(name))
    joined = (candidates.join(per_drug(pregnancy, "np"), "item_seq", "left")
              .join(per_drug(elderly, "ne"), "item_seq", "left"))
    counted = joined.withColumns({
        "pregnancy_warnings": F.when(pregnant, F.coalesce("np", F.lit(0))).otherwise(0),
        "elderly_warnings": F.when(old, F.coalesce("ne", F.lit(0))).otherwise(0)}).drop("np", "ne")
    return counted.withColumn(
        "has_warnings", F.col("pregnancy_warnings") + F.col("elderly_warnings") > 0)


def missing_facts(candidates: DataFrame, pregnancy: DataFrame, elderly: DataFrame) -> DataFrame:
    """Per request, the facts its candidates need and the user has not given."""
    need_age = F.col("elderly_rule") & F.col("user_age").isNull()
    need_pregnancy = F.col("pregnancy_rule") & F.col("is_pregnant").isNull()
    per_request = flagged(candidates, pregnancy, elderly).groupBy("request_id").agg(
        F.bool_or(need_age).alias("a"), F.bool_or(need_pregnancy).alias("p"))
    missing = F.array_compact(F.array(F.when(F.col("a"), "age"), F.when(F.col("p"), "pregnancy")))
    return per_request.select("request_id", missing.alias("missing"),
                              (F.size(missing) == 0).alias("all_info_provided"))


def pair_interactions(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """Forbidden pairs inside one prescription, each once, smaller item first.

    The lines of a pair's rarer item look for the other item in their own
    prescription. Only forbidden pairs are formed, never all pairs of a
    prescription, and an item in a third of all lines is only ever looked up.
    """
    taken = lines.select("rx_id", "item_seq").distinct()
    forbidden = pairs.select(
        F.least("item_seq", "mixture_item_seq").alias("a"),
        F.greatest("item_seq", "mixture_item_seq").alias("b")).where("a <> b").distinct()
    uses = taken.groupBy("item_seq").agg(F.count(F.lit(1)).alias("n"))
    counted = (forbidden.join(uses.select(F.col("item_seq").alias("a"), F.col("n").alias("na")), "a")
               .join(uses.select(F.col("item_seq").alias("b"), F.col("n").alias("nb")), "b"))
    rare = F.col("na") <= F.col("nb")
    asked = counted.select("a", "b", F.when(rare, F.col("a")).otherwise(F.col("b")).alias("item_seq"),
                           F.when(rare, F.col("b")).otherwise(F.col("a")).alias("other"))
    others = taken.withColumnRenamed("item_seq", "other")
    return (taken.join(asked, "item_seq").join(others, ["rx_id", "other"], "left_semi")
            .select("rx_id", F.col("a").alias("item_seq"), F.col("b").alias("mixture_item_seq")))


def rule_hits(lines: DataFrame, rules: dict[str, DataFrame]) -> DataFrame:
    """Age, dose, duration and split rules that touch a prescription line: one join for all."""
    tagged = reduce(DataFrame.unionByName, [
        r.select("item_seq", F.lit(kind).alias("kind"), "prohbt_content") for kind, r in rules.items()])
    return lines.select("rx_id", "item_seq").distinct().join(tagged, "item_seq")


def therapeutic_duplication(lines: DataFrame, effects: DataFrame) -> DataFrame:
    """Effect groups with two or more different drugs in one prescription."""
    return (lines.select("rx_id", "item_seq").distinct()
            .join(effects.select("item_seq", "effect_name").distinct(), "item_seq")
            .groupBy("rx_id", "effect_name").agg(F.count(F.lit(1)).alias("item_count"))
            .where("item_count >= 2"))
