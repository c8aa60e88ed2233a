"""Disease master table from a wiki dump: ``dump(title, text, ordinal[, snapshot])``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.functions.markup import (
    SYMPTOM_TITLES, categories, clean_markup, is_disease_page, pick_section, redirect_target, sections,
)
from carelake.operators.layout import with_once
from carelake.operators.numbering import numbered_chunks
from carelake.operators.redirects import resolve_chains
from carelake.operators.upsert import newest
from carelake.session import cut_lineage

#: Aliases in one stored row.
CHUNK = 10_000


def redirect_edges(dump: DataFrame) -> DataFrame:
    """``src, tgt``: the last redirect line of a title counts."""
    found = dump.select(F.col("title").alias("src"), redirect_target(F.col("text")).alias("tgt"), "ordinal")
    return newest(found.where("tgt IS NOT NULL"), ["src"], "ordinal").drop("ordinal")


def disease_articles(dump: DataFrame) -> DataFrame:
    """Articles about diseases with their cleaned symptom section; no shuffle."""
    text = F.col("text")
    articles = dump.where(redirect_target(text).isNull())
    parsed = with_once(articles, parts=sections(text), found=categories(text))
    return (parsed.where(is_disease_page(F.col("title"), F.col("found"), F.col("parts")))
            .select("title", "ordinal",
                    F.nullif(clean_markup(pick_section(F.col("parts"), SYMPTOM_TITLES)), F.lit(""))
                    .alias("symptom_text")))


def alias_rows(resolved: DataFrame) -> DataFrame:
    """``canonical_title, alias``, one row each, whatever the number of aliases.

    A title on a cycle is an alias of its target, any other of its chain's end.
    """
    end = F.when(F.col("on_cycle"), F.col("tgt")).otherwise(F.col("canonical"))
    return resolved.select(end.alias("canonical_title"), F.col("src").alias("alias"))


def alias_chunks(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """``canonical_title, chunk, aliases``: the stored form, at most ``size`` different aliases a row, sorted and numbered on.

    Aliases are numbered over range partitions, so a title with any number of
    them spans as many tasks and rows as it needs and is never in one place.
    """
    return numbered_chunks(rows.distinct(), size, ["alias"], ["canonical_title"]).groupBy("canonical_title", "chunk").agg(
        F.sort_array(F.collect_list("alias")).alias("aliases"))


def alias_sets(chunks: DataFrame) -> DataFrame:
    """``canonical_title, aliases``: one sorted array per title, for titles whose aliases fit one row; of ``alias_chunks``."""
    return chunks.groupBy("canonical_title").agg(F.flatten(F.transform(F.sort_array(
        F.collect_list(F.struct("chunk", "aliases"))), lambda c: c["aliases"])).alias("aliases"))


def disease_titles(dump: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(titles, aliases)``: one row per canonical disease title, and its alias rows."""
    resolved = cut_lineage(resolve_chains(redirect_edges(dump)))
    canonical = resolved.select(F.col("src").alias("title"), "canonical")
    pages = disease_articles(dump).join(canonical, "title", "left").withColumn(
        "canonical_title", F.coalesce("canonical", "title"))
    shown = F.col("symptom_text").isNotNull()
    titles = pages.groupBy("canonical_title").agg(
        F.min_by(F.when(shown, F.col("symptom_text")), F.when(shown, F.col("ordinal"))).alias("symptom_text"),
        F.count(F.lit(1)).alias("source_titles_count"))
    aliases = alias_rows(resolved).join(titles.select("canonical_title"), "canonical_title", "left_semi")
    return titles, aliases


def disease_master(dump: DataFrame, provider: str, snapshot: str | None) -> tuple[DataFrame, DataFrame]:
    """``(master, chunks)``: one row per canonical title, and its aliases in chunks beside it.

    A title has a common name, which is the first alias in order, the number of
    its aliases and of their chunks, its symptoms and its sources.
    """
    titles, aliases = disease_titles(dump)
    chunks = cut_lineage(alias_chunks(aliases))
    named = chunks.groupBy("canonical_title").agg(
        F.min(F.when(F.col("chunk") == 0, F.get("aliases", F.lit(0)))).alias("common_name"),
        F.sum(F.size("aliases")).alias("alias_count"), F.count(F.lit(1)).alias("alias_chunks"))
    none = F.lit(0).cast("long")
    return titles.join(named, "canonical_title", "left").select(
        "canonical_title", "common_name", F.coalesce("alias_count", none).alias("alias_count"),
        F.coalesce("alias_chunks", none).alias("alias_chunks"),
        F.coalesce("symptom_text", F.lit("")).alias("symptom_text"), "source_titles_count",
        F.lit(provider).alias("source_provider"), F.lit(snapshot).alias("source_snapshot")), chunks


def title_keys(*parts: DataFrame) -> DataFrame:
    """All titles known to any part, each once, in order."""
    keys = parts[0].select("canonical_title")
    for part in parts[1:]:
        keys = keys.union(part.select("canonical_title"))
    return keys.distinct().orderBy("canonical_title")
