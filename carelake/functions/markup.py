"""Wiki markup: redirects, sections, cleaning, categories, page classifier.

Patterns are matched by the JVM. ``m`` line mode, ``d`` only ``\\n`` ends a
line, ``U`` Unicode classes, ``i`` any case, ``s`` dot matches line ends.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from carelake.functions.text import squash, strip

# Markup patterns.
REDIRECT = r"(?imdU)^\s*#\s*(?:redirect|넘겨주기)\s*(?:\[\[)?\s*([^\]\n#]+?)\s*(?:\]\])?\s*$"
HEADING = r"(?mdU)^(=+)\s*(.+?)\s*\1\s*$"
CATEGORY = r"(?iU)\[\[\s*(?:분류|category)\s*:\s*([^\]]+)\]\]"
TITLE_HINT = r"(?:질환|병|증후군|염|암|증)\n?$"
SNAPSHOT = r"(\d{8}|\d{6})"

# Cleaning steps, in the order they apply.
CLEANING = [
    (r"(?isU)<ref[^>]*>.*?</ref>", ""),
    (r"(?s)\{\{\{.*?\}\}\}", ""),
    (r"(?s)\{\{.*?\}\}", ""),
    (r"\[\[([^|\]]+)\|([^\]]+)\]\]", "$2"),
    (r"\[\[([^\]]+)\]\]", "$1"),
    (r"(?U)\[(?:https?|ftp)://[^\s\]]+\s+([^\]]+)\]", "$1"),
    (r"''+", ""),
    (r"(?mdU)^\s*\[\[(?:분류|분류:).*\]\]\s*$", ""),
]

# Section titles and category words.
SYMPTOM_TITLES = ["증상", "임상 증상", "임상증상", "주요 증상", "증후", "임상 소견", "종류 및 증상"]
CAUSE_TITLES = ["원인", "병인", "병태생리", "병태 생리"]
TREATMENT_TITLES = ["치료", "치료법", "치료 방법", "예후", "관리", "치료와 관리"]
DISEASE_CATEGORIES = [
    "질병", "감염병", "전염병", "증후군", "의학", "의학 용어", "의학적 상태", "정신 질환",
    "희귀질환", "암", "종양", "면역질환", "자가면역질환", "질환", "장애", "염증",
]
OTHER_CATEGORIES = [
    "인물", "영화", "음악", "게임", "애니메이션", "웹툰", "기업", "회사", "지명", "국가",
    "역사", "스포츠", "정치", "군사", "소프트웨어", "프로그래밍",
]


def _keys(words: list[str]) -> list[str]:
    return sorted({"".join(w.split()).lower() for w in words})


def redirect_target(text: Column) -> Column:
    """Target of the first redirect line, null when the page is an article."""
    return F.nullif(strip(F.regexp_extract(text, REDIRECT, 1)), F.lit(""))


def sections(text: Column) -> Column:
    """``array<struct<level,title,body>>`` in page order.

    A body runs to the next heading of any level. Splitting the text at the
    headings gives one piece more than there are headings, so heading ``i``
    owns piece ``i + 1``: no explode and no shuffle.
    """
    marks = F.regexp_extract_all(text, F.lit(HEADING), F.lit(1))
    titles = F.regexp_extract_all(text, F.lit(HEADING), F.lit(2))
    bodies = F.split(text, HEADING, -1)
    return F.transform(
        titles, lambda title, i: F.struct(
            F.length(F.get(marks, i)).alias("level"), strip(title).alias("title"),
            F.get(bodies, i + 1).alias("body")))


def pick_section(parts: Column, titles: list[str]) -> Column:
    """Body of the first section whose title is one of ``titles``."""
    return F.get(F.filter(parts, lambda s: squash(s["title"]).isin(*_keys(titles))), F.lit(0))["body"]


def clean_markup(text: Column) -> Column:
    for pattern, keep in CLEANING:
        text = F.regexp_replace(text, pattern, keep)
    text = F.translate(text, "\t\r", " ")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def categories(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(CATEGORY), F.lit(1)), strip)


def any_category(found: Column, words: list[str]) -> Column:
    """True when any category contains any of the words."""
    return F.exists(found, lambda c: F.array_contains(
        F.transform(F.array(*[F.lit(k) for k in _keys(words)]),
                    lambda k: F.contains(squash(c), k)), True))


def is_disease_page(title: Column, found: Column, parts: Column) -> Column:
    """Disease category without an excluded one, or symptoms plus a second hint."""
    by_category = any_category(found, DISEASE_CATEGORIES) & ~any_category(found, OTHER_CATEGORIES)
    symptoms = pick_section(parts, SYMPTOM_TITLES).isNotNull()
    context = (pick_section(parts, CAUSE_TITLES).isNotNull()
               | pick_section(parts, TREATMENT_TITLES).isNotNull())
    return by_category | (symptoms & (context | title.rlike(TITLE_HINT)))


def snapshot_tag(path: Column) -> Column:
    """Snapshot date in a dump's name: eight digits, or six with the century added.

    A dump that is a folder of part files is named by its folder.
    """
    steps = F.split(path, "/")
    name = F.when(F.element_at(steps, -1).startswith("part-"), F.try_element_at(steps, F.lit(-2))) \
        .otherwise(F.element_at(steps, -1))
    found = F.regexp_extract(name, SNAPSHOT, 1)
    return F.when(F.length(found) == 6, F.concat(F.lit("20"), found)).otherwise(
        F.nullif(found, F.lit("")))
