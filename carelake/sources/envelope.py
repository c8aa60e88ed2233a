"""Landed feed pages: ``pages(source, page_no, payload[, batch_size])``.

A payload is the raw response text. It is parsed as VARIANT by the JVM, one of
the known envelope shapes is recognised, and its items become rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.functions.text import camel_key
from carelake.operators.layout import with_once
from carelake.session import cut_lineage, staged

# Markers of an error page.
ERROR_TAG = "<OpenAPI_ServiceResponse>"
QUOTA_TEXT = "LIMITED_NUMBER_OF_SERVICE_REQUESTS_EXCEEDS_ERROR"
SERVICE_TEXT = "SERVICE ERROR"

LIST = "array<variant>"
NUMERIC_KEY = r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)?\s*$"


def _at(node: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(node, path, kind)


def _given(node: Column, path: str) -> Column:
    """Present and neither null, false, zero nor empty text."""
    found = _at(node, path)
    text = found.cast("string")
    scalar = F.schema_of_variant(found).rlike("^(STRING|BIGINT|BOOLEAN|DOUBLE|DECIMAL)")
    return F.coalesce(found.isNotNull() & ~F.is_variant_null(found)
                      & ~(scalar & text.isin("", "0", "false")), F.lit(False))


def _many(node: Column, path: str) -> Column:
    """The array at ``path``, or the one value there as an array."""
    one = _at(node, path)
    return F.coalesce(_at(node, path, LIST), F.array(one))


def _number(node: Column, path: str, default: int) -> Column:
    value = _at(node, path, "bigint")
    return F.coalesce(F.nullif(value, F.lit(0)), F.lit(default)).cast("bigint")


def normalise(pages: DataFrame) -> DataFrame:
    """Adds ``shape, error, items, total_count, page_in_body, rows_in_body, item_count``."""
    body = F.col("node")
    keys = F.map_keys(_at(body, "$", "map<string,variant>"))
    numeric = (F.size(keys) > 0) & F.forall(keys, lambda k: k.rlike(NUMERIC_KEY))
    # Only a payload that is no JSON can be an error page; a readable one may well hold the tag as text.
    error_page = body.isNull() & F.contains("payload", F.lit(ERROR_TAG))
    shape = (F.when(error_page, "xml_error")
             .when(body.isNull(), "unreadable")
             .when(_at(body, "$", LIST).isNotNull(), "array")
             .when(F.coalesce(numeric, F.lit(False)), "numeric_keys")
             .when(_given(body, "$.header"),
                   F.when(_given(body, "$.body"), "header").otherwise("unsupported"))
             .when(_given(body, "$.response"),
                   F.when(_given(body, "$.response.body"), "response").otherwise("unsupported"))
             .when(_given(body, "$.body.items"), "body")
             .otherwise("unsupported"))
    reason = (F.when(F.contains("payload", F.lit(QUOTA_TEXT)), "quota")
              .when(F.contains("payload", F.lit(SERVICE_TEXT)), "service").otherwise("xml"))
    error = F.when(F.col("shape") == "xml_error", reason).when(
        F.col("shape").isin("unreadable", "unsupported"), F.col("shape"))

    in_body = (F.when(~_given(body, "$.body.items"), F.array().cast(LIST))
               .when(_at(body, "$.body.items", LIST).isNotNull(), _at(body, "$.body.items", LIST))
               .when(_given(body, "$.body.items.item"), _many(body, "$.body.items.item"))
               .otherwise(F.array(_at(body, "$.body.items"))))
    in_response = F.when(_given(body, "$.response.body.items.item"),
                         _many(body, "$.response.body.items.item")).otherwise(F.array().cast(LIST))
    by_key = _at(body, "$", "map<string,variant>")
    in_order = F.transform(
        F.array_sort(F.transform(F.map_keys(by_key), lambda k: F.struct(
            k.try_cast("double").alias("n"), k.alias("k")))), lambda s: by_key[s["k"]])
    items = (F.when(F.col("shape") == "array", _at(body, "$", LIST))
             .when(F.col("shape") == "numeric_keys", in_order)
             .when(F.col("shape") == "response", in_response)
             .when(F.col("shape").isin("header", "body"), in_body)
             .otherwise(F.array().cast(LIST)))
    size = F.size("items").cast("bigint")

    def counted(path, bare, default):
        plain = F.col("shape").isin("array", "numeric_keys")
        return (F.when(plain, bare).when(F.col("shape") == "response",
                                         _number(body, f"$.response.body.{path}", default))
                .when(F.col("error").isNull(), _number(body, f"$.body.{path}", default)))
    parsed = with_once(pages, node=F.try_parse_json("payload"))
    shaped = with_once(parsed, shape=shape).withColumn("error", error)
    return with_once(shaped, items=items).withColumns({
        "item_count": size, "total_count": counted("totalCount", size, 0),
        "page_in_body": counted("pageNo", F.lit(1).cast("bigint"), 1),
        "rows_in_body": counted("numOfRows", size, 1)}).drop("node")


def quarantine(normalised: DataFrame) -> DataFrame:
    """Pages that hold no rows because they could not be read, with the reason."""
    return normalised.where(F.col("error").isNotNull()).select("source", "page_no", "shape", "error")


#: What the stop rule needs to know of a page.
PAGE = ("batch_size", "item_count", "total_count", "error")


def item_rows(normalised: DataFrame, unwrap: bool = False, pages: bool = False) -> DataFrame:
    """One row per item, with its place; ``unwrap`` opens one more ``item`` level.

    With ``pages`` each row also tells of its page, and a page without items
    has one row whose ``item_no`` is null.
    """
    landed = ["landed"] if "landed" in normalised.columns else []
    items = (F.posexplode_outer if pages else F.posexplode)("items").alias("item_no", "item")
    rows = normalised.select("source", "page_no", *landed, *(PAGE if pages else ()), items)  # an unreadable page has no items
    return rows.withColumn("item", _at(F.col("item"), "$.item")) if unwrap else rows


def first_rows(rows: DataFrame) -> DataFrame:
    """One row per landed page, of rows that tell of their pages: what ``ledger`` reads."""
    return rows.where(F.coalesce(F.col("item_no"), F.lit(0)) == 0)


def fields(rows: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """Named fields of each item, spelled ``someName`` or ``SOME_NAME``; first non-empty wins.

    An item is read once, into a struct of all spellings. Spellings may differ
    in case only, so the struct's fields are then numbered.
    """
    spellings = [s for c in columns for s in (camel_key(c), c.upper())]
    found = ", ".join(f"`{s}`: string" for s in spellings)
    numbered = ", ".join(f"s{i}: string" for i in range(len(spellings)))
    read = with_once(rows, _f=F.expr(
        f"CAST(try_variant_get(item, '$', 'struct<{found}>') AS struct<{numbered}>)"))
    return read.select(*keep, *[
        F.expr(f"coalesce(nullif(_f.s{2 * i}, ''), nullif(_f.s{2 * i + 1}, '')) AS `{c}`")
        for i, c in enumerate(columns)])


def ledger(normalised: DataFrame) -> DataFrame:
    """One narrow row per page, written once: the stop rule reads it several times.

    A page that landed more than once counts once: the newest, or without a
    ``landed`` column a readable one with the most items.
    """
    bad = F.col("error").isNotNull() | (F.col("item_count") == 0)
    newer = [F.col("landed")] if "landed" in normalised.columns else []
    rank = F.struct(*newer, (~bad).alias("ok"), "item_count", "total_count", "batch_size")
    best = normalised.groupBy("source", "page_no").agg(F.max(rank).alias("r"))
    return cut_lineage(best.select(
        "source", "page_no", "r.batch_size", "r.item_count", "r.total_count", (~F.col("r.ok")).alias("bad")))


def page_plan(pages: DataFrame, max_pages: int = 0) -> DataFrame:
    """Last page that counts per source, from its ``ledger``: pages 1..n of a paged fetch.

    A source stops after the page that completes its total, and before a page
    that is missing, unreadable or empty, or beyond ``max_pages``. Only
    aggregates and key joins: no window runs over the pages of a source.
    """
    following = pages.select("source", (F.col("page_no") - 1).alias("page_no"))
    gaps = pages.join(following, ["source", "page_no"], "left_anti").groupBy("source").agg(
        F.min("page_no").alias("last_in_row"))
    totals = pages.groupBy("source").agg(
        F.max(F.when(F.col("page_no") == 1, F.col("total_count"))).alias("announced"))
    reached = (F.col("page_no") - 1) * F.col("batch_size") + F.col("item_count") >= F.col("announced")
    stops = pages.join(totals, "source").groupBy("source", "announced").agg(
        F.min(F.when(F.col("bad"), F.col("page_no") - 1)).alias("before_bad"),
        F.min(F.when(~F.col("bad") & reached, F.col("page_no"))).alias("complete_at"))
    limits = [F.col("before_bad"), F.col("complete_at"), F.col("last_in_row")]
    if max_pages:
        limits.append(F.lit(max_pages).cast("bigint"))
    plan = stops.join(gaps, "source").withColumn(
        "last_page", F.when(F.col("announced").isNull(), 0).otherwise(F.least(*limits)))
    return plan.select("source", "announced", "last_page")


def completeness(normalised: DataFrame, max_pages: int = 0) -> DataFrame:
    """Pages and rows taken per source against the announced total, with a ``complete`` flag."""
    pages = ledger(normalised)
    taken = pages.join(page_plan(pages, max_pages), "source").groupBy("source", "announced", "last_page").agg(
        F.sum(F.when(F.col("page_no").between(1, F.col("last_page")), F.col("item_count"))
              .otherwise(0)).alias("row_count"))
    return taken.select("source", "announced", F.col("last_page").alias("page_count"), "row_count",
                        F.coalesce(F.col("row_count") >= F.col("announced"), F.lit(False))
                        .alias("complete"))


def taken_pages(normalised: DataFrame, max_pages: int = 0) -> DataFrame:
    """The pages that count, without their payload.

    The parsed pages are written once: the ledger, which reads a few numbers of
    each, and the rows both come from there, so no payload is parsed again.
    """
    parsed = staged(normalised.drop("payload"), "parsed-pages")
    plan = page_plan(ledger(parsed), max_pages).select("source", "last_page")
    return parsed.join(plan, "source").where(
        F.col("page_no").between(1, F.col("last_page"))).drop("last_page")
