"""Not-modified revisit records resolved to the full responses they stand for.

A revisit that a server answered with 304 has no payload. It is joined as of
its time to the latest earlier full response of the same canonical URL; if the
validators agree, it takes that response's payload, and its headers are merged
as far as a 304 may change them.

The join is one sort: records are range-partitioned by URL and time, so a URL
with very many captures spans many tasks. Each task carries the last response
of the current URL along its sorted rows. What a task cannot know, the last
response of its first URL before its first row, comes from one small row per
task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from carelake.session import staged

# Header fields that a 304 may send for the stored response (RFC 9110, 15.4.5, and the validators).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
# Query parameters that only tell where a visitor came from.
TRACKING = "^(utm_[a-z]*|gclid|fbclid)(=|$)"
_START = r"^[a-zA-Z][a-zA-Z0-9+.-]*://"


def canonical_url(url: Column) -> Column:
    """Host, path and sorted query of a URL, without what does not tell pages apart.

    The scheme, a leading www., the default ports, the fragment, slashes at
    the end of the path and tracking parameters go; the host is lowered.
    Null for null, and for what has no scheme and host.
    """
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(bare, _START + r"([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, _START + r"[^/?]*([^?]*)", 1), "/+$", "")
    asked = F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&")
    asked = F.array_join(F.array_sort(F.filter(asked, lambda p: (p != "") & ~F.rlike(p, F.lit(TRACKING)))), "&")
    return F.when(host != "", F.concat(host, path, F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise("")))


def _carry(width: int):
    """Carry responses along sorted rows. Columns: url, at, response, record, headers, digest."""
    def last_of(rows: pa.RecordBatch, url) -> pa.RecordBatch | None:
        own = rows.filter(pc.and_(rows.column(2), pc.equal(rows.column(0), pa.scalar(url))))
        return own.slice(own.num_rows - 1) if own.num_rows else None

    def out(rows: pa.RecordBatch, came: pa.RecordBatch, at, unsure, edge, part) -> pa.RecordBatch:
        picked = pa.array(at, pa.int64())
        found = [came.column(i).take(picked) for i in range(3, width)]
        n = rows.num_rows
        return pa.RecordBatch.from_arrays(
            [rows.column(0), rows.column(1), *[rows.column(i) for i in range(3, width)], *found,
             pa.array(unsure, pa.bool_()), pa.array(np.full(n, edge, np.int32)), pa.array(np.full(n, part, np.int32))],
            names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, carry, first, last = TaskContext.get().partitionId(), None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            any_row = batch.slice(0, 1)
            rows = batch if carry is None else pa.concat_batches([carry, batch])
            skip = rows.num_rows - batch.num_rows
            urls = rows.column(0)
            if first is None:
                first = urls[0].as_py()
            changed = np.ones(rows.num_rows, bool)
            changed[1:] = pc.not_equal(urls.slice(1), urls.slice(0, rows.num_rows - 1)).to_numpy(zero_copy_only=False)
            index = np.arange(rows.num_rows)
            begin = np.maximum.accumulate(np.where(changed, index, 0))
            answers = rows.column(2).to_numpy(zero_copy_only=False).astype(bool)
            seen = np.maximum.accumulate(np.where(answers, index, -1))
            have = seen >= begin
            ask = ~answers
            ask[:skip] = False
            asking = np.flatnonzero(ask)
            places = pa.array(asking)
            unsure = ~have[asking] & pc.equal(urls, pa.scalar(first)).to_numpy(zero_copy_only=False)[asking]
            at = pa.array(seen[asking], mask=~have[asking])
            yield out(rows.take(places), rows, at, unsure, 0, part)
            last = urls[rows.num_rows - 1].as_py()
            carry = last_of(rows, last)
        if first is not None:  # one row for the first URL, which asks, and one for the last, which tells
            none = any_row.slice(0, 0) if carry is None else carry
            for edge, url, row in ((1, first, None), (2, last, carry)):
                one = any_row.set_column(0, any_row.schema.field(0), pa.array([url], any_row.column(0).type))
                found = [None] if row is None else [0]
                yield out(one, one if row is None else none, pa.array(found, pa.int64()), [False], edge, part)
    return run


_NAMES = ["url", "at", "record", "headers", "digest", "r_record", "r_headers", "r_digest", "unsure", "edge", "part"]


def as_of_responses(records: DataFrame) -> DataFrame:
    """``url, at, record, headers, digest, r_record, r_headers, r_digest``: each revisit with its latest earlier response.

    ``records`` has ``url`` (canonical, not null), ``at``, ``response``,
    ``record``, ``headers`` and ``digest``. Earlier means before ``at``; of
    responses at one time the larger record counts.
    """
    order = ["url", "at", "response", "record"]  # at one time revisits come first, so no response of that time is before
    placed = records.select(*order, "headers", "digest").repartitionByRange(*order).sortWithinPartitions(*order)
    field = {f.name: f for f in placed.schema.fields}
    schema = StructType([*[StructField(n, field[n.removeprefix("r_")].dataType) for n in _NAMES[:-3]],
                         StructField("unsure", BooleanType()), StructField("edge", IntegerType()),
                         StructField("part", IntegerType())])
    columns = placed.select("url", "at", "response", "record", "headers", "digest")
    found = staged(columns.mapInArrow(_carry(6), schema), "as-of")
    # Two rows per task: what its first URL lacks is the last response that any task before it ended with.
    edges = found.where("edge > 0").withColumn("r", F.when(F.col("r_record").isNotNull(),
                                                           F.struct("r_record", "r_headers", "r_digest")))
    before = Window.partitionBy("url").orderBy("part", "edge").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumn("r", F.last("r", ignorenulls=True).over(before)).where("edge = 1").select("part", "r")
    rows = found.where("edge = 0").join(F.broadcast(edges), "part", "left")
    pick = [F.when(F.col("unsure"), F.col(f"r.{c}")).otherwise(F.col(c)).alias(c)
            for c in ("r_record", "r_headers", "r_digest")]
    return rows.select("url", "at", "record", "headers", "digest", *pick)


def _validators_agree(own: Column, stored: Column) -> Column:
    """By entity tag if the revisit has one, weak marks aside; else by modification time; null without either."""
    def tag(h):
        return F.regexp_replace(h["etag"], "^W/", "")
    same_tag = F.coalesce(tag(own) == tag(stored), F.lit(False))
    same_time = F.coalesce(own["last-modified"] == stored["last-modified"], F.lit(False))
    return F.when(own["etag"].isNotNull(), same_tag).when(own["last-modified"].isNotNull(), same_time)


def merged_headers(stored: Column, own: Column) -> Column:
    """The stored headers, with those of the revisit that a 304 may change in their place."""
    allowed = F.array(*[F.lit(name) for name in PERMITTED])
    newer = F.map_filter(own, lambda k, v: F.array_contains(allowed, k) & v.isNotNull())
    older = F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(newer), k))
    return F.map_concat(older, newer)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``record, url, at, outcome, response, digest, headers``: one row per revisit in ``records``.

    ``records``: ``record`` (long), ``url``, ``at`` (long), ``kind``
    (``response`` or ``revisit``; others are no part of this), ``headers`` (map
    with lower-case names) and ``digest`` of the payload. ``outcome`` is

    * ``resolved``: the latest earlier response has the same validator;
      ``response`` and ``digest`` are its, ``headers`` are merged;
    * ``changed``: it has another validator; ``response`` names it, ``digest``
      is null and ``headers`` are the revisit's own;
    * ``unchecked``: the revisit sent no validator; as for ``changed``;
    * ``missing``: there is no earlier response, or the URL or time is null.

    ``url`` is the canonical one. Null headers count as none. Of several
    responses at one time the one with the largest record counts; rows that
    repeat are resolved each on its own. Other columns are not read; empty
    tables give no rows.
    """
    empty = F.create_map().cast("map<string,string>")
    rows = records.select("record", canonical_url(F.col("url")).alias("url"), F.col("at").cast("long").alias("at"),
                          (F.col("kind") == "response").alias("response"), F.col("kind"),
                          F.coalesce("headers", empty).alias("headers"), "digest").where("kind IN ('response', 'revisit')")
    whole = F.col("url").isNotNull() & F.col("at").isNotNull()
    found = as_of_responses(rows.where(whole).drop("kind"))
    agree = _validators_agree(F.col("headers"), F.col("r_headers"))
    outcome = F.when(F.col("r_record").isNull(), "missing").when(agree, "resolved").when(~agree, "changed").otherwise(
        "unchecked")
    found = found.withColumn("outcome", outcome)
    done = F.col("outcome") == "resolved"
    found = found.select("record", "url", "at", "outcome", F.col("r_record").alias("response"),
                         F.when(done, F.col("r_digest")).alias("digest"),
                         F.when(done, merged_headers(F.col("r_headers"), F.col("headers"))).otherwise(F.col("headers"))
                         .alias("headers"))
    lost = rows.where(~whole & ~F.col("response")).select(
        "record", "url", "at", F.lit("missing").alias("outcome"), F.lit(None).cast("long").alias("response"),
        F.lit(None).cast(rows.schema["digest"].dataType).alias("digest"), "headers")
    return found.unionByName(lost)


def with_payload(resolved: DataFrame, records: DataFrame, payload: str) -> DataFrame:
    """``resolved`` with the payload column of the responses in ``records``; null where nothing was resolved."""
    bodies = records.where("kind = 'response'").select(F.col("record").alias("response"), payload)
    wanted = resolved.withColumn("response", F.when(F.col("outcome") == "resolved", F.col("response")))
    return wanted.join(bodies, "response", "left")
