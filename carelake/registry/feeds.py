"""Landed feed pages, normalisation, upserts, deletes, patches and run counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake import schemas
from carelake.functions import checks, clock, text
from carelake.operators import filters, numbering, rollups, upsert
from carelake.plans import collection
from carelake.registry import query
from carelake.registry.standins import table
from carelake.session import scratch_path
from carelake.sources import envelope, keyed, snapshots
from carelake.streaming import recollect

PAGE = 40


def landed_pages(spark, sf) -> DataFrame:
    """Customers as feed pages, one source per market segment, in six envelope shapes.

    One page of one source is an error page and one page of another is missing.
    """
    rows = numbering.number_rows(table(spark, sf, "customer"), ["c_custkey"], ["c_mktsegment"])
    sized = rows.withColumn("page_no", F.floor(F.col("row_no") / PAGE) + 1)
    item = F.struct(F.col("row_no"), F.struct(
        F.col("c_custkey").cast("string").alias("c_custkey"), F.col("c_name").alias("C_NAME")).alias("item"))
    totals = rows.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("total"))
    pages = sized.groupBy("c_mktsegment", "page_no").agg(
        F.sort_array(F.collect_list(item))["item"].alias("items")).join(totals, "c_mktsegment")
    items, one = F.to_json("items"), F.to_json(F.get("items", F.lit(0)))
    counts = F.concat(F.lit(',"totalCount":'), F.col("total").cast("string"), F.lit(',"pageNo":'),
                      F.col("page_no").cast("string"), F.lit(f',"numOfRows":{PAGE}}}'))
    head = F.lit('{"header":{"resultCode":"00"},"body":{"items":')
    keyed = F.to_json(F.map_from_entries(F.transform(
        "items", lambda x, i: F.struct(i.cast("string").alias("k"), x.alias("v")))))
    nested = F.when(F.size("items") == 1, one).otherwise(items)
    kind = F.col("page_no") % 6
    payload = (F.when((F.col("c_mktsegment") == "BUILDING") & (F.col("page_no") == 4),
                      "<OpenAPI_ServiceResponse><cmmMsgHeader>SERVICE ERROR</cmmMsgHeader></OpenAPI_ServiceResponse>")
               .when(kind == 0, F.concat(head, items, counts, F.lit("}")))
               .when(kind == 1, F.concat(head, F.lit('{"item":'), nested, F.lit("}"), counts, F.lit("}")))
               .when(kind == 2, F.concat(F.lit('{"response":{"body":{"items":{"item":'), nested, F.lit("}"),
                                         counts, F.lit("}}")))
               .when(kind == 3, F.concat(F.lit('{"body":{"items":'), items, counts, F.lit("}")))
               .when(kind == 4, items).otherwise(keyed))
    return pages.where("NOT (c_mktsegment = 'MACHINERY' AND page_no = 5)").select(
        F.col("c_mktsegment").alias("source"), "page_no", F.lit(PAGE).cast("bigint").alias("batch_size"),
        payload.alias("payload"))


_LANDED = f"""WITH n AS (
  SELECT c_mktsegment AS source, c_custkey, c_name,
         row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS row_no FROM customer),
p AS (SELECT *, row_no // {PAGE} + 1 AS page_no, row_no % {PAGE} AS item_no FROM n),
landed AS (SELECT * FROM p WHERE NOT (source = 'MACHINERY' AND page_no = 5)),
readable AS (SELECT * FROM landed WHERE NOT (source = 'BUILDING' AND page_no = 4))
"""


@query("envelope_rows", _LANDED + """
SELECT source, page_no, item_no, CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM readable""")
def envelope_rows(spark, sf):
    rows = envelope.item_rows(envelope.normalise(landed_pages(spark, sf)))
    return envelope.fields(rows, ["c_name"], ["source", "page_no", "item_no",
                                              F.try_variant_get("item", "$.c_custkey", "string").alias("c_custkey")])


@query("envelope_shapes", _LANDED + """
SELECT source, page_no,
  CASE WHEN source = 'BUILDING' AND page_no = 4 THEN 'xml_error'
       ELSE list_value('header', 'header', 'response', 'body', 'array', 'numeric_keys')[CAST(page_no % 6 + 1 AS INT)]
  END AS shape,
  CASE WHEN source = 'BUILDING' AND page_no = 4 THEN 'service' END AS error,
  CASE WHEN source = 'BUILDING' AND page_no = 4 THEN 0 ELSE count(*) END AS item_count,
  CASE WHEN source = 'BUILDING' AND page_no = 4 THEN NULL WHEN page_no % 6 IN (4, 5) THEN count(*)
       ELSE (SELECT count(*) FROM customer WHERE c_mktsegment = source) END AS total_count
FROM landed GROUP BY source, page_no""")
def envelope_shapes(spark, sf):
    return envelope.normalise(landed_pages(spark, sf)).select(
        "source", "page_no", "shape", "error", "item_count", "total_count")


@query("quarantined_pages", _LANDED + """
SELECT DISTINCT source, page_no, 'xml_error' AS shape, 'service' AS error
FROM landed WHERE source = 'BUILDING' AND page_no = 4""")
def quarantined_pages(spark, sf):
    return envelope.quarantine(envelope.normalise(landed_pages(spark, sf)))


_COMPLETE = _LANDED + """,
c AS (SELECT source, count(*) AS announced, max(page_no) AS pages FROM p GROUP BY source),
l AS (SELECT *, CASE source WHEN 'MACHINERY' THEN least(pages, 4) WHEN 'BUILDING' THEN least(pages, 3)
      ELSE pages END AS last_page FROM c)
"""


@query("page_completeness", _COMPLETE + """
SELECT source, announced, last_page AS page_count, row_count, row_count >= announced AS complete
FROM (SELECT l.source, l.announced, l.last_page, count(*) FILTER (WHERE page_no <= last_page) AS row_count
      FROM l JOIN readable ON l.source = readable.source GROUP BY l.source, l.announced, l.last_page)""")
def page_completeness(spark, sf):
    return envelope.completeness(envelope.normalise(landed_pages(spark, sf)))


@query("pages_taken", _COMPLETE + """
SELECT DISTINCT source, page_no FROM l JOIN readable USING (source) WHERE page_no <= least(last_page, 6)""")
def pages_taken(spark, sf):
    return envelope.taken_pages(envelope.normalise(landed_pages(spark, sf)), max_pages=6).select("source", "page_no")


@query("camel_keys", """
SELECT p_partkey AS pPartkey, p_name AS pName, p_brand || '/' || p_type AS path FROM part""")
def camel_keys(spark, sf):
    nested = table(spark, sf, "part").select("p_partkey", "p_name", F.struct(
        F.col("p_brand").alias("brand_name"), F.array(F.struct(F.col("p_type").alias("type_name"))).alias("kind_list")
    ).alias("part_info"))
    renamed = text.camel_columns(nested)
    return renamed.select("pPartkey", "pName", F.concat(
        "partInfo.brandName", F.lit("/"), F.col("partInfo.kindList")[0]["typeName"]).alias("path"))


@query("field_defaults", """
SELECT o_orderkey,
  CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y%m%d') WHEN 'O' THEN strftime(o_orderdate, '%Y-%m-%d')
       ELSE '' END AS raw_date,
  CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-%d') END AS date_value,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'none' ELSE o_orderpriority END AS priority
FROM orders""")
def field_defaults(spark, sf):
    raw = (F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyyMMdd"))
           .when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyy-MM-dd")))
    blank = F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.col("o_orderpriority"))
    return table(spark, sf, "orders").select(
        "o_orderkey", text.normal_date(raw).alias("raw_date"),
        text.date_value(raw).cast("string").alias("date_value"),
        text.default_if_empty(blank, "none").alias("priority"))


@query("row_chunks", """
SELECT c_custkey, c_mktsegment,
       (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1) // 64 AS chunk FROM customer""")
def row_chunks(spark, sf):
    return numbering.numbered_chunks(table(spark, sf, "customer"), 64, ["c_custkey"], ["c_mktsegment"]).select(
        "c_custkey", "c_mktsegment", "chunk")


@query("attribute_maps", """
SELECT event_id, replace(props, ' ', '') AS props, event_type AS kind, 2 AS attributes FROM events""")
def attribute_maps(spark, sf):
    raw = F.create_map(F.lit("sessionAttr:props"), F.col("props"), F.lit("sessionAttr:kind"), F.col("event_type"),
                       F.lit("lastAccess"), F.col("ts").cast("string"))
    return table(spark, sf, "events").select("event_id", text.attribute_map(raw).alias("a")).select(
        "event_id", F.col("a")["props"].alias("props"), F.col("a")["kind"].alias("kind"), F.size("a").alias("attributes"))


@query("duration_labels", """
SELECT o_orderkey, CASE WHEN ms = 0 THEN '-' WHEN ms < 1000 THEN CAST(ms AS VARCHAR) || 'ms'
  WHEN ms < 60000 THEN CAST(CAST(floor(ms / 1000e0 + 0.5e0) AS BIGINT) AS VARCHAR) || '초'
  ELSE CAST(CAST(floor(ms / 60000e0 + 0.5e0) AS BIGINT) AS VARCHAR) || '분' END AS label
FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) % (1 + (o_orderkey % 5) * 30000) AS ms FROM orders)""")
def duration_labels(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "CAST(floor(o_totalprice) AS BIGINT) % (1 + (o_orderkey % 5) * 30000) AS ms")
    return rows.select("o_orderkey", clock.duration_label(F.col("ms")).alias("label"))


def _results(spark, sf):
    """Run results of three feed groups, each with columns of its own."""
    lines = table(spark, sf, "lineitem").select(
        F.lit("rules").alias("feed_group"), F.col("l_returnflag").alias("source"),
        F.floor("l_extendedprice").alias("processing_ms"), F.col("l_linenumber").cast("bigint").alias("page_count"),
        F.floor("l_quantity").alias("row_count"), (F.col("l_tax") < 0.08).alias("success"))
    orders = table(spark, sf, "orders").select(
        F.lit("facilities").alias("feed_group"), F.col("o_orderstatus").alias("source"),
        F.floor("o_totalprice").alias("processing_ms"), F.lit(1).cast("bigint").alias("page_count"),
        F.lit(3).cast("bigint").alias("row_count"), F.lit(True).alias("success"))
    parts = table(spark, sf, "part").select(
        F.lit("items").alias("feed_group"), F.col("p_type").alias("source"),
        F.col("p_size").cast("bigint").alias("row_count"), (F.col("p_size") > 0).alias("success"))
    return [lines, orders, parts]


_RESULTS = """WITH r AS (
  SELECT 'rules' AS feed_group, l_returnflag AS source, CAST(floor(l_extendedprice) AS BIGINT) AS processing_ms,
         CAST(l_linenumber AS BIGINT) AS page_count, CAST(floor(l_quantity) AS BIGINT) AS row_count,
         l_tax < 0.08 AS success FROM lineitem
  UNION ALL SELECT 'facilities', o_orderstatus, CAST(floor(o_totalprice) AS BIGINT), 1, 3, TRUE FROM orders
  UNION ALL SELECT 'items', p_type, NULL, NULL, p_size, p_size > 0 FROM part)
"""


@query("union_of_feeds", _RESULTS + """
SELECT feed_group, source, count(*) AS runs, count(processing_ms) AS timed FROM r GROUP BY ALL""")
def union_of_feeds(spark, sf):
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), _results(spark, sf))
    return rows.groupBy("feed_group", "source").agg(
        F.count(F.lit(1)).alias("runs"), F.count("processing_ms").alias("timed"))


@query("run_summary", _RESULTS + """
SELECT feed_group, source, CAST(sum(processing_ms) AS BIGINT) AS processing_ms,
       CAST(sum(page_count) AS BIGINT) AS page_count, CAST(sum(row_count) AS BIGINT) AS row_count,
       bool_and(success) AS success, count(*) AS runs FROM r GROUP BY ROLLUP (feed_group, source)""")
def run_summary(spark, sf):
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), _results(spark, sf))
    return rollups.run_summary(rows)


# ---- upsert of every keyed table, from landed pages ---------------------------------------------

BEFORE, NOW = "2024-01-01 00:00:00", "2024-02-01 00:00:00"
UNWRAPPED = {t for t in schemas.UPSERTED if t.startswith("dur_")}


def _plain(table_name):
    return [c for c in schemas.column_names(table_name) if c not in ("created_at", "updated_at")]


def _value(name: str, field: T.StructField, place: int, changed: str) -> str:
    """SQL text of one column, as a string; ``changed`` is a suffix expression or ''."""
    if (name, field.name) in schemas.ALLOWED:
        first, second = schemas.ALLOWED[name, field.name]
        return f"CASE WHEN (p_size{f' + length({changed})' if changed else ''}) % 2 = 0 THEN '{first}' ELSE '{second}' END"
    suffix = f" || {changed}" if changed else ""
    if isinstance(field.dataType, T.StringType):
        return f"'{field.name}-' || p_brand{suffix}"
    bump = f" + length({changed})" if changed else ""
    if isinstance(field.dataType, T.DecimalType):
        return f"CAST(100 + p_size{bump} AS VARCHAR(20)) || '.25'"
    if isinstance(field.dataType, T.ByteType):
        return f"CAST(p_size{bump} AS VARCHAR(20))"
    return f"CAST(p_partkey + {place}{bump} AS VARCHAR(20))"


def _key(field: T.StructField, place: int) -> str:
    number = f"CAST(p_partkey + {place} AS VARCHAR(20))"
    return f"'k' || {number}" if isinstance(field.dataType, T.StringType) else number


def _columns(name: str, changed) -> dict[str, str]:
    """Text expression of every column of a table; ``changed(column)`` gives its suffix."""
    keys, out = schemas.KEYS[name], {}
    for i, field in enumerate(f for f in schemas.schema(name) if f.name in _plain(name)):
        out[field.name] = _key(field, keys.index(field.name)) if field.name in keys \
            else _value(name, field, i, changed(field.name))
    return out


def _feed_suffix(name):
    """What the feed changed: everything where rows are overwritten; else by kind of column."""
    if name not in schemas.COMPARED:
        return lambda _: "p_name"
    compared = set(schemas.COMPARED[name])
    small, both = "CASE WHEN p_type = 'SMALL' THEN '+' ELSE '' END", \
        "CASE WHEN p_type IN ('SMALL', 'MEDIUM') THEN '+' ELSE '' END"
    return lambda c: small if c in compared else both


def _existing_suffix(name):
    return lambda _: ""


def _nulled(name):
    """A compared text column that is null in the table and filled in the feed for one type."""
    return {"hospital": "telno", "pharmacy": "telno", "emergency": "duty_tel1", "trauma": "duty_tel1"}.get(name)


#: Parts that the table holds before the feed; all others come with it.
EXISTING = "(p_size <= 30 OR p_type = 'PROMO')"


def existing_rows(spark, sf, name) -> DataFrame:
    rows = table(spark, sf, "part").where(EXISTING)
    types = {f.name: f.dataType for f in schemas.schema(name)}
    columns = []
    for c, e in _columns(name, _existing_suffix(name)).items():
        e = f"CASE WHEN p_type = 'ECONOMY' THEN NULL ELSE {e} END" if c == _nulled(name) else e
        columns.append(F.expr(e).cast(types[c]).alias(c))
    stamp = F.lit(BEFORE).cast("timestamp")
    return rows.select(*columns, stamp.alias("created_at"), stamp.alias("updated_at"))


def feed_pages(spark, sf, name) -> DataFrame:
    """The table's feed: camelCase or UPPER_CASE keys, duplicates, and rows without a key."""
    rows = table(spark, sf, "part", costly=True).where("p_type <> 'PROMO'")
    last = F.when(F.col("p_type") == "LARGE", 1).otherwise(0)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), last)))
    newest = F.col("copy") == last
    camel, upper, both, kinds = [], [], [], {f.name: f.dataType for f in schemas.schema(name)}
    for c, e in _columns(name, _feed_suffix(name)).items():
        value = F.expr(e)
        if c in schemas.KEYS[name]:
            value = F.when(F.col("p_brand") == "Brand#9", "").otherwise(value)
        elif isinstance(kinds[c], T.StringType) and (name, c) not in schemas.ALLOWED:
            value = F.when(newest, value).otherwise(F.lit("older"))
        camel.append(value.alias(text.camel_key(c)))
        upper.append(value.alias(c.upper()))
        if c.upper() != text.camel_key(c):
            both += [F.lit("").alias(text.camel_key(c)), value.alias(c.upper())]
    item = (F.when(F.col("p_size") % 5 == 0, F.to_json(F.struct(*both)))
            .when(F.col("p_size") % 2 == 0, F.to_json(F.struct(*upper)))
            .otherwise(F.to_json(F.struct(*camel))))
    if name in UNWRAPPED:
        item = F.concat(F.lit('{"item":'), item, F.lit("}"))
    pages = rows.select((F.floor(F.col("p_partkey") / 50) + 1).alias("page_no"), "p_partkey", "copy",
                        item.alias("item")).groupBy("page_no").agg(
        F.sort_array(F.collect_list(F.struct("p_partkey", "copy", "item")))["item"].alias("items"))
    payload = F.concat(F.lit('{"header":{"resultCode":"00"},"body":{"items":['), F.array_join("items", ","),
                       F.lit('],"totalCount":1000000000000,"numOfRows":50}}'))
    landed = pages.select(F.lit(name).alias("source"), "page_no", F.lit(50).cast("bigint").alias("batch_size"),
                          payload.alias("payload"))
    return landed.repartition(spark.sparkContext.defaultParallelism)  # as landed files are


def _as_text(df, name):
    shown = [F.col(c).cast("string").alias(c) for c in _plain(name) + ["created_at", "updated_at"]]
    return df.select(*shown, *(["action"] if "action" in df.columns else []))


def _typed_sql(name, column, expression):
    kind = schemas.schema(name)[column].dataType
    if isinstance(kind, T.DecimalType):
        return f"CAST(CAST({expression} AS DECIMAL({kind.precision},{kind.scale})) AS VARCHAR)"
    return expression


def _upsert_sql(name: str, body: str = "SELECT * FROM result") -> str:
    def frame(suffix, condition, nulled):
        columns = []
        for c, e in _columns(name, suffix(name)).items():
            e = f"CASE WHEN p_type = 'ECONOMY' THEN NULL ELSE {e} END" if c == nulled else e
            columns.append(f"{_typed_sql(name, c, e)} AS {c}")
        return f"SELECT {', '.join(columns)} FROM part WHERE {condition}"
    keys = schemas.KEYS[name]
    on = " AND ".join(f"o.{k} = n.{k}" for k in keys)
    old, new = f"o.{keys[0]} IS NOT NULL", f"n.{keys[0]} IS NOT NULL"
    differs = " OR ".join(f"o.{c} IS DISTINCT FROM n.{c}" for c in schemas.COMPARED.get(name, [])) or "TRUE"
    action = f"CASE WHEN NOT {new} THEN 'kept' WHEN NOT {old} THEN 'saved' WHEN {differs} THEN 'updated' ELSE 'skipped' END"
    shown = [f"coalesce(o.{c}, n.{c}) AS {c}" if c in keys else
             f"CASE WHEN action IN ('saved', 'updated') THEN n.{c} ELSE o.{c} END AS {c}" for c in _plain(name)]
    extra = ["action"] if name in schemas.COMPARED else []
    return f"""WITH o AS ({frame(_existing_suffix, EXISTING, _nulled(name))}),
n AS ({frame(_feed_suffix, "p_type <> 'PROMO' AND p_brand <> 'Brand#9'", None)}),
j AS (SELECT o, n, {action} AS action, {old} AS was FROM o FULL JOIN n ON {on}),
result AS (SELECT {', '.join(shown)}, CASE WHEN was THEN '{BEFORE}' ELSE '{NOW}' END AS created_at,
  CASE WHEN action IN ('saved', 'updated') THEN '{NOW}' ELSE '{BEFORE}' END AS updated_at
  {', action' if extra else ''} FROM j)
{body}"""


def _register_upsert(name):
    @query(f"upsert_{name}", _upsert_sql(name))
    def run(spark, sf):
        pages = envelope.normalise(feed_pages(spark, sf, name))
        after = collection.collect(existing_rows(spark, sf, name), pages, name,
                                   F.lit(NOW).cast("timestamp"), unwrap=name in UNWRAPPED)
        return _as_text(after, name)


for _name in [*schemas.UPSERTED, *schemas.COMPARED]:
    _register_upsert(_name)


@query("save_counts", """WITH p AS (
  SELECT *, p_size <= 30 AS known, p_brand = 'Brand#9' AS keyless FROM part WHERE p_type <> 'PROMO'),
c AS (SELECT count(*) + count(*) FILTER (WHERE p_type = 'LARGE') AS total_count,
  count(*) FILTER (WHERE NOT keyless AND NOT known) AS saved_count,
  count(*) FILTER (WHERE NOT keyless AND known AND p_type IN ('SMALL', 'ECONOMY')) AS updated_count,
  count(*) FILTER (WHERE NOT keyless AND known AND p_type NOT IN ('SMALL', 'ECONOMY')) AS skipped_count,
  count(*) FILTER (WHERE keyless) + count(*) FILTER (WHERE keyless AND p_type = 'LARGE') AS error_count,
  count(*) FILTER (WHERE NOT keyless AND p_type = 'LARGE') AS superseded_count FROM p)
SELECT * FROM c""")
def save_counts(spark, sf):
    pages = envelope.normalise(feed_pages(spark, sf, "emergency"))
    return collection.collection_counts(existing_rows(spark, sf, "emergency"), pages, "emergency")


# Items of the emergency feed of which some hold no number, a number that does not fit, or a value that is not allowed.
_FLAWED = {
    "hpid": "CASE WHEN p_brand = 'Brand#9' THEN '' ELSE 'k' || CAST(p_partkey AS VARCHAR(20)) END", "duty_name": "p_name",
    "hvec": "CAST(p_size AS VARCHAR(20)) || CASE WHEN p_type = 'SMALL' THEN 'x' ELSE '' END",
    "wgs84_lon": "CASE WHEN p_size % 11 = 0 THEN '9999.5' ELSE '126.5' END",
    "m_kiosk_ty25": "CASE WHEN p_size % 7 = 0 THEN 'Z' ELSE 'Y' END"}
_FLAWED_SQL = f"""WITH f AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _FLAWED.items())}, p_type = 'SMALL' AS no_number,
 p_size % 11 = 0 AS no_fit, p_size % 7 = 0 AS not_allowed, p_brand = 'Brand#9' AS keyless, p_size <= 25 AS known FROM part),
p AS (SELECT c_custkey AS id, c_custkey % 200 AS user_age FROM customer),
m AS (SELECT conv_id, turn, CASE turn WHEN 1 THEN '' WHEN 2 THEN repeat(text, 40) ELSE text END AS content FROM conversations)
"""


def _flawed_rows(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_partkey", *[f"{e} AS {c.upper()}" for c, e in _FLAWED.items()])
    items = rows.groupBy((F.floor(F.col("p_partkey") / 50) + 1).alias("page_no")).agg(F.sort_array(F.collect_list(F.struct(
        "p_partkey", F.to_json(F.struct(*[c.upper() for c in _FLAWED])).alias("item"))))["item"].alias("items"))
    payload = F.concat(F.lit('{"header":{"resultCode":"00"},"body":{"items":['), F.array_join("items", ","),
                       F.lit('],"totalCount":1000000000000,"numOfRows":50}}'))
    pages = items.select(F.lit("emergency").alias("source"), "page_no", F.lit(50).cast("bigint").alias("batch_size"),
                         payload.alias("payload"))
    return envelope.normalise(pages)


@query("quarantined_values", _FLAWED_SQL + """
SELECT 'emergency' AS table_name, nullif(hpid, '') AS key, 'hvec' AS name, 'type' AS check, hvec AS text FROM f WHERE no_number
UNION ALL SELECT 'emergency', nullif(hpid, ''), 'wgs84_lon', 'type', wgs84_lon FROM f WHERE no_fit
UNION ALL SELECT 'emergency', nullif(hpid, ''), 'm_kiosk_ty25', 'allowed', m_kiosk_ty25 FROM f WHERE not_allowed
UNION ALL SELECT 'people', CAST(id AS VARCHAR), 'user_age', 'range', CAST(user_age AS VARCHAR) FROM p WHERE user_age > 150
UNION ALL SELECT 'messages', CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR), 'content', 'length', content
FROM m WHERE length(content) NOT BETWEEN 1 AND 1000""")
def quarantined_values(spark, sf):
    """Values of three tables that fail a check: of their type, of what is allowed, of a range, of a length."""
    feed = collection.quarantined_values(collection.typed_rows(_flawed_rows(spark, sf), "emergency"), "emergency")
    people = table(spark, sf, "customer").selectExpr("c_custkey AS id", "CAST(c_custkey % 200 AS INT) AS user_age")
    messages = table(spark, sf, "conversations").selectExpr(
        "conv_id", "turn", "CASE turn WHEN 1 THEN '' WHEN 2 THEN repeat(text, 40) ELSE text END AS content")
    parts = [feed.withColumn("key", F.nullif("hpid", F.lit(""))),
             checks.failing(people, "people", ["id"]).withColumn("key", F.col("id").cast("string")),
             checks.failing(messages, "messages", ["conv_id", "turn"]).withColumn("key", F.concat_ws("/", "conv_id", "turn"))]
    return reduce(DataFrame.unionByName, [p.select("table_name", "key", "name", "check", "text") for p in parts])


@query("error_counts", _FLAWED_SQL + """
SELECT 'type' AS check, count(*) AS n FROM f WHERE no_number OR no_fit
UNION ALL SELECT 'allowed', count(*) FROM f WHERE not_allowed UNION ALL SELECT 'required', count(*) FROM f WHERE keyless""")
def error_counts(spark, sf):
    return collection.error_counts(collection.typed_rows(_flawed_rows(spark, sf), "emergency"), "emergency")


@query("checked_save_counts", _FLAWED_SQL + """
SELECT count(*) AS total_count, count(*) FILTER (WHERE good AND NOT known) AS saved_count,
 count(*) FILTER (WHERE good AND known AND hpid LIKE '%7') AS updated_count,
 count(*) FILTER (WHERE good AND known AND hpid NOT LIKE '%7') AS skipped_count,
 count(*) FILTER (WHERE NOT good) AS error_count, 0 AS superseded_count
FROM (SELECT *, NOT (no_number OR no_fit OR not_allowed OR keyless) AS good FROM f)""")
def checked_save_counts(spark, sf):
    """Counts by outcome where rows fail for every kind of reason; each such row is one error."""
    known = table(spark, sf, "part").where("p_size <= 25 AND p_brand <> 'Brand#9'")
    types = {f.name: f.dataType for f in schemas.schema("emergency")}
    given = {"hpid": F.expr(_FLAWED["hpid"]), "wgs84_lon": F.lit("126.5"),
             "duty_name": F.when(F.col("p_partkey") % 10 == 7, "before").otherwise(F.col("p_name"))}
    existing = known.select(*[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in types.items()])
    return collection.collection_counts(existing, _flawed_rows(spark, sf), "emergency")


@query("forced_update", _upsert_sql("trauma").split("result AS")[0].rstrip().rstrip(",") + f"""
SELECT CASE WHEN action = 'skipped' THEN 'updated' ELSE action END AS action, count(*) AS n FROM j GROUP BY 1""")
def forced_update(spark, sf):
    pages = envelope.normalise(feed_pages(spark, sf, "trauma"))
    after = collection.collect(existing_rows(spark, sf, "trauma"), pages, "trauma",
                               F.lit(NOW).cast("timestamp"), force=True)
    return after.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("outcome_counts", _upsert_sql("pharmacy", """
SELECT count(*) AS total_count, count(*) FILTER (WHERE action = 'saved') AS saved_count,
  count(*) FILTER (WHERE action = 'updated') AS updated_count,
  count(*) FILTER (WHERE action = 'skipped') AS skipped_count, 0 AS error_count FROM result WHERE action <> 'kept'"""))
def outcome_counts(spark, sf):
    pages = envelope.normalise(feed_pages(spark, sf, "pharmacy"))
    after = collection.collect(existing_rows(spark, sf, "pharmacy"), pages, "pharmacy", F.lit(NOW).cast("timestamp"))
    return rollups.outcome_counts(after.where("action <> 'kept'"))


@query("required_keys", """
SELECT 'valid' AS part, count(*) AS n FROM part WHERE p_brand <> 'Brand#9'
UNION ALL SELECT 'rejected', count(*) FROM part WHERE p_brand = 'Brand#9'""")
def required_keys(spark, sf):
    rows = table(spark, sf, "part").withColumn(
        "dur_seq", F.when(F.col("p_brand") == "Brand#9", "").otherwise(F.col("p_partkey").cast("string")))
    valid, rejected = filters.split_required(rows, ["dur_seq"])
    return valid.agg(F.lit("valid").alias("part"), F.count(F.lit(1)).alias("n")).union(
        rejected.agg(F.lit("rejected"), F.count(F.lit(1))))


@query("deleted_by_key", """
SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)""")
def deleted_by_key(spark, sf):
    gone = table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return upsert.delete(table(spark, sf, "customer"), gone, ["c_custkey"]).select("c_custkey", "c_name")


_PATCHED = """WITH p AS (SELECT s_suppkey * 20 AS c_custkey, CASE WHEN s_acctbal > 5000 THEN s_name END AS c_name,
  CAST(NULL AS VARCHAR(20)) AS c_mktsegment, s_nationkey % 3 = 0 AS clears FROM supplier)
"""


@query("patched_rows", _PATCHED + f"""
SELECT c.c_custkey, coalesce(p.c_name, c.c_name) AS c_name,
  CASE WHEN p.clears THEN NULL ELSE c.c_mktsegment END AS c_mktsegment,
  CASE WHEN p.c_name IS NOT NULL OR p.clears THEN '{NOW}' ELSE '{BEFORE}' END AS updated_at
FROM customer c LEFT JOIN p ON c.c_custkey = p.c_custkey""")
def patched_rows(spark, sf):
    return upsert.patch(_patch_target(spark, sf), _patches(spark, sf), ["c_custkey"], ["c_name", "c_mktsegment"],
                        F.lit(NOW).cast("timestamp")).withColumn("updated_at", F.col("updated_at").cast("string"))


def _patch_target(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", "c_name", "c_mktsegment", F.lit(BEFORE).cast("timestamp").alias("updated_at"))


def _patches(spark, sf):
    return table(spark, sf, "supplier").select(
        (F.col("s_suppkey") * 20).alias("c_custkey"), F.when(F.col("s_acctbal") > 5000, F.col("s_name")).alias("c_name"),
        F.lit(None).cast("string").alias("c_mktsegment"), (F.col("s_nationkey") % 3 == 0).alias("set_c_mktsegment"))


@query("patches_not_found", _PATCHED + "SELECT c_custkey FROM p WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)")
def patches_not_found(spark, sf):
    return upsert.unmatched(_patch_target(spark, sf), _patches(spark, sf), ["c_custkey"]).select("c_custkey")


@query("batch_insert", """
SELECT c_custkey AS id, c_name AS name, c_mktsegment AS role FROM customer
UNION ALL SELECT 1000000 + s_suppkey, s_name, NULL FROM supplier""")
def batch_insert(spark, sf):
    users = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("role"))
    rows = table(spark, sf, "supplier").select((F.col("s_suppkey") + 1000000).alias("id"), F.col("s_name").alias("name"))
    return upsert.append(users, rows)


@query("bound_scan", "SELECT p_partkey, p_name FROM part WHERE p_type = 'LARGE' AND p_size > 20")
def bound_scan(spark, sf):
    return snapshots.scan(spark, f"{sf}/part.parquet", "SELECT p_partkey, p_name FROM {rows} WHERE p_type = :kind "
                          "AND p_size > :size", ["p_partkey", "p_name", "p_type", "p_size"], kind="LARGE", size=20)


@query("snapshot_refresh", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def snapshot_refresh(spark, sf):
    """Two full refreshes; the newer one holds every row once."""
    base, rows = scratch_path(spark, "refresh"), table(spark, sf, "customer")
    snapshots.write_snapshot(rows.where("c_acctbal > 0"), base, 1)
    snapshots.write_snapshot(rows, base, 2)
    newest = snapshots.read_snapshot(spark, base, snapshots.latest_version(spark, base))
    return newest.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


def _recollected(spark, landing, existing, name, files_per_run):
    """A keyed table of ``existing``, moved on by a stream over the landed pages."""
    base = scratch_path(spark, "table")
    keyed.create(existing, base, schemas.KEYS[name], buckets=8)
    recollect.run(spark, landing, base, name, F.lit(NOW).cast("timestamp"), "february", scratch_path(spark, "progress"),
                  files_per_run)
    return base


@query("recollected_feed", _upsert_sql("emergency", "SELECT * EXCLUDE (action) FROM result"))
def recollected_feed(spark, sf):
    """The feed landed as files, taken by a stream in several runs into a table in buckets."""
    landing = scratch_path(spark, "landing")
    feed_pages(spark, sf, "emergency").write.parquet(landing)
    base = _recollected(spark, landing, existing_rows(spark, sf, "emergency"), "emergency", files_per_run=4)
    return _as_text(keyed.table(spark, base), "emergency")


@query("recollected_twice", _upsert_sql("emergency", """
SELECT result.* EXCLUDE (action), runs FROM result, (VALUES ('each file by itself'), ('all files at once')) AS r(runs)"""))
def recollected_twice(spark, sf):
    """Two collections of which the newer one comes first, cut into runs in two ways."""
    landing, pages = scratch_path(spark, "landing"), feed_pages(spark, sf, "emergency")
    late = pages.withColumn("landed", F.lit("2024-02-01 06:00:00").cast("timestamp"))
    early = pages.withColumns({"payload": F.replace("payload", F.lit("duty_name-"), F.lit("early-")),
                               "landed": F.lit("2024-01-31 06:00:00").cast("timestamp")})
    for part in (late, early):
        part.coalesce(2).write.mode("append").parquet(landing)
    existing = existing_rows(spark, sf, "emergency")
    parts = [_as_text(keyed.table(spark, _recollected(spark, landing, existing, "emergency", files)), "emergency").withColumn(
        "runs", F.lit(runs)) for files, runs in ((1, "each file by itself"), (1000, "all files at once"))]
    return parts[0].unionByName(parts[1])


@query("cycle_outcomes", _upsert_sql("pharmacy", """
SELECT action, count(*) AS n FROM result WHERE action <> 'kept' GROUP BY 1"""))
def cycle_outcomes(spark, sf):
    """What one collection did to a table in buckets, read from the table."""
    base = scratch_path(spark, "table")
    keyed.create(existing_rows(spark, sf, "pharmacy"), base, schemas.KEYS["pharmacy"], buckets=8)
    collection.collect_into(spark, base, envelope.normalise(feed_pages(spark, sf, "pharmacy")), "pharmacy",
                            F.lit(NOW).cast("timestamp"), "february")
    return keyed.outcomes(spark, base, "february")


@query("bucket_deletes", """
SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)""")
def bucket_deletes(spark, sf):
    """Deletes by key from a table in buckets, whose old bucket versions then go."""
    base = scratch_path(spark, "table")
    keyed.create(table(spark, sf, "customer").select("c_custkey", "c_name"), base, ["c_custkey"], buckets=16)
    gone = table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    keyed.delete(spark, base, gone, ["c_custkey"])
    keyed.vacuum(spark, base)
    return keyed.table(spark, base)
