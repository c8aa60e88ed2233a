"""The registered queries of the subpackage, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from carelake.llm import (
    decontamination, lexical, licenses, linededup, merkle, personal, pieces, secrets, sharding, simhash, topk,
    toxicity, warc,
)
from carelake.llm.common import ORACLE, QUERIES, query, table  # noqa: F401

SHARDS = 40

# The usual 32-bit checksum, byte by byte, from a table that SQL works out itself.
_CRC = """WITH codes AS (SELECT list(code ORDER BY n) AS t FROM (SELECT n, list_reduce(
 list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS code
 FROM range(256) AS r(n))),
rows AS (SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, list_transform(
 regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM documents),
sums AS (SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295, bytes),
 lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32 FROM rows, codes)"""


@query("op3_byte_shards", _CRC + f""",
placed AS (SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
 AS before, sum(size) OVER () AS total FROM sums),
cut AS (SELECT *, least((2 * before + size) * {SHARDS} // (2 * total), {SHARDS - 1}) AS shard FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law,
 CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot,
 CAST(NULL AS INTEGER) AS grown_shard FROM cut""")
def op3_byte_shards(spark, sf):
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = table(spark, sf, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    cut = sharding.byte_shards(rows, "size", ["doc_id", "text_crc32"], SHARDS)
    return cut.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


@query("op8_simhash_components")
def op8_simhash_components(spark, sf):
    found = simhash.near_duplicates(table(spark, sf, "documents"), width=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op10_histogram_topk", """
WITH good AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
 FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND
 len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))
 AS BIGINT) AS score FROM good q JOIN good c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5""")
def op10_histogram_topk(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


_TEST_WORDS = ("regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
               "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")


@query("op9_positional_index", f"""
WITH items AS (SELECT item_id, coalesce({_TEST_WORDS}, []) AS w FROM benchmark),
cut AS (SELECT item_id, w, least(10, len(w)) AS n FROM items WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
 FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM cut)),
docs AS (SELECT doc_id, coalesce({_TEST_WORDS}, []) AS w FROM documents),
grams AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
 FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM grams JOIN wins USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))
 AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
 sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)""")
def op9_positional_index(spark, sf):
    found = decontamination.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _license_sql() -> str:
    """The same rules as a table, tried on every text without the prefilter."""
    values = ",\n".join(f"({r['rule']}, {_sql_text(r['label'])}, {_sql_text(r['pattern'])}, {r['priority']}, "
                        f"{r['confidence']})" for r in licenses.rules())
    either = "|".join(licenses.spaced(p) for p in licenses.PHRASES)
    labels = ", ".join(f"CASE WHEN contains(t, {_sql_text(licenses.spaced(p))}) THEN {_sql_text(label)} END"
                       for p, label in licenses.PHRASES.items())
    return f"""
WITH rules(rule, label, pattern, priority, confidence) AS (VALUES {values}),
lowered AS (SELECT row_number() OVER () AS row, doc_id, trim(regexp_replace(translate(coalesce(text, ''),
 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{licenses.SEPARATORS}', ' ', 'g')) AS w FROM documents),
texts AS (SELECT row, doc_id, CASE WHEN w = '' THEN '' ELSE ' ' || replace(w, ' ', '  ') || ' ' END AS t,
 CASE WHEN w = '' THEN 0 ELSE len(string_split(w, ' ')) END AS n_words FROM lowered),
base AS (SELECT row, doc_id, n_words, regexp_extract_all(t, '({either})') AS hits,
 string_split_regex(t, '({either})') AS pieces, list_filter([{labels}], lambda x: x IS NOT NULL) AS base_labels FROM texts),
tried AS (SELECT row, rule, label, priority, confidence, regexp_extract_all(t, pattern) AS hits,
 string_split_regex(t, pattern) AS gaps FROM texts JOIN rules ON regexp_matches(t, pattern)),
cells AS (SELECT row, rule, label, priority, confidence, len(hits[i]) AS n, list_sum(list_transform(gaps[1:i], lambda g: len(g)))
 + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: len(h))), 0) AS start
 FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM tried)),
found AS (SELECT row, rule, label, priority, confidence, start, start + n AS stop FROM cells),
outer_ones AS (SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM found g WHERE g.row = f.row AND
 g.priority > f.priority AND g.start >= f.start AND g.stop <= f.stop)),
kept AS (SELECT * FROM outer_ones f WHERE NOT EXISTS (SELECT 1 FROM outer_ones g WHERE g.row = f.row AND
 g.priority >= f.priority AND g.start <= f.start AND g.stop >= f.stop AND
 (g.start < f.start OR g.stop > f.stop OR g.priority > f.priority OR g.rule < f.rule))),
best AS (SELECT row, list(DISTINCT label) AS more, max(confidence) AS score FROM kept GROUP BY row)
SELECT doc_id, n_words, len(hits) AS n_base,
 CASE WHEN len(hits) > 0 THEN len(regexp_extract_all(pieces[1], '[^ ]+')) END AS first_word,
 CASE WHEN len(hits) > 0 THEN n_words - len(regexp_extract_all(pieces[-1], '[^ ]+'))
  - len(regexp_extract_all(hits[-1], '[^ ]+')) END AS last_word,
 array_to_string(list_sort(base_labels), ',') AS base_labels,
 array_to_string(list_sort(list_distinct(list_concat(base_labels, coalesce(more, [])))), ',') AS labels,
 CAST(coalesce(score, 0) AS DOUBLE) AS score FROM base LEFT JOIN best USING (row)"""


@query("op6_license_rules", _license_sql())
def op6_license_rules(spark, sf):
    found = licenses.license_labels(table(spark, sf, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


@query("op7_unigram_pieces")
def op7_unigram_pieces(spark, sf):
    return pieces.encode_texts(table(spark, sf, "documents"), pieces.load_pieces())


@query("op5_secret_field")
def op5_secret_field(spark, sf):
    docs = table(spark, sf, "documents")
    found = secrets.find_secrets(docs, secrets.train(secrets.sample_texts(docs)))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "field")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
                        count("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))


@query("op4_ordinal_toxicity")
def op4_ordinal_toxicity(spark, sf):
    docs = table(spark, sf, "documents")
    found = toxicity.severity(docs, toxicity.train(docs, table(spark, sf, "labels")))
    return found.select("doc_id", "grade", F.round("severity", 6).alias("severity"),
                        F.round("p_toxic", 6).alias("p_toxic"), (F.col("grade") > 0).alias("toxic"))


@query("op2_near_lines")
def op2_near_lines(spark, sf):
    return linededup.line_summary(table(spark, sf, "documents")).drop("key")


# Captures of the pages: a full response of each, and a revisit of each under another spelling of its URL. Some
# revisits have another tag, some only a time, some nothing; some come before their page was first seen.
_CAPTURES = """
SELECT page_id * 2 AS record, url, page_id * 10 AS "at", 'response' AS kind, md5(coalesce(html, '')) AS digest,
 '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS etag, 'day ' || CAST(page_id % 365 AS VARCHAR(9)) AS modified,
 'no-cache' AS cache, 'text/html' AS kind_of, CAST(NULL AS VARCHAR(9)) AS vary FROM pages
UNION ALL
SELECT page_id * 2 + 1, replace(replace(url, 'https://', 'HTTP://WWW.'), '#top', '') ||
 CASE WHEN url LIKE '%?%' THEN '&utm_medium=mail' ELSE '' END,
 page_id * 10 + CASE WHEN page_id % 7 = 0 THEN -5 ELSE 5 + page_id % 100 END, 'revisit', CAST(NULL AS VARCHAR(32)),
 CASE WHEN page_id % 5 = 1 THEN '"other"' WHEN page_id % 5 < 3
 THEN 'W/"' || substr(md5(coalesce(html, '')), 1, 16) || '"' END,
 CASE WHEN page_id % 5 = 3 THEN 'day ' || CAST(page_id % 365 AS VARCHAR(9)) END, 'max-age=60', 'text/plain', 'accept' FROM pages"""


@query("op1_revisit_resolution", f"""
WITH captures AS ({_CAPTURES}),
bare AS (SELECT *, regexp_replace(trim(url), '#.*$', '') AS u FROM captures),
parts AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '{warc._START}([^/?]*)', 1)),
 ':(80|443)$', ''), '^www\\.', '') AS host,
 regexp_replace(regexp_extract(u, '{warc._START}[^/?]*([^?]*)', 1), '/+$', '') AS path,
 array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'),
  lambda p: p <> '' AND NOT regexp_matches(p, '{warc.TRACKING}'))), '&') AS asked FROM bare),
named AS (SELECT *, CASE WHEN host <> '' THEN host || path || CASE WHEN asked <> '' THEN '?' || asked ELSE '' END END
 AS canonical FROM parts),
met AS (SELECT *, CASE WHEN canonical IS NOT NULL THEN last_value(CASE WHEN kind = 'response' THEN record END IGNORE NULLS)
 OVER (PARTITION BY canonical ORDER BY "at", kind DESC, record ROWS UNBOUNDED PRECEDING) END AS response FROM named),
joined AS (SELECT v.*, r.digest AS r_digest, r.etag AS r_etag, r.modified AS r_modified,
 CASE WHEN r.record IS NULL THEN 'missing' WHEN v.etag IS NOT NULL THEN
  CASE WHEN regexp_replace(v.etag, '^W/', '') = regexp_replace(r.etag, '^W/', '') THEN 'resolved' ELSE 'changed' END
  WHEN v.modified IS NOT NULL THEN CASE WHEN v.modified = r.modified THEN 'resolved' ELSE 'changed' END
  ELSE 'unchecked' END AS outcome
 FROM met v LEFT JOIN captures r ON r.record = v.response WHERE v.kind = 'revisit')
SELECT record // 2 AS page_id, canonical AS url, "at", outcome, response // 2 AS response_page,
 CASE WHEN outcome = 'resolved' THEN r_digest END AS digest,
 'cache-control=max-age=60;content-type=' || CASE WHEN outcome = 'resolved' THEN 'text/html' ELSE 'text/plain' END ||
 coalesce(';etag=' || CASE WHEN outcome = 'resolved' THEN coalesce(etag, r_etag) ELSE etag END, '') ||
 coalesce(';last-modified=' || CASE WHEN outcome = 'resolved' THEN coalesce(modified, r_modified) ELSE modified END, '') ||
 ';vary=accept' AS headers FROM joined""")
def op1_revisit_resolution(spark, sf):
    captures = spark.sql(_CAPTURES.replace('"at"', "`at`").replace("FROM pages", "FROM {pages}"),
                         pages=table(spark, sf, "pages"))
    sent = {"etag": "etag", "last-modified": "modified", "cache-control": "cache", "content-type": "kind_of", "vary": "vary"}
    headers = F.create_map(*[x for name, c in sent.items() for x in (F.lit(name), F.col(c))])
    records = captures.select("record", "url", "at", "kind", "digest",
                              F.map_filter(headers, lambda _, v: v.isNotNull()).alias("headers"))
    found = warc.resolve_revisits(records)
    pairs = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.select(F.expr("record div 2").alias("page_id"), "url", "at", "outcome",
                        F.expr("response div 2").alias("response_page"), "digest", F.array_join(pairs, ";").alias("headers"))


# Nodes of a level as one list per tree; three in a row are hashed to the next level's until one is left.
_MERKLE = """
WITH RECURSIVE rows AS (SELECT doc_id, source, text, concat_ws('', {leaf}) AS plain, concat_ws('', {tampered}) AS changed FROM documents),
leaves AS (SELECT row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, sha256(plain)) - 1 AS pos, doc_id, source,
 sha256(plain) AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 2 = 0 THEN sha256(changed) ELSE sha256(plain) END AS given FROM rows, codes),
bottom(source, level, nodes) AS (SELECT source, 0, list(leaf ORDER BY pos) FROM leaves GROUP BY source
 UNION ALL SELECT source, level + 1, list_transform(range(0, (len(nodes) + 2) // 3),
  lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], ''))) FROM bottom WHERE len(nodes) > 1),
subroots AS (SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM bottom WHERE len(nodes) = 1),
top(level, nodes) AS (SELECT 0, list(subroot ORDER BY place) FROM subroots
 UNION ALL SELECT level + 1, list_transform(range(0, (len(nodes) + 2) // 3),
  lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], ''))) FROM top WHERE len(nodes) > 1),
climbs AS (SELECT l.pos AS id, l.source, 0 AS part, b.level, b.nodes, l.pos // CAST(pow(3, b.level) AS BIGINT) AS a
 FROM leaves l JOIN bottom b ON l.source IS NOT DISTINCT FROM b.source AND len(b.nodes) > 1
 UNION ALL SELECT l.pos, l.source, 1, t.level, t.nodes, s.place // CAST(pow(3, t.level) AS BIGINT)
 FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source, top t WHERE len(t.nodes) > 1),
steps AS (SELECT id, source, list(array_to_string(nodes[a // 3 * 3 + 1:a], '') || '*' ||
 array_to_string(nodes[a + 2:a // 3 * 3 + 3], '') ORDER BY part, level) AS way FROM climbs GROUP BY id, source)
SELECT l.doc_id, l.leaf, s.subroot, t.nodes[1] AS root, sha256(replace(array_to_string(coalesce(way, []), ''), '*', '')) AS proof_sha256,
 list_reduce(list_prepend(l.given, coalesce(way, [])), lambda h, w: sha256(replace(w, '*', h))) AS folded_root,
 list_reduce(list_prepend(l.given, coalesce(way, [])), lambda h, w: sha256(replace(w, '*', h))) = t.nodes[1] AS verified
FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source JOIN top t ON len(t.nodes) = 1
LEFT JOIN steps w ON w.id = l.pos AND w.source IS NOT DISTINCT FROM l.source"""


def _leaf_sql(text: str) -> str:
    return ", ".join(f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
                     for c in ("doc_id", "source", "lang", "n_chars", text))


# The checksum of a short ASCII text, by the table that _CRC works out.
_CRC_OF_ID = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(coalesce(doc_id, 0) AS VARCHAR), ''),
 lambda c: ascii(c)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"""


@query("op12_merkle_manifest", _MERKLE.replace("WITH RECURSIVE rows", "WITH RECURSIVE " + _CRC[5:_CRC.index("rows AS")].strip() + " rows").format(
    leaf=_leaf_sql("text"), tampered=_leaf_sql("replace(text, chr(10), '')"), crc=_CRC_OF_ID))
def op12_merkle_manifest(spark, sf):
    def leaf(text):
        return merkle.row_digest([F.col(c) for c in ("doc_id", "source", "lang", "n_chars")] + [text])
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    rows = table(spark, sf, "documents").select(
        F.col("source").alias("tree"), F.col("doc_id").alias("key"), leaf(F.col("text")).alias("leaf"),
        F.when(tampered, leaf(F.replace("text", F.lit("\n"), F.lit("")))).alias("given"))
    return merkle.manifest(rows).withColumnRenamed("key", "doc_id")


@query("op11_ranked_search", f"""
WITH docs AS (SELECT row_number() OVER () AS no, doc_id, coalesce({_TEST_WORDS}, []) AS w FROM documents),
sums AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM docs WHERE len(w) > 0),
asked AS (SELECT item_no, item_id, unnest(list_distinct({_TEST_WORDS})) AS term
 FROM (SELECT row_number() OVER () AS item_no, item_id, text FROM benchmark)),
counted AS (SELECT no, doc_id, len, term, count(*) AS tf FROM (SELECT no, doc_id, len(w) AS len, unnest(w) AS term FROM docs)
 SEMI JOIN asked USING (term) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counted, sums GROUP BY term, n_docs),
scored AS (SELECT item_no, item_id, doc_id,
 sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len * n_docs) // n_terms))))::BIGINT AS score
 FROM counted JOIN weights USING (term) JOIN asked USING (term), sums GROUP BY item_no, item_id, no, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10""")
def op11_ranked_search(spark, sf):
    return lexical.ranked_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k=10)


@query("op13_personal_field")
def op13_personal_field(spark, sf):
    docs = table(spark, sf, "documents")
    found = personal.find_personal(docs, personal.train(personal.sample_texts(docs)))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*personal.TYPES))
    return found.select("doc_id", *map(count, personal.TYPES), F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))
