"""Feed envelopes, dumps, snapshots, logs and the disease plan."""

import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from carelake import schemas
from carelake.plans import collection, disease
from carelake.sources import dumps, envelope, snapshots

PAGES = "source string, page_no long, batch_size long, payload string"
ITEM = {"a_key": 1}


def page(payload, source="s", no=1, size=2):
    return (source, no, size, payload if isinstance(payload, str) else json.dumps(payload))


SHAPES = {
    "array": ([{"x": 1}, {"x": 2}], "array", 2, 2),
    "numeric keys": ({"10": {"x": 2}, "2": {"x": 1}}, "numeric_keys", 2, 2),
    "items array": ({"header": {}, "body": {"items": [ITEM], "totalCount": 7}}, "header", 1, 7),
    "item array": ({"header": {"c": 1}, "body": {"items": {"item": [ITEM, ITEM]}, "totalCount": "9"}}, "header", 2, 9),
    "item single": ({"header": {"c": 1}, "body": {"items": {"item": ITEM}}}, "header", 1, 0),
    "single object": ({"header": {"c": 1}, "body": {"items": ITEM, "totalCount": 1}}, "header", 1, 1),
    "no items": ({"header": {"c": 1}, "body": {"items": "", "totalCount": 0}}, "header", 0, 0),
    "response": ({"response": {"body": {"items": {"item": [ITEM]}, "totalCount": 3}}}, "response", 1, 3),
    "response single": ({"response": {"body": {"items": {"item": ITEM}, "totalCount": 1}}}, "response", 1, 1),
    "bare body": ({"body": {"items": {"item": ITEM}, "totalCount": 4}}, "body", 1, 4),
}
BROKEN = {
    "quota": "<OpenAPI_ServiceResponse>LIMITED_NUMBER_OF_SERVICE_REQUESTS_EXCEEDS_ERROR</OpenAPI_ServiceResponse>",
    "service": "<OpenAPI_ServiceResponse>SERVICE ERROR</OpenAPI_ServiceResponse>",
    "xml": "<OpenAPI_ServiceResponse>other</OpenAPI_ServiceResponse>",
    "unreadable": '{"header": {"c": 1}, "body": {"ite', "unsupported": {"data": []},
}


def test_envelope_shapes(spark):
    rows = [page(p, source=name) for name, (p, *_) in SHAPES.items()] + [page(p, source=e) for e, p in BROKEN.items()]
    normalised = envelope.normalise(spark.createDataFrame(rows, PAGES))
    got = {r.source: r for r in normalised.select("source", "shape", "error", "item_count", "total_count").collect()}
    for name, (_, shape, items, total) in SHAPES.items():
        assert (got[name].shape, got[name].error, got[name].item_count, got[name].total_count) == (shape, None, items, total), name
    assert {e: got[e].error for e in BROKEN} == {e: e for e in BROKEN}
    assert {r.error for r in envelope.quarantine(normalised).collect()} == set(BROKEN)
    order = envelope.item_rows(normalised).where("source = 'numeric keys'").select(
        "item_no", F.try_variant_get("item", "$.x", "int").alias("x")).collect()
    assert sorted((r.item_no, r.x) for r in order) == [(0, 1), (1, 2)]


def test_fields_and_unwrap(spark):
    items = [{"item": {"durSeq": "1", "MIX": "m"}}, {"item": {"durSeq": "", "DUR_SEQ": 2, "mix": None}}, {"item": {}}]
    normalised = envelope.normalise(spark.createDataFrame([page(items)], PAGES))
    got = envelope.fields(envelope.item_rows(normalised, unwrap=True), ["dur_seq", "mix"], ["item_no"]).collect()
    assert sorted((r.item_no, r.dur_seq, r.mix) for r in got) == [(0, "1", "m"), (1, "2", None), (2, None, None)]


def test_page_plan(spark):
    def body(n, total):
        return {"header": {"c": 1}, "body": {"items": [ITEM] * n, "totalCount": total}}
    rows = [page(body(2, 5), "full", 1), page(body(2, 5), "full", 2), page(body(1, 5), "full", 3), page(body(2, 5), "full", 4),
            page(body(2, 9), "gap", 1), page(body(2, 9), "gap", 3), page(body(2, 9), "short", 1), page(body(1, 9), "short", 2),
            page(body(2, 9), "broken", 1), page("oops", "broken", 2), page(body(2, 9), "broken", 3),
            page(body(2, 9), "empty", 1), page(body(0, 9), "empty", 2), page(body(2, 9), "late", 2)]
    normalised = envelope.normalise(spark.createDataFrame(rows, PAGES))
    got = {r.source: (r.page_count, r.row_count, r.complete) for r in envelope.completeness(normalised).collect()}
    assert got == {"full": (3, 5, True), "gap": (1, 2, False), "short": (2, 3, False), "broken": (1, 2, False),
                   "empty": (1, 2, False), "late": (0, 0, False)}
    capped = envelope.taken_pages(normalised, max_pages=2).where("source = 'full'")
    assert sorted(r.page_no for r in capped.collect()) == [1, 2]


def test_collect_facilities(spark):
    items = [{"hpid": "A", "dutyName": "new", "wgs84Lon": "127.5"}, {"hpid": "B", "dutyName": "b"}, {"hpid": "B", "dutyName": "b2"}]
    pages = envelope.normalise(spark.createDataFrame([page({"header": {"c": 1}, "body": {"items": items, "totalCount": 3}}, size=3)], PAGES))
    old = spark.createDataFrame([], schemas.schema("emergency"))
    now = F.lit("2024-02-01").cast("timestamp")
    got = collection.collect(old, pages, "emergency", now).collect()
    assert {(r.hpid, r.duty_name, r.action) for r in got} == {("A", "new", "saved"), ("B", "b2", "saved")}
    again = collection.collect(collection.collect(old, pages, "emergency", now).drop("action"), pages, "emergency", now)
    assert {r.action for r in again.collect()} == {"skipped"}


@pytest.mark.parametrize("name", schemas.COLUMNS)
def test_schemas(name):
    names = schemas.column_names(name)
    assert len(names) == len(set(names)) and set(schemas.KEYS[name]) <= set(names)
    assert set(schemas.COMPARED.get(name, [])) <= set(names)


def test_compared_columns():
    assert {t: len(c) for t, c in schemas.COMPARED.items()} == {"hospital": 29, "pharmacy": 14, "emergency": 5, "trauma": 5}
    assert len(schemas.UPSERTED) == 16


def test_read_dump(spark, tmp_path):
    lines = ['{"title": " A ", "text": "x"}', "", "{broken", '{"title": "", "text": "x"}', '{"title": "B", "text": "  "}',
             '{"title": "C", "text": "한글 y"}']
    plain, packed = tmp_path / "wiki_20240101.jsonl", tmp_path / "wiki_240102.jsonl.gz"
    plain.write_text("\n".join(lines), encoding="utf8")
    packed.write_bytes(gzip.compress("\n".join(lines).encode()))
    for path, snapshot in ((plain, "20240101"), (packed, "20240102")):
        got = dumps.read_dump(spark, str(path)).collect()
        assert [(r.title, r.text, r.snapshot) for r in got] == [("A", "x", snapshot), ("C", "한글 y", snapshot)]


def test_snapshots_refresh_whole(spark, tmp_path):
    base = str(tmp_path / "t")
    assert snapshots.latest_version(spark, base) is None
    for version, rows in ((1, 1200), (2, 700)):
        snapshots.write_snapshot(spark.range(rows), base, version)
    assert snapshots.latest_version(spark, base) == 2
    assert snapshots.read_snapshot(spark, base, 2).count() == 700


def test_append_log(spark, tmp_path):
    path = str(tmp_path / "l")
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 2))], "log_id int, created_at timestamp")
    with pytest.raises(ValueError):
        snapshots.read_log(spark, path)
    for batch in ("a", "b", "a"):  # the first job runs once more
        snapshots.append_log(rows, path, batch)
    got = snapshots.scan(spark, path, "SELECT log_id FROM {rows} WHERE log_date = :day", day="2024-01-02")
    assert [r.log_id for r in got.collect()] == [2, 2]
    assert sorted((r.batch, r.log_id) for r in snapshots.read_log(spark, path).collect()) == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]
    snapshots.append_log(rows, path, "lost")
    (tmp_path / "l" / "batch=lost" / "_SUCCESS").unlink()
    assert snapshots.read_log(spark, path).where("batch = 'lost'").count() == 0
    with pytest.raises(ValueError):
        snapshots.append_log(rows, path, "../elsewhere")


DUMP = [
    ("감기", "== 증상 ==\n'''콧물''' [[열|발열]]\n== 원인 ==\nvirus"), ("코감기", "#redirect [[감기]]"), ("고뿔", "#넘겨주기 코감기"),
    ("고뿔", "#redirect [[감기]]"), ("위염", "== 증상 ==\n\n== 치료 ==\nrest"), ("영화", "[[분류:영화]]\nplot"),
    ("독감", "[[분류:질병]]\n no sections"), ("x", "#redirect [[y]]"), ("y", "#redirect [[x]]"),
]


def test_disease_master(spark):
    dump = spark.createDataFrame([(t, x, i) for i, (t, x) in enumerate(DUMP)], "title string, text string, ordinal int")
    got = {r.canonical_title: r for r in disease.disease_master(dump, "wiki", "20240101")[0].collect()}
    assert set(got) == {"감기", "위염", "독감"}
    assert (got["감기"].common_name, got["감기"].alias_count, got["감기"].symptom_text) == ("고뿔", 2, "콧물 발열")
    assert got["위염"].symptom_text == "" and got["독감"].common_name is None


def test_alias_sets_are_one_row_each(spark):
    rows = spark.range(1000).selectExpr("'hot' AS canonical_title", "CAST(id AS STRING) AS alias").union(
        spark.sql("SELECT 'small', 'b'")).union(spark.sql("SELECT 'small', 'a'"))
    got = {r.canonical_title: r.aliases for r in disease.alias_sets(disease.alias_chunks(rows, 64)).collect()}
    assert got == {"hot": sorted(str(i) for i in range(1000)), "small": ["a", "b"]}


def test_a_title_with_very_many_aliases_spans_rows(spark):
    many = 300_000
    rows = spark.range(many).selectExpr("'hot' AS canonical_title", "format_string('%08d', id) AS alias").union(
        spark.sql("SELECT 'hot', '00000007'")).union(spark.sql("SELECT 'small', 'a'"))
    stored = disease.alias_chunks(rows, 1000)
    got = stored.selectExpr("canonical_title", "chunk", "size(aliases) AS n", "aliases[0] AS first").collect()
    hot = sorted((r.chunk, r.n, r.first) for r in got if r.canonical_title == "hot")
    assert hot == [(i, 1000, f"{i * 1000:08d}") for i in range(many // 1000)]
    assert [(r.chunk, r.n, r.first) for r in got if r.canonical_title == "small"] == [(0, 1, "a")]


def test_payloads_are_parsed_once(spark):
    pages = spark.createDataFrame([("s", 1, 2, '{"header": {"ok": 1}, "body": {"items": [{"a": 1}, {"a": 2}], "totalCount": 2}}')],
                                  "source string, page_no long, batch_size long, payload string")
    taken = envelope.taken_pages(envelope.normalise(pages))
    rows = envelope.item_rows(taken)
    assert "parse_json" not in rows._jdf.queryExecution().optimizedPlan().toString()  # what is parsed has been written
    assert rows.select(F.try_variant_get("item", "$.a", "int").alias("a")).collect() == [(1,), (2,)]


def test_scan_is_pushed_down(spark, tmp_path):
    spark.range(10).selectExpr("id", "id AS other", "id AS third").write.parquet(str(tmp_path / "p"))
    plan = snapshots.scan(spark, str(tmp_path / "p"), "SELECT id FROM {rows} WHERE other > :n", ["id", "other"], n=5)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(other,5)" in text and "third" not in text


def test_a_stored_index_is_asked_by_one_row_per_query(spark, tmp_path, monkeypatch):
    """However many clusters a query visits; the k best are those of brute force."""
    import numpy as np

    rng = np.random.default_rng(8)
    v = rng.normal(size=(400, 8))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    path, kept = str(tmp_path / "index"), []
    snapshots.write_vector_index(rows, path, "dot")
    stage = snapshots.staged
    monkeypatch.setattr(snapshots, "staged", lambda df, label: kept.append(stage(df, label)) or kept[-1])
    found = snapshots.search_vector_index(spark, path, rows.withColumnRenamed("vec_id", "query_id"), 3).collect()
    assert [df.count() for df in kept] == [400]
    got = {(r.query_id, r["rank"]): r.vec_id for r in found}
    best = np.argsort(-(v @ v.T), axis=1)[:, :3]
    assert got == {(i, j + 1): best[i, j] for i in range(400) for j in range(3)}
