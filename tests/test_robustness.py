"""Rows that tidy stand-ins do not have: gaps, odd numbers, other letter case, pages and files out of order."""

import datetime as dt
import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from carelake import schemas
from carelake.functions import advice, checks, replies
from carelake.operators import filters, vectors
from carelake.llm.common import staged_at
from carelake.plans import collection
from carelake.session import staged
from carelake.sources import dumps, envelope


@pytest.mark.parametrize("offset", [0, 1e4, 1e6])
def test_vectors_far_from_the_origin(offset):
    rng = np.random.default_rng(0)
    q, v = (rng.normal(size=(n, 32)) * 0.01 + offset for n in (30, 800))
    for i, ids, _ in vectors.block_best(q, v, np.arange(800), 5, "l2sq"):
        exact = vectors._precise(q[i], v, "l2sq")
        assert list(ids) == list(np.lexsort((np.arange(800), exact))[:5])


@pytest.mark.parametrize("few", [100, 1])
@pytest.mark.parametrize("metric", ["l2sq", "dot"])
def test_vectors_with_gaps_take_no_part(spark, metric, few):
    rows = [(i, [float(i), 1.0]) for i in range(30)] + [(90, None), (91, []), (92, [None, 1.0])]
    catalogue = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(0, [3.1, 1.0]), (1, None), (2, [8.0, 1.0])], "query_id long, embedding array<double>")
    got = vectors.similar(queries, catalogue, 2, metric, few=few, block_rows=4).collect()
    want = {0: {3, 4} if metric == "l2sq" else {28, 29}, 2: {7, 8} if metric == "l2sq" else {28, 29}}
    assert {q: {r.vec_id for r in got if r.query_id == q} for q in {r.query_id for r in got}} == want


def test_pruned_products_visit_few_clusters():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 4)) * 100
    least, far = vectors._reach(rng.normal(size=(5, 4)), centres, np.full(20, 0.1), "dot")
    assert (least <= far).all() and (np.sort(far, axis=1)[:, :1] < least).sum() > 50


def test_a_routed_query_is_one_row_however_many_clusters_it_visits():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    q, centres = rng.normal(size=(3000, 64)), rng.normal(size=(400, 64))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(3000)), pa.array(q.tolist())], names=["query_id", "embedding"])
    route = vectors._route(centres, np.full(400, 9.0), np.full(400, 300), 5, "l2sq")
    found = list(route([batch]))
    assert sum(b.num_rows for b in found) == 3000 and max(b.nbytes for b in found) < 4e6
    visits = np.unpackbits(np.frombuffer(b"".join(v for b in found for v in b.column("visits").to_pylist()), np.uint8))
    assert visits.reshape(3000, 400).mean() > 0.5  # these queries visit most clusters


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_block_search_with_many_equal_vectors(spark, metric):
    """As many equal vectors as several blocks hold; ids break the ties."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(300, 3))
    v[40:140] = v[40]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    asked = rows.selectExpr("vec_id + 1000 AS query_id", "embedding").where("vec_id % 3 = 0")
    got = {}
    for r in vectors.similar(asked, rows, 4, metric, few=2, block_rows=8).collect():
        got.setdefault(r.query_id - 1000, []).append((r["rank"], r.vec_id))
    for i in range(0, 300, 3):
        d = vectors._precise(v[i], v, metric)
        assert [x for _, x in sorted(got[i])] == np.lexsort((np.arange(300), d))[:4].tolist()
    assert len(got) == 100


def test_vectors_of_two_widths_are_refused():
    import pyarrow as pa
    with pytest.raises(ValueError, match="widths"):
        vectors._matrix(pa.array([[1.0], [1.0, 2.0]]))


def test_letter_case_never_counts(spark):
    people = spark.createDataFrame([(1, "A@b.org"), (2, "c@d.org"), (3, None)], "id int, email string")
    assert [r.id for r in filters.lookup(people, "email", "a@B.ORG").collect()] == [1]
    assert [r.id for r in filters.matching(people, {"email": "C@D.org"}).collect()] == [2]
    assert {r.id for r in filters.matching(people, {"email": ["a@b.org", "C@d.org"], "id": [1, 2, 9]}).collect()} == {1, 2}
    wanted = spark.createDataFrame([("A@B.ORG",), ("a@b.org",), (None,)], "w string")
    assert [r.id for r in filters.lookup_all(people, "email", wanted, "w").collect()] == [1]


def test_nulls_do_not_swallow_messages(values):
    drugs = [([("a", None), ("b", "m"), (None, "m")],)]
    message = advice.pharmacy_message(F.lit("d"), F.col("drugs"), F.lit(0))
    got = values(drugs, "drugs array<struct<item_name:string,entp_name:string>>", message)[0]
    assert "1. a ()" in got and "2. b (m)" in got and "3.  (m)" in got
    hospital = advice.hospital_message(F.lit("d"), F.col("score"), F.lit(None).cast("string"), F.lit(1))
    assert all("d" in m for m in values([(3,), (8,), (10,)], "score int", hospital))
    decision = replies.severity_decision(F.col("r"))
    found = values([('{"severity_score": 3, "recommendation": "pharmacy"}',)], "r string", decision)[0]
    assert found.parse_ok and found.reason


def test_readable_pages_may_hold_the_error_tag(spark):
    payload = json.dumps({"body": {"items": [{"name": f"x {envelope.ERROR_TAG}"}], "totalCount": 1}})
    pages = spark.createDataFrame([("s", 1, 10, payload), ("s", 2, 10, f"{envelope.ERROR_TAG} QUOTA")],
                                  "source string, page_no long, batch_size long, payload string")
    got = {r.page_no: (r.shape, r.error) for r in envelope.normalise(pages).collect()}
    assert got[1][1] is None and got[2] == ("xml_error", "xml")


def test_a_page_that_landed_twice_counts_once(spark):
    payload = json.dumps({"header": {"ok": 1}, "body": {"items": [{"a": 1}, {"a": 2}], "totalCount": 4}})
    schema = "source string, page_no long, batch_size long, payload string"
    twice = spark.createDataFrame([("s", 1, 2, payload), ("s", 1, 2, payload)], schema)
    got = envelope.completeness(envelope.normalise(twice)).first()
    assert (got.row_count, got.complete) == (2, False)


def emergency_page(spark, items, page_no=1, landed=None):
    payload = json.dumps({"header": {"ok": 1}, "body": {"items": items, "totalCount": len(items)}})
    return spark.createDataFrame([("e", page_no, 100, payload, landed)],
                                 "source string, page_no long, batch_size long, payload string, landed timestamp")


def test_newest_collection_wins_whatever_the_page_number(spark):
    key, old, new = schemas.KEYS["emergency"][0], dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    pages = emergency_page(spark, [{key.upper(): "A", "DUTY_NAME": "old"}], 9, old).union(
        emergency_page(spark, [{key.upper(): "A", "DUTY_NAME": "new"}], 1, new))
    empty = spark.createDataFrame([], schemas.schema("emergency"))
    got = collection.collect(empty, envelope.normalise(pages), "emergency", F.current_timestamp(), stop_rule=False).collect()
    assert [r.duty_name for r in got] == ["new"]


def test_unreadable_values_are_errors_and_overwrite_nothing(spark):
    key = schemas.KEYS["emergency"][0]
    number = next(f.name for f in schemas.schema("emergency").fields
                  if f.dataType.typeName() in ("double", "decimal") and f.name not in schemas.KEYS["emergency"])
    pages = envelope.normalise(emergency_page(spark, [
        {key.upper(): "A", number.upper(): "12x"}, {key.upper(): "B", number.upper(): "12.5"}]))
    rows = collection.typed_rows(pages, "emergency")
    bad = collection.quarantined_values(rows, "emergency").collect()
    assert [(r.table_name, r[key], r["name"], r["check"], r["text"]) for r in bad] == [("emergency", "A", number, "type", "12x")]
    assert [r[key] for r in collection.incoming_rows(pages, "emergency").collect()] == ["B"]
    empty = spark.createDataFrame([], schemas.schema("emergency"))
    counts = collection.collection_counts(empty, pages, "emergency").first()
    assert (counts.total_count, counts.saved_count, counts.error_count) == (2, 1, 1)


def test_checks_before_a_write(spark):
    pages = envelope.normalise(emergency_page(spark, [
        {"HPID": "A", "M_KIOSK_TY25": "Z"}, {"HPID": "B", "M_KIOSK_TY25": "Y"}, {"HPID": "C", "HVEC": "3.x", "M_KIOSK_TY1": "no"},
        {"HPID": "", "M_KIOSK_TY1": "N"}]))
    rows = collection.typed_rows(pages, "emergency")
    bad = {(r.hpid, r["name"], r["check"]) for r in collection.quarantined_values(rows, "emergency").collect()}
    assert bad == {("A", "m_kiosk_ty25", "allowed"), ("C", "hvec", "type"), ("C", "m_kiosk_ty1", "allowed")}
    assert {r.check: r.n for r in collection.error_counts(rows, "emergency").collect()} == {"allowed": 2, "type": 1, "required": 1}
    counts = collection.collection_counts(spark.createDataFrame([], schemas.schema("emergency")), pages, "emergency").first()
    assert (counts.total_count, counts.saved_count, counts.error_count) == (4, 1, 3)
    options = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 1.5), (4, -0.1), (5, None)], "id int, confidence double")
    assert sorted(r.id for r in checks.failing(options, "options", ["id"]).collect()) == [3, 4]
    logs = spark.createDataFrame([(1, "PHARMACY"), (2, "it's"), (3, None)], "log_id long, recommendation string")
    assert [(r.log_id, r.text) for r in checks.failing(logs, "symptom_logs", ["log_id"]).collect()] == [(2, "it's")]
    assert logs.where(checks.holds("symptom_logs", {"recommendation": "string"})).count() == 2


def test_dump_order_follows_the_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"title": "t", "text": "first"}\n')
    (tmp_path / "b.jsonl").write_text("".join(f'{{"title": "t", "text": "later {i} {"x" * 200}"}}\n' for i in range(300)))
    got = dumps.read_dump(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert len(got) == 301 and got[0].text == "first" and got[1].text.startswith("later 0 ")


def test_scratch_is_removed(spark):
    import os

    from carelake import session
    session.clean_scratch(spark)
    path = session.scratch_path(spark, "gone")
    session.staged(spark.range(3), "gone").count()
    spark.range(3).write.parquet(path)
    assert os.path.isdir(path) and session.clean_scratch(spark) == 2 and not os.path.exists(path)


@pytest.mark.parametrize("write", [staged, staged_at])
def test_staging_leaves_no_shuffle_files(spark, write):
    """Shuffle files go with the write that took them, not when the driver collects its garbage."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        names = (found.apply(i).getName() for i in range(found.size()))
        return {n for n in names if n.startswith("shuffle_")}

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = files(), spark.conf.get(setting)
    write(spark.range(5000).groupBy((F.col("id") % 991).alias("k")).agg(F.max("id").alias("m")), "no-shuffle-files")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get(setting) == was
