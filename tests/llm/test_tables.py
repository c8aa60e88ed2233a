"""Top-k, revisits, the pipeline and the registered queries on the smallest tables."""

import random

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import check
import corpus_pipeline
from carelake.llm import decontamination, linededup, pieces, topk, toxicity, warc
from carelake.llm.queries import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for name in check.TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    text, _, good = check.compare(spark, con, SF_DIR, name)
    assert good, text


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


# --- top-k ----------------------------------------------------------------------------------------------------------


def brute_top(vectors, queries, k):
    out = []
    for q, x in queries:
        scores = []
        for c, y in vectors:
            if c != q and len(x) == len(y):
                scores.append((-sum(int(a) * int(b) for a, b in zip(np.floor(np.float64(x) * 256), np.floor(np.float64(y) * 256))), c))
        out += [(q, r, c, -s) for r, (s, c) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("bins", "block"), [(2, 3), (1024, 1024)])
def test_top_k(spark, monkeypatch, bins, block):
    monkeypatch.setattr(topk, "BINS", bins)
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(120)]
    good += [(200 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(40)] + [(300, [1.0, 2.0]), (310, [2.0, 1.0]), (5, good[5][1])]
    bad = [(400, None), (410, []), (420, [1.0, None, 1.0, 1.0]), (430, [float("nan")] * 4), (440, [float("inf")] * 4),
           (None, [9.0, 9.0, 9.0, 9.0])]
    rows = [(i, v, "x", 1) for i, v in good + bad]
    random.Random(2).shuffle(rows)
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, row_no string, v int").repartition(3)
    found = topk.top_k(vectors, vectors.where("vec_id % 10 = 0"), 5, block_queries=block)
    assert found.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    got = sorted(tuple(r) for r in found.collect())
    assert got == brute_top(good, [g for g in good if g[0] % 10 == 0], 5)


def test_top_k_without_rows(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    one = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(none, none, 5).collect() == []
    assert topk.top_k(one, one, 5).collect() == []
    assert topk.top_k(one, none, 5).collect() == []


# --- revisits -------------------------------------------------------------------------------------------------------


def test_canonical_url(values):
    urls = {"https://WWW.A.org:443/x/?b=2&a=1&utm_source=f#top": "a.org/x?a=1&b=2", "http://a.org": "a.org",
            "http://a.org/": "a.org", "a.org/x": None, None: None, "": None, "http://m.a.org/x?gclid=3": "m.a.org/x"}
    import pyspark.sql.functions as F
    got = values([(u,) for u in urls], "u string", warc.canonical_url(F.col("u")))
    assert got == list(urls.values())


def brute_revisits(records):
    out = []
    for rec, url, at, kind, headers, digest in records:
        if kind != "revisit":
            continue
        own = {k: v for k, v in (headers or {}).items()}
        earlier = [r for r in records if r[3] == "response" and r[1] is not None and r[1] == url and at is not None
                   and r[2] is not None and r[2] < at]
        best = max(earlier, key=lambda r: (r[2], r[0]), default=None)
        if best is None:
            out.append((rec, "missing", None, None, own))
            continue
        stored = best[4] or {}
        if own.get("etag") is not None:
            same = own["etag"].removeprefix("W/") == (stored.get("etag") or "?").removeprefix("W/")
        elif own.get("last-modified") is not None:
            same = own["last-modified"] == stored.get("last-modified")
        else:
            out.append((rec, "unchecked", best[0], None, own))
            continue
        if not same:
            out.append((rec, "changed", best[0], None, own))
        else:
            newer = {k: v for k, v in own.items() if k in warc.PERMITTED}
            out.append((rec, "resolved", best[0], best[5], {**stored, **newer}))
    return out


@pytest.mark.parametrize("batch", [2, 10000])
def test_revisits(spark, batch):
    rng, records = random.Random(3), []
    for rec in range(400):
        hot = rng.random() < 0.4
        url = "http://hot.org/a" if hot else rng.choice([None, *(f"http://u{i}.org/x" for i in range(30))])
        kind = rng.choice(["response", "revisit", "revisit", "request"] if not hot else ["response", "revisit", "revisit"])
        headers = None if rng.random() < 0.1 else {k: v for k, v in {
            "etag": rng.choice([None, '"a"', 'W/"a"', '"b"']), "last-modified": rng.choice([None, "mon"]),
            "content-type": kind, "date": str(rec)}.items() if v is not None}
        records.append((rec, url, rng.choice([None, *range(60)]), kind, headers, f"d{rec}"))
    schema = "record long, url string, at long, kind string, headers map<string,string>, digest string"
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        table = spark.createDataFrame(records, schema).repartition(7)
        found = warc.resolve_revisits(table)
        got = sorted((r.record, r.outcome, r.response, r.digest, sorted(r.headers.items())) for r in found.collect())
        assert got == sorted((*r[:4], sorted(r[4].items())) for r in brute_revisits(records))
        bodies = warc.with_payload(found, table, "digest").count()
        assert bodies == len(got)
        assert warc.resolve_revisits(table.limit(0)).collect() == []
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


# --- pipeline -------------------------------------------------------------------------------------------------------


def test_pipeline_is_its_stages_by_brute_force(spark, con, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.train(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    rows = {i: t for i, t in rows.items() if model.past([model.score(set(toxicity.words_of((t or "").encode())))])[0, 0] <= 0.5}
    first, lines = {}, []
    for i in sorted(rows):
        for n, line in enumerate((rows[i] or "").split("\n")):
            if line.strip(" "):
                lines.append((i, n, line))
                first.setdefault(line, (i, n))
    by_size = {}
    for line in first:
        by_size.setdefault(len(line), []).append(line)
    near = set()
    for line, place in first.items():
        wide = linededup.allowed(len(line))
        for size in range(len(line) - wide, len(line) + wide + 1):
            for other in by_size.get(size, ()):
                most = linededup.allowed(min(len(line), size))
                if first[other] < place and most and linededup.edit_distance(line, other, most) <= most:
                    near.add(line)
    gone = {(i, n) for i, n, line in lines if first[line] != (i, n) or line in near}
    rows = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in rows.items()}
    sets = {}
    for i, t in rows.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[n:n + 5]) for n in range(max(1, len(w) - 4))} if w else set()

    def alike(a, b):
        return 5 * len(a & b) >= 4 * len(a | b)
    kept = {}
    for i in sorted(rows):  # grow groups from their smallest document
        group = {g for g, members in kept.items() if any(alike(sets[i], sets[m]) for m in members)}
        merged = [i] + [m for g in group for m in kept.pop(g)]
        kept[min(merged)] = merged
    rows = {i: rows[i] for i in kept}
    items = [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    wins = set()
    for text in items:
        w = decontamination.words_of((text or "").encode())
        wins |= {tuple(w[i:i + min(10, len(w))]) for i in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in wins}

    def clean(text):
        w = decontamination.words_of(text.encode())
        return not any(tuple(w[i:i + n]) in wins for n in sizes for i in range(len(w) - n + 1))
    rows = {i: t for i, t in rows.items() if clean(t)}
    encoder = pieces.Encoder(pieces.load_pieces())
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    assert set(got) == set(rows)
    assert all(got[i].exact and got[i].ids == list(encoder.encode(t)) for i, t in rows.items())


def test_stages_take_empty_tables_and_more_columns(spark, tmp_path):
    schema = spark.read.parquet(f"{SF_DIR}/documents.parquet").schema
    rows = [(None, None, None, None, None), (1, "", None, "s", 0), (1, "", None, "s", 0), (2, None, "en", None, None),
            (3, "a line that is long enough\nand more", "en", "s", 5)]
    for given in ([], rows):
        docs = spark.createDataFrame(given, schema).selectExpr("*", "'x' AS fp", "1 AS key", "2 AS grade")
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, docs, SF_DIR)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert found.columns == docs.columns, name
            path = str(tmp_path / f"{name}-{len(given)}")
            found.write.parquet(path)
            docs = spark.read.parquet(path)
        assert (docs.count() > 0) == bool(given)
