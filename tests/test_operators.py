"""Relational operators against plain Python on small frames."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from carelake.operators import (
    drug_safety, filters, nearby, numbering, redirects, rollups, session_log, sessions, upsert, vectors,
)
from carelake.operators.selection import select_drugs


def metres(a, b):
    (lat1, lon1), (lat2, lon2) = [(math.radians(x), math.radians(y)) for x, y in (a, b)]
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    return 2 * 6370986.0 * math.asin(min(1, math.sqrt(h)))


def brute_nearby(points, facilities, km, k, tiers=False):
    out = set()
    for p, plon, plat in points:
        rows = []
        for f, lon, lat, kind in facilities:
            if None not in (lon, lat, plon, plat):
                d = metres((plat, plon), (lat, lon)) / 1000
                tier = [t for t, w in ((1, "상급종합"), (2, "종합병원"), (3, "병원"), (4, "")) if w in kind][0] if tiers else 0
                if d <= km:
                    rows.append((tier, d, f))
        out |= {(p, f, n + 1) for n, (_, _, f) in enumerate(sorted(rows)[:k])}
    return out


def scattered(n, centre, spread, seed, copies=0):
    rng = random.Random(seed)
    kinds = ["상급종합병원", "종합병원", "병원", "의원"]
    rows = []
    for i in range(n):
        lat = centre[0] + rng.uniform(-spread, spread)
        lat = math.copysign(180 - abs(lat), lat) if abs(lat) > 90 else lat
        lon = (centre[1] + rng.uniform(-spread, spread) * (20 if abs(centre[0]) > 85 else 1) + 180) % 360 - 180
        rows.append((i, lon, lat, kinds[i % 4]))
    return rows + [(n + i, rows[0][1], rows[0][2], kinds[i % 4]) for i in range(copies)]


@pytest.mark.parametrize("centre", [(37.5, 127.0), (0.0, 180.0), (89.97, 10.0), (-89.99, 0.0)])
@pytest.mark.parametrize("order, levels", [("distance", None), ("tier", 1), ("distance", 3)])
def test_nearby_equals_brute_force(spark, centre, order, levels):
    facilities = scattered(120, centre, 0.08, 1, copies=60) + [(900, None, 37.5, "병원")]
    points = [(p, lon, lat) for p, lon, lat, _ in scattered(60, centre, 0.1, 2)] + [(99, None, None)]
    got = nearby.nearby_facilities(
        spark.createDataFrame(points, "point_id int, lon double, lat double"),
        spark.createDataFrame(facilities, "facility_id int, lon double, lat double, kind string"),
        5.0, 7, order=order, levels=levels)
    assert {(r.point_id, r.facility_id, r["rank"]) for r in got.collect()} == brute_nearby(
        points, facilities, 5.0, 7, order == "tier")


def test_nearby_hot_place(spark):
    """Nearly all facilities in one cube and one position, points just beside it."""
    facilities = scattered(200, (37.5, 127.0), 0.001, 3, copies=300) + [(950, 127.03, 37.5, "병원")]
    points = [(i, 127.0 + i * 0.002, 37.5) for i in range(20)]
    got = nearby.nearby_facilities(
        spark.createDataFrame(points, "point_id int, lon double, lat double"),
        spark.createDataFrame(facilities, "facility_id int, lon double, lat double, kind string"), 3.0, 5, levels=4)
    assert {(r.point_id, r.facility_id, r["rank"]) for r in got.collect()} == brute_nearby(points, facilities, 3.0, 5)
    assert nearby.busiest_cell(spark.createDataFrame(facilities, "facility_id int, lon double, lat double, kind string"),
                               3.0, 8) >= 50
    crowd = spark.range(3000).selectExpr("id AS facility_id", "127 + id / 1e7 AS lon", "37.5 AS lat")
    assert nearby.levels_for(crowd, 3.0) > 1


def test_prefer_open(spark):
    rows = [(1, 1, False), (1, 2, True), (2, 1, False), (2, 2, False), (2, 3, False), (2, 4, False)]
    got = nearby.prefer_open(spark.createDataFrame(rows, "point_id int, rank int, is_open boolean")).collect()
    assert sorted((r.point_id, r["rank"]) for r in got) == [(1, 2), (2, 1), (2, 2), (2, 3)]


def walk(edges, title):
    seen, cur = set(), title
    while cur in edges and cur not in seen:
        seen.add(cur)
        cur = edges[cur]
    return cur


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.dictionaries(st.integers(0, 25), st.integers(0, 28), min_size=1, max_size=24))
def test_redirects_equal_walk(spark, edges):
    got = redirects.resolve_chains(spark.createDataFrame(list(edges.items()), "src int, tgt int")).collect()
    assert {r.src: r.canonical for r in got} == {s: walk(edges, s) for s in edges}


@pytest.mark.parametrize(("seed", "local_rows"), [(1, 1), (2, 25)])
def test_redirects_contracted_in_rounds_equal_walk(spark, seed, local_rows):
    rng = np.random.default_rng(seed)
    edges = {i: i + 1 for i in range(30)}  # one long chain
    edges |= {200 + i: 200 + (i + 1) % 11 for i in range(11)} | {300: 300, 301: 302, 302: 301}  # cycles
    edges |= {400 + i: int(rng.choice([5, 20, 205, 210, 300, 302, 999, 400 + i + 1])) for i in range(20)}
    got = redirects.resolve_chains(spark.createDataFrame(list(edges.items()), "src int, tgt int").coalesce(2), local_rows).collect()
    assert {r.src: (r.tgt, r.canonical) for r in got} == {s: (t, walk(edges, s)) for s, t in edges.items()}
    assert {r.src for r in got if r.on_cycle} == set(range(200, 211)) | {300, 301, 302}


def test_redirect_shapes(spark):
    edges = {"a": "b", "b": "c", "c": "end", "self": "self", "x": "y", "y": "x", "tail": "x", "t2": "tail", "gone": "missing"}
    got = redirects.resolve_chains(spark.createDataFrame(list(edges.items()), "src string, tgt string")).collect()
    assert {r.src: r.canonical for r in got} == {
        "a": "end", "b": "end", "c": "end", "self": "self", "x": "x", "y": "y", "tail": "x", "t2": "x", "gone": "missing"}
    assert {r.src for r in got if r.on_cycle} == {"self", "x", "y"}


NOW, OLD = dt.datetime(2024, 2, 1), dt.datetime(2024, 1, 1)
STAMPED = "k string, a string, b string, created_at timestamp, updated_at timestamp"


def table(spark):
    return spark.createDataFrame(
        [("same", "1", "x", OLD, OLD), ("changed", "1", "x", OLD, OLD), ("filled", None, "x", OLD, OLD),
         ("cleared", "1", "x", OLD, OLD), ("loose", "1", "x", OLD, OLD), ("absent", "1", "x", OLD, OLD)], STAMPED)


INCOMING = [("same", "1", "x", 0), ("changed", "0", "x", 1), ("changed", "2", "x", 2), ("filled", "1", "x", 3),
            ("cleared", None, "x", 4), ("loose", "1", "y", 5), ("new", "1", "x", 6), ("", "1", "x", 7), (None, "1", "x", 8)]


def incoming(spark):
    return spark.createDataFrame(INCOMING, "k string, a string, b string, n int")


def stamp(t):
    return F.lit(str(t)).cast("timestamp")


def test_compare_and_upsert(spark):
    got = upsert.compare_and_upsert(table(spark), incoming(spark), ["k"], ["a"], "n", stamp(NOW)).collect()
    assert len(got) == 7
    assert {r.k: (r.action, r.a, r.b, r.created_at, r.updated_at) for r in got} == {
        "same": ("skipped", "1", "x", OLD, OLD), "changed": ("updated", "2", "x", OLD, NOW),
        "filled": ("updated", "1", "x", OLD, NOW), "cleared": ("updated", None, "x", OLD, NOW),
        "loose": ("skipped", "1", "x", OLD, OLD), "absent": ("kept", "1", "x", OLD, OLD),
        "new": ("saved", "1", "x", NOW, NOW)}


def test_upsert_is_idempotent(spark):
    once = upsert.upsert(table(spark), incoming(spark), ["k"], "n", stamp(NOW))
    twice = upsert.upsert(once, incoming(spark), ["k"], "n", stamp(NOW))
    assert sorted(once.collect()) == sorted(twice.collect())
    assert {r.k: r.b for r in once.collect()}["loose"] == "y"


def test_save_counts(spark):
    got = upsert.save_counts(table(spark), incoming(spark), ["k"], ["a"], "n").first().asDict()
    assert got == {"total_count": 9, "saved_count": 1, "updated_count": 3, "skipped_count": 2, "error_count": 2,
                   "superseded_count": 1}
    forced = upsert.save_counts(table(spark), incoming(spark), ["k"], ["a"], "n", force=True).first()
    assert (forced.updated_count, forced.skipped_count) == (5, 0)


def test_patch_and_delete(spark):
    patches = spark.createDataFrame(
        [("same", "9", None, False), ("changed", None, None, True), ("filled", None, None, False), ("nobody", "1", None, False)],
        "k string, a string, b string, set_b boolean")
    got = {r.k: (r.a, r.b, r.updated_at) for r in upsert.patch(table(spark), patches, ["k"], ["a", "b"], stamp(NOW)).collect()}
    assert got["same"] == ("9", "x", NOW) and got["changed"] == ("1", None, NOW) and got["filled"] == (None, "x", OLD)
    assert [r.k for r in upsert.unmatched(table(spark), patches, ["k"]).collect()] == ["nobody"]
    assert upsert.delete(table(spark), patches, ["k"]).count() == 3


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_vectors_few_and_blocks_equal_brute_force(spark, metric):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=(60, 6)), np.repeat(rng.normal(size=(1, 6)), 40, axis=0), rng.normal(3, .1, (50, 6))])
    q = np.concatenate([v[:20] + .01, v[70:75]])
    dot = q @ v.T
    norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None]
    d = {"l2sq": ((q[:, None] - v[None]) ** 2).sum(2), "cosine": 1 - dot / norms, "dot": -dot}[metric]
    want = {(i, int(j)) for i in range(len(q)) for j in np.lexsort((np.arange(len(v)), d[i].round(9)))[:6]}
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, embedding array<double>")
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    for few in (100, 3):
        got = vectors.similar(queries, rows, 6, metric, few=few, block_rows=16).collect()
        assert len(got) == len(want) == len({(r.query_id, r.vec_id) for r in got})
        assert {(r.query_id, r.vec_id) for r in got} == want, few


def candidates(spark):
    facts = [(None, None), (0, False), (64, True), (65, False), (65, True), (70, None)]
    rows = [(i, drug, age, pregnant) for i, (age, pregnant) in enumerate(facts) for drug in ("both", "preg", "old", "free")]
    return spark.createDataFrame(rows, "request_id int, item_seq string, user_age int, is_pregnant boolean")


def rules(spark):
    def rule(names):
        return spark.createDataFrame([(n, "t", "c") for n in names], "item_seq string, type_name string, prohbt_content string")
    return rule(["both", "preg", "preg"]), rule(["both", "old"])


def test_safety(spark):
    c, (pregnancy, elderly) = candidates(spark), rules(spark)
    safe = {}
    for r in drug_safety.safe_candidates(c, pregnancy, elderly).collect():
        safe.setdefault(r.request_id, set()).add(r.item_seq)
    every = {"both", "preg", "old", "free"}
    assert safe == {0: every, 1: every, 2: {"old", "free"}, 3: {"preg", "free"}, 4: {"free"}, 5: {"preg", "free"}}
    warned = drug_safety.warning_counts(c, pregnancy, elderly)
    kept = {(r.request_id, r.item_seq) for r in warned.where("NOT has_warnings").collect()}
    assert kept == {(i, d) for i, drugs in safe.items() for d in drugs}
    assert drug_safety.warning_rows(c, pregnancy, elderly).count() == warned.agg(
        F.sum(F.col("pregnancy_warnings") + F.col("elderly_warnings"))).first()[0]
    missing = {r.request_id: r.missing for r in drug_safety.missing_facts(c, pregnancy, elderly).collect()}
    assert missing == {0: ["age", "pregnancy"], 1: [], 2: [], 3: [], 4: [], 5: ["pregnancy"]}


def test_pairs_and_duplication(spark):
    lines = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (1, "c"), (2, "a"), (3, "b"), (3, "a")], "rx_id int, item_seq string")
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "z"), ("c", "c")], "item_seq string, mixture_item_seq string")
    got = drug_safety.pair_interactions(lines, pairs).collect()
    assert sorted((r.rx_id, r.item_seq, r.mixture_item_seq) for r in got) == [(1, "a", "b"), (3, "a", "b")]
    effects = spark.createDataFrame([("a", "e"), ("b", "e"), ("c", "f")], "item_seq string, effect_name string")
    got = drug_safety.therapeutic_duplication(lines, effects).collect()
    assert sorted((r.rx_id, r.effect_name, r.item_count) for r in got) == [(1, "e", 2), (3, "e", 2)]


def test_select_drugs(spark):
    shown = spark.createDataFrame([(1, n, f"d{n}") for n in range(1, 5)] + [(2, 1, "only")],
                                  "request_id int, shown_rank int, item_seq string")
    replies = spark.createDataFrame([(1, "[4, 2]")], "request_id int, reply string")
    got = select_drugs(shown, replies).collect()
    assert sorted((r.request_id, r.place, r.item_seq) for r in got) == [(1, 0, "d4"), (1, 1, "d2"), (2, 0, "only")]


def stage_rule(history):
    if not history:
        return "initial"
    users = [c for r, c in history if r == "user"]
    if len(users) >= 2 and sum(map(len, users)) > 30:
        return "inferring"
    return "inferring" if len(history) >= 6 else "collecting"


def test_stages(spark):
    chats = {
        1: [("user", "x" * 15), ("user", "x" * 15), ("user", "x"), ("user", "y")],
        2: [("user", "x" * 40), ("assistant", "a"), ("user", "x"), ("assistant", "b")],
        3: [("assistant", "z" * 50)] * 9, 4: [("user", "u")] * 8,
        5: [("user", "x" * 15), ("assistant", "q"), ("user", "x" * 16), ("assistant", "q")],
    }
    rows = [(s, t * 2, r, c) for s, chat in chats.items() for t, (r, c) in enumerate(chat)]
    got = sessions.stage_per_turn(spark.createDataFrame(rows, "session_id int, turn int, role string, content string"))
    assert {(r.session_id, r.turn): r.stage for r in got.collect()} == {
        (s, t * 2): stage_rule(chat[:t]) for s, chat in chats.items() for t in range(len(chat))}


def test_inactivity_sessions(spark):
    base = dt.datetime(2024, 1, 1, 0, 30, tzinfo=dt.timezone.utc)
    seconds = {"a": [0, 3599, 7198, 7198 + 3600, 20000], "b": [100]}
    rows = [(u, base + dt.timedelta(seconds=s)) for u, times in seconds.items() for s in times]
    got = sessions.inactivity_sessions(spark.createDataFrame(rows, "user_id string, ts timestamp")).collect()
    assert sorted((r.user_id, r.session_no, r.event_count) for r in got) == [("a", 1, 3), ("a", 2, 1), ("a", 3, 1), ("b", 1, 1)]


def test_live_sessions(spark):
    base = dt.datetime(2024, 1, 1)

    def at(s):
        return base + dt.timedelta(seconds=s)
    rows = [("open", 1, at(0), "message", "u", {}), ("open", 2, at(5000), "message", "u", {}),
            ("open", 3, at(5100), "context", None, {"a": "1", "b": "1"}), ("open", 4, at(5200), "context", None, {"a": "2"}),
            ("closed", 1, at(5000), "message", "u", {}), ("closed", 2, at(5001), "close", None, {}),
            ("closed", 3, at(5002), "message", "u", {}), ("silent", 1, at(100), "message", "u", {})]
    events = spark.createDataFrame(rows, "session_id string, seq int, at timestamp, kind string, role string, context map<string,string>")
    as_of = stamp(at(6000))
    assert sorted((r.session_id, r.seq) for r in session_log.live_history(events, as_of).collect()) == [("closed", 3), ("open", 2)]
    assert sorted((r.session_id, r.key, r.value) for r in session_log.live_context(events, as_of).collect()) == [
        ("open", "a", "2"), ("open", "b", "1")]


def test_numbering_spans_partitions(spark):
    rows = spark.range(5000).selectExpr("id", "CASE WHEN id % 10 = 0 THEN 'small' ELSE 'hot' END AS g")
    got = numbering.number_rows(rows.repartition(7), ["id"], ["g"]).collect()
    for g in ("small", "hot"):
        ids = sorted((r.id, r.row_no) for r in got if r.g == g)
        assert [n for _, n in ids] == list(range(len(ids)))


def test_filters(spark):
    drugs = spark.createDataFrame(
        [("1", "Head Pill", None, "c", "02", None), ("2", "other", "HEADacid", "c", "02", None),
         ("3", "head", None, "c", "01", None), ("4", "head", None, "c", "02", "gone"), ("5", "x", None, "c", "일반의약품", "정상")],
        "item_seq string, item_name string, material_name string, class_no string, etc_otc_code string, cancel_name string")
    assert [r.item_seq for r in filters.keyword_search(drugs, ["head"]).collect()] == ["1", "2"]
    assert filters.keyword_search(drugs, []).count() == 0
    assert [r.item_seq for r in filters.otc_catalogue(drugs).collect()] == ["5"]
    valid, rejected = filters.split_required(drugs, ["material_name"])
    assert (valid.count(), rejected.count()) == (1, 4)
    assert filters.any_match(drugs, {"item_name": "%pill"}).first()[0] is True
    assert [r.item_seq for r in filters.page(filters.ordered(drugs, "item_seq", "DESC"), 2, 2).collect()] == ["3", "2"]


def test_rollups(spark):
    rows = [("g", "a", 10, 1, 5, True), ("g", "b", 20, 2, 6, False), ("h", "a", None, 1, 1, True)]
    summary = rollups.run_summary(spark.createDataFrame(
        rows, "feed_group string, source string, processing_ms int, page_count int, row_count int, success boolean"))
    got = {(r.feed_group, r.source): (r.row_count, r.success) for r in summary.collect()}
    assert got[(None, None)] == (12, False) and got[("h", None)] == (1, True) and got[("g", None)] == (11, False)
