"""Session state and re-collection as streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from carelake.streaming import session_state

BASE = dt.datetime(2024, 1, 1)


def event(session, seq, at, kind="message", role="user", content="hello there, ten", context=None, missing=None, reply=None):
    return (session, seq, BASE + dt.timedelta(seconds=at), kind, role, content, context, missing, reply)


EVENTS = [
    event(1, 0, 0), event(1, 1, 10, role="assistant"), event(1, 2, 20), event(1, 3, 30),
    event(1, 4, 3629, role="assistant"), event(1, 5, 3629 + 3600),
    event(2, 0, 0, kind="context", context={"a": "1", "b": "1"}), event(2, 1, 5, kind="context", context={"a": "2"}),
    event(2, 2, 6, kind="ask", missing="age"), event(2, 3, 7, reply="what?"), event(2, 4, 8, reply='{"success": false}'),
    event(2, 5, 9, reply='{"age": 40, "success": true}'), event(2, 6, 10),
    event(3, 0, 0), event(3, 1, 1, kind="close"), event(3, 2, 2), event(3, 3, 4000),
]
WANT = {
    (1, 0): ("initial", 1, False), (1, 1): ("collecting", 2, False), (1, 2): ("collecting", 3, False),
    (1, 3): ("inferring", 4, False), (1, 4): ("inferring", 5, False), (1, 5): ("initial", 1, True),
    (2, 0): (None, 0, False), (2, 1): (None, 0, False), (2, 2): (None, 0, False), (2, 3): ("ask_again", 1, False),
    (2, 4): ("ask_again", 2, False), (2, 5): ("recommend", 3, False), (2, 6): ("inferring", 4, False),
    (3, 0): ("initial", 1, False), (3, 1): (None, 0, False), (3, 2): ("initial", 1, False), (3, 3): ("initial", 1, True),
}


def outcomes(spark, tmp_path, parts, **options):
    landing, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for part in parts:
        spark.createDataFrame(part, session_state.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(landing)
        session_state.run(spark, landing, out, progress, partitions=2, **options)
    return spark.read.parquet(out).collect()


@pytest.mark.parametrize("cut", [(), (3,), (1, 2, 4)])
def test_one_or_many_runs_agree(spark, tmp_path, cut):
    edges = [0, *cut, 99]
    parts = [[e for e in EVENTS if lo <= e[1] < hi] for lo, hi in zip(edges, edges[1:])]
    rows = outcomes(spark, tmp_path, parts)
    assert {(r.session_id, r.seq): (r.outcome, r.history_length, r.restarted) for r in rows} == WANT
    assert {r.seq: r.context_size for r in rows if r.session_id == 2} == {0: 2, 1: 2, 2: 2, 3: 2, 4: 2, 5: 3, 6: 3}


@pytest.mark.parametrize("batch", [3, 10000])
def test_order_of_landing_changes_nothing(spark, tmp_path, batch, monkeypatch):
    """Events land backwards, odd ones first, and are read in small or large Arrow batches."""
    def with_batches(session, partitions=None, make=session_state.state_session):
        made = make(session, partitions)
        made.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        return made
    monkeypatch.setattr(session_state, "state_session", with_batches)
    parts = [[e for e in reversed(EVENTS) if e[1] % 2], [e for e in reversed(EVENTS) if not e[1] % 2]]
    rows = outcomes(spark, tmp_path, parts)
    assert {(r.session_id, r.seq): (r.outcome, r.history_length, r.restarted) for r in rows} == WANT
    assert {r.seq: r.context_size for r in rows if r.session_id == 2} == {0: 2, 1: 2, 2: 2, 3: 2, 4: 2, 5: 3, 6: 3}


def test_an_event_that_lands_twice_is_applied_once(spark, tmp_path):
    one = [e for e in EVENTS if e[0] == 1][:3]
    rows = outcomes(spark, tmp_path, [one, one[1:2]])
    assert sorted((r.seq, r.outcome) for r in rows) == [
        (0, "initial"), (1, "collecting"), (1, "repeated"), (2, "collecting")]


def test_long_ttl_keeps_state(spark, tmp_path):
    """The control: with a long time to live nothing restarts."""
    rows = outcomes(spark, tmp_path, [[e for e in EVENTS if e[0] == 1][:5], [e for e in EVENTS if e[0] == 1][5:]],
                    ttl_seconds=100_000)
    assert max(r.history_length for r in rows) == 6 and not any(r.restarted for r in rows)


def test_event_time_timer_frees_silent_sessions(spark, tmp_path):
    early, late = [event(7, 0, 0)], [event(8, 0, 20_000)]
    rows = outcomes(spark, tmp_path, [early, late, [event(8, 1, 20_001)]], event_time=True)
    assert (7, "expired") in {(r.session_id, r.kind) for r in rows}
    assert {(r.session_id, r.seq) for r in rows if r.kind == "message"} == {(7, 0), (8, 0), (8, 1)}


def test_an_older_event_never_moves_the_end_back(spark, tmp_path):
    """Behind the watermark of the first run the older event still counts; the session ends by its newest one."""
    parts = [[event(7, 1, 5000), event(8, 0, 8000)], [event(7, 0, 4500)], [event(8, 1, 12_100)], [event(8, 2, 12_300)]]
    rows = outcomes(spark, tmp_path, parts[:3], event_time=True)
    assert (7, "expired") not in {(r.session_id, r.kind) for r in rows}  # 8100 and 8500 < 5000 + 3600: not by either
    assert {(r.session_id, r.seq) for r in rows if r.kind == "message"} == {(7, 0), (7, 1), (8, 0), (8, 1)}
    progress, landing, out = (str(tmp_path / n) for n in ("progress", "in", "out"))
    spark.createDataFrame(parts[3], session_state.EVENT_SCHEMA).write.mode("append").parquet(landing)
    session_state.run(spark, landing, out, progress, partitions=2, event_time=True)
    assert [r.kind for r in spark.read.parquet(out).collect() if r.session_id == 7].count("expired") == 1


def test_a_missing_event_is_passed_over_by_event_time(spark, tmp_path):
    parts = [[event(7, 0, 0), event(7, 2, 20), event(7, 3, 30), event(7, 6, 60)], [event(8, 0, 3000)], [event(8, 1, 4000)],
             [event(7, 1, 3900), event(8, 2, 4100)]]
    rows = outcomes(spark, tmp_path, parts, event_time=True, patience_seconds=60)
    own = [r for r in rows if r.session_id == 7]
    assert sorted((r.seq, r.kind, r.outcome) for r in own) == [
        (0, "message", "initial"), (1, "message", "repeated"), (1, "skipped", "1"), (2, "message", "collecting"),
        (3, "message", "inferring"), (4, "skipped", "2"), (6, "message", "inferring")]


def test_by_processing_time_state_is_freed(spark, tmp_path):
    import time
    rows = outcomes(spark, tmp_path, [[event(7, 0, 0), event(7, 2, 20)]], ttl_seconds=4, patience_seconds=2)
    assert {(r.seq, r.kind) for r in rows} == {(0, "message")}  # the third waits for the second
    time.sleep(2)
    rows = outcomes(spark, tmp_path, [[event(8, 0, 0)]], ttl_seconds=4, patience_seconds=2)
    time.sleep(5)
    rows = outcomes(spark, tmp_path, [[event(8, 1, 1)]], ttl_seconds=4, patience_seconds=2)
    kinds = [(r.session_id, r.seq, r.kind) for r in rows]
    assert (7, 1, "skipped") in kinds and (7, 2, "message") in kinds and (7, -1, "expired") in kinds
    state = session_state.state_session(spark)
    for name in ("history", "counts", "context", "early"):
        held = session_state._state(state, str(tmp_path / "progress"), name).select("key.session_id").collect()
        assert 7 not in {r.session_id for r in held}, name


def test_after_its_memory_nothing_of_a_session_is_left(spark, tmp_path):
    day = 24 * 3600
    outcomes(spark, tmp_path, [[event(7, 0, 0)], [event(8, 0, 10_000)], [event(8, 1, 20_000 + day)], [event(8, 2, 40_000 + day)]],
             event_time=True)
    state = session_state.state_session(spark)
    for name in ("turn", "due", "history", "counts"):
        held = session_state._state(state, str(tmp_path / "progress"), name).select("key.session_id").collect()
        assert {r.session_id for r in held} <= {8}, name


def test_history_and_context_come_from_state(spark, tmp_path):
    outcomes(spark, tmp_path, [[e for e in EVENTS if e[1] < 3], [e for e in EVENTS if e[1] >= 3]])
    progress = str(tmp_path / "progress")
    at = F.lit(str(BASE + dt.timedelta(seconds=3500))).cast("timestamp")
    got = session_state.history(spark, progress, at).collect()
    assert sorted((r.session_id, r.seq) for r in got) == [(1, 5), (2, 3), (2, 4), (2, 5), (2, 6), (3, 3)]
    facts = {(r.session_id, r.key): r.value for r in session_state.context(spark, progress, at).collect()}
    assert facts == {(2, "a"): "2", (2, "b"): "1", (2, "age"): "40"}
    late = F.lit(str(BASE + dt.timedelta(days=1))).cast("timestamp")
    assert session_state.history(spark, progress, late).count() == 0


def test_landed_pages_are_read_a_few_at_a_time(spark, tmp_path, monkeypatch):
    """More text in one file than a column of one batch of 4 096 rows can hold."""
    from carelake.streaming import recollect

    size, pages = 1 << 22, 600
    spark.range(0, pages, 1, 1).selectExpr(
        "'s' AS source", "id AS page_no", "50L AS batch_size", f"repeat(' ', {size}) AS payload",
        "timestamp '2024-01-01 00:00:00' AS landed").write.parquet(str(tmp_path / "landing"))
    taken = []
    monkeypatch.setattr(recollect, "normalise", lambda batch: batch.selectExpr("page_no", "length(payload) AS n"))
    monkeypatch.setattr(recollect, "collect_into", lambda spark, base, rows, *rest, **named: taken.append(
        (tuple(rows.selectExpr("count(*)", "sum(n)").first()), spark.conf.get(recollect.READ_ROWS))))
    usual = spark.conf.get(recollect.READ_ROWS)
    recollect.run(spark, str(tmp_path / "landing"), "base", "emergency", None, "c", str(tmp_path / "progress"))
    assert taken == [((pages, pages * size), usual)] and spark.conf.get(recollect.READ_ROWS) == usual
