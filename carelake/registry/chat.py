"""Chat messages, model replies, session state."""

from __future__ import annotations

from pyspark.sql import functions as F

from carelake.functions import advice, replies
from carelake.operators import rollups, session_log, sessions
from carelake.registry import query
from carelake.registry.standins import standin, table, with_sql
from carelake.session import scratch_path
from carelake.streaming import session_state

_MESSAGES = with_sql("messages")


@query("last_messages", _MESSAGES + """
, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS r FROM messages QUALIFY r <= 3)
SELECT session_id, string_agg(role || ': ' || content, chr(10) ORDER BY turn) AS recent FROM n GROUP BY 1""")
def last_messages(spark, sf):
    return sessions.last_messages(standin(spark, sf, "messages"))


@query("session_volume", _MESSAGES + """
SELECT session_id, count(*) FILTER (WHERE role = 'user') AS user_messages,
  CAST(coalesce(sum(length(content)) FILTER (WHERE role = 'user'), 0) AS BIGINT) AS user_chars
FROM messages GROUP BY 1""")
def session_volume(spark, sf):
    return rollups.session_volume(standin(spark, sf, "messages"))


@query("stage_per_turn", _MESSAGES + """
, h AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (WHERE role = 'user') OVER w AS u,
    coalesce(sum(length(content)) FILTER (WHERE role = 'user') OVER w, 0) AS c FROM messages
  WINDOW w AS (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT session_id, turn, role, CASE WHEN n = 0 THEN 'initial' WHEN u >= 2 AND c > 30 THEN 'inferring'
  WHEN n >= 6 THEN 'inferring' ELSE 'collecting' END AS stage FROM h""")
def stage_per_turn(spark, sf):
    return sessions.stage_per_turn(standin(spark, sf, "messages"))


@query("inference_texts", _MESSAGES + """
SELECT 'whole' AS scope, session_id, turn, md5(content) AS digest FROM messages WHERE role = 'user'
UNION ALL SELECT 'before_newest', session_id, turn, md5(content) FROM messages m WHERE role = 'user' AND turn <
 (SELECT max(turn) FROM messages x WHERE x.session_id = m.session_id AND role = 'user')""")
def inference_texts(spark, sf):
    rows = standin(spark, sf, "messages")

    def part(scope, newest):
        return sessions.inference_text(rows, newest).select(
            F.lit(scope).alias("scope"), "session_id", "turn", F.md5("content").alias("digest"))
    return part("whole", True).union(part("before_newest", False))


# Options on the assistant's turns; a recommended name on turns with a long text.
_OFFERS, _RECOMMENDED = "role = 'assistant'", "CASE WHEN length(content) > 120 THEN 'N' || CAST(turn - 2 AS VARCHAR(20)) END"


@query("chosen_options", _MESSAGES + f"""
, m AS (SELECT *, {_OFFERS} AS offers, {_RECOMMENDED} AS recommended FROM messages),
l AS (SELECT session_id, arg_max(struct_pack(r := recommended), turn).r AS recommended,
      max(turn) FILTER (WHERE offers) AS t FROM m GROUP BY 1)
SELECT session_id, recommended, CASE WHEN recommended = 'N' || CAST(t AS VARCHAR) THEN 'N' ELSE 'M' END
  || CAST(t AS VARCHAR) AS selected FROM l WHERE recommended IS NOT NULL AND t IS NOT NULL""")
def chosen_options(spark, sf):
    turn = F.col("turn").cast("string")

    def option(letter):
        return F.struct(F.concat(F.lit(letter.lower()), turn).alias("id"), F.concat(F.lit(letter), turn).alias("name"))
    offered = standin(spark, sf, "messages").withColumns({
        "options": F.when(F.expr(_OFFERS), F.array(option("M"), option("N"))), "recommended": F.expr(_RECOMMENDED)})
    return sessions.result_options(offered).select("session_id", "recommended", F.col("selected.name").alias("selected"))


@query("inactivity_sessions", """
WITH o AS (SELECT user_id, epoch_us(ts) AS t, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 3600000000, TRUE) AS opens
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS session_no FROM o)
SELECT user_id, CAST(session_no AS BIGINT) AS session_no, min(t) AS started_us, max(t) AS ended_us, count(*) AS event_count
FROM n GROUP BY user_id, session_no""")
def inactivity_sessions(spark, sf):
    return sessions.inactivity_sessions(table(spark, sf, "events"))


# ---- model replies ------------------------------------------------------------------------------

_SEVERITY = """CASE o_orderstatus WHEN 'F' THEN '```json' || chr(10) || '{"severity_score": ' || CAST(1 + o_orderkey % 10 AS VARCHAR(20))
  || ', "recommendation": "HOSPITAL", "reason": "r"}' || chr(10) || '```'
 WHEN 'O' THEN ' {"severity_score": ' || CAST(1 + o_orderkey % 10 AS VARCHAR(20)) || ', "recommendation": "PHARMACY", "reason": "s"} '
 ELSE CASE WHEN o_orderpriority = '5-LOW' THEN '{"severity_score": 7}' ELSE 'sorry' END END"""


# Fixed value: the wording of the default reason.
@query("severity_decisions", """
WITH s AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN 4 ELSE 1 + o_orderkey % 10 END AS severity_score FROM orders)
SELECT o_orderkey, severity_score, CASE o_orderstatus WHEN 'F' THEN 'HOSPITAL' ELSE 'PHARMACY' END AS recommendation,
  CASE o_orderstatus WHEN 'F' THEN 'r' WHEN 'O' THEN 's' ELSE '일반적인 증상으로 판단됩니다. 증상이 심해지면 병원을 방문하세요.' END AS reason,
  o_orderstatus <> 'P' AS parse_ok,
  CASE WHEN severity_score <= 5 THEN 'PHARMACY' WHEN severity_score <= 7 THEN 'PHARMACY_AND_VISIT' ELSE 'HOSPITAL' END AS band,
  CASE WHEN severity_score >= 9 THEN 'EMERGENCY' WHEN severity_score >= 8 THEN 'SEVERE' ELSE 'MODERATE' END AS tone
FROM s""")
def severity_decisions(spark, sf):
    decided = table(spark, sf, "orders", costly=True).select(
        "o_orderkey", replies.severity_decision(F.expr(_SEVERITY)).alias("d"))
    score = F.col("severity_score")
    return decided.select("o_orderkey", "d.*").select(
        "*", advice.triage_band(score).alias("band"), advice.message_tone(score).alias("tone"))


_DISEASES = """'```json{"diseases": [{"id": "d1", "name": "A' || CAST(p_size AS VARCHAR(20)) || '", "confidence": ' ||
 CAST(p_size AS VARCHAR(20)) || ', "symptoms": ["s1", "s2"]}, {"id": "d2", "name": "B", "confidence": 0.25, "symptoms": []}]}```'"""


@query("disease_options", """
SELECT p_partkey, 'A' || CAST(p_size AS VARCHAR) AS name,
  round(CASE WHEN p_size > 1 THEN p_size / 100.0 ELSE p_size END, 6)::DOUBLE AS confidence, 's1 s2' AS query_text,
  's1 / s2' AS log_text, 'B' AS other, 0.25::DOUBLE AS other_confidence FROM part""")
def disease_options(spark, sf):
    options = table(spark, sf, "part").select("p_partkey", replies.disease_options(F.expr(_DISEASES)).alias("o"))
    first, second = (replies.pick_by_id(F.col("o"), F.lit(i)) for i in ("d1", "d2"))
    return options.select(
        "p_partkey", first["name"].alias("name"), F.round(first["confidence"], 6).alias("confidence"),
        advice.query_text(first["symptoms"]).alias("query_text"),
        advice.query_text(first["symptoms"], " / ").alias("log_text"),
        second["name"].alias("other"), second["confidence"].alias("other_confidence"))


@query("fact_labels", with_sql("people") + """
SELECT id, CASE WHEN user_age IS NULL THEN '정보 없음' ELSE CAST(user_age AS VARCHAR) || '세' END AS age,
  CASE WHEN is_pregnant IS NULL THEN '정보 없음' WHEN is_pregnant THEN '예' ELSE '아니오' END AS pregnancy FROM people""")
def fact_labels(spark, sf):
    return standin(spark, sf, "people").select("id", advice.age_label(F.col("user_age")).alias("age"),
                                               advice.pregnancy_label(F.col("is_pregnant")).alias("pregnancy"))


# ---- session state ------------------------------------------------------------------------------

# Messages as timed events: a long silence in some sessions, context and close events, questions.
_EVENT = {
    "session_id": "conv_id", "seq": "turn",
    "at_s": "1704067200 + conv_id * 600 % 86400 + turn * 120 + CASE WHEN conv_id % 3 = 0 AND turn >= 3 THEN 7200 ELSE 0 END",
    "kind": "CASE WHEN role = 'system' THEN 'context' WHEN turn = 3 AND conv_id % 4 = 1 THEN 'close' "
            "WHEN role = 'assistant' AND conv_id % 5 = 2 THEN 'ask' ELSE 'message' END",
    "role": "role", "content": "text",
    "reply": "CASE WHEN length(text) % 2 = 0 THEN '{\"age\": 40, \"success\": true}' ELSE 'unclear' END",
}
_EVENTS = f"WITH ev AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _EVENT.items())} FROM conversations)"
_AS_OF = 1704067200 + 50_000  # sessions that fell silent an hour before are gone


def session_events(spark, sf):
    rows = table(spark, sf, "conversations").selectExpr(*[f"{e} AS {c}" for c, e in _EVENT.items()])
    context = F.create_map(F.lit("turn"), F.col("seq").cast("string"), F.lit("chars"), F.length("content").cast("string"))
    return rows.select(
        "session_id", "seq", F.timestamp_seconds("at_s").alias("at"), "kind", "role", "content",
        F.when(F.col("kind") == "context", context).alias("context"),
        F.when(F.col("kind") == "ask", "age").alias("missing"), "reply")


_SEGMENTS = _EVENTS + """,
g AS (SELECT *, coalesce(at_s - lag(at_s) OVER w >= 3600, FALSE) AS restarted,
        coalesce(lag(kind) OVER w = 'close', FALSE) AS reopened FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
s AS (SELECT *, sum((restarted OR reopened OR kind = 'close')::INT) OVER
        (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS seg FROM g)
"""


@query("streamed_sessions", _SEGMENTS + """,
h AS (SELECT *, count(*) FILTER (WHERE kind = 'message') OVER w AS n,
   count(*) FILTER (WHERE kind = 'message' AND role = 'user') OVER w AS u,
   coalesce(sum(length(content)) FILTER (WHERE kind = 'message' AND role = 'user') OVER w, 0) AS c,
   coalesce(last_value(CASE WHEN kind = 'ask' THEN TRUE WHEN kind = 'message' AND role = 'user' AND length(content) % 2 = 0
     THEN FALSE END IGNORE NULLS) OVER w, FALSE) AS waiting,
   count(*) FILTER (WHERE kind = 'context') OVER w AS cx FROM s
   WINDOW w AS (PARTITION BY session_id, seg ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT session_id, seq, kind,
  CASE WHEN kind <> 'message' THEN NULL
    WHEN role = 'user' AND waiting THEN CASE WHEN length(content) % 2 = 0 THEN 'recommend' ELSE 'ask_again' END
    WHEN n = 0 THEN 'initial' WHEN u >= 2 AND c > 30 OR n >= 6 THEN 'inferring' ELSE 'collecting' END AS outcome,
  CASE WHEN kind = 'close' THEN 0 WHEN kind = 'message' THEN n + 1 ELSE n END AS history_length,
  restarted AND NOT reopened AS restarted
FROM h""")
def streamed_sessions(spark, sf):
    """All events through the stateful stream, in two runs, dealt out over files without regard to their order."""
    landing, out, progress = (scratch_path(spark, p) for p in ("events", "outcomes", "progress"))
    rows = session_events(spark, sf)
    for part in ("seq % 3 = 1", "seq % 3 <> 1"):
        rows.where(part).repartition(spark.sparkContext.defaultParallelism, F.xxhash64("session_id", "seq")).write.mode(
            "append").parquet(landing)
        session_state.run(spark, landing, out, progress, partitions=spark.sparkContext.defaultParallelism)
    return spark.read.parquet(out).select("session_id", "seq", "kind", "outcome", "history_length", "restarted")


_LIVE = _SEGMENTS + f""",
z AS (SELECT *, max(seg) OVER (PARTITION BY session_id) AS last_seg, max(at_s) OVER (PARTITION BY session_id) AS last_s FROM s),
live AS (SELECT * FROM z WHERE seg = last_seg AND kind <> 'close' AND {_AS_OF} - last_s < 3600)
"""


@query("live_history", _LIVE + "SELECT session_id, seq, role, md5(content) AS digest FROM live WHERE kind = 'message'")
def live_history(spark, sf):
    rows = session_log.live_history(session_events(spark, sf), F.timestamp_seconds(F.lit(_AS_OF)))
    return rows.select("session_id", "seq", "role", F.md5("content").alias("digest"))


@query("live_context", _LIVE + """
, c AS (SELECT session_id, arg_max(content, seq) AS content, max(seq) AS seq FROM live WHERE kind = 'context' GROUP BY 1)
SELECT session_id, 'turn' AS key, CAST(seq AS VARCHAR) AS value FROM c
UNION ALL SELECT session_id, 'chars', CAST(length(content) AS VARCHAR) FROM c""")
def live_context(spark, sf):
    return session_log.live_context(session_events(spark, sf), F.timestamp_seconds(F.lit(_AS_OF)))


def _stream(spark, parts, **options):
    """Land and take each part of the events in turn; gives where the outcomes and the state are."""
    landing, out, progress = (scratch_path(spark, p) for p in ("events", "outcomes", "progress"))
    for part in parts:
        part.repartition(spark.sparkContext.defaultParallelism, F.xxhash64("session_id", "seq")).write.mode("append").parquet(landing)
        session_state.run(spark, landing, out, progress, partitions=spark.sparkContext.defaultParallelism, **options)
    return out, progress


@query("history_from_state", _LIVE + "SELECT session_id, seq, role, md5(content) AS digest FROM live WHERE kind = 'message'")
def history_from_state(spark, sf):
    """The same as ``live_history``, read from the state that the stream left in its checkpoint."""
    rows = session_events(spark, sf)
    _, progress = _stream(spark, [rows.where("seq % 3 = 1"), rows.where("seq % 3 <> 1")])
    found = session_state.history(spark, progress, F.timestamp_seconds(F.lit(_AS_OF)))
    return found.select("session_id", "seq", "role", F.md5("content").alias("digest"))


@query("context_from_state", _LIVE + """
, c AS (SELECT session_id, arg_max(content, seq) AS content, max(seq) AS seq FROM live WHERE kind = 'context' GROUP BY 1)
SELECT session_id, 'turn' AS key, CAST(seq AS VARCHAR) AS value FROM c
UNION ALL SELECT session_id, 'chars', CAST(length(content) AS VARCHAR) FROM c""")
def context_from_state(spark, sf):
    """Facts of context events, read from the state; facts that answers gave stand beside them there."""
    _, progress = _stream(spark, [session_events(spark, sf)])
    return session_state.context(spark, progress, F.timestamp_seconds(F.lit(_AS_OF))).where("key <> 'age'")


_MISSING, _LATE = "session_id % 7 = 0 AND seq = 1", "session_id % 11 = 0 AND seq = 2"


@query("expired_sessions", _EVENTS + f""",
landed AS (SELECT * FROM ev WHERE NOT ({_MISSING})),
mark AS (SELECT max(at_s) - 3600 AS at FROM landed WHERE NOT ({_LATE})),
taken AS (SELECT * FROM landed, mark WHERE NOT ({_LATE}) OR at_s > mark.at)
SELECT session_id, 1 AS expired, max(seq) + 1 - count(*) AS skipped, count(*) AS applied FROM taken GROUP BY session_id""")
def expired_sessions(spark, sf):
    """Sessions that end by event time, some with events that never land, some with late ones; a last event far ahead ends all."""
    rows = session_events(spark, sf).where(f"NOT ({_MISSING})")
    last = rows.limit(1).select(*[F.lit(-1).cast("bigint").alias("session_id") if c == "session_id" else
                                  F.lit(0).cast(rows.schema[c].dataType).alias(c) if c == "seq" else
                                  F.lit("2024-02-01 00:00:00").cast("timestamp").alias(c) if c == "at" else c for c in rows.columns])
    out, _ = _stream(spark, [rows.where(f"NOT ({_LATE})"), rows.where(_LATE), last], event_time=True)

    def count(condition):
        return F.count(F.when(F.expr(condition), 1))
    return spark.read.parquet(out).where("session_id >= 0").groupBy("session_id").agg(
        count("kind = 'expired'").cast("int").alias("expired"),
        F.coalesce(F.sum(F.when(F.col("kind") == "skipped", F.col("outcome").cast("long"))), F.lit(0)).alias("skipped"),
        count("kind NOT IN ('expired', 'skipped')").alias("applied"))
