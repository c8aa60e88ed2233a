"""Chat sessions as tables: ``messages(session_id, turn, role, content)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# When enough is known to infer a disease.
HISTORY_ENOUGH = 6
USER_MESSAGES_ENOUGH = 2
USER_CHARS_ENOUGH = 30


def last_messages(messages: DataFrame, n: int = 3) -> DataFrame:
    """The last ``n`` messages of each session as ``role: content`` lines.

    The ranking keeps ``n`` rows per session and task before it shuffles, so
    the list that is built has at most ``n`` entries.
    """
    w = Window.partitionBy("session_id").orderBy(F.desc("turn"))
    line = F.concat("role", F.lit(": "), "content").alias("line")
    return (messages.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= n)
            .groupBy("session_id")
            .agg(F.sort_array(F.collect_list(F.struct("turn", line))).alias("lines"))
            .select("session_id", F.array_join(F.col("lines.line"), "\n").alias("recent")))


def stage_per_turn(messages: DataFrame) -> DataFrame:
    """``initial``, ``collecting`` or ``inferring`` for each message, by what came before it.

    A session never leaves ``inferring``, and reaches it after six messages at
    the latest. So the turn that starts it follows from the first six messages
    of the session, and the others only compare their turn with it: no window
    runs over a whole session.
    """
    w = Window.partitionBy("session_id").orderBy("turn")
    head = messages.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= HISTORY_ENOUGH)
    user = F.col("role") == "user"
    users = F.sum(F.when(user, 1).otherwise(0)).over(w)
    chars = F.sum(F.when(user, F.length("content")).otherwise(0)).over(w)
    enough = ((F.col("users") >= USER_MESSAGES_ENOUGH) & (F.col("chars") > USER_CHARS_ENOUGH)) \
        | (F.col("_at") >= HISTORY_ENOUGH)
    marks = (head.withColumns({"users": users, "chars": chars}).groupBy("session_id")
             .agg(F.min("turn").alias("first_turn"),
                  F.min(F.when(enough, F.col("turn"))).alias("enough_turn")))
    stage = (F.when(F.col("turn") == F.col("first_turn"), "initial")
             .when(F.col("turn") > F.col("enough_turn"), "inferring").otherwise("collecting"))
    return (messages.join(marks, "session_id")
            .select("session_id", "turn", "role", stage.alias("stage")))


def inference_text(messages: DataFrame, include_newest: bool = True) -> DataFrame:
    """User messages in order, the text a disease is inferred from; one row per message.

    Kept as rows: a session of any length stays spread over tasks.
    """
    user = messages.where(F.col("role") == "user").select("session_id", "turn", "content")
    if include_newest:
        return user
    newest = user.groupBy("session_id").agg(F.max("turn").alias("turn"))
    return user.join(newest, ["session_id", "turn"], "left_anti")


def result_options(messages: DataFrame) -> DataFrame:
    """For sessions that end in a recommendation, the disease chosen among the latest options.

    ``messages`` carry ``options array<struct<id,name,...>>`` and ``recommended``,
    the name of the recommended disease, null on every other message.
    """
    offered = F.size("options") > 0
    last = messages.groupBy("session_id").agg(
        F.max_by("recommended", "turn").alias("recommended"),
        F.max_by(F.when(offered, F.col("options")), F.when(offered, F.col("turn"))).alias("options"))
    named = F.get(F.filter("options", lambda d: d["name"] == F.col("recommended")), F.lit(0))
    chosen = F.coalesce(named, F.get("options", F.lit(0)))
    return (last.where(F.col("recommended").isNotNull() & F.col("options").isNotNull())
            .select("session_id", "recommended", chosen.alias("selected")))


def inactivity_sessions(events: DataFrame, key: str = "user_id", ts: str = "ts",
                        gap_seconds: int = 3600) -> DataFrame:
    """Sessions that end after ``gap_seconds`` without an event.

    Events of one key in the same slot of that length always share a session.
    They collapse to one row per slot before the shuffle, so a key with very
    many events is as short as its time span.
    """
    gap = gap_seconds * 1_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    slots = events.groupBy(key, F.floor(at / F.lit(gap)).alias("slot")).agg(
        F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key).orderBy("slot")
    opens = F.coalesce(F.col("first") - F.lag("last").over(w) >= gap, F.lit(True))
    numbered = slots.withColumn("opens", opens.cast("int")).withColumn("session_no", F.sum("opens").over(w))
    return numbered.groupBy(key, "session_no").agg(
        F.min("first").alias("started_us"), F.max("last").alias("ended_us"),
        F.sum("n").alias("event_count"))
