"""Session state from the full event log, as tables.

``events(session_id, seq, at, kind, ...)`` with kinds ``message``, ``context``
and ``close``. A session lives while events come less than ``ttl_seconds``
apart; a close event or a longer silence starts it anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.operators.sessions import inactivity_sessions

TTL_SECONDS = 3600


def live_from(events: DataFrame, as_of: Column, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """``session_id, from_us, closed_seq``: where the state of each live session begins.

    Silences come from slots and closes from a maximum, so a session with very
    many events is never gathered in one place. Expired sessions are absent.
    """
    spans = inactivity_sessions(events, "session_id", "at", ttl_seconds)
    last = spans.groupBy("session_id").agg(F.max("started_us").alias("from_us"), F.max("ended_us").alias("last_us"))
    closes = events.groupBy("session_id").agg(
        F.max(F.when(F.col("kind") == "close", F.col("seq"))).alias("closed_seq"))
    alive = F.unix_micros(as_of) - F.col("last_us") < ttl_seconds * 1_000_000
    return last.where(alive).join(closes, "session_id").drop("last_us")


def live_events(events: DataFrame, as_of: Column, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Events that still count: after the last close and the last long silence."""
    start = live_from(events, as_of, ttl_seconds)
    return events.join(start, "session_id").where(
        (F.unix_micros(F.col("at").cast("timestamp")) >= F.col("from_us"))
        & (F.col("closed_seq").isNull() | (F.col("seq") > F.col("closed_seq")))).drop("from_us", "closed_seq")


def live_history(events: DataFrame, as_of: Column, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Message history of the live sessions, one row per message."""
    return live_events(events, as_of, ttl_seconds).where("kind = 'message'")


def live_context(events: DataFrame, as_of: Column, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Merged context of the live sessions, one row per key: later values win."""
    entries = live_events(events, as_of, ttl_seconds).where("kind = 'context'").select(
        "session_id", "seq", F.explode("context").alias("key", "value"))
    return entries.groupBy("session_id", "key").agg(F.max_by("value", "seq").alias("value"))
