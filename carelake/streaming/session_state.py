"""Chat sessions as keyed streaming state.

Events ``(session_id, seq, at, kind, role, content, context, missing, reply)``:

* ``message``  appends to the history; a user message while facts are awaited
  is read as the answer (``reply``: age, is_pregnant, success as JSON),
* ``context``  merges facts, later values win,
* ``ask``      notes which facts are awaited (``missing``, comma-separated),
* ``close``    drops everything.

``seq`` counts the events of a session from 0 without gaps. An event is applied
when all before it have been, however files, runs and Arrow batches deal them
out; one that comes too early waits in state, but no longer than ``patience``:
then the missing ones are passed over (an output row ``skipped`` tells how
many) and what waits is applied. History goes to a list that is only appended
to, so a long session costs one write per message. Silence of ``ttl`` seconds
by event time drops the state when the next event arrives.

Timers free what nobody asks for any more. Deadlines are kept in state and
only ever move forward, whatever order events come in. By processing time, the
default, a session ends when it has been silent for ``ttl`` on the clock of the
stream; by event time when the watermark has passed its greatest event time by
``ttl``. At its end what still waits is applied and an output row ``expired`` is
given; the number of the next event stays for ``memory``, so that what lands
once more is told from what is new, and then goes as well: no key stays for
ever. An event that comes after that, and is not the first, waits as any other.

``history`` and ``context`` read the live state of a stream from its checkpoint.
"""

from __future__ import annotations

import json
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from carelake.operators.session_log import TTL_SECONDS
from carelake.operators.sessions import HISTORY_ENOUGH, USER_CHARS_ENOUGH, USER_MESSAGES_ENOUGH

EVENT_SCHEMA = ("session_id bigint, seq bigint, at timestamp, kind string, role string, content string, "
                "context map<string,string>, missing string, reply string")
OUTPUT = ("session_id bigint, seq bigint, kind string, outcome string, history_length bigint, "
          "context_size bigint, restarted boolean")
COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stage(messages: int, users: int, chars: int) -> str:
    """Stage of the next message after this much history."""
    if not messages:
        return "initial"
    if users >= USER_MESSAGES_ENOUGH and chars > USER_CHARS_ENOUGH:
        return "inferring"
    return "inferring" if messages >= HISTORY_ENOUGH else "collecting"


def read_answer(reply) -> dict | None:
    """Facts of a successful answer, else None."""
    try:
        facts = json.loads(reply)
        if not facts.get("success"):
            return None
        return {k: facts[k] for k in ("age", "is_pregnant") if facts.get(k) is not None}
    except (TypeError, ValueError, AttributeError):
        return None


class Event(NamedTuple):
    """One event as state holds it: time in microseconds, context as JSON."""

    us: int
    kind: str
    role: str | None
    content: str | None
    context: str | None
    missing: str | None
    reply: str | None


#: How much longer than its silence the number of a session's next event is kept.
MEMORY = 24
NONE = -1


class SessionProcessor(StatefulProcessor):
    """State of one session; events are applied in the order of ``seq``, whatever the order they come in."""

    def __init__(self, ttl_seconds: int = TTL_SECONDS, event_time: bool = False, patience_seconds: int | None = None):
        self.ttl_us, self.event_time = ttl_seconds * 1_000_000, event_time
        self.ttl_ms = ttl_seconds * 1000
        self.patience_ms = self.ttl_ms if patience_seconds is None else patience_seconds * 1000

    def init(self, handle):
        self.handle = handle
        self.counts = handle.getValueState("counts", "messages long, users long, chars long, last_us long, facts long")
        self.turn = handle.getValueState("turn", "seq long")
        self.early = handle.getMapState("early", "seq long", "us long, kind string, role string, content string, "
                                        "context string, missing string, reply string")
        self.history = handle.getListState("history", "seq long, role string, content string")
        self.context = handle.getMapState("context", "key string", "value string")
        self.waiting = handle.getValueState("waiting", "missing string")
        # When the session ends, when what waits is applied, and when the number of the next event goes.
        self.due = handle.getValueState("due", "silent long, gap long, forget long")

    def _drop(self):
        for state in (self.counts, self.history, self.context, self.waiting):
            state.clear()

    def handleInputRows(self, key, rows, timerValues):
        turn = self.turn.get()[0] if self.turn.exists() else 0
        silent, gap, _ = self.due.get() if self.due.exists() else (NONE, NONE, NONE)
        now = timerValues.getCurrentProcessingTimeInMs()
        for frame in rows:  # one Arrow batch at a time, in and out
            out = []
            for row in frame.sort_values("seq").itertuples(index=False):
                event = (row.at.value // 1000, row.kind, row.role, row.content,
                         json.dumps(dict(row.context)) if row.context is not None else None, row.missing, row.reply)
                seen = event[0] // 1000 if self.event_time else now
                silent = max(silent, seen + self.ttl_ms)  # an older event never moves it back
                if row.seq < turn:  # applied before: the same event once more
                    out.append((key[0], int(row.seq), row.kind, "repeated", None, None, False))
                    continue
                if row.seq > turn:
                    self.early.updateValue((int(row.seq),), event)
                    gap = seen + self.patience_ms if gap == NONE else min(gap, seen + self.patience_ms)
                    continue
                out.append(self._apply(key[0], turn, Event(*event)))
                turn = self._follow(key[0], turn + 1, out)
            yield pd.DataFrame(out, columns=COLUMNS)
        self.turn.update((turn,))
        self._set(silent, gap if any(True for _ in self.early.keys()) else NONE, NONE)

    def _follow(self, session, turn, out):
        """Apply what has waited for the event before it; gives the number of the next event."""
        while self.early.containsKey((turn,)):
            out.append(self._apply(session, turn, Event(*self.early.getValue((turn,)))))
            self.early.removeKey((turn,))
            turn += 1
        return turn

    def _pass_over(self, session, turn, out):
        """Give up on the events before the first one that waits."""
        first = min(seq for (seq,) in self.early.keys())
        held = self.counts.get() if self.counts.exists() else (0, 0, 0, 0, 0)
        out.append((session, turn, "skipped", str(first - turn), held[0], held[4], False))
        return self._follow(session, first, out)

    def _set(self, silent, gap, forget):
        """Keep the deadlines, and one timer at the first of them."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.due.update((silent, gap, forget))
        self.handle.registerTimer(min(t for t in (silent, gap, forget) if t != NONE))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """Pass over what is missing, or end the session, or let go of the last that is known of it."""
        silent, gap, forget = self.due.get() if self.due.exists() else (NONE, NONE, NONE)
        now, out = (timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()), []
        if forget != NONE:
            if forget <= now:
                self.turn.clear()
                self.due.clear()
            yield pd.DataFrame(out, columns=COLUMNS)
            return
        turn = self.turn.get()[0] if self.turn.exists() else 0
        while gap != NONE and gap <= now or silent <= now and any(True for _ in self.early.keys()):
            turn = self._pass_over(key[0], turn, out)
            rest = [self.early.getValue(k)[0] // 1000 if self.event_time else now for k in self.early.keys()]
            gap = min(rest) + self.patience_ms if rest else NONE
        self.turn.update((turn,))
        if silent <= now:
            self._drop()
            out.append((key[0], NONE, "expired", None, 0, 0, True))
            self._set(NONE, NONE, now + MEMORY * self.ttl_ms)
        else:
            self._set(silent, gap, NONE)
        yield pd.DataFrame(out, columns=COLUMNS)

    def _apply(self, session, seq, event):
        held = self.counts.get() if self.counts.exists() else (0, 0, 0, event.us, 0)
        messages, users, chars, last_us, facts = held
        restarted = self.counts.exists() and event.us - last_us >= self.ttl_us
        if restarted or event.kind == "close":
            self._drop()
            messages = users = chars = facts = 0
        outcome = None
        if event.kind == "message":
            if event.role == "user":
                outcome, more = self._answer(event)
                facts += more
            outcome = outcome or stage(messages, users, chars)
            self.history.appendValue((seq, event.role, event.content))
            messages += 1
            if event.role == "user":
                users, chars = users + 1, chars + len(event.content or "")
        elif event.kind == "context":
            facts += self._merge(json.loads(event.context or "{}"))
        elif event.kind == "ask":
            self.waiting.update((event.missing,))
        if event.kind != "close":
            self.counts.update((messages, users, chars, event.us, facts))
        return session, seq, event.kind, outcome, messages, facts, bool(restarted)

    def _merge(self, facts: dict) -> int:
        """Later values win; gives how many names are new, so that the facts need not be counted again."""
        fresh = 0
        for name, value in facts.items():
            fresh += not self.context.containsKey((name,))
            self.context.updateValue((name,), (value,))
        return fresh

    def _answer(self, event) -> tuple[str | None, int]:
        """A user message while facts are awaited: taken, or asked again; and how many facts are new."""
        if not self.waiting.exists():
            return None, 0
        facts = read_answer(event.reply)
        if facts is None:
            return "ask_again", 0
        fresh = self._merge({name: json.dumps(value) for name, value in facts.items()})
        self.waiting.clear()
        return "recommend", fresh

    def close(self):
        pass


def sessions(events: DataFrame, ttl_seconds: int = TTL_SECONDS, event_time: bool = False,
             patience_seconds: int | None = None) -> DataFrame:
    """One output row per event, and one per gap that is passed over and per session that ends.

    Needs the RocksDB state store (``state_session``). With ``event_time``
    sessions end behind a watermark of the time to live; events later than that
    are then left out, and their numbers are passed over.
    """
    if event_time:
        events = events.withWatermark("at", f"{ttl_seconds} seconds")
    return events.groupBy("session_id").transformWithStateInPandas(
        SessionProcessor(ttl_seconds, event_time, patience_seconds), OUTPUT, "Append",
        "EventTime" if event_time else "ProcessingTime")


def _state(spark: SparkSession, progress: str, name: str) -> DataFrame:
    """A state variable of the stream whose checkpoint is ``progress``, as its last finished run left it."""
    return spark.read.format("statestore").option("path", progress).option("stateVarName", name).load()


def _live(spark: SparkSession, progress: str, as_of: Column, ttl_seconds: int) -> DataFrame:
    """Sessions that have not been silent for the time to live. Their state goes when the next event or a timer comes."""
    counts = _state(state_session(spark), progress, "counts").select("key.session_id", "value.last_us")
    return counts.where(F.unix_micros(as_of) - F.col("last_us") < ttl_seconds * 1_000_000).select("session_id")


def history(spark: SparkSession, progress: str, as_of: Column, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """``session_id, seq, role, content``: the messages of the live sessions, read from the state of a stream."""
    live = _live(spark, progress, as_of, ttl_seconds)
    return _state(live.sparkSession, progress, "history").select("key.session_id", "list_element.*").join(live, "session_id")


def context(spark: SparkSession, progress: str, as_of: Column, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """``session_id, key, value``: the merged facts of the live sessions, read from the state of a stream."""
    live = _live(spark, progress, as_of, ttl_seconds)
    return _state(live.sparkSession, progress, "context").select(
        "key.session_id", F.col("user_map_key.key").alias("key"), F.col("user_map_value.value").alias("value")).join(
        live, "session_id")


def state_session(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A session beside ``spark`` with the RocksDB store and its own number of state partitions.

    That number is fixed by the first run of a stream: choose it for the cluster.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    if partitions:
        session.conf.set("spark.sql.shuffle.partitions", partitions)
    return session


def run(spark: SparkSession, events_path: str, out_path: str, progress: str,
        partitions: int | None = None, files_per_run: int = 1000, **options) -> None:
    """Take the event files that landed since the last call, append the outcomes, and stop.

    By processing time, timers that are due are served with the events of a
    call: a run without any would wait for the clock and never stop.
    """
    session = state_session(spark, partitions)
    session.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", bool(options.get("event_time")))
    events = session.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_run).parquet(events_path)
    (sessions(events, **options).writeStream.format("parquet").option("path", out_path)
     .option("checkpointLocation", progress).outputMode("append").trigger(availableNow=True)
     .start().awaitTermination())
