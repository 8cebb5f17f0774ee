"""Structured Streaming jobs: the batch rules over readStream sources. Late rows beyond the watermark are dropped,
unlike in the batch operators.

Jobs with state of their own (flights, accumulated) keep the rows of a key until the watermark has passed them and only then hand them to the rules, in order of time: rows
may come in any order within the watermark's delay and in any batches (T20), the result is that of the batch operator. A key has one timer, at the
next moment that matters: a waiting row, a flight that ends by silence, or the end of the state's life, when all of it is cleared (T5)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import sessions as rules
from ..operators import transponder


def once(stream: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """K1: redelivered rows are dropped within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def hourly(stream: DataFrame, time: str = "received_at", delay: str = "10 minutes") -> DataFrame:
    """Tumbling hours."""
    windows = stream.withWatermark(time, delay).groupBy(F.window(time, "1 hour").alias("w"), "receiver_id")
    return windows.agg(F.count("*").alias("n_fixes")).select(F.col("w.start").alias("hour"), "receiver_id", "n_fixes")


def sessions(stream: DataFrame, gap: str = "30 minutes", time: str = "received_at", delay: str = "10 minutes") -> DataFrame:
    """Plain gaps, without the rules of flights."""
    w = F.session_window(time, gap)
    return stream.withWatermark(time, delay).groupBy("aircraft_id", w.alias("w")).agg(F.count("*").alias("n_fixes")).select("aircraft_id", F.col("w.start").alias("first"), F.col("w.end").alias("end"), "n_fixes")


def _stateful(stream: DataFrame) -> None:
    """State of one's own needs this store; it holds on disk what does not fit in memory."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Ordered(StatefulProcessor):
    """Keeps rows until the watermark has passed them; a subclass says what to do with them, and when it needs to be woken without any."""

    #: Columns of a row that waits: seconds first, then what orders rows of one time; SQL types of all.
    WAITING: dict[str, str]
    EMPTY: pd.DataFrame

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(f"{c} {kind}" for c, kind in self.WAITING.items()))
        self.state = handle.getValueState("state", "state string")

    def released(self, key: object, state: str | None, rows: list[tuple], now: float) -> tuple[str | None, pd.DataFrame]:
        """The new state, null to forget the key, and rows to put out; now: seconds that the watermark has passed."""
        raise NotImplementedError

    def wakes(self, state: str | None) -> float | None:
        """Seconds at which released() is called without rows."""
        raise NotImplementedError

    def _timer(self, state: str | None, first: float | None) -> None:
        at = [x for x in (first, self.wakes(state)) if x is not None]
        due = math.ceil(min(at) * 1000) if at else None
        for t in list(self.handle.listTimers()):
            if (t[0] if isinstance(t, tuple) else t) != due:
                self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        if due is not None:
            self.handle.registerTimer(due)

    def _state(self) -> str | None:
        return self.state.get()[0] if self.state.exists() else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        came = [tuple(None if isinstance(x, float) and math.isnan(x) else x for x in r) for pdf in rows for r in pdf[list(self.WAITING)].astype(object).itertuples(index=False)]
        self.waiting.appendList(came)
        first = min((r[0] for r in self.waiting.get()), default=None)
        self._timer(self._state(), first)
        yield self.EMPTY

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        now = timerValues.getCurrentWatermarkInMs() / 1000
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready, rest = [r for r in held if r[0] <= now], [r for r in held if r[0] > now]
        state, out = self.released(key[0], self._state(), sorted(ready, key=lambda r: r[:2]), now)
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        if state is None:
            self.state.clear()
        else:
            self.state.update((state,))
        self._timer(state, min((r[0] for r in rest), default=None))
        yield out

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: ANN001, N802, N803
        """Goes on from a table (key, state)."""
        state = str(initialState["state"].iloc[0])
        self.state.update((state,))
        self._timer(state, None)

    def close(self) -> None:
        pass


class FlightProcessor(Ordered):
    """The batch tracker. A silent flight is closed when no later fix could continue it (``GAP_ALWAYS``), so that batches do not matter;
    an aircraft is forgotten ``STALE`` seconds after its last fix, and its flights are then numbered from 1 again."""

    WAITING = {"t": "double", "fix_id": "long", **dict.fromkeys(rules.INPUT[1:], "double"), **rules.MAYBE}
    EMPTY = rules.frame(0, [])

    def released(self, key, state, rows, now):  # noqa: ANN001, ANN201
        tracker = rules.Tracker.from_json(state)
        closed = [f for t, _, *row in rows for f in tracker.feed(t, *row)]
        if tracker.open and tracker.last and now - tracker.last[0] > rules.GAP_ALWAYS:
            closed.append(tracker.close(timed_out=True))
        over = not tracker.open and tracker.last is not None and now - tracker.last[0] > rules.STALE
        return None if over else tracker.to_json(), rules.frame(key, closed)

    def wakes(self, state):  # noqa: ANN001, ANN201
        tracker = rules.Tracker.from_json(state)
        if tracker.last is None:
            return None
        return tracker.last[0] + (rules.GAP_ALWAYS if tracker.open else rules.STALE) + 0.001


def flights(stream: DataFrame, delay: str = "10 minutes", before: DataFrame | None = None) -> DataFrame:
    """Flights as they close. before: (aircraft_id, state) of ``sessions.states`` or ``sessions.orphans``, where a new query goes on."""
    _stateful(stream)
    source = rules.prepared(stream.withWatermark("received_at", delay), "received_at")
    held = None if before is None else before.select("aircraft_id", "state").groupBy("aircraft_id")
    return source.groupBy("aircraft_id").transformWithStateInPandas(FlightProcessor(), rules.SCHEMA, "Append", "EventTime", initialState=held)


class Accumulator(Ordered):
    """The fields of a transponder's messages put together; all of it is forgotten after a silence of ``state_s`` seconds."""

    WAITING = {"t": "double", "message_id": "long", **transponder.FIELDS}
    EMPTY = pd.DataFrame(transponder.columns([]))

    def __init__(self, ttl_s: int, state_s: float) -> None:
        self.ttl_s, self.state_s = ttl_s, state_s

    def released(self, key, state, rows, now):  # noqa: ANN001, ANN201
        kept = transponder.Kept.from_json(state)
        made = []
        for t, message, *fields in rows:
            if kept.last is not None and t - kept.last > self.state_s:
                kept = transponder.Kept()
            made += kept.feed(key, t, message, dict(zip(transponder.FIELDS, fields, strict=True)), self.ttl_s)
        over = kept.last is None or now - kept.last > self.state_s
        return None if over else kept.to_json(), pd.DataFrame(transponder.columns(made))

    def wakes(self, state):  # noqa: ANN001, ANN201
        kept = transponder.Kept.from_json(state)
        return None if kept.last is None else kept.last + self.state_s + 0.001


def accumulated(stream: DataFrame, ttl_s: int = transponder.TTL_S, state_s: float = transponder.TTL_S, delay: str = "1 minute") -> DataFrame:
    """The fixes of ``transponder.accumulated(messages, ttl_s, state_s)`` as the watermark passes their messages."""
    _stateful(stream)
    timed = stream.withWatermark("received_at", delay).filter("aircraft_id IS NOT NULL")
    fields = [F.col(c).cast(kind).alias(c) for c, kind in transponder.FIELDS.items()]
    source = timed.select("aircraft_id", "received_at", (F.unix_micros("received_at") / 1e6).alias("t"), "message_id", *fields)
    return source.groupBy("aircraft_id").transformWithStateInPandas(Accumulator(ttl_s, state_s), transponder.SCHEMA, "Append", "EventTime")


def upsert_latest(stream: DataFrame, path: str, checkpoint: str, key: str = "aircraft_id", time: str = "received_at"):  # noqa: ANN201
    """K3: the newest row of each key, kept in numbered versions below path, each written whole before it is named current; the version
    before the last is deleted, the last one stays for a restart. The state has a row for each key, so a batch costs as much as there are keys."""
    from ..operators.tracks import latest

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in (key, time)]
        if number:
            batch = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/v{number - 1}"))
        latest(batch, key, time, *rest).select(*batch.columns).write.mode("overwrite").parquet(f"{path}/v{number}")
        if number > 1:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{number - 2}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
