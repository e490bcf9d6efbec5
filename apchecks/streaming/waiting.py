"""Waiting for earlier invoices, as a stream with event-time timers and as its batch twin.

An invoice that is ready for its checks goes ahead once all earlier ones of its tenant have been read, and after
``longest`` seconds at the latest; then a clean result is no pass. The stream holds back what stands after the
watermark, so that events may arrive in any order within the delay and the result is that of the batch.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "tenant_id string, invoice_id long, ready_at timestamp, released_at timestamp, still_pending boolean"
#: Events of one time stand in this order: what ends a wait counts before what a wait's end looks at.
_KINDS = {"received": 0, "resolved": 1, "ready": 2}
_HOUR = 3_600_000_000
#: Rows that a task holds before it puts them into the state, and rows of a frame that it returns.
HELD_ROWS, OUTPUT_ROWS = 1 << 18, 1 << 16


def go_aheads(events: DataFrame, longest: int = 300) -> DataFrame:
    """When each ready invoice goes ahead, and whether earlier ones are still being read then.

    ``events`` holds tenant_id, invoice_id, kind (received, ready, failed), at and created_at, the time at which the
    invoice was received; ready and failed end its being read. An invoice that is never ready never goes ahead.
    The greatest end of all earlier ones is a running maximum, so no pairs of invoices are made.
    """
    ends = events.groupBy("tenant_id", "invoice_id").agg(
        F.min("created_at").alias("created_at"), F.min(F.when(F.col("kind") != "received", F.col("at"))).alias("resolved"), F.min(F.when(F.col("kind") == "ready", F.col("at"))).alias("ready_at")
    )
    before = Window.partitionBy("tenant_id").orderBy("created_at", "invoice_id").rowsBetween(Window.unboundedPreceding, -1)
    never = F.lit("9999-12-31").cast("timestamp")
    w = ends.withColumn("last", F.max(F.coalesce("resolved", never)).over(before)).filter(F.col("ready_at").isNotNull())
    limit = F.col("ready_at") + F.make_dt_interval(secs=F.lit(longest))
    late = F.coalesce(F.col("last") > limit, F.lit(False))
    released = F.when(late, limit).otherwise(F.greatest("ready_at", "last"))
    return w.select("tenant_id", "invoice_id", "ready_at", released.alias("released_at"), late.alias("still_pending"))


def _packed(rows: np.ndarray) -> bytes:
    return np.ascontiguousarray(rows, dtype=np.int64).tobytes()


def _unpacked(data: tuple | None, columns: int) -> np.ndarray:
    return np.frombuffer(data[0] if data else b"", dtype=np.int64).reshape(-1, columns)


class Waiting(StatefulProcessor):
    """Per tenant the events after the watermark, the invoices being read and those that wait.

    Events stand in the state store as packed parts of an hour, and are read hour by hour, so that a tenant's
    events are never in memory together. Heaps give the first invoice being read and the first that has waited out.
    """

    def __init__(self, longest: int):
        self.longest = longest * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hours = handle.getMapState("hours", "hour long", "parts long, first long")
        self.events = handle.getMapState("events", "hour long, part long", "rows binary")
        self.pending = handle.getValueState("pending", "rows binary")
        self.waiting = handle.getValueState("waiting", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first, held, size = None, [], 0
        for part in rows:
            micros = lambda c: (c.astype("datetime64[us, UTC]") if c.dt.tz is not None else c.astype("datetime64[us]")).astype("int64")
            kinds = part["kind"].map(_KINDS).fillna(1).astype("int64")
            held.append(np.column_stack([micros(part["at"]), kinds, micros(part["created_at"]), part["invoice_id"].astype("int64")]))
            size += len(part)
            if size >= HELD_ROWS:
                first, held, size = self._hold(held, first), [], 0
        first = self._hold(held, first)
        if first is not None:
            self._wake(first)
        yield pd.DataFrame()

    def _hold(self, held: list[np.ndarray], first: int | None) -> int | None:
        """Put events into the state, a part for each of their hours; returns the first time of all so far."""
        rows = np.concatenate([np.zeros((0, 4), np.int64), *held])
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        hour = rows[:, 0] // _HOUR
        for part in np.split(rows, np.flatnonzero(np.diff(hour)) + 1) if len(rows) else ():
            own, at = int(part[0, 0] // _HOUR), int(part[0, 0])
            parts, least = self.hours.getValue((own,)) or (0, at)
            self.events.updateValue((own, parts), (_packed(part),))
            self.hours.updateValue((own,), (parts + 1, min(least, at)))
            first = at if first is None else min(first, at)
        return first

    def _wake(self, micros: int) -> None:
        """One timer a tenant, at the first time at which something happens."""
        at = -(-micros // 1000)
        held = list(self.handle.listTimers())
        if not held or at < min(held):
            for t in held:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def _happened(self, now: int) -> Iterator[list]:
        """The events (time, kind, creation, invoice) up to a time in their order, taken out of the state."""
        for hour, parts in sorted((k[0], v[0]) for k, v in self.hours.iterator()):
            if hour * _HOUR > now:
                break
            rows = np.concatenate([_unpacked(self.events.getValue((hour, i)), 4) for i in range(parts)])
            for i in range(parts):
                self.events.removeKey((hour, i))
            self.hours.removeKey((hour,))
            self._hold([rows[rows[:, 0] > now]], None)
            rows = rows[rows[:, 0] <= now]
            yield from rows[np.lexsort(rows.T[::-1])].tolist()

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Go through what has happened up to the watermark, in its order."""
        now = timerValues.getCurrentWatermarkInMs() * 1000
        pending = dict(_unpacked(self.pending.get(), 2).tolist())
        waiting = {i: (created, ready) for i, created, ready in _unpacked(self.waiting.get(), 3).tolist()}
        # Entries of heaps that the dictionaries no longer hold are passed over.
        reading = [(c, i) for i, c in pending.items()]
        oldest = [(c, i, r) for i, (c, r) in waiting.items()]
        longest = [(r, i, c) for i, (c, r) in waiting.items()]
        for heap in (reading, oldest, longest):
            heapq.heapify(heap)
        out: list[tuple] = []

        def release(at: int) -> None:
            """Let go ahead whatever waits behind no pending invoice, or has waited out at a time."""
            while reading and pending.get(reading[0][1]) != reading[0][0]:
                heapq.heappop(reading)
            while oldest and (not reading or oldest[0][:2] <= reading[0]):
                created, i, ready = heapq.heappop(oldest)
                if waiting.get(i) == (created, ready):
                    del waiting[i]
                    out.append((i, ready, at, False))
            while longest and longest[0][0] + self.longest < at:
                ready, i, created = heapq.heappop(longest)
                if waiting.get(i) == (created, ready):
                    del waiting[i]
                    out.append((i, ready, ready + self.longest, True))

        def wait_out(before: int) -> None:
            """Let go ahead what has waited out before a time."""
            while longest and longest[0][0] + self.longest < before:
                release(longest[0][0] + self.longest + 1)

        def frame() -> pd.DataFrame:
            stamp = lambda j: pd.to_datetime([o[j] for o in out], unit="us", utc=True)
            made = pd.DataFrame({"tenant_id": key[0], "invoice_id": [o[0] for o in out], "ready_at": stamp(1), "released_at": stamp(2), "still_pending": [o[3] for o in out]})
            out.clear()
            return made

        time = None
        for at, kind, created, i in self._happened(now):
            if at != time:
                if time is not None:
                    release(time)
                wait_out(at)
                time = at
                if len(out) >= OUTPUT_ROWS:
                    yield frame()
            if kind == _KINDS["received"]:
                pending[i] = created
                heapq.heappush(reading, (created, i))
            else:
                pending.pop(i, None)
            if kind == _KINDS["ready"]:
                waiting[i] = (created, at)
                heapq.heappush(oldest, (created, i, at))
                heapq.heappush(longest, (at, i, created))
        if time is not None:
            release(time)
        wait_out(now + 1)
        self.pending.update((_packed(np.array(list(pending.items()))),))
        self.waiting.update((_packed(np.array([(i, *w) for i, w in waiting.items()])),))
        following = [v[1] for _, v in self.hours.iterator()] + [r + self.longest for _, r in waiting.values()]
        if following:
            self.handle.registerTimer(max(-(-min(following) // 1000), timerValues.getCurrentWatermarkInMs() + 1))
        yield frame() if out else pd.DataFrame()

    def close(self) -> None:
        pass


def go_aheads_stream(events: DataFrame, longest: int = 300, delay: str = "10 minutes") -> DataFrame:
    """As `go_aheads`, of a stream of events that arrive within ``delay``; rows come out as the watermark passes them."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    held = events.withWatermark("at", delay).groupBy("tenant_id")
    return held.transformWithStateInPandas(Waiting(longest), OUTPUT, "Append", "EventTime")
