"""The waiting stream's processor on many invoices that are being read at once."""

import time
from datetime import datetime, timedelta, timezone

import pandas as pd

from apchecks.streaming import waiting

START = datetime(2026, 5, 1, tzinfo=timezone.utc)


class Held(dict):
    """A value, list or map state in memory."""

    def get(self, *_):
        return super().get("value", [])

    def update(self, value):
        self["value"] = value

    put = update

    def appendList(self, values):
        self["value"] = [*super().get("value", []), *values]

    def getValue(self, key):
        return super().get(key)

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]

    def iterator(self):
        return iter(list(self.items()))


class Handle:
    def __init__(self):
        self.timers = set()
        self.getValueState = self.getListState = self.getMapState = lambda *_: Held()

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class Clock:
    def __init__(self, at):
        self.ms = int(at.timestamp() * 1000)

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_many_being_read(spark, monkeypatch):
    """Work grows with the events, not with their product with the invoices being read, and results are the batch's."""
    monkeypatch.setattr(waiting, "HELD_ROWS", 5000, raising=False)
    monkeypatch.setattr(waiting, "OUTPUT_ROWS", 1000, raising=False)
    n, rows = 12_000, []
    for i in range(n):  # received at the start, but created after all others: they hold up nothing
        rows.append(("t", n + i, "received", START, START + timedelta(days=9, seconds=i)))
    for i in range(n):
        at = START + timedelta(seconds=2 * i)
        rows.append(("t", i, "received", at, at))
        rows.append(("t", i, "ready" if i % 7 else "failed", at + timedelta(seconds=i * 37 % 600), at))
    events = pd.DataFrame(rows, columns=["tenant_id", "invoice_id", "kind", "at", "created_at"]).sample(frac=1, random_state=3)
    processor, handle, out = waiting.Waiting(300), Handle(), []
    processor.init(handle)
    began = time.time()
    list(processor.handleInputRows(("t",), iter([events[j : j + 4000] for j in range(0, len(events), 4000)]), None))
    for hours in (1, 4, 5, 48):
        out += processor.handleExpiredTimer(("t",), Clock(START + timedelta(hours=hours)), None)
    took = time.time() - began
    key = lambda f: set(zip(f["invoice_id"], f["ready_at"].astype(str).str[:19], f["released_at"].astype(str).str[:19], f["still_pending"]))
    whole = spark.createDataFrame(events.assign(at=events["at"].dt.tz_localize(None), created_at=events["created_at"].dt.tz_localize(None)))
    want = waiting.go_aheads(whole, 300).toPandas()
    assert key(pd.concat(out)) == key(want) and len(pd.concat(out)) == len(want)
    assert took < 20
