"""Choosing among a pool's resources, the least recently used first, under a use budget of each and a rest after a ban.

Events are (key, at, pos, resource): a request of the key's pool, or, with a resource, word that it was
banned. Each depends on those before it, so a key's events are taken in order, by at, then pos, with a
state of a few numbers for each resource. `choose` does so for tables: rows are dealt by key and
sorted, and a task reads them as they come, holding one key's state. `choose_stream` does so for
streams with the same steps: rows wait until the watermark has passed them, so that late ones within
it still come in order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quarryline.operators.policy import USES, WINDOW_SECONDS

#: How long a banned resource rests, in seconds.
COOLDOWN_SECONDS = 300
_MICROS = 1_000_000
_CHOSEN = StructType([StructField("key", StringType()), StructField("micros", LongType()), StructField("pos", LongType()), StructField("chosen", StringType())])


class Pool:
    """One key's resources: their last use, uses within the window, and end of rest."""

    def __init__(self, names: list[str], uses: int = USES, seconds: int = WINDOW_SECONDS, cooldown: int = COOLDOWN_SECONDS, hold: int = 1, state: str | None = None):
        self.names, self.uses, self.window, self.cooldown, self.hold = names, max(1, uses), seconds * _MICROS, cooldown * _MICROS, max(1, hold)
        kept = json.loads(state) if state else {}
        self.last, self.recent, self.rests = kept.get("last", {}), kept.get("recent", {}), kept.get("rests", {})
        self.held, self.left = kept.get("held"), kept.get("left", 0)

    def state(self) -> str:
        return json.dumps({"last": self.last, "recent": self.recent, "rests": self.rests, "held": self.held, "left": self.left})

    def _uses(self, name: str, now: int) -> list[int]:
        """Its uses within the window; one that is just a window old counts no more."""
        self.recent[name] = [t for t in self.recent.get(name, []) if t > now - self.window]
        return self.recent[name]

    def take(self, now: int, banned: str | None = None) -> str | None:
        """The resource for a request, None if all rest; or, of a ban, nothing."""
        if banned is not None:
            self.rests[banned] = now + self.cooldown
            return None
        awake = [n for n in self.names if now >= self.rests.get(n, now)]
        free = [n for n in awake if len(self._uses(n, now)) < self.uses]
        if self.held in free and self.left > 0:
            chosen, self.left = self.held, self.left - 1
        else:
            if free:
                chosen = min(free, key=lambda n: self.last.get(n, float("-inf")))
            elif awake:
                chosen = min(awake, key=lambda n: self.recent[n][0])  # all are over their budgets: whose oldest use goes first
            else:
                chosen = None
            self.held, self.left = chosen, self.hold - 1
        if chosen is not None:
            self.last[chosen] = now
            self.recent[chosen] = [*self.recent[chosen], now]
        return chosen


def _events(events: DataFrame) -> DataFrame:
    """(key, micros, pos, resource) of events that have a key and a time."""
    return events.filter("key is not null and at is not null").select(F.col("key").cast("string").alias("key"), F.unix_micros(F.col("at").cast("timestamp")).alias("micros"), F.col("pos").cast("long").alias("pos"), "resource")


def choose(events: DataFrame, names: list[str], **options) -> DataFrame:
    """(key, micros, pos, chosen) of each event, chosen being null for bans and where all resources rest.

    options: uses in seconds, cooldown, and hold, how many requests in a row a chosen resource serves
    while it may. Events without a key or time are left out; equal (at, pos) come by resource, requests
    first. A key is taken by one task, in order, without holding its rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pool = None, None
        for b in batches:
            chosen = []
            for k, now, banned in zip(b["key"].to_pylist(), b["micros"].to_pylist(), b["resource"].to_pylist(), strict=True):
                if pool is None or k != key:
                    key, pool = k, Pool(names, **options)
                chosen.append(pool.take(now, banned))
            yield pa.RecordBatch.from_arrays([b["key"], b["micros"], b["pos"], pa.array(chosen, pa.string())], ["key", "micros", "pos", "chosen"])

    return _events(events).repartition("key").sortWithinPartitions("key", "micros", "pos", F.asc_nulls_first("resource")).mapInArrow(run, _CHOSEN)


class _Chooser(StatefulProcessor):
    def __init__(self, names: list[str], options: dict):
        self.names, self.options = names, options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "micros long, pos long, resource string")
        self.pool = handle.getValueState("pool", "state string")

    def handleInputRows(self, key, rows, timerValues):
        for part in rows:
            part = part.astype(object).where(part.notna(), None)
            self.waiting.appendList([(int(m), None if p is None else int(p), r) for m, p, r in zip(part["micros"], part["pos"], part["resource"], strict=True)])
            for ms in {int(m) // 1000 + 1 for m in part["micros"]}:
                self.handle.registerTimer(ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        past = timerValues.getCurrentWatermarkInMs() * 1000
        rows = list(self.waiting.get())
        order = lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "")
        due = sorted((r for r in rows if r[0] < past), key=order)
        if not due:
            yield pd.DataFrame({c: [] for c in _CHOSEN.names}, dtype=object)
            return
        pool = Pool(self.names, **self.options, state=self.pool.get()[0] if self.pool.exists() else None)
        out = [(key[0], r[0], r[1], pool.take(r[0], r[2])) for r in due]
        self.pool.update((pool.state(),))
        rest = [tuple(r) for r in rows if r[0] >= past]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        yield pd.DataFrame(out, columns=_CHOSEN.names, dtype=object)

    def close(self) -> None:
        pass


def choose_stream(events: DataFrame, names: list[str], late: str = "5 minutes", **options) -> DataFrame:
    """choose() of a stream: an event's row comes once the watermark, `late` behind the newest event, has passed it; later ones are dropped. Needs a state store with column families (RocksDB)."""
    at = events.withWatermark("at", late)
    rows = at.filter("key is not null and at is not null").select(F.col("key").cast("string").alias("key"), "at", F.unix_micros(F.col("at").cast("timestamp")).alias("micros"), F.col("pos").cast("long").alias("pos"), "resource")
    return rows.groupBy("key").transformWithStateInPandas(_Chooser(names, options), _CHOSEN, "Append", "EventTime")
