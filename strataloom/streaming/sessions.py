"""Sessions of users as stateful streams: strokes, debounced saves and the guide's runs, in event time.

Events of a key arrive late, repeated and out of order. They wait in state until the watermark has passed them, are then folded in the
order of (time, id), once each, and forgotten. Timers wake a key when its first waiting event or its next due save is passed; state
is what waits, packed by arrivals, and one small record. What comes later than the watermark is dropped by Spark, so a repeated event can't count twice.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.graph import settings

#: What a fold is given: an event's time (ms), id, kind and value.
Event = tuple[int, int, str, float]
#: fold(state, events, now) -> (rows, due): changes the state in place; ``due`` is when it must be woken next without an event.
Fold = Callable[[dict, list[Event], int], tuple[list[dict], int | None]]
WAITING = "json string"
#: How many waiting events are one row of state at most: each row is a call to the store.
PACK = 10_000
SESSIONS = "what string, start long, end long, n long, outcome string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def strokes(delay: int) -> Fold:
    """begin, continue and end of strokes; a save comes ``delay`` ms after a stroke ends, unless another one has ended by then.

    A begin within a stroke starts it anew; continue and end without a begin are nothing. Rows: ``stroke`` with its points, ``save`` with the strokes since the last save.
    """

    def fold(s: dict, events: list[Event], now: int) -> tuple[list[dict], int | None]:
        rows: list[dict] = []

        def save(until: int) -> None:
            if s.get("due") is not None and s["due"] <= until:
                rows.append({"what": "save", "start": s["since"], "end": s.pop("due"), "n": s.pop("edits"), "outcome": "saved"})
                s.pop("since")

        for ts, _, kind, _ in events:
            save(ts)
            if kind == "begin":
                s["start"], s["points"] = ts, 1
            elif kind == "continue" and "start" in s:
                s["points"] += 1
            elif kind == "end" and "start" in s:
                rows.append({"what": "stroke", "start": s.pop("start"), "end": ts, "n": s.pop("points"), "outcome": "committed"})
                s["due"], s["edits"] = ts + delay, s.get("edits", 0) + 1
                s.setdefault("since", ts)
        save(now)
        return rows, s.get("due")

    return fold


def guide_runs(regions: int = 3, least: float = 20) -> Fold:
    """start, verify (value: reference pixels in the region) and skip of the guide.

    A start offers ``regions`` anew. Verifying needs ``least`` reference pixels and goes on to the next; after the last the run is ``verified``. A skip drops what is
    still open: ``skipped``. A start within a run drops it: ``restarted``. Verify and skip outside a run are nothing. n: regions verified.
    """

    def fold(s: dict, events: list[Event], now: int) -> tuple[list[dict], int | None]:
        rows: list[dict] = []

        def finish(ts: int, outcome: str) -> None:
            rows.append({"what": "guide", "start": s.pop("start"), "end": ts, "n": s.pop("verified"), "outcome": outcome})

        for ts, _, kind, value in events:
            if kind == "start":
                if "start" in s:
                    finish(ts, "restarted")
                s["start"], s["verified"] = ts, 0
            elif "start" in s and kind == "verify" and value >= least:
                s["verified"] += 1
                if s["verified"] == regions:
                    finish(ts, "verified")
            elif "start" in s and kind == "skip":
                finish(ts, "skipped")
        return rows, None

    return fold


class InOrder(StatefulProcessor):
    """Folds each key's events once the watermark has passed them."""

    def __init__(self, key: str, fold: Fold) -> None:
        self.key, self.fold = key, fold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.held = handle.getValueState("held", "json string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        earliest = []
        while pack := [r[-4:] for r in islice(rows, PACK)]:
            self.waiting.appendValue((json.dumps(pack),))
            earliest.append(min(e[0] for e in pack))
        self.handle.registerTimer(min(earliest))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        known: dict[int, Event] = {}
        for (pack,) in self.waiting.get():
            for e in json.loads(pack):
                known.setdefault(e[1], tuple(e))
        ready, later = sorted(e for e in known.values() if e[0] <= now), [e for e in known.values() if e[0] > now]
        held = self.held.get()
        state = json.loads(held[0]) if held else {}
        rows, due = self.fold(state, ready, now)
        if later:
            self.waiting.put([(json.dumps(later[i : i + PACK]),) for i in range(0, len(later), PACK)])
        elif known:
            self.waiting.clear()
        if state:
            self.held.update((json.dumps(state),))
        elif held:
            self.held.clear()
        for at in {min((e[0] for e in later), default=None), due} - {None}:
            self.handle.registerTimer(at)
        for r in rows:
            yield Row(**{self.key: key[0]}, **r)

    def close(self) -> None:
        pass


def folded(events: DataFrame, key: str, fold: Fold, watermark: str) -> DataFrame:
    """events (key, ts timestamp, id long, kind string, value double; a stream) -> (key, SESSIONS), times in ms."""
    kind = dict(events.dtypes)[key]
    e = events.withWatermark("ts", watermark).select(key, "ts", F.unix_millis("ts").alias("ms"), F.col("id").cast("long").alias("id"), "kind", F.coalesce(F.col("value").cast("double"), F.lit(float("nan"))).alias("value"))
    return e.select(key, F.col("ts").alias("at"), F.col("ms").alias("ts"), "id", "kind", "value").groupBy(key).transformWithState(statefulProcessor=InOrder(key, fold), outputStructType=f"{key} {kind}, {SESSIONS}", outputMode="Append", timeMode="EventTime")


def run(events: DataFrame, key: str, fold: Fold, watermark: str, path: str, checkpoint: str) -> None:
    """Fold what is there into a Parquet table and end; started again on the same checkpoint, it goes on from there."""
    with settings(events.sparkSession, {"spark.sql.streaming.stateStore.providerClass": ROCKS}):
        out = folded(events, key, fold, watermark)
        out.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
