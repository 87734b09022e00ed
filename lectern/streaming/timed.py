"""Stateful operators on streams of events that may come late and in any order, with timers.

Events of a key wait in the state until the watermark has passed them, then they are taken in the order of time and event_id, so what comes out does not
depend on how the stream was cut into triggers, and equals the batch form. A key's state is what waits and a few values; a key that is silent has one row, and
with expiry none. Events later than the watermark are dropped, as everywhere in streams.

Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STEP = 0.01
_ROUNDING = 1e-9


class Ordered(StatefulProcessor):
    """Takes a key's events in order once the watermark has passed them.

    step(state, event) changes the state (a dict that JSON can hold) and gives the events that are passed on; due(state, now) those that time alone decides, and
    next_due(state) when that is (microseconds).
    """

    def __init__(self, key: str, columns: list[str]):
        self.key, self.columns = key, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event_id long, body string")
        self.held = handle.getValueState("held", "body string")

    def step(self, state: dict[str, Any], event: dict[str, Any]) -> list[dict[str, Any]]:
        raise NotImplementedError

    def due(self, state: dict[str, Any], now: int) -> list[dict[str, Any]]:
        return []

    def next_due(self, state: dict[str, Any]) -> int | None:
        return None

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            at = frame["ts"].astype("datetime64[us]").astype("int64")
            bodies = frame.drop(columns=["ts"]).to_dict("records")
            told = [(int(a), int(b["event_id"]), json.dumps(b, default=str)) for a, b in zip(at, bodies, strict=True)]
            self.waiting.appendList(told)
            for a, _, _ in told:
                self.handle.registerTimer(max(a // 1000 + 1, mark + 1))
        yield self._frame([])

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = self.held.get() if self.held.exists() else None
        state = json.loads(held[0]) if held else {}
        events = sorted(self.waiting.get()) if self.waiting.exists() else []
        out, later = [], []
        for at, number, body in events:
            if at > now:
                later.append((at, number, body))
                continue
            out += self.due(state, at)
            out += self.step(state, {"ts": at, **json.loads(body)})
        out += self.due(state, now)
        if later:
            self.waiting.put(later)
        elif events:
            self.waiting.clear()
        self.held.update((json.dumps(state),))
        if (then := self.next_due(state)) is not None:
            self.handle.registerTimer(max(then // 1000 + 1, now // 1000 + 1))
        yield self._frame([{self.key: key[0], **e} for e in out])

    def close(self) -> None:
        pass

    def _frame(self, events: list[dict[str, Any]]) -> pd.DataFrame:
        rows = [{**e, "ts": dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=e["ts"])} for e in events]
        return pd.DataFrame(rows, columns=self.columns)


class Switched(Ordered):
    """Of events with a topic those whose topic was chosen last (chosen: a topic, in events that choose one)."""

    def step(self, state: dict[str, Any], event: dict[str, Any]) -> list[dict[str, Any]]:
        if event["chosen"] is not None:
            state["topic"] = event["chosen"]
            return []
        return [event] if event["topic"] is not None and event["topic"] == state.get("topic") else []


class Throttled(Ordered):
    """Reports at least a step beyond the last that was passed on, and the first that is done."""

    def __init__(self, key: str, columns: list[str], step: float):
        super().__init__(key, columns)
        self.least = step

    def step(self, state: dict[str, Any], event: dict[str, Any]) -> list[dict[str, Any]]:
        last, progress = state.get("last"), event["progress"]
        if last is None or progress - last >= self.least - _ROUNDING or (progress >= 1 > last):
            state["last"] = progress
            return [event]
        return []


class Settled(Ordered):
    """Changes of page after which nothing changed for the quiet time (microseconds)."""

    def __init__(self, key: str, columns: list[str], quiet: int):
        super().__init__(key, columns)
        self.quiet = quiet

    def step(self, state: dict[str, Any], event: dict[str, Any]) -> list[dict[str, Any]]:
        if event["page"] != state.get("page") or "page" not in state:
            state["page"], state["open"] = event["page"], event
        return []

    def due(self, state: dict[str, Any], now: int) -> list[dict[str, Any]]:
        then = self.next_due(state)
        return [state.pop("open")] if then is not None and then <= now else []

    def next_due(self, state: dict[str, Any]) -> int | None:
        return state["open"]["ts"] + self.quiet if "open" in state else None


def _run(stream: DataFrame, key: str, late: str, columns: list[str], processor: Ordered) -> DataFrame:
    kinds = ", ".join(f"{c} {stream.schema[c].dataType.simpleString()}" for c in columns)
    return stream.withWatermark("ts", late).groupBy(key).transformWithStateInPandas(processor, kinds, "Append", "EventTime")


def switched(stream: DataFrame, key: str = "key", late: str = "10 minutes") -> DataFrame:
    """key, ts, event_id, topic of a stream (key, ts, event_id, topic, chosen: strings): flat-map latest, as control.switched."""
    columns = [key, "ts", "event_id", "topic"]
    return _run(stream.select(*columns, "chosen"), key, late, columns, Switched(key, columns))


def throttled(stream: DataFrame, key: str = "key", step: float = STEP, late: str = "10 minutes") -> DataFrame:
    """Reports (key, ts, event_id, progress) of a stream that are passed on, as control.throttled."""
    columns = [key, "ts", "event_id", "progress"]
    return _run(stream.select(*columns), key, late, columns, Throttled(key, columns, step))


def settled(stream: DataFrame, quiet_seconds: float, key: str = "reader", late: str = "10 minutes") -> DataFrame:
    """Pages (key, ts, event_id, page) of a stream that stayed for the quiet time, as reading.settled; the last once the watermark has passed that."""
    columns = [key, "ts", "event_id", "page"]
    return _run(stream.select(*columns), key, late, columns, Settled(key, columns, int(quiet_seconds * 1_000_000)))
