"""Operators that keep state for each key of a stream: held regimes and signal health.

Each works on one key's rows of a batch in the order of time and id, and carries the rest in its state, which holds a bounded recent
past and goes when the watermark has passed a key's last row by the time it can still matter.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stateful(stream: DataFrame, key: str, at: str, step: Callable[[dict, pd.Series], dict], empty: Callable[[], dict], schema: str, keep_ms: int, late: str = "1 day") -> DataFrame:
    """For each row, in order, step(state, row) -> the row's result; states are dictionaries that JSON can hold."""

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else empty()
        rows = pd.concat(list(frames)).sort_values([at, "event_id"])  # one key's rows of one batch
        made = [step(held, row) for row in rows.to_dict("records")]
        state.update((json.dumps(held),))
        last = int(rows[at].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + keep_ms)
        yield pd.DataFrame(made)

    return stream.withWatermark(at, late).groupBy(key).applyInPandasWithState(run, schema, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def states_held(stream: DataFrame, need: int = 5, keep_ms: int = 86_400_000 * 400) -> DataFrame:
    """observations(event_id, key, at, state) -> key, at, effective: a state takes over once it was seen `need` times running."""

    def step(held: dict, row: dict) -> dict:
        seen = row["state"]
        held["count"] = held["count"] + 1 if seen == held["last"] else 1
        held["last"] = seen
        if held["now"] is None or held["count"] >= need:
            held["now"] = seen
        return {"key": row["key"], "at": row["at"], "effective": held["now"]}

    return stateful(stream, "key", "at", step, lambda: {"now": None, "last": None, "count": 0}, "key string, at timestamp, effective string", keep_ms)


def health_held(stream: DataFrame, floor: float = 0.0, quarantine: int = 5, keep_ms: int = 86_400_000 * 400) -> DataFrame:
    """periods(event_id, signal, at, ic) -> signal, at, health and below, as contracts.signal_health() has them."""

    def step(held: dict, row: dict) -> dict:
        bad = pd.isna(row["ic"]) or row["ic"] < floor
        held["below"] = held["below"] + 1 if bad else 0
        health = "QUARANTINED" if held["below"] >= quarantine else "WATCH" if held["below"] else "HEALTHY"
        return {"signal": row["signal"], "at": row["at"], "health": health, "below": held["below"]}

    return stateful(stream, "signal", "at", step, lambda: {"below": 0}, "signal string, at timestamp, health string, below long", keep_ms)
