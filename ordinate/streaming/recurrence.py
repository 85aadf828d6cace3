"""The trapezoidal recurrence and the causal convolution of scalar inputs on a stream, by state per key."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "user_id bigint, event_id bigint, t bigint, h double, y double, late boolean"
STATE = "t bigint, at bigint, last_id bigint, h double, last_x double, history array<double>"


def stepper(rate: float, lam: float, weights: list[float]):
    """The function of one key's new rows: (t, h) of the recurrence and y, a causal convolution of x with weights.

    Rows are taken in order of (at, event_id). A row that is not after the key's last one is late: it comes out with
    nulls and late set, and changes nothing, as the recurrence depends on the order.
    """
    back = len(weights) - 1

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches).sort_values(["at", "event_id"], kind="stable")
        t, at, last_id, h, last_x, history = state.get if state.exists else (-1, None, -1, 0.0, 0.0, [0.0] * back)
        history, out = list(history), []
        for now, event, x in zip(rows["at"].tolist(), rows["event_id"].tolist(), rows["x"].tolist()):
            if at is not None and (now, event) <= (at, last_id):
                out.append((key[0], event, None, None, None, True))
                continue
            dt = 0.0 if at is None else (now - at) / 3.6e9
            decay = math.exp(max(-60.0, dt * rate))
            h = decay * h + (1 - lam) * dt * decay * last_x + lam * dt * x
            window = [*history, x]
            y = sum(w * v for w, v in zip(weights, window))
            t, at, last_id, last_x, history = t + 1, now, event, x, window[1:]
            out.append((key[0], event, t, h, y, False))
        state.update((t, at, last_id, h, last_x, history))
        frame = pd.DataFrame(out, columns=["user_id", "event_id", "t", "h", "y", "late"])
        yield frame.astype({"t": "Int64", "h": "float64", "y": "float64"})

    return step


def recurrence(events: DataFrame, rate: float, lam: float, weights: list[float]) -> DataFrame:
    """The stream of events(user_id, event_id, ts, value) with t, h and y; a null value counts as 0."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.select("user_id", "event_id", at.alias("at"), F.coalesce("value", F.lit(0.0)).alias("x"))
    return rows.groupBy("user_id").applyInPandasWithState(stepper(rate, lam, weights), OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
