"""Streams: windowed rates with watermarks, and per-node state machines, the same code for batch and stream."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_rate(events: DataFrame, time: str, width: str, late: str, seconds: float) -> DataFrame:
    """Events of each node in tumbling windows; what is later than the watermark is dropped (WIN-1, STR-13)."""
    counted = events.withWatermark(time, late).groupBy("i", F.window(time, width).alias("w")).agg(F.count("*").alias("n"))
    return counted.select("i", F.col("w.start").alias("start"), "n", (F.col("n") / F.lit(seconds)).alias("rate"))


def refractory(events: DataFrame, hold: float) -> DataFrame:
    """Events of each node that come at least ``hold`` after the last one kept (PRJ-15): a fold over each node's
    events in order of time."""
    names = [c for c in events.columns if c not in ("i", "t", "event_id")]
    ordered = F.sort_array(F.collect_list(F.struct("t", "event_id", *names))).alias("all")
    start = F.struct(F.lit(-1e300).alias("last"), F.array().cast("array<bigint>").alias("kept"))

    def step(s: Column, e: Column) -> Column:
        free = e["t"] - s["last"] >= hold
        return F.struct(
            F.when(free, e["t"]).otherwise(s["last"]).alias("last"),
            F.when(free, F.array_append(s["kept"], e["event_id"])).otherwise(s["kept"]).alias("kept"),
        )

    packed = events.groupBy("i").agg(ordered)
    kept = F.aggregate("all", start, step, lambda s: s["kept"])
    return packed.select("i", F.explode(kept).alias("event_id"))


def refractory_stream(events: DataFrame, hold: float) -> DataFrame:
    """The same as a streaming query: the time of the last kept event is each node's state (STR-10)."""

    def step(key: tuple[Any, ...], parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["t", "event_id"])
        last = state.get[0] if state.exists else float("-inf")
        keep = []
        for t in rows["t"]:
            keep.append(t - last >= hold)
            last = t if keep[-1] else last
        state.update((last,))
        out = rows[keep]
        yield pd.DataFrame({"i": key[0], "event_id": out["event_id"], "t": out["t"]})

    return events.groupBy("i").applyInPandasWithState(
        step, "i long, event_id long, t double", "last double", "append", GroupStateTimeout.NoTimeout
    )


def trace_stream(events: DataFrame, tau: float) -> DataFrame:
    """A decaying trace of each node, updated by its events as they come (INT-15, WIN-9)."""

    def step(key: tuple[Any, ...], parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import math

        rows = pd.concat(list(parts)).sort_values(["t", "event_id"])
        x, last = state.get if state.exists else (0.0, 0.0)
        out = []
        for t, value in zip(rows["t"], rows["value"], strict=True):
            x, last = x * math.exp((last - t) / tau) + value, t
            out.append(x)
        state.update((x, last))
        yield pd.DataFrame({"i": key[0], "event_id": rows["event_id"], "trace": out})

    return events.groupBy("i").applyInPandasWithState(
        step, "i long, event_id long, trace double", "x double, last double", "append", GroupStateTimeout.NoTimeout
    )
