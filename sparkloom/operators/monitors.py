"""Monitors: what a run leaves behind, as tables that are appended to, read back, and rebuilt from."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import FORMATS


def event_monitor(events: DataFrame, values: DataFrame | None = None, variables: tuple[str, ...] = (), start: int | None = None, stop: int | None = None) -> DataFrame:
    """Events ``(tick, i)`` of the nodes in [start, stop), with the variables' values of that tick (SNK-1, SNK-2, FLT-6)."""
    if start is not None:
        events = events.filter(F.col("i") >= start)
    if stop is not None:
        events = events.filter(F.col("i") < stop)
    if not variables:
        return events.select("tick", "i")
    return events.select("tick", "i").join(values.select("tick", "i", *variables), ["tick", "i"])


def state_monitor(trace: DataFrame, variables: tuple[str, ...], every: int = 1, record: Column | None = None) -> DataFrame:
    """Values of some nodes at every so many ticks (SNK-3)."""
    kept = trace.filter(F.col("tick") % every == 0)
    return (kept.filter(record) if record is not None else kept).select("tick", "i", *variables)


def with_state_now(trace: DataFrame, state: DataFrame, tick: int) -> DataFrame:
    """One more sample, of the state after a run (SNK-4)."""
    now = state.withColumn("tick", F.lit(tick).cast("bigint")).select(trace.columns)
    return trace.unionByName(now)


def states(state: DataFrame, variables: Iterable[str], views: dict[str, Column] | None = None, kind: str = "parquet", path: str | None = None):
    """Columns and view columns of a state in a registered format (SNK-6); as a DataFrame where no format is asked."""
    out = state.select("i", *[(views or {}).get(v, F.col(v)).alias(v) for v in variables])
    return out if kind == "parquet" and path is None else FORMATS[kind][1](out, path)


def rebuilt(trace: DataFrame, views: dict[str, Column]) -> DataFrame:
    """View columns computed afterwards from what was recorded (SNK-13)."""
    return trace.withColumns(views)


def append(part: DataFrame, path: str, chunk: int) -> None:
    """One round's results as a part of a table (SNK-9, SNK-10); a repeated round replaces its own part only."""
    part.write.mode("overwrite").parquet(f"{path}/chunk={chunk}")


def read(spark: SparkSession, path: str, chunks: tuple[int, int] | None = None) -> DataFrame:
    """All parts, or those in a range, which are the only ones listed (SNK-9, SRC-18, SRC-19)."""
    df = spark.read.parquet(path)
    return df if chunks is None else df.filter((F.col("chunk") >= chunks[0]) & (F.col("chunk") < chunks[1]))


def stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The parts as they come (SRC-18)."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(path)
