"""Events along edges: fan-out, delays, and aggregation at the targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def threshold(rows: DataFrame, condition: Column, event: str = "spike", guard: str | None = None) -> DataFrame:
    """Rows whose condition holds (and whose guard is up) as events (FLT-1, FLT-2)."""
    keep = condition & F.col(guard) if guard else condition
    return rows.filter(keep).select("tick", F.lit(event).alias("event"), "i")


def delay_ticks(delay: Column, dt: float) -> Column:
    """Delays round to the nearest tick."""
    return (delay / dt + 0.5).cast("int")


def propagate(events: DataFrame, edges: DataFrame) -> DataFrame:
    """Each event on each edge of its source, due after the edge's delay (JOIN-1, JOIN-9)."""
    return events.select("tick", "i").join(edges, "i").withColumn("due", F.col("tick") + F.col("delay_ticks"))


def deliver_sum(pending: DataFrame, value: Column, by: tuple[str, ...] = ("due", "j")) -> DataFrame:
    """What arrives at each target in each tick, added up; partial sums are made before the shuffle (AGG-2)."""
    return pending.groupBy(*by).agg(F.sum(value).alias("total"))


def deliver_product(pending: DataFrame, value: Column, by: tuple[str, ...] = ("due", "j")) -> DataFrame:
    """Factors multiplied (AGG-3)."""
    return pending.groupBy(*by).agg(F.product(value).alias("factor"))


def deliver_last(pending: DataFrame, value: Column, seq: str, by: tuple[str, ...] = ("due", "j")) -> DataFrame:
    """Of several assignments the one of the last edge (AGG-4)."""
    return pending.groupBy(*by).agg(F.max_by(value, F.col(seq)).alias("assigned"))


def summed(edges: DataFrame, targets: DataFrame, value: Column, name: str = "total") -> DataFrame:
    """A sum over each target's edges, 0 where it has none (AGG-1)."""
    found = edges.groupBy(F.col("j").alias("i")).agg(F.sum(value).alias(name))
    return targets.select("i").join(found, "i", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def fused_sums(edges: DataFrame, by: list[str], **values: Column) -> DataFrame:
    """Several sums over the same groups in one pass (AGG-16)."""
    return edges.groupBy(*by).agg(*[F.sum(v).alias(k) for k, v in values.items()])


def requantised(pending: DataFrame, old_dt: float, new_dt: float) -> DataFrame:
    """Pending deliveries on another clock (STR-7)."""
    return pending.withColumn("due", (F.col("due") * old_dt / new_dt + 0.5).cast("bigint"))


def drop_late(events: DataFrame, start: int) -> DataFrame:
    """Events from before the run's first tick are left out (STR-13)."""
    return events.filter(F.col("tick") >= start)
