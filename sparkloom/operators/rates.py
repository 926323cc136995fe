"""Monitors' readings: counts, trains, rates, smoothing and statistics of event trains and traces."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def counts(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """Events of every node, 0 included (AGG-6)."""
    found = events.groupBy("i").agg(F.count("*").alias("n"))
    return nodes.select("i").join(found, "i", "left").select("i", F.coalesce("n", F.lit(0)).alias("n"))


def total(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("n"))


def trains(events: DataFrame, value: str = "t", by: str = "i") -> DataFrame:
    """Each node's values in order of time (AGG-8)."""
    kept = F.sort_array(F.collect_list(F.struct("t", F.col(value).alias("v"))))
    return events.groupBy(by).agg(F.transform(kept, lambda x: x["v"]).alias("values"))


def binned_rate(events: DataFrame, nodes: DataFrame, bins: int, bin_ticks: int, dt: float) -> DataFrame:
    """Rate of every node in every bin (AGG-9). Counts are dense: nodes by bins, 0 where nothing happened."""
    found = events.groupBy("i", F.floor(F.col("tick") / bin_ticks).alias("bin")).agg(F.count("*").alias("n"))
    dense = nodes.select("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin"))
    return dense.join(found, ["i", "bin"], "left").select(
        "i", "bin", (F.coalesce("n", F.lit(0)) / F.lit(bin_ticks * dt)).alias("rate")
    )


def population_rate(spark: SparkSession, events: DataFrame, n: int, first: int, last: int, dt: float) -> DataFrame:
    """Events of all nodes over n and dt for every tick from first to before last (SNK-5)."""
    ticks = spark.range(first, last).select(F.col("id").alias("tick"))
    found = events.groupBy("tick").agg(F.count("*").alias("n"))
    return ticks.join(found, "tick", "left").select("tick", (F.coalesce("n", F.lit(0)) / F.lit(n * dt)).alias("rate"))


def binned_population_rate(rates: DataFrame, bin_ticks: int) -> DataFrame:
    """Mean rate of each complete bin, counted from the first recorded tick (AGG-10)."""
    at = rates.withColumn("first", rates.agg(F.min("tick")).scalar())
    bins = at.groupBy(F.floor((F.col("tick") - F.col("first")) / bin_ticks).alias("bin")).agg(
        F.avg("rate").alias("rate"), F.count("*").alias("n")
    )
    return bins.filter(F.col("n") == bin_ticks).select("bin", "rate")


def _smoothed(rates: DataFrame, weights: list[float], by: list[str], block: int) -> DataFrame:
    """Weighted sums over neighbours in time, zeros beyond the ends. Ticks are cut in blocks and each row is copied
    to the blocks whose frames it is in, so that one long series is many tasks."""
    h = len(weights) // 2
    places = F.array_distinct(F.array(*[F.floor((F.col("tick") + d) / block) for d in (-h, 0, h)]))
    copies = rates.withColumn("_block", F.explode(places))
    w = Window.partitionBy(*by, "_block").orderBy("tick").rangeBetween(-h, h)
    near = F.collect_list(F.struct("tick", "rate")).over(w)
    fixed = F.array(*[F.lit(float(x)) for x in weights])
    value = F.aggregate(
        near, F.lit(0.0), lambda s, x: s + x["rate"] * F.get(fixed, (x["tick"] - F.col("tick") + h).cast("int"))
    )
    own = F.col("_block") == F.floor(F.col("tick") / block)
    return copies.withColumn("smooth", value).filter(own).select(*by, "tick", "smooth")


def smooth(rates: DataFrame, window: str | list[float], width_ticks: int = 0, by: tuple[str, ...] = (), block: int = 100_000) -> DataFrame:
    """Rates smoothed by a flat window, a gaussian of that width cut at two of it, or given weights (WIN-3..6)."""
    if window == "flat":
        n = width_ticks // 2 * 2 + 1
        weights = [1.0 / n] * n
    elif window == "gaussian":
        shape = [math.exp(-(k**2) / (2 * width_ticks**2)) for k in range(-2 * width_ticks, 2 * width_ticks + 1)]
        weights = [x / sum(shape) for x in shape]
    else:
        if len(window) % 2 == 0:
            raise ValueError("a window has an odd number of weights")
        weights = [x / sum(window) for x in window]
    return _smoothed(rates, weights, list(by), max(block, len(weights)))


def intervals(events: DataFrame) -> DataFrame:
    """Time since each node's event before (WIN-7)."""
    before = F.lag("t").over(Window.partitionBy("i").orderBy("t"))
    return events.withColumn("isi", F.col("t") - before).filter("isi IS NOT NULL")


def last_event(events: DataFrame) -> DataFrame:
    return events.groupBy("i").agg(F.max("t").alias("last"))


def lvr(events: DataFrame, refractory: float) -> DataFrame:
    """Irregularity of each node's train from pairs of neighbouring intervals, corrected for refractoriness (AGG-12)."""
    isi = intervals(events)
    pair = isi.withColumn("prev", F.lag("isi").over(Window.partitionBy("i").orderBy("t"))).filter("prev IS NOT NULL")
    both = F.col("isi") + F.col("prev")
    term = (1 - 4 * F.col("isi") * F.col("prev") / (both * both)) * (1 + 4 * F.lit(refractory) / both)
    return pair.filter(both > 0).groupBy("i").agg((3 * F.avg(term)).alias("lvr"), F.count("*").alias("pairs"))


def mean_correlation(binned: DataFrame, value: str = "n") -> DataFrame:
    """Mean pairwise correlation of nodes' counts without the matrix: from the length of the sum of all normalised
    trains (AGG-13). ``binned`` is dense; nodes that never vary are left out."""
    per = Window.partitionBy("i")
    centred = (F.col(value) - F.avg(value).over(per)) / F.sqrt(F.var_pop(value).over(per) * F.count("*").over(per))
    z = binned.withColumn("_var", F.var_pop(value).over(per)).withColumn("_z", centred).filter("_var > 0")
    n = z.agg(F.count_distinct("i").alias("nodes"))
    length = z.groupBy("bin").agg(F.sum("_z").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("length"))
    out = length.withColumn("nodes", n.scalar())
    return out.select(((F.col("length") - F.col("nodes")) / (F.col("nodes") * (F.col("nodes") - 1))).alias("correlation"), "nodes")


def population_statistics(counted: DataFrame, seconds: float) -> DataFrame:
    """Mean, spread, quartiles of rates, and the share of silent nodes (AGG-11)."""
    # counts are few different numbers: quartiles are taken of them, each once with its frequency
    often = counted.groupBy("n").agg(F.count("*").alias("times"))
    rate = F.col("n") / F.lit(seconds)
    quartiles = often.agg(F.percentile(rate, F.array(*map(F.lit, (0.25, 0.5, 0.75))), F.col("times")).alias("q"))
    out = counted.agg(
        F.avg(rate).alias("mean"),
        F.stddev_pop(rate).alias("std"),
        F.avg(F.when(F.col("n") == 0, 1.0).otherwise(0.0)).alias("silent"),
    )
    q = quartiles.select("q").scalar()
    return out.select("mean", "std", *[q[k].alias(name) for k, name in enumerate(("q25", "q50", "q75"))], "silent")


def histogram(events: DataFrame, bin_ticks: int) -> DataFrame:
    return events.groupBy(F.floor(F.col("tick") / bin_ticks).alias("bin")).agg(F.count("*").alias("n"))


def exponential_trace(events: DataFrame, tau: float, weight: Column | None = None, block: float = 300.0) -> DataFrame:
    """The sum of decayed weights at each event, itself included (WIN-9). Within blocks of ``block`` time constants a
    running sum of scaled weights does it; across blocks only the last value of the block before matters, since what is
    older has decayed by a whole block."""
    if block < 30:
        raise ValueError("blocks of less than 30 time constants would lose what decays across two of them")
    w = weight if weight is not None else F.lit(1.0)
    rows = events.withColumn("_b", F.floor(F.col("t") / F.lit(block * tau))).withColumn("_w", w)
    since = (F.col("t") - F.col("_b") * block * tau) / tau
    run = Window.partitionBy("i", "_b").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_x", F.sum(F.col("_w") * F.exp(since)).over(run) * F.exp(-since))
    ends = rows.groupBy("i", "_b").agg(F.max("t").alias("_t1"), F.max_by("_x", "t").alias("_x1"))
    ends = ends.withColumn("_b", F.col("_b") + 1)
    rows = rows.join(ends, ["i", "_b"], "left")
    carried = F.coalesce(F.col("_x1") * F.exp(-(F.col("t") - F.col("_t1")) / tau), F.lit(0.0))
    return rows.select(*events.columns, (F.col("_x") + carried).alias("trace"))


def as_of(rows: DataFrame, held: DataFrame, by: str, time: str, value: str) -> DataFrame:
    """For each row the newest held value not later than it (JOIN-10): both in one sorted stream a key."""
    left = rows.withColumns({"_v": F.lit(None).cast(dict(held.dtypes)[value]), "_r": F.lit(1)})
    right = held.select(by, time, F.col(value).alias("_v"), F.lit(0).alias("_r"))
    both = left.unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(time, "_r").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).filter("_r = 1")
    return out.drop("_v", "_r")


def invalid(rows: DataFrame, columns: list[str], bound: float = 1e50) -> DataFrame:
    """How many values of each column are NaN or beyond a bound (AGG-18)."""
    bad = [F.count_if(F.isnan(c) | (F.abs(c) > bound)).alias(c) for c in columns]
    return rows.agg(*bad)
