"""Sources of nodes, events, edges, lookups and trees as DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rng
from ..functions.lang import timestep


def nodes(spark: SparkSession, n: int, **columns: Column | float) -> DataFrame:
    """A table of n rows ``i`` with columns that may refer to i (SRC-1)."""
    return spark.range(n).select(F.col("id").alias("i")).withColumns(
        {k: v if isinstance(v, Column) else F.lit(v) for k, v in columns.items()}
    )


def replay(events: DataFrame, dt: float, period: float | None = None, until: float | None = None) -> DataFrame:
    """Events ``(i, t)`` with their ticks; with a period each is repeated up to ``until`` (SRC-3, STR-14)."""
    tick = timestep(F.col("t"), F.lit(dt))
    out = events.select("i", tick.alias("tick"))
    if period is None:
        return out
    every = int((period + 1e-3 * dt) / dt)
    last = int((until + 1e-3 * dt) / dt)
    again = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.lit(last - 1) - F.col("tick")) / every)))
    return out.filter(F.col("tick") < last).select("i", "tick", F.explode(again).alias("_k")).select("i", (F.col("tick") + F.col("_k") * every).alias("tick"))


def replay_issues(events: DataFrame, n: int, dt: float, period: float | None = None) -> DataFrame:
    """What is wrong with replay input, a row each: ids and times out of range, two events of a row in a tick (SRC-4)."""
    problem = (
        F.when((F.col("i") < 0) | (F.col("i") >= n), "id out of range")
        .when(F.col("t") < 0, "negative time")
        .when(F.lit(period is not None) & (F.col("t") >= (period or 0.0)), "time not within the period")
    )
    bad = events.withColumn("issue", problem).filter("issue IS NOT NULL").select("i", "t", "issue")
    twice = events.groupBy("i", timestep(F.col("t"), F.lit(dt)).alias("tick")).agg(F.count("*").alias("n"), F.min("t").alias("t"))
    return bad.unionByName(twice.filter("n > 1").select("i", "t", F.lit("several events in a tick").alias("issue")))


def poisson_events(spark: SparkSession, n: int, ticks: int, rate: Column | float, dt: float, seed: int) -> DataFrame:
    """Events where a draw falls below rate * dt; the draw belongs to (seed, tick, i), not to a partition (SRC-2)."""
    rows = spark.range(n * ticks).select((F.col("id") % n).alias("i"), F.floor(F.col("id") / n).alias("tick"))
    p = (rate if isinstance(rate, Column) else F.lit(rate)) * dt
    return rows.filter(rng.uniform(seed, "poisson", F.col("tick"), F.col("i")) < p).select("tick", "i")


def poisson_input(ticks: DataFrame, n: int, rate: float, weight: float, dt: float, seed: int) -> DataFrame:
    """Summed input of n Poisson sources per (tick, i): binomial draws times the weight (SRC-5)."""
    drawn = rng.binomial(n, rate * dt, seed, "input", F.col("tick"), F.col("i"))
    return ticks.withColumn("value", drawn * F.lit(weight))


def timed_array(rows: DataFrame, values: list[float], dt: float, t: str = "t") -> DataFrame:
    """The value that holds at each row's time, the first and last beyond the ends (SRC-6)."""
    place = F.least(F.greatest(timestep(F.col(t), F.lit(dt)), F.lit(0)), F.lit(len(values) - 1)).cast("int")
    fixed = F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")
    return rows.withColumn("value", F.get(fixed, place))


def timed_array_2d(rows: DataFrame, values: DataFrame, last: int) -> DataFrame:
    """As above with a column per node, from a table ``(tick, i, value)`` (SRC-7)."""
    at = rows.withColumn("_bin", F.least(F.greatest(F.col("tick"), F.lit(0)), F.lit(last)))
    held = values.select(F.col("tick").alias("_bin"), "i", "value")
    return at.join(held, ["_bin", "i"], "left").drop("_bin")


def edge_list(pairs: DataFrame, n: Column | int = 1, keep: Column | None = None) -> DataFrame:
    """Edges from listed pairs ``(i, j)`` with copies and a condition; ``k`` numbers the copies (SRC-8)."""
    many = n if isinstance(n, Column) else F.lit(n)
    out = pairs.filter(keep) if keep is not None else pairs
    return out.filter(many > 0).withColumn("k", F.explode(F.sequence(F.lit(0), many.cast("int") - 1)))


def fixed_total_edges(spark: SparkSession, count: int, n_pre: int, n_post: int, seed: int) -> DataFrame:
    """``count`` edges with drawn ends; several may join the same two (SRC-10)."""
    pick = lambda name, n: F.floor(rng.uniform(seed, name, F.col("id")) * n).alias(name)
    return spark.range(count).select(F.col("id").alias("syn"), pick("i", n_pre), pick("j", n_post))


def chosen(n: int, k: int, seed: int, *keys: Column) -> Column:
    """``k`` different numbers below n, in the order in which repeated draws first show them. A few more than k draws
    do unless k is close to n; then, and in the rare other case, all n are ranked by hash."""
    k = min(k, n)
    draws = F.array_distinct(
        F.transform(
            F.sequence(F.lit(0), F.lit(4 * k + 32)),
            lambda r: F.floor(rng.uniform(seed, "choose", *keys, r) * n).cast("bigint"),
        )
    )
    ranked = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")),
        lambda x: F.struct(F.xxhash64(F.lit(seed), *keys, x).alias("h"), x.alias("x")),
    )
    every = F.transform(F.slice(F.array_sort(ranked), 1, k), lambda s: s["x"])
    return F.when(F.size(draws) >= k, F.slice(draws, 1, k)).otherwise(every)


def fixed_indegree_edges(spark: SparkSession, k: int, n_pre: int, n_post: int, seed: int) -> DataFrame:
    """Exactly k different sources for each target (SRC-11), made where the target's row stands, without a shuffle."""
    rows = spark.range(n_post)
    return rows.select(F.explode(chosen(n_pre, k, seed, F.col("id"))).alias("i"), F.col("id").alias("j"))


def swc(spark: SparkSession, path: str) -> DataFrame:
    """Points of a tree from a blank-separated file with # comments (SRC-12)."""
    line = F.trim(F.regexp_replace("value", r"\s+", " "))
    parts = F.split(line, " ")
    kinds = ("index int", "type int", "x double", "y double", "z double", "radius double", "parent int")
    rows = spark.read.text(path).filter((line != "") & ~line.startswith("#"))
    return rows.select(*[parts[k].cast(kind.split()[1]).alias(kind.split()[0]) for k, kind in enumerate(kinds)])


def point_issues(points: DataFrame) -> DataFrame:
    """Points whose parent comes later or is missing, and indices that occur twice (SRC-13)."""
    parents = points.select(F.col("index").alias("parent")).distinct().withColumn("known", F.lit(True))
    joined = points.join(parents, "parent", "left")
    count = F.count("*").over(Window.partitionBy("index"))
    problem = (
        F.when(F.col("n") > 1, "index twice")
        .when((F.col("parent") != -1) & F.col("known").isNull(), "no such parent")
        .when(F.col("parent") >= F.col("index"), "parent comes later")
    )
    return joined.withColumn("n", count).withColumn("issue", problem).filter("issue IS NOT NULL").select("index", "issue")


def imported(state: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """A state table with columns taken over from another by i, where it has the row (SRC-15)."""
    new = values.select("i", *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_has"))
    out = state.join(new, "i", "left")
    return out.select(
        *[F.when(F.col("_has"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else c for c in state.columns]
    )


#: Readers and writers of states by format (SRC-16).
FORMATS: dict[str, tuple[Callable, Callable]] = {
    "parquet": (lambda spark, path: spark.read.parquet(path), lambda df, path: df.write.parquet(path)),
    "json": (lambda spark, path: spark.read.json(path), lambda df, path: df.write.json(path)),
    "pandas": (lambda spark, frame: spark.createDataFrame(frame), lambda df, _: df.toPandas()),
    "dict": (
        lambda spark, found: spark.createDataFrame(list(zip(*found.values(), strict=True)), list(found)),
        lambda df, _: {c: [r[c] for r in df.collect()] for c in df.columns},
    ),
}


def register_format(name: str, reader: Callable, writer: Callable) -> None:
    if name in FORMATS:
        raise ValueError(f"format {name} exists")
    FORMATS[name] = (reader, writer)
