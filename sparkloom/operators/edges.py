"""Edge tables: ways to connect nodes, indexing, numbering, attributes, and gathers from both ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rng
from ..sources.tables import chosen


def _pre(nodes: DataFrame) -> DataFrame:
    return nodes.select(*[F.col(c).alias("i" if c == "i" else f"{c}_pre") for c in nodes.columns])


def _post(nodes: DataFrame) -> DataFrame:
    return nodes.select(*[F.col(c).alias("j" if c == "i" else f"{c}_post") for c in nodes.columns])


def connect_condition(pre: DataFrame, post: DataFrame, condition: Column) -> DataFrame:
    """All pairs for which the condition holds (JOIN-2, FLT-8). An equality between both sides in it becomes a hash
    join (JOIN-6); what concerns one side alone is filtered before pairing (EDG-4). Only the ids and the columns
    that the condition names are carried."""
    return _pre(pre).join(_post(post), condition)


def connect_range(pre: DataFrame, start: Column, stop: Column, step: int = 1, n_post: int | None = None, keep: Column | None = None) -> DataFrame:
    """For each i the targets start, start + step, ... before stop (JOIN-3); targets out of range are an error, or
    skipped where ``n_post`` is given (FLT-10)."""
    last = stop - 1 if step > 0 else stop + 1
    some = (start < stop) if step > 0 else (start > stop)
    out = pre.filter(some).withColumn("j", F.explode(F.sequence(start.cast("bigint"), last.cast("bigint"), F.lit(step).cast("bigint"))))
    if n_post is not None:
        out = out.filter((F.col("j") >= 0) & (F.col("j") < n_post))
    return out.filter(keep) if keep is not None else out


def connect_one_to_one(pre: DataFrame, post: DataFrame) -> DataFrame:
    """Each i with the j of the same number (JOIN-5)."""
    return _pre(pre).join(_post(post), F.col("i") == F.col("j"))


def connect_random(pre: DataFrame, n_post: int, p: float, seed: int) -> DataFrame:
    """Pairs with probability p (FLT-9, JOIN-4). Rather than trying all pairs, each i skips ahead by geometric gaps:
    the k-th gap of i is a function of (seed, i, k), so the work is that of the edges that come out."""
    if p <= 0:
        return pre.select("i", F.lit(0).cast("bigint").alias("j")).limit(0)
    if p >= 1:
        return pre.select("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_post - 1).cast("bigint"))).alias("j"))
    # the targets are cut into stretches of about 64 expected edges; a stretch's gaps go on until they leave it, which
    # they do at the latest after as many as it has targets
    width = min(n_post, max(1, int(64 / p)))
    stretches = pre.select("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit((n_post - 1) // width).cast("bigint"))).alias("_part"))
    usual = min(width, 64 + 12 * 8 + 20)

    def gap(k: Column) -> Column:
        return F.floor(F.log(1.0 - rng.uniform(seed, "gap", F.col("i"), F.col("_part"), k)) / F.log(F.lit(1.0 - p))).cast("bigint") + 1

    def places(last: int) -> Column:
        gaps = F.transform(F.sequence(F.lit(0), F.lit(last)), gap)
        start = F.array(F.lit(-1).cast("bigint"))
        return F.slice(F.aggregate(gaps, start, lambda s, g: F.array_append(s, F.element_at(s, -1) + g)), 2, last + 1)

    found = places(usual)
    # gaps that have not left the stretch by then are all drawn
    whole = F.when(F.element_at(found, -1) < width, places(width)).otherwise(found) if usual < width else found
    out = stretches.select("i", "_part", F.explode(whole).alias("_at")).filter(F.col("_at") < width)
    return out.select("i", (F.col("_part") * width + F.col("_at")).alias("j")).filter(F.col("j") < n_post)


def connect_sample(pre: DataFrame, n_post: int, size: int, seed: int) -> DataFrame:
    """For each i, ``size`` different targets (JOIN-4)."""
    return pre.select("i", F.explode(chosen(n_post, size, seed, F.col("i"))).alias("j"))


def number_duplicates(edges: DataFrame, by: list[str], order: list[str], name: str = "k") -> DataFrame:
    """A running number from 0 among edges between the same two nodes (WIN-2, JOIN-13)."""
    return edges.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def append(*edges: DataFrame) -> DataFrame:
    """Edges of several connect calls, in one table (SET-2)."""
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e, allowMissingColumns=True)
    return out


def at(edges: DataFrame, i: slice | int | Column | None = None, j: slice | int | Column | None = None, k: slice | int | Column | None = None) -> DataFrame:
    """Edges by source, target and copy: numbers, ranges or predicates, all of which must hold (FLT-7, SET-1)."""
    for name, want in (("i", i), ("j", j), ("k", k)):
        c = F.col(name)
        if isinstance(want, slice):
            start, step = want.start or 0, want.step or 1
            edges = edges.filter((c >= start) & (F.lit(want.stop is None) | (c < (want.stop or 0))) & ((c - start) % step == 0))
        elif want is not None:
            edges = edges.filter(want if isinstance(want, Column) else c == want)
    return edges


def out_of_range(edges: DataFrame, n_pre: int, n_post: int) -> DataFrame:
    """Listed edges whose ends don't exist (EDG-9)."""
    return edges.filter((F.col("i") < 0) | (F.col("i") >= n_pre) | (F.col("j") < 0) | (F.col("j") >= n_post))


def with_attribute(edges: DataFrame, name: str, value: Column, where: Column | None = None) -> DataFrame:
    """Set an edge column, everywhere or under a condition (EDG-5, EDG-6)."""
    if where is not None:
        old = F.col(name) if name in edges.columns else F.lit(None)
        value = F.when(where, value).otherwise(old)
    return edges.withColumn(name, value)


def clipped_normal(mean: float, sd: float, low: float, high: float, seed: int, *keys: Column) -> Column:
    """Normal draws held between bounds (EDG-8)."""
    return F.least(F.greatest(F.lit(mean) + sd * rng.normal(seed, "clipped", *keys), F.lit(low)), F.lit(high))


def uniform_between(low: float, high: float, seed: int, *keys: Column) -> Column:
    return F.lit(low) + (high - low) * rng.uniform(seed, "between", *keys)


def gather(edges: DataFrame, pre: DataFrame | None = None, post: DataFrame | None = None) -> DataFrame:
    """Edges with the columns of their ends, as ``x_pre`` and ``x_post`` (JOIN-7). Spark broadcasts a side that its
    statistics show to be small and otherwise sorts and merges; skewed ends are split by AQE."""
    if pre is not None:
        edges = edges.join(_pre(pre), "i")
    return edges.join(_post(post), "j") if post is not None else edges


def linked(rows: DataFrame, target: DataFrame, index: str, columns: list[str]) -> DataFrame:
    """Columns of another table, by an index column (JOIN-8, PRJ-16)."""
    other = target.select(F.col("i").alias(index), *[F.col(c).alias(f"{c}_linked") for c in columns])
    return rows.join(other, index, "left")


def degrees(edges: DataFrame, end: str, n: DataFrame) -> DataFrame:
    """Edges at each node, 0 where there are none (AGG-5)."""
    found = edges.groupBy(F.col(end).alias("i")).agg(F.count("*").alias("degree"))
    return n.select("i").join(found, "i", "left").select("i", F.coalesce("degree", F.lit(0)).alias("degree"))


def delivery_order(edges: DataFrame) -> DataFrame:
    """Edges of each target by falling delay, then source, then creation, with their rank (SORT-5)."""
    w = Window.partitionBy("j").orderBy(F.desc("delay"), "i", "seq")
    return edges.withColumn("rank", F.row_number().over(w) - 1)
