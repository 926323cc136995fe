"""Trees of compartments: geometry from points, selection, and the cable equation's linear solve."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compartments(points: DataFrame) -> DataFrame:
    """One compartment per point with a parent, between both: length, area, volume, mean diameter (SPA-4, JOIN-14)."""
    a = points.select(F.col("index").alias("parent"), *[F.col(c).alias(f"{c}0") for c in ("x", "y", "z", "radius")])
    rows = points.filter("parent <> -1").join(a, "parent")
    length = F.sqrt(sum(((F.col(c) - F.col(f"{c}0")) * (F.col(c) - F.col(f"{c}0")) for c in "xyz"), F.lit(0.0)))
    r0, r1 = F.col("radius0"), F.col("radius")
    slant = F.sqrt((r1 - r0) * (r1 - r0) + F.col("length") * F.col("length"))
    return rows.withColumn("length", length).select(
        F.col("index").alias("i"), "parent", "type", "length", (math.pi * (r0 + r1) * slant).alias("area"),
        (math.pi / 3 * F.col("length") * (r0 * r0 + r0 * r1 + r1 * r1)).alias("volume"), (r0 + r1).alias("diameter"),
        *[((F.col(c) + F.col(f"{c}0")) / 2).alias(c) for c in "xyz"],
    )


def path_distance(parts: DataFrame, most: int = 64) -> DataFrame:
    """Distance of each compartment's end from the root (SPA-5), by pointer doubling: each round doubles the stretch
    of ancestors that a row has summed up, so a path of 2**k compartments takes k rounds."""
    rows = parts.select("i", "parent", F.col("length").alias("distance"))
    for _ in range(most):
        up = rows.select(F.col("i").alias("parent"), F.col("parent").alias("_next"), F.col("distance").alias("_more"))
        joined = rows.join(up, "parent", "left")
        rows = joined.select("i", F.col("_next").alias("parent"), (F.col("distance") + F.coalesce("_more", F.lit(0.0))).alias("distance"))
        rows = rows.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else _cut(rows)
        if rows.filter("parent IS NOT NULL").isEmpty():
            return parts.join(rows.select("i", "distance"), "i")
    raise ValueError("the tree is deeper than that, or no tree")


def _cut(rows: DataFrame) -> DataFrame:
    import uuid

    from .network import folder, kept

    return kept(rows, f"{folder(rows.sparkSession)}/paths-{uuid.uuid4().hex}")


def between(parts: DataFrame, start: float, stop: float) -> DataFrame:
    """Compartments by their distance from the root (SPA-3)."""
    return parts.filter((F.col("distance") >= start) & (F.col("distance") < stop))


def by_type(parts: DataFrame, kind: int) -> DataFrame:
    return parts.filter(F.col("type") == kind)


def point_current(current: Column, area: Column) -> Column:
    """A current at a point as a density of its compartment (SPA-7)."""
    return current / area


def solve_tree(parent: np.ndarray, diagonal: np.ndarray, coupling: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The solution of a symmetric system whose off-diagonal entries join rows to their parents, who come first.
    ``coupling[k]`` is the entry between k and its parent (the root's is ignored). Leaves are eliminated into their
    parents, then values follow from the root out: one pass each way (INT-13)."""
    d, b = diagonal.astype(float).copy(), right.astype(float).copy()
    for k in range(len(d) - 1, 0, -1):
        f = coupling[k] / d[k]
        d[parent[k]] -= f * coupling[k]
        b[parent[k]] -= f * b[k]
    b[0] /= d[0]
    for k in range(1, len(d)):
        b[k] = (b[k] - coupling[k] * b[parent[k]]) / d[k]
    return b


def cable(parts: DataFrame, steps: int, dt: float, capacity: float, resistivity: float, leak: float) -> DataFrame:
    """Voltages of many neurons ``(neuron, i, parent, length, area, diameter, v, current)`` after some implicit steps;
    each neuron is one group, solved on its own. A compartment without area or neighbours keeps its voltage."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i").reset_index(drop=True)
        place = {k: n for n, k in enumerate(rows["i"])}
        parent = np.array([place.get(p, -1) for p in rows["parent"]])
        length, diameter, area = (rows[c].to_numpy(float) for c in ("length", "diameter", "area"))
        half = resistivity * (length / 2) / (math.pi * (diameter / 2) ** 2)
        axial = np.where(parent >= 0, 1 / (half + half[np.maximum(parent, 0)]), 0.0)
        total = axial.copy()
        np.add.at(total, np.maximum(parent, 0), np.where(parent >= 0, axial, 0.0))
        v, current = rows["v"].to_numpy(float), rows["current"].to_numpy(float)
        diagonal = capacity * area / dt + leak * area + total
        lone = diagonal == 0
        for _ in range(steps):
            right = np.where(lone, v, capacity * area / dt * v + current)
            v = solve_tree(np.maximum(parent, 0), np.where(lone, 1.0, diagonal), -axial, right)
        return pd.DataFrame({"neuron": rows["neuron"], "i": rows["i"], "v": v})

    return parts.groupBy("neuron").applyInPandas(run, "neuron long, i long, v double")
