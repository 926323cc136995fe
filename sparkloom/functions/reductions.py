"""Reductions of columns and searches in sorted values, as NumPy has them for arrays (AGG-15, WIN-10, SORT-6).

Each gives an aggregate (or, for the running ones, a window) expression. Nulls are left out; of no values the sum and
the product are 0 and 1, ``every`` is true and ``some`` false, all else is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0.0))


def prod(x: Column) -> Column:
    return F.coalesce(F.product(x), F.lit(1.0))


def ptp(x: Column) -> Column:
    return F.max(x) - F.min(x)


def some(condition: Column) -> Column:
    return F.coalesce(F.bool_or(condition), F.lit(False))


def every(condition: Column) -> Column:
    return F.coalesce(F.bool_and(condition), F.lit(True))


def argmin(x: Column, place: Column) -> Column:
    """The place of the least value, the first of equal ones."""
    return F.min(F.when(x.isNotNull(), F.struct(x.alias("x"), place.alias("place"))))["place"]


def argmax(x: Column, place: Column) -> Column:
    return F.max(F.when(x.isNotNull(), F.struct(x.alias("x"), (-place).alias("place"))))["place"] * -1


def dot(a: Column, b: Column) -> Column:
    return total(a * b)


def trace(row: Column, column: Column, value: Column) -> Column:
    """The sum along the diagonal of a matrix given by entries."""
    return total(F.when(row == column, value))


def nonzero(x: Column) -> Column:
    return F.count_if(x != 0)


def cumsum(x: Column, order: list[str], by: tuple[str, ...] = ()) -> Column:
    return F.sum(x).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def cumprod(x: Column, order: list[str], by: tuple[str, ...] = ()) -> Column:
    return F.product(x).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def running_count(order: list[str], by: tuple[str, ...] = ()) -> Column:
    return F.count("*").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def searchsorted(x: Column, edges: list[float], right: bool = False) -> Column:
    """How many of the sorted edges lie below a value (or, ``right``, not above it); an expression of their number."""
    fixed = F.array(*[F.lit(float(e)) for e in edges])
    return F.size(F.filter(fixed, lambda e: (e <= x) if right else (e < x)))


def argsort(rows: DataFrame, order: list[str], by: tuple[str, ...], name: str = "place") -> DataFrame:
    """Rows with their place, from 1, in the order of each group (SORT-1)."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint"))
