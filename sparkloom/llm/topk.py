"""Exact top-k search in Hamming distance by incremental multi-index hashing.

Vectors become 64-bit codes, a bit per component that is positive. A code is cut into segments of about as many bits
as the index has rows in its logarithm, and has an index row for each. In round r every open query looks up, in each
segment, all values at distance r from its own; what it finds is verified on the whole code. After round r every
code within ``segments * (r + 1) - 1`` has been found, since a farther one alone can differ by more than r in all
segments; a query is closed once its k-th distance is within that radius.

Equal codes are one index entry with its k + 1 smallest ids, and equal query codes one query, so a vector that is
repeated ever so often costs one lookup. A pair is taken only in the round and segment that find it first.

Defined results: neighbours are ordered by distance, then id; a query is not its own neighbour, though another row
with its id counts as the same and is left out too; rows with a null id or vector, or a null component, are neither
queries nor neighbours; vectors shorter than 64 leave the other bits 0, longer ones are an error; with fewer than k
others all are returned; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

K = 10
BITS = 64
QUERY_STEP = 50


def code(vector: Column) -> Column:
    """The sign bits of a vector as a long; null if it has none for some component."""
    masks = F.array(*[F.lit(1 << b if b < BITS - 1 else -(1 << b)).cast("long") for b in range(BITS)])
    bits = F.transform(vector, lambda x, i: F.when(x.isNull(), None).when(x > 0, F.get(masks, i)).otherwise(F.lit(0)))
    found = F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return F.when(F.size(vector) > BITS, F.raise_error(F.lit(f"more than {BITS} components"))).otherwise(found)


class Segments:
    """How codes are cut: ``count`` segments, the first ones a bit longer where they can't be equal."""

    def __init__(self, rows: int):
        self.count = min(8, max(2, math.ceil(BITS / max(1.0, math.log2(max(2, rows))))))
        self.widths = [BITS // self.count + (k < BITS % self.count) for k in range(self.count)]
        self.starts = [sum(self.widths[:k]) for k in range(self.count)]

    def of(self, value: Column, k: int) -> Column:
        return F.shiftrightunsigned(value, self.starts[k]).bitwiseAND(F.lit((1 << self.widths[k]) - 1).cast("long"))

    def apart(self, a: Column, b: Column, k: int) -> Column:
        return F.bit_count(self.of(a, k).bitwiseXOR(self.of(b, k)))

    def entries(self, value: Column) -> Column:
        return F.array(*[F.struct(F.lit(k).alias("seg"), self.of(value, k).alias("key")) for k in range(self.count)])

    def probes(self, value: Column, radius: int) -> Column:
        """Entries at this distance from the value's own, segment by segment."""

        def around(k: int) -> Column:
            masks = [sum(1 << b for b in flipped) for flipped in combinations(range(self.widths[k]), radius)]
            fixed = F.split(F.lit(",".join(map(str, masks))), ",").cast("array<bigint>")
            return F.transform(
                fixed, lambda m: F.struct(F.lit(k).alias("seg"), self.of(value, k).bitwiseXOR(m).alias("key"))
            )

        return F.concat(*[around(k) for k in range(self.count) if radius <= self.widths[k]])

    def first_found(self, a: Column, b: Column, seg: Column, radius: int) -> Column:
        """Whether no earlier round, and no earlier segment of this round, finds b from a."""
        out = F.lit(True)
        for k in range(self.count):
            far = self.apart(a, b, k)
            out = out & ((far > radius) | ((far == radius) & (seg <= k)))
        return out


def smallest(rows: DataFrame, by: str, order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each group; Spark drops the others before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= most)


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``query_id``, ``vec_id``, ``distance`` and ``rank`` of each query's k nearest; both tables have ``vec_id``
    and ``embedding``."""
    spark = vectors.sparkSession

    def coded(df: DataFrame) -> DataFrame:
        rows = df.select("vec_id", code(F.col("embedding")).alias("code"))
        return rows.filter("vec_id IS NOT NULL AND code IS NOT NULL").distinct()

    ids = F.array_sort(F.collect_list("vec_id")).alias("ids")
    base = written(smallest(coded(vectors), "code", ["vec_id"], k + 1).groupBy("code").agg(ids), "codes")
    cut = Segments(base.count())
    index = base.withColumn("entry", F.explode(cut.entries(F.col("code")))).select("entry.*", "code", "ids")
    own = written(coded(queries), "queries")
    pending = own.select(F.col("code").alias("q")).distinct().withColumn("worst", F.lit(BITS))
    best = spark.createDataFrame([], f"q long, distance int, vec_id {dict(vectors.dtypes)['vec_id']}")
    done = []
    for radius in range(max(cut.widths) + 1):
        probes = pending.withColumn("entry", F.explode(cut.probes(F.col("q"), radius))).select("q", "worst", "entry.*")
        found = (
            # probes come by the thousand from each query, which Spark's estimate of their size can't see
            probes.hint("merge").join(index, ["seg", "key"])
            .filter(cut.first_found(F.col("q"), F.col("code"), F.col("seg"), radius))
            .withColumn("distance", F.bit_count(F.col("q").bitwiseXOR(F.col("code"))).cast("int"))
            .filter(F.col("distance") <= F.col("worst"))
            .select("q", "distance", F.explode("ids").alias("vec_id"))
        )
        best = written(smallest(best.unionByName(found), "q", ["distance", "vec_id"], k + 1).drop("rank"), "best")
        reached = best.groupBy("q").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
        state = pending.select("q").join(reached, "q", "left")
        full = F.coalesce(F.col("n") > k, F.lit(False))
        closed = full & (F.col("far") <= cut.count * (radius + 1) - 1)
        open_ = state.filter(~closed).select("q", F.when(full, F.col("far")).otherwise(BITS).alias("worst"))
        pending = written(open_, "pending")
        done.append(best.join(pending, "q", "left_anti"))
        best = best.join(pending, "q", "left_semi")
        if pending.isEmpty():
            break
    done.append(best)
    pairs = own.select(F.col("vec_id").alias("query_id"), F.col("code").alias("q")).join(reduce(DataFrame.unionByName, done), "q")
    # a query with several codes takes each neighbour at its nearest
    others = pairs.filter("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("distance").alias("distance"))
    return smallest(others, "query_id", ["distance", "vec_id"], k)


def op7_exact_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter(F.col("vec_id") % QUERY_STEP == 0))


SQL = f"""
WITH bits AS (
    SELECT vec_id, list_reduce(list_prepend(0::UBIGINT, list_transform(embedding,
               lambda x, i: CASE WHEN x > 0 THEN 1::UBIGINT << (i - 1)::UBIGINT ELSE 0::UBIGINT END)),
               lambda a, b: a | b) AS code
    FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
pairs AS (
    SELECT q.vec_id AS query_id, v.vec_id, CAST(bit_count(xor(q.code, v.code)) AS INTEGER) AS distance
    FROM bits q JOIN bits v ON q.vec_id % {QUERY_STEP} = 0 AND v.vec_id <> q.vec_id)
SELECT query_id, vec_id, distance, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs)
WHERE rank <= {K}
"""
