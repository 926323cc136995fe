"""Mixing sources to target weights.

Sizes are word counts. Each source gets a target: its share, by weight, of a total, but at most ``epochs`` times
its own size; what a source cannot take goes to the others by weight. Within a source, documents are ordered by a
hash of their id (ranges of the hash first, then sorted within each range), their sizes are summed up along that
order, and the source is cut where the sum meets its budget, the whole words of its target: whole repetitions of
all its documents first, then one more copy of those before the cut; the document at the cut gives its first words.

A source of n documents is cut into about the square root of n ranges, so that neither a range nor the list of a
source's ranges, which are each sorted in one task, grows faster than that. Sources are one row each on the driver, at most ``MOST_SOURCES``.

Defined results: a null text has size 0; a null source is a source of its own, last in order; empty sources have
target 0; a null id is ordered like the empty string; rows with the same id are ordered by size, then by a hash of
all their columns, and only rows that are equal in all of them are numbered in any order; extra columns are kept by
``stage``.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import WORD, let, row_hash, table, written

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
EPOCHS = 2
MOST_SOURCES = 1_000_000


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> list[float]:
    """Targets of sources with these sizes: all are filled at the pace of their weights until they are full."""
    weight = [weights[k % len(weights)] for k in range(len(sizes))]
    left, rest, level = min(share, epochs) * sum(sizes), sum(weight), 0.0
    # the level rises while full sources are taken out, and would fall with the first that isn't full
    for k in sorted(range(len(sizes)), key=lambda k: epochs * sizes[k] / weight[k]):
        level = max(level, left / rest)
        left, rest = left - epochs * sizes[k], rest - weight[k]
    return [min(float(epochs * n), level * w) for n, w in zip(sizes, weight, strict=True)]


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``key``, a hash of the id, and ``tie``, a hash of the row."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        digest.alias("key"),
        row_hash(docs).alias("tie"),
    )


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS
) -> DataFrame:
    """Per document: ``doc_id``, ``source``, ``size``, ``source_size``, ``target`` and ``taken`` words; also ``key`` and
    ``tie``, how many rows are its ``equals``, itself among them, and how many of these come ``ahead``."""
    spark = docs.sparkSession
    rows = written(sized(docs), "sized")
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    found = by_source.orderBy(F.col("source").asc_nulls_last()).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    goal = targets([r["source_size"] for r in found], weights, share, epochs)
    kinds = StructType.fromDDL(f"source {dict(docs.dtypes)['source']}, source_size long, target double, ranges long")
    plan = [(r["source"], r["source_size"], t, math.isqrt(r["n"]) + 1) for r, t in zip(found, goal, strict=True)]
    # as Arrow: rows as tuples would start Python workers, which then stay beside the executors
    plan = spark.createDataFrame(pa.Table.from_pylist([dict(zip(kinds.names, x, strict=True)) for x in plan], to_arrow_schema(kinds)), kinds)
    # the first 52 bits of the key as a number in [0, 1); equal keys fall in one range
    place = F.conv(F.substring("key", 1, 13), 16, 10).cast("double") / F.lit(2.0**52)
    rows = rows.withColumnRenamed("source", "_source").join(
        F.broadcast(plan), F.col("_source").eqNullSafe(F.col("source"))
    )
    rows = rows.drop("_source").withColumn("range", F.floor(place * F.col("ranges")))
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("source").alias("_source"), F.col("range").alias("_range"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset")
    )
    ordered = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", "tie")
    within = ordered.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "*",
        F.coalesce(F.sum("size").over(within), F.lit(0)).alias("_within"),
        F.count("*").over(ordered.rangeBetween(Window.currentRow, Window.currentRow)).alias("equals"),
        (F.row_number().over(ordered) - F.rank().over(ordered)).cast("long").alias("ahead"),
    )
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("_source")) & (F.col("range") == F.col("_range")))
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - whole * F.col("source_size") - F.col("offset") - F.col("_within")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least("size", rest))
    return rows.select(
        "doc_id", "source", "key", "size", "tie", "equals", "ahead", "source_size", "target", taken.cast("long").alias("taken")
    )


def op4_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH d AS (
    SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
    FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM s),
r AS (
    SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER up, 0))
              / (sum(weight) OVER () - coalesce(sum(weight) OVER up, 0)) AS level
    FROM w
    WINDOW up AS (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max(level) AS level FROM r),
t AS (SELECT source, source_size,
             least(2.0::DOUBLE * source_size, l.level * weight) AS target
      FROM w, l),
c AS (
    SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS budget,
           coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0
            ELSE budget // source_size * size
                 + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken
FROM c
"""


def cuts(docs: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """Per source: how many ``whole`` repetitions it gives, the place in the order of the document where it is cut,
    how many rows are its ``equals`` and how many of these come ``ahead`` of it, and how many ``words`` of it come in.
    Documents with smaller places come once more."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0)
    more = F.col("taken") - F.col("whole") * F.col("size")
    place = F.struct("key", F.struct("doc_id", "size", "tie").alias("rest"), "ahead", "equals", more.alias("words"))
    first = F.min(F.when(more < F.col("size"), place))
    return mix(docs, epochs=epochs).withColumn("whole", whole).groupBy("source", "whole").agg(first.alias("cut"))


def stage(spark, docs, sf_dir):
    """Each document as often as the mix takes it; the one at a source's cut gives its first words once more.
    Only the narrow table of sizes is sorted; the texts meet the cuts, one row a source, where they are read. Where
    several equal rows lie at a cut, one of them stands for all that come in once more."""
    plan = cuts(docs).select(F.col("source").alias("_source"), F.col("whole").alias("_whole"), F.col("cut").alias("_cut"))
    plan = written(plan, "cuts")
    key = F.md5(F.coalesce(docs["doc_id"].cast("string"), F.lit("")))
    size = F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("long")
    rest = F.struct(docs["doc_id"].alias("doc_id"), size.alias("size"), row_hash(docs).alias("tie"))
    side = (  # before, at or behind the cut; the whole place is computed for rows of the cut's key alone
        F.when(F.col("_cut").isNull() | (key < F.col("_cut.key")), -1)
        .when(key > F.col("_cut.key"), 1)
        .otherwise(let(rest, lambda x: F.when(x < F.col("_cut.rest"), -1).when(x > F.col("_cut.rest"), 1).otherwise(0)))
    )
    rows = docs.join(F.broadcast(plan), docs["source"].eqNullSafe(F.col("_source"))).withColumn("_side", side)
    alone = F.when(F.col("_cut.equals") == 1, F.col("_cut.words"))
    last = F.when(F.col("_side") < 0, -1).when(F.col("_side") == 0, alone)
    # -1: the whole text
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), F.col("_whole").cast("int")), F.array(last.cast("long")))
    if not plan.filter("_cut.equals > 1").isEmpty():
        again = rows.filter("_side = 0 AND _cut.equals > 1").dropDuplicates(["_source"])
        again = again.withColumn("_copies", F.concat(F.array_repeat(F.lit(-1).cast("long"), F.col("_cut.ahead").cast("int")), F.array("_cut.words")))
        rows = rows.withColumn("_copies", copies).unionByName(again)
    else:
        rows = rows.withColumn("_copies", copies)
    rows = rows.withColumn("_words", F.explode(F.filter("_copies", lambda x: x.isNotNull() & (x != 0))))
    parts = F.regexp_extract_all("text", F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    rows = rows.filter(F.regexp_like("text", F.lit(WORD)))
    head = F.array_join(F.slice(parts, 1, F.greatest(F.col("_words"), F.lit(1)).cast("int")), "")
    rows = rows.withColumn("text", F.when(F.col("_words") < 0, F.col("text")).otherwise(head))
    if "n_chars" in docs.columns:
        cut = F.when(F.col("_words") < 0, F.col("n_chars")).otherwise(F.length("text"))
        rows = rows.withColumn("n_chars", cut.cast(dict(docs.dtypes)["n_chars"]))
    return rows.select(docs.columns)
