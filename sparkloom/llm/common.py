"""What the operators share: word patterns, tables, and places where lineage is cut."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_TEXT = re.compile(WORD)
WORD_BYTES = re.compile(WORD.encode())

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session within one JVM, as in tests, may leave it unset; it
    then gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_written: list[list[str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table in the shared folder, so that a lost executor costs a reread, not the work before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkloom/{name}-{uuid.uuid4().hex}"
    if _written:
        _written[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of the shared folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession):
    """Tables that are written within the block are deleted after it; results must be on disk by then."""
    _written.append([])
    try:
        yield
    finally:
        removed(spark, _written.pop())


def slices(part: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch as pieces of about ``most`` bytes of text each, one row at least, so that what is made of a piece is
    small whatever the batch; an empty batch is one piece."""
    size = np.asarray(pc.fill_null(pc.binary_length(part.column(column)), 0), np.int64)
    at = 0
    while at < len(size) or not len(size):
        n = max(1, int(np.searchsorted(np.cumsum(size[at : at + 4096]), most, "right")))
        yield part.slice(at, n)
        if not len(size):
            return
        at += n


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """A to Z lower-cased, all else untouched."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def row_hash(df: DataFrame) -> Column:
    """128 bits over all columns, as a struct of two longs: a total order of rows up to rows that are all equal."""
    parts = [x for c in df.columns for x in (df[c].isNull(), df[c])]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))


def join_ids(df: DataFrame, ids: DataFrame, key: str, how: str, bound: int = 1_000_000) -> DataFrame:
    """Join a narrow table of distinct keys to a wide one. It is broadcast only where a count shows at most
    ``bound`` rows; beyond that both sides are dealt out by key, where Spark splits skewed partitions."""
    small = ids.limit(bound + 1).count() <= bound
    return df.join(F.broadcast(ids) if small else ids.hint("merge"), key, how)
