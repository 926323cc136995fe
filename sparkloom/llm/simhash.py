"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint's ball is every 64-bit value within half the link radius of it. Two fingerprints lie within the
radius exactly if their balls meet, so all values of all balls are dealt out and those that several balls hold
link their owners. A ball has 2081 values at radius 4; to keep the shuffle small, a fingerprint travels once to
each *route* (the leading bits of a value) that its ball touches, and the values under that route are written out
where they are sorted. Routes get longer as the corpus grows, so that a route's share stays the same size.

Links between different fingerprints are joined to components by large-star and small-star rounds over tables in
the shared folder; each route passes on a spanning forest of its links, never all pairs.

Defined results: a null text counts as empty; a text without words has fingerprint zero and is linked like any
other; rows with the same fingerprint are one component, rows that merely share an id are not; rows without an id
link like all others; ``component_id`` is the smallest non-null id of the component, null if there is none; repeated
rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, row_hash, slices, table, written

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Ball values that one route should hold, and that are sorted at a time.
ROUTE_VALUES = 1 << 22
MIN_ROUTE_BITS = 10
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles, A to Z lower-cased."""
    parts = WORD_BYTES.findall((text or "").encode("utf-8", "replace").lower())
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(parts) - shingle + 1)
    spans = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n)
    for k in range(0, n, BLOCK):
        ones += np.unpackbits(hashes[k : k + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64
        )
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, also: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns ``also`` and ``fp``, the fingerprint as a signed long."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (piece for batch in parts for piece in slices(batch, 1)):
            found = [fingerprint(x.as_py(), shingle) for x in part.column(1)]
            fps = pa.array(np.array(found, np.uint64).view(np.int64))
            rest = [part.column(k) for k in range(2, part.num_columns)]
            yield pa.RecordBatch.from_arrays([part.column(0), *rest, fps], ["doc_id", *also, "fp"])

    kind = dict(docs.dtypes)
    schema = ", ".join(f"{c} {kind[c]}" for c in ("doc_id", *also))
    return docs.select("doc_id", "text", *also).mapInArrow(batches, f"{schema}, fp long")


def ball_size(bits: int, reach: int) -> int:
    return sum(math.comb(bits, k) for k in range(reach + 1))


def flips(bits: int, reach: int) -> np.ndarray:
    """Masks of all ways to flip at most ``reach`` of the lowest ``bits`` bits."""
    masks = [sum(1 << b for b in chosen) for k in range(reach + 1) for chosen in combinations(range(bits), k)]
    return np.array(masks, np.uint64)


def routed(nodes: DataFrame, bits: int, reach: int) -> DataFrame:
    """Each node once for every route that its ball touches."""
    home = F.shiftrightunsigned("fp", 64 - bits)
    masks = F.array(*[F.lit(int(m)) for m in flips(bits, reach)])
    return nodes.select("fp", "rep", home.alias("home"), F.explode(masks).alias("mask")).select(
        F.col("home").bitwiseXOR(F.col("mask")).alias("route"), "fp", "rep"
    )


def meetings(fps: np.ndarray, left: np.ndarray, bits: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions in ``fps`` whose balls hold the same value. Only the lowest ``bits`` bits are still to be
    flipped, ``left[i]`` times at most for the i-th. Too many values for one sort are split by their next bit."""
    if len(fps) < 2:
        return
    total = sum(int((left == k).sum()) * ball_size(bits, k) for k in range(int(left.max()) + 1))
    if total > most and bits > 8:
        top = np.uint64(1 << (bits - 1))
        for value in (np.uint64(0), top):
            spent = left - ((fps & top) != value)
            keep = np.flatnonzero(spent >= 0)
            for a, b in meetings(fps[keep], spent[keep], bits - 1, most):
                yield keep[a], keep[b]
        return
    low = np.uint64((1 << bits) - 1)
    values, owners = [], []
    for k in range(int(left.max()) + 1):
        own = np.flatnonzero(left == k)
        masks = flips(bits, k)
        values.append(((fps[own] & low)[:, None] ^ masks[None, :]).ravel())
        owners.append(np.repeat(own, len(masks)))
    value, owner = np.concatenate(values), np.concatenate(owners)
    order = np.argsort(value)
    value, owner = value[order], owner[order]
    same = np.flatnonzero(value[1:] == value[:-1])
    yield owner[same], owner[same + 1]


def forest(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The labels after joining by the links a-b. A label is the smallest position of a component; it labels itself."""
    while True:
        ra, rb = label[a], label[b]
        apart = ra != rb
        if not apart.any():
            return label
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
        while (label[label] != label).any():
            label = label[label]


def links(nodes: DataFrame, radius: int = RADIUS, route_values: int = ROUTE_VALUES) -> DataFrame:
    """Links ``a``-``b`` (b < a) between ids of linked nodes: per route, everyone to the smallest of its component."""
    if radius % 2:
        raise ValueError("the radius must be even: a ball has half of it")
    reach = radius // 2
    n = max(1, nodes.count())
    bits = max(MIN_ROUTE_BITS, math.ceil(math.log2(n * ball_size(64, reach) / route_values)))

    def joined(group: pa.Table) -> pa.Table:
        fps = group.column("fp").to_numpy().view(np.uint64)
        reps = group.column("rep").to_numpy()
        order = np.lexsort((fps, reps))
        fps, reps = fps[order], reps[order]
        route = np.uint64(group.column("route")[0].as_py())
        left = reach - np.bitwise_count((fps >> np.uint64(64 - bits)) ^ route).astype(np.int64)
        label = np.arange(len(fps))
        for a, b in meetings(fps, left, 64 - bits, route_values):
            near = np.bitwise_count(fps[a] ^ fps[b]) <= radius
            pairs = np.unique(np.minimum(a, b)[near] * len(fps) + np.maximum(a, b)[near])
            label = forest(pairs // len(fps), pairs % len(fps), label)
        moved = np.flatnonzero(reps[label] != reps)
        return pa.table({"a": reps[moved], "b": reps[label][moved]})

    return routed(nodes, bits, reach).groupBy("route").applyInArrow(joined, "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node that has a link."""

    def star(both: DataFrame) -> DataFrame:
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        return both.join(least, "u").withColumn("m", F.least("u", "m"))

    def settled(edges: DataFrame) -> bool:
        """Whether every node has one edge, to a node that has none: then these are the components' roots."""
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("low"), F.lit(0).alias("top")).union(
            edges.select("v", F.lit(0), F.lit(1))
        )
        by = ends.groupBy("x").agg(F.sum("low").alias("low"), F.max("top").alias("top"))
        return by.agg(F.max(F.col("low") + F.col("top"))).first()[0] in (None, 1)

    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    for _ in range(rounds):
        if settled(edges):
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = star(large)
        rooted = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            small.select("u", F.col("m").alias("v"))
        )
        edges = written(rooted.filter("u <> v").distinct(), "edges")
    else:
        raise RuntimeError(f"components were not settled after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def grouped(
    docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, also: tuple[str, ...] = ()
) -> DataFrame:
    """``doc_id``, the columns ``also``, ``fp``, ``component_id`` and ``root``, the component's key, for every row."""
    fps = written(fingerprints(docs, shingle, also), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    # every fingerprint is a node of its own, so that rows without an id link too
    roots = components(links(nodes.select("fp", F.col("fp").alias("rep")), radius))
    found = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    found = written(found, "roots")
    ids = found.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(found.select("fp", "root").join(ids, "root"), "fp")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` for every row."""
    return grouped(docs, radius, shingle).select("doc_id", "fp", "component_id")


def op10_simhash_near_dedup(spark, sf_dir):
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark, docs, sf_dir):
    """Of each component keep one row: that with the smallest id, rows without an id last, then by a hash of the row.
    A component without any id keeps one row too, and unrelated texts that share an id are all kept."""
    keyed = docs.withColumn("_row", row_hash(docs))
    rows = grouped(keyed, also=("_row",))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    kept = rows.groupBy("root").agg(F.min(order).alias("first")).select("first._row")
    return keyed.join(kept, "_row").dropDuplicates(["_row"]).select(docs.columns)
