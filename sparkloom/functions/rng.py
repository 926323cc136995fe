"""Random draws by counter: a function of (seed, stream, tick, row), whatever the partitions and their order.

Columns and arrays draw with the same generator, the 64-bit hash that Spark has as ``xxhash64``, so that a run folded in
an expression and one in a kernel see the same numbers. Draws of whole numbers go through their cumulated
probabilities; a table of these ends where the next one no longer changes the sum, so no outcome that a draw of 53
bits can have is cut off.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 2.0**-53
#: Rate of one Poisson draw; a larger rate is a sum of draws of at most this one.
STEP_RATE = 32.0
#: Constants of the hash (XXH64), and the seed that Spark gives it; fixed values.
PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
SPARK_SEED = 42


def uniform(seed: int, stream: str, *keys: Column) -> Column:
    """A double in [0, 1) from the top 53 bits of a hash; keys are whole numbers."""
    bits = F.xxhash64(F.lit(seed).cast("int"), F.lit(stream), *[k.cast("bigint") for k in keys])
    return F.shiftrightunsigned(bits, 11).cast("double") * F.lit(SCALE)


def prefix(seed: int, stream: str) -> int:
    """The hash of seed and stream, which those of the keys go on from."""
    first = xxhash.xxh64_intdigest(int(seed).to_bytes(4, "little", signed=True), SPARK_SEED)
    return xxhash.xxh64_intdigest(stream.encode(), first)


def hashed(before: np.ndarray | int, keys: np.ndarray) -> np.ndarray:
    """The hash of one more 64-bit key each."""
    a, b, c, d, e = map(np.uint64, PRIMES)
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    x = np.asarray(keys, np.int64).astype(np.uint64)
    h = (np.uint64(before) if isinstance(before, int) else before) + e + np.uint64(8)
    h = turn(h ^ (turn(x * b, 31) * a), 27) * a + d
    h = (h ^ (h >> np.uint64(33))) * b
    h = (h ^ (h >> np.uint64(29))) * c
    return h ^ (h >> np.uint64(32))


def uniforms(seed: int, stream: str, tick: int, ids: np.ndarray) -> np.ndarray:
    """``uniform`` with the keys tick and id, over arrays."""
    with np.errstate(over="ignore"):
        bits = hashed(hashed(prefix(seed, stream), np.array([tick])), ids)
    return (bits >> np.uint64(11)) * SCALE


def normal(seed: int, stream: str, *keys: Column) -> Column:
    """Box-Muller on two uniform draws."""
    u = 1.0 - uniform(seed, stream + "/r", *keys)
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * math.pi * uniform(seed, stream + "/a", *keys))


def normals(seed: int, stream: str, tick: int, ids: np.ndarray) -> np.ndarray:
    u, v = uniforms(seed, stream + "/r", tick, ids), uniforms(seed, stream + "/a", tick, ids)
    return np.sqrt(-2 * np.log(1 - u)) * np.cos(2 * np.pi * v)


def cumulated(first: float, ratio) -> list[float]:
    """Probabilities of 0, 1, ... summed up, from that of 0 and the ratio of the k-th to the one before, until the sum
    no longer changes; the last one, which no draw exceeds, is left out."""
    out, p, k = [first], first, 0
    while True:
        k += 1
        p *= ratio(k)
        if out[-1] + p == out[-1]:
            return out[:-1] if len(out) > 1 else out
        out.append(out[-1] + p)


def below(table: list[float], u: Column) -> Column:
    """How many entries of a rising table a draw has reached."""
    return F.size(F.filter(F.array(*map(F.lit, table)), lambda x: x <= u)).cast("bigint")


def binomial(n: int, p: float, seed: int, stream: str, *keys: Column) -> Column:
    """By inversion on the shorter tail; by a rounded normal where both tails are long (n p and n (1 - p) over 5)."""
    if p > 0.5:
        return F.lit(n).cast("bigint") - binomial(n, 1 - p, seed, stream, *keys)
    if n * p > 5:
        drawn = F.round(n * p + math.sqrt(n * p * (1 - p)) * normal(seed, stream, *keys))
        return F.least(F.greatest(drawn, F.lit(0.0)), F.lit(float(n))).cast("bigint")
    table = cumulated((1 - p) ** n, lambda k: (n - k + 1) / k * p / (1 - p) if k <= n else 0.0)
    return F.least(below(table, uniform(seed, stream, *keys)), F.lit(n).cast("bigint"))


def poisson(rate: float | Column, seed: int, stream: str, *keys: Column) -> Column:
    """Poisson draws, exact at any rate: as many draws as the rate has steps of ``STEP_RATE``, each by inversion. The
    rate may differ by row; one below 0 or no number gives null."""
    rate = rate.cast("double") if isinstance(rate, Column) else F.lit(float(rate))
    parts = F.greatest(F.ceil(rate / STEP_RATE), F.lit(1)).cast("int")
    most = int(STEP_RATE + 14 * math.sqrt(STEP_RATE) + 30)

    def one(part: Column) -> Column:
        own, u = rate / parts, uniform(seed, stream, *keys, part)
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.exp(-own).alias("p"), F.exp(-own).alias("sum"))

        def step(s: Column, k: Column) -> Column:
            p = s["p"] * own / k
            return F.struct((s["n"] + (s["sum"] <= u).cast("bigint")).alias("n"), p.alias("p"), (s["sum"] + p).alias("sum"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda s: s["n"])

    drawn = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0).cast("bigint"), lambda s, part: s + one(part))
    return F.when((rate >= 0) & (rate < float("inf")), drawn)


def poissons(rate: np.ndarray, seed: int, stream: str, tick: int, ids: np.ndarray) -> np.ndarray:
    """``poisson`` over arrays; rates below 0 and NaN give 0."""
    rate = np.nan_to_num(np.broadcast_to(np.asarray(rate, float), ids.shape)).clip(0)
    parts = np.maximum(np.ceil(rate / STEP_RATE), 1).astype(int)
    out, most = np.zeros(len(ids), np.int64), int(STEP_RATE + 14 * math.sqrt(STEP_RATE) + 30)
    with np.errstate(over="ignore"):
        bits = hashed(hashed(prefix(seed, stream), np.array([tick])), ids)
        for part in range(1, int(parts.max(initial=1)) + 1):
            own, live = rate / parts, parts >= part
            u = (hashed(bits, np.full(len(ids), part)) >> np.uint64(11)) * SCALE
            p = np.exp(-own)
            total = p.copy()
            for k in range(1, most + 1):
                out += live & (total <= u)
                p = p * own / k
                total = total + p
    return out
