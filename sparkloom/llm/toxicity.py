"""Toxicity: a classifier of words and word beginnings, regularised by counterfactuals.

A text's features are the words that it has (lower-cased runs of letters) and their first ``PREFIX`` letters, as a
set, so that long and short texts are judged alike. The ``FEATURES`` ones that set toxic texts apart most are chosen
by a z-score of their log odds over the training sample, and logistic regression weighs them. Words that name groups
of people (``IDENTITY``) are always features; for every training text that names a group, the names are swapped for
those of the next group and the squared change of the score is a penalty, so that naming a group neither speaks for
nor against a text.

The classifier is fitted on at most ``SAMPLE`` labelled rows, those whose ids have the smallest hashes; every whole
text is scored. Labels are learnt from only where ``crc32(doc_id) mod 3`` is not 1.

Defined results: a null or empty text has no features and gets the base score; null labels and ids are not learnt
from, nor labels other than 0 and 1 (of any type that casts to them); with no toxic or no other training text every score is 0; equal ids with several labels or texts give all
combinations to learn from; repeated rows each give a row; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_ids, slices, table, written

SAMPLE = 20_000
FEATURES = 2_000
LEAST_DOCS = 4
#: Least absolute z-score of a feature.
LEAST_Z = 3.0
PREFIX = 5
THRESHOLD = 0.7
L2 = 3e-5
COUNTERFACTUAL = 1.0
ROUNDS = 600
STEP = 0.05
TOKEN = re.compile(r"[^\W\d_]+")

#: Names of groups of people, a line each of names that take one another's place; fixed values.
IDENTITY = (
    ("women", "men", "girls", "boys", "trans", "gay", "lesbian", "straight"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "muslim", "christian", "jewish"),
    ("black", "white", "asian", "latino", "african", "european", "immigrants", "refugees"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "noirs", "blancs", "immigrés"),
    ("frauen", "männer", "muslime", "christen", "juden", "schwarze", "weiße", "flüchtlinge"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "negros", "blancos", "inmigrantes"),
)


def features(text: str | None) -> set[str]:
    """The words of a text, and for longer ones their beginning with a ``^`` before it."""
    found = set(TOKEN.findall((text or "").lower()))
    return found | {f"^{w[:PREFIX]}" for w in found if len(w) > PREFIX}


def swaps() -> dict[str, str]:
    return {a: row[(k + 1) % len(row)] for row in IDENTITY for k, a in enumerate(row)}


class Classifier(NamedTuple):
    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        own = features(text)
        known = own & self.weights.keys() if len(own) > len(self.weights) else [w for w in own if w in self.weights]
        # sorted, so that the sum doesn't depend on the order within a set
        x = self.bias + sum(self.weights[w] for w in sorted(known))
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """``text`` and ``toxic`` of the labelled rows with the smallest id hashes, at most ``most`` labels."""
    marked = labels.select("doc_id", F.col("toxic").try_cast("int").alias("toxic"))
    usable = marked.filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
    chosen = usable.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", "toxic").limit(most)
    return join_ids(docs.select("doc_id", "text"), chosen, "doc_id", "inner", most)


def choose(found: DataFrame, most: int, least: int = LEAST_DOCS) -> list[str]:
    """Features with the highest absolute z-scores of their log odds, by sample texts that have them."""
    y = found.groupBy("toxic").agg(F.sum("n").alias("n")).filter("toxic IS NOT NULL").collect()
    totals = {r["toxic"]: r["n"] for r in y}
    if len(totals) < 2:
        return []
    a, b = F.col("bad") + 0.5, F.col("good") + 0.5
    odds = F.log(a / (totals[1] - F.col("bad") + 0.5)) - F.log(b / (totals[0] - F.col("good") + 0.5))
    z = F.abs(odds / F.sqrt(1 / a + 1 / b))
    by = found.filter("feature IS NOT NULL").groupBy("feature").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"),
    )
    top = by.filter((F.col("bad") + F.col("good") >= least) & (z >= LEAST_Z)).orderBy(z.desc(), "feature").limit(most)
    return [r["feature"] for r in top.select("feature").collect()]


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, n_features: int = FEATURES) -> Classifier:
    rows = written(sample(docs, labels, most).select("text", "toxic"), "toxicity-sample")

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of features among toxic and other texts; a null feature counts the texts."""
        for part in parts:
            count: dict[tuple[str | None, int], int] = {}
            for text, toxic in zip(part.column(0), part.column(1), strict=True):
                for f in (None, *features(text.as_py())):
                    key = f, int(toxic.as_py())
                    count[key] = count.get(key, 0) + 1
            names, kinds = zip(*count, strict=True) if count else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(kinds, pa.int32()), pa.array(count.values(), pa.int64())],
                ["feature", "toxic", "n"],
            )

    found = rows.mapInArrow(counted, "feature string, toxic int, n long")
    totals = found.filter("feature IS NULL")
    chosen = choose(found.filter("feature IS NOT NULL").union(totals.withColumn("feature", F.lit(None).cast("string"))), n_features)
    swap = swaps()
    names = sorted({*chosen, *swap, *(f"^{w[:PREFIX]}" for w in swap if len(w) > PREFIX)}) if chosen else []
    place = {w: k for k, w in enumerate(names)}

    def marked(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text's features that were chosen, as sorted positions, and those of its counterfactual."""
        for part in parts:
            real, other = [], []
            for x in part.column(0):
                own = features(x.as_py())
                words = {w for w in own if not w.startswith("^")}
                moved = {swap.get(w, w) for w in words}
                moved |= {f"^{w[:PREFIX]}" for w in moved if len(w) > PREFIX}
                real.append(sorted(place[w] for w in own & place.keys()))
                other.append(sorted(place[w] for w in moved & place.keys()))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(real, kind), pa.array(other, kind), part.column(1)], ["x", "swapped", "toxic"])

    if not names:
        return Classifier({}, -math.inf)
    spec = "x array<int>, swapped array<int>, toxic int"
    got = rows.mapInArrow(marked, spec)
    # at most one short list a sampled label; the order of the rows is fixed by sorting them
    data = sorted((r["x"], r["swapped"], r["toxic"]) for r in got.collect())
    return solve(data, names)


def solve(data: list[tuple[list[int], list[int], int]], names: list[str]) -> Classifier:
    """Full-batch Adam on log loss, L2 and the counterfactual penalty."""

    def sparse(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array([k for r in rows for k in r], np.int64)

    n, d = len(data), len(names)
    at, which = sparse([r[0] for r in data])
    at_swapped, which_swapped = sparse([r[1] for r in data])
    y = np.array([r[2] for r in data], float)
    # both classes weigh the same
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, n - y.sum()))
    w, mean, square = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)  # the last one is the bias
    for k in range(1, ROUNDS + 1):
        real = np.bincount(at, w[which], n)
        error = weight * (1 / (1 + np.exp(-np.clip(real + w[d], -500, 500))) - y)
        penalty = 2 * COUNTERFACTUAL * (real - np.bincount(at_swapped, w[which_swapped], n)) / n
        grad = np.bincount(which, (error + penalty)[at], d + 1) - np.bincount(which_swapped, penalty[at_swapped], d + 1)
        grad += L2 * w
        grad[d] = error.sum()
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        w = w - STEP * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-9)
    bias, w = w[d], w[:d]
    return Classifier({name: float(v) for name, v in zip(names, w, strict=True) if v}, float(bias))


def score(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: ``doc_id``, ``score`` and ``predicted``."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (piece for batch in parts for piece in slices(batch, 1)):
            found = [model.score(x.as_py()) for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    out = docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def remainder(doc_id="doc_id", by: int = 3):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % by


def op5_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(remainder() != 1))
    held = F.coalesce(remainder() == 1, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")
