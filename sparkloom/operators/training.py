"""Training of layers of leaky threshold units by surrogate gradients through time.

Samples are dealt out to tasks; each task runs its samples forward, keeps what the way back needs, and gives the sum
of its gradients, one row a weight matrix. The driver adds them up (their size is the model's) and steps.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Plan:
    """Sizes of the layers and the units' constants (TRN-1)."""

    sizes: tuple[int, ...]
    ticks: int
    beta: float = 0.9
    threshold: float = 1.0
    slope: float = 10.0
    scale: float = 5.0
    rate: float = 1e-2
    optimizer: str = "adam"
    seed: int = 0


@dataclass
class Model:
    plan: Plan
    weights: list[np.ndarray] = field(default_factory=list)
    mean: list[np.ndarray] = field(default_factory=list)
    square: list[np.ndarray] = field(default_factory=list)
    #: Weights that may change, as 0 or 1 (TRN-11).
    masks: list[np.ndarray] = field(default_factory=list)
    steps: int = 0

    def __post_init__(self):
        if not self.weights:
            rng, s = np.random.default_rng(self.plan.seed), self.plan.sizes
            self.weights = [rng.normal(0, 2 / np.sqrt(a), (a, b)) for a, b in zip(s, s[1:], strict=False)]
        for name in ("mean", "square"):
            if not getattr(self, name):
                setattr(self, name, [np.zeros_like(w) for w in self.weights])
        self.masks = self.masks or [np.ones_like(w) for w in self.weights]


def forward(plan: Plan, weights: list[np.ndarray], x: np.ndarray):
    """``x`` is samples by ticks by inputs. Gives per layer the potentials before reset and the events, over ticks."""
    n = len(x)
    v = [np.zeros((n, w.shape[1])) for w in weights]
    tape = []
    for t in range(plan.ticks):
        signal, row = x[:, t], []
        for k, w in enumerate(weights):
            u = plan.beta * v[k] + signal @ w
            s = (u > plan.threshold).astype(float)
            v[k] = u - plan.threshold * s
            row.append((signal, u, s))
            signal = s
        tape.append(row)
    return tape


def loss_and_gradients(plan: Plan, weights: list[np.ndarray], x: np.ndarray, y: np.ndarray, window: int | None = None):
    """Summed cross entropy of scaled mean event counts, its gradients, and right answers (TRN-2..4, TRN-6). With a
    ``window`` nothing flows back over more than so many ticks."""
    tape = forward(plan, weights, x)
    counts = sum(row[-1][2] for row in tape) / plan.ticks
    logits = plan.scale * counts
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum()
    out = p.copy()
    out[np.arange(len(y)), y] -= 1
    out *= plan.scale / plan.ticks
    grads = [np.zeros_like(w) for w in weights]
    later = [np.zeros_like(u) for _, u, _ in tape[0]]
    for t in range(plan.ticks - 1, -1, -1):
        if window and (plan.ticks - 1 - t) % window == 0:
            later = [np.zeros_like(z) for z in later]
        above = out
        for k in range(len(weights) - 1, -1, -1):
            signal, u, _ = tape[t][k]
            step = 1 / (1 + plan.slope * np.abs(u - plan.threshold)) ** 2
            # v = u - threshold * s, and both u and s reach the next tick
            du = (above - plan.threshold * plan.beta * later[k]) * step + plan.beta * later[k]
            grads[k] += signal.T @ du
            later[k] = du
            above = du @ weights[k].T
    return loss, grads, int((counts.argmax(axis=1) == y).sum())


def dense(rows: pd.DataFrame, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``(sample, label, tick, input, amplitude)`` as arrays."""
    ids, at = np.unique(rows["sample"].to_numpy(), return_inverse=True)
    x = np.zeros((len(ids), plan.ticks, plan.sizes[0]))
    np.add.at(x, (at, rows["tick"].to_numpy(), rows["input"].to_numpy()), rows["amplitude"].to_numpy())
    y = np.zeros(len(ids), int)
    y[at] = rows["label"].to_numpy()
    return x, y


def gradients(batch: DataFrame, model: Model, tasks: int = 8, window: int | None = None) -> DataFrame:
    """Summed gradients as rows ``(k, values)``, with loss, samples and right answers in the row -1 (TRN-7, TRN-13).
    A task takes whole samples; the partial sums are added up before anything reaches the driver."""
    plan, weights = model.plan, model.weights

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = dense(rows, plan)
        loss, grads, right = loss_and_gradients(plan, weights, x, y, window)
        found = [[float(loss), float(len(y)), float(right)], *(g.ravel().tolist() for g in grads)]
        return pd.DataFrame({"k": range(-1, len(grads)), "values": found})

    parts = batch.withColumn("task", F.pmod(F.xxhash64("sample"), F.lit(tasks))).groupBy("task").applyInPandas(run, "k int, values array<double>")
    return parts.select("k", F.posexplode("values").alias("at", "x")).groupBy("k", "at").agg(F.sum("x").alias("x"))


def collected(found: DataFrame, model: Model) -> tuple[tuple[float, float, float], list[np.ndarray]]:
    """As arrays; there are as many numbers as the model has weights, and three."""
    rows = found.toPandas().sort_values(["k", "at"])
    totals = rows[rows["k"] == -1]["x"].to_numpy()
    grads = [rows[rows["k"] == k]["x"].to_numpy().reshape(w.shape) for k, w in enumerate(model.weights)]
    return tuple(totals), grads


def step(batch: DataFrame, model: Model, tasks: int = 8) -> dict[str, float]:
    """One update of the model (TRN-5, TRN-7)."""
    (loss, n, right), grads = collected(gradients(batch, model, tasks), model)
    model.steps += 1
    for k, g in enumerate(grads):
        g = g / n * model.masks[k]
        if model.plan.optimizer == "sgd":
            model.weights[k] = model.weights[k] - model.plan.rate * g
            continue
        model.mean[k] = 0.9 * model.mean[k] + 0.1 * g
        model.square[k] = 0.999 * model.square[k] + 0.001 * g * g
        m, s = model.mean[k] / (1 - 0.9**model.steps), model.square[k] / (1 - 0.999**model.steps)
        model.weights[k] = model.weights[k] - model.plan.rate * m / (np.sqrt(s) + 1e-8)
    return {"loss": loss / n, "accuracy": right / n}


def evaluate(batch: DataFrame, model: Model) -> DataFrame:
    """``sample``, ``label`` and the predicted class, without a change of the model (AGG-20, AGG-21)."""
    plan, weights = model.plan, model.weights

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            x, y = dense(rows.explode(["tick", "input", "amplitude"]).astype({"tick": int, "input": int, "amplitude": float}), plan)
            counts = sum(row[-1][2] for row in forward(plan, weights, x))
            yield pd.DataFrame({"sample": np.unique(rows["sample"]), "label": y, "predicted": counts.argmax(axis=1)})

    packed = batch.groupBy("sample", "label").agg(*[F.collect_list(c).alias(c) for c in ("tick", "input", "amplitude")])
    return packed.mapInPandas(run, "sample long, label int, predicted int")


def quantised(weights: DataFrame, scale: float, low: int = -128, high: int = 127) -> DataFrame:
    """Frozen integer weights (CNV-6)."""
    value = F.least(F.greatest(F.rint(F.col("w") * scale), F.lit(float(low))), F.lit(float(high)))
    return weights.withColumn("q", value.cast("int"))


def store(model: Model, spark, path: str) -> None:
    kinds = ("weights", "mean", "square", "masks")
    rows = [(kind, k, a.ravel().tolist()) for kind in kinds for k, a in enumerate(getattr(model, kind))]
    spark.createDataFrame(rows, "kind string, k int, x array<double>").write.mode("overwrite").parquet(f"{path}/arrays")
    note = json.dumps({"plan": vars(model.plan) | {"sizes": list(model.plan.sizes)}, "steps": model.steps})
    spark.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/plan")


def restore(spark, path: str) -> Model:
    note = json.loads(spark.read.text(f"{path}/plan").first()[0])
    plan = Plan(**note["plan"] | {"sizes": tuple(note["plan"]["sizes"])})
    shapes = list(zip(plan.sizes, plan.sizes[1:], strict=False))
    found: dict[str, list] = {}
    for r in sorted(spark.read.parquet(f"{path}/arrays").collect(), key=lambda r: r["k"]):
        found.setdefault(r["kind"], []).append(np.array(r["x"]).reshape(shapes[r["k"]]))
    return Model(plan, **found, steps=note["steps"])
