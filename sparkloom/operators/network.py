"""Connected groups: supersteps of shards that exchange events along delayed edges.

Rows are dealt out to shards. No event can reach a target sooner than the shortest delay, so every shard runs that
many ticks on its own, in one NumPy kernel, from its rows and what is due to them; then the events meet their edges
in one join and become what is due later. A run costs one round per shortest delay, whatever the number of ticks
within it. Order within a tick: state update, threshold, deliveries, reset. Deliveries to a target are added up in
the order of their edges, so that neither shards nor partitions change a bit of the result.

State and pending deliveries are written to the checkpoint folder after every round; a lost executor repeats part of
one round.
"""

from __future__ import annotations

import ast
import json
import re
import tempfile
import uuid
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lang, rng
from ..plans import integrators
from .delivery import delay_ticks
from .group import NEVER, Group
from .monitors import append, read


def folder(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def kept(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class Pathway:
    """What an event of a source does on each of its edges after a delay: add ``weight``, an expression of the edge's
    columns, to ``target`` of the edge's target."""

    target: str
    weight: str
    #: Seconds, or the name of an edge column that holds them.
    delay: float | str = 0.0


@dataclass
class Kernel:
    """What a shard needs to run ticks: expressions only, so it is small and travels with the task."""

    stored: dict[str, str]
    constants: dict[str, float]
    step: list[tuple[str, str]]
    threshold: str | None
    reset: list[tuple[str, str]]
    refractory: str | None
    condition: bool
    frozen: frozenset[str]
    n: int
    dt: float
    seed: int
    name: str
    record: tuple[str, ...] = ()
    views: dict[str, str] = field(default_factory=dict)
    held: list[tuple[str, str]] = field(default_factory=list)
    method: str = ""

    @classmethod
    def of(cls, group: Group, dt: float, record: tuple[str, ...] = ()) -> Kernel:
        text = ast.unparse
        method, step = group.plan(dt)
        tree = group.code(str(group.refractory), "refractory") if group.refractory is not None else None
        lines = lambda code: [(k, text(v)) for k, v in code]
        return cls(
            group.stored, {k: float(v) for k, v in group.constants().items()}, lines(step),
            text(group.code(group.threshold, "threshold")) if group.threshold else None, lines(group.resets()),
            text(tree) if tree is not None else None,
            tree is not None and any(isinstance(x, (ast.Compare, ast.BoolOp)) for x in ast.walk(tree)),
            frozenset(e.name for e in group.equations.of("ode").values() if "unless refractory" in e.flags),
            group.n, dt, group.seed, group.name, record, {r: text(group.code(r, f"show{r}")) for r in record}, lines(group.held()), method,
        )

    def draws(self, tick: int, ids: np.ndarray) -> dict:
        """What the functions that draw mean in a tick, and the noise of its step."""
        place = lambda kind, site: f"{self.name}/{kind}/{site}"
        env = {
            "rand": lambda site="": rng.uniforms(self.seed, place("rand", site), tick, ids),
            "randn": lambda site="": rng.normals(self.seed, place("randn", site), tick, ids),
            "poisson": lambda site, rate: rng.poissons(rate, self.seed, place("poisson", site), tick, ids),
        }
        noises = {n for _, e in self.step for n in re.findall(r"\b_dW\w*", e)}
        return env | {n: rng.normals(self.seed, f"{self.name}/xi{n[3:]}", tick, ids) * self.dt**0.5 for n in noises}

    def run(self, rows: pd.DataFrame, due: pd.DataFrame, first: int, ticks: int):
        """Advance the rows by some ticks. Gives the new rows, events and recorded values."""
        rows = rows.sort_values("i").reset_index(drop=True)
        ids = rows["i"].to_numpy()
        state = {k: rows[k].to_numpy().astype({"double": float, "int": np.int32, "boolean": bool}[t]) for k, t in self.stored.items()}
        last, ready = rows["lastspike"].to_numpy().astype(float), rows["not_refractory"].to_numpy().astype(bool)
        due = due.sort_values(["due", "target", "seq", "src"])
        if len(due) and due["due"].iloc[0] < first:
            raise ValueError("a delivery is due before the ticks of this round")
        bounds = np.searchsorted(due["due"].to_numpy(), np.arange(first, first + ticks + 1))
        at, values, names = np.searchsorted(ids, due["j"].to_numpy()), due["value"].to_numpy(), due["target"].to_numpy()
        events, traces = [], []
        for k in range(first, first + ticks):
            t = k * self.dt
            env = {**self.constants, **state, "t": t, "dt": self.dt, "N": self.n, "i": ids, "lastspike": last}
            env |= self.draws(k, ids)
            env["not_refractory"] = ready
            for name, tree in self.held:
                env[name] = np.broadcast_to(lang.array(tree, env), ids.shape)
            if self.record:
                env["not_refractory"] = ready
                traces.append((k, {r: np.broadcast_to(lang.array(e, env), ids.shape).astype(float) for r, e in self.views.items()}))
            if self.refractory is not None:
                env["not_refractory"] = ready
                held = lang.array(self.refractory, env)
                if self.condition:
                    ready = ready | ~held
                else:
                    gone = ((t - last + 1e-3 * self.dt) / self.dt).astype(np.int64)
                    ready = gone >= ((np.asarray(held, float) + 1e-3 * self.dt) / self.dt).astype(np.int64)
            env["not_refractory"] = ready
            self.integrate(env, state, ready)
            if self.threshold is not None:
                fired = np.broadcast_to(lang.array(self.threshold, {**env, **state}), ids.shape) & ready
                where = np.flatnonzero(fired)
                last = np.where(fired, t, last)
                if self.refractory is not None:
                    ready = ready & ~fired
                if len(where):
                    events.append((k, ids[where]))
            a, b = bounds[k - first], bounds[k - first + 1]
            for target in sorted(set(names[a:b])):
                own = names[a:b] == target
                # a refractory row keeps its frozen columns, whatever arrives
                open_ = ready[at[a:b][own]] if target in self.frozen else np.ones(own.sum(), bool)
                np.add.at(state[target], at[a:b][own][open_], values[a:b][own][open_])
            if self.threshold is not None and len(where):
                env = {**env, **state, "not_refractory": ready, "lastspike": last}
                self._apply(self.reset, env, state, fired, np.ones(len(ids), bool))
        out = pd.DataFrame({"i": ids, **state, "lastspike": last, "not_refractory": ready})
        return out, events, traces, ids

    def integrate(self, env: dict, state: dict, ready: np.ndarray) -> None:
        """One step of all rows. An adaptive method takes each row's substeps; frozen columns then have no rate."""
        if self.method not in integrators.ADAPTIVE:
            return self._apply(self.step, env, state, np.ones(len(ready), bool), ready)
        names = [target.removeprefix("_rate_") for target, _ in self.step]

        def rates(x: np.ndarray, t: np.ndarray, at: np.ndarray) -> np.ndarray:
            of = {k: v[at] if isinstance(v, np.ndarray) and v.shape == ready.shape else v for k, v in env.items()}
            of |= dict(zip(names, x, strict=True)) | {"t": t}
            found = [np.broadcast_to(lang.array(tree, of), at.shape).astype(float) for _, tree in self.step]
            return np.stack([np.where(ready[at], f, 0.0) if name in self.frozen else f for name, f in zip(names, found, strict=True)])

        start = np.stack([state[x].astype(float) for x in names])
        for x, value in zip(names, integrators.adaptive(rates, start, env["t"], self.dt, scheme=integrators.ADAPTIVE[self.method]), strict=True):
            state[x] = env[x] = value

    def _apply(self, step, env: dict, state: dict, where: np.ndarray, ready: np.ndarray) -> None:
        for target, tree in step:
            value = lang.array(tree, env)
            if target in state:
                keep = where & ready if target in self.frozen else where
                value = np.where(keep, value, state[target]).astype(state[target].dtype)
                state[target] = value
            env[target] = value


def folded(group: Group, df: DataFrame, ticks: int, dt: float, record: tuple[str, ...], every: int, first: int) -> DataFrame:
    """``Group.fold`` in kernels, a batch of rows at a time, for methods that columns can't express."""
    kernel = Kernel.of(group, dt, record)
    shown = "".join(f"{r}: double, " for r in record)
    types = {"i": "bigint", **group.stored, "lastspike": "double", "not_refractory": "boolean", "spikes": "array<bigint>", "trace": f"array<struct<{shown}tick: bigint>>"}
    nothing = pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("due", "int64"), ("j", "int64"), ("target", str), ("value", float), ("seq", "int64"), ("src", "int64"))})

    def advance(parts):
        for rows in parts:
            out, events, traces, ids = kernel.run(rows, nothing, first, ticks)
            place = {i: k for k, i in enumerate(ids.tolist())}
            fired, seen = [[] for _ in place], [[] for _ in place]
            for tick, who in events:
                for i in who.tolist():
                    fired[place[i]].append(tick)
            for tick, values in traces:
                if tick % every == 0:
                    for k in range(len(seen)):
                        seen[k].append({**{r: float(values[r][k]) for r in record}, "tick": tick})
            yield out.assign(spikes=fired, trace=seen)[list(types)]

    return df.select("i", *group.stored, "lastspike", "not_refractory").mapInPandas(advance, ", ".join(f"`{c}` {t}" for c, t in types.items()))


def advancing(kernel: Kernel, first: int, ticks: int, names: list[str]):
    """A round of one shard: rows after it (kind 0), its events (1) and recorded values (2)."""

    def advance(rows: pd.DataFrame, due: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame(columns=names)
        out, events, traces, ids = kernel.run(rows, due, first, ticks)
        parts = [out.assign(kind=0, tick=first + ticks)]
        parts += [pd.DataFrame({"kind": 1, "tick": k, "i": who}) for k, who in events]
        parts += [pd.DataFrame({"kind": 2, "tick": k, "i": ids, **values}) for k, values in traces]
        return pd.concat(parts, ignore_index=True).reindex(columns=names)

    return advance


PENDING = "due long, j long, target string, value double, seq long, src long"


class Network:
    """A group, its edges ``(seq, i, j, ...)`` and the pathways along them."""

    def __init__(self, group: Group, edges: DataFrame | None = None, pathways: list[Pathway] | None = None, inputs: DataFrame | None = None, shards: int | None = None):
        self.group, self.edges, self.pathways, self.inputs, self.shards = group, edges, pathways or [], inputs, shards
        self.tick = 0
        self.state: DataFrame | None = None
        self.pending: DataFrame | None = None
        self.base: str | None = None
        self.spark: SparkSession | None = None

    def explain(self, dt: float) -> str:
        """Which way a run takes, the method, and the order of a tick."""
        method, _ = self.group.plan(dt)
        mode = f"supersteps of {self._shortest(dt)} ticks" if self.pathways else "fold"
        order = schedule_of(self.group, self.pathways)
        return f"{mode}; {method}; " + ", ".join(f"{slot}: {name}" for slot, _, name in order)

    def _delay(self, p: Pathway, dt: float) -> Column:
        return delay_ticks(F.col(p.delay) if isinstance(p.delay, str) else F.lit(p.delay), dt)

    def _shortest(self, dt: float) -> int:
        found = []
        for p in self.pathways:
            if isinstance(p.delay, str):
                least = self.edges.agg(F.min(self._delay(p, dt))).first()[0]
                found += [] if least is None else [least]
            else:
                found.append(int(p.delay / dt + 0.5))
        return min(found, default=1)

    def _fanned(self, events: DataFrame, dt: float) -> DataFrame:
        """Events on the edges of their sources, as what is due."""
        parts = []
        columns = {c: F.col(c) for c in self.edges.columns} | self.group.constants()
        for k, p in enumerate(self.pathways):
            joined = events.join(self.edges, "i")
            parts.append(
                joined.select(
                    (F.col("tick") + self._delay(p, dt)).cast("long").alias("due"), F.col("j").cast("long").alias("j"),
                    F.lit(p.target).alias("target"), lang.column(p.weight, columns).cast("double").alias("value"),
                    F.col("seq").cast("long").alias("seq"), (F.col("i") * len(self.pathways) + k).cast("long").alias("src"),
                )
            )
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out

    def run(self, spark: SparkSession, duration: float, dt: float, record: tuple[str, ...] = ()) -> Network:
        """Run on from where the last run ended (STR-5, STR-12). Events and recorded values are parts of
        one table each in the shared folder, a part a round, so that reading them costs the same after any number."""
        ticks = int(duration / dt + 0.5)
        window = self._shortest(dt)
        if window < 1:
            raise ValueError("a delay shorter than half a step: give it at least one step, or run `relational` or an `Assembly`")
        shards = self.shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
        kernel = Kernel.of(self.group, dt, record)
        self.base, self.spark = self.base or f"{folder(spark)}/network-{uuid.uuid4().hex}", spark
        base = f"{self.base}/rounds"
        state = self.state if self.state is not None else self.group.table(spark)
        pending = self.pending if self.pending is not None else spark.createDataFrame([], PENDING)
        if self.inputs is not None and self.tick == 0:
            pending = pending.unionByName(self.inputs)
        columns = ["i", *self.group.stored, "lastspike", "not_refractory"]
        types = {"i": "long", **self.group.stored, "lastspike": "double", "not_refractory": "boolean"}
        extra = [r for r in record if r not in types]
        spec = "kind int, tick long, " + ", ".join(f"{c} {types[c]}" for c in columns) + "".join(f", {r} double" for r in extra)
        names = ["kind", "tick", *columns, *extra]
        end = self.tick + ticks
        while self.tick < end:
            first, size = self.tick, min(window, end - self.tick)

            here = pending.filter(F.col("due") < first + size).withColumn("shard", F.col("j") % shards)
            grouped = state.withColumn("shard", F.col("i") % shards).groupBy("shard")
            out = kept(grouped.cogroup(here.groupBy("shard")).applyInPandas(advancing(kernel, first, size, names), spec), f"{base}/{first}")
            state = out.filter("kind = 0").select(columns)
            events = out.filter("kind = 1").select("tick", "i")
            append(events, f"{self.base}/events", first)
            if record:
                append(out.filter("kind = 2").select("tick", "i", *record), f"{self.base}/traces", first)
            rest = pending.filter(F.col("due") >= first + size)
            if self.pathways:
                rest = rest.unionByName(self._fanned(events, dt))
            pending = kept(rest, f"{base}/{first}-pending")
            self.tick = first + size
        self.state, self.pending = state, pending
        return self

    def spikes(self) -> DataFrame:
        return read(self.spark, f"{self.base}/events").drop("chunk")

    def recorded(self) -> DataFrame:
        return read(self.spark, f"{self.base}/traces").drop("chunk")

    # --- checkpoints ------------------------------------------------------------------------------------------

    def store(self, path: str) -> None:
        """Everything that a later run needs, in one folder (SNK-7)."""
        self.state.write.mode("overwrite").parquet(f"{path}/state")
        self.pending.write.mode("overwrite").parquet(f"{path}/pending")
        spark = self.state.sparkSession
        manifest = json.dumps({"tick": self.tick, "columns": self.state.columns, "seed": self.group.seed})
        spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")

    def restore(self, spark: SparkSession, path: str) -> Network:
        """Strict on columns and seed (SNK-8)."""
        manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
        want = ["i", *self.group.stored, "lastspike", "not_refractory"]
        if manifest["columns"] != want or manifest["seed"] != self.group.seed:
            raise ValueError(f"the checkpoint is of another network: {manifest}")
        self.state, self.pending = spark.read.parquet(f"{path}/state"), spark.read.parquet(f"{path}/pending")
        self.tick = manifest["tick"]
        return self


def schedule_of(group: Group, pathways: list[Pathway]) -> list[tuple[str, int, str]]:
    from .group import schedule

    items = [("groups", 0, f"{group.name} state update")]
    if group.threshold:
        items.append(("thresholds", 0, f"{group.name} threshold"))
    if group.reset:
        items.append(("resets", 0, f"{group.name} reset"))
    items += [("synapses", -1, f"pathway {k} to {p.target}") for k, p in enumerate(pathways)]
    return schedule(items)


def relational(group: Group, edges: DataFrame, pathways: list[Pathway], spark: SparkSession, ticks: int, dt: float) -> tuple[DataFrame, DataFrame]:
    """The same run as plain relational steps, a few jobs a tick: the measure that supersteps are tested against, and
    the way to run delays of zero. Gives the events and the final state."""
    base = f"{folder(spark)}/relational-{uuid.uuid4().hex}"
    net = Network(group, edges, pathways)
    state, pending, fired_all = group.table(spark), spark.createDataFrame([], PENDING), []
    method, step = group.plan(dt)
    if method in integrators.ADAPTIVE:
        raise integrators.UnsupportedEquations(f"{method} runs in kernels only")
    types = group.stored | {"lastspike": "double", "not_refractory": "boolean"}
    for k in range(ticks):
        env = {c: F.col(c) for c in types}
        t = F.lit(k * dt)
        more = {x: rng.normal(group.seed, f"{group.name}/xi{x[3:]}", F.lit(k), F.col("i")) * dt**0.5 for x in group.noises(step)}
        for name, tree in group.held():
            state = state.withColumn(f"_held_{name}", lang.column(tree, group.columns({**env, "t": t, "dt": F.lit(dt), "_tick": F.lit(k)})))
            more[name] = F.col(f"_held_{name}")
        run = lambda tree, env=env, t=t, k=k, more=more: lang.column(tree, group.columns({**env, **more, "t": t, "dt": F.lit(dt), "_tick": F.lit(k)}))
        if group.refractory is not None:
            state = state.withColumn("not_refractory", group._ready(run, t, dt, F.struct(*types)))
        new = group._statements(step, dict(env), lambda tree, e=env: run(tree), types, True) if not step else _stepwise(group, step, env, t, dt, k, types, more)
        state = state.withColumns(new)
        fired = run(group.code(group.threshold, "threshold")) & F.col("not_refractory")
        state = state.withColumn("_fired", fired).withColumn("lastspike", F.when(F.col("_fired"), t).otherwise(F.col("lastspike")))
        if group.refractory is not None:
            state = state.withColumn("not_refractory", F.col("not_refractory") & ~F.col("_fired"))
        state = kept(state, f"{base}/{k}-fired")
        events = state.filter("_fired").select(F.lit(k).cast("long").alias("tick"), "i")
        fired_all.append(events)
        pending = kept(pending.filter(F.col("due") >= k).unionByName(net._fanned(events, dt)), f"{base}/{k}-pending")
        for target in {p.target for p in pathways}:
            now = pending.filter((F.col("due") == k) & (F.col("target") == target)).groupBy(F.col("j").alias("i")).agg(F.sum("value").alias("_in"))
            open_ = F.col("not_refractory") if target in {e.name for e in group.equations.of("ode").values() if "unless refractory" in e.flags} else F.lit(True)
            state = state.join(now, "i", "left").withColumn(target, F.col(target) + F.when(open_, F.coalesce("_in", F.lit(0.0))).otherwise(0.0)).drop("_in")
        pending = pending.filter(F.col("due") > k)
        after = group._statements(group.resets(), dict(env), run, types, False)
        changed = {c: F.when(F.col("_fired"), after[c]).otherwise(F.col(c)) for c in group.stored}
        state = kept(state.withColumns(changed).select("i", *types), f"{base}/{k}")
    out = fired_all[0]
    for x in fired_all[1:]:
        out = out.unionByName(x)
    return out, state


def _stepwise(group: Group, step, env: dict, t: Column, dt: float, k: int, types: dict, more: dict) -> dict[str, Column]:
    env = dict(env)

    def run(tree):
        return lang.column(tree, group.columns({**env, **more, "t": t, "dt": F.lit(dt), "_tick": F.lit(k)}))

    return group._statements(step, env, run, types, True)


def stdp(events_pre: DataFrame, events_post: DataFrame, edges: DataFrame, tau_pre: float, tau_post: float, up: float, down: float, low: float, high: float) -> DataFrame:
    """Pair-based plasticity of each edge's weight: every event on either side changes it by the other side's trace,
    clipped each time, in order of time; at equal times the source comes first (STR-9).

    An edge's events meet in one group, sorted, and are folded; edges are dealt out by their number, so a busy node's
    edges are many groups."""
    at_pre = edges.join(events_pre.select("i", "t"), "i").select("seq", "t", F.lit(0).alias("side"))
    at_post = edges.join(events_post.select(F.col("i").alias("j"), "t"), "j").select("seq", "t", F.lit(1).alias("side"))
    packed = at_pre.unionByName(at_post).groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("t", "side"))).alias("events"))
    start = F.struct(F.col("w").cast("double").alias("w"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("t"))

    def step(s: Column, e: Column) -> Column:
        gone = s["t"] - e["t"]
        a, b = s["a"] * F.exp(gone / tau_pre), s["b"] * F.exp(gone / tau_post)
        clip = lambda x: F.least(F.greatest(x, F.lit(low)), F.lit(high))
        pre = e["side"] == 0
        return F.struct(
            F.when(pre, clip(s["w"] + b)).otherwise(clip(s["w"] + a)).alias("w"),
            F.when(pre, a + up).otherwise(a).alias("a"),
            F.when(pre, b).otherwise(b + down).alias("b"),
            e["t"].alias("t"),
        )

    done = edges.join(packed, "seq", "left")
    new = F.aggregate(F.coalesce("events", F.array().cast("array<struct<t: double, side: int>>")), start, step, lambda s: s["w"])
    return done.select("seq", "i", "j", new.alias("w"))


__all__ = ["NEVER", "Kernel", "Network", "Pathway", "relational", "stdp"]
