"""Groups: node tables whose columns and dynamics come from equations.

A group runs in one of three ways, which ``Network.explain`` names: rows that don't influence one another are folded
over the ticks within one expression (``fold``); connected ones run in a NumPy kernel a shard, in windows no longer
than the shortest delay between them (``supersteps``, see network.py).
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lang, rng
from ..functions import units as U
from ..plans import integrators
from ..plans.equations import Equations

#: Order of a tick's slots; each may have operators before and after it.
SLOTS = ("start", "groups", "thresholds", "synapses", "resets", "end")
NEVER = -1e4


def schedule(items: list[tuple[str, int, str]]) -> list[tuple[str, int, str]]:
    """Operators ``(slot, order, name)`` as they run in a tick (SORT-3): by slot with its before and after, then by
    order, then by name."""
    place = {f"{pre}{s}": 3 * k + d for k, s in enumerate(SLOTS) for pre, d in (("before_", 0), ("", 1), ("after_", 2))}
    return sorted(items, key=lambda x: (place[x[0]], x[1], x[2]))


@dataclass
class Group:
    """``n`` rows with the columns of the equations, and how they fire and reset."""

    n: int
    equations: Equations | str
    method: str | tuple[str, ...] = ("exact", "euler", "heun")
    threshold: str | None = None
    reset: str | None = None
    #: A time in seconds, an expression of one, or a condition that keeps a row refractory.
    refractory: float | str | None = None
    namespace: dict[str, Any] = field(default_factory=dict)
    events: dict[str, str] = field(default_factory=dict)
    seed: int = 0
    name: str = "group"

    def __post_init__(self):
        if isinstance(self.equations, str):
            self.equations = Equations.parse(self.equations)
        self.equations.check(self.namespace)
        self.initial: list[tuple[str, str, str | None]] = []

    # --- state ------------------------------------------------------------------------------------------------

    @property
    def stored(self) -> dict[str, str]:
        return {e.name: e.sql_type for e in self.equations.items.values() if e.kind != "sub"}

    def constants(self) -> dict[str, Any]:
        return {k: U.quantity(v).value if isinstance(v, (int, float, U.Quantity)) else v for k, v in self.namespace.items()}

    def columns(self, extra: Mapping[str, Any] | None = None) -> dict[str, Any]:
        """What names mean in a column expression: stored columns, views, constants, draws."""
        base = {**self.constants(), "N": F.lit(self.n), "i": F.col("i"), **{k: F.col(k) for k in self.stored}}
        base["not_refractory"], base["lastspike"] = F.col("not_refractory"), F.col("lastspike")
        base.update(extra or {})
        tick = base.get("_tick", F.lit(-1))
        base.setdefault("rand", lambda site="": rng.uniform(self.seed, f"{self.name}/rand/{site}", tick, F.col("i")))
        base.setdefault("randn", lambda site="": rng.normal(self.seed, f"{self.name}/randn/{site}", tick, F.col("i")))
        base.setdefault("poisson", lambda site, rate: rng.poisson(rate, self.seed, f"{self.name}/poisson/{site}", tick, F.col("i")))
        return base

    def code(self, text: str | Any, site: str):
        """An expression of the group with views put in and draws numbered: ``site`` names the place that it stands at."""
        return lang.numbered(self.equations.resolved(text), site)

    def column(self, text: str, extra: Mapping[str, Any] | None = None, site: str = "column") -> Column:
        """An expression as a column of the group's table, views that hold a value during a tick put in too."""
        held = {name: lang.column(lang.numbered(tree, f"held{name}"), self.columns(extra)) for name, tree in self.equations.held()}
        return lang.column(self.code(text, site), self.columns({**held, **(extra or {})}))

    def set(self, name: str, value: str | float, where: str | None = None) -> Group:
        """Set a column from an expression, everywhere or where a predicate holds (PRJ-4, PRJ-5)."""
        if name not in self.stored:
            raise lang.unknown(name, self.stored)
        self.initial.append((name, str(value), where))
        return self

    def table(self, spark: SparkSession) -> DataFrame:
        """The initial state (SRC-1)."""
        taken = [x for x in self.equations.items if x.lower() in ("i", "lastspike", "not_refractory")]
        lower = [x.lower() for x in self.equations.items]
        if (taken or len(set(lower)) < len(lower)) and spark.conf.get("spark.sql.caseSensitive") != "true":
            raise ValueError(f"column names that differ in case alone need spark.sql.caseSensitive: {sorted({*taken, *(x for x in self.equations.items if lower.count(x.lower()) > 1)})}")
        df = spark.range(self.n).select(F.col("id").alias("i"))
        df = df.withColumns({k: F.lit(0).cast(t) for k, t in self.stored.items()})
        df = df.withColumns({"lastspike": F.lit(NEVER), "not_refractory": F.lit(True)})
        for k, (name, value, where) in enumerate(self.initial):
            new = self.column(value, site=f"set{k}").cast(self.stored[name])
            df = df.withColumn(name, F.when(self.column(where), new).otherwise(F.col(name)) if where else new)
        return df

    def where(self, df: DataFrame, predicate: str) -> DataFrame:
        """Rows for which a predicate holds (FLT-3, PRJ-7)."""
        return df.filter(self.column(predicate))

    def views(self, df: DataFrame, *names: str) -> DataFrame:
        """With view columns evaluated (PRJ-2, PRJ-8)."""
        return df.withColumns({k: self.column(k) for k in names})

    def subgroup(self, df: DataFrame, start: int, stop: int) -> DataFrame:
        """A contiguous range, renumbered from 0 (FLT-5)."""
        return df.filter((F.col("i") >= start) & (F.col("i") < stop)).withColumn("i", F.col("i") - start)

    # --- the fold ---------------------------------------------------------------------------------------------

    def plan(self, dt: float) -> tuple[str, integrators.Step]:
        """The method that takes the equations, and the statements of a step, draws numbered."""
        method, step = integrators.step(self.equations, self.method, self.constants(), dt)
        return method, [(name, lang.numbered(tree, f"step{k}")) for k, (name, tree) in enumerate(step)]

    def held(self) -> list[tuple[str, Any]]:
        return [(name, lang.numbered(tree, f"held{name}")) for name, tree in self.equations.held()]

    def resets(self) -> list[tuple[str, Any]]:
        return [(x.target, self.code(x.full, f"reset{k}")) for k, x in enumerate(lang.statements(self.reset or ""))]

    def noises(self, step: integrators.Step) -> list[str]:
        return sorted({n for _, tree in step for n in lang.names(tree) if n.startswith("_dW")})

    def fold(self, df: DataFrame, ticks: int, dt: float, record: tuple[str, ...] = (), every: int = 1, first: int = 0) -> DataFrame:
        """All ticks of all rows in one expression, without a shuffle or a job per tick.

        Each row gives its final columns, ``spikes`` (ticks at which it fired) and ``trace``: what ``record`` names,
        taken at the start of each ``every``-th tick (SNK-1, SNK-3)."""
        method, step = self.plan(dt)
        if method in integrators.ADAPTIVE:
            from .network import folded

            return folded(self, df, ticks, dt, record, every, first)
        noises, held, resets = self.noises(step), self.held(), self.resets()
        threshold = self.code(self.threshold, "threshold") if self.threshold else None
        kept = [*self.stored, "lastspike", "not_refractory"]
        types = self.stored | {"lastspike": "double", "not_refractory": "boolean"}
        spec = "".join(f"{r}: double, " for r in record)
        start = F.struct(
            *[F.col(k).alias(k) for k in kept],
            F.array().cast("array<bigint>").alias("spikes"),
            F.array().cast(f"array<struct<{spec}tick: bigint>>").alias("trace"),
        )

        def tick(state: Column, k: Column) -> Column:
            t = k.cast("double") * dt
            env = {name: state[name] for name in kept}
            base = {"t": t, "dt": F.lit(dt), "_tick": k}
            base |= {x: rng.normal(self.seed, f"{self.name}/xi{x[3:]}", k, F.col("i")) * dt**0.5 for x in noises}

            def run(tree):
                return lang.column(tree, self.columns({**base, **env}))

            for name, tree in held:
                base[name] = run(tree)
            shown = F.struct(*[run(self.code(r, f"show{r}")).cast("double").alias(r) for r in record], k.alias("tick"))
            trace = F.when(k % every == 0, F.array_append(state["trace"], shown)).otherwise(state["trace"]) if record else state["trace"]
            if self.refractory is not None:
                env["not_refractory"] = self._ready(run, t, dt, state)
            out = self._statements(step, env, run, types, guarded=True)
            if self.threshold is None:
                return F.struct(*[out[k].alias(k) for k in kept], state["spikes"].alias("spikes"), trace.alias("trace"))
            env.update(out)
            fired = run(threshold) & env["not_refractory"]

            # a struct for what the reset reads, so that the threshold is taken once
            def reset(s: Column) -> Column:
                env.update({name: s[name] for name in kept})
                changed = self._statements(resets, env, run, types, guarded=False)
                env.update({name: s[name] for name in kept})
                return F.struct(
                    *[F.when(s["fired"], changed[c]).otherwise(s[c]).alias(c) if c not in ("lastspike", "not_refractory") else s[c].alias(c) for c in kept],
                    F.when(s["fired"], F.array_append(s["spikes"], k)).otherwise(s["spikes"]).alias("spikes"),
                    s["trace"].alias("trace"),
                )

            now = dict(env)
            now["lastspike"] = F.when(fired, t).otherwise(env["lastspike"])
            if self.refractory is not None:
                now["not_refractory"] = F.when(fired, F.lit(False)).otherwise(env["not_refractory"])
            fields = [now[c].cast(types[c]).alias(c) for c in kept]
            merged = F.struct(*fields, fired.alias("fired"), state["spikes"].alias("spikes"), trace.alias("trace"))
            return F.transform(F.array(merged), reset)[0]

        folded = F.aggregate(F.sequence(F.lit(first).cast("bigint"), F.lit(first + ticks - 1).cast("bigint")), start, tick)
        return df.select("i", folded.alias("_s")).select("i", "_s.*")

    def _ready(self, run, t: Column, dt: float, state: Column) -> Column:
        """Whether a row may change and fire again: by ticks since it fired, or by a condition that only frees it."""
        tree = self.code(str(self.refractory), "refractory")
        if isinstance(self.refractory, str) and any(type(n).__name__ in ("Compare", "BoolOp") for n in lang.ast.walk(tree)):
            return state["not_refractory"] | ~run(tree)
        held = lang.timestep(run(tree).cast("double"), F.lit(dt))
        return lang.timestep(t - state["lastspike"], F.lit(dt)) >= held

    def _statements(self, step, env: dict, run, types: dict, guarded: bool) -> dict[str, Column]:
        """Run statements one after another on an environment; gives the stored columns. While a row is refractory,
        guarded columns keep their values."""
        before = dict(env)
        frozen = {e.name for e in self.equations.of("ode").values() if "unless refractory" in e.flags} if guarded else set()
        for target, tree in step:
            value = run(tree)
            if target in types:
                value = value.cast(types[target])
                if target in frozen:
                    value = F.when(env["not_refractory"], value).otherwise(before[target])
            env[target] = value
        out = {k: env[k] for k in types}
        for k in list(env):
            if k not in before:
                del env[k]
        return out


def spikes(folded: DataFrame) -> DataFrame:
    """Events ``(i, tick)`` of a fold (SNK-2)."""
    return folded.select("i", F.explode("spikes").alias("tick"))


def traces(folded: DataFrame) -> DataFrame:
    """Recorded columns ``(i, tick, ...)`` of a fold."""
    return folded.select("i", F.explode("trace").alias("_t")).select("i", "_t.*")


def run_regularly(df: DataFrame, tick: int, every: int, updates: dict[str, Column]) -> DataFrame:
    """An update on its own clock: applied where the tick is one of its (PRJ-9)."""
    return df.withColumns(updates) if tick % every == 0 else df


def run_at(df: DataFrame, tick: int, times: list[float], dt: float, updates: dict[str, Column]) -> DataFrame:
    """An update at listed times (PRJ-10)."""
    due = {int((t + 1e-3 * dt) / dt) for t in times}
    return df.withColumns(updates) if tick in due else df


def conditional_set(df: DataFrame, name: str, value: Column, where: Column) -> DataFrame:
    return df.withColumn(name, F.when(where, value).otherwise(F.col(name)))
