"""Assemblies: several groups, synapses with state and code of their own, and clocked code, as whole networks.

A parameter sweep or a study is many networks; each is one group of rows (``run``), and all run side by side, a task
each, in NumPy. A single network that does not fit a task is cut into ``shards`` by the targets of its edges, where
nothing flows back into the sources of edges: these are in every shard, everything else is in one, and results are the
same to the last bit. Recurrent ones run in supersteps instead (``network.Network``), which take additive pathways only.

Order within a tick: ``start`` (held views, operations, clocked code, recording), ``groups`` (summed variables, then
the groups' state updates, then those of clock-driven synapses), ``thresholds`` (events), ``synapses`` (pathways by
order, then name; what is due to each in the order of its edges), ``resets`` (resets and code on events), ``end``.

Names in a synapse's code are its own columns, then ``x_pre`` and ``x_post`` of its ends, then, bare, those of the
target. Statements run one after the other over all edges concerned; ``+=``, ``-=`` and ``*=`` on an end's column take
every edge, ``=`` the last edge's value. Event-driven equations are advanced from the edge's last event.

Defined results: rows of an object with the same number, edges whose ends do not exist, columns that nobody defines and unknown groups are errors, as are
delays below zero; a null value counts as 0; a run without nodes gives nothing; other runs don't matter to a run.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lang
from ..plans import integrators
from ..plans.equations import EquationError, Equations
from .group import Group
from .network import Kernel

NODES = "run long, object string, i long, values map<string,double>"
EDGES = "run long, object string, seq long, i long, j long, values map<string,double>"
RESULT = "run long, kind string, object string, tick long, i long, name string, value double"


@dataclass
class Way:
    """A pathway of synapses: code that an event of one end runs on its edges, after a delay (STR-8)."""

    code: str
    side: str = "pre"
    #: Seconds, or the name of an edge column that holds them.
    delay: float | str = 0.0
    event: str = "spike"
    order: int | None = None

    @property
    def place(self) -> int:
        return self.order if self.order is not None else (-1 if self.side == "pre" else 1)


@dataclass
class Synapses:
    """Edges from one object's rows to another's: equations of their columns and pathways (EDG-1). ``target`` may be
    other synapses, whose edges then are the rows (JOIN-15)."""

    name: str
    source: str
    target: str
    equations: Equations | str = ""
    ways: dict[str, Way] = field(default_factory=dict)
    method: str | tuple[str, ...] = ("exact", "euler")
    namespace: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        if isinstance(self.equations, str):
            self.equations = Equations.parse(self.equations)
        self.check()

    def flagged(self, flag: str) -> set[str]:
        return {e.name for e in self.equations.items.values() if flag in e.flags}

    @property
    def summed(self) -> dict[str, ast.expr]:
        """Columns of an end that are sums over its edges (AGG-1): ``x_post = expr : unit (summed)``."""
        return {e.name: e.expr for e in self.equations.items.values() if "summed" in e.flags}

    @property
    def stored(self) -> dict[str, str]:
        return {e.name: e.sql_type for e in self.equations.items.values() if e.kind != "sub"}

    def check(self) -> None:
        """What evolves by the clock may not need what evolves by events, nor the other way round (EDG-7)."""
        events = self.flagged("event-driven")
        clocked = {e.name for e in self.equations.of("ode").values()} - events
        for e in self.equations.of("ode").values():
            other = clocked if e.name in events else events
            if found := lang.names(self.equations.resolved(e.expr)) & other:
                raise EquationError(f"{e.name} can't depend on {sorted(found)}: one is driven by events, the other by the clock")
        for name in self.summed:
            if not name.endswith(("_pre", "_post")):
                raise EquationError(f"{name} is summed: its name must end in _pre or _post")


@dataclass
class Clocked:
    """Code of a group's or synapses' rows on a clock: every so many seconds, at listed times, or on an event."""

    target: str
    code: str
    every: float | None = None
    at: tuple[float, ...] = ()
    event: str | None = None

    def due(self, k: int, dt: float) -> bool:
        if self.every is not None:
            return k % max(1, int(self.every / dt + 0.5)) == 0
        return k in {int((t + 1e-3 * dt) / dt) for t in self.at}


@dataclass
class Linked:
    """A column of one group that shows one of another, by an index column or row by row (JOIN-8)."""

    target: str
    name: str
    source: str
    column: str
    index: str | None = None


class Stop(Exception):
    """Raised by an operation to end a run after this tick (LIM-2)."""


class Rows:
    """An object's rows in a run."""

    def __init__(self, name: str, kinds: dict[str, str], ids: np.ndarray, values: list[np.ndarray]):
        """``ids`` rise; ``values`` has the columns of ``kinds``, in their order."""
        self.name, self.ids, self.kinds = name, ids, kinds
        types = {"double": float, "int": np.int32, "boolean": bool}
        self.state: dict[str, np.ndarray] = {}
        for (c, kind), x in zip(kinds.items(), values, strict=True):
            if kind == "int" and not (np.abs(x) < 2**31).all():
                raise ValueError(f"{c} of {name} is no integer of 32 bits somewhere")
            self.state[c] = x.astype(types[kind])
        self.fired: dict[str, np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.ids)


@dataclass
class Assembly:
    """Groups, synapses, clocked code and links. ``record`` names columns as ``object.column``; ``operations`` are
    Python functions of (tick, {object: Rows}) called at the start of every tick (STR-11)."""

    groups: list[Group]
    synapses: list[Synapses] = field(default_factory=list)
    clocked: list[Clocked] = field(default_factory=list)
    links: list[Linked] = field(default_factory=list)
    operations: list[Callable[[int, dict[str, Rows]], None]] = field(default_factory=list)
    record: tuple[str, ...] = ()
    every: int = 1
    active: frozenset[str] | None = None

    def __post_init__(self):
        names = [g.name for g in self.groups] + [s.name for s in self.synapses]
        if len(set(names)) < len(names):
            raise ValueError("two objects have the same name")
        for s in self.synapses:
            for end in (s.source, s.target):
                if end not in names:
                    raise lang.unknown(end, names)
        for c in [*self.clocked, *self.links]:
            if c.target not in names:
                raise lang.unknown(c.target, names)

    def nodes(self, spark: SparkSession, runs: int = 1) -> DataFrame:
        """The groups' initial rows, the same for every run."""
        out = None
        for g in self.groups:
            pairs = [x for c in g.stored for x in (F.lit(c), F.col(c).cast("double"))]
            values = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")
            rows = g.table(spark).select(F.lit(g.name).alias("object"), "i", values.alias("values"))
            out = rows if out is None else out.unionByName(rows)
        return spark.range(runs).select(F.col("id").alias("run")).join(out).select("run", "object", "i", "values")

    @property
    def kinds(self) -> dict[str, dict[str, str]]:
        """The columns of every object's rows."""
        delays = {s.name: {w.delay: "double" for w in s.ways.values() if isinstance(w.delay, str)} for s in self.synapses}
        return {x.name: dict(x.stored) | delays.get(x.name, {}) for x in [*self.groups, *self.synapses]}

    def run(self, nodes: DataFrame, edges: DataFrame | None, ticks: int, dt: float, shards: int = 1) -> DataFrame:
        """Events, recorded values and final states of all runs, a row each: ``(run, kind, object, tick, i, name,
        value)`` with kind ``event``, ``trace`` or ``state``; an edge's ``i`` is its ``seq``."""

        def result(live: Live, run: int | None) -> pa.Table:
            live.out += [("state", name, live.ticks, rows.ids, c, x) for name, rows in live.shown() for c, x in rows.state.items()]
            parts = []
            for kind, name, tick, ids, column, values in live.out:
                n = len(ids)
                fixed = [pa.repeat(pa.scalar(x, t), n) for x, t in ((run, pa.int64()), (kind, pa.string()), (name, pa.string()), (tick, pa.int64()))]
                parts.append(pa.table([*fixed, pa.array(ids), pa.repeat(column, n), pa.array(values, pa.float64())], SHOWN.names))
            return pa.concat_tables(parts) if parts else SHOWN.empty_table()

        return self.solved(nodes, edges, ticks, dt, shards, result, SHOWN, RESULT)

    def final(self, nodes: DataFrame, edges: DataFrame | None, ticks: int, dt: float, name: str, shards: int = 1) -> DataFrame:
        """The final state of one object alone, a row for each of its rows: ``(run, i, ...)`` with its columns as doubles."""
        columns = list(self.kinds[name])
        schema = pa.schema([("run", pa.int64()), ("i", pa.int64()), *((c, pa.float64()) for c in columns)])

        def result(live: Live, run: int | None) -> pa.Table:
            rows = dict(live.shown()).get(name)
            if rows is None:
                return schema.empty_table()
            values = [pa.array(rows.state[c].astype(float)) for c in columns]
            return pa.table([pa.repeat(pa.scalar(run, pa.int64()), len(rows)), pa.array(rows.ids), *values], schema.names)

        text = "run long, i long" + "".join(f", `{c}` double" for c in columns)
        return self.solved(nodes, edges, ticks, dt, shards, result, schema, text)

    def solved(self, nodes: DataFrame, edges: DataFrame | None, ticks: int, dt: float, shards: int, result: Callable, schema: pa.Schema, text: str) -> DataFrame:
        spark = nodes.sparkSession
        edges = edges if edges is not None else spark.createDataFrame([], EDGES)
        kept = self.everywhere() if shards > 1 else frozenset()

        def one(rows: pa.Table, links: pa.Table) -> pa.Table:
            if not rows.num_rows:
                return schema.empty_table()
            live = Live(self, dt, rows, links, kept if rows.column("shard")[0].as_py() else frozenset())
            live.advance(ticks)
            out = result(live, rows.column("run")[0].as_py())
            return pa.Table.from_batches(out.to_batches(max_chunksize=100_000), out.schema)

        nodes, edges = self.dealt(self.flat(nodes, ["i"]), self.flat(edges, ["seq", "i", "j"]), shards, kept)
        return nodes.groupBy("run", "shard").cogroup(edges.groupBy("run", "shard")).applyInArrow(one, text)

    def flat(self, rows: DataFrame, ids: list[str]) -> DataFrame:
        """Rows with their values in columns ``c0``, ``c1``, ... in the order of their object's; ``odd`` is the first name
        that the object doesn't have."""
        kinds = self.kinds

        def by_object(of: Callable[[list[str]], Column]) -> Column:
            out = F.lit(None)
            for name, own in kinds.items():
                out = F.when(F.col("object") == name, of(list(own))).otherwise(out)
            return out

        wide = max(map(len, kinds.values()), default=0)
        columns = [by_object(lambda own, n=n: F.col("values")[own[n]] if n < len(own) else F.lit(None)).cast("double").alias(f"c{n}") for n in range(wide)]
        known = lambda own: F.array(*map(F.lit, [*own, "lastspike"]))
        odd = by_object(lambda own: F.array_min(F.array_except(F.map_keys("values"), known(own)))).cast("string").alias("odd")
        return rows.select("run", "object", *ids, *columns, odd)

    def dealt(self, nodes: DataFrame, edges: DataFrame, shards: int, kept: frozenset[str]) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges with their shards. An edge goes where its target is, one onto another edge where that edge
        goes; a bare row (``stub``) of each goes where its ``seq`` is, for two of the same number to be found."""
        if shards <= 1:
            return nodes.withColumn("shard", F.lit(0)), edges.withColumns({"shard": F.lit(0), "stub": F.lit(False)})
        home = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(shards)).cast("int")
        every = F.sequence(F.lit(0), F.lit(shards - 1))
        marks = nodes.select("run").distinct()  # each shard knows of each run that has nodes
        all_ = nodes.withColumn("shard", F.explode(F.when(F.col("object").isin(*kept), every).otherwise(F.array(home("i")))))
        all_ = all_.unionByName(marks.withColumn("shard", F.explode(every)), allowMissingColumns=True)

        onto = {s.name: s.target for s in self.synapses if s.target in {x.name for x in self.synapses}}
        placed = edges.filter(~F.coalesce(F.col("object").isin(*onto), F.lit(False))).withColumn("at", home("j")) if onto else edges.withColumn("at", home("j"))
        waiting = dict(onto)
        while waiting:
            name = next(x for x, target in waiting.items() if target not in waiting)
            target = placed.filter(F.col("object") == waiting.pop(name)).select("run", F.col("seq").alias("j"), "at")
            own = edges.filter(F.col("object") == name).join(target, ["run", "j"], "left").withColumn("at", F.coalesce("at", home("j")))
            placed = placed.unionByName(own)
        both = F.array(F.struct(F.col("at").alias("shard"), F.lit(False).alias("stub")), F.struct(home("seq").alias("shard"), F.lit(True).alias("stub")))
        bare = {c: F.when(~F.col("stub"), F.col(c)).alias(c) for c in edges.columns if c not in ("run", "object", "seq")}
        copies = placed.withColumn("_to", F.explode(both)).select(*edges.columns, "_to.shard", "_to.stub")
        return all_, copies.withColumns(bare)

    def everywhere(self) -> frozenset[str]:
        """The groups that every shard must have: the sources of edges. An error where shards would not be on their own."""
        kinds, sources = self.kinds, frozenset(s.source for s in self.synapses)
        texts = [x for g in self.groups for x in (g.threshold, g.reset, g.refractory, *g.events.values())] + [w.code for s in self.synapses for w in s.ways.values()]
        texts += [c.code for c in self.clocked] + [ast.unparse(e.expr) for x in [*self.groups, *self.synapses] for e in x.equations.items.values() if e.expr is not None]
        written = set()
        for s in self.synapses:
            code = [w.code for w in s.ways.values()] + [c.code for c in self.clocked if c.target == s.name]
            names = {x.target for text in code for x in lang.statements(text)} - kinds[s.name].keys() | s.summed.keys()
            for name in names:
                for suffix, other in (("_pre", s.source), ("_post", s.target), ("", s.target)):
                    if name.endswith(suffix) and name.removesuffix(suffix) in kinds[other]:
                        written.add(other)
                        break
        why = [
            ("links", bool(self.links)), ("operations", bool(self.operations)), ("N", any(re.search(r"\bN\b", str(x)) for x in texts)),
            ("edges from edges", bool(sources & {s.name for s in self.synapses})), (f"code that changes {sorted(sources & written)}, sources of edges,", bool(sources & written)),
        ]
        if found := [x for x, holds in why if holds]:
            raise ValueError(f"a network with {found[0]} can't be cut into shards")
        return sources


#: What ``Assembly.run`` gives, in Arrow.
SHOWN = pa.schema([("run", pa.int64()), ("kind", pa.string()), ("object", pa.string()), ("tick", pa.int64()), ("i", pa.int64()), ("name", pa.string()), ("value", pa.float64())])


def whole(column: pa.ChunkedArray, name: str) -> np.ndarray:
    if column.null_count:
        raise ValueError(f"a row of {name} has no number or no end")
    return column.to_numpy()


class Live:
    """One run of an assembly."""

    def __init__(self, plan: Assembly, dt: float, nodes: pa.Table, edges: pa.Table, hidden: frozenset[str] = frozenset()):
        """``hidden``: objects whose results another shard gives."""
        self.plan, self.dt, self.hidden, self.kinds = plan, dt, hidden, plan.kinds
        self.rows: dict[str, Rows] = {}
        self.kernels = {g.name: Kernel.of(g, dt) for g in plan.groups}
        for g in plan.groups:
            rows, _ = self.load(g.name, nodes.filter(pc.equal(nodes.column("object"), g.name)), "i")
            rows.last, rows.ready = np.full(len(rows), -1e4), np.ones(len(rows), bool)
            self.rows[g.name] = rows
        self.ends: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting = list(plan.synapses)
        while waiting:  # synapses on synapses come after those they are on
            s = next((x for x in waiting if x.source in self.rows and x.target in self.rows), None)
            if s is None:
                raise ValueError("synapses that need each other's rows")
            waiting.remove(s)
            own = edges.filter(pc.equal(edges.column("object"), s.name))
            stubs = whole(own.filter(own.column("stub")).column("seq"), s.name)
            if len(np.unique(stubs)) < len(stubs):
                raise ValueError(f"two rows of {s.name} have the same number")
            self.rows[s.name], own = self.load(s.name, own.filter(pc.invert(own.column("stub"))), "seq")
            self.rows[s.name].updated = np.zeros(own.num_rows)
            self.ends[s.name] = (self.places(s.source, s.name, own, "i"), self.places(s.target, s.name, own, "j"))
        self.steps = {s.name: self.steps_of(s) for s in plan.synapses}
        self.queue: dict[tuple[str, str], dict[int, list[np.ndarray]]] = {(s.name, w): {} for s in plan.synapses for w in s.ways}
        self.known = {g.name for g in plan.groups} if plan.active is None else set(plan.active)
        #: Kind, object, tick, numbers of rows, name and values.
        self.out: list[tuple] = []
        self.ticks = 0

    def load(self, name: str, own: pa.Table, key: str) -> tuple[Rows, pa.Table]:
        ids = whole(own.column(key), name)
        own = own.take(np.argsort(ids, kind="stable"))
        ids = own.column(key).to_numpy()
        if (ids[1:] == ids[:-1]).any():
            raise ValueError(f"two rows of {name} have the same number")
        if unknown := pc.min(own.column("odd")).as_py():
            raise lang.unknown(unknown, self.kinds[name])
        values = [own.column(f"c{n}").fill_null(0.0).to_numpy() for n in range(len(self.kinds[name]))]
        return Rows(name, self.kinds[name], ids, values), own

    def shown(self) -> list[tuple[str, Rows]]:
        return [(name, rows) for name, rows in self.rows.items() if name not in self.hidden]

    def places(self, name: str, edges: str, own: pa.Table, end: str) -> np.ndarray:
        ids, want = self.rows[name].ids, whole(own.column(end), edges)
        at = np.searchsorted(ids, want)
        if len(want) and ((at >= len(ids)) | (ids[np.minimum(at, max(0, len(ids) - 1))] != want)).any() if len(ids) else len(want):
            raise ValueError(f"an edge's end is no row of {name}")
        return at

    def steps_of(self, s: Synapses) -> tuple[list, list]:
        """Statements of an edge's event-driven and clock-driven equations."""
        rates = s.equations.rates()
        events = {x: tree for x, tree in rates.items() if x in s.flagged("event-driven")}
        constants = {k: float(v) for k, v in Group(1, "").constants().items()}
        driven = integrators.exact(events, constants) if events else []
        clocked = Equations({k: e for k, e in s.equations.items.items() if k not in events})
        method, step = integrators.step(clocked, s.method, s.namespace, self.dt) if clocked.of("ode") else ("none", [])
        if method in integrators.ADAPTIVE:
            raise integrators.UnsupportedEquations(f"{method} is for groups, not for synapses")
        return driven, step

    # --- names ------------------------------------------------------------------------------------------------

    def group_env(self, g: Group, k: int) -> dict:
        rows, kernel = self.rows[g.name], self.kernels[g.name]
        env = {**kernel.constants, **rows.state, "t": k * self.dt, "dt": self.dt, "N": len(rows), "i": rows.ids, "lastspike": rows.last, "not_refractory": rows.ready}
        env |= kernel.draws(k, rows.ids)
        for name, tree in kernel.held:
            env[name] = np.broadcast_to(lang.array(tree, env), rows.ids.shape)
        return env

    def edge_env(self, s: Synapses, k: int, at: np.ndarray) -> dict:
        from ..functions import rng

        rows, (pre, post) = self.rows[s.name], self.ends[s.name]
        env: dict[str, Any] = {}
        for suffix, name, end in (("", s.target, post), ("_pre", s.source, pre), ("_post", s.target, post)):
            other = self.rows[name]
            for c, values in other.state.items():
                env[c + suffix] = values[end[at]]
            if hasattr(other, "last") and suffix:
                env["lastspike" + suffix], env["not_refractory" + suffix] = other.last[end[at]], other.ready[end[at]]
        env |= {c: v[at] for c, v in rows.state.items()}
        env |= {n: float(v) if isinstance(v, (int, float)) else v.value for n, v in s.namespace.items()}
        env |= {"t": k * self.dt, "dt": self.dt, "i": self.rows[s.source].ids[pre[at]], "j": self.rows[s.target].ids[post[at]], "lastupdate": rows.updated[at], "N": len(rows)}
        group = next((g for g in self.plan.groups if g.name == s.source), None)
        seed, ids = group.seed if group else 0, rows.ids[at]
        env["rand"] = lambda site="": rng.uniforms(seed, f"{s.name}/rand/{site}", k, ids)
        env["randn"] = lambda site="": rng.normals(seed, f"{s.name}/randn/{site}", k, ids)
        env["poisson"] = lambda site, rate: rng.poissons(rate, seed, f"{s.name}/poisson/{site}", k, ids)
        return env

    # --- a tick -----------------------------------------------------------------------------------------------

    def advance(self, ticks: int) -> None:
        for k in range(ticks):
            try:
                for operation in self.plan.operations:
                    operation(k, self.rows)
            except Stop:
                ticks = k
                break
            self.tick(k)
        self.ticks = ticks

    def tick(self, k: int) -> None:
        plan = self.plan
        for link in plan.links:
            own, other = self.rows[link.target], self.rows[link.source]
            at = own.state[link.index].astype(int) if link.index else np.arange(len(own))
            own.state[link.name] = other.state[link.column][at].astype(own.state[link.name].dtype)
        for c in plan.clocked:
            if c.event is None and c.due(k, self.dt):
                self.apply(c, k, np.arange(len(self.rows[c.target])))
        if k % plan.every == 0:
            for item in plan.record:
                name, column = item.split(".")
                if name in self.hidden:
                    continue
                values = self.rows[name].state.get(column)
                if values is None:
                    g = next(g for g in plan.groups if g.name == name)
                    values = np.broadcast_to(lang.array(g.code(column, f"show{column}"), self.group_env(g, k)), self.rows[name].ids.shape)
                self.out.append(("trace", name, k, self.rows[name].ids, column, np.array(values, float)))
        for s in plan.synapses:
            self.sums(s, k)
        for g in plan.groups:
            self.update(g, k)
        for s in plan.synapses:
            if self.steps[s.name][1]:
                every = np.arange(len(self.rows[s.name]))
                self.assign(s, self.steps[s.name][1], k, every, scatter=False)
        for g in plan.groups:
            self.fire(g, k)
        for s in plan.synapses:
            for name, way in s.ways.items():
                self.push(s, name, way, k)
        for s, name, way in sorted(((s, n, w) for s in plan.synapses for n, w in s.ways.items()), key=lambda x: (x[2].place, x[0].name, x[1])):
            due = self.queue[s.name, name].pop(k, None)
            if due:
                self.deliver(s, way, k, np.sort(np.concatenate(due)))
        for g in plan.groups:
            fired = self.rows[g.name].fired.get("spike")
            if fired is not None and len(fired) and g.reset:
                self.statements(g, self.kernels[g.name].reset, k, fired)
        for c in plan.clocked:
            if c.event is not None:
                fired = self.rows[c.target].fired.get(c.event)
                if fired is not None and len(fired):
                    self.apply(c, k, fired)

    def sums(self, s: Synapses, k: int) -> None:
        every = np.arange(len(self.rows[s.name]))
        for name, tree in s.summed.items():
            column, _, side = name.rpartition("_")
            end = self.ends[s.name][0 if side == "pre" else 1]
            rows = self.rows[s.source if side == "pre" else s.target]
            value = np.broadcast_to(np.asarray(lang.array(s.equations.resolved(tree), self.edge_env(s, k, every)), float), every.shape)
            rows.state[column] = np.bincount(end, value, len(rows)).astype(rows.state[column].dtype)

    def update(self, g: Group, k: int) -> None:
        rows, kernel = self.rows[g.name], self.kernels[g.name]
        env = self.group_env(g, k)
        if kernel.refractory is not None:
            held = lang.array(kernel.refractory, env)
            if kernel.condition:
                rows.ready = rows.ready | ~np.broadcast_to(held, rows.ids.shape)
            else:
                gone = ((k * self.dt - rows.last + 1e-3 * self.dt) / self.dt).astype(np.int64)
                rows.ready = gone >= ((np.asarray(held, float) + 1e-3 * self.dt) / self.dt).astype(np.int64)
            env["not_refractory"] = rows.ready
        if self.plan.active is None or g.name in self.plan.active:
            kernel.integrate(env, rows.state, rows.ready)

    def fire(self, g: Group, k: int) -> None:
        rows = self.rows[g.name]
        rows.fired = {}
        if self.plan.active is not None and g.name not in self.plan.active:
            return
        conditions = ({"spike": g.threshold} if g.threshold else {}) | g.events
        for event, text in conditions.items():
            env = self.group_env(g, k)
            site = "threshold" if event == "spike" else f"event{event}"
            fired = np.broadcast_to(lang.array(g.code(text, site), env), rows.ids.shape)
            if event == "spike":
                fired = fired & rows.ready
                rows.last = np.where(fired, k * self.dt, rows.last)
                if g.refractory is not None:
                    rows.ready = rows.ready & ~fired
            rows.fired[event] = np.flatnonzero(fired)
            if g.name not in self.hidden:
                self.out.append(("event", g.name, k, rows.ids[rows.fired[event]], event, np.ones(len(rows.fired[event]))))

    def push(self, s: Synapses, name: str, way: Way, k: int) -> None:
        fired = self.rows[s.source if way.side == "pre" else s.target].fired.get(way.event)
        if fired is None or not len(fired):
            return
        end = self.ends[s.name][0 if way.side == "pre" else 1]
        hit = np.zeros(len(self.rows[s.source if way.side == "pre" else s.target]), bool)
        hit[fired] = True
        edges = np.flatnonzero(hit[end])
        delay = self.rows[s.name].state[way.delay][edges] if isinstance(way.delay, str) else np.full(len(edges), float(way.delay))
        if (delay < 0).any():
            raise ValueError(f"a delay of {s.name} is below zero")
        later = (delay / self.dt + 0.5).astype(np.int64)
        for d in np.unique(later):
            self.queue[s.name, name].setdefault(k + int(d), []).append(edges[later == d])

    def deliver(self, s: Synapses, way: Way, k: int, edges: np.ndarray) -> None:
        rows, driven = self.rows[s.name], self.steps[s.name][0]
        if driven:
            env = self.edge_env(s, k, edges) | {"dt": k * self.dt - rows.updated[edges]}
            for target, tree in driven:
                env[target] = lang.array(tree, env)
                if target in rows.state:
                    rows.state[target][edges] = env[target]
        rows.updated[edges] = k * self.dt
        code = [(x, lang.numbered(x.value, f"{way.side}{n}")) for n, x in enumerate(lang.statements(way.code))]
        self.assign(s, code, k, edges, scatter=True)

    def assign(self, s: Synapses, code: list, k: int, edges: np.ndarray, scatter: bool) -> None:
        rows = self.rows[s.name]
        env = self.edge_env(s, k, edges)
        local: dict[str, np.ndarray] = {}
        for line, tree in code:
            target, op = (line, "") if isinstance(line, str) else (line.target, line.op)
            value = np.broadcast_to(lang.array(s.equations.resolved(tree), env | local), edges.shape)
            if target in rows.state:
                old = rows.state[target][edges]
                rows.state[target][edges] = combined(op, old, value)
                env = self.edge_env(s, k, edges)
                continue
            end = self.end_of(s, target)
            if end is None or not scatter:
                local[target] = value
                continue
            other, column, at = end
            into, places = other.state[column], at[edges]
            if hasattr(other, "ready") and column in self.kernels[other.name].frozen:
                open_ = other.ready[places]
                places, value = places[open_], value[open_]
            if op in ("+", "-"):
                np.add.at(into, places, value if op == "+" else -value)
            elif op in ("*", "/"):
                np.multiply.at(into, places, value if op == "*" else 1 / value)
            elif op:
                raise lang.LanguageError(f"{op}= of an end's column is not defined")
            else:
                into[places] = value  # of several the last
            env = self.edge_env(s, k, edges)

    def end_of(self, s: Synapses, name: str) -> tuple[Rows, str, np.ndarray] | None:
        pre, post = self.ends[s.name]
        for suffix, other, at in (("_pre", s.source, pre), ("_post", s.target, post), ("", s.target, post)):
            column = name.removesuffix(suffix) if suffix else name
            if name.endswith(suffix) and column in self.rows[other].state:
                return self.rows[other], column, at
        return None

    def statements(self, g: Group, code: list, k: int, at: np.ndarray) -> None:
        rows = self.rows[g.name]
        where = np.zeros(len(rows), bool)
        where[at] = True
        self.kernels[g.name]._apply(code, self.group_env(g, k), rows.state, where, np.ones(len(rows), bool))

    def apply(self, c: Clocked, k: int, at: np.ndarray) -> None:
        group = next((g for g in self.plan.groups if g.name == c.target), None)
        if group is not None:
            own = [(x.target, group.code(x.full, f"clocked{n}")) for n, x in enumerate(lang.statements(c.code))]
            return self.statements(group, own, k, at)
        s = next(s for s in self.plan.synapses if s.name == c.target)
        return self.assign(s, [(x, lang.numbered(x.value, f"clocked{n}")) for n, x in enumerate(lang.statements(c.code))], k, at, scatter=True)


def combined(op: str, old: np.ndarray, value: np.ndarray) -> np.ndarray:
    return lang.array(f"a {op} b", {"a": old, "b": value}) if op else value


def of_kind(result: DataFrame, kind: str, name: str | None = None) -> DataFrame:
    """Events, traces or states of a result; of one event or column where a name is given."""
    out = result.filter(F.col("kind") == kind)
    return out.filter(F.col("name") == name) if name else out


def edge_rows(edges: DataFrame, name: str, columns: tuple[str, ...] = (), run: Any = 0) -> DataFrame:
    """Edges ``(seq, i, j, ...)`` as rows of an assembly's synapses; ``run`` is a number or a column's name."""
    pairs = [x for c in columns for x in (F.lit(c), F.col(c).cast("double"))]
    values = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")
    own = F.col(run) if isinstance(run, str) else F.lit(run)
    ends = [F.col(c).cast("long").alias(c) for c in ("seq", "i", "j")]
    return edges.select(own.cast("long").alias("run"), F.lit(name).alias("object"), *ends, values.alias("values"))
