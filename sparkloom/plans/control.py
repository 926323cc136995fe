"""The control plane: preferences, clocks, registries, monitors of a run, parameter sweeps, and plan export."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field
from graphlib import TopologicalSorter
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lang
from ..functions import units as U

log = logging.getLogger("sparkloom")


# --- preferences ----------------------------------------------------------------------------------------------


class Preferences:
    """Named settings with checks; unknown names are errors with suggestions (CTL-1, CTL-12)."""

    def __init__(self):
        self.known: dict[str, tuple[Any, Callable[[Any], bool]]] = {}
        self.values: dict[str, Any] = {}

    def register(self, name: str, default: Any, check: Callable[[Any], bool] = lambda v: True) -> None:
        self.known[name] = (default, check)

    def __getitem__(self, name: str) -> Any:
        if name not in self.known:
            raise lang.unknown(name, self.known)
        return self.values.get(name, self.known[name][0])

    def __setitem__(self, name: str, value: Any) -> None:
        if name not in self.known:
            raise lang.unknown(name, self.known)
        if not self.known[name][1](value):
            raise ValueError(f"{value!r} is not a value of {name}")
        self.values[name] = value

    def under(self, prefix: str) -> dict[str, Any]:
        return {k: self[k] for k in self.known if k.startswith(prefix + ".")}

    def read(self, text: str) -> None:
        """Lines of ``name = value``, values as JSON."""
        for line in text.splitlines():
            if line.strip() and not line.strip().startswith("#"):
                name, _, value = line.partition("=")
                self[name.strip()] = json.loads(value)


prefs = Preferences()
prefs.register("run.shards", 0, lambda v: isinstance(v, int) and v >= 0)
prefs.register("run.method", ["exact", "euler", "heun"], lambda v: isinstance(v, list))
prefs.register("run.seed", 0, lambda v: isinstance(v, int))


# --- clocks ---------------------------------------------------------------------------------------------------


@dataclass
class Clock:
    """Logical time: a tick and a step; the time is always their product (STR-1)."""

    dt: float
    tick: int = 0

    @property
    def t(self) -> float:
        return self.tick * self.dt

    def end_tick(self, until: float) -> int:
        """The nearest tick; the next one where the time isn't on the grid."""
        near = round(until / self.dt)
        return near if abs(near * self.dt - until) <= 1e-4 * self.dt else int(until / self.dt) + 1

    def with_dt(self, dt: float) -> Clock:
        """Another step between runs: the time must be on the new grid (STR-4)."""
        tick = round(self.t / dt)
        if abs(tick * dt - self.t) > 1e-4 * dt:
            raise ValueError(f"{self.t} s is not a multiple of {dt} s")
        return Clock(dt, tick)


@dataclass
class EventClock:
    """A clock that goes through listed times (STR-2)."""

    times: list[float]
    tick: int = 0

    def __post_init__(self):
        if len(set(self.times)) < len(self.times):
            raise ValueError("a time is listed twice")
        self.times = sorted(self.times)

    @property
    def t(self) -> float:
        return self.times[self.tick] if self.tick < len(self.times) else float("inf")


def advance(clocks: list[Clock | EventClock], tolerance: float = 1e-9) -> list[Clock | EventClock]:
    """The clocks whose time comes next, after they have been moved on (STR-3)."""
    now = min(c.t for c in clocks)
    due = [c for c in clocks if c.t - now <= tolerance]
    for c in due:
        c.tick += 1
    return due


# --- objects --------------------------------------------------------------------------------------------------


@dataclass
class Scope:
    """The objects of a session: unique names, what depends on what, and which are active (CTL-5, CTL-6, STR-16)."""

    objects: dict[str, Any] = field(default_factory=dict)
    needs: dict[str, set[str]] = field(default_factory=dict)
    inactive: set[str] = field(default_factory=set)

    def add(self, obj: Any, name: str, needs: tuple[str, ...] = ()) -> str:
        """A name that ends in * gets a number."""
        if name.endswith("*"):
            stem, k = name[:-1], 0
            while (name := stem + (f"_{k}" if k else "")) in self.objects:
                k += 1
        if name in self.objects:
            raise ValueError(f"the name {name} is taken")
        self.objects[name], self.needs[name] = obj, set(needs)
        return name

    def remove(self, name: str) -> None:
        if users := [k for k, v in self.needs.items() if name in v]:
            raise ValueError(f"{name} is needed by {users}")
        del self.objects[name], self.needs[name]

    def order(self) -> list[str]:
        missing = {n for v in self.needs.values() for n in v} - self.objects.keys()
        if missing:
            raise ValueError(f"not in the scope: {sorted(missing)}")
        return [n for n in TopologicalSorter(self.needs).static_order() if n not in self.inactive]


@contextmanager
def profiled(found: dict[str, float], name: str):
    start = time.perf_counter()
    try:
        yield
    finally:
        found[name] = found.get(name, 0.0) + time.perf_counter() - start


def profile_table(spark: SparkSession, found: dict[str, float]) -> DataFrame:
    """Seconds and share of each operator, longest first (AGG-19)."""
    total = sum(found.values()) or 1.0
    rows = [(k, v, v / total) for k, v in found.items()]
    return spark.createDataFrame(rows, "operator string, seconds double, share double").orderBy(F.desc("seconds"))


# --- functions of the user ------------------------------------------------------------------------------------


def check_units(result: str | Callable | None = None, **arguments: str):
    """Check a Python function's quantities against units by name (UDF-3)."""

    def wrap(fn):
        def call(*args, **kwargs):
            named = dict(zip(fn.__code__.co_varnames, args, strict=False)) | kwargs
            for name, unit in arguments.items():
                U.require(U.quantity(named[name]).dim, lang.dimension(unit, {}), f"argument {name}")
            out = fn(*args, **kwargs)
            if result is not None:
                want = result(*[U.quantity(a) for a in args]) if callable(result) else lang.dimension(result, {})
                U.require(U.quantity(out).dim, want, "result")
            return out

        return call

    return wrap


def vector_function(name: str, fn: Callable, returns: str = "double", arity: int = 1, stateless: bool = True) -> lang.Function:
    """A NumPy function as one of the language: Arrow batches in columns, as it is in kernels (UDF-1, UDF-2)."""
    import pandas as pd

    def batch(*series):
        return pd.Series(fn(*[s.to_numpy() for s in series]))

    udf = F.pandas_udf(batch, returns, F.PandasUDFType.SCALAR)
    return lang.register(lang.Function(name, udf if stateless else udf.asNondeterministic(), fn, lang._plain, arity, stateless))


# --- sweeps and export ----------------------------------------------------------------------------------------


def sweep(state: DataFrame, runs: list[dict[str, float]]) -> DataFrame:
    """One table for many runs: each row once a run, with the run's values and ``run_id`` (CTL-8). ``i`` stays the
    row's number within its run."""
    spark = state.sparkSession
    names = sorted({k for r in runs for k in r})
    rows = [(k, *[float(r[n]) if n in r else None for n in names]) for k, r in enumerate(runs)]
    given = spark.createDataFrame(rows, "run_id int" + "".join(f", `_{n}` double" for n in names))
    packed = F.array(*[F.struct(*[F.lit(v).cast(t).alias(c) for v, (c, t) in zip(row, given.dtypes, strict=True)]) for row in rows])
    out = state.withColumn("_run", F.explode(packed))
    new = {n: F.coalesce(F.col(f"_run._{n}"), F.col(n)).cast(dict(state.dtypes)[n]) for n in names}
    return out.withColumns(new).withColumn("run_id", F.col("_run.run_id")).drop("_run")


def exported(group, pathways=(), dt: float = 1e-4) -> str:
    """A group's compiled plan as canonical JSON (SNK-12): the same definition gives the same text."""
    from ..operators.network import Kernel

    kernel = Kernel.of(group, dt)
    note = {k: sorted(v) if isinstance(v, frozenset) else v for k, v in vars(kernel).items()}
    note["pathways"] = [vars(p) for p in pathways]
    return json.dumps(note, sort_keys=True, separators=(",", ":"))


def imported(text: str):
    """The kernel of an exported plan (SRC-17)."""
    from ..operators.network import Kernel

    note = json.loads(text)
    note.pop("pathways")
    note["frozen"] = frozenset(note["frozen"])
    for name in ("step", "reset"):
        note[name] = [tuple(x) for x in note[name]]
    note["record"] = tuple(note["record"])
    return Kernel(**note)


def issues(group, pathways=()) -> list[str]:
    """Everything that keeps a group from running, all at once (CNV-7)."""
    found = []
    for what in (lambda: group.equations.check(group.namespace), lambda: group.plan(1e-4)):
        try:
            what()
        except ValueError as err:
            found.append(str(err))
    known = set(group.stored) | {e.name for e in group.equations.of("sub").values()}
    for p in pathways:
        if p.target not in known:
            found.append(str(lang.unknown(p.target, known)))
    for code in filter(None, (group.reset,)):
        for s in lang.statements(code):
            if s.target not in group.stored:
                found.append(str(lang.unknown(s.target, group.stored)))
    return found
