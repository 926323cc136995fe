"""Equations: the schema and dynamics of a table, declared line by line.

``dx/dt = expr : unit (flags)`` is a state that evolves, ``x = expr : unit (flags)`` a view column, and
``x : unit (flags)`` a stored column. A unit is ``1``, ``boolean``, ``integer`` or an expression of units.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from ..functions import lang
from ..functions import units as U

LINE = re.compile(r"^(?:d(?P<ode>\w+)/dt\s*=\s*(?P<f>[^:]+)|(?P<sub>\w+)\s*=\s*(?P<e>[^:]+)|(?P<par>\w+))\s*:\s*(?P<unit>[^()]*?)\s*(?:\((?P<flags>[^()]*)\))?$")
TYPES = {"1": "double", "boolean": "boolean", "integer": "int"}
FLAGS = {
    "ode": {"unless refractory", "event-driven", "clock-driven"},
    "sub": {"shared", "constant over dt", "summed"},
    "par": {"constant", "shared", "linked"},
}
#: Names that an equation can't define.
RESERVED = {"t", "dt", "i", "j", "N", "xi"}


class EquationError(ValueError):
    """A line that is no equation, or equations that don't fit together."""


@dataclass(frozen=True)
class Equation:
    name: str
    kind: str
    unit: str
    expr: ast.expr | None = None
    flags: frozenset[str] = frozenset()

    @property
    def dim(self) -> U.Dim:
        return U.NONE if self.unit in TYPES else lang.dimension(self.unit, {})

    @property
    def sql_type(self) -> str:
        return TYPES.get(self.unit, "double")

    def __str__(self) -> str:
        left = f"d{self.name}/dt" if self.kind == "ode" else self.name
        right = f" = {ast.unparse(self.expr)}" if self.expr is not None else ""
        flags = f" ({', '.join(sorted(self.flags))})" if self.flags else ""
        return f"{left}{right} : {self.unit}{flags}"


@dataclass
class Equations:
    items: dict[str, Equation] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> Equations:
        items: dict[str, Equation] = {}
        issues = []
        # a line that ends within an expression goes on in the next
        for line in re.sub(r"\\\n", " ", text).splitlines():
            line = line.split("#")[0].strip()
            if not line:
                continue
            m = LINE.match(line)
            if not m:
                issues.append(f"not an equation: {line!r}")
                continue
            kind = next(k for k in ("ode", "sub", "par") if m[k])
            name, body = m[kind], m["f"] or m["e"]
            flags = frozenset(x.strip() for x in (m["flags"] or "").split(",") if x.strip())
            if bad := flags - FLAGS[kind]:
                issues.append(f"{name}: flags {sorted(bad)} are not for this kind")
            if name in RESERVED or name in items:
                issues.append(f"{name} is already taken")
            if kind == "ode" and (m["unit"] in ("boolean", "integer")):
                issues.append(f"{name}: only real variables evolve")
            try:
                items[name] = Equation(name, kind, m["unit"], lang.parse(body) if body else None, flags)
            except lang.LanguageError as err:
                issues.append(str(err))
        if issues:
            raise EquationError("; ".join(issues))
        return cls(items)

    def __add__(self, other: Equations | str) -> Equations:
        other = Equations.parse(other) if isinstance(other, str) else other
        if both := self.items.keys() & other.items.keys():
            raise EquationError(f"defined twice: {sorted(both)}")
        return Equations(self.items | other.items)

    def renamed(self, by: dict[str, str | float]) -> Equations:
        """With names replaced by other names, or by numbers in expressions."""
        trees = {k: lang.parse(str(v)) for k, v in by.items()}
        out = {}
        for e in self.items.values():
            name = by.get(e.name, e.name)
            if not isinstance(name, str):
                raise EquationError(f"{e.name} can't become a number")
            out[name] = Equation(name, e.kind, e.unit, None if e.expr is None else lang.substitute(e.expr, trees), e.flags)
        return Equations(out)

    def of(self, kind: str) -> dict[str, Equation]:
        return {k: e for k, e in self.items.items() if e.kind == kind}

    def ordered_views(self) -> list[Equation]:
        """View columns so that each follows those it needs."""
        views = self.of("sub")
        try:
            order = TopologicalSorter({k: lang.names(e.expr) & views.keys() for k, e in views.items()}).static_order()
            return [views[k] for k in order]
        except CycleError as err:
            raise EquationError(f"views that need each other: {err.args[1]}") from err

    def resolved(self, tree: str | ast.expr) -> ast.expr:
        """An expression with view columns put in, but for those that hold a value of their own during a tick."""
        tree = lang.parse(tree)
        for e in reversed(self.ordered_views()):
            if not e.flags & {"summed", "constant over dt"}:
                tree = lang.substitute(tree, {e.name: e.expr})
        return tree

    def held(self) -> list[tuple[str, ast.expr]]:
        """Views that are taken once a tick, before anything else (PRJ-3), in an order in which each finds the others."""
        return [(e.name, self.resolved(e.expr)) for e in self.ordered_views() if "constant over dt" in e.flags]

    def rates(self) -> dict[str, ast.expr]:
        """The right sides of the evolving states, views put in; frozen ones are zero while refractory."""
        out = {}
        for e in self.of("ode").values():
            tree = self.resolved(e.expr)
            out[e.name] = lang.parse(f"int(not_refractory) * ({ast.unparse(tree)})") if "unless refractory" in e.flags else tree
        return out

    def check(self, namespace: dict) -> None:
        """Every equation's dimensions; all issues are named at once."""
        known = {k: e.dim for k, e in self.items.items()}
        second = U.UNITS["second"].dim
        noise = {n: U.power(second, -0.5) for e in self.items.values() if e.expr is not None for n in lang.names(e.expr) if n.startswith("xi_")}
        extra = noise | {"t": second, "dt": second, "i": U.NONE, "j": U.NONE, "N": U.NONE, "lastspike": second, "not_refractory": U.NONE, "xi": U.power(second, -0.5)}
        dims = {k: U.quantity(v).dim for k, v in namespace.items() if isinstance(v, (int, float, U.Quantity))}
        issues = []
        for e in self.items.values():
            if e.expr is None:
                continue
            try:
                found = lang.dimension(e.expr, {**dims, **extra, **known})
                U.require(found, U.times(e.dim, second, -1) if e.kind == "ode" else e.dim, str(e))
            except (U.DimensionError, lang.LanguageError) as err:
                issues.append(str(err))
        if issues:
            raise EquationError("; ".join(issues))

    def __str__(self) -> str:
        return "\n".join(map(str, self.items.values()))
