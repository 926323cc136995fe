"""Numerical integration: from equations to a list of statements that advance every row by one step.

A method turns right sides ``f`` (and noise factors ``g``, the coefficients of ``xi``) into assignments, first of
temporaries, then of the new states; whatever runs them, columns or arrays, is not its concern.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from typing import NamedTuple

import numpy as np

from ..functions import lang
from .equations import Equations

Step = list[tuple[str, ast.expr]]


class UnsupportedEquations(ValueError):
    """A method can't integrate these equations."""


def text(tree: ast.expr) -> str:
    return f"({ast.unparse(tree)})"


def simple(tree: ast.expr) -> ast.expr:
    """Zeros and ones taken out of sums and products."""

    class Fold(ast.NodeTransformer):
        def visit_BinOp(self, n: ast.BinOp) -> ast.AST:
            self.generic_visit(n)
            zero = lambda x: isinstance(x, ast.Constant) and x.value == 0
            one = lambda x: isinstance(x, ast.Constant) and x.value == 1
            match n.op:
                case ast.Add():
                    return n.right if zero(n.left) else n.left if zero(n.right) else n
                case ast.Sub():
                    return n.left if zero(n.right) else n
                case ast.Mult():
                    if zero(n.left) or zero(n.right):
                        return ast.Constant(0)
                    return n.right if one(n.left) else n.left if one(n.right) else n
                case ast.Div():
                    return ast.Constant(0) if zero(n.left) else n.left if one(n.right) else n
            return n

    return Fold().visit(ast.parse(ast.unparse(tree), mode="eval").body)


def linear_in(tree: ast.expr, variables: set[str]) -> tuple[dict[str, ast.expr], ast.expr]:
    """Coefficients of the variables and the rest, if the expression is linear in them."""
    e = lambda s: lang.parse(s)
    if not lang.names(tree) & variables:
        return {}, tree
    match tree:
        case ast.Name(id=name):
            return {name: ast.Constant(1)}, ast.Constant(0)
        case ast.UnaryOp(op=ast.USub(), operand=a):
            c, b = linear_in(a, variables)
            return {k: e(f"-{text(v)}") for k, v in c.items()}, e(f"-{text(b)}")
        case ast.BinOp(left=a, op=ast.Add() | ast.Sub() as op, right=b):
            sign = "+" if isinstance(op, ast.Add) else "-"
            (ca, ra), (cb, rb) = linear_in(a, variables), linear_in(b, variables)
            zero = ast.Constant(0)
            both = {k: simple(e(f"{text(ca.get(k, zero))} {sign} {text(cb.get(k, zero))}")) for k in ca.keys() | cb.keys()}
            return both, simple(e(f"{text(ra)} {sign} {text(rb)}"))
        case ast.BinOp(left=a, op=ast.Mult(), right=b):
            if lang.names(a) & variables and lang.names(b) & variables:
                raise UnsupportedEquations(f"not linear: {ast.unparse(tree)}")
            inner, factor = (a, b) if lang.names(a) & variables else (b, a)
            c, r = linear_in(inner, variables)
            return {k: simple(e(f"{text(v)} * {text(factor)}")) for k, v in c.items()}, simple(e(f"{text(r)} * {text(factor)}"))
        case ast.BinOp(left=a, op=ast.Div(), right=b) if not lang.names(b) & variables:
            c, r = linear_in(a, variables)
            return {k: simple(e(f"{text(v)} / {text(b)}")) for k, v in c.items()}, simple(e(f"{text(r)} / {text(b)}"))
    raise UnsupportedEquations(f"not linear: {ast.unparse(tree)}")


def noises(tree: ast.expr) -> set[str]:
    """Names of white noise in an expression: ``xi``, or ``xi_`` and a name; different names are independent."""
    return {n for n in lang.names(tree) if n == "xi" or n.startswith("xi_")}


def noise(rates: dict[str, ast.expr]) -> tuple[dict[str, ast.expr], dict[str, dict[str, ast.expr]]]:
    """Right sides without noise, and in each the factor of every noise by the name of its draw over the step: ``_dW``
    for ``xi``, ``_dW_a`` for ``xi_a``."""
    f, g = {}, {}
    for name, tree in rates.items():
        found = noises(tree)
        c, f[name] = linear_in(tree, found) if found else ({}, tree)
        g[name] = {f"_dW{n[2:]}": c[n] for n in sorted(found)}
    return f, g


def kick(factors: dict[str, ast.expr]) -> str:
    """What the noise adds, as text."""
    return " + ".join(f"{text(tree)} * {dw}" for dw, tree in factors.items()) or "0"


def is_zero(tree: ast.expr) -> bool:
    return isinstance(tree, ast.Constant) and tree.value == 0


def deterministic(rates: dict[str, ast.expr]) -> dict[str, ast.expr]:
    if any(noises(t) for t in rates.values()):
        raise UnsupportedEquations("the method doesn't take noise")
    return rates


def moved(tree: ast.expr, by: dict[str, str], dt: str | None = None) -> ast.expr:
    """The expression at other values of the states, and of t where a shift of it is given."""
    at = {k: lang.parse(v) for k, v in by.items()}
    if dt:
        at["t"] = lang.parse(f"t + {dt}")
    return lang.substitute(tree, at)


def finish(names) -> Step:
    """All states take their new values at once."""
    return [(x, lang.parse(f"_new_{x}")) for x in names]


def euler(rates: dict[str, ast.expr]) -> Step:
    f, g = noise(rates)
    for x, factors in g.items():
        if any(lang.names(tree) & rates.keys() for tree in factors.values()):
            raise UnsupportedEquations(f"noise of {x} depends on the states")
    out = []
    for x in rates:
        more = f" + {kick(g[x])}" if g[x] else ""
        out.append((f"_new_{x}", lang.parse(f"{x} + dt * {text(f[x])}{more}")))
    return out + finish(rates)


def runge_kutta(stages: list[tuple[float, list[float]]], weights: list[float]) -> Callable[[dict[str, ast.expr]], Step]:
    """An explicit scheme from its tableau: per stage the shift of t and the weights of the stages before."""

    def method(rates: dict[str, ast.expr]) -> Step:
        deterministic(rates)
        out: Step = []
        for s, (c, a) in enumerate(stages):
            at = {
                x: "(" + " + ".join([x, *(f"{w!r} * dt * _k{r}_{x}" for r, w in enumerate(a) if w)]) + ")" for x in rates
            }
            out += [(f"_k{s}_{x}", moved(tree, at, f"{c!r} * dt" if c else None)) for x, tree in rates.items()]
        for x in rates:
            total = " + ".join(f"{w!r} * _k{s}_{x}" for s, w in enumerate(weights) if w)
            out.append((f"_new_{x}", lang.parse(f"{x} + dt * ({total})")))
        return out + finish(rates)

    return method


#: Midpoint rule and the classical fourth-order scheme; fixed values.
rk2 = runge_kutta([(0.0, []), (0.5, [0.5])], [0.0, 1.0])
rk4 = runge_kutta([(0.0, []), (0.5, [0.5]), (0.5, [0.0, 0.5]), (1.0, [0.0, 0.0, 1.0])], [1 / 6, 1 / 3, 1 / 3, 1 / 6])


def heun(rates: dict[str, ast.expr]) -> Step:
    """Predictor and corrector, for noise in Stratonovich's sense."""
    f, g = noise(rates)
    out: Step = []
    for x in rates:
        out.append((f"_p_{x}", lang.parse(f"{x} + dt * {text(f[x])} + {kick(g[x])}")))
    ahead = {x: f"_p_{x}" for x in rates}
    for x in rates:
        f2, g2 = moved(f[x], ahead, "dt"), {dw: moved(tree, ahead, "dt") for dw, tree in g[x].items()}
        out.append((f"_new_{x}", lang.parse(f"{x} + dt * 0.5 * ({text(f[x])} + {text(f2)}) + 0.5 * ({kick(g[x])} + {kick(g2)})")))
    return out + finish(rates)


def milstein(rates: dict[str, ast.expr]) -> Step:
    """For one noise a state that depends on this state alone; the derivative of its factor is taken by a small
    difference along the factor itself, which is exact for linear factors up to rounding."""
    f, g = noise(rates)
    out: Step = []
    for x in rates:
        if len(g[x]) > 1:
            raise UnsupportedEquations(f"{x} has several noises")
        more = ""
        for dw, tree in g[x].items():
            if lang.names(tree) & rates.keys() - {x}:
                raise UnsupportedEquations(f"noise of {x} depends on other states")
            shifted = moved(tree, {x: f"({x} + {text(tree)} * dt ** 0.5)"})
            more = f" + {kick(g[x])} + 0.5 * ({text(shifted)} - {text(tree)}) / dt ** 0.5 * ({dw} ** 2 - dt)"
        out.append((f"_new_{x}", lang.parse(f"{x} + dt * {text(f[x])}{more}")))
    return out + finish(rates)


def exponential_euler(rates: dict[str, ast.expr]) -> Step:
    """Each right side must be linear in its own state; all else is held during the step."""
    deterministic(rates)
    out: Step = []
    for x, tree in rates.items():
        c, rest = linear_in(tree, {x})
        a = text(c.get(x, ast.Constant(0)))
        out.append((f"_new_{x}", lang.parse(f"{x} * exp({a} * dt) + {text(rest)} * dt * exprel({a} * dt)")))
    return out + finish(rates)


def expm(a: np.ndarray) -> np.ndarray:
    """Matrix exponential by scaling, a Taylor sum and squaring."""
    n = max(0, int(np.ceil(np.log2(max(1e-300, np.abs(a).sum(axis=1).max())))) + 6)
    x = a / 2.0**n
    out, term = np.eye(len(a)), np.eye(len(a))
    for k in range(1, 19):
        term = term @ x / k
        out = out + term
    for _ in range(n):
        out = out @ out
    return out


def exact(rates: dict[str, ast.expr], namespace: dict | None = None, dt: float | None = None) -> Step:
    """Linear systems. States that depend on themselves alone have a closed form with any constant coefficients;
    coupled ones need numbers for theirs, and for dt, and get a matrix exponential taken on the driver."""
    deterministic(rates)
    states = set(rates)
    rows = {x: linear_in(tree, states) for x, tree in rates.items()}
    if any("t" in lang.names(t) for c, b in rows.values() for t in (*c.values(), b)):
        raise UnsupportedEquations("coefficients depend on time")
    if all(set(c) <= {x} for x, (c, _) in rows.items()):
        return exponential_euler(rates)
    if dt is None:
        raise UnsupportedEquations("coupled equations need the step to be known")
    order = list(rates)
    n = len(order)
    full = np.zeros((2 * n, 2 * n))
    try:
        for r, x in enumerate(order):
            for c, y in enumerate(order):
                full[r, c] = float(lang.array(rows[x][0].get(y, ast.Constant(0)), namespace or {}))
    except lang.LanguageError as err:
        raise UnsupportedEquations(f"coefficients aren't numbers: {err}") from err
    # d(x, b)/dt = (A x + b, 0) gives the factor of the constant part too
    full[:n, n:] = np.eye(n)
    solved = expm(full * dt)[:n]
    out: Step = []
    for r, x in enumerate(order):
        terms = [f"{solved[r, c].item()!r} * {y}" for c, y in enumerate(order) if solved[r, c]]
        terms += [f"{solved[r, n + c].item()!r} * {text(rows[y][1])}" for c, y in enumerate(order) if solved[r, n + c] and not is_zero(rows[y][1])]
        out.append((f"_new_{x}", lang.parse(" + ".join(terms) or "0.0")))
    return out + finish(rates)


def independent(rates: dict[str, ast.expr]) -> Step:
    """Exact, for states none of which depends on another one."""
    for x, tree in rates.items():
        if lang.names(tree) & rates.keys() - {x}:
            raise UnsupportedEquations(f"{x} depends on other states")
    return exact(rates)


METHODS: dict[str, Callable[..., Step]] = {}


def register(name: str, method: Callable[..., Step]) -> None:
    if name in METHODS:
        raise ValueError(f"method {name} exists")
    METHODS[name] = method


for _name, _method in (
    ("exact", exact), ("linear", exact), ("independent", independent), ("exponential_euler", exponential_euler), ("euler", euler), ("rk2", rk2),
    ("rk4", rk4), ("heun", heun), ("milstein", milstein),
):
    register(_name, _method)


def explicit(description: str) -> Callable[..., Step]:
    """A user's own explicit scheme (INT-9): lines ``name = expression`` of x, t, dt, dW, f(x, t), g(x, t) and names
    before, and last ``x_new = ...``, for all states alike. g is the factor of the noise; schemes that have dW take
    one noise a state."""
    lines = lang.statements(re.sub(r"[ \t]*\n[ \t]*", "\n", description.strip()), calls=("f", "g"))
    if not lines or lines[-1].target != "x_new":
        raise ValueError("the last line must give x_new")

    def method(rates: dict[str, ast.expr]) -> Step:
        fs, gs = noise(rates)
        if any(len(x) > 1 for x in gs.values()):
            raise UnsupportedEquations("several noises")
        if any(gs.values()) and "dW" not in lang.names(lines[-1].value):
            raise UnsupportedEquations("the scheme doesn't take noise")
        out: Step = []

        def put(tree: ast.expr, x: str) -> ast.expr:
            class Put(ast.NodeTransformer):
                def visit_Call(self, node: ast.Call) -> ast.AST:
                    if node.func.id not in ("f", "g"):
                        return self.generic_visit(node)
                    at, time = node.args
                    own = fs[x] if node.func.id == "f" else next(iter(gs[x].values()), ast.Constant(0))
                    by = {y: put(at, y) for y in rates} | {"t": put(time, x)}
                    return lang.substitute(own, by)

                def visit_Name(self, node: ast.Name) -> ast.AST:
                    known = {"x": x, "dW": next(iter(gs[x]), "_dW")}
                    return ast.Name(known.get(node.id, f"_{node.id}_{x}" if node.id in names else node.id), ast.Load())

            return Put().visit(ast.parse(ast.unparse(tree), mode="eval").body)

        names: set[str] = set()
        for line in lines:
            out += [(f"_new_{x}" if line.target == "x_new" else f"_{line.target}_{x}", put(line.value, x)) for x in rates]
            names.add(line.target)
        return out + finish(rates)

    return method


def step(eqs: Equations, method: str | tuple[str, ...] = ("exact", "euler", "heun"), namespace: dict | None = None, dt: float | None = None) -> tuple[str, Step]:
    """The first method that takes the equations, and its statements."""
    rates, refused = eqs.rates(), []
    if not rates:
        return "none", []
    drawn = {x for x, tree in rates.items() if lang.draws(tree)}
    for name in (method,) if isinstance(method, str) else method:
        if name not in METHODS:
            raise ValueError(f"unknown method {name!r}; known: {sorted(METHODS)}")
        if drawn and name != "euler":
            refused.append(f"{name}: takes right sides more than once, and those of {sorted(drawn)} draw")
            continue
        try:
            own = METHODS[name]
            return name, own(rates, namespace, dt) if own is exact else own(rates)
        except UnsupportedEquations as err:
            refused.append(f"{name}: {err}")
    raise UnsupportedEquations("; ".join(refused))


class Scheme(NamedTuple):
    """An embedded scheme: per stage the weights of the stages before, the stages' times, the weights of the solution
    that is compared and of the one that is kept, and the power of the error that a substep's size follows."""

    stages: tuple[tuple[float, ...], ...]
    shifts: tuple[float, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    power: float


#: Fehlberg's fourth and fifth order; fixed values.
FEHLBERG = Scheme(
    ((), (1 / 4,), (3 / 32, 9 / 32), (1932 / 2197, -7200 / 2197, 7296 / 2197), (439 / 216, -8.0, 3680 / 513, -845 / 4104),
     (-8 / 27, 2.0, -3544 / 2565, 1859 / 4104, -11 / 40)),
    (0.0, 1 / 4, 3 / 8, 12 / 13, 1.0, 1 / 2),
    (25 / 216, 0.0, 1408 / 2565, 2197 / 4104, -1 / 5, 0.0),
    (16 / 135, 0.0, 6656 / 12825, 28561 / 56430, -9 / 50, 2 / 55),
    1 / 5,
)
#: Cash's and Karp's fourth and fifth order; fixed values.
CASH_KARP = Scheme(
    ((), (1 / 5,), (3 / 40, 9 / 40), (3 / 10, -9 / 10, 6 / 5), (-11 / 54, 5 / 2, -70 / 27, 35 / 27),
     (1631 / 55296, 175 / 512, 575 / 13824, 44275 / 110592, 253 / 4096)),
    (0.0, 1 / 5, 3 / 10, 3 / 5, 1.0, 7 / 8),
    (2825 / 27648, 0.0, 18575 / 48384, 13525 / 55296, 277 / 14336, 1 / 4),
    (37 / 378, 0.0, 250 / 621, 125 / 594, 0.0, 512 / 1771),
    1 / 5,
)
#: The midpoint rule within Kutta's third order; fixed values.
MIDPOINT = Scheme(((), (1 / 2,), (-1.0, 2.0)), (0.0, 1 / 2, 1.0), (0.0, 1.0, 0.0), (1 / 6, 2 / 3, 1 / 6), 1 / 3)


def halved(stages: list[tuple[float, list[float]]], weights: list[float], order: int) -> Scheme:
    """One step of an explicit scheme held against two of half its size, as one tableau whose first stage both share."""
    n = len(weights)
    rows, times = [tuple(a) for _, a in stages], [c for c, _ in stages]
    half = lambda ws: [w / 2 for w in ws]
    # the first half takes the stages 0 and n to 2 * n - 2, the second one those behind
    spread = lambda ws: [ws[0], *[0.0] * (n - 1), *ws[1:]]
    rows += [tuple(spread(half(a))) for _, a in stages[1:]]
    times += [c / 2 for c, _ in stages[1:]]
    before = spread(half(weights))
    rows += [(*before, *half(a)) for _, a in stages]
    times += [0.5 + c / 2 for c, _ in stages]
    low, high = [*weights, *[0.0] * (2 * n - 1)], [*before, *half(weights)]
    return Scheme(tuple(rows), tuple(times), tuple(low), tuple(high), 1 / (order + 1))


#: Methods that take substeps of their own size, by name; they run in kernels only.
ADAPTIVE: dict[str, Scheme] = {
    "gsl": FEHLBERG, "gsl_rkf45": FEHLBERG, "gsl_rkck": CASH_KARP, "gsl_rk2": MIDPOINT,
    "gsl_rk4": halved([(0.0, []), (0.5, [0.5]), (0.5, [0.0, 0.5]), (1.0, [0.0, 0.0, 1.0])], [1 / 6, 1 / 3, 1 / 3, 1 / 6], 4),
}


def right_sides(rates: dict[str, ast.expr]) -> Step:
    """For an adaptive method a step is its right sides, which a kernel takes as often as the error asks for."""
    return [(f"_rate_{x}", tree) for x, tree in deterministic(rates).items()]


for _name in ADAPTIVE:
    register(_name, right_sides)


def adaptive(rates: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], x: np.ndarray, t: float, dt: float, tolerance: float = 1e-6, most: int = 10_000, scheme: Scheme = FEHLBERG) -> np.ndarray:
    """One step of dt for all rows (the last axis), each with substeps of its own that hold the error. ``rates`` takes
    states, times and the places of the rows that they are of."""
    stages, shifts, low, high, power = scheme
    now, size = np.full(x.shape[-1], t), np.full(x.shape[-1], dt)
    for _ in range(most):
        left = t + dt - now
        open_ = np.flatnonzero(left > 1e-12 * abs(dt))
        if not len(open_):
            return x
        h = np.minimum(size[open_], left[open_])
        y, ks = x[..., open_], []
        for a, c in zip(stages, shifts, strict=True):
            at = y + h * sum((w * k for w, k in zip(a, ks, strict=True)), np.zeros_like(y))
            ks.append(rates(at, now[open_] + c * h, open_))
        worse, better = (y + h * sum(w * k for w, k in zip(ws, ks, strict=True)) for ws in (low, high))
        error = np.abs(better - worse).reshape(-1, len(open_)).max(axis=0)
        good = error <= tolerance
        done = open_[good]
        x[..., done], now[done] = better[..., good], now[done] + h[good]
        size[open_] = h * np.clip(0.9 * (tolerance / np.maximum(error, 1e-300)) ** power, 0.2, 5.0)
    raise RuntimeError("too many substeps")
