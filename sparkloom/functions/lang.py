"""The expression language: Python-like expressions that become Spark columns, NumPy arrays or dimensions.

One parser checks the syntax; three walkers give meaning. Columns follow IEEE arithmetic, as NumPy does, where SQL
would raise an error or give null: division by zero, logarithms outside their domain, comparisons with NaN; the
remainder and the whole quotient follow the divisor's sign.
"""

from __future__ import annotations

import ast
import difflib
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import units as U

INF, NAN = float("inf"), float("nan")


class LanguageError(ValueError):
    """An expression that the language doesn't have, or a name nobody knows."""


# --- IEEE helpers ---------------------------------------------------------------------------------------------


def ieee_div(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b != 0, a / F.when(b != 0, b)).when(b == 0, by_zero)


def floor_div(a: Column, b: Column) -> Column:
    """The whole quotient as a double: NaN or an infinity where a double's would be."""
    x = ieee_div(a, b)
    whole = F.when(F.abs(x) < 2.0**53, F.floor(F.when(F.abs(x) < 2.0**53, x)).cast("double"))
    return F.when(F.isnan(x) | (b.cast("double") == 0) & (a.cast("double") == 0), F.lit(NAN)).otherwise(F.coalesce(whole, x))


def py_mod(a: Column, b: Column) -> Column:
    """The remainder with the divisor's sign; NaN by zero."""
    by = F.when(b != 0, b)
    return F.when(b == 0, F.lit(NAN)).otherwise(((a % by) + by) % by)


def whole(x: Column) -> Column:
    """As a 32-bit integer; what has none (NaN, infinities, larger numbers) is the smallest one, as in arrays."""
    x = x.cast("double")
    return F.when(F.abs(x) < 2.0**31, F.when(F.abs(x) < 2.0**31, x).cast("int")).otherwise(F.lit(-(2**31)).cast("int"))


def lesser(*xs: Column) -> Column:
    """The least; NaN if any is."""
    return F.when(_any_nan(xs), F.lit(NAN)).otherwise(F.least(*xs))


def greater(*xs: Column) -> Column:
    return F.when(_any_nan(xs), F.lit(NAN)).otherwise(F.greatest(*xs))


def _any_nan(xs) -> Column:
    out = F.lit(False)
    for x in xs:
        out = out | F.isnan(x.cast("double"))
    return out


def safe_log(x: Column, fn: Callable[[Column], Column] = F.log, zero: float = 0.0) -> Column:
    """A logarithm with -inf at the edge of its domain (``zero``) and NaN beyond it."""
    x = x.cast("double")
    return F.when(x > zero, fn(x)).when(x == zero, F.lit(-INF)).when(x < zero, F.lit(NAN))


def exprel(x: Column) -> Column:
    x = x.cast("double")
    return F.when(x == 0, F.lit(1.0)).otherwise(F.expm1(x) / F.when(x != 0, x))


def timestep(t: Column, dt: Column) -> Column:
    """The tick of a time: shifted a little against rounding, then truncated."""
    return ((t + 1e-3 * dt) / dt).cast("bigint")


def compare(op: str, a: Column, b: Column) -> Column:
    """Comparisons that are false with NaN, and != that is true."""
    number = ~(F.isnan(a.cast("double")) | F.isnan(b.cast("double")))
    if op == "!=":
        return (a != b) | ~number
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "==": a == b}[op] & number


# --- Functions ------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Function:
    """A function of the language: as a column expression, as NumPy, and what it does to dimensions."""

    name: str
    column: Callable[..., Column] | None
    numpy: Callable[..., Any] | None
    dims: Callable[..., U.Dim]
    arity: int = 1
    stateless: bool = True
    #: Given dt, whether the value is constant within a step (UDF-6).
    locally_constant: bool = False
    #: A text to put in place of a call, with the names of its parameters (UDF-5).
    inline: tuple[tuple[str, ...], str] | None = None


def _plain(*dims: U.Dim) -> U.Dim:
    for d in dims:
        U.require(d, U.NONE, "a function of plain numbers")
    return U.NONE


def _same(*dims: U.Dim) -> U.Dim:
    for d in dims[1:]:
        U.require(dims[0], d, "arguments")
    return dims[0]


def _int32(x):
    x = np.asarray(x, float)
    fits = np.abs(x) < 2.0**31
    return np.where(fits, np.where(fits, x, 0), -(2.0**31)).astype(np.int32)


FUNCTIONS: dict[str, Function] = {}


def register(function: Function) -> Function:
    FUNCTIONS[function.name] = function
    return function


for _n, _c, _f in (
    ("sin", F.sin, np.sin), ("cos", F.cos, np.cos), ("tan", F.tan, np.tan), ("sinh", F.sinh, np.sinh),
    ("cosh", F.cosh, np.cosh), ("tanh", F.tanh, np.tanh), ("arcsin", F.asin, np.arcsin), ("arccos", F.acos, np.arccos),
    ("arctan", F.atan, np.arctan), ("exp", F.exp, np.exp), ("expm1", F.expm1, np.expm1), ("log", safe_log, np.log),
    ("log10", lambda x: safe_log(x, F.log10), np.log10), ("log1p", lambda x: safe_log(x, F.log1p, -1.0), np.log1p),
    ("exprel", exprel, lambda x: np.where(np.asarray(x) == 0, 1.0, np.expm1(x) / np.where(np.asarray(x) == 0, 1, x))),
):
    register(Function(_n, _c, _f, _plain))
register(Function("sqrt", lambda x: F.when(x >= 0, F.sqrt(x)).when(x < 0, F.lit(NAN)), np.sqrt, lambda d: U.power(d, 0.5)))
register(Function("ceil", lambda x: whole(F.ceil(F.when(F.abs(x) < 2.0**31, x))), lambda x: _int32(np.ceil(x)), _plain))
register(Function("floor", lambda x: whole(F.floor(F.when(F.abs(x) < 2.0**31, x))), lambda x: _int32(np.floor(x)), _plain))
register(Function("int", whole, _int32, _plain))
register(Function("abs", F.abs, np.abs, lambda d: d))
register(Function("sign", F.signum, np.sign, lambda d: U.NONE))
register(Function("clip", lambda x, a, b: lesser(greater(x, a), b), np.clip, _same, 3))
register(Function("minimum", lesser, np.minimum, _same, 2))
register(Function("maximum", greater, np.maximum, _same, 2))
register(Function("timestep", timestep, lambda t, dt: ((np.asarray(t) + 1e-3 * dt) / dt).astype(np.int64), lambda a, b: _same(a, b) and U.NONE, 2))
register(Function("where", lambda c, a, b: F.when(c, a).otherwise(b), np.where, lambda c, a, b: _same(a, b), 3))
# drawn by the counter generator of functions.rng, bound in the namespace of a step
register(Function("rand", None, None, lambda: U.NONE, 0, stateless=False))
register(Function("randn", None, None, lambda: U.NONE, 0, stateless=False))
register(Function("poisson", None, None, _plain, 1, stateless=False))


def inline_function(name: str, params: tuple[str, ...], body: str, dims: Callable[..., U.Dim] = _plain) -> Function:
    """A function given by an expression of its parameters; calls are replaced by it before anything else."""
    parse(body)
    return register(Function(name, None, None, dims, len(params), inline=(params, body)))


# --- Parser ---------------------------------------------------------------------------------------------------

ALLOWED = (
    ast.Expression, ast.BinOp, ast.UnaryOp, ast.BoolOp, ast.Compare, ast.Call, ast.Name, ast.Constant, ast.Load,
    ast.Add, ast.Sub, ast.Mult, ast.Div, ast.FloorDiv, ast.Mod, ast.Pow, ast.USub, ast.UAdd, ast.Not, ast.And, ast.Or,
    ast.Lt, ast.LtE, ast.Gt, ast.GtE, ast.Eq, ast.NotEq,
)
COMPARE = {ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Eq: "==", ast.NotEq: "!="}


class _Inline(ast.NodeTransformer):
    def visit_Call(self, node: ast.Call) -> ast.AST:
        self.generic_visit(node)
        fn = FUNCTIONS.get(node.func.id) if isinstance(node.func, ast.Name) else None
        if fn and fn.inline:
            params, body = fn.inline
            return substitute(parse(body), dict(zip(params, node.args, strict=True)))
        return node


def parse(text: str | ast.expr) -> ast.expr:
    """The expression as a tree of what the language has; calls of inline functions are replaced."""
    if isinstance(text, ast.expr):
        return text
    try:
        tree = ast.parse(" ".join(text.split()), mode="eval")
    except SyntaxError as err:
        raise LanguageError(f"not an expression: {text!r}") from err
    for node in ast.walk(tree):
        if not isinstance(node, ALLOWED):
            raise LanguageError(f"{type(node).__name__} is not allowed in {text!r}")
        if isinstance(node, ast.Constant) and not isinstance(node.value, (bool, int, float)):
            raise LanguageError(f"only numbers are allowed in {text!r}")
        if isinstance(node, ast.Call) and (not isinstance(node.func, ast.Name) or node.keywords):
            raise LanguageError(f"only plain calls are allowed in {text!r}")
    return _Inline().visit(tree.body)


class _Numbered(ast.NodeTransformer):
    def __init__(self, site: str):
        self.site, self.n = site, 0

    def visit_Call(self, node: ast.Call) -> ast.AST:
        self.generic_visit(node)
        if node.func.id not in DRAWS:
            return node
        self.n += 1
        name = f"_{node.func.id}_{self.site}_{self.n}"
        return ast.Call(ast.Name(name, ast.Load()), node.args, []) if node.args else ast.Name(name, ast.Load())


#: Functions that draw.
DRAWS = ("rand", "randn", "poisson")


def numbered(tree: str | ast.expr, site: str) -> ast.expr:
    """With every call that draws under a name of its own, so that two calls in a tick don't share a draw (UDF-7)."""
    return _Numbered(site).visit(ast.parse(ast.unparse(parse(tree)), mode="eval").body)


def draws(tree: str | ast.expr) -> set[str]:
    """Functions with a state that an expression calls."""
    called = {n.func.id for n in ast.walk(parse(tree)) if isinstance(n, ast.Call)}
    return {c for c in called if c in FUNCTIONS and not FUNCTIONS[c].stateless}


def _drawn(name: str) -> tuple[str, str] | None:
    """What a numbered name draws, and its site."""
    kind, _, site = name[1:].partition("_")
    return (kind, site) if name.startswith("_") and kind in DRAWS and site else None


class _Substitute(ast.NodeTransformer):
    def __init__(self, by: Mapping[str, ast.expr]):
        self.by = by

    def visit_Name(self, node: ast.Name) -> ast.AST:
        return self.by.get(node.id, node)


def substitute(tree: ast.expr, by: Mapping[str, ast.expr]) -> ast.expr:
    return _Substitute(by).visit(ast.parse(ast.unparse(tree), mode="eval").body)


def names(tree: str | ast.expr) -> set[str]:
    """Names of variables (not of functions) in an expression."""
    tree = parse(tree)
    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    return {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and id(n) not in called}


def unknown(name: str, known) -> LanguageError:
    close = difflib.get_close_matches(name, list(known), 3)
    return LanguageError(f"unknown name {name!r}" + (f"; did you mean {', '.join(close)}?" if close else ""))


class Walker:
    """Evaluates a tree; subclasses say what the operations mean."""

    def __init__(self, namespace: Mapping[str, Any]):
        self.namespace = namespace

    def run(self, tree: str | ast.expr) -> Any:
        return self.visit(parse(tree))

    def visit(self, node: ast.expr) -> Any:
        match node:
            case ast.Constant(value=v):
                return self.constant(v)
            case ast.Name(id=name):
                return self.name(name)
            case ast.BinOp(left=a, op=op, right=b):
                return self.binary(op, self.visit(a), self.visit(b), b)
            case ast.UnaryOp(op=ast.Not(), operand=a):
                return self.negate(self.visit(a))
            case ast.UnaryOp(op=ast.USub(), operand=a):
                return self.minus(self.visit(a))
            case ast.UnaryOp(operand=a):
                return self.visit(a)
            case ast.BoolOp(op=op, values=values):
                return self.boolean(isinstance(op, ast.And), [self.visit(v) for v in values])
            case ast.Compare(left=a, ops=ops, comparators=rest):
                items = [self.visit(x) for x in (a, *rest)]
                found = [self.compare(COMPARE[type(o)], x, y) for o, x, y in zip(ops, items, items[1:], strict=False)]
                return found[0] if len(found) == 1 else self.boolean(True, found)
            case ast.Call(func=ast.Name(id=name), args=args):
                if drawn := _drawn(name):
                    return self.namespace[drawn[0]](drawn[1], *[self.visit(x) for x in args])
                if name not in FUNCTIONS and name not in self.namespace:
                    raise unknown(name, [*FUNCTIONS, *self.namespace])
                return self.call(name, [self.visit(x) for x in args])
        raise LanguageError(f"can't evaluate {ast.dump(node)}")

    def name(self, name: str) -> Any:
        if name in self.namespace:
            return self.namespace[name]
        if (drawn := _drawn(name)) and drawn[0] in self.namespace:
            return self.namespace[drawn[0]](drawn[1])
        for known in (U.CONSTANTS, U.UNITS):
            if name in known:
                return self.quantity(known[name])
        raise unknown(name, [*self.namespace, *U.CONSTANTS, *U.UNITS])

    def minus(self, a):
        return -a

    def call(self, name: str, args: list) -> Any:
        raise NotImplementedError


class ToColumn(Walker):
    """Expressions as Spark columns; numbers stay numbers until a column meets them."""

    def constant(self, v):
        return F.lit(v)

    def quantity(self, q: U.Quantity):
        return F.lit(q.value)

    def name(self, name: str):
        found = super().name(name)
        if isinstance(found, U.Quantity):
            return F.lit(found.value)
        return found if isinstance(found, Column) else F.lit(found)

    def binary(self, op, a, b, right):
        match op:
            case ast.Add():
                return a + b
            case ast.Sub():
                return a - b
            case ast.Mult():
                return a * b
            case ast.Div():
                sure = isinstance(right, ast.Constant) and right.value or isinstance(right, ast.Name) and (
                    right.id in U.UNITS and right.id not in self.namespace
                )
                return a.cast("double") / b.cast("double") if sure else ieee_div(a, b)
            case ast.FloorDiv():
                return floor_div(a, b)
            case ast.Mod():
                return py_mod(a, b)
            case ast.Pow():
                return F.pow(a, b)
        raise LanguageError(f"no operator {op}")

    def negate(self, a):
        return ~a

    def boolean(self, every: bool, values):
        out = values[0]
        for v in values[1:]:
            out = out & v if every else out | v
        return out

    def compare(self, op, a, b):
        return compare(op, a, b)

    def call(self, name, args):
        bound = self.namespace.get(name)
        if callable(bound) and not isinstance(bound, Column):
            return bound(*args)
        fn = FUNCTIONS.get(name)
        if fn is None or fn.column is None:
            raise LanguageError(f"{name} has no column form here")
        return fn.column(*args)


class ToNumpy(Walker):
    """Expressions over arrays."""

    def constant(self, v):
        return v

    def quantity(self, q):
        return q.value

    def name(self, name):
        found = super().name(name)
        return found.value if isinstance(found, U.Quantity) else found

    def binary(self, op, a, b, right):
        with np.errstate(all="ignore"):
            match op:
                case ast.Add():
                    return a + b
                case ast.Sub():
                    return a - b
                case ast.Mult():
                    return a * b
                case ast.Div():
                    return np.true_divide(a, b)
                case ast.FloorDiv():
                    return np.floor_divide(a, b)
                case ast.Mod():
                    return np.mod(a, b)
        return np.power(np.asarray(a, float), b)

    def negate(self, a):
        return np.logical_not(a)

    def boolean(self, every, values):
        return (np.logical_and if every else np.logical_or).reduce(np.broadcast_arrays(*values))

    def compare(self, op, a, b):
        fn = {"<": np.less, "<=": np.less_equal, ">": np.greater, ">=": np.greater_equal, "==": np.equal, "!=": np.not_equal}
        return fn[op](a, b)

    def call(self, name, args):
        fn = self.namespace.get(name) or FUNCTIONS[name].numpy
        if fn is None:
            raise LanguageError(f"{name} has no array form here")
        with np.errstate(all="ignore"):
            return fn(*args)


class ToDimension(Walker):
    """The dimension of an expression; the namespace holds dimensions (or quantities)."""

    def constant(self, v):
        return U.NONE

    def quantity(self, q):
        return q.dim

    def name(self, name):
        found = super().name(name)
        return found if isinstance(found, tuple) else U.quantity(found).dim

    def minus(self, a):
        return a

    def binary(self, op, a, b, right):
        match op:
            case ast.Mult():
                return U.times(a, b)
            case ast.Div() | ast.FloorDiv():
                return U.times(a, b, -1)
            case ast.Pow():
                U.require(b, U.NONE, "exponent")
                if a == U.NONE:
                    return a
                try:
                    return U.power(a, float(ToNumpy({}).visit(right)))
                except LanguageError as err:
                    raise U.DimensionError("a dimension can only be raised to a number") from err
        U.require(a, b, ast.dump(op))
        return a

    def negate(self, a):
        return U.NONE

    def boolean(self, every, values):
        return U.NONE

    def compare(self, op, a, b):
        U.require(a, b, op)
        return U.NONE

    def call(self, name, args):
        fn = FUNCTIONS[name]
        if len(args) != fn.arity:
            raise LanguageError(f"{name} takes {fn.arity} arguments")
        return fn.dims(*args)


def column(text: str | ast.expr, namespace: Mapping[str, Any]) -> Column:
    return ToColumn(namespace).run(text)


def array(text: str | ast.expr, namespace: Mapping[str, Any]) -> Any:
    return ToNumpy(namespace).run(text)


def dimension(text: str | ast.expr, namespace: Mapping[str, Any]) -> U.Dim:
    return ToDimension(namespace).run(text)


# --- Statements -----------------------------------------------------------------------------------------------

AUGMENTED = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Pow: "**", ast.Mod: "%", ast.FloorDiv: "//"}


@dataclass(frozen=True)
class Statement:
    """``target = value``; ``op`` is the operator of an augmented assignment, whose value is then only its right side."""

    target: str
    value: ast.expr
    op: str = ""

    @property
    def full(self) -> ast.expr:
        return parse(f"({self.target}) {self.op} ({ast.unparse(self.value)})") if self.op else self.value


def statements(code: str, calls: tuple[str, ...] = ()) -> list[Statement]:
    """The assignments of a code, one a line or between semicolons; ``calls`` are functions that whoever asks knows."""
    out = []
    for line in code.replace(";", "\n").splitlines():
        line = line.split("#")[0].strip()
        if not line:
            continue
        try:
            node = ast.parse(line).body[0]
        except SyntaxError as err:
            raise LanguageError(f"not a statement: {line!r}") from err
        match node:
            case ast.Assign(targets=[ast.Name(id=name)], value=value):
                out.append(Statement(name, parse(ast.unparse(value))))
            case ast.AugAssign(target=ast.Name(id=name), op=op, value=value) if type(op) in AUGMENTED:
                out.append(Statement(name, parse(ast.unparse(value)), AUGMENTED[type(op)]))
            case _:
                raise LanguageError(f"only assignments are allowed: {line!r}")
    return out
