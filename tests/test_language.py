"""Units, expressions, equations and integrators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import lang
from sparkloom.functions import units as U
from sparkloom.plans import control, integrators
from sparkloom.plans.equations import EquationError, Equations


def test_units():
    mv = U.UNITS["mV"]
    assert (3 * mv).best() == "3 mV" and (3 * mv).in_unit("uvolt") == pytest.approx(3000)
    assert (U.UNITS["volt"] / U.UNITS["amp"]).dim == U.UNITS["ohm"].dim
    with pytest.raises(U.DimensionError):
        mv + U.UNITS["ms"]
    with pytest.raises(lang.LanguageError, match="did you mean"):
        lang.dimension("mvolts * 2", {})


@pytest.mark.parametrize(
    "text",
    ["x/y", "x//y", "x%y", "-x**2", "x<y", "x<=y and not (x==y)", "x!=y or y>3", "exprel(x)", "log(x)", "log10(x)", "log1p(x)", "sqrt(x)",
     "clip(x,-1,1)", "int(x)", "ceil(x)", "floor(x)", "sign(x)", "timestep(x,0.1)", "1 < x < 3", "abs(x)+exp(-x)*sin(y)"],
)
def test_columns_agree_with_numpy(spark, text):
    x = np.array([0.0, -0.0, 1.0, -1.0, 2.5, -2.5, 3.0, 7.25])
    y = np.array([0.0, 2.0, 0.0, 0.0, -0.75, 0.75, 3.0, -2.0])
    keep = y != 0 if "//" in text or "%" in text else np.ones(8, bool)
    x, y = x[keep], y[keep]
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))], "k int, x double, y double")
    got = [r[0] for r in df.orderBy("k").select(lang.column(text, {"x": F.col("x"), "y": F.col("y")})).collect()]
    want = lang.array(text, {"x": x, "y": y})
    assert np.allclose(np.array(got, float), np.asarray(want, float), equal_nan=True)


def test_nothing_but_the_language():
    for bad in ("__import__('os')", "x.y", "[1]", "lambda: 1", "f(x=1)", "x if y else z"):
        with pytest.raises(lang.LanguageError):
            lang.parse(bad)
    lang.inline_function("double_it", ("a",), "a + a")
    assert lang.array("double_it(3 * x)", {"x": np.array([1.0])}) == 6


def test_equations():
    eqs = Equations.parse("dv/dt = (ge - (v - El))/taum : volt (unless refractory)\ndge/dt = -ge/taue : volt\ntwo = 2*v : volt\nk : integer (constant)")
    ns = {"taum": 20 * U.UNITS["ms"], "taue": 5 * U.UNITS["ms"], "El": -49 * U.UNITS["mV"]}
    eqs.check(ns)
    assert Equations.parse(str(eqs)).items == eqs.items or str(Equations.parse(str(eqs))) == str(eqs)
    with pytest.raises(EquationError, match="dv/dt.*does not fit"):
        Equations.parse("dv/dt = v : volt\ndw/dt = w/(1*ms) : 1").check({})
    with pytest.raises(EquationError, match="need each other"):
        Equations.parse("a = b : 1\nb = a : 1").ordered_views()
    with pytest.raises(EquationError):
        eqs + "k : 1"


def run(text, method, steps, dt, state, constants=None, noise=None):
    _, plan = integrators.step(Equations.parse(text), method, constants or {}, dt)
    env = {**(constants or {}), **state, "dt": dt, "t": 0.0, "not_refractory": True}
    for k in range(steps):
        env["t"], env["_dW"] = k * dt, noise[k] if noise is not None else 0.0
        for name, tree in plan:
            env[name] = lang.array(tree, env)
    return env


@pytest.mark.parametrize(("method", "order"), [("euler", 1), ("rk2", 2), ("heun", 2), ("rk4", 4)])
def test_order_of_methods(method, order):
    # x' = -x * t has the solution exp(-t**2 / 2)
    errors = []
    for n in (20, 40):
        x = run("dx/dt = -x*t : 1", method, n, 1.0 / n, {"x": 1.0})["x"]
        errors.append(abs(x - math.exp(-0.5)))
    assert math.log2(errors[0] / errors[1]) == pytest.approx(order, abs=0.35)


def test_exact_coupled_system():
    text = "dv/dt = (g - v)/a : 1\ndg/dt = -g/b : 1"
    c = {"a": 0.02, "b": 0.005}
    v = run(text, "exact", 100, 1e-3, {"v": 1.0, "g": 2.0}, c)["v"]
    k = 2.0 * c["b"] / (c["b"] - c["a"])
    assert v == pytest.approx((1 - k) * math.exp(-0.1 / c["a"]) + k * math.exp(-0.1 / c["b"]), rel=1e-9)


def test_milstein_on_geometric_noise():
    rng = np.random.default_rng(0)
    dt, n = 1e-3, 1000
    dw = rng.normal(size=n) * dt**0.5
    x = run("dx/dt = -x + 0.5*x*xi : 1", "milstein", n, dt, {"x": 1.0}, noise=dw)["x"]
    assert x == pytest.approx(math.exp((-1 - 0.125) * n * dt + 0.5 * dw.sum()), rel=0.02)


def test_methods_refuse_and_fall_back():
    with pytest.raises(integrators.UnsupportedEquations):
        integrators.step(Equations.parse("dx/dt = x**2 : 1"), "exact")
    assert integrators.step(Equations.parse("dx/dt = x**2 : 1"))[0] == "euler"
    assert integrators.step(Equations.parse("dx/dt = x*xi : 1"))[0] == "heun"


def test_adaptive():
    x = np.ones((1, 3))
    rate = np.array([1.0, 10.0, 100.0])
    out = integrators.adaptive(lambda y, t, at: -y * rate[at], x, 0.0, 1.0, 1e-9)
    assert np.allclose(out[0], np.exp(-rate), atol=1e-6)


def test_clocks_and_scope():
    c = control.Clock(1e-4)
    assert c.end_tick(1e-3) == 10 and c.end_tick(1.05e-3) == 11
    with pytest.raises(ValueError):
        control.Clock(1e-4, 3).with_dt(2e-4)
    a, b = control.Clock(1.0), control.EventClock([0.5, 2.0])
    seen = []
    for _ in range(4):
        t = min(a.t, b.t)
        seen.append((t, len(control.advance([a, b]))))
    assert seen == [(0.0, 1), (0.5, 1), (1.0, 1), (2.0, 2)]
    s = control.Scope()
    assert [s.add(1, "g*"), s.add(2, "g*"), s.add(3, "syn", ("g",))] == ["g", "g_1", "syn"]
    assert s.order().index("g") < s.order().index("syn")
    with pytest.raises(ValueError, match="needed"):
        s.remove("g")
    control.prefs["run.shards"] = 3
    assert control.prefs["run.shards"] == 3
    control.prefs["run.shards"] = 0
    with pytest.raises(ValueError):
        control.prefs["run.shards"] = -1
