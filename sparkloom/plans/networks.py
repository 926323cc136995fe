"""Registered queries of networks, flags, clocked code, functions at the edges of their domains, and reductions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lang, reductions
from ..operators.assembly import Assembly, Clocked, Synapses, Way, edge_rows, of_kind
from ..operators.group import Group
from . import catalogue as C

DT = 1e-3
#: What a network is cut into; each shard fits a task.
SHARDS = 64


def rows_of(df, name: str, columns: tuple[str, ...] = ()):
    """A table ``(i, ...)`` as rows of an assembly's group, in run 0."""
    pairs = [x for c in columns for x in (F.lit(c), F.col(c).cast("double"))]
    values = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")
    return df.select(F.lit(0).cast("long").alias("run"), F.lit(name).alias("object"), F.col("i").cast("long").alias("i"), values.alias("values"))


def suppliers(spark, sf_dir):
    return C.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), (F.col("s_suppkey") % 5 + 2).alias("period"), F.col("s_acctbal").alias("v"))


def parts(spark, sf_dir):
    return C.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"))


def links(spark, sf_dir):
    """One edge an order."""
    rows = C.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("seq"))
    rows = rows.agg(F.min("l_suppkey").alias("i"), F.min("l_partkey").alias("j"), F.sum("l_quantity").alias("w"))
    return rows.withColumn("d", F.col("seq") % 3 * F.lit(DT))


#: Fires every ``period`` ticks, first at 0.
PERIODIC = "(t/(1*ms) + 0.5)//1 % period == 0"
LINKS = "(SELECT l_orderkey, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY 1)"
#: Events of a supplier that reach an edge of delay d within 20 ticks.
TIMES = f"(SELECT l_orderkey, l_suppkey AS i, l_partkey AS j, l_quantity AS w, (19 - l_orderkey % 3) // (l_suppkey % 5 + 2) + 1 AS n FROM {LINKS} l)"


def network(spark, sf_dir, target: str, code: str, shown: str, equations: str = "w : 1"):
    """The final state of one of its objects."""
    a, b = Group(1, "period : 1", threshold=PERIODIC, name="a"), Group(1, target, name="b")
    plan = Assembly([a, b], [Synapses("s", "a", "b", equations, {"pre": Way(code, delay="d")})])
    nodes = rows_of(suppliers(spark, sf_dir), "a", ("period",)).unionByName(rows_of(parts(spark, sf_dir), "b"))
    return plan.final(nodes, edge_rows(links(spark, sf_dir), "s", ("w", "d")), 20, DT, shown, SHARDS)


@C.query("str_8_pathway", f"SELECT p_partkey AS i, round(coalesce(sum(w * n), 0), 6) AS v FROM part LEFT JOIN {TIMES} e ON e.j = p_partkey GROUP BY 1")
def _(spark, sf_dir):
    """What arrives at each target, over edges with delays of their own."""
    return network(spark, sf_dir, "v : 1", "v_post += w", "b").select("i", F.round("v", 6).alias("v"))


@C.query("edg_1_edge_state", f"SELECT l_orderkey AS seq, round(w * power(1.5::DOUBLE, n), 6) AS w, CAST(n AS DOUBLE) AS seen FROM {TIMES} e")
def _(spark, sf_dir):
    """Code that changes the edge itself."""
    out = network(spark, sf_dir, "v : 1", "w *= 1.5; seen += 1", "s", "w : 1\nseen : 1")
    return out.select(F.col("i").alias("seq"), F.round("w", 6).alias("w"), "seen")


@C.query("int_14_clock_driven", f"SELECT l_orderkey AS seq, round(s_acctbal * (1 - power(0.9::DOUBLE, 12)), 6) AS q FROM {LINKS} l JOIN supplier ON s_suppkey = l_suppkey")
def _(spark, sf_dir):
    """An equation of the edges, integrated every tick."""
    a, b = Group(1, "v : 1", name="a"), Group(1, "x : 1", name="b")
    plan = Assembly([a, b], [Synapses("s", "a", "b", "dq/dt = (v_pre - q)/(10*ms) : 1 (clock-driven)", method="euler")])
    nodes = rows_of(suppliers(spark, sf_dir), "a", ("v",)).unionByName(rows_of(parts(spark, sf_dir), "b"))
    out = plan.final(nodes, edge_rows(links(spark, sf_dir), "s"), 12, DT, "s", SHARDS)
    return out.select(F.col("i").alias("seq"), F.round("q", 6).alias("q"))


@C.query("join_15_synapses_on_synapses", f"""
    SELECT l_orderkey AS seq, CAST(count(s_suppkey) * 4 AS DOUBLE) AS w FROM {LINKS} l
    LEFT JOIN supplier ON s_suppkey % 7 = l_orderkey % 11 AND s_suppkey = l_suppkey GROUP BY 1""")
def _(spark, sf_dir):
    """Edges whose targets are edges."""
    a, b = Group(1, "period : 1", threshold="t < 3.5*ms", name="a"), Group(1, "x : 1", name="b")
    plan = Assembly([a, b], [Synapses("s", "a", "b", "u : 1"), Synapses("m", "a", "s", "", {"pre": Way("u_post += 1")})])
    edges = links(spark, sf_dir)
    onto = edges.filter(F.col("i") % 7 == F.col("seq") % 11).select("seq", "i", F.col("seq").alias("j"))
    nodes = rows_of(suppliers(spark, sf_dir), "a", ("period",)).unionByName(rows_of(parts(spark, sf_dir), "b"))
    out = plan.final(nodes, edge_rows(edges, "s").unionByName(edge_rows(onto, "m")), 6, DT, "s", SHARDS)
    return out.select(F.col("i").alias("seq"), F.col("u").alias("w"))


@C.query("agg_1_summed_flag", f"SELECT p_partkey AS i, round(coalesce(sum(l_quantity * s_acctbal), 0), 4) AS g FROM part LEFT JOIN ({LINKS} l JOIN supplier ON s_suppkey = l_suppkey) ON l_partkey = p_partkey GROUP BY 1")
def _(spark, sf_dir):
    a, b = Group(1, "v : 1", name="a"), Group(1, "g : 1", name="b")
    plan = Assembly([a, b], [Synapses("s", "a", "b", "w : 1\ng_post = w*v_pre : 1 (summed)")])
    nodes = rows_of(suppliers(spark, sf_dir), "a", ("v",)).unionByName(rows_of(parts(spark, sf_dir), "b"))
    out = plan.final(nodes, edge_rows(links(spark, sf_dir), "s", ("w",)), 1, DT, "b", SHARDS)
    return out.select("i", F.round("g", 4).alias("g"))


def clocked(spark, sf_dir, group: Group, code: list[Clocked], ticks: int, name: str):
    plan = Assembly([group], clocked=code)
    out = plan.run(rows_of(suppliers(spark, sf_dir), group.name, tuple(c for c in ("v", "period") if c in group.stored)), None, ticks, DT)
    return of_kind(out, "state", name).select("i", F.round("value", 6).alias(name))


@C.query("prj_10_run_at", "SELECT s_suppkey AS i, round(s_acctbal * 0.25::DOUBLE, 6) AS v FROM supplier")
def _(spark, sf_dir):
    return clocked(spark, sf_dir, Group(1, "v : 1", name="g"), [Clocked("g", "v *= 0.5", at=(3e-3, 7e-3, 1.0))], 10, "v")


@C.query("prj_11_run_on_clock", "SELECT s_suppkey AS i, round(s_acctbal + 4, 6) AS v FROM supplier")
def _(spark, sf_dir):
    return clocked(spark, sf_dir, Group(1, "v : 1", name="g"), [Clocked("g", "v += 1", every=3e-3)], 11, "v")


@C.query("prj_13_run_on_event", "SELECT s_suppkey AS i, CAST(11 // (s_suppkey % 5 + 2) + 1 AS DOUBLE) AS hits FROM supplier")
def _(spark, sf_dir):
    g = Group(1, "period : 1\nhits : 1", events={"beat": PERIODIC}, name="g")
    return clocked(spark, sf_dir, g, [Clocked("g", "hits += 1", event="beat")], 12, "hits")


@C.query("prj_3_constant_over_dt", "SELECT s_suppkey AS i, round(s_acctbal / 100 * power(1.05::DOUBLE, 4), 6) AS v FROM supplier")
def _(spark, sf_dir):
    """A view that keeps its value during a tick: every stage of the scheme sees the same."""
    g = Group(1, "dv/dt = level/(20*ms) : 1\nlevel = v + 0 : 1 (constant over dt)", method="rk4")
    rows = suppliers(spark, sf_dir).select("i", (F.col("v") / 100).alias("v"), F.lit(-1e4).alias("lastspike"), F.lit(True).alias("not_refractory"))
    return g.fold(rows, 4, 1e-3).select("i", F.round("v", 6).alias("v"))


@C.query("int_9_user_scheme", "SELECT s_suppkey AS i, round(10 + (s_acctbal / 100 - 10) * power(1 - 0.05::DOUBLE + 0.05::DOUBLE * 0.05::DOUBLE / 2, 10), 6) AS v FROM supplier")
def _(spark, sf_dir):
    """The midpoint rule, written as a user would."""
    from .integrators import METHODS, explicit, register

    if "user_midpoint" not in METHODS:
        register("user_midpoint", explicit("k = dt * f(x, t)\nx_new = x + dt * f(x + k / 2, t + dt / 2) + g(x, t) * dW"))
    g = Group(1, "dv/dt = (10 - v)/(20*ms) : 1", method="user_midpoint")
    rows = suppliers(spark, sf_dir).select("i", (F.col("v") / 100).alias("v"), F.lit(-1e4).alias("lastspike"), F.lit(True).alias("not_refractory"))
    return g.fold(rows, 10, 1e-3).select("i", F.round("v", 6).alias("v"))


@C.query("fn_more_functions", """
    SELECT l_orderkey, l_linenumber, round(cos(x), 9) AS a, round(tan(x), 9) AS b, round((exp(x) - exp(-x)) / 2, 9) AS c, round((exp(x) + exp(-x)) / 2, 9) AS d,
           round(asin(x), 9) AS e, round(acos(x), 9) AS f, round(exp(x) - 1, 9) AS g, round(ln(1 + x), 9) AS h, CAST(floor(x * 20) AS INTEGER) AS k,
           abs(x) AS l, CAST(sign(x) AS DOUBLE) AS m, CAST(trunc(x * 20) AS INTEGER) AS n, CASE WHEN x > 0 THEN x ELSE -1.0 END AS o
    FROM (SELECT *, round(l_discount * 10 - 0.5::DOUBLE, 2) AS x FROM lineitem WHERE l_discount * 10 - 0.5 > -1 AND l_discount * 10 - 0.5 < 1)""")
def _(spark, sf_dir):
    x = F.col("l_discount") * 10 - F.lit(0.5)
    rows = C.table(spark, sf_dir, "lineitem").filter((x > -1) & (x < 1)).withColumn("x", F.round(x, 2))
    c = lambda text: lang.column(text, {"x": F.col("x")})
    texts = {"a": "cos(x)", "b": "tan(x)", "c": "sinh(x)", "d": "cosh(x)", "e": "arcsin(x)", "f": "arccos(x)", "g": "expm1(x)", "h": "log1p(x)"}
    plain = {"k": "floor(x*20)", "l": "abs(x)", "m": "sign(x)", "n": "int(x*20)", "o": "where(x > 0, x, -1.0)"}
    return rows.select("l_orderkey", "l_linenumber", *[F.round(c(t), 9).alias(k) for k, t in texts.items()], *[c(t).alias(k) for k, t in plain.items()])


#: Values at which columns and arrays could differ, and what each expression is there: NaN, infinities, signed zero,
#: beyond 32 bits. NaN is shown as -999 and the infinities as 1e300 and -1e300.
ODD = ("'NaN'", "'Infinity'", "'-Infinity'", "0.0", "-0.0", "-1.5", "2.5", "1e12")


@C.query("fn_ieee_edges", """
    SELECT l_orderkey, l_linenumber, CASE WHEN isnan(x) THEN -999 ELSE least(greatest(x, 0), 1) END AS clip,
           CASE WHEN isnan(x) THEN -999 WHEN x > 1e300 THEN 3 WHEN x < -1e300 THEN -1e300 ELSE least(x, 3) END AS low,
           CASE WHEN isnan(x) THEN -999 WHEN x > 1e300 THEN 1e300 ELSE greatest(x, 3) END AS high,
           CASE WHEN isnan(x) OR abs(x) >= 2147483648 THEN -2147483648 ELSE CAST(trunc(x) AS INTEGER) END AS whole,
           CASE WHEN isnan(x) OR x = 0 THEN -999 WHEN x > 0 THEN 1e300 ELSE -1e300 END AS ratio,
           -999.0::DOUBLE AS rest, CASE WHEN isnan(x) OR x < 0 THEN -999 WHEN x = 0 THEN -1e300 WHEN x > 1e300 THEN 1e300 ELSE round(ln(CASE WHEN x > 0 THEN x ELSE 1 END), 9) END AS log
    FROM (SELECT l_orderkey, l_linenumber, (['NaN', 'Infinity', '-Infinity', '0.0', '-0.0', '-1.5', '2.5', '1e12'])[1 + (l_orderkey + l_linenumber) % 8]::DOUBLE AS x FROM lineitem)""")
def _(spark, sf_dir):
    values = F.array(*[F.lit(float(v.strip("'"))) for v in ODD])
    rows = C.table(spark, sf_dir, "lineitem").withColumn("x", F.get(values, ((F.col("l_orderkey") + F.col("l_linenumber")) % 8).cast("int")))
    c = lambda text: lang.column(text, {"x": F.col("x"), "zero": F.lit(0.0)})
    shown = lambda x: F.when(F.isnan(x), F.lit(-999.0)).when(x > 1e300, F.lit(1e300)).when(x < -1e300, F.lit(-1e300)).otherwise(x)
    return rows.select(
        "l_orderkey", "l_linenumber", shown(c("clip(x, 0, 1)")).alias("clip"), shown(c("minimum(x, 3)")).alias("low"), shown(c("maximum(x, 3)")).alias("high"),
        c("int(x)").alias("whole"), shown(c("x/zero")).alias("ratio"), shown(c("x % zero")).alias("rest"), F.round(shown(c("log(x)")), 9).alias("log"),
    )


@C.query("agg_15_more_reductions", """
    SELECT l_returnflag, round(product(1 + l_tax / 100), 9) AS p, bool_or(l_quantity > 49) AS some, bool_and(l_quantity > 0) AS every,
           arg_min(l_orderkey * 10 + l_linenumber, struct_pack(x := l_extendedprice, k := l_orderkey * 10 + l_linenumber)) AS first_least,
           arg_max(l_orderkey * 10 + l_linenumber, struct_pack(x := l_extendedprice, k := -(l_orderkey * 10 + l_linenumber))) AS first_most,
           round(sum(l_quantity * l_discount), 4) AS dot, count(*) FILTER (l_tax <> 0) AS nonzero,
           round(coalesce(sum(l_quantity) FILTER (l_linenumber = CAST(l_quantity AS INTEGER)), 0), 4) AS trace
    FROM lineitem GROUP BY 1""")
def _(spark, sf_dir):
    c, place = F.col, F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return C.table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.round(reductions.prod(1 + c("l_tax") / 100), 9).alias("p"), reductions.some(c("l_quantity") > 49).alias("some"),
        reductions.every(c("l_quantity") > 0).alias("every"), reductions.argmin(c("l_extendedprice"), place).alias("first_least"),
        reductions.argmax(c("l_extendedprice"), place).alias("first_most"), F.round(reductions.dot(c("l_quantity"), c("l_discount")), 4).alias("dot"),
        reductions.nonzero(c("l_tax")).alias("nonzero"), F.round(reductions.trace(c("l_linenumber"), c("l_quantity").cast("int"), c("l_quantity")), 4).alias("trace"),
    )


@C.query("sort_6_searchsorted", "SELECT l_orderkey, l_linenumber, (l_quantity > 10)::INTEGER + (l_quantity > 20)::INTEGER + (l_quantity > 45)::INTEGER AS place FROM lineitem")
def _(spark, sf_dir):
    rows = C.table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", reductions.searchsorted(F.col("l_quantity"), [10.0, 20.0, 45.0]).alias("place"))


@C.query("win_10_cumprod", f"SELECT event_id, round(exp(sum(ln(1 + value / 10000)) OVER (PARTITION BY i ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)), 6) AS p FROM {C.EV} e")
def _(spark, sf_dir):
    return C.stream(spark, sf_dir).select("event_id", F.round(reductions.cumprod(1 + F.col("value") / 10000, ["t", "event_id"], ("i",)), 6).alias("p"))
