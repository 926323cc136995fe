"""The engine's registered queries and the SQL they are checked against.

The driver's tables stand for the engine's: ``events`` is an event stream (``user_id`` fires), ``orders`` and
``lineitem`` are edge tables, ``supplier``, ``part``, ``customer`` and ``nation`` are node tables. Names begin with
the operator that a query shows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lang, reductions, rng
from ..operators import delivery as D
from ..operators import edges as E
from ..operators import rates as R
from ..operators.group import Group, conditional_set, spikes, traces
from ..operators.network import stdp
from ..sources import tables as T

ORIGIN = "2024-01-01"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as an event stream: i, t in seconds from the origin, tick of one second."""
    start = F.lit(ORIGIN).cast("timestamp_ntz")
    t = F.timestamp_diff("MICROSECOND", start, F.col("ts").cast("timestamp_ntz")) / F.lit(1e6)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("i"), t.alias("t"), lang.timestep(t, F.lit(1.0)).alias("tick"), "event_id", "event_type", "value"
    )


#: The same in DuckDB.
EV = """(SELECT user_id AS i, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6::DOUBLE AS t,
         CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6::DOUBLE + 0.001::DOUBLE) AS BIGINT) AS tick,
         event_id, event_type, value FROM events)"""
USERS = "(SELECT DISTINCT user_id AS i FROM events)"


def users(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("i")).distinct()


@query("flagship", f"""
    SELECT e.i, tick // 3600 AS bin, count(*) AS n, count(*) / 3600.0::DOUBLE AS rate, round(sum(value), 6) AS total
    FROM {EV} e WHERE value * 2 > 20 OR value < 1 GROUP BY ALL""")
def flagship(spark, sf_dir):
    """Threshold by an expression of the language, then rates in hourly bins for each node."""
    events = stream(spark, sf_dir)
    keep = lang.column("value*2 > 20 or value < 1", {c: F.col(c) for c in events.columns})
    return events.filter(keep).groupBy("i", F.floor(F.col("tick") / 3600).alias("bin")).agg(
        F.count("*").alias("n"), (F.count("*") / F.lit(3600.0)).alias("rate"), F.round(F.sum("value"), 6).alias("total")
    )


# --- sources --------------------------------------------------------------------------------------------------


@query("src_1_group_table", "SELECT i, i * 0.5::DOUBLE + 1 AS v, CAST(i % 3 AS INTEGER) AS kind FROM range(1000) r(i)")
def _(spark, sf_dir):
    g = Group(1000, "dv/dt = -v/(10*ms) : 1\nkind : integer").set("v", "i*0.5 + 1").set("kind", "i % 3")
    return g.table(spark).select("i", "v", "kind")


def draw_sql(relation: str, seed: int, name: str, keys: list[str], out: str) -> str:
    """The relation with a uniform draw by its key columns, in DuckDB's SQL: the hash, step by step, on integers of 128
    bits that are cut to 64."""
    a, b, c, d, e = (f"{x}::UHUGEINT" for x in rng.PRIMES)
    most = f"{1 << 64}::UHUGEINT"
    times = lambda x, y: f"(({x}) * {y} % {most})"
    turn = lambda x, n: f"((({x}) * {1 << n}::UHUGEINT) % {most} + ({x}) // {1 << (64 - n)}::UHUGEINT)"
    mixed = lambda x, n: f"xor(({x})::UBIGINT, (({x}) // {1 << n}::UHUGEINT)::UBIGINT)::UHUGEINT"
    sql = f"SELECT *, {rng.prefix(seed, name)}::UHUGEINT AS _h FROM {relation}"
    for key in keys:
        sql = f"SELECT *, {times(f'({key})::UHUGEINT', b)} AS _k FROM ({sql})"
        sql = f"SELECT * REPLACE ({times(turn('_k', 31), a)} AS _k, (_h + {e} + 8::UHUGEINT) % {most} AS _h) FROM ({sql})"
        sql = f"SELECT * EXCLUDE (_k) REPLACE (xor(_h::UBIGINT, _k::UBIGINT)::UHUGEINT AS _h) FROM ({sql})"
        sql = f"SELECT * REPLACE (({times(turn('_h', 27), a)} + {d}) % {most} AS _h) FROM ({sql})"
        sql = f"SELECT * REPLACE ({times(mixed('_h', 33), b)} AS _h) FROM ({sql})"
        sql = f"SELECT * REPLACE ({times(mixed('_h', 29), c)} AS _h) FROM ({sql})"
        sql = f"SELECT * REPLACE ({mixed('_h', 32)} AS _h) FROM ({sql})"
    return f"(SELECT * EXCLUDE (_h), (_h // 2048::UHUGEINT)::DOUBLE * {rng.SCALE!r}::DOUBLE AS {out} FROM ({sql}))"


def chosen_sql(owners: str, n: int, k: int, seed: int) -> str:
    """``(id, x)``: for each id the first k different ones of repeated draws below n."""
    draws = draw_sql(f"(SELECT id, r FROM {owners} CROSS JOIN range({4 * k + 33}) q(r))", seed, "choose", ["id", "r"], "u")
    first = f"SELECT id, CAST(floor(u * {n}) AS BIGINT) AS x, min(r) AS r FROM {draws} GROUP BY ALL"
    return f"(SELECT id, x FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r) AS place FROM ({first})) WHERE place <= {k})"


@query("src_2_poisson_events", f"""
    SELECT tick, i FROM {draw_sql("(SELECT k % 100 AS i, k // 100 AS tick FROM range(100000) r(k))", 42, "poisson", ["tick", "i"], "u")}
    WHERE u < 20.0::DOUBLE * 1e-3::DOUBLE""")
def _(spark, sf_dir):
    return T.poisson_events(spark, 100, 1000, 20.0, 1e-3, 42)


@query("src_3_periodic_replay", f"""
    SELECT e.i, e.tick % 86400 + 86400 * k AS tick FROM {EV} e, range(3) p(k)""")
def _(spark, sf_dir):
    day = stream(spark, sf_dir).select("i", (F.col("tick") % 86400).cast("double").alias("t"))
    return T.replay(day, 1.0, 86400.0, 3 * 86400.0)


@query("src_4_replay_issues", f"""
    SELECT i, min(t) AS t, 'several events in a tick' AS issue FROM {EV} e GROUP BY i, tick HAVING count(*) > 1""")
def _(spark, sf_dir):
    return T.replay_issues(stream(spark, sf_dir).select("i", "t"), 1 << 40, 1.0)


BELOW = " + ".join(f"(u >= {x!r}::DOUBLE)::INTEGER" for x in rng.cumulated(0.98**100, lambda k: (101 - k) / k * 0.02 / 0.98 if k <= 100 else 0.0))


@query("src_5_poisson_input", f"SELECT tick, i, ({BELOW}) * 0.5::DOUBLE AS value FROM {draw_sql(f'(SELECT tick, i FROM {EV} e)', 7, 'input', ['tick', 'i'], 'u')}")
def _(spark, sf_dir):
    return T.poisson_input(stream(spark, sf_dir).select("tick", "i"), 100, 2.0, 0.5, 1e-2, 7)


@query("src_6_timed_array", f"""
    SELECT event_id, [1.5::DOUBLE, -2.0::DOUBLE, 4.25::DOUBLE, 0.0::DOUBLE][1 + least(greatest(
        CAST(floor(t / 604800.0::DOUBLE + 0.001::DOUBLE) AS BIGINT), 0), 3)] AS value FROM {EV} e""")
def _(spark, sf_dir):
    rows = T.timed_array(stream(spark, sf_dir).drop("value"), [1.5, -2.0, 4.25, 0.0], 604800.0)
    return rows.select("event_id", "value")


@query("src_7_timed_array_2d", f"""
    SELECT e.event_id, p.p_retailprice AS held FROM {EV} e LEFT JOIN part p ON p.p_partkey = e.i""")
def _(spark, sf_dir):
    values = table(spark, sf_dir, "part").select(F.lit(0).cast("bigint").alias("tick"), F.col("p_partkey").alias("i"), F.col("p_retailprice").alias("value"))
    rows = stream(spark, sf_dir).drop("value")
    return T.timed_array_2d(rows, values, 0).select("event_id", F.col("value").alias("held"))


@query("src_8_edge_list", """
    SELECT l_suppkey AS i, l_partkey AS j, k FROM lineitem, range(3) r(k)
    WHERE k < CAST(l_quantity AS INTEGER) % 3""")
def _(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), (F.col("l_quantity").cast("int") % 3).alias("n"))
    return T.edge_list(pairs, F.col("n")).select("i", "j", F.col("k").cast("bigint").alias("k"))


@query("src_10_fixed_total_edges", f"""
    SELECT syn, CAST(floor(u * 200) AS BIGINT) AS i, CAST(floor(v * 300) AS BIGINT) AS j
    FROM {draw_sql(draw_sql("(SELECT k AS syn FROM range(10000) r(k))", 5, "i", ["syn"], "u"), 5, "j", ["syn"], "v")}""")
def _(spark, sf_dir):
    return T.fixed_total_edges(spark, 10_000, 200, 300, 5)


@query("src_11_fixed_indegree_edges", f"SELECT x AS i, id AS j FROM {chosen_sql('(SELECT k AS id FROM range(300) r(k))', 200, 10, 5)}")
def _(spark, sf_dir):
    return T.fixed_indegree_edges(spark, 10, 200, 300, 5)


@query("src_15_state_import", """
    SELECT s_suppkey AS i, CASE WHEN c_acctbal IS NULL AND c_custkey IS NULL THEN s_acctbal ELSE c_acctbal END AS v
    FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey AND c_custkey % 2 = 0""")
def _(spark, sf_dir):
    state = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("v"))
    values = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("i"), F.col("c_acctbal").alias("v"))
    return T.imported(state, values, ["v"])


# --- expressions, updates, filters ----------------------------------------------------------------------------


@query("prj_5_conditional_set", """
    SELECT p_partkey, CASE WHEN p_size > 25 AND p_retailprice < 1500 THEN p_retailprice * 2 ELSE p_retailprice END AS p_retailprice FROM part""")
def _(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    names = {c: F.col(c) for c in part.columns}
    out = conditional_set(part, "p_retailprice", lang.column("p_retailprice*2", names), lang.column("p_size > 25 and p_retailprice < 1500", names))
    return out.select("p_partkey", "p_retailprice")


@query("prj_17_operators", """
    SELECT l_orderkey, l_linenumber, CAST(floor(x / 7.0::DOUBLE) AS BIGINT) AS whole, x - 7 * floor(x / 7.0::DOUBLE) AS rest,
           round(power(l_tax + 1, 2), 9) AS squared, CASE WHEN l_tax = 0 THEN NULL ELSE round(l_discount / l_tax, 9) END AS ratio
    FROM (SELECT *, l_quantity - 25 AS x FROM lineitem)""")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("x", F.col("l_quantity") - 25)
    c = lambda text: lang.column(text, {n: F.col(n) for n in rows.columns})
    ratio = c("l_discount/l_tax")
    return rows.select(
        "l_orderkey", "l_linenumber", c("x // 7.0").alias("whole"), c("x % 7.0").alias("rest"),
        F.round(c("(l_tax + 1) ** 2"), 9).alias("squared"),
        F.when(F.col("l_tax") == 0, None).otherwise(F.round(ratio, 9)).alias("ratio"),
    )


@query("prj_18_statements", "SELECT s_suppkey AS i, round((s_acctbal + 10) * 2 - 1, 6) AS v, round(s_acctbal + 10, 6) AS w FROM supplier")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("v"))
    env = {c: F.col(c) for c in rows.columns}
    for s in lang.statements("v += 10; w = v; v *= 2; v -= 1"):
        env[s.target] = lang.column(s.full, env)
    return rows.select("i", F.round(env["v"], 6).alias("v"), F.round(env["w"], 6).alias("w"))


@query("fn_functions", """
    SELECT l_orderkey, l_linenumber, round(sin(x), 9) AS a, round(exp(-x), 9) AS b, round(ln(x), 9) AS c, round(log10(x), 9) AS d,
           round(sqrt(x), 9) AS e, round(tanh(x), 9) AS f, CAST(ceil(x) AS INTEGER) AS g, least(greatest(x, 0.3::DOUBLE), 0.7::DOUBLE) AS h,
           round(CASE WHEN x - 0.5 = 0 THEN 1.0 ELSE (exp(x - 0.5) - 1) / (x - 0.5) END, 6) AS k, round(atan(x), 9) AS m
    FROM (SELECT *, l_discount + 0.25::DOUBLE AS x FROM lineitem)""")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("x", F.col("l_discount") + F.lit(0.25))
    c = lambda text: lang.column(text, {"x": F.col("x")})
    texts = {"a": "sin(x)", "b": "exp(-x)", "c": "log(x)", "d": "log10(x)", "e": "sqrt(x)", "f": "tanh(x)", "m": "arctan(x)"}
    return rows.select(
        "l_orderkey", "l_linenumber", *[F.round(c(t), 9).alias(k) for k, t in texts.items()], c("ceil(x)").alias("g"),
        c("clip(x, 0.3, 0.7)").alias("h"), F.round(c("exprel(x - 0.5)"), 6).alias("k"),
    )


def normal_sql(relation: str, seed: int, name: str, keys: list[str]) -> str:
    return draw_sql(draw_sql(relation, seed, f"{name}/r", keys, "_r"), seed, f"{name}/a", keys, "_a")


@query("fn_13_uniform_draws", f"""
    SELECT event_id, u, round(sqrt(-2 * ln(1 - _r)) * cos(2 * pi() * _a), 9) AS z
    FROM {normal_sql(draw_sql("(SELECT event_id FROM events)", 1, "u", ["event_id"], "u"), 1, "n", ["event_id"])}""")
def _(spark, sf_dir):
    rows = stream(spark, sf_dir)
    return rows.select("event_id", rng.uniform(1, "u", F.col("event_id")).alias("u"), F.round(rng.normal(1, "n", F.col("event_id")), 9).alias("z"))


@query("flt_1_threshold_events", f"SELECT tick, 'spike' AS event, i FROM {EV} e WHERE value > 40")
def _(spark, sf_dir):
    return D.threshold(stream(spark, sf_dir), F.col("value") > 40)


@query("flt_2_custom_events", f"""
    SELECT tick, 'high' AS event, i FROM {EV} e WHERE value > 60 UNION ALL
    SELECT tick, 'buy' AS event, i FROM {EV} e WHERE event_type = 'purchase' AND value > 20""")
def _(spark, sf_dir):
    rows = stream(spark, sf_dir)
    buy = (F.col("event_type") == "purchase") & (F.col("value") > 20)
    return D.threshold(rows, F.col("value") > 60, "high").unionByName(D.threshold(rows, buy, "buy"))


@query("flt_5_subgroup", "SELECT c_custkey - 100 AS i, c_acctbal AS v FROM customer WHERE c_custkey >= 100 AND c_custkey < 400")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), F.col("c_acctbal").alias("v"))
    return Group(1, "v : 1").subgroup(rows, 100, 400)


@query("flt_7_edge_index", "SELECT l_suppkey AS i, l_partkey AS j, l_linenumber AS k FROM lineitem WHERE l_suppkey >= 10 AND l_suppkey < 60 AND (l_suppkey - 10) % 5 = 0 AND l_partkey % 2 = 0 AND l_linenumber = 1")
def _(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_linenumber").alias("k"))
    return E.at(edges, slice(10, 60, 5), F.col("j") % 2 == 0, 1)


# --- joins and edges ------------------------------------------------------------------------------------------


def order_edges(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("i"), F.col("o_orderkey").alias("j"), F.col("o_totalprice").alias("w"))


@query("join_1_propagate", f"""
    SELECT e.tick + CAST(floor(o_totalprice / 1000.0::DOUBLE + 0.5) AS INTEGER) AS due, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS j,
           round(sum(o_totalprice), 4) AS total
    FROM {EV} e JOIN orders ON o_custkey = e.i WHERE e.value > 80 GROUP BY ALL""")
def _(spark, sf_dir):
    edges = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("i"), F.substring("o_orderpriority", 1, 1).cast("bigint").alias("j"), F.col("o_totalprice").alias("w"),
        D.delay_ticks(F.col("o_totalprice"), 1000.0).alias("delay_ticks"),
    )
    fired = D.threshold(stream(spark, sf_dir), F.col("value") > 80)
    out = D.deliver_sum(D.propagate(fired, edges), F.col("w"))
    return out.select("due", "j", F.round("total", 4).alias("total"))


@query("join_2_connect_condition", "SELECT a.n_nationkey AS i, b.n_nationkey AS j FROM nation a, nation b WHERE a.n_nationkey <> b.n_nationkey AND a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey + 5")
def _(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("i"), F.col("n_regionkey").alias("r"))
    cond = (F.col("i") != F.col("j")) & (F.col("r_pre") == F.col("r_post")) & (F.col("i") < F.col("j") + 5)
    return E.connect_condition(n, n, cond).select("i", "j")


@query("join_3_connect_range", "SELECT s_suppkey AS i, j FROM supplier, range(0, 200) r(j) WHERE j >= s_suppkey - 3 AND j < s_suppkey + 4 AND (j - (s_suppkey - 3)) % 2 = 0 AND j < 100 AND j <> s_suppkey")
def _(spark, sf_dir):
    n = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"))
    return E.connect_range(n, F.col("i") - 3, F.col("i") + 4, 2, 100, F.col("j") != F.col("i"))


@query("join_4_connect_sample", f"SELECT id AS i, x AS j FROM {chosen_sql('(SELECT s_suppkey AS id FROM supplier)', 500, 5, 3)}")
def _(spark, sf_dir):
    return E.connect_sample(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i")), 500, 5, 3)


@query("join_5_one_to_one", "SELECT s_suppkey AS i, c_custkey AS j FROM supplier JOIN customer ON s_suppkey = c_custkey")
def _(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"))
    return E.connect_one_to_one(a, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"))).select("i", "j")


@query("join_6_connect_equal", "SELECT s_suppkey AS i, c_custkey AS j FROM supplier JOIN customer ON s_suppkey % 50 = c_custkey % 70")
def _(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"))
    return E.connect_condition(a, b, F.col("i") % 50 == F.col("j") % 70).select("i", "j")


@query("join_7_pre_post_gather", "SELECT l_orderkey, l_linenumber, s_acctbal AS v_pre, p_retailprice AS v_post, round(s_acctbal * p_retailprice, 4) AS product FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey")
def _(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"))
    pre = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("v"))
    post = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.col("p_retailprice").alias("v"))
    return E.gather(edges, pre, post).select("l_orderkey", "l_linenumber", "v_pre", "v_post", F.round(F.col("v_pre") * F.col("v_post"), 4).alias("product"))


@query("join_8_linked", "SELECT c_custkey AS i, s_acctbal AS v_linked FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey % 120")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), (F.col("c_custkey") % 120).alias("at"))
    target = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("v"))
    return E.linked(rows, target, "at", ["v"]).select("i", "v_linked")


@query("join_10_as_of", f"""
    WITH e AS (SELECT * FROM {EV} x)
    SELECT p.event_id, h.value AS held FROM (SELECT * FROM e WHERE event_type = 'purchase') p ASOF LEFT JOIN
    (SELECT i, t, max(value) AS value FROM e WHERE event_type = 'view' GROUP BY i, t) h ON p.i = h.i AND p.t >= h.t""")
def _(spark, sf_dir):
    rows = stream(spark, sf_dir)
    held = rows.filter("event_type = 'view'").groupBy("i", "t").agg(F.max("value").alias("held"))
    return R.as_of(rows.filter("event_type = 'purchase'"), held, "i", "t", "held").select("event_id", "held")


@query("join_12_semi", f"SELECT s_suppkey AS i FROM supplier WHERE s_suppkey IN (SELECT i FROM {EV} e WHERE value > 90)")
def _(spark, sf_dir):
    fired = D.threshold(stream(spark, sf_dir), F.col("value") > 90)
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i")).join(fired, "i", "left_semi")


@query("win_2_multisynaptic_index", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber) - 1 AS k FROM lineitem")
def _(spark, sf_dir):
    out = E.number_duplicates(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_partkey"], ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", F.col("k").cast("bigint").alias("k"))


@query("sort_5_delivery_order", "SELECT o_orderkey AS seq, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_custkey, o_orderkey) - 1 AS rank FROM orders")
def _(spark, sf_dir):
    edges = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("j"), F.col("o_custkey").alias("i"), F.col("o_totalprice").alias("delay"), F.col("o_orderkey").alias("seq"))
    return E.delivery_order(edges).select("seq", F.col("rank").cast("bigint").alias("rank"))


@query("set_2_append_edges", "SELECT o_custkey AS i, o_orderkey AS j FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT l_suppkey, l_partkey FROM lineitem WHERE l_quantity > 49")
def _(spark, sf_dir):
    a = order_edges(spark, sf_dir).filter("w > 300000").select("i", "j")
    b = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"))
    return E.append(a, b)


@query("edg_9_out_of_range", "SELECT l_suppkey AS i, l_partkey AS j FROM lineitem WHERE l_suppkey >= 90 OR l_partkey >= 1900")
def _(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"))
    return E.out_of_range(edges, 90, 1900)


# --- aggregates -----------------------------------------------------------------------------------------------


@query("agg_1_summed_variable", """
    SELECT p_partkey AS i, round(coalesce(sum(l_quantity * s_acctbal), 0), 2) AS total FROM part
    LEFT JOIN (lineitem JOIN supplier ON s_suppkey = l_suppkey AND l_returnflag = 'R') ON l_partkey = p_partkey GROUP BY 1""")
def _(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), "l_quantity")
    pre = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("v"))
    targets = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"))
    out = D.summed(E.gather(edges, pre), targets, F.col("l_quantity") * F.col("v_pre"))
    return out.select("i", F.round("total", 2).alias("total"))


@query("agg_3_scatter_product", "SELECT l_partkey AS j, round(product(1 + l_tax), 9) AS factor FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("j"), "l_tax")
    return D.deliver_product(rows, 1 + F.col("l_tax"), ("j",)).select("j", F.round("factor", 9).alias("factor"))


@query("agg_4_scatter_last", "SELECT l_partkey AS j, arg_max(l_extendedprice, l_orderkey * 100 + l_linenumber) AS assigned FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("seq", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    return D.deliver_last(rows.withColumnRenamed("l_partkey", "j"), F.col("l_extendedprice"), "seq", ("j",))


@query("agg_5_degree", "SELECT p_partkey AS i, count(l_orderkey) AS degree FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 45 GROUP BY 1")
def _(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"))
    return E.degrees(edges, "j", table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i")))


@query("agg_6_event_counts", f"SELECT u.i, count(e.event_id) AS n FROM {USERS} u LEFT JOIN {EV} e ON e.i = u.i AND e.value > 30 GROUP BY 1")
def _(spark, sf_dir):
    return R.counts(stream(spark, sf_dir).filter("value > 30"), users(spark, sf_dir))


@query("agg_7_total_events", f"SELECT count(*) AS n FROM {EV} e")
def _(spark, sf_dir):
    return R.total(stream(spark, sf_dir))


@query("agg_8_trains", f"SELECT i, array_to_string(list(event_id ORDER BY t, event_id), ',') AS train FROM {EV} e GROUP BY 1")
def _(spark, sf_dir):
    return R.trains(stream(spark, sf_dir), "event_id").select("i", F.array_join("values", ",").alias("train"))


def last(spark, sf_dir, width: int) -> int:
    """The bin, of so many seconds, of the table's last event; one number on the driver."""
    return stream(spark, sf_dir).agg(F.floor(F.max("tick") / width).alias("last")).first()["last"]


DAYS = f"(SELECT unnest(range(0, (SELECT max(tick) // 86400 + 1 FROM {EV} m))) AS bin)"


@query("agg_9_binned_rate", f"""
    SELECT u.i, b.bin, coalesce(n, 0) / 86400.0::DOUBLE AS rate FROM {USERS} u CROSS JOIN {DAYS} b
    LEFT JOIN (SELECT i, tick // 86400 AS bin, count(*) AS n FROM {EV} e GROUP BY ALL) c ON c.i = u.i AND c.bin = b.bin""")
def _(spark, sf_dir):
    return R.binned_rate(stream(spark, sf_dir), users(spark, sf_dir), last(spark, sf_dir, 86400) + 1, 86400, 1.0)


def hourly(spark, sf_dir):
    """The population's rate in ticks of one hour, of as many nodes and hours as the table has."""
    events = stream(spark, sf_dir).withColumn("tick", F.floor(F.col("tick") / 3600))
    return R.population_rate(spark, events, users(spark, sf_dir).count(), 0, last(spark, sf_dir, 3600) + 1, 3600.0)


HOURLY = f"""(SELECT h AS tick, coalesce(n, 0) / (3600.0::DOUBLE * (SELECT count(*) FROM {USERS} u)) AS rate
    FROM (SELECT unnest(range(0, (SELECT max(tick) // 3600 + 1 FROM {EV} m))) AS h)
    LEFT JOIN (SELECT tick // 3600 AS k, count(*) AS n FROM {EV} e GROUP BY 1) ON k = h)"""


@query("snk_5_population_rate", f"SELECT tick, rate FROM {HOURLY} h")
def _(spark, sf_dir):
    return hourly(spark, sf_dir)


@query("agg_10_binned_population_rate", f"SELECT tick // 24 AS bin, round(avg(rate), 12) AS rate FROM {HOURLY} h GROUP BY 1 HAVING count(*) = 24")
def _(spark, sf_dir):
    return R.binned_population_rate(hourly(spark, sf_dir), 24).select("bin", F.round("rate", 12).alias("rate"))


@query("agg_11_population_statistics", f"""
    SELECT round(avg(r), 9) AS mean, round(stddev_pop(r), 9) AS std, round(quantile_cont(r, 0.25), 9) AS q25, round(quantile_cont(r, 0.5), 9) AS q50,
           round(quantile_cont(r, 0.75), 9) AS q75, round(avg(CASE WHEN r = 0 THEN 1.0::DOUBLE ELSE 0 END), 9) AS silent
    FROM (SELECT u.i, count(e.event_id) / 30.0::DOUBLE AS r FROM {USERS} u LEFT JOIN {EV} e ON e.i = u.i AND value > 60 GROUP BY 1)""")
def _(spark, sf_dir):
    out = R.population_statistics(R.counts(stream(spark, sf_dir).filter("value > 60"), users(spark, sf_dir)), 30.0)
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query("agg_12_lvr", f"""
    WITH a AS (SELECT i, t, t - lag(t) OVER w AS isi FROM {EV} e WINDOW w AS (PARTITION BY i ORDER BY t)),
    b AS (SELECT i, isi, lag(isi) OVER (PARTITION BY i ORDER BY t) AS prev FROM a WHERE isi IS NOT NULL)
    SELECT i, round(3 * avg((1 - 4 * isi * prev / ((isi + prev) * (isi + prev))) * (1 + 20 / (isi + prev))), 6) AS lvr, count(*) AS pairs
    FROM b WHERE prev IS NOT NULL AND isi + prev > 0 GROUP BY 1""")
def _(spark, sf_dir):
    return R.lvr(stream(spark, sf_dir), 5.0).select("i", F.round("lvr", 6).alias("lvr"), "pairs")


@query("agg_13_mean_correlation", f"""
    WITH c AS (SELECT u.i, b.bin, coalesce(n, 0)::DOUBLE AS n FROM {USERS} u CROSS JOIN {DAYS} b
        LEFT JOIN (SELECT i, tick // 86400 AS bin, count(*) AS n FROM {EV} e GROUP BY ALL) k ON k.i = u.i AND k.bin = b.bin),
    z AS (SELECT bin, (n - avg(n) OVER w) / sqrt(var_pop(n) OVER w * count(*) OVER w) AS z FROM c WINDOW w AS (PARTITION BY i)),
    s AS (SELECT sum(z) AS s FROM z GROUP BY bin), m AS (SELECT count(DISTINCT i) AS nodes FROM c)
    SELECT round((sum(s * s) - nodes) / (nodes * (nodes - 1)), 9) AS correlation, nodes FROM s, m GROUP BY nodes""")
def _(spark, sf_dir):
    nodes = users(spark, sf_dir)
    binned = R.binned_rate(stream(spark, sf_dir), nodes, last(spark, sf_dir, 86400) + 1, 86400, 1 / 86400).withColumnRenamed("rate", "n")
    return R.mean_correlation(binned).select(F.round("correlation", 9).alias("correlation"), "nodes")


@query("agg_14_histogram", f"SELECT tick // 7200 AS bin, count(*) AS n FROM {EV} e GROUP BY 1")
def _(spark, sf_dir):
    return R.histogram(stream(spark, sf_dir), 7200)


@query("agg_15_reductions", "SELECT l_returnflag, round(sum(l_tax), 6) AS s, round(avg(l_quantity), 6) AS a, min(l_discount) AS lo, max(l_discount) AS hi, max(l_quantity) - min(l_quantity) AS ptp, round(stddev_pop(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS var FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.sum("l_tax"), 6).alias("s"), F.round(F.avg("l_quantity"), 6).alias("a"), F.min("l_discount").alias("lo"),
        F.max("l_discount").alias("hi"), reductions.ptp(F.col("l_quantity")).alias("ptp"),
        F.round(F.stddev_pop("l_quantity"), 6).alias("sd"), F.round(F.var_pop("l_quantity"), 6).alias("var"),
    )


@query("agg_16_fused_sums", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q, round(sum(l_extendedprice), 2) AS p, round(sum(l_extendedprice * (1 - l_discount)), 2) AS d FROM lineitem GROUP BY 1, 2")
def _(spark, sf_dir):
    out = D.fused_sums(
        table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], q=F.col("l_quantity"), p=F.col("l_extendedprice"),
        d=F.col("l_extendedprice") * (1 - F.col("l_discount")),
    )
    return out.select("l_returnflag", "l_linestatus", *[F.round(c, 2).alias(c) for c in "qpd"])


@query("agg_18_invalid_values", "SELECT count(*) FILTER (isnan(ln(l_tax + 1)) OR l_tax > 1e50) AS l_tax, count(*) FILTER (l_quantity > 1e50) AS l_quantity FROM lineitem")
def _(spark, sf_dir):
    return R.invalid(table(spark, sf_dir, "lineitem"), ["l_tax", "l_quantity"])


# --- windows --------------------------------------------------------------------------------------------------


@query("win_3_smooth_flat", f"SELECT tick, round(sum(rate) OVER (ORDER BY tick ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7.0, 12) AS smooth FROM {HOURLY} h")
def _(spark, sf_dir):
    return R.smooth(hourly(spark, sf_dir), "flat", 7, block=200).select("tick", F.round("smooth", 12).alias("smooth"))


@query("win_4_smooth_gaussian", f"""
    WITH w AS (SELECT d, exp(-(d * d) / 18.0::DOUBLE) / sum(exp(-(d * d) / 18.0::DOUBLE)) OVER () AS weight FROM range(-6, 7) r(d))
    SELECT a.tick, round(sum(b.rate * weight), 12) AS smooth FROM {HOURLY} a CROSS JOIN w JOIN {HOURLY} b ON b.tick = a.tick + d GROUP BY 1""")
def _(spark, sf_dir):
    return R.smooth(hourly(spark, sf_dir), "gaussian", 3, block=200).select("tick", F.round("smooth", 12).alias("smooth"))


@query("win_7_intervals", f"SELECT * FROM (SELECT event_id, round(t - lag(t) OVER (PARTITION BY i ORDER BY t), 6) AS isi FROM {EV} e) WHERE isi IS NOT NULL")
def _(spark, sf_dir):
    return R.intervals(stream(spark, sf_dir)).select("event_id", F.round("isi", 6).alias("isi"))


@query("win_8_last_event", f"SELECT i, max(t) AS last FROM {EV} e GROUP BY 1")
def _(spark, sf_dir):
    return R.last_event(stream(spark, sf_dir))


@query("win_9_exponential_trace", f"""
    WITH e AS (SELECT * FROM {EV} x)
    SELECT a.event_id, round(sum(b.value * exp((b.t - a.t) / 20000.0::DOUBLE)), 6) AS trace
    FROM e a JOIN e b ON a.i = b.i AND b.t <= a.t GROUP BY 1""")
def _(spark, sf_dir):
    rows = stream(spark, sf_dir)
    return R.exponential_trace(rows, 20000.0, F.col("value"), block=30.0).select("event_id", F.round("trace", 6).alias("trace"))


@query("win_10_cumulative", f"SELECT event_id, count(*) OVER (PARTITION BY i ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS n FROM {EV} e")
def _(spark, sf_dir):
    return stream(spark, sf_dir).select("event_id", reductions.running_count(["t", "event_id"], ("i",)).alias("n"))


@query("win_11_observation_window", f"SELECT event_id FROM {EV} e WHERE tick >= 86400 AND tick < 172800")
def _(spark, sf_dir):
    return stream(spark, sf_dir).filter("tick >= 86400 AND tick < 172800").select("event_id")


@query("str_7_requantised", f"SELECT event_id, CAST(floor(tick * 1.0::DOUBLE / 7.0 + 0.5) AS BIGINT) AS due FROM {EV} e")
def _(spark, sf_dir):
    rows = stream(spark, sf_dir).select("event_id", F.col("tick").alias("due"))
    return D.requantised(rows, 1.0, 7.0)


@query("str_13_late_drop", f"SELECT event_id FROM {EV} e WHERE tick >= 604800")
def _(spark, sf_dir):
    return D.drop_late(stream(spark, sf_dir), 604800).select("event_id")


# --- dynamics -------------------------------------------------------------------------------------------------


def decay(method: str):
    def run(spark, sf_dir):
        g = Group(1, "dv/dt = (10 - v)/(20*ms) : 1", method=method)
        rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), (F.col("s_acctbal") / 100).alias("v"))
        rows = rows.withColumns({"lastspike": F.lit(-1e4), "not_refractory": F.lit(True)})
        return g.fold(rows, 50, 1e-3).select("i", F.round("v", 6).alias("v"))

    return run


def decay_sql(factor: str) -> str:
    return f"SELECT s_suppkey AS i, round(10 + (s_acctbal / 100 - 10) * power({factor}, 50), 6) AS v FROM supplier"


query("int_1_exact", decay_sql("exp(-0.05::DOUBLE)"))(decay("exact"))
query("int_3_exponential_euler", decay_sql("exp(-0.05::DOUBLE)"))(decay("exponential_euler"))
query("int_4_euler", decay_sql("(1 - 0.05::DOUBLE)"))(decay("euler"))
query("int_5_rk2", decay_sql("(1 - 0.05::DOUBLE + 0.05::DOUBLE * 0.05::DOUBLE / 2)"))(decay("rk2"))
query("int_6_rk4", decay_sql("(1 - 0.05::DOUBLE + power(0.05::DOUBLE, 2) / 2 - power(0.05::DOUBLE, 3) / 6 + power(0.05::DOUBLE, 4) / 24)"))(decay("rk4"))
query("int_7_heun", decay_sql("(1 - 0.05::DOUBLE + 0.05::DOUBLE * 0.05::DOUBLE / 2)"))(decay("heun"))


@query("lif_spikes", """
    WITH RECURSIVE r AS (
        SELECT s_suppkey AS i, 0 AS tick, 0.0::DOUBLE AS v, 1.1::DOUBLE + s_suppkey % 10 * 0.1::DOUBLE AS drive, false AS fired FROM supplier
        UNION ALL
        SELECT i, tick + 1, CASE WHEN v + 0.1::DOUBLE * (drive - v) > 1 THEN 0.0 ELSE v + 0.1::DOUBLE * (drive - v) END, drive,
               v + 0.1::DOUBLE * (drive - v) > 1 FROM r WHERE tick < 200)
    SELECT i, CAST(tick - 1 AS BIGINT) AS tick FROM r WHERE fired""")
def _(spark, sf_dir):
    g = Group(1, "dv/dt = (drive - v)/(10*ms) : 1\ndrive : 1", method="euler", threshold="v > 1", reset="v = 0")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), F.lit(0.0).alias("v"), (F.lit(1.1) + F.col("s_suppkey") % 10 * F.lit(0.1)).alias("drive"))
    rows = rows.withColumns({"lastspike": F.lit(-1e4), "not_refractory": F.lit(True)})
    return spikes(g.fold(rows, 200, 1e-3))


@query("snk_3_state_trace", """
    SELECT s_suppkey AS i, CAST(k * 10 AS BIGINT) AS tick, round(power(0.95::DOUBLE, k * 10) * s_acctbal, 6) AS v FROM supplier, range(5) r(k)""")
def _(spark, sf_dir):
    g = Group(1, "dv/dt = -v/(20*ms) : 1", method="euler")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("v"))
    rows = rows.withColumns({"lastspike": F.lit(-1e4), "not_refractory": F.lit(True)})
    return traces(g.fold(rows, 50, 1e-3, record=("v",), every=10)).select("i", "tick", F.round("v", 6).alias("v"))


@query("prj_15_refractory_filter", f"""
    WITH RECURSIVE o AS (SELECT i, t, event_id, row_number() OVER (PARTITION BY i ORDER BY t, event_id) AS k FROM {EV} e),
    r AS (SELECT i, k, event_id, t AS last, true AS keep FROM o WHERE k = 1 UNION ALL
        SELECT o.i, o.k, o.event_id, CASE WHEN o.t - r.last >= 40000 THEN o.t ELSE r.last END, o.t - r.last >= 40000 FROM r JOIN o ON o.i = r.i AND o.k = r.k + 1)
    SELECT i, event_id FROM r WHERE keep""")
def _(spark, sf_dir):
    from ..streaming.stateful import refractory

    return refractory(stream(spark, sf_dir), 40000.0).select("i", "event_id")


@query("str_9_stdp")
def _(spark, sf_dir):
    rows = stream(spark, sf_dir)
    edges = order_edges(spark, sf_dir).select("i", (F.col("j") % 150).alias("j"), F.col("j").alias("seq"), F.lit(0.5).alias("w"))
    return stdp(rows.filter("event_type = 'view'"), rows.filter("event_type = 'purchase'"), edges, 20000.0, 20000.0, 0.1, -0.105, 0.0, 1.0)


# --- monitors -------------------------------------------------------------------------------------------------


@query("snk_1_event_monitor", f"SELECT tick, i, max(value) AS value FROM {EV} e WHERE value > 70 AND i >= 10 AND i < 120 GROUP BY ALL")
def _(spark, sf_dir):
    from ..operators.monitors import event_monitor

    rows = stream(spark, sf_dir)
    values = rows.groupBy("tick", "i").agg(F.max("value").alias("value"))
    fired = D.threshold(values.select("tick", "i", "value"), F.col("value") > 70)
    return event_monitor(fired, values, ("value",), 10, 120)


@query("snk_6_states", "SELECT s_suppkey AS i, s_acctbal AS v, s_acctbal * 2 AS twice FROM supplier")
def _(spark, sf_dir):
    from ..operators.monitors import states

    g = Group(1, "v : 1\ntwice = 2*v : 1")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("v"))
    return states(rows, ("v", "twice"), {"twice": g.column("twice")})


@query("snk_13_rebuilt", """
    SELECT s_suppkey AS i, CAST(k * 10 AS BIGINT) AS tick, round(power(0.95::DOUBLE, k * 10) * s_acctbal * 3 + 1, 5) AS current FROM supplier, range(5) r(k)""")
def _(spark, sf_dir):
    from ..operators.monitors import rebuilt, state_monitor

    g = Group(1, "dv/dt = -v/(20*ms) : 1", method="euler")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("v"))
    rows = rows.withColumns({"lastspike": F.lit(-1e4), "not_refractory": F.lit(True)})
    kept = state_monitor(traces(g.fold(rows, 50, 1e-3, record=("v",))), ("v",), 10)
    return rebuilt(kept, {"current": F.round(F.col("v") * 3 + 1, 5)}).select("i", "tick", "current")


# --- sets, samples, sweeps, trees, training -------------------------------------------------------------------


@query("set_1_intersect", "SELECT o_custkey AS i, o_orderkey AS j FROM orders WHERE o_custkey % 3 = 0 AND o_totalprice > 100000")
def _(spark, sf_dir):
    edges = order_edges(spark, sf_dir)
    pairs = edges.filter("i % 3 = 0").select("i", "j")
    return pairs.intersect(edges.filter("w > 100000").select("i", "j"))


@query("set_3_distinct_ids", "SELECT DISTINCT user_id AS i FROM events WHERE event_type = 'error'")
def _(spark, sf_dir):
    return stream(spark, sf_dir).filter("event_type = 'error'").select("i").distinct()


@query("sort_1_event_order", f"SELECT event_id, row_number() OVER (PARTITION BY tick // 86400 ORDER BY t, i, event_id) AS place FROM {EV} e")
def _(spark, sf_dir):
    rows = stream(spark, sf_dir).withColumn("day", F.floor(F.col("tick") / 86400))
    return reductions.argsort(rows, ["t", "i", "event_id"], ("day",)).select("event_id", "place")


@query("lim_1_bounded_sample", "SELECT c_custkey AS i FROM (SELECT *, md5(CAST(c_custkey AS VARCHAR)) AS h FROM customer) ORDER BY h LIMIT 200")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"))
    return rows.orderBy(F.md5(F.col("i").cast("string"))).limit(200)


@query("prj_9_run_regularly", "SELECT s_suppkey AS i, s_acctbal * power(0.5::DOUBLE, 5) AS v FROM supplier")
def _(spark, sf_dir):
    from ..operators.group import run_regularly

    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("v"))
    for tick in range(50):
        rows = run_regularly(rows, tick, 10, {"v": F.col("v") * 0.5})
    return rows


@query("win_6_smooth_per_cell", f"""
    WITH d AS (SELECT u.i, b.bin AS tick, coalesce(n, 0)::DOUBLE / 86400.0::DOUBLE AS rate FROM {USERS} u CROSS JOIN {DAYS} b
        LEFT JOIN (SELECT i, tick // 86400 AS k, count(*) AS n FROM {EV} e GROUP BY ALL) c ON c.i = u.i AND c.k = b.bin)
    SELECT i, tick, round(0.25 * coalesce(lag(rate) OVER w, 0) + 0.5 * rate + 0.25 * coalesce(lead(rate) OVER w, 0), 12) AS smooth
    FROM d WINDOW w AS (PARTITION BY i ORDER BY tick)""")
def _(spark, sf_dir):
    binned = R.binned_rate(stream(spark, sf_dir), users(spark, sf_dir), last(spark, sf_dir, 86400) + 1, 86400, 1.0).withColumnRenamed("bin", "tick")
    return R.smooth(binned, [1.0, 2.0, 1.0], by=("i",)).select("i", "tick", F.round("smooth", 12).alias("smooth"))


@query("agg_20_class_codes", f"SELECT i, arg_max(event_type, n * 1000 - code) AS winner FROM (SELECT i, event_type, count(*) AS n, CAST(length(event_type) AS BIGINT) * 10 + ascii(event_type) AS code FROM {EV} e GROUP BY ALL) GROUP BY 1")
def _(spark, sf_dir):
    n = stream(spark, sf_dir).groupBy("i", "event_type").agg(F.count("*").alias("n"))
    code = F.length("event_type") * 10 + F.ascii("event_type")
    return n.groupBy("i").agg(F.max_by("event_type", F.col("n") * 1000 - code).alias("winner"))


@query("agg_21_cross_entropy", f"""
    WITH n AS (SELECT i, event_type, count(*) / 30.0::DOUBLE AS x FROM {EV} e GROUP BY ALL),
    z AS (SELECT i, event_type, x, ln(sum(exp(x)) OVER (PARTITION BY i)) AS z FROM n)
    SELECT round(avg(z - x), 9) AS loss, count(*) AS rows FROM z WHERE event_type = 'click'""")
def _(spark, sf_dir):
    from pyspark.sql import Window

    n = stream(spark, sf_dir).groupBy("i", "event_type").agg((F.count("*") / F.lit(30.0)).alias("x"))
    z = F.log(F.sum(F.exp("x")).over(Window.partitionBy("i")))
    return n.withColumn("z", z).filter("event_type = 'click'").agg(
        F.round(F.avg(F.col("z") - F.col("x")), 9).alias("loss"), F.count("*").alias("rows")
    )


@query("ctl_8_parameter_sweep", "SELECT CAST(r AS INTEGER) AS run_id, s_suppkey AS i, round(s_acctbal * power(1 - 0.001::DOUBLE / ((r + 1) * 0.01::DOUBLE), 20), 6) AS v FROM supplier, range(3) q(r)")
def _(spark, sf_dir):
    from .control import sweep

    g = Group(1, "dv/dt = -v/tau : 1\ntau : second", method="euler")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("v"), F.lit(0.0).alias("tau"))
    rows = sweep(rows, [{"tau": 0.01}, {"tau": 0.02}, {"tau": 0.03}])
    rows = rows.withColumns({"lastspike": F.lit(-1e4), "not_refractory": F.lit(True), "_i": F.col("i"), "i": F.col("i") * 3 + F.col("run_id")})
    out = g.fold(rows, 20, 1e-3)
    return out.select((F.col("i") % 3).cast("int").alias("run_id"), F.floor(F.col("i") / 3).alias("i"), F.round("v", 6).alias("v"))


@query("int_10_adaptive", "SELECT s_suppkey AS i, round(s_acctbal * exp(-0.5::DOUBLE), 2) AS v FROM supplier")
def _(spark, sf_dir):
    from .integrators import adaptive

    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("v"))

    def solve(parts):
        for rows in parts:
            x = adaptive(lambda y, t, at: -y * t, rows[["v"]].to_numpy().T.copy(), 0.0, 1.0, 1e-9)
            yield rows.assign(v=x[0])

    return rows.mapInPandas(solve, "i long, v double").select("i", F.round("v", 2).alias("v"))


@query("int_10_adaptive_methods", """
    SELECT method, i, round((i % 10) / 10.0 * exp(-0.5::DOUBLE), 3) AS v
    FROM (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier), (VALUES ('gsl'), ('gsl_rk2'), ('gsl_rk4'), ('gsl_rkck'), ('gsl_rkf45')) m(method)""")
def _(spark, sf_dir):
    from ..operators.group import Group
    from .integrators import ADAPTIVE

    def solved(method: str):
        group = Group(table(spark, sf_dir, "supplier").count(), "dv/dt = -v*t/second**2 : 1", method=method).set("v", "(i % 10)/10")
        return group.fold(group.table(spark), 1, 1.0).select(F.lit(method).alias("method"), "i", F.round("v", 3).alias("v"))

    return reduce(DataFrame.unionByName, map(solved, sorted(ADAPTIVE)))


def tree(spark, sf_dir):
    """The parts as points of a binary tree."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.cast("int").alias("index"), (F.col("p_size") % 3).alias("type"), (k % 17).cast("double").alias("x"), (k % 5).cast("double").alias("y"),
        F.lit(0.0).alias("z"), F.lit(1.0).alias("radius"), F.when(k == 1, -1).otherwise(F.floor(k / 2)).cast("int").alias("parent"),
    ).filter("index >= 1")


@query("spa_4_geometry", """
    SELECT CAST(a.p_partkey AS INTEGER) AS i, round(sqrt(power(a.p_partkey % 17 - (a.p_partkey // 2) % 17, 2) + power(a.p_partkey % 5 - (a.p_partkey // 2) % 5, 2)), 9) AS length,
           round(2 * pi() * sqrt(power(a.p_partkey % 17 - (a.p_partkey // 2) % 17, 2) + power(a.p_partkey % 5 - (a.p_partkey // 2) % 5, 2)), 6) AS area
    FROM part a WHERE a.p_partkey > 1""")
def _(spark, sf_dir):
    from ..operators.morphology import compartments

    return compartments(tree(spark, sf_dir)).select("i", F.round("length", 9).alias("length"), F.round("area", 6).alias("area"))


@query("spa_5_path_distance", """
    WITH RECURSIVE r AS (SELECT CAST(1 AS BIGINT) AS i, 0.0::DOUBLE AS distance UNION ALL
        SELECT p_partkey, r.distance + sqrt(power(p_partkey % 17 - r.i % 17, 2) + power(p_partkey % 5 - r.i % 5, 2)) FROM r JOIN part ON p_partkey // 2 = r.i AND p_partkey > 1)
    SELECT CAST(i AS INTEGER) AS i, round(distance, 6) AS distance FROM r WHERE i > 1""")
def _(spark, sf_dir):
    from ..operators.morphology import compartments, path_distance

    return path_distance(compartments(tree(spark, sf_dir))).select("i", F.round("distance", 6).alias("distance"))


@query("int_13_cable")
def _(spark, sf_dir):
    from ..operators.morphology import cable, compartments

    parts = compartments(tree(spark, sf_dir)).withColumns(
        {"neuron": F.col("type").cast("bigint"), "v": F.lit(0.0), "current": F.when(F.col("i") < 10, 1.0).otherwise(0.0), "i": F.col("i").cast("bigint"),
         "length": F.greatest("length", F.lit(0.5))}
    )
    return cable(parts, 50, 0.1, 1.0, 1.0, 0.1)


@query("trn_7_gradients")
def _(spark, sf_dir):
    from ..operators.training import Model, Plan, gradients

    rows = stream(spark, sf_dir).select(
        F.col("i").alias("sample"), (F.col("i") % 3).cast("int").alias("label"), (F.col("tick") % 10).cast("int").alias("tick"),
        (F.col("event_id") % 8).cast("int").alias("input"), F.lit(1.0).alias("amplitude"),
    )
    return gradients(rows, Model(Plan((8, 6, 3), 10)))


@query("cnv_6_quantised", "SELECT l_orderkey, l_linenumber, CAST(least(greatest(round_even(l_tax * 1000, 0), -20), 50) AS INTEGER) AS q FROM lineitem")
def _(spark, sf_dir):
    from ..operators.training import quantised

    rows = table(spark, sf_dir, "lineitem").withColumn("w", F.col("l_tax"))
    return quantised(rows, 1000.0, -20, 50).select("l_orderkey", "l_linenumber", "q")


@query("str_5_network_run")
def _(spark, sf_dir):
    """A recurrent network in supersteps; its events."""
    from ..operators.network import Network, Pathway

    g = Group(100, "dv/dt = (drive - v)/(10*ms) : 1 (unless refractory)\ndrive : 1", method="euler", threshold="v > 1", reset="v = 0", refractory="2*ms")
    g.set("drive", "1.2 + 0.01*i").set("v", "i*0.008")
    edges = T.fixed_indegree_edges(spark, 5, 100, 100, 1).withColumns({"seq": F.col("j") * 1000 + F.col("i"), "w": F.lit(0.02)})
    return Network(g, edges, [Pathway("v", "w", 5e-3)], shards=4).run(spark, 0.02, 1e-3).spikes()


from . import networks  # noqa: E402, F401  registers its queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
