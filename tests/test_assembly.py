"""Networks of several groups with synapses' own state and code, against loops."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators.assembly import Assembly, Clocked, Linked, Stop, Synapses, Way, edge_rows, of_kind
from sparkloom.operators.group import Group, spikes
from sparkloom.operators.network import Network, Pathway, relational
from sparkloom.plans.equations import EquationError, Equations

DT = 1e-3


def edges_of(spark, rows, name="s", columns=("w",)):
    kinds = ", ".join(f"{c} double" for c in columns)
    return edge_rows(spark.createDataFrame(rows, "seq long, i long, j long" + (f", {kinds}" if kinds else "")), name, columns)


def states(out, name):
    return {(r["object"], r["i"]): r["value"] for r in of_kind(out, "state", name).collect()}


def events(out):
    return sorted((r["object"], r["tick"], r["i"]) for r in of_kind(out, "event").collect())


def clock(name="a", n=2, period="i + 2"):
    """Rows that fire every few ticks."""
    return Group(n, "c : 1\nlate : 1", threshold=f"(t/(1*ms) + 0.5)//1 % ({period}) == 0", name=name)


def test_pathways_change_edges_and_ends(spark):
    a, b = clock(), Group(3, "v : 1\nm : 1\nlast : 1", name="b").set("m", 1)
    s = Synapses("s", "a", "b", "w : 1\nn : 1", {"pre": Way("v_post += w; m_post *= 2; last_post = i + 1; n += 1; w *= 1.5", delay=2e-3)})
    rows = [(0, 0, 0, 1.0), (1, 1, 0, 10.0), (2, 1, 2, 100.0)]
    got = Assembly([a, b], [s]).run(Assembly([a, b], [s]).nodes(spark), edges_of(spark, rows), 9, DT)
    w, v, m, last, n = {0: 1.0, 1: 10.0, 2: 100.0}, [0.0] * 3, [1.0] * 3, [0.0] * 3, dict.fromkeys(range(3), 0)
    for k in range(9):
        due = [(q, i, j) for q, i, j, _ in rows if k >= 2 and (k - 2) % (i + 2) == 0]
        for q, i, j in due:
            v[j], m[j], last[j], n[q] = v[j] + w[q], m[j] * 2, i + 1, n[q] + 1
        for q, *_ in due:
            w[q] *= 1.5
    assert [states(got, "v")["b", j] for j in range(3)] == pytest.approx(v)
    assert [states(got, "m")["b", j] for j in range(3)] == m and [states(got, "last")["b", j] for j in range(3)] == last
    assert {q: states(got, "w")["s", q] for q in w} == pytest.approx(w) and {q: states(got, "n")["s", q] for q in n} == n


def test_stdp_as_pathways(spark):
    a, b = clock("a", 1, "3"), clock("b", 1, "4")
    s = Synapses("s", "a", "b", "w : 1\ndx/dt = -x/(5*ms) : 1 (event-driven)\ndy/dt = -y/(7*ms) : 1 (event-driven)",
                 {"pre": Way("x += 0.1; w = clip(w + y, 0, 1)"), "post": Way("y -= 0.12; w = clip(w + x, 0, 1)", "post")})
    plan = Assembly([a, b], [s])
    got = plan.run(plan.nodes(spark), edges_of(spark, [(0, 0, 0, 0.5)]), 40, DT)
    w, x, y, last = 0.5, 0.0, 0.0, 0.0
    for k in range(40):
        for side in [z for z, every in (("pre", 3), ("post", 4)) if k % every == 0]:
            gone = k * DT - last
            x, y, last = x * math.exp(-gone / 5e-3), y * math.exp(-gone / 7e-3), k * DT
            x, y = (x + 0.1, y) if side == "pre" else (x, y - 0.12)
            w = min(1.0, max(0.0, w + (y if side == "pre" else x)))
    assert states(got, "w")["s", 0] == pytest.approx(w)


def test_summed_clock_driven_and_synapses_on_synapses(spark):
    a, b = Group(2, "u : 1", name="a").set("u", "i + 1"), Group(2, "g : 1\ndv/dt = g/second : 1", method="euler", name="b")
    s = Synapses("s", "a", "b", "w : 1\ndq/dt = (u_pre - q)/(10*ms) : 1 (clock-driven)\ng_post = w*q : 1 (summed)", method="euler")
    c = clock("c", 1, "2")
    t = Synapses("t", "c", "s", "", {"pre": Way("w_post += 0.5")})
    plan = Assembly([a, b, c], [s, t])
    rows = edges_of(spark, [(0, 0, 0, 1.0), (1, 1, 0, 2.0), (2, 1, 1, 3.0)]).unionByName(edges_of(spark, [(0, 0, 1)], "t", ()))
    got = plan.run(plan.nodes(spark), rows, 6, DT)
    w, q, v = np.array([1.0, 2, 3]), np.zeros(3), np.zeros(2)
    for k in range(6):
        g = np.array([w[0] * q[0] + w[1] * q[1], w[2] * q[2]])
        v = v + DT * g
        q = q + DT * (np.array([1, 2, 2]) - q) / 0.01
        w[1] += 0.5 * (k % 2 == 0)
    assert [states(got, "v")["b", j] for j in range(2)] == pytest.approx(v) and states(got, "w")["s", 1] == w[1]


def test_clocked_code_events_links_and_operations(spark):
    g = Group(3, "x : 1\nseen : 1\nhits : 1\nlevel = 2*x : 1 (constant over dt)", threshold="x > 3", reset="x = 0", events={"low": "x < 2"}, name="g")
    h = Group(3, "y : 1 (linked)\nk : integer\nz : 1", name="h").set("k", "2 - i")
    stops = []

    def operation(tick, rows):
        stops.append(tick)
        if tick == 7:
            raise Stop

    plan = Assembly(
        [g, h],
        clocked=[Clocked("g", "x += 1 + i", every=2e-3), Clocked("g", "seen = level", at=(3e-3,)), Clocked("g", "hits += 1", event="low"), Clocked("h", "z = y", every=1e-3)],
        links=[Linked("h", "y", "g", "x", "k")], operations=[operation], record=("g.x", "g.level"), every=3,
    )
    got = plan.run(plan.nodes(spark), None, 50, DT)
    x, seen, hits, fired, z, traces = np.zeros(3), np.zeros(3), np.zeros(3), [], np.zeros(3), {}
    for k in range(7):
        y = x[[2, 1, 0]]
        if k % 2 == 0:
            x = x + [1, 2, 3]
        if k == 3:
            seen = 2 * x
        z = y
        if k % 3 == 0:
            traces |= {(k, i): (x[i], 2 * x[i]) for i in range(3)}
        spike, low = x > 3, x < 2
        fired += [("g", k, i) for i in np.flatnonzero(spike)] + [("g", k, i) for i in np.flatnonzero(low)]
        x = np.where(spike, 0, x)
        hits += low
    assert sorted(events(got)) == sorted(fired)
    for name, want in (("x", x), ("seen", seen), ("hits", hits)):
        assert [states(got, name)["g", i] for i in range(3)] == list(want), name
    assert [states(got, "z")["h", i] for i in range(3)] == list(z)
    rows = of_kind(got, "trace").collect()
    assert {(r["tick"], r["i"]): r["value"] for r in rows if r["name"] == "x"} == {k: v[0] for k, v in traces.items()}
    assert {(r["tick"], r["i"]): r["value"] for r in rows if r["name"] == "level"} == {k: v[1] for k, v in traces.items()}


def test_runs_are_apart_and_zero_delays_reach_the_same_tick(spark):
    a = Group(1, "dv/dt = (2 - v)/(10*ms) : 1", method="euler", threshold="v > 1", reset="v = 0", name="a")
    b = Group(1, "n : 1", name="b")
    plan = Assembly([a, b], [Synapses("s", "a", "b", "d : second", {"pre": Way("n_post += 1", delay="d")})])
    nodes = plan.nodes(spark, 3)
    rows = spark.createDataFrame([(r, 0, 0, 0, d) for r, d in ((0, 0.0), (1, 0.4e-3), (2, 1e-3))], "run long, seq long, i long, j long, d double")
    got = plan.run(nodes, edge_rows(rows, "s", ("d",), "run"), 8, DT)
    first = min(t for _, t, _ in events(got))
    n = {r["run"]: r["value"] for r in of_kind(got, "state", "n").collect()}
    count = {r: sum(1 for x in of_kind(got, "event").collect() if x["run"] == r) for r in range(3)}
    assert first == 6 and n == {0: count[0], 1: count[1], 2: sum(x["tick"] + 1 < 8 for x in of_kind(got, "event").collect() if x["run"] == 2)}
    net = Network(Group(1, "v : 1", threshold="v > 1"), spark.createDataFrame([(0, 0, 0, 0.0)], "seq long, i long, j long, d double"), [Pathway("v", "1", "d")])
    with pytest.raises(ValueError, match="shorter"):
        net.run(spark, 0.01, 1e-3)


def test_what_does_not_fit_is_refused(spark):
    with pytest.raises(EquationError, match="driven"):
        Synapses("s", "a", "b", "dx/dt = -x/(1*ms) : 1 (event-driven)\ndy/dt = x/second : 1 (clock-driven)")
    with pytest.raises(ValueError, match="did you mean"):
        Assembly([Group(1, "x : 1", name="abc")], [Synapses("s", "abc", "abd")])
    with pytest.raises(ValueError, match="same name"):
        Assembly([Group(1, "x : 1", name="a"), Group(1, "x : 1", name="a")])
    bad = Assembly([Group(1, "x : 1", name="a")], [Synapses("s", "a", "a")])
    with pytest.raises(Exception, match="no row"):
        bad.run(bad.nodes(spark), edges_of(spark, [(0, 0, 5)], columns=()), 2, DT).collect()
    empty = bad.nodes(spark).filter("false")
    assert bad.run(empty, None, 3, DT).count() == 0


def test_noise_is_the_same_in_every_mode(spark):
    text = "dv/dt = (1.2 - v)/(10*ms) + 0.3*xi_a/(10*ms)**0.5 + 0.1*xi_b/(10*ms)**0.5 : 1 (unless refractory)\nr : 1\nq : 1"
    g = Group(40, text, method="euler", threshold="v > 0.9 + 0.1*rand()", reset="v = 0; r = rand() - rand(); q += poisson(3)", refractory="2*ms", seed=5)
    g.set("v", "rand()")
    edges = spark.createDataFrame([(k, k, (7 * k) % 40, 0.02) for k in range(40)], "seq long, i long, j long, w double")
    quiet = edges.withColumn("w", F.lit(0.0))
    net = Network(g, quiet, [Pathway("v", "w", 2e-3)], shards=3).run(spark, 0.012, 1e-3)
    folded = g.fold(g.table(spark), 12, 1e-3)
    fired, last = relational(g, quiet, [Pathway("v", "w", 2e-3)], spark, 12, 1e-3)
    plan = Assembly([g])
    whole = plan.run(plan.nodes(spark), None, 12, 1e-3)
    want = sorted((r["tick"], r["i"]) for r in spikes(folded).collect())
    assert len(want) > 20
    assert want == sorted(map(tuple, net.spikes().collect())) == sorted(map(tuple, fired.collect())) == [(t, i) for _, t, i in events(whole)]
    for c in ("v", "r", "q"):
        a = {r["i"]: r[c] for r in folded.collect()}
        for other in ({r["i"]: r[c] for r in net.state.collect()}, {r["i"]: r[c] for r in last.collect()}, {i: v for (_, i), v in states(whole, c).items()}):
            assert a == pytest.approx(other)
    r = [x["r"] for x in folded.collect() if x["spikes"]]
    assert min(map(abs, r)) > 0


def test_equation_flags_hold_or_are_refused(spark):
    eqs = Equations.parse("x = 2*y : 1 (constant over dt)\ny : 1")
    assert [n for n, _ in eqs.held()] == ["x"]
    g = Group(2, "dv/dt = level/second : 1\nlevel = v + 1 : 1 (constant over dt)", method="rk4")
    out = g.fold(g.table(spark), 3, 0.5).first()["v"]
    v = 0.0
    for _ in range(3):
        v += 0.5 * (v + 1)  # held, so that every stage sees the same value
    assert out == pytest.approx(v)


def spread(spark, out) -> int:
    """Tasks that a result's rows come from."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return out.select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_shards_change_nothing(spark):
    """Two runs of 60 targets and 400 edges, with all that shards may have: draws, delays, events of both ends, sums."""
    a = Group(30, "dx/dt = (1.4 - x)/(10*ms) + 0.3*xi/(10*ms)**0.5 : 1", method="euler", threshold="x > 1", reset="x = 0", name="a").set("x", "rand()")
    b = Group(60, "dv/dt = -v/(20*ms) : 1\ng : 1", method="euler", threshold="v > 2", reset="v = 0", events={"low": "v < 0.1"}, name="b").set("v", "rand()")
    lone = Group(9, "y : 1", name="lone").set("y", "rand()")
    s = Synapses("s", "a", "b", "w : 1\nd : second\ndq/dt = -q/(5*ms) : 1 (event-driven)\ndz/dt = (x_pre - z)/second : 1 (clock-driven)\ng_post = w*z : 1 (summed)",
                 {"pre": Way("v_post += w*rand(); q += 1", delay="d"), "post": Way("w *= 0.9; q -= 0.5", "post")}, method="euler")
    m = Synapses("m", "a", "s", "", {"pre": Way("w_post += 0.01")})
    plan = Assembly([a, b, lone], [s, m], [Clocked("lone", "y += 1", every=2e-3), Clocked("b", "v += 0.01", event="low")], record=("b.v", "a.x"), every=5)
    rows = [(k % 2, k, k % 7 + 3 * (k % 5), (k * k + k // 3) % 60, 0.1 + k % 9, k % 4 * DT) for k in range(800)]
    edges = edge_rows(spark.createDataFrame(rows, "run long, seq long, i long, j long, w double, d double"), "s", ("w", "d"), "run")
    onto = edge_rows(spark.createDataFrame([(k % 2, k, k % 30, k) for k in range(0, 800, 3)], "run long, seq long, i long, j long"), "m", (), "run")
    nodes = plan.nodes(spark, 2)
    whole, cut = (sorted(map(tuple, plan.run(nodes, edges.unionByName(onto), 15, DT, shards).collect())) for shards in (1, 5))
    assert whole == cut and {(x[1], x[2]) for x in whole} == {("event", "a"), ("event", "b"), ("trace", "a"), ("trace", "b"), *(("state", n) for n in ("a", "b", "lone", "s"))}
    last = plan.final(nodes, edges.unionByName(onto), 15, DT, "s", 5).collect()
    assert {(r["run"], r["i"], c): r[c] for r in last for c in ("w", "d", "q", "z")} == {(x[0], x[4], x[5]): x[6] for x in whole if x[1:3] == ("state", "s")}
    assert len(last) == 800


def test_what_is_wrong_in_one_shard_is_wrong(spark):
    a, b = Group(3, "x : 1", name="a"), Group(50, "v : 1", name="b")
    plan = Assembly([a, b], [Synapses("s", "a", "b", "w : 1", {"pre": Way("v_post += w")})])
    nodes = plan.nodes(spark)
    run = lambda rows, some=nodes: plan.run(some, edges_of(spark, rows), 2, DT, 8)
    assert run([(k, k % 3, k, 1.0) for k in range(50)]).count() == 3 + 50 + 50
    for j in range(1, 50, 7):  # wherever the two edges' targets are
        with pytest.raises(Exception, match="two rows of s"):
            run([(0, 0, 0, 1.0), (0, 0, j, 1.0)]).collect()
    bad = [(0, 0, 0, 1.0), (1, 0, 77, 1.0)]
    with pytest.raises(Exception, match="no row of b"):
        run(bad).collect()
    with pytest.raises(Exception, match="no row of a"):  # also where the edge's shard has no nodes at all
        run([(0, 0, 0, 1.0)], nodes.filter("object = 'b' and i = 1")).collect()
    assert run(bad, nodes.filter("false")).count() == 0
    with pytest.raises(Exception, match="did you mean"):
        plan.run(nodes, edge_rows(spark.createDataFrame([(0, 0, 0, 1.0)], "seq long, i long, j long, ww double"), "s", ("ww",)), 2, DT, 8).collect()


def test_networks_that_shards_would_change_are_refused(spark):
    a, b = Group(2, "x : 1", threshold="x > 1", name="a"), Group(2, "v : 1", name="b")
    way = lambda code: {"pre": Way(code)}
    refused = {
        "changes": [Assembly([a, b], [Synapses("s", "a", "b", "w : 1", way("x_pre += w"))]), Assembly([a], [Synapses("s", "a", "a", "", way("x += 1"))]),
                    Assembly([a, b], [Synapses("s", "a", "b", "x_pre = v_post : 1 (summed)")]), Assembly([a, b], [Synapses("s", "a", "b")], [Clocked("s", "x_pre = 1", every=DT)])],
        "N": [Assembly([a, Group(2, "v : 1", threshold="v > N", name="b")], [Synapses("s", "a", "b")]), Assembly([a, b], [Synapses("s", "a", "b", "", way("v += 1/N"))])],
        "links": [Assembly([a, Group(2, "v : 1 (linked)", name="b")], [Synapses("s", "a", "b")], links=[Linked("b", "v", "a", "x")])],
        "operations": [Assembly([a, b], [Synapses("s", "a", "b")], operations=[print])],
        "edges from edges": [Assembly([a, b], [Synapses("s", "a", "b", "u : 1"), Synapses("m", "s", "b")])],
    }
    for text, plans in refused.items():
        for plan in plans:
            with pytest.raises(ValueError, match=f"{text}.*shards"):
                plan.run(plan.nodes(spark), None, 2, DT, 3)


@pytest.mark.parametrize("name", ["edg_1_edge_state", "str_8_pathway", "int_14_clock_driven", "join_15_synapses_on_synapses", "agg_1_summed_flag"])
def test_a_large_network_is_many_tasks(spark, name):
    from sparkloom.plans import catalogue

    out = catalogue.queries()[name](spark, "/root/testdata/sf0.001")
    groups = re.findall(r"FlatMapCoGroupsInArrow \[([^\]]*)\]", out._jdf.queryExecution().sparkPlan().toString())
    assert [re.sub(r"#\w+", "", g) for g in groups] == ["run, shard"] and spread(spark, out) == 4
