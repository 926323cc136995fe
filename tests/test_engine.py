"""Groups, edges, delivery, rates, networks, streams, trees and training, on small cases with known results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions.units import UNITS
from sparkloom.operators import delivery, edges, morphology, rates, training
from sparkloom.operators.group import SLOTS, Group, schedule, spikes, traces
from sparkloom.operators.network import Network, Pathway, relational, stdp
from sparkloom.plans import control
from sparkloom.sources import tables
from sparkloom.streaming import stateful


def test_lif_fires_nine_times(spark):
    g = Group(1, "dv/dt = (1.5 - v)/(10*ms) : 1", method="euler", threshold="v > 1", reset="v = 0")
    assert spikes(g.fold(g.table(spark), 1000, 1e-4)).count() == 9


def test_decay_trace(spark):
    g = Group(1, "dv/dt = -v/(5*ms) : 1").set("v", 1)
    got = traces(g.fold(g.table(spark), 5, 1e-4, record=("v",))).orderBy("tick").collect()
    assert [r["v"] for r in got] == pytest.approx([math.exp(-k / 50) for k in range(5)])


def test_counters(spark):
    g2 = Group(2, "dc/dt = 1/(0.1*ms) : 1\nd : 1\nmost : 1", method="euler", threshold="c >= most - 0.5", reset="c = 0; d += 1").set("most", "50 + 50*i")
    got = g2.fold(g2.table(spark), 100, 1e-4).orderBy("i").collect()
    assert [r["d"] for r in got] == [2, 1] and got[0]["spikes"] == [49, 99]


def test_refractory_condition_only_frees(spark):
    g = Group(1, "dv/dt = 1/(1*ms) : 1", method="euler", threshold="v > 0.5", reset="", refractory="v > 0.5")
    assert len(g.fold(g.table(spark), 20, 1e-3).first()["spikes"]) == 1


def test_access_by_predicate_and_views(spark):
    g = Group(10, "v : volt\ntwice = 2*v : volt").set("v", "i*mV").set("v", "0*mV", where="i > 7")
    df = g.table(spark)
    assert [r["i"] for r in g.where(df, "i > 3 and v > 5*mV").orderBy("i").collect()] == [6, 7]
    assert g.views(df.filter("i = 3"), "twice").first()["twice"] == pytest.approx(6e-3)
    assert [r["i"] for r in g.subgroup(df, 2, 4).orderBy("i").collect()] == [0, 1]
    with pytest.raises(ValueError, match="did you mean"):
        g.set("vv", 1)


def test_schedule():
    order = schedule([("resets", 0, "r"), ("after_groups", 0, "x"), ("synapses", 1, "post"), ("synapses", -1, "pre"), ("groups", 0, "b"), ("groups", 0, "a")])
    assert [n for _, _, n in order] == ["a", "b", "x", "pre", "post", "r"] and SLOTS[0] == "start"


def test_connect(spark):
    n = tables.nodes(spark, 10)
    pairs = lambda df: sorted((r["i"], r["j"]) for r in df.select("i", "j").collect())
    assert len(pairs(edges.connect_condition(n, n, F.col("i") != F.col("j")))) == 90
    assert pairs(edges.connect_one_to_one(n, n)) == [(k, k) for k in range(10)]
    near = edges.connect_range(n, F.col("i") - 1, F.col("i") + 2, n_post=10, keep=F.col("j") != F.col("i"))
    assert pairs(near) == [(a, b) for a in range(10) for b in (a - 1, a + 1) if 0 <= b < 10]
    some = pairs(edges.connect_random(tables.nodes(spark, 300), 200, 0.1, 1))
    assert len(set(some)) == len(some) and abs(len(some) - 6000) < 400 and max(j for _, j in some) < 200
    assert some == pairs(edges.connect_random(tables.nodes(spark, 300).repartition(7), 200, 0.1, 1))
    assert len(pairs(edges.connect_random(n, 10, 1.0, 1))) == 100 and pairs(edges.connect_random(n, 10, 0.0, 1)) == []
    sample = pairs(edges.connect_sample(n, 50, 4, 2))
    assert len(set(sample)) == 40
    into = pairs(tables.fixed_indegree_edges(spark, 3, 20, 15, 9))
    assert all(len({i for i, j in into if j == k}) == 3 for k in range(15))


def test_numbering_and_indexing(spark):
    keys = spark.createDataFrame(list(enumerate([7, 5, 7, 3, 7, 5])), "seq int, key int")
    got = edges.number_duplicates(keys, ["key"], ["seq"]).orderBy("seq").collect()
    assert [r["k"] for r in got] == [0, 0, 1, 0, 2, 1]
    e = tables.edge_list(spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "i long, j long"), 2)
    assert edges.at(e, slice(1, None), None, 0).count() == 2 and edges.at(e, 1, 2, 1).count() == 1
    assert edges.out_of_range(e, 2, 3).count() == 2


def test_delivery(spark):
    events = spark.createDataFrame([(3, 0), (3, 1), (4, 0)], "tick long, i long")
    e = spark.createDataFrame([(0, 5, 0.5, 2, 0), (1, 5, 2.0, 2, 1), (0, 6, 1.0, 0, 2)], "i long, j long, w double, delay_ticks int, seq int")
    due = delivery.propagate(events, e)
    assert {(r["due"], r["j"]): r["total"] for r in delivery.deliver_sum(due, F.col("w")).collect()} == {(5, 5): 2.5, (6, 5): 0.5, (3, 6): 1.0, (4, 6): 1.0}
    assert {r["factor"] for r in delivery.deliver_product(due.filter("due = 5"), F.col("w")).collect()} == {1.0}
    assert delivery.deliver_last(due.filter("due = 5"), F.col("w"), "seq").first()["assigned"] == 2.0


def test_binned_rates(spark):
    t = [(0, 10), (0, 30), (1, 20), (1, 40), (2, 50)]
    events = spark.createDataFrame([(i, float(x), x) for i, x in t], "i long, t double, tick long")
    got = rates.binned_rate(events, tables.nodes(spark, 3), 5, 20, 1e-3).orderBy("i", "bin").collect()
    assert [r["rate"] for r in got] == [50, 50, 0, 0, 0, 0, 50, 50, 0, 0, 0, 0, 50, 0, 0]
    flat = spark.createDataFrame([(k % 5, k) for k in range(35)], "i long, tick long")
    pop = rates.population_rate(spark, flat, 5, 0, 35, 1e-3)
    assert [r["rate"] for r in rates.binned_population_rate(pop, 10).collect()] == pytest.approx([200.0] * 3)


def test_smoothing_is_the_same_over_any_blocks(spark):
    rng = np.random.default_rng(0)
    x = rng.random(60)
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "tick long, rate double")
    for window, weights in (("flat", np.ones(7) / 7), ([1.0, 2.0, 3.0], np.array([1, 2, 3]) / 6)):
        for block in (10, 1000):
            got = rates.smooth(df, window, 7, block=block).orderBy("tick").collect()
            assert np.allclose([r["smooth"] for r in got], np.convolve(x, weights[::-1], mode="same"))


def test_trace_over_blocks(spark):
    rng = np.random.default_rng(1)
    t = np.sort(rng.random(80)) * 50
    df = spark.createDataFrame([(0, float(x), k) for k, x in enumerate(t)], "i long, t double, k int")
    want = [np.exp((t[t <= x] - x) / 0.5).sum() for x in t]
    for block in (30.0, 300.0):
        got = rates.exponential_trace(df, 0.5, block=block).orderBy("k").collect()
        assert np.allclose([r["trace"] for r in got], want)


@pytest.fixture(scope="module")
def recurrent(spark):
    g = Group(12, "dv/dt = (drive - v)/(10*ms) : 1 (unless refractory)\ndrive : 1", method="euler", threshold="v > 1", reset="v = 0", refractory="2*ms")
    g.set("drive", "1.3 + 0.05*i").set("v", "i*0.06")
    e = tables.fixed_indegree_edges(spark, 4, 12, 12, 3).withColumns({"seq": F.col("j") * 100 + F.col("i"), "w": F.lit(0.04), "d": F.lit(2e-3) + (F.col("i") % 2) * F.lit(1e-3)})
    return g, e.cache(), [Pathway("v", "2*w", "d")]


def events_of(net):
    return sorted(map(tuple, net.spikes().collect()))


def test_supersteps_equal_relational_steps(spark, recurrent):
    want, _ = relational(*recurrent, spark, 10, 1e-3)
    net = Network(*recurrent, shards=3).run(spark, 0.01, 1e-3)
    assert events_of(net) == sorted(map(tuple, want.collect())) and net.explain(1e-3).startswith("supersteps of 2 ticks")


def test_shards_segments_and_checkpoints_change_nothing(spark, recurrent, tmp_path):
    whole = events_of(Network(*recurrent, shards=1).run(spark, 0.012, 1e-3))
    first = Network(*recurrent, shards=4).run(spark, 0.006, 1e-3)
    first.store(str(tmp_path / "mid"))
    then = Network(*recurrent, shards=2).restore(spark, str(tmp_path / "mid")).run(spark, 0.006, 1e-3)
    assert len(whole) > 5 and sorted(events_of(first) + events_of(then)) == whole
    with pytest.raises(ValueError, match="another network"):
        Network(Group(3, "x : 1")).restore(spark, str(tmp_path / "mid"))


def test_plan_export_is_canonical(recurrent):
    group, _, paths = recurrent
    text = control.exported(group, paths)
    assert text == control.exported(group, paths) and control.imported(text).stored == group.stored
    assert control.issues(group, paths) == []
    broken = Group(1, "dv/dt = -v/(1*ms) : 1", threshold="v > 1", reset="q = 0", method="exact")
    assert len(control.issues(broken, [Pathway("w", "1")])) == 2


def test_stdp_against_a_loop(spark):
    rng = np.random.default_rng(2)
    pre, post = np.sort(rng.random(30)), np.sort(rng.random(30))
    tau, up, down = 0.05, 0.2, -0.21
    ev = lambda t: spark.createDataFrame([(0, float(x)) for x in t], "i long, t double")
    e = spark.createDataFrame([(9, 0, 0, 0.5)], "seq long, i long, j long, w double")
    w, a, b, last = 0.5, 0.0, 0.0, 0.0
    for t, side in sorted([(t, 0) for t in pre] + [(t, 1) for t in post]):
        a, b, last = a * math.exp((last - t) / tau), b * math.exp((last - t) / tau), t
        w = min(1.0, max(0.0, w + (b if side == 0 else a)))
        a, b = (a + up, b) if side == 0 else (a, b + down)
    assert stdp(ev(pre), ev(post), e, tau, tau, up, down, 0.0, 1.0).first()["w"] == pytest.approx(w)


def test_streams_give_what_batches_give(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, 3)), float(t), k, 1.0) for k, t in enumerate(np.sort(rng.random(60) * 100))]
    df = spark.createDataFrame(rows, "i long, t double, event_id long, value double")
    for k in range(3):
        df.filter(f"event_id >= {20 * k} AND event_id < {20 * k + 20}").coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
    want = {r["event_id"] for r in stateful.refractory(df, 5.0).collect()}

    def streamed(fn, name):
        source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        run = fn(source).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True)
        run.option("checkpointLocation", f"{tmp_path}/{name}").start().awaitTermination()
        return spark.table(name).collect()

    assert {r["event_id"] for r in streamed(lambda s: stateful.refractory_stream(s, 5.0), "kept")} == want
    trace = {r["event_id"]: r["trace"] for r in rates.exponential_trace(df, 5.0).collect()}
    got = {r["event_id"]: r["trace"] for r in streamed(lambda s: stateful.trace_stream(s, 5.0), "traces")}
    assert got == pytest.approx(trace)


def test_tree_solver_and_cable(spark):
    rng = np.random.default_rng(4)
    parent = np.array([0, 0, 0, 1, 1, 4, 2])
    c = -rng.random(7)
    full = np.diag(3 + rng.random(7))
    for k in range(1, 7):
        full[k, parent[k]] = full[parent[k], k] = c[k]
    b = rng.random(7)
    assert np.allclose(morphology.solve_tree(parent, np.diag(full), c, b), np.linalg.solve(full, b))
    rows = [(0, k, k - 1, 1.0, math.pi, 1.0, 0.0, 1.0 if k == 0 else 0.0) for k in range(200)]
    df = spark.createDataFrame(rows, "neuron long, i long, parent long, length double, area double, diameter double, v double, current double")
    v = [r["v"] for r in morphology.cable(df, 400, 10.0, 1.0, 1.0, 0.01).orderBy("i").collect()]
    # a long cable at rest decays by exp(-x / lambda), lambda = sqrt(d / (4 R g))
    space = math.sqrt(1.0 / (4 * 1.0 * 0.01))
    assert v[20] / v[10] == pytest.approx(math.exp(-10 / space), rel=0.02)


def test_swc(spark, tmp_path):
    path = tmp_path / "a.swc"
    path.write_text("# points\n1 1 0 0 0 1 -1\n 2 3 0 0 3 1 1\n3 3 0 4 3 1 2\n\n")
    points = tables.swc(spark, str(path))
    assert tables.point_issues(points).count() == 0
    parts = morphology.path_distance(morphology.compartments(points))
    assert {r["i"]: r["distance"] for r in parts.collect()} == {2: 3.0, 3: 7.0}
    assert morphology.between(parts, 0, 5).count() == 1
    bad = spark.createDataFrame([(1, -1), (2, 3), (2, 1), (3, 9)], "index int, parent int")
    assert tables.point_issues(bad).count() == 3


def test_gradients_are_the_loss_surface_of_the_surrogate(spark):
    plan = training.Plan((3, 4, 2), 6, threshold=0.8)
    model = training.Model(plan)
    rng = np.random.default_rng(5)
    rows = [(s, s % 2, t, k, float(rng.random())) for s in range(8) for t in range(6) for k in range(3)]
    df = spark.createDataFrame(rows, "sample long, label int, tick int, input int, amplitude double")
    (loss, n, _), grads = training.collected(training.gradients(df, model, tasks=3), model)
    x, y = training.dense(df.toPandas().sort_values(["sample", "tick", "input"]), plan)
    whole, want, _ = training.loss_and_gradients(plan, model.weights, x, y)
    assert n == 8 and loss == pytest.approx(whole) and all(np.allclose(a, b) for a, b in zip(grads, want, strict=True))


def test_training_learns_and_resumes(spark, tmp_path):
    plan = training.Plan((4, 12, 2), 8, rate=0.05)
    model = training.Model(plan)
    rows = [(s, s % 2, t, 2 * (s % 2) + k, 1.0) for s in range(20) for t in range(8) for k in range(2)]
    df = spark.createDataFrame(rows, "sample long, label int, tick int, input int, amplitude double").cache()
    before = training.step(df, model, 2)["loss"]
    for _ in range(8):
        last = training.step(df, model, 2)
    assert last["loss"] < before
    training.store(model, spark, str(tmp_path / "m"))
    again = training.restore(spark, str(tmp_path / "m"))
    assert training.step(df, again, 2) == training.step(df, model, 2)
    out = training.evaluate(df, model)
    assert out.count() == 20


def test_sources(spark):
    rows = spark.createDataFrame([(0, 0.011), (1, 0.015), (0, 0.09)], "i long, t double")
    assert sorted(map(tuple, tables.replay(rows, 1e-2, 0.1, 0.25).collect())) == [(0, 1), (0, 9), (0, 11), (0, 19), (0, 21), (1, 1), (1, 11), (1, 21)]
    held = tables.timed_array(spark.createDataFrame([(-1.0,), (0.0,), (0.1,), (0.29,), (9.0,)], "t double"), [1.0, 2.0, 3.0], 0.1)
    assert [r["value"] for r in held.collect()] == [1.0, 1.0, 2.0, 3.0, 3.0]
    bad = spark.createDataFrame([(0, 0.01), (0, 0.011), (7, 0.0), (1, -1.0)], "i long, t double")
    assert tables.replay_issues(bad, 3, 1e-2).count() == 3
    events = tables.poisson_events(spark, 200, 500, 50.0, 1e-3, 3)
    assert abs(events.count() - 5000) < 350
    total = tables.poisson_input(tables.nodes(spark, 2000).withColumn("tick", F.lit(0)), 50, 10.0, 1.0, 1e-2, 1).agg(F.avg("value")).first()[0]
    assert total == pytest.approx(5.0, abs=0.3)


def test_user_functions(spark):
    control.vector_function("cube", lambda x: x**3)
    from sparkloom.functions import lang

    df = tables.nodes(spark, 4, x=F.col("i").cast("double"))
    assert [r[0] for r in df.select(lang.column("cube(x) + 1", {"x": F.col("x")})).collect()] == [1, 2, 9, 28]

    @control.check_units(result="volt", a="amp")
    def voltage(a):
        return a * UNITS["ohm"]

    assert voltage(2 * UNITS["amp"]).value == 2
    with pytest.raises(ValueError):
        voltage(2 * UNITS["volt"])


def test_monitors(spark, tmp_path):
    from sparkloom.operators import monitors

    trace = spark.createDataFrame([(t, i, float(10 * t + i)) for t in range(6) for i in range(3)], "tick long, i long, v double")
    events = spark.createDataFrame([(1, 0), (2, 1), (5, 2)], "tick long, i long")
    assert sorted(map(tuple, monitors.event_monitor(events, trace, ("v",), 1, 3).collect())) == [(2, 1, 21.0), (5, 2, 52.0)]
    kept = monitors.state_monitor(trace, ("v",), 2, F.col("i") == 1)
    assert sorted(r["v"] for r in kept.collect()) == [1.0, 21.0, 41.0]
    more = monitors.with_state_now(kept, spark.createDataFrame([(1, 99.0)], "i long, v double"), 6)
    assert more.count() == 4 and more.filter("tick = 6").first()["v"] == 99.0
    path = str(tmp_path / "m")
    for k in range(3):
        monitors.append(trace.filter(f"tick >= {2 * k} AND tick < {2 * k + 2}"), path, k)
    monitors.append(trace.filter("tick < 2"), path, 0)
    assert monitors.read(spark, path).count() == 18 and monitors.read(spark, path, (1, 2)).count() == 6
    assert monitors.states(kept, ("v",), kind="dict")["v"] == [r["v"] for r in kept.collect()]


@pytest.mark.parametrize("method", ["gsl", "gsl_rkf45", "gsl_rkck", "gsl_rk2", "gsl_rk4"])
def test_adaptive_methods_by_name(spark, method):
    eqs = "dv/dt = (2 - v)*(1 + sin(t/second))/second : 1 (unless refractory)\nw : 1"
    g = Group(3, eqs, method=method, threshold="v > w", reset="v = 0", refractory=0.3).set("w", "1 + 10*int(i > 0)")
    got = {r["i"]: r for r in g.fold(g.table(spark), 20, 0.1, record=("v",), every=5).collect()}
    solution = lambda t: 2 - 2 * math.exp(-t - 1 + math.cos(t))
    assert got[1]["v"] == pytest.approx(solution(2.0), abs=1e-4)
    assert [(r["tick"], r["v"]) for r in got[2]["trace"]] == [(k, pytest.approx(solution(k / 10), abs=1e-4)) for k in (0, 5, 10, 15)]
    first = next(k for k in range(20) if solution((k + 1) / 10) > 1)
    # it stays at 0 for the rest of the time step and three more, then grows again
    assert got[0]["spikes"][0] == first and got[1]["spikes"] == []
    fine = Group(3, eqs, method="rk4", threshold="v > w", reset="v = 0", refractory=0.3).set("w", "1 + 10*int(i > 0)")
    assert got[0]["spikes"] == {r["i"]: r["spikes"] for r in fine.fold(fine.table(spark), 20, 0.1).collect()}[0]


def test_adaptive_methods_are_kernels(spark):
    g = Group(4, "dv/dt = (1.5 - v)/(10*ms) : 1", method="gsl_rkf45", threshold="v > 1", reset="v = 0").set("v", "i/10")
    alone = sorted((r["tick"], r["i"]) for r in spikes(g.fold(g.table(spark), 200, 1e-3)).collect())
    e = spark.createDataFrame([(0, 1, 0)], "i long, j long, seq long")
    pathways = [Pathway("v", "0.0", 5e-3)]
    run = Network(g, e, pathways).run(spark, 0.2, 1e-3)
    assert sorted((r["tick"], r["i"]) for r in run.spikes().collect()) == alone
    with pytest.raises(ValueError, match="kernels only"):
        relational(g, e, pathways, spark, 2, 1e-3)
    empty = g.fold(g.table(spark).filter("i < 0"), 3, 1e-3)
    assert empty.count() == 0
    with pytest.raises(ValueError, match="noise"):
        Group(1, "dv/dt = -v/second + xi*second**-0.5 : 1", method="gsl").plan(0.1)
