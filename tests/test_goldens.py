"""Small cases with results worked out by hand."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from causetrace.functions import stats
from causetrace.operators import causal, detect, graph, prepare, rank

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def metrics(spark, rows):
    return spark.createDataFrame(rows, "entity string, metric string, ts timestamp_ntz, value double")


def test_messy_frame_loses_sparse_metrics(spark):
    times, a = [0, 30, 30, 60, 0], [1.0, None, 3.0, 1000.0, 1.0]
    rows = [("e", m, at(t), v if m == "a" else None, k) for k, (t, v) in enumerate(zip(times, a, strict=True)) for m in ("a", "b")]
    df = spark.createDataFrame(rows, "entity string, metric string, ts timestamp_ntz, value double, seq long")
    last = prepare.dedupe_keep_last(df).where("metric = 'a'").orderBy("ts").collect()
    assert [r.value for r in last] == [1.0, 3.0, 1000.0]
    grid = prepare.reindex_grid(prepare.dedupe_keep_last(df), "5 minutes")
    assert grid.count() == 26
    assert prepare.clean_and_impute(df, "5 minutes").count() == 0


def test_gap_of_ten(spark):
    rows = [("e", "m", at(5 * i), {0: 0.0, 11: 11.0}.get(i)) for i in range(12)]
    got = prepare.fill_gaps(prepare.reindex_grid(metrics(spark, rows), "5 minutes")).orderBy("ts")
    assert [r.value for r in got.collect()] == [0, 1, 2, 3, 4, 5, 6, 6, 6, 6, 6, 11]


def fold(flags, required, cooldown):
    run = wait = 0
    out = []
    for i, f in enumerate(flags):
        if wait:
            wait, run = wait - 1, 0
            continue
        run = run + 1 if f else 0
        if run >= required:
            out.append(i)
            run, wait = 0, cooldown
    return out


def test_alert_damping(spark):
    golden = [0, 1, 1, 1, 1, 1, 1, 1, 0, 0, 1, 1, 1, 0, 1]
    rng = np.random.default_rng(3)
    cases = {"golden": golden} | {f"r{k}": (rng.random(150) < 0.3 + 0.04 * k).astype(int).tolist() for k in range(15)} | {"ones": [1] * 60, "none": [0] * 9}
    rows = [("e", m, at(i), bool(f)) for m, fs in cases.items() for i, f in enumerate(fs)]
    df = spark.createDataFrame(rows, "entity string, metric string, ts timestamp_ntz, is_anomaly boolean")
    got = detect.dampen_alerts(df, 3, 5).where("hard_alert").collect()
    for m, fs in cases.items():
        assert sorted((r.ts - T0).seconds // 60 for r in got if r.metric == m) == fold(fs, 3, 5), m
    assert fold(golden, 3, 5) == [3, 12]


def test_stream_damping_equals_batch(spark, tmp_path):
    from causetrace.streaming.damping import stream_dampen_alerts, use_rocksdb

    use_rocksdb(spark)
    rng = np.random.default_rng(5)
    flags = (rng.random(90) < 0.6).tolist()
    rows = [("e", "m", at(i), bool(f)) for i, f in enumerate(flags)]
    df = spark.createDataFrame(rows, "entity string, metric string, ts timestamp_ntz, is_anomaly boolean")
    for k in range(3):  # three files, read one after another
        df.where((F.col("ts") >= F.lit(at(30 * k))) & (F.col("ts") < F.lit(at(30 * k + 30)))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_dampen_alerts(stream, 3, 5, "0 seconds").writeStream.format("memory").queryName("damped").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.ts - T0).seconds // 60 for r in spark.table("damped").collect()) == fold(flags, 3, 5)


def test_constant_window_has_no_trend(spark):
    rows = [("e", "flat", at(i), 7.0) for i in range(12)] + [("e", "up", at(i), float(i)) for i in range(12)]
    got = {r.metric: r.trend for r in detect.trend_r2(metrics(spark, rows)).where(F.col("ts") == F.lit(at(11))).collect()}
    assert got["flat"] == 0 and got["up"] == pytest.approx(1)


def chain(spark):
    edges = spark.createDataFrame([("i", "A", "B", 0.9, 0.01, 1), ("i", "B", "C", 0.8, 0.01, 1)], "incident_id string, cause string, effect string, strength double, p_value double, lag int")
    nodes = spark.createDataFrame([("i", "A", 0.9), ("i", "B", 0.7), ("i", "C", 0.8)], "incident_id string, metric string, anomaly_score double")
    seen = spark.createDataFrame([("i", m, at(5 * k)) for k, m in enumerate("ABC")], "incident_id string, metric string, first_seen timestamp_ntz")
    return nodes, edges, seen


def test_ranking_of_a_chain(spark):
    nodes, edges, seen = chain(spark)
    none = spark.createDataFrame([], "incident_id string, metric string, correlation_score double")
    ranks = rank.pagerank(nodes, edges)
    total = ranks.agg(F.sum("pagerank")).first()[0]
    assert total == pytest.approx(1, abs=1e-6)
    f = {r.metric: r for r in rank.factors(nodes, edges, seen, none, ranks).withColumn("h", rank.heuristic(rank.WEIGHTS_B)).collect()}
    assert [f[m].causal_outflow for m in "ABC"] == [1, 1, 0]
    assert [f[m].causal_inflow for m in "ABC"] == [1, 0, 0]
    assert [f[m].temporal_priority for m in "ABC"] == [1, 0.5, 0]
    assert [round(f[m].h, 6) for m in "ABC"] == [0.835, 0.53, 0.12]
    chains = {r.metric: r.causal_chain for r in rank.causal_chain(nodes, edges).collect()}
    assert chains == {"A": ["A", "B", "C"], "B": ["B", "C"], "C": ["C"]}


def test_event_twenty_minutes_before(spark):
    seen = spark.createDataFrame([("i", "m", at(20))], "incident_id string, metric string, first_seen timestamp_ntz")
    events = spark.createDataFrame([(at(0), "release", "deployment"), (at(20), "same time", "deployment"), (at(-1500), "old", "deployment")], "ts timestamp_ntz, description string, type string")
    got = graph.correlate_events(seen, events).collect()
    assert [(r.event_description, r.delta_hours, r.correlation_score) for r in got] == [("release", 0.333, 0.75)]


def test_topology_keeps_joined_services(spark):
    topology = spark.createDataFrame([("frontend_app", "api_server"), ("api_server", "db_server")], "src string, dst string")
    rows = [("i", "api_server_load", "db_server_load"), ("i", "frontend_app_load", "db_server_load"), ("i", "db_server_load", "other_thing_load")]
    edges = spark.createDataFrame(rows, "incident_id string, cause string, effect string")
    assert graph.refine_by_topology(edges, topology).count() == 3
    apart = topology.union(spark.createDataFrame([("x_y", "z_w")], "src string, dst string"))
    far = spark.createDataFrame([("i", "x_y_load", "db_server_load")], "incident_id string, cause string, effect string")
    assert graph.refine_by_topology(far, apart).count() == 0


def test_cycles_go_violators_first(spark):
    _, _, seen = chain(spark)
    rows = [("i", "A", "B", 0.5, 0.0, 1), ("i", "B", "C", 0.6, 0.0, 1), ("i", "C", "A", 0.9, 0.0, 1)]
    edges = spark.createDataFrame(rows, "incident_id string, cause string, effect string, strength double, p_value double, lag int")
    kept = lambda df: sorted((r.cause, r.effect) for r in df.collect())
    assert kept(graph.break_cycles(edges, seen)) == [("A", "B"), ("B", "C")]
    assert kept(graph.break_cycles_weakest(edges)) == [("B", "C"), ("C", "A")]


def test_lagged_cause_is_found(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=100)
    b = np.concatenate([[0], 2 * a[:-1]]) + 0.1 * rng.normal(size=100)
    rows = [("i", m, at(i), float(v)) for m, vs in (("A", a), ("B", b)) for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "incident_id string, metric string, ts timestamp_ntz, value double")
    got = {(r.cause, r.effect): r for r in causal.granger(df, 3).collect()}
    assert got["A", "B"].p_value < 1e-10


def test_structure_of_a_chain(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=500)
    y = x + 0.5 * rng.normal(size=500)
    z = y + 0.5 * rng.normal(size=500)
    rows = [("i", m, at(i), float(v)) for m, vs in zip("XYZ", (x, y, z), strict=True) for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "incident_id string, metric string, ts timestamp_ntz, value double")
    pairs = {frozenset((r.cause, r.effect)) for r in causal.pc_structure(df).collect()}
    assert pairs == {frozenset("XY"), frozenset("YZ")}


def test_distribution_tails():
    assert stats.f_tail(4.9646, 1, 10) == pytest.approx(0.05, abs=1e-5)
    assert stats.t_two_sided(2.2281, 10) == pytest.approx(0.05, abs=1e-5)
    assert stats.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert stats.unit_root_p(-2.86) == pytest.approx(0.05, abs=2e-3)
    assert math.isclose(stats.incomplete_beta(2, 3, 0.4), 0.5248, abs_tol=1e-4)
