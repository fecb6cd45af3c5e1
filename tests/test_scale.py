"""Steps whose work grew with pairs, against the pairs; figures as printf writes them."""

import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from causetrace.functions.text import fixed
from causetrace.operators import graph, rank
from causetrace.sources import sinks

T0 = datetime(2024, 1, 1)


def pairs_of(seen, events, keyed):
    """C12 by brute force."""
    out = []
    for i, e, m, t in seen:
        for e2, ts, d in events:
            if t is not None and (not keyed or e == e2) and timedelta(0) < t - ts <= timedelta(hours=24):
                h = (t - ts) / timedelta(hours=1)
                out.append((i, m, d, ts, t, round(h, 3), round(1 / (1 + h), 6)))
    return out


def drawn(seed):
    r = random.Random(seed)
    times = [T0 + timedelta(hours=6 * k) for k in range(12)] + [None]
    seen = [(f"i{n % 6}", f"x{n % 2}", f"m{n}", r.choice(times)) for n in range(30)]
    at = lambda: T0 + timedelta(hours=r.choice([0, 5.999, 6, 24, 24.5, 30]) if r.random() < 0.5 else r.uniform(-30, 80))
    return seen, [(f"x{n % 2}", at(), f"release {n}") for n in range(120)]


def test_events_without_a_row_for_each_pair(spark):
    for keyed in (False, True):
        seen, events = drawn(3 + keyed)
        keys = ["entity"] if keyed else []
        s = spark.createDataFrame(seen, "incident_id string, entity string, metric string, first_seen timestamp_ntz").select("incident_id", *keys, "metric", "first_seen")
        e = spark.createDataFrame(events, "entity string, ts timestamp_ntz, description string").select(*keys, "ts", "description")
        want = pairs_of(seen, events, keyed)
        got = graph.correlate_events(s, e, shares=3).collect()
        cols = ("incident_id", "metric", "event_description", "event_time", "anomaly_time", "delta_hours", "correlation_score")
        assert want and sorted(tuple(x[c] for c in cols) for x in got) == sorted(want)
        best = {}
        for i, m, *_, score in want:
            best[i, m] = max(score, best.get((i, m), 0))
        closest = graph.closest_events(s, e).collect()
        assert {(x.incident_id, x.metric): x.correlation_score for x in closest} == best and len(closest) == len(best)
        few = graph.leading_events(s, e, 3)
        first = rank.top(few.withColumn("t", F.concat("metric", "event_description")), "correlation_score", 3, "t").collect()
        told = {}
        for x in sorted(want, key=lambda x: (x[0], -x[6], x[1] + x[2])):
            told.setdefault(x[0], []).append((x[1], x[2]))
        assert {(x.incident_id, x.place): (x.metric, x.event_description) for x in first} == {(i, k + 1): v for i, vs in told.items() for k, v in enumerate(vs[:3])}


def test_metrics_of_one_time_share_their_events(spark, tmp_path):
    events = spark.createDataFrame([(T0 - timedelta(minutes=k), f"release {k}") for k in range(1, 41)], "ts timestamp_ntz, description string")
    seen = spark.range(50).selectExpr("concat('i', id % 5) AS incident_id", "concat('m', id) AS metric", "timestamp_ntz'2024-01-01 00:00:00.000001' AS first_seen")
    lists = graph.event_lists(seen, events)
    assert lists.count() == 40 and graph.correlate_events(seen, events).count() == 2000
    sinks.write_event_lists(lists, str(tmp_path / "lists"))
    told = spark.read.schema("anomaly_time string, event_time string, event_description string").json(str(tmp_path / "lists"))
    assert {x.anomaly_time for x in told.collect()} == {"2024-01-01 00:00:00.000001"} and told.count() == 40
    refs = seen.select("incident_id", "metric", F.col("first_seen").cast("string").alias("anomaly_time")).join(told.groupBy("anomaly_time").agg(F.count(F.lit(1)).alias("n_events")), "anomaly_time")
    ranked = seen.selectExpr("incident_id", "metric", "1L AS rank", "0.5D AS composite_score", "'Low' AS confidence")
    edges = spark.createDataFrame([], "incident_id string, cause string, effect string, strength double, lag int, p_value double")
    docs = sinks.report_documents(ranked, edges, refs)
    n = docs.select(F.get_json_object("report", "$.event_correlations[*].n_events").alias("n"))
    assert all(x.n == "[" + ",".join(["40"] * 10) + "]" for x in n.collect())


def test_fixed_rounds_as_printf_does(spark):
    r = np.random.default_rng(1)
    values = [0.0, 0.125, 0.375, 0.625, 0.285, 23.45, 99.95, 0.05, 0.25, 1.005, 100.0, -0.125, 12.35, 7e11 + 0.25, 3e12, 1e300, 0.045, 9.995]
    values += [float(x) for x in np.round(r.uniform(0, 100, 3000), 3)] + [float(x) * 100 for x in np.round(r.uniform(0, 1, 3000), 4)] + [float(x) for x in r.uniform(0, 1, 500)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", fixed(F.col("x"), 1).alias("a"), fixed(F.col("x"), 2).alias("b")).collect()
    wrong = [(x.x, x.a, x.b) for x in rows if (abs(x.x) < 1e12 and (x.a, x.b) != (f"{x.x:.1f}", f"{x.x:.2f}"))]
    assert not wrong, wrong[:5]
    null = spark.sql("SELECT CAST(NULL AS DOUBLE) AS x").select(fixed(F.col("x"), 1)).first()[0]
    assert null is None


def test_report_rounds_exact_halves_to_even(spark):
    ranked = spark.createDataFrame([("i", 1, "m", 0.2345, "Low", 0.125, 0.625, 0.285, 0.375), ("i", 2, "n", 0.1625, "Low", 0.0, 0.0, 0.0, 0.0)], "incident_id string, rank long, metric string, composite_score double, confidence string, causal_outflow double, temporal_priority double, causal_inflow double, event_correlation double")
    text = rank.markdown_report(ranked.withColumn("downstream_effects", F.array().cast("array<string>"))).first().report
    for part in (f"{0.2345 * 100:.1f}%", "outflow: 0.12", "priority: 0.62", "inflow: 0.28", "correlation: 0.38", "`n`: 16.2%"):
        assert part in text


def test_graphs_split_into_parts_by_size(spark):
    """Weakly connected parts walked whole, packed together or searched by joins, with the same components, levels and joined pairs."""
    from causetrace.operators import condense

    r = np.random.default_rng(21)
    edges = [(1000 * g + int(a), 1000 * g + int(b)) for g, n in enumerate((3, 40, 12, 60)) for a, b in r.integers(0, 16, size=(n // 2, 2))]
    edges += [(9000 + i, 9001 + i) for i in range(6)] + [(9100, 9100)]
    links = {}
    for a, b in edges:
        links.setdefault(a, set()).add(b)
        links.setdefault(b, set())
    far = graph.reached(links)
    near = {n: {n} for n in links}
    while True:
        grown = {n: near[n].union(*(near[x] for x in near[n]), *(links[x] for x in near[n]), *({y for y in links if x in links[y]} for x in near[n])) for n in links}
        if grown == near:
            break
        near = grown
    asked = [(int(g), int(at), sorted(links)[int(n)]) for g, at, n in zip(r.integers(0, 3, 90), r.integers(0, 50, 90), r.integers(0, len(links), 90))] + [(None, 1, 9000), (0, None, 9001)]
    want = {(a, b) for g, i, a in asked for h, j, b in asked if None not in (g, i, j) and g == h and i < j and (a == b or b in far[a] or a in far[b])}
    pairs = [(a, b) for a in links for b in links]
    joined = {(a, b) for a, b in pairs if a == b or b in far[a] or a in far[b]}
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {x.node: x.part for x in condense.weak_parts(df).collect()} == {n: min(m) for n, m in near.items()}
    components = None
    for small in (1000, 24, 0):
        services, between = condense.condensed(df, small=small)
        told = {x.node: (x.component, x.level) for x in services.collect()}
        assert components in (None, told) and len(told) == services.count() == len(links)
        components = told
        got = condense.joined_in_groups(services, between, spark.createDataFrame(asked, "group long, at long, node long"), small=small).collect()
        assert {(x.src, x.dst) for x in got} == want and len(got) == len(want)
        got = condense.joined_pairs(services, between, spark.createDataFrame(pairs, "src long, dst long"), small=small).collect()
        assert {(x.src, x.dst) for x in got} == joined and len(got) == len(joined)


def test_levels_in_fewer_rounds_than_levels(spark):
    """A part of more than ``small`` edges whose longest path is longer than the rounds allowed: rounds from both ends leave a core that is walked."""
    from causetrace.operators import condense

    r = np.random.default_rng(25)
    edges = [(k, k + 1) for k in range(30)] + [(30, 28), (5, 5)]
    edges += [(1000 + 10 * i + k, 1001 + 10 * i + k) for i in range(60) for k in range(3)] + [(1003 + 10 * i, int(r.integers(0, 4))) for i in range(60)]
    edges += [(int(r.integers(8, 31)), 5000 + 10 * i) for i in range(40)] + [(5000 + 10 * i + k, 5001 + 10 * i + k) for i in range(40) for k in range(i % 4)] + [(1000 + 10 * i, 5000 + 10 * i) for i in range(20)]
    services, _ = condense.condensed(spark.createDataFrame(edges, "src long, dst long"), max_rounds=15, small=50)
    assert sorted((x.node, x.component, x.level) for x in services.collect()) == sorted(condense.walked(edges))


def test_groups_of_a_large_part_make_no_pairs(spark, monkeypatch):
    """Many asked nodes of one group in a part of more than ``small`` links: what is written grows with links and joined pairs, not with the pairs of the group; a long path takes few rounds."""
    from causetrace.operators import condense

    edges = [(10 * i + k, 10 * i + k + 1) for i in range(600) for k in range(i % 3)] + [(10 * i + i % 3, 9_000) for i in range(600)] + [(9_000 + k, 9_001 + k) for k in range(16)]
    asked = [(0, i, 10 * i) for i in range(600)] + [(0, 700, 9_016), (0, 300, 9_008), (1, 5, 9_016), (1, 4, 9_001), (1, 6, 9_001), (2, 1, 9_012)]
    want = {(10 * i, 9_016) for i in range(600)} | {(10 * i, 9_008) for i in range(300)} | {(9_008, 10 * i) for i in range(301, 600)} | {(9_008, 9_016), (9_001, 9_016), (9_016, 9_001), (9_001, 9_001)}
    services, links = condense.condensed(spark.createDataFrame(edges, "src long, dst long"))
    rows, settled = [], condense.settled

    def counted(df, tag="rows"):
        back = settled(df, tag)
        rows.append(back.count())
        return back

    monkeypatch.setattr(condense, "settled", counted)
    got = condense.joined_in_groups(services, links, spark.createDataFrame(asked, "group long, at long, node long"), max_rounds=10, small=0).collect()
    assert {(x.src, x.dst) for x in got} == want and len(got) == len(want)
    assert sum(rows) < 60 * (len(edges) + len(asked)) and max(rows) < 20 * len(edges)


def test_groups_of_large_parts_without_levels(spark):
    """Parts that went by joins have no levels: those with few links between components too, and those that are one component."""
    from causetrace.operators import condense

    r = np.random.default_rng(31)
    edges = [(k, (k + 1) % 8) for k in range(8)] + [(7, 40), (40, 41), (50, 51), (51, 3), (7, 3)] + [(100 + k, 100 + (k + 1) % 8) for k in range(8)] + [(200 + k, 201 + k) for k in range(8)] + [(300, 301), (301, 302)]
    links = {}
    for a, b in edges:
        links.setdefault(a, set()).add(b)
        links.setdefault(b, set())
    far = graph.reached(links)
    asked = [(int(g), int(at), sorted(links)[int(n)]) for g, at, n in zip(r.integers(0, 3, 90), r.integers(0, 50, 90), r.integers(0, len(links), 90))]
    want = {(a, b) for g, i, a in asked for h, j, b in asked if g == h and i < j and (a == b or b in far[a] or a in far[b])}
    services, between = condense.condensed(spark.createDataFrame(edges, "src long, dst long"), small=6, levels=False)
    assert {x.node for x in services.where("level is null").collect()} == {n for n in links if n < 300}
    got = condense.joined_in_groups(services, between, spark.createDataFrame(asked, "group long, at long, node long"), small=6).collect()
    assert {(x.src, x.dst) for x in got} == want and len(got) == len(want)
