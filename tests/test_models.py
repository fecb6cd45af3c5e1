"""Operators that SQL cannot express, against plain NumPy."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from causetrace.functions import stats
from causetrace.operators import causal, condense, detect, graph, moments, prepare, quality, rank
from causetrace.plans.diagnose import diagnose, run_pipeline
from causetrace.sources import events as ev
from causetrace.sources import logs, payloads, sinks

T0 = dt.datetime(2024, 1, 1)
LONG = "entity string, metric string, ts timestamp_ntz, value double"


def frame(spark, columns, entity="e", schema=LONG):
    rows = [(entity, m, T0 + dt.timedelta(minutes=5 * i), None if v is None else float(v)) for m, vs in columns.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, schema)


def incident(spark, columns, name="i"):
    return frame(spark, columns, name).withColumnRenamed("entity", "incident_id")


def test_null_is_not_an_anomaly(spark):
    """First points, missing baselines, null values and null scores are unknown, not extreme."""
    normal = frame(spark, {"a": [1, 2, 3, 4, 5, 6], "c": [3, 3, 3]})
    df = frame(spark, {"a": [None, 9, 3.5], "new": [100, 900]})
    base = detect.fit_baselines(normal)
    got = {(r.metric, r.ts.minute): r for r in detect.statistical_scores(df, base).collect()}
    assert all(got["new", k][c] == 0 for k in (0, 5) for c in ("zscore", "mad_score", "iqr_score", "stat"))
    assert got["a", 0].stat == 0 and got["a", 5].stat > 0.5
    spike = [r.spike for r in detect.spike_score(frame(spark, {"a": [1, 2, 4, 4, None, 9, 10]})).orderBy("ts").collect()]
    assert spike[0] == 0 and spike[4] == 0 and spike[5] == 0 and spike[1] > 0
    scaled = {(r.metric, r.ts.minute): r.value for r in prepare.apply_minmax(df.where("metric = 'a'"), prepare.fit_minmax(normal)).collect()}
    assert scaled["a", 0] is None and scaled["a", 5] == 1 and scaled["a", 10] == 0.5
    filled = [r.value for r in prepare.fill_incident(frame(spark, {"a": [None, 9, None, 3]})).orderBy("ts").collect()]
    assert filled == [9, 9, 9, 3]
    capped = [r.value for r in prepare.cap_outliers(frame(spark, {"a": [1, 2, None, 3]}), 1.0).orderBy("ts").collect()]
    assert capped[2] is None
    scores = detect.statistical_scores(df, base)
    rec = df.select("entity", "metric", "ts", F.when(F.col("value") > 5, 2.0).alias("score"))
    ens = detect.ensemble_scores(rec, scores, scores.select("entity", "metric", "ts", F.lit(0.0).alias("temporal"))).collect()
    assert len(ens) == 3 and all(r.l == 1 for r in ens)


def test_correlated_groups(spark):
    rng = np.random.default_rng(1)
    s = rng.normal(size=60).cumsum()
    cols = {"flat": np.ones(60), "signal": s, "copy": 2 * s + 0.01 * rng.normal(size=60), "wave": np.cos(np.arange(60))}
    groups = {r.metric: r.group for r in prepare.group_correlated(frame(spark, {k: v for k, v in cols.items() if k != "flat"}), 0.9).collect()}
    rho = pd.DataFrame(cols).corr(method="spearman").abs()
    assert rho.loc["signal", "copy"] > 0.9 > rho.loc["signal", "wave"]
    assert groups == {"copy": "copy", "signal": "copy", "wave": "wave"}
    kept = {r.representative: list(r.members) for r in prepare.reduce_dimensions(frame(spark, cols), 1e-5, 0.9).collect()}
    assert kept == {"copy": ["copy", "signal"], "wave": ["wave"]}


def test_reconstruction_error(spark):
    """Principal components by singular values of the same windows."""
    rng = np.random.default_rng(2)
    n, window, latent = 80, 4, 3
    a = np.sin(np.arange(n) / 5) + 0.1 * rng.normal(size=n)
    cols = {"a": a, "b": 2 * a + 0.3 * rng.normal(size=n)}
    df = frame(spark, cols)
    model = detect.fit_reconstruction_model(df, ["a", "b"], window, 1, latent)
    x = np.array([np.concatenate([cols[m][i : i + window] for m in ("a", "b")]) for i in range(n - window + 1)])
    train = x[: int(len(x) * 0.8)]
    mean = train.mean(axis=0)
    _, _, vt = np.linalg.svd(train - mean, full_matrices=False)
    p = vt[:latent]
    want = ((x - mean - (x - mean) @ p.T @ p) ** 2).reshape(len(x), 2, window).mean(axis=2)
    got = {(r.metric, r.ts): r.score for r in detect.reconstruction_error(df, model).collect()}
    assert len(got) == 2 * len(x)
    for i in range(len(x)):
        for k, m in enumerate(("a", "b")):
            assert abs(got[m, T0 + dt.timedelta(minutes=5 * (i + window - 1))] - want[i, k]) < 1e-9
    both = df.unionByName(frame(spark, {m: 100 * v for m, v in cols.items()}, "other"))
    own = detect.entity_reconstruction_error(both, detect.fit_entity_models(df, ["a", "b"], window, 1, latent), ["a", "b"], window).collect()
    assert len(own) == len(got) and all(abs(r.score - got[r.metric, r.ts]) < 1e-9 for r in own)


def svd_model(x, latent):
    mean = x.mean(axis=0)
    return mean, np.linalg.svd(x - mean, full_matrices=False)[2][:latent]


def window_matrix(cols, window, stride=1):
    ms = sorted(cols)
    n = len(cols[ms[0]])
    return np.array([np.concatenate([cols[m][i : i + window] for m in ms]) for i in range(0, n - window + 1, stride)])


def test_states_add_up(spark):
    """Moments of parts in any cut and order merge into those of the whole; few rows span few directions."""
    rng = np.random.default_rng(11)
    x = 50 + rng.normal(size=(97, 6)) @ rng.normal(size=(6, 6))
    parts = [p for p in np.split(x, [1, 2, 40, 41, 90]) if len(p)]
    state = [(len(p), p.mean(axis=0), (p - p.mean(axis=0)).T @ (p - p.mean(axis=0))) for p in parts]
    n, mean, scatter = moments.merged(*(np.array(z) for z in zip(*state[::-1], strict=True)))
    assert n == 97 and np.allclose(mean, x.mean(axis=0), atol=1e-12) and np.allclose(scatter, (x - mean).T @ (x - mean), rtol=1e-10)
    few = x[:3]
    assert moments.components(3, few.mean(axis=0), (few - few.mean(axis=0)).T @ (few - few.mean(axis=0)), 5).shape == (2, 6)
    df = spark.createDataFrame([("e", i % 4, [float(v) for v in r]) for i, r in enumerate(x)], "entity string, day int, x array<double>").repartition(5)
    got = moments.merge_states(moments.moment_states(df, "entity", bucket=F.col("day")), ["entity"]).first()
    assert got["n"] == 97 and np.allclose(got["mean"], mean) and np.allclose(np.reshape(got["scatter"], (6, 6)), scatter)


def test_refit_from_states(spark):
    """The model after a deployment comes from kept states alone and equals that of the scaled windows; thresholds are of held-out windows."""
    rng = np.random.default_rng(12)
    n, window, latent = 24 * 12, 4, 3
    cols = {m: 20 * k + np.sin(np.arange(n) / (5 + k)) * 3 + rng.normal(size=n) for k, m in enumerate("ab", 1)}
    cols["b"][-60:] += 9 * rng.normal(size=60)  # the last hours are noisier
    df = frame(spark, cols)
    states = detect.daily_states(df, ["a", "b"], window, 1, bucket="hour")
    due = spark.createDataFrame([("e", T0 + dt.timedelta(hours=9, minutes=30), True), ("other", T0, True)], "entity string, deployed timestamp_ntz, due boolean")
    models, thresholds, bounds = detect.rebaseline_model(df, due, states, ["a", "b"], window, 1, latent, bucket="hour")
    since = {m: v[9 * 12 + 6 :] for m, v in cols.items()}
    lo, hi = ({m: f(v) for m, v in since.items()} for f in (min, max))
    scaled = window_matrix({m: (v - lo[m]) / (hi[m] - lo[m]) for m, v in cols.items()}, window)
    # windows that begin in hours 10 to 23: 14 buckets, of which the last 2 are held out
    train, held = scaled[10 * 12 : 22 * 12], scaled[22 * 12 :]
    mean, p = svd_model(train, latent)
    got = models.first()
    assert models.count() == 1 and np.allclose(got.mean, mean, atol=1e-10)
    assert np.allclose(np.array(got.components).T @ np.array(got.components), p.T @ p, atol=1e-8)
    e = ((held - mean - (held - mean) @ p.T @ p) ** 2).reshape(len(held), 2, window).mean(axis=2)
    told = {r.metric: r.threshold for r in thresholds.collect()}
    assert np.allclose([told["a"], told["b"]], np.percentile(e, 99, axis=0), rtol=1e-8)
    inside = ((train - mean - (train - mean) @ p.T @ p) ** 2).reshape(len(train), 2, window).mean(axis=2)
    assert told["b"] > 2 * np.percentile(inside, 99, axis=0)[1]  # thresholds of the training windows would flag every noisy hour


def test_pipeline_thresholds_are_held_out(spark):
    """Errors on windows that the model was fitted to are smaller than those on others; only the latter calibrate."""
    rng = np.random.default_rng(13)
    cols = {m: rng.normal(size=160) for m in "abc"}
    df = frame(spark, cols)
    models = detect.fit_entity_models(df, ["a", "b", "c"], 4, 1, 8)
    x = window_matrix(cols, 4)
    cut = int(len(x) * 0.8)
    mean, p = svd_model(x[:cut], 8)
    e = ((x - mean - (x - mean) @ p.T @ p) ** 2).reshape(len(x), 3, 4).mean(axis=2)
    got = {r.metric: r.threshold for r in detect.calibrate_thresholds(detect.held_out_errors(df, models, ["a", "b", "c"], 4, 1)).collect()}
    assert np.allclose([got[m] for m in "abc"], np.percentile(e[cut:], 99, axis=0), rtol=1e-8)
    out = run_pipeline(df, df, ["a", "b", "c"], spark.createDataFrame([], "ts timestamp_ntz, description string, type string"), 4)
    lo, hi = ({m: f(v) for m, v in cols.items()} for f in (min, max))
    x = window_matrix({m: (v - lo[m]) / (hi[m] - lo[m]) for m, v in cols.items()}, 4, 5)
    cut = int(len(x) * 0.8)
    mean, p = svd_model(x[:cut], min(32, 11, cut - 1))
    e = ((x - mean - (x - mean) @ p.T @ p) ** 2).reshape(len(x), 3, 4).mean(axis=2)
    told = {r.metric: r.threshold for r in out["thresholds"].collect()}
    assert np.allclose([told[m] for m in "abc"], np.percentile(e[cut:], 99, axis=0), rtol=1e-8)
    assert not np.allclose([told[m] for m in "abc"], np.percentile(e[:cut], 99, axis=0), rtol=0.05)


def _least_squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    beta, _, rank, _ = np.linalg.lstsq(x, y, rcond=None)
    if rank < x.shape[1]:
        raise np.linalg.LinAlgError("singular")
    return beta, float(((y - x @ beta) ** 2).sum()), np.linalg.inv(x.T @ x)


def adf_plain(series: np.ndarray) -> float:
    """Unit-root test with a constant; the lag has the least AIC on a common sample, then the test uses its own sample."""
    y = np.asarray(series, dtype=float)
    n = len(y)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    if most < 0 or np.ptp(y) == 0:
        raise ValueError("too short or constant")
    dy = np.diff(y)

    def design(lag: int, start: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(start, len(dy))
        return np.column_stack([y[rows], *[dy[rows - i] for i in range(1, lag + 1)], np.ones(len(rows))]), dy[rows]

    def aic(lag: int) -> float:
        x, d = design(lag, most)
        _, ssr, _ = _least_squares(x, d)
        m = len(d)
        return m * (math.log(2 * math.pi * ssr / m) + 1) + 2 * x.shape[1]

    lag = min(range(most + 1), key=aic)
    x, d = design(lag, lag)
    beta, ssr, inverse = _least_squares(x, d)
    return stats.unit_root_p(beta[0] / math.sqrt(ssr / (len(d) - x.shape[1]) * inverse[0, 0]))


def test_unit_roots_from_sums(spark):
    """The same p as least squares on the whole series, at several lengths, with nulls, and none where it can't be tested."""
    rng = np.random.default_rng(9)
    cols = {f"walk{n}": 1000 + rng.normal(size=n).cumsum() for n in (12, 40, 150, 900)} | {f"noise{n}": 5 * rng.normal(size=n) for n in (9, 33, 400)}
    cols |= {"wave": np.sin(np.arange(300) / 9) + 0.1 * rng.normal(size=300), "gaps": [None if i % 9 == 2 else v for i, v in enumerate(rng.normal(size=200).cumsum())]}
    cols |= {"flat": [3.0] * 50, "short": [1.0, 2.0, 4.0], "none": [None] * 8, "line": [float(i) for i in range(60)]}
    got = {r.metric: r.p_value for r in causal.adf_report(incident(spark, cols)).collect()}
    assert set(got) == set(cols) and all(got[m] is None for m in ("flat", "short", "none", "line"))
    for m, p in got.items():
        if p is not None:
            assert abs(p - adf_plain(np.array([v for v in cols[m] if v is not None]))) < 1e-9, m


def test_differences_until_stationary(spark):
    """A series that needs two differences gets them, and nulls in it spread as they do in plain differences."""
    rng = np.random.default_rng(10)
    cols = {"twice": rng.normal(size=200).cumsum().cumsum(), "once": rng.normal(size=200).cumsum(), "noise": rng.normal(size=200)}
    cols["once"][[0, 60]] = np.nan
    given = {m: [None if np.isnan(v) else v for v in vs] for m, vs in cols.items()}
    rows = causal.make_stationary(incident(spark, given)).collect()
    for m, vs in cols.items():
        want = pd.Series(vs)
        for _ in range({"twice": 2, "once": 1, "noise": 0}[m]):
            want = want.diff()
        got = {int((r.ts - T0).total_seconds() // 300): r.value for r in rows if r.metric == m}
        want = want.dropna().to_dict()
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got), m


def test_stationarity(spark):
    rng = np.random.default_rng(3)
    cols = {"noise": rng.normal(size=300), "walk": rng.normal(size=300).cumsum()}
    s = incident(spark, cols)
    n = {r.metric: r["count"] for r in causal.make_stationary(s).groupBy("metric").count().collect()}
    assert n == {"noise": 300, "walk": 299}
    report = {r.metric: r for r in causal.adf_report(s).collect()}
    assert report["noise"].stationary and not report["walk"].stationary and report["walk"].p_value > 0.05


def rss(y, cols):
    x = np.column_stack([*cols, np.ones(len(y))])
    return ((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum()


def test_granger_by_least_squares(spark):
    """Every ordered pair of more metrics than one group tests, one with gaps, against least squares."""
    rng = np.random.default_rng(4)
    n, most = 120, 3
    a = rng.normal(size=n)
    cols = {f"m{k:02d}": rng.normal(size=n) for k in range(15)} | {"a": a, "b": np.concatenate(([0], 2 * a[:-1])) + 0.1 * rng.normal(size=n), "z": rng.normal(size=n)}
    gaps = cols | {"z": [None if i % 7 == 0 else v for i, v in enumerate(cols["z"])]}
    got = {(r.cause, r.effect): (r.p_value, r.optimal_lag) for r in causal.granger_raw(incident(spark, gaps), most, 1.1).collect()}
    assert len(got) == 18 * 17 and got["a", "b"][0] < 1e-12 and got["a", "b"][1] == 1
    for cause, effect in (("a", "b"), ("b", "a"), ("m03", "a"), ("z", "m14"), ("m07", "z")):
        known = np.array([u is not None and v is not None for u, v in zip(gaps[cause], gaps[effect], strict=True)])
        x, y = (np.array([v for v, k in zip(gaps[c], known, strict=True) if k], dtype=float) for c in (cause, effect))
        best = (1.0, None)
        for lag in range(1, most + 1):
            own = [y[lag - k : len(y) - k] for k in range(1, lag + 1)]
            r0, r1 = rss(y[lag:], own), rss(y[lag:], own + [x[lag - k : len(x) - k] for k in range(1, lag + 1)])
            df = len(y) - lag - (2 * lag + 1)
            p = stats.f_tail((r0 - r1) / r1 / lag * df, lag, df)
            best = (p, lag) if p < best[0] else best
        assert got[cause, effect][1] == best[1] and abs(got[cause, effect][0] - best[0]) < 1e-8


def test_partial_correlation(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(size=200)
    cols = {"x": z + 0.5 * rng.normal(size=200), "y": z + 0.5 * rng.normal(size=200), "z": z}
    r = causal.partial_corr_test(incident(spark, cols), "x", "y", ["z"]).first()
    left = [cols[m] - np.polyval(np.polyfit(z, cols[m], 1), z) for m in ("x", "y")]
    assert abs(r.r - np.corrcoef(*left)[0, 1]) < 1e-9
    assert r.independent == (r.p_value > 0.05) and causal.partial_corr_test(incident(spark, cols), "x", "y", []).first().p_value < 1e-10


def chain(rng, n=150):
    a = rng.normal(size=n)
    b = np.concatenate(([0], 1.5 * a[:-1])) + 0.2 * rng.normal(size=n)
    return {"a": a, "b": b, "c": np.concatenate(([0, 0], 1.5 * b[1:-1])) + 0.2 * rng.normal(size=n)}


def test_diagnose(spark):
    """Scores and ranks recomputed from the graph it reports."""
    series = incident(spark, chain(np.random.default_rng(6)))
    seen = {"a": 0, "b": 5, "c": 10}
    severity = {"a": 0.9, "b": 0.7, "c": 0.8}
    inc = spark.createDataFrame([("i", m, severity[m], T0 + dt.timedelta(minutes=60 + t)) for m, t in seen.items()], "incident_id string, metric string, max_score double, first_seen timestamp_ntz")
    events = spark.createDataFrame([(T0 + dt.timedelta(minutes=40), "release", "deployment")], "ts timestamp_ntz, description string, type string")
    out = diagnose(series, inc, events, max_lag=3, alpha=0.01)
    edges = {(r.cause, r.effect): r.strength for r in out["edges"].collect()}
    assert ("a", "b") in edges and not any((y, x) in edges for x, y in edges)
    ms = sorted(seen)
    deg = {m: (sum(x == m for x, _ in edges), sum(y == m for _, y in edges)) for m in ms}
    move = np.zeros((3, 3))
    for (x, y), w in edges.items():
        move[ms.index(x), ms.index(y)] = w
    total = move.sum(axis=0)
    pr = np.full(3, 1 / 3)
    for _ in range(100):
        pr = 0.15 / 3 + 0.85 * (pr[total == 0].sum() / 3 + move @ (pr / np.where(total > 0, total, 1)))
    most = [max(1, max(d[k] for d in deg.values())) for k in (0, 1)]
    want = {}
    for k, m in enumerate(ms):
        h = 0.4 * deg[m][0] / most[0] + 0.3 * (1 - seen[m] / 10) + 0.2 * (1 - deg[m][1] / most[1]) + 0.05 * severity[m] + 0.05 / (1 + (20 + seen[m]) / 60)
        want[m] = min(1, 0.7 * h + 0.3 * pr[k])
    ranked = out["ranked"].orderBy("rank").collect()
    assert [r.metric for r in ranked] == sorted(ms, key=lambda m: -want[m]) and ranked[0].metric == "a"
    assert all(abs(r.composite_score - want[r.metric]) < 1e-5 for r in ranked)
    topology = spark.createDataFrame([("x_a", "x_b", 1, 1.0)], "src string, dst string, weight long, avg_latency_ms double")
    late = diagnose(series, inc, events, topology, 3, 0.01, prune="after")["ranked"].orderBy("rank").collect()
    assert [r.metric for r in late] == [r.metric for r in ranked]


def test_run_pipeline(spark):
    rng = np.random.default_rng(7)
    calm = {m: np.sin(np.arange(200) / 9 + k) + 0.1 * rng.normal(size=200) for k, m in enumerate("ab")}
    bad = {m: np.sin(np.arange(60) / 9 + k) + 0.1 * rng.normal(size=60) for k, m in enumerate("ab")}
    bad["a"][30:] += 6
    bad["b"][33:] += 6
    none = spark.createDataFrame([], "entity string, ts timestamp_ntz, description string, type string")
    out = run_pipeline(frame(spark, calm), frame(spark, bad), ["a", "b"], none, 6)
    scores = out["scores"].toPandas()
    flagged = scores[scores.is_anomaly].groupby("metric").ts.min().to_dict()
    got = {r.metric: r for r in out["incidents"].collect()}
    assert set(got) == set(flagged) and "a" in got
    assert all(got[m].first_seen == flagged[m].to_pydatetime() and abs(got[m].max_score - scores[scores.metric == m].score.max()) < 1e-12 for m in got)
    of_a = scores[scores.metric == "a"]
    assert of_a.loc[of_a.score.idxmax()].ts >= T0 + dt.timedelta(minutes=5 * 30)
    reports = out["reports"].collect()
    assert len(reports) == 1 and "Most likely root cause: `" in reports[0].report


def test_symptoms_far_away(spark):
    """A chain of twenty metrics: no depth at which paths end silently."""
    edges = spark.createDataFrame([("i", f"m{k:02d}", f"m{k + 1:02d}", 2) for k in range(20)], "incident_id string, cause string, effect string, lag int")
    roots = spark.createDataFrame([("i", "m00", T0)], "incident_id string, root string, started timestamp_ntz")
    got = {r.metric: r for r in quality.symptom_times(edges, roots).collect()}
    assert len(got) == 20 and got["m20"].lag == 40 and got["m20"].expected == T0 + dt.timedelta(seconds=40 * 300)
    paths = [r.path for r in quality.paths_to_leaves(edges.where("cause >= 'm10'")).collect()]
    assert len(paths) == 10 and max(p.count("→") for p in paths) == 10


def test_only_wanted_services_are_searched(spark):
    calls = spark.createDataFrame([(f"s{k}", f"s{k + 1}") for k in range(12)] + [("x", "y")], "src string, dst string")
    pairs = spark.createDataFrame([("s0", "s12"), ("s12", "s0"), ("s3", "x"), ("y", "x"), ("s5", "nowhere")], "src string, dst string")
    assert {(r.src, r.dst) for r in graph.reachable_pairs(calls, pairs).collect()} == {("s0", "s12"), ("s12", "s0"), ("y", "x")}


def test_events_from_files(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"timestamp": "2024-01-02 00:00:00", "description": "new", "type": "deployment"}\n{"timestamp": "2023-01-01 00:00:00", "description": "old"}\n{"timestamp": "soon"}\n')
    as_of = F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")
    assert [r.description for r in ev.load_events(spark, str(tmp_path), as_of).collect()] == ["new"]
    assert ev.load_events(spark, str(tmp_path / "absent"), as_of).count() == 0
    sinks.write_report(spark.createDataFrame([("i", '{"a":1}')], "incident_id string, report string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == '{"a":1}'


def brute_reach(edges):
    links = {}
    for a, b in edges:
        links.setdefault(a, set()).add(b)
        links.setdefault(b, set())
    far = graph.reached(links)
    comp = {n: min([n, *(m for m in far[n] if n in far[m])]) for n in links}
    level = dict.fromkeys(comp.values(), 0)
    for _ in level:
        for a, b in edges:
            if comp[a] != comp[b]:
                level[comp[b]] = max(level[comp[b]], level[comp[a]] + 1)
    return far, comp, level


@pytest.mark.parametrize("small", [0, 1_000])
def test_condensed_graph_answers_every_pair(spark, small):
    """Components, levels and pairs of a graph with cycles, chains, self calls and repeats, by joins and walked whole."""
    r = np.random.default_rng(14)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 40, size=(48, 2))]
    edges += [(100 + i, 101 + i) for i in range(5)] + [(105, 103), (103, 100), (7, 7), (200, 200), (300, 301), (301, 302), (302, 300), edges[0]]
    services, links = condense.condensed(spark.createDataFrame(edges, "src long, dst long"), small=small)
    far, comp, level = brute_reach(edges)
    assert {r.node: (r.component, r.level) for r in services.collect()} == {n: (c, level[c]) for n, c in comp.items()}
    assert {(r.src, r.dst) for r in links.collect()} == {(comp[a], comp[b]) for a, b in edges if comp[a] != comp[b]}
    nodes = sorted(comp)
    pairs = [(a, b) for a in nodes for b in nodes] + [(1, 999)]
    got = {(r.src, r.dst) for r in condense.joined_pairs(services, links, spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {(a, b) for a in nodes for b in nodes if a == b or b in far[a] or a in far[b]}


def test_every_simple_cycle_once():
    """Against a plain search, on graphs dense enough to block nodes."""
    r = np.random.default_rng(15)
    for n, m in ((4, 8), (5, 14), (6, 14), (7, 20)):
        for _ in range(6):
            links = {}
            for a, b in r.integers(0, n, size=(m, 2)):
                if a != b:
                    links.setdefault(str(a), set()).add(str(b))

            def walk(path, links=links):
                for x in sorted(links.get(path[-1], ())):
                    if x == path[0]:
                        yield path
                    elif x > path[0] and x not in path:
                        yield from walk([*path, x])

            assert list(graph.simple_cycles(links)) == [c for s in sorted(links) for c in walk([s])]


def test_each_cycle_loses_its_weakest_remaining_edge(spark):
    rows = [("i", "a", "b", 0.9), ("i", "b", "a", 0.1), ("i", "a", "c", 0.8), ("i", "c", "b", 0.7), ("j", "x", "y", 0.5), ("j", "y", "x", 0.5), ("k", "x", "y", 0.5)]
    edges = spark.createDataFrame(rows, "incident_id string, cause string, effect string, strength double")
    kept = sorted((r.incident_id, r.cause, r.effect) for r in graph.break_cycles_weakest(edges).collect())
    assert kept == [("i", "a", "b"), ("i", "a", "c"), ("j", "y", "x"), ("k", "x", "y")]
    few = graph.break_cycles_weakest(edges, most=1).collect()  # what is left after one cycle goes by strength
    links = {}
    for e in few:
        links.setdefault((e.incident_id, e.cause), set()).add((e.incident_id, e.effect))
    assert len(few) == 5 and not any(n in far for n, far in graph.reached(links).items())


def test_payload_texts(spark):
    """Whole answers and bare lists are read with labels in order; everything else is a reject with its reason."""
    series = '[{"metric": {"zone": "z", "__name__": "up", "a": "1"}, "values": [[1704067200.5, "2"], [1704067260, "NaN"]]}]'
    bodies = [series, '{"status": "success", "data": {"resultType": "matrix", "result": ' + series + "}}", series[:-4], "", None, "text", '{"status": "error", "error": "no"}', '{"status": "success", "data": {}}', "{}", '[{"metric": 3}]', "[]"]
    texts = spark.createDataFrame([("e", str(i), b) for i, b in enumerate(bodies)], "entity string, query string, body string")
    good, bad = payloads.read_range_payloads(texts)
    got = {r.query: r.result for r in good.collect()}
    assert set(got) == {"0", "1", "10"} and got["0"] == got["1"] and got["10"] == []
    samples = payloads.range_payload_samples(good.where("query = '0'")).orderBy("ts").collect()
    assert [r.metric for r in samples] == ["up_zone_z_a_1"] * 2 and samples[0].value == 2
    assert {r.query: r.reason for r in bad.collect()} == {"2": "not valid", "3": "empty", "4": "empty", "5": "not valid", "6": "failed: no", "7": "no result", "8": "failed: no status", "9": "not valid"}
    point = '{"Label": "x", "Datapoints": [{"Timestamp": "2024-01-01T00:00:00Z", "Average": 1.5, "Unit": "Percent"}]}'
    texts = spark.createDataFrame([("e", "A/B", [], point), ("e", "A/B", [], "{}"), ("e", "A/B", [], point[:-1])], "entity string, namespace string, dimensions array<struct<Name: string, Value: string>>, body string")
    good, bad = payloads.read_datapoint_payloads(texts)
    assert [r.Datapoints[0].Average for r in good.collect()] == [1.5] and sorted(r.reason for r in bad.collect()) == ["no result", "not valid"]


def dense_pagerank(names, edges, damping=0.85):
    at, n = {m: k for k, m in enumerate(names)}, len(names)
    move = np.zeros((n, n))
    for c, e, w in edges:
        if c in at and e in at:
            move[at[c], at[e]] += w
    out = move.sum(axis=0)
    move /= np.where(out > 0, out, 1)
    r = np.full(n, 1 / n)
    for _ in range(100):
        was, r = r, (1 - damping) / n + damping * (r[out == 0].sum() / n + move @ r)
        if abs(r - was).sum() < n * 1e-6:
            break
    return dict(zip(names, r, strict=True))


@pytest.mark.parametrize("grouped", [0, 20, 1_000_000])
def test_pagerank_by_groups_and_joins(spark, grouped):
    """The converged ranks of small and large incidents against a dense matrix: dangling nodes, repeated links, unknown metrics, no links at all."""
    r = np.random.default_rng(16)
    nodes, edges = [("lone", "x"), ("pair", "x"), ("pair", "y")], [("pair", "x", "y", 0.5), ("pair", "x", "gone", 0.9), ("none", "a", "b", 0.2)]
    nodes += [("big", f"m{k}") for k in range(30)]
    edges += [("big", f"m{a}", f"m{b}", float(w)) for a, b, w in zip(r.integers(0, 30, 70), r.integers(0, 24, 70), r.random(70), strict=True)]
    n = spark.createDataFrame(nodes, "incident_id string, metric string")
    e = spark.createDataFrame(edges, "incident_id string, cause string, effect string, strength double")
    got = {(x.incident_id, x.metric): x.pagerank for x in rank.pagerank(n, e, grouped=grouped).collect()}
    assert set(got) == set(nodes)
    for i in ("lone", "pair", "big"):
        want = dense_pagerank(sorted(m for j, m in nodes if j == i), [(c, f, w) for j, c, f, w in edges if j == i])
        assert all(abs(got[i, m] - v) < 1e-9 for m, v in want.items()), i
    plain = {(x.incident_id, x.metric): x.pagerank for x in rank.pagerank(n, e, weighted=False, rounds=3, grouped=grouped).collect()}
    assert abs(sum(v for (i, _), v in plain.items() if i == "big") - 1) < 1e-9


def test_calls_within_a_trace(spark):
    span = lambda i, p, d, *up: (i, p, d, [("CHILD_OF", u) if u[0] != "~" else ("FOLLOWS_FROM", u[1:]) for u in up])
    trace = [
        ("t1", [span("a", "p1", 5), span("b", "p2", 1000, "a"), span("c", "p2", 3000, "a", "b"), span("d", "p9", 7, "a"), span("e", "p3", 8, "~a"), span("f", "p3", 10, "missing")], {"p1": ("web",), "p2": ("db",), "p3": ("mq",)}),
        ("t2", [span("b", "p1", 2000, "a"), span("a", "p2", 1), span("a", "p1", 1)], {"p1": ("db",), "p2": ("web",)}),
    ]
    df = spark.createDataFrame(trace, "traceID string, spans array<struct<spanID: string, processID: string, duration: long, references: array<struct<refType: string, spanID: string>>>>, processes map<string,struct<serviceName: string>>")
    assert [tuple(r) for r in ev.traces_to_topology(df).collect()] == [("web", "db", 3, 2.0)]


def long_series(spark, n=67):
    r = np.random.default_rng(17)
    cols = {"a": r.normal(size=n), "flat": np.ones(n), "late": r.normal(size=n), "b": r.normal(size=n).round()}
    cols = {m: [float(v) for v in vs] for m, vs in cols.items()} | {"none": [None] * n}
    for m, gone in (("a", [0, 1, 2, 9, 20, 21, 22, 23, 24, 25, 26, 27, 28, 40, 64, 65, 66]), ("late", range(45)), ("b", range(3, n, 4))):
        for i in gone:
            cols[m][i] = None
    return prepare.reindex_grid(frame(spark, cols), "5 minutes").repartition(5)


@pytest.mark.parametrize("size", [1, 2, 7, 13, 500])
def test_chunked_scans_equal_plain_ones(spark, size):
    """Filling, spikes, trends and alerts of series cut into pieces of any length."""
    df = long_series(spark)
    key = lambda d: sorted(map(str, d.collect()))
    for limit in (None, 2, 6):
        assert key(prepare.fill_gaps(df, limit, size)) == key(prepare.fill_gaps(df, limit))
    close = lambda d, c: {(r.metric, r.ts): r[c] for r in d.collect()}
    for f, c in ((detect.spike_score, "spike"), (detect.trend_r2, "trend")):
        got, want = close(f(df, 5, size), c), close(f(df, 5), c)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    flags = df.select("entity", "metric", "ts", (F.col("value") > -0.8).alias("is_anomaly"))
    for required, cooldown in ((1, 0), (2, 3), (4, 1)):
        assert key(detect.dampen_alerts(flags, required, cooldown, 300 * size)) == key(detect.dampen_alerts(flags, required, cooldown))


def test_wide_structures_equal_grouped_ones(spark, monkeypatch):
    """Pairs dealt out level by level find the skeleton and the directions of the search on one matrix."""
    r = np.random.default_rng(18)
    monkeypatch.setattr(causal, "PAIRS", 4)
    df = None
    for name, n in (("i", 9), ("j", 4), ("k", 2)):
        x = r.normal(size=(120, n))
        for k in range(2, n):
            x[:, k] += x[:, r.integers(0, k)] + 0.7 * x[:, r.integers(0, k)]
        one = incident(spark, {f"m{k}": x[:, k] for k in range(n)}, name)
        df = one if df is None else df.unionByName(one)
    key = lambda d: sorted(map(tuple, d.collect()))
    plain = key(causal.pc_structure(df, 0.05))
    assert key(causal.pc_structure(df, 0.05, grouped=0)) == plain == key(causal.pc_structure(df, 0.05, grouped=4))
    assert any(e[3] for e in plain) and len([e for e in plain if e[0] == "i"]) >= 8


def test_factors_in_one_stack_equal_those_one_by_one(spark):
    """Degrees, priorities, severities, events and ranks, with metrics that only some tables know."""
    r = np.random.default_rng(19)
    names = [(i, f"m{k}") for i in "ab" for k in range(6)] + [("c", "m0")]
    nodes = spark.createDataFrame([(*n, float(r.random()) if k % 4 else None) for k, n in enumerate(names)], "incident_id string, metric string, anomaly_score double")
    edges = [(i, f"m{a}", f"m{b}") for i in "ab" for a, b in r.integers(0, 8, size=(9, 2))]
    edges = spark.createDataFrame(edges, "incident_id string, cause string, effect string")
    seen = spark.createDataFrame([(i, m, T0 + dt.timedelta(minutes=int(r.integers(0, 90))) if k % 3 else None) for k, (i, m) in enumerate([*names, ("a", "m7")])], "incident_id string, metric string, first_seen timestamp_ntz")
    found = spark.createDataFrame([(i, m, float(r.random())) for i, m in names[::2] * 3] + [("z", "m0", 0.4)], "incident_id string, metric string, correlation_score double")
    ranks = spark.createDataFrame([(i, m, float(r.random())) for i, m in names[1:]], "incident_id string, metric string, pagerank double")
    got = {(x.incident_id, x.metric): x for x in rank.factors(nodes, edges, seen, found, ranks).collect()}
    assert set(got) == set(names)
    parts = [(rank.degree_scores(nodes, edges), ["causal_outflow", "causal_inflow"]), (rank.temporal_priority(seen), ["temporal_priority"]), (nodes.withColumnRenamed("anomaly_score", "anomaly_severity"), ["anomaly_severity"]), (rank.event_factor(found), ["event_correlation"]), (ranks, ["pagerank"])]
    for df, columns in parts:
        told = {(x.incident_id, x.metric): x for x in df.collect()}
        for key, row in got.items():
            for c in columns:
                assert abs(row[c] - ((told[key][c] or 0.0) if key in told else 0.0)) < 1e-12, (key, c)


def test_a_wrong_timestamp_is_an_error(spark):
    rows = [("e", "a", T0, 1.0), ("e", "a", dt.datetime(2124, 1, 1), 1.0)]
    with pytest.raises(Exception, match="more than"):
        prepare.reindex_grid(spark.createDataFrame(rows, LONG), "1 minutes").collect()
    lines = spark.createDataFrame([("e", t, "INFO") for _, _, t, _ in rows], "entity string, ts timestamp_ntz, level string")
    with pytest.raises(Exception, match="more than"):
        logs.bin_log_levels(lines, "1 minutes").collect()
    assert prepare.reindex_grid(spark.createDataFrame(rows, LONG), "30 days").count() == 1218

