"""Lagged regression tests and conditional-independence structure."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causetrace.functions import stats
from causetrace.functions.shared import dropped, settled
from causetrace.operators import lagged

#: Conditioning sets that one batch of inverses takes, and pairs that one group tests.
BATCH, PAIRS = 1024, 64


def make_stationary(series: DataFrame) -> DataFrame:
    """``incident_id, metric, ts, value``, differenced at most twice until the unit-root test rejects at 5 %.

    The second difference isn't tested again; leading nulls go. A series that can't be tested is left out. Tests use sums alone; how often a
    series is differenced is joined to its rows. ``series`` is read three times: store it first if it is costly.
    """
    rows = series.select("incident_id", "metric", "ts", F.col("value").cast("double").alias("value"))
    key = ["incident_id", "metric"]
    w = Window.partitionBy(*key).orderBy("ts")
    steps = rows.select(*key, "ts", "value", (F.col("value") - F.lag("value").over(w)).alias("d1"), (F.col("value") - 2 * F.lag("value").over(w) + F.lag("value", 2).over(w)).alias("d2"))
    # both tests in one pass: the series and its first difference side by side
    tried = steps.select(*key, "ts", F.inline(F.array(F.struct(F.lit(0).alias("times"), "value"), F.struct(F.lit(1).alias("times"), F.col("d1").alias("value")))))
    told = lagged.unit_root_tests(tried, (*key, "times")).groupBy(*key).agg(*[F.max(F.when(F.col("times") == k, F.col("p_value"))).alias(f"p{k}") for k in (0, 1)])
    times = F.when(F.col("p0") < 0.05, 0).when(F.col("p0").isNotNull() & (F.col("p1") < 0.05), 1).when(F.col("p0").isNotNull() & F.col("p1").isNotNull(), 2)
    placed = steps.join(told.select(*key, times.alias("times")).where("times is not null"), key)
    value = F.when(F.col("times") == 0, F.col("value")).when(F.col("times") == 1, F.col("d1")).otherwise(F.col("d2"))
    return placed.select(*key, "ts", value.alias("value")).where("value is not null")


def adf_report(series: DataFrame) -> DataFrame:
    """``p_value, stationary`` (p < 0.05) of each metric; null where the test isn't possible."""
    names = series.select("incident_id", "metric").distinct()
    tested = names.join(lagged.unit_root_tests(series), ["incident_id", "metric"], "left")
    return tested.select("incident_id", "metric", "p_value", (F.col("p_value") < 0.05).alias("stationary"))


def _pairs(series: DataFrame) -> DataFrame:
    """Aligned rows of every ordered pair of an incident's metrics, numbered: ``incident_id, cause, effect, i, x, y``."""
    mean = F.avg("value").over(Window.partitionBy("incident_id", "metric"))
    s = series.where("value is not null").withColumn("value", F.col("value") - mean)
    x = s.select("incident_id", "ts", F.col("metric").alias("cause"), F.col("value").alias("x"))
    y = s.select("incident_id", "ts", F.col("metric").alias("effect"), F.col("value").alias("y"))
    at = F.row_number().over(Window.partitionBy("incident_id", "cause", "effect").orderBy("ts")) - 1
    return x.join(y, ["incident_id", "ts"]).where("cause <> effect").withColumn("i", at)


def granger(series: DataFrame, max_lag: int = 10, alpha: float = 0.05, stationary: bool = True, rounded: bool = True) -> DataFrame:
    """Significant ordered pairs: ``incident_id, cause, effect, p_value, optimal_lag, strength``.

    For each lag order the F-test of the cause's lags; the smallest p wins, the first on ties. Pairs with fewer than
    3·max_lag common rows, and pairs that a numerical failure stops, are left out. Series are added up in Spark; the tests see sums for each lag (``lagged``).
    """
    sums = lagged.pair_sums(make_stationary(series) if stationary else series, max_lag, 3 * max_lag)
    strength = 1 - F.col("p_value")
    return lagged.lag_tests(sums, max_lag, alpha).withColumn("strength", F.round(strength, 6) if rounded else strength)


def granger_raw(series: DataFrame, max_lag: int = 10, alpha: float = 0.05) -> DataFrame:
    """The same on the series as they are, strength not rounded."""
    return granger(series, max_lag, alpha, stationary=False, rounded=False)


def granger_f_lag1(series: DataFrame) -> DataFrame:
    """The F statistic at lag 1 of every ordered pair, from aggregates alone: ``incident_id, cause, effect, n, f``."""
    w = Window.partitionBy("incident_id", "cause", "effect").orderBy("i")
    rows = _pairs(series).select("incident_id", "cause", "effect", "y", F.lag("y").over(w).alias("u"), F.lag("x").over(w).alias("v")).where("u is not null")
    co = lambda a, b: F.covar_pop(a, b).alias(f"{a}{b}")
    g = rows.groupBy("incident_id", "cause", "effect").agg(F.count(F.lit(1)).alias("n"), *[co(a, b) for a, b in ("yy", "uu", "vv", "yu", "yv", "uv")])
    own = F.col("yy") - F.col("yu") * F.col("yu") / F.col("uu")
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    explained = (F.col("yu") * F.col("yu") * F.col("vv") - 2 * F.col("yu") * F.col("yv") * F.col("uv") + F.col("yv") * F.col("yv") * F.col("uu")) / det
    joint = F.col("yy") - explained
    return g.select("incident_id", "cause", "effect", "n", ((own - joint) / joint * (F.col("n") - 3)).alias("f"))


def correlation_rows(series: DataFrame) -> DataFrame:
    """``incident_id, a, b, r, n`` over the times at which all of an incident's metrics are known; one distributed pass."""
    known = series.where("value is not null")
    size = known.groupBy("incident_id").agg(F.countDistinct("metric").alias("m"))
    full = known.groupBy("incident_id", "ts").agg(F.count(F.lit(1)).alias("c")).join(size, "incident_id").where("c = m").select("incident_id", "ts")
    rows = known.join(full, ["incident_id", "ts"], "left_semi")
    x = rows.select("incident_id", "ts", F.col("metric").alias("a"), F.col("value").alias("x"))
    y = rows.select("incident_id", "ts", F.col("metric").alias("b"), F.col("value").alias("y"))
    return x.join(y, ["incident_id", "ts"]).where("a <= b").groupBy("incident_id", "a", "b").agg(F.corr("x", "y").alias("r"), F.count(F.lit(1)).alias("n"))


def first_separating(corr: np.ndarray, i: int, j: int, side: list[int], size: int, n: int, alpha: float) -> tuple[int, ...] | None:
    """The first ``size`` of ``side``, in order, given which i and j pass as independent; inverses are taken a batch at a time."""
    sets = combinations(side, size)
    while batch := list(islice(sets, BATCH)):
        at = np.array([(i, j, *s) for s in batch])
        p = np.linalg.pinv(corr[at[:, :, None], at[:, None, :]])
        with np.errstate(divide="ignore", invalid="ignore"):
            r = np.clip(-p[:, 0, 1] / np.sqrt(np.abs(p[:, 0, 0] * p[:, 1, 1])), -1, 1)
        for s, x in zip(batch, r, strict=True):
            if stats.fisher_z_p(float(x), n, size) > alpha:
                return s
    return None


def skeleton(corr: np.ndarray, n: int, alpha: float) -> tuple[dict[int, set[int]], dict[tuple[int, int], tuple[int, ...]]]:
    """(neighbours, separating sets) of a small matrix: the stable search by levels."""
    p = len(corr)
    adj = {i: set(range(p)) - {i} for i in range(p)}
    apart: dict[tuple[int, int], tuple[int, ...]] = {}
    size = 0
    while any(len(adj[i]) - 1 >= size for i in adj):
        frozen = {i: frozenset(adj[i]) for i in adj}
        for i, j in combinations(range(p), 2):
            if j not in adj[i]:
                continue
            for side in (frozen[i] - {j}, frozen[j] - {i}):
                hit = first_separating(corr, i, j, sorted(side), size, n, alpha)
                if hit is not None:
                    adj[i].discard(j)
                    adj[j].discard(i)
                    apart[i, j] = apart[j, i] = hit
                    break
        size += 1
    return adj, apart


def oriented(names: list[str], adj: dict[int, set[int]], apart: dict[tuple[int, int], tuple[int, ...]]) -> list[tuple[str, str, bool]]:
    """Unshielded colliders, then Meek's first three rules: (cause, effect, directed)."""
    p = len(names)
    arrow: set[tuple[int, int]] = set()
    for k in range(p):
        for i, j in combinations(sorted(adj[k]), 2):
            if j not in adj[i] and k not in apart.get((i, j), ()):
                arrow |= {(i, k), (j, k)}
    arrow -= {(a, b) for a, b in arrow if (b, a) in arrow}
    loose = lambda a, b: b in adj[a] and (a, b) not in arrow and (b, a) not in arrow
    changed = True
    while changed:
        changed = False
        for a in range(p):
            for b in sorted(adj[a]):
                if not loose(a, b):
                    continue
                one = any((c, a) in arrow and b not in adj[c] for c in range(p) if c != b)
                two = any((a, c) in arrow and (c, b) in arrow for c in range(p))
                mid = [c for c in sorted(adj[a]) if loose(a, c) and (c, b) in arrow]
                if one or two or any(d not in adj[c] for c, d in combinations(mid, 2)):
                    arrow.add((a, b))
                    changed = True
    return [(names[a], names[b], (a, b) in arrow) for a in range(p) for b in sorted(adj[a]) if (a, b) in arrow or loose(a, b)]


def _matrix(names: list[str], a: list[str], b: list[str], r: list[float]) -> np.ndarray:
    at = {m: k for k, m in enumerate(names)}
    corr = np.eye(len(names))
    for x, y, v in zip(a, b, r, strict=True):
        corr[at[x], at[y]] = corr[at[y], at[x]] = 1.0 if x == y else np.nan_to_num(v)
    return corr


def _wide_skeletons(packed: DataFrame, alpha: float) -> tuple[DataFrame, DataFrame]:
    """(edges ``incident_id, i, j``, separating sets ``incident_id, i, j, given``) of incidents ``packed(incident_id, names, a, b, r, n)``.

    At each level the pairs that are left are rows with their neighbours, ``PAIRS`` of them in a group with the incident's matrix, so that a wide incident spreads over tasks.
    """
    key = ["incident_id"]
    names = F.size("names")
    edges = packed.select(*key, F.explode(F.sequence(F.lit(0), names - 1)).alias("i"), "names").select(*key, "i", F.explode(F.filter(F.sequence(F.lit(0), names - 1), lambda x: x > F.col("i"))).alias("j"))
    edges, apart, size = settled(edges, "pairs"), None, 0

    def test(key_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            m = right.iloc[0]
            corr = _matrix(list(m["names"]), m["a"], m["b"], m["r"])
            for i, j, ni, nj, level in zip(left["i"], left["j"], left["ni"], left["nj"], left["size"], strict=True):
                for side in ([x for x in ni if x != j], [x for x in nj if x != i]):
                    hit = first_separating(corr, i, j, side, level, int(m["n"]), alpha)
                    if hit is not None:
                        rows.append((key_[0], i, j, [int(x) for x in hit]))
                        break
        return pd.DataFrame(rows, columns=["incident_id", "i", "j", "given"])

    while True:
        near = edges.select(*key, F.inline(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))).groupBy(*key, "i").agg(F.array_sort(F.collect_set("j")).alias("near"))
        near = settled(near, "neighbours")
        if near.where(F.size("near") > size).isEmpty():
            break
        blocks = edges.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / PAIRS).cast("int").alias("blocks"))
        rows = edges.join(blocks, key).withColumn("block", F.pmod(F.xxhash64("i", "j"), F.col("blocks")).cast("int")).drop("blocks")
        rows = rows.join(near.withColumnRenamed("near", "ni"), [*key, "i"]).join(near.select(*key, F.col("i").alias("j"), F.col("near").alias("nj")), [*key, "j"]).withColumn("size", F.lit(size))
        matrices = packed.join(blocks, key).select(*packed.columns, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        told = rows.groupBy(*key, "block").cogroup(matrices.groupBy(*key, "block")).applyInPandas(test, "incident_id string, i int, j int, given array<int>")
        told = settled(told, "apart")
        left = settled(edges.join(told, [*key, "i", "j"], "left_anti"), "pairs")
        dropped(edges)
        edges, apart, size = left, told if apart is None else apart.unionByName(told), size + 1
    return edges, apart


def pc_structure(series: DataFrame, alpha: float = 0.05, grouped: int = 32) -> DataFrame:
    """``incident_id, cause, effect, directed``; an undirected edge stands both ways. Fewer than two metrics or ten rows give none.

    Correlations come from one distributed pass. The search for an incident of at most ``grouped`` metrics works on its small matrix; the tests of wider ones, which grow with
    the power of a metric's neighbours, are dealt out pair by pair, level by level, with the same result.
    """
    rows = correlation_rows(series)
    packed = rows.groupBy("incident_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("a", "b"))))).alias("names"), F.collect_list(F.struct("a", "b", F.coalesce("r", F.lit(0.0)).alias("r"))).alias("x"), F.max("n").alias("n"))
    packed = packed.where((F.size("names") > 1) & (F.col("n") >= 10)).select("incident_id", "names", F.col("x.a").alias("a"), F.col("x.b").alias("b"), F.col("x.r").alias("r"), "n")
    packed = settled(packed, "correlations")
    schema = "incident_id string, cause string, effect string, directed boolean"

    def small(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for m in pdf.itertuples():
                names = list(m.names)
                found = skeleton(_matrix(names, m.a, m.b, m.r), int(m.n), alpha)
                out += [(m.incident_id, *r) for r in oriented(names, *found)]
            yield pd.DataFrame(out, columns=["incident_id", "cause", "effect", "directed"])

    got = packed.where(F.size("names") <= grouped).mapInPandas(small, schema)
    wide = packed.where(F.size("names") > grouped)
    if wide.isEmpty():
        return got
    edges, apart = _wide_skeletons(wide, alpha)
    sets = apart.groupBy("incident_id").agg(F.collect_list(F.struct("i", "j", "given")).alias("apart"))
    links = edges.groupBy("incident_id").agg(F.collect_list(F.struct("i", "j")).alias("links"))

    def turn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for m in pdf.itertuples():
                adj: dict[int, set[int]] = {k: set() for k in range(len(m.names))}
                for e in m.links:
                    adj[e["i"]].add(e["j"])
                    adj[e["j"]].add(e["i"])
                given = {k: tuple(x["given"]) for x in (m.apart if m.apart is not None else []) for k in ((x["i"], x["j"]), (x["j"], x["i"]))}
                out += [(m.incident_id, *r) for r in oriented(list(m.names), adj, given)]
            yield pd.DataFrame(out, columns=["incident_id", "cause", "effect", "directed"])

    joined = wide.select("incident_id", "names").join(links, "incident_id").join(sets, "incident_id", "left")
    return got.unionByName(joined.mapInPandas(turn, schema))


def partial_corr_test(series: DataFrame, x: str, y: str, given: list[str], alpha: float = 0.05) -> DataFrame:
    """``incident_id, r, p_value, independent`` (p > alpha): correlation of x and y without the linear effect of ``given``."""
    rows = correlation_rows(series.where(F.col("metric").isin(x, y, *given)))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names = [x, y, *given]
        at = {m: k for k, m in enumerate(names)}
        corr = np.eye(len(names))
        for a, b, r in zip(pdf["a"], pdf["b"], pdf["r"], strict=True):
            if a != b:
                corr[at[a], at[b]] = corr[at[b], at[a]] = np.nan_to_num(r)
        r, df = stats.partial_correlation(corr, 0, 1, tuple(range(2, len(names)))), int(pdf["n"].max()) - 2 - len(given)
        p = stats.t_two_sided(r * np.sqrt(df / max(1 - r * r, 1e-300)), df) if df > 0 else None
        return pd.DataFrame([(*key, r, p, None if p is None else bool(p > alpha))], columns=["incident_id", "r", "p_value", "independent"])

    return rows.groupBy("incident_id").applyInPandas(one, "incident_id string, r double, p_value double, independent boolean")


def lag_estimates(series: DataFrame, max_lag: int = 10, step_minutes: int = 5) -> DataFrame:
    """The lag at which the cause's past correlates most with the effect: ``incident_id, cause, effect, lag, r, minutes``."""
    w = Window.partitionBy("incident_id", "cause", "effect").orderBy("i")
    lags = F.array(*[F.struct(F.lit(k).alias("lag"), F.lag("x", k).over(w).alias("v")) for k in range(max_lag + 1)])
    rows = _pairs(series).select("incident_id", "cause", "effect", "y", lags.alias("l")).select("incident_id", "cause", "effect", "y", F.explode("l").alias("l"))
    r = rows.where("l.v is not null").groupBy("incident_id", "cause", "effect", "l.lag").agg(F.corr("l.v", "y").alias("r"))
    best = F.max_by(F.struct("lag", "r"), F.struct(F.round(F.abs("r"), 9), -F.col("lag")))
    return r.where("r is not null and not isnan(r)").groupBy("incident_id", "cause", "effect").agg(best.alias("x")).select("incident_id", "cause", "effect", "x.lag", "x.r", (F.col("x.lag") * step_minutes).alias("minutes"))
