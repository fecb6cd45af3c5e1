"""Sums of lagged products of series, and the regression tests that need nothing else (behind C1-C3, B19).

Series stay in Spark. What reaches Python is one row for each series or pair: sums for every lag and the first and last few values, whose
size depends on the number of lags alone. Cross products over a shorter sample follow from the sums by taking away the products at both ends.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causetrace.functions import stats
from causetrace.functions.shared import settled

SERIES = ("incident_id", "metric")
PAIR = ("incident_id", "a", "b")
#: Condition number, of cross products scaled to a unit diagonal, from which a regression counts as singular.
SINGULAR = 1e12


def known(series: DataFrame) -> DataFrame:
    """``incident_id, metric, ts, value`` where the value is a finite number; one value a time is expected."""
    value = F.col("value").cast("double")
    return series.select(*SERIES, "ts", value.alias("value")).where(F.abs("value") < float("inf"))


# ------------------------------------------------------------------------------------------------ pairs


def _sides(rows: DataFrame, lags: int) -> DataFrame:
    """Every value with its place from both ends of its series, less its series' mean, and the ``lags`` values before it."""
    own, order = Window.partitionBy(*SERIES), Window.partitionBy(*SERIES).orderBy("ts")
    v = rows.withColumn("value", F.col("value") - F.avg("value").over(own))
    j = F.row_number().over(order) - 1
    return v.select(*SERIES, "ts", j.alias("j"), (F.count(F.lit(1)).over(own) - 1 - j).alias("r"), *[F.lag("value", k).over(order).alias(f"v{k}") if k else F.col("value").alias("v0") for k in range(lags + 1)])


def _side(sides: DataFrame, name: str, lags: int) -> DataFrame:
    return sides.select("incident_id", "ts", F.col("metric").alias(name), F.col("j").alias(f"j{name}"), F.col("r").alias(f"r{name}"), *[F.col(f"v{k}").alias(f"{name}{k}") for k in range(lags + 1)])


def _sums(rows: DataFrame, lags: int, c: Column, r: Column) -> DataFrame:
    """One row a pair: sums of lagged products for each lag, sums, and the first and last ``lags`` values of both sides.

    ``c`` and ``r`` are a row's places from both ends of the pair's common rows, if the aggregate finds those without a gap (``whole``).
    """
    at = rows.withColumns({"c": c, "r": r})
    out = [F.count(F.lit(1)).alias("n"), F.sum("a0").alias("sa"), F.sum("b0").alias("sb")]
    out += [F.min("c").alias("c0"), F.min("r").alias("r0")] + [(F.max(x) - F.min(x) + 1).alias(f"span{x}") for x in ("ja", "jb")]
    for x, y in ("aa", "ab", "ba", "bb"):
        out += [F.sum(F.when(F.col("c") >= k, F.col(f"{x}0") * F.col(f"{y}{k}"))).alias(f"{x}{y}{k}") for k in range(lags + 1)]
    for x in "ab":
        out += [F.max(F.when(F.col(e) == k, F.col(f"{x}0"))).alias(f"{e}{x}{k}") for e in "cr" for k in range(lags)]
    got = at.groupBy(*PAIR).agg(*out)
    several = lambda p, n: F.array(*[F.col(f"{p}{k}") for k in range(n)]).alias(p)
    whole = (F.col("c0") == 0) & (F.col("r0") == 0) & (F.col("spanja") == F.col("n")) & (F.col("spanjb") == F.col("n"))
    return got.select(*PAIR, "n", "sa", "sb", whole.alias("whole"), *[several(p, lags + 1) for p in ("aa", "ab", "ba", "bb")], *[several(f"{e}{x}", lags) for e in "cr" for x in "ab"])


def pair_sums(series: DataFrame, lags: int, least: int = 0) -> DataFrame:
    """Lagged sums of every unordered pair of an incident's metrics over their common times, in which lags are counted (see ``_sums``); pairs of at least ``least`` common times.

    Values meet at their times, in as many tasks as there are times; partial sums leave them. For most pairs the common times are without a gap in both
    series, and a value's predecessors are its own series'. The aggregate itself finds the other pairs, and only those are numbered anew, pair by pair.
    """
    sides = settled(_sides(known(series), lags), "sides")
    joined = _side(sides, "a", lags).join(_side(sides, "b", lags), ["incident_id", "ts"]).where("a < b")
    first = settled(_sums(joined, lags, F.least("ja", "jb"), F.least("ra", "rb")).where(F.col("n") >= least), "sums")
    gaps = first.where("not whole").select(*PAIR)
    if gaps.isEmpty():
        return first
    rows = joined.join(gaps, list(PAIR), "left_semi")
    order, own = Window.partitionBy(*PAIR).orderBy("ts"), Window.partitionBy(*PAIR)
    j = F.row_number().over(order) - 1
    lagged = [F.lag(f"{x}0", k).over(order).alias(f"{x}{k}") if k else F.col(f"{x}0") for x in "ab" for k in range(lags + 1)]
    again = rows.select(*PAIR, j.alias("ja"), j.alias("jb"), (F.count(F.lit(1)).over(own) - 1 - j).alias("ra"), *lagged)
    return first.where("whole").unionByName(_sums(again, lags, F.col("ja"), F.col("ra")))


class _Products:
    """Cross products of lagged columns of many pairs, from their sums; index 0 is the pair."""

    def __init__(self, pdf: pd.DataFrame):
        stack = lambda c: np.array(pdf[c].to_list(), dtype=float)
        self.n = pdf["n"].to_numpy(dtype=float)
        self.c = {k: stack(k) for k in ("aa", "ab", "ba", "bb")}
        self.total = {x: pdf[f"s{x}"].to_numpy(dtype=float) for x in "ab"}
        self.head = {x: stack(f"c{x}") for x in "ab"}
        self.tail = {x: stack(f"r{x}") for x in "ab"}

    def product(self, u: str, i: int, v: str, j: int, start: int) -> np.ndarray:
        """Sum over t from ``start`` of u at t - i times v at t - j."""
        if i > j:
            return self.product(v, j, u, i, start)
        k = j - i
        out = self.c[u + v][:, k].copy()
        for s in range(k, start - i):
            out -= self.head[u][:, s] * self.head[v][:, s - k]
        for e in range(i):  # places from the end
            out -= self.tail[u][:, e] * self.tail[v][:, e + k]
        return out

    def sum(self, u: str, i: int, start: int) -> np.ndarray:
        return self.total[u] - self.head[u][:, : max(start - i, 0)].sum(axis=1) - self.tail[u][:, :i].sum(axis=1)

    def gram(self, effect: str, cause: str, lag: int) -> np.ndarray:
        """Cross products of effect, its lags, the cause's lags and 1, over all times that have ``lag`` predecessors."""
        columns = [(effect, i) for i in range(lag + 1)] + [(cause, i) for i in range(1, lag + 1)]
        m = len(columns) + 1
        g = np.empty((len(self.n), m, m))
        for p, (u, i) in enumerate(columns):
            g[:, p, -1] = g[:, -1, p] = self.sum(u, i, lag)
            for q in range(p, m - 1):
                g[:, p, q] = g[:, q, p] = self.product(u, i, *columns[q], lag)
        g[:, -1, -1] = self.n - lag
        return g


def left_over(gram: np.ndarray, on: list[int]) -> np.ndarray:
    """Sum of squares left of column 0 after regression on ``on``, for a stack of cross products; not a number where that is singular."""
    at = [0, *on]
    g = gram[:, at][:, :, at]
    scale = np.sqrt(np.maximum(np.einsum("bii->bi", g), 0))
    fine = (scale > 0).all(axis=1) & np.isfinite(g).all(axis=(1, 2))
    out = np.full(len(g), np.nan)
    g, scale = g[fine] / (scale[fine][:, :, None] * scale[fine][:, None, :]), scale[fine]
    if len(g):
        ok = np.linalg.cond(g[:, 1:, 1:]) <= SINGULAR
        told = np.full(len(g), np.nan)
        beta = np.linalg.solve(g[ok][:, 1:, 1:], g[ok][:, 1:, :1])[:, :, 0]
        told[ok] = (g[ok][:, 0, 0] - (g[ok][:, 0, 1:] * beta).sum(axis=1)) * scale[ok][:, 0] ** 2
        out[fine] = told
    return out


def _best_lags(p: _Products, effect: str, cause: str, lags: int) -> list[tuple[float, int] | None]:
    """For each pair (smallest p, its lag order) of the F-tests of the cause's lags; None where the algebra fails."""
    found: list[tuple[float, int] | None] = [(1.0, 0)] * len(p.n)
    for lag in range(1, lags + 1):
        g = p.gram(effect, cause, lag)
        own, joint = left_over(g, [*range(1, lag + 1), 2 * lag + 1]), left_over(g, [*range(1, 2 * lag + 2)])
        df = p.n - lag - (2 * lag + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            f = (own - joint) / joint / lag * df
        for at, (x, d) in enumerate(zip(f, df, strict=True)):
            if found[at] is None or not np.isfinite(x):
                found[at] = None
            elif (tail := stats.f_tail(x, lag, d)) < found[at][0]:
                found[at] = (tail, lag)
    return [x if x is None or x[1] else None for x in found]


def lag_tests(sums: DataFrame, lags: int, alpha: float) -> DataFrame:
    """``incident_id, cause, effect, p_value, optimal_lag`` of both directions of every pair whose smallest p is below ``alpha``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            p, rows = _Products(pdf), []
            for cause, effect in ("ab", "ba"):
                for i, x, y, best in zip(pdf["incident_id"], pdf[cause], pdf[effect], _best_lags(p, effect, cause, lags), strict=True):
                    if best is not None and best[0] < alpha:
                        rows.append((i, x, y, *best))
            yield pd.DataFrame(rows, columns=["incident_id", "cause", "effect", "p_value", "optimal_lag"])

    return sums.mapInPandas(run, "incident_id string, cause string, effect string, p_value double, optimal_lag int")


# ------------------------------------------------------------------------------------------------ unit roots


def most_lags(n: int) -> int:
    """Lag orders that the unit-root test of ``n`` values tries; negative if there are too few values."""
    return min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)


def change_sums(rows: DataFrame, keys: tuple[str, ...], most: int) -> DataFrame:
    """One row a series of ``rows(*keys, ts, value)``: its length, range, sums, sums of the products of changes and of levels with the changes up to ``most`` steps before, and the
    values at both ends. One shuffle; a series is read in order, and its sums are what is kept."""
    order, own = Window.partitionBy(*keys).orderBy("ts"), Window.partitionBy(*keys)
    y = F.col("value") - F.avg("value").over(own)
    placed = rows.select(*keys, "ts", "value", y.alias("y"), (F.lead("value").over(order) - F.col("value")).alias("d"), (F.row_number().over(order) - 1).alias("t"), F.count(F.lit(1)).over(own).alias("n"))
    at = placed.select("*", *[F.lag("d", k).over(order).alias(f"d{k}") for k in range(1, most + 1)]).withColumn("d0", F.col("d"))
    change = F.col("d").isNotNull()
    ends = F.when(change & ((F.col("t") < most) | (F.col("t") >= F.col("n") - 1 - most)), F.struct("t", "d", "y"))
    sums = [F.sum(F.when(change, F.col(x) * F.col(f"d{k}"))).alias(f"{x}{k}_") for x in ("d", "y") for k in range(most + 1)]
    got = at.groupBy(*keys).agg(
        F.max("n").alias("n"), (F.max("value") - F.min("value")).alias("range"), F.sum(F.when(change, F.col("y"))).alias("sy"), F.sum(F.when(change, F.col("y") * F.col("y"))).alias("yy"), F.sum("d").alias("sd"),
        F.sort_array(F.collect_list(ends)).alias("ends"), *sums,
    )
    several = [F.array(*[F.col(f"{x}{k}_") for k in range(most + 1)]).alias(name) for x, name in (("d", "dd"), ("y", "yd"))]
    return got.select(*keys, "n", "range", "sy", "yy", "sd", "ends", *several)


def _root_p(n: int, span: float, sy: float, yy: float, sd: float, ends: list, dd: list, yd: list) -> float | None:
    """p of the unit-root test with a constant from a row of ``change_sums``; None where the test isn't possible."""
    most = most_lags(n)
    if most < 0 or span == 0:
        return None
    m = n - 1  # changes
    t = {int(e["t"]): (float(e["d"]), float(e["y"])) for e in ends}

    def product(i: int, j: int, start: int) -> float:
        """Sum over t from ``start`` of change t - i times change t - j."""
        i, j = min(i, j), max(i, j)
        k = j - i
        return dd[k] - sum(t[s][0] * t[s - k][0] for s in range(k, start - i)) - sum(t[s][0] * t[s - k][0] for s in range(m - i, m))

    def gram(lag: int, start: int) -> np.ndarray:
        """Cross products of the change, the level before it, the ``lag`` changes before that, and 1."""
        g = np.empty((lag + 3, lag + 3))
        head = range(start)
        place = [0, *range(2, lag + 2)]
        for i in range(lag + 1):
            for j in range(i, lag + 1):
                g[place[i], place[j]] = g[place[j], place[i]] = product(i, j, start)
            g[1, place[i]] = g[place[i], 1] = yd[i] - sum(t[s][1] * t[s - i][0] for s in head if s >= i)
            g[-1, place[i]] = g[place[i], -1] = sd - sum(t[s][0] for s in range(start - i)) - sum(t[s][0] for s in range(m - i, m))
        g[1, 1] = yy - sum(t[s][1] ** 2 for s in head)
        g[1, -1] = g[-1, 1] = sy - sum(t[s][1] for s in head)
        g[-1, -1] = m - start
        return g

    full = gram(most, most)
    size = m - most
    best, lag = None, 0
    for k in range(most + 1):
        left = left_over(full[None], [*range(1, k + 2), most + 2])[0]
        if not left > 0:
            return None
        aic = size * (math.log(2 * math.pi * left / size) + 1) + 2 * (k + 2)
        if best is None or aic < best:
            best, lag = aic, k
    g = gram(lag, lag)
    scale = np.sqrt(np.diag(g))
    if (scale == 0).any() or m - lag <= lag + 2:
        return None
    g = g / np.outer(scale, scale)
    if np.linalg.cond(g[1:, 1:]) > SINGULAR:
        return None
    inverse = np.linalg.inv(g[1:, 1:])
    beta = inverse @ g[1:, 0]
    left = g[0, 0] - g[0, 1:] @ beta
    if left <= 0:
        return None
    # scales of the change and the level cancel in the ratio
    return stats.unit_root_p(beta[0] / math.sqrt(left / (m - lag - lag - 2) * inverse[0, 0]))


def unit_root_tests(series: DataFrame, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """``*keys, p_value`` of every series with a value; null where the test isn't possible (too short, constant, singular).

    The lag orders tried grow with the fourth root of the length, so the longest length is asked for first.
    """
    rows = series.select(*keys, "ts", F.col("value").cast("double").alias("value")).where(F.abs("value") < float("inf"))
    longest = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    sums = change_sums(rows, keys, max(most_lags(longest or 0), 0))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            columns = [pdf[c] for c in ("n", "range", "sy", "yy", "sd", "ends", "dd", "yd")]
            p = [_root_p(*x) for x in zip(*columns, strict=True)]
            yield pdf[list(keys)].assign(p_value=pd.Series(p, dtype="float64", index=pdf.index))

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return sums.mapInPandas(run, f"{kinds}, p_value double")
