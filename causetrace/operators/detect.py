"""Baselines, anomaly scores, flags and alert damping."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causetrace.functions.shared import settled
from causetrace.operators import chunks, moments
from causetrace.operators.prepare import KEYS, apply_minmax, fit_minmax, to_wide

#: Windows that one group scores.
SCORED = 4096


def _series():
    return Window.partitionBy(*KEYS)


def _ordered():
    return _series().orderBy("ts")

TINY = 1e-8


def _at_most_one(x: Column) -> Column:
    """``x``, 1 at most; null stays null, which ``least`` alone would turn into 1."""
    return F.when(x.isNotNull(), F.least(x, F.lit(1.0)))


@dataclass
class ReconstructionModel:
    """A linear autoencoder: the windows of an entity's metrics, projected to their main components and back."""

    metrics: list[str]
    window: int
    mean: list[float]
    components: list[list[float]]


def wide_windows(df: DataFrame, metrics: list[str], window: int, stride: int = 1) -> DataFrame:
    """``entity, ts, begin, k, x``: complete windows over the times that have all metrics, from ``begin`` to ``ts``, one flat array each (metric by metric)."""
    # side by side first: one row for each time, so that a value is shuffled once and windows are collected after that
    wide = to_wide(df.where(F.col("metric").isin(metrics)), metrics).dropna(subset=metrics)
    order = Window.partitionBy("entity").orderBy("ts")
    rows = F.collect_list(F.array(*[F.col(f"`{m}`") for m in metrics])).over(order.rowsBetween(-(window - 1), 0))
    place = F.row_number().over(order) - window
    got = wide.select("entity", "ts", F.lag("ts", window - 1).over(order).alias("begin"), place.alias("__p"), rows.alias("__x")).where((F.col("__p") >= 0) & (F.col("__p") % stride == 0))
    flat = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(len(metrics) - 1)), lambda m: F.transform("__x", lambda row: row[m])))
    return got.select("entity", "ts", "begin", (F.col("__p") / stride).cast("long").alias("k"), flat.alias("x"))


def training_windows(normal: DataFrame, metrics: list[str], window: int = 12, stride: int = 5, validation: float = 0.2) -> DataFrame:
    """Windows with ``train``: whether one is among the first 1 - ``validation`` of its entity's in time, at least the first. The others are held out for thresholds."""
    place, n = F.row_number().over(Window.partitionBy("entity").orderBy("ts")), F.count(F.lit(1)).over(Window.partitionBy("entity"))
    return wide_windows(normal, metrics, window, stride).withColumn("train", place <= F.greatest(F.floor(n * (1 - validation)), F.lit(1)))


def fit_reconstruction_model(normal: DataFrame, metrics: list[str], window: int = 12, stride: int = 5, latent: int = 32) -> ReconstructionModel:
    """Principal components of the training windows (the first 80 % in time) of all entities given, at most ``latent``; only their moments reach the driver.

    One pass; each task hands on one state.
    """
    rows = training_windows(normal, metrics, window, stride).where("train")
    total = moments.moment_states(rows).first()
    size = len(metrics) * window
    if total is None:
        return ReconstructionModel(metrics, window, [0.0] * size, [])
    mean = np.array(total["mean"])
    parts = moments.components(total["n"], mean, np.array(total["scatter"]).reshape(size, size), latent)
    return ReconstructionModel(metrics, window, mean.tolist(), parts.tolist())


def reconstruction_error(df: DataFrame, model: ReconstructionModel) -> DataFrame:
    """``entity, metric, ts, score``: mean squared error of each metric over each window, labelled with the window's end."""
    mean, metrics, window = np.array(model.mean), model.metrics, model.window
    parts = np.array(model.components).reshape(-1, len(mean))

    @F.pandas_udf("array<double>")
    def errors(x: pd.Series) -> pd.Series:
        m = np.vstack(x.to_list()) - mean
        e = ((m - m @ parts.T @ parts) ** 2).reshape(len(m), len(metrics), window).mean(axis=2)
        return pd.Series(list(e))

    names = F.array(*[F.lit(m) for m in metrics])
    scored = wide_windows(df, metrics, window).select("entity", "ts", F.explode(F.arrays_zip(names.alias("metric"), errors("x").alias("score"))).alias("z"))
    return scored.select("entity", F.col("z.metric").alias("metric"), "ts", F.col("z.score").alias("score"))


def fit_entity_models(normal: DataFrame, metrics: list[str], window: int = 12, stride: int = 5, latent: int = 32) -> DataFrame:
    """D1, a model for each entity: ``entity, mean, components`` of its own training windows, from their moments. An entity without a complete window has none; models stay distributed."""
    rows = training_windows(normal, metrics, window, stride).where("train")
    return moments.models(moments.moment_states(rows, "entity"), latent)


def window_errors(windows: DataFrame, models: DataFrame, metrics: list[str], window: int = 12) -> DataFrame:
    """``entity, metric, ts, score`` of ``windows(entity, ts, k, x)`` with the models of their entities, ``SCORED`` windows and one model at a time."""

    def one(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return left[["entity", "ts"]].iloc[:0].assign(metric="", score=0.0)
        mean = np.array(right["mean"].iloc[0])
        parts = np.array([list(p) for p in right["components"].iloc[0]]).reshape(-1, len(mean))
        m = np.vstack(left["x"].to_list()) - mean
        e = ((m - m @ parts.T @ parts) ** 2).reshape(len(m), len(metrics), window).mean(axis=2)
        return pd.DataFrame({"entity": key[0], "metric": np.tile(metrics, len(m)), "ts": np.repeat(left["ts"].to_numpy(), len(metrics)), "score": e.ravel()})

    kind = windows.schema["ts"].dataType.simpleString()
    left = windows.select("entity", F.floor(F.col("k") / SCORED).alias("chunk"), "ts", "x")
    # a model goes to each chunk of its entity's windows
    last = windows.groupBy("entity").agg(F.floor(F.max("k") / SCORED).alias("last"))
    right = models.join(last, "entity").select("entity", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("chunk"), "mean", "components")
    return left.groupBy("entity", "chunk").cogroup(right.groupBy("entity", "chunk")).applyInPandas(one, f"entity string, metric string, ts {kind}, score double")


def entity_reconstruction_error(df: DataFrame, models: DataFrame, metrics: list[str], window: int = 12) -> DataFrame:
    """D2 with the models of ``fit_entity_models``: ``entity, metric, ts, score``. Entities without a model have no rows."""
    return window_errors(wide_windows(df, metrics, window), models, metrics, window)


def held_out_errors(normal: DataFrame, models: DataFrame, metrics: list[str], window: int = 12, stride: int = 5) -> DataFrame:
    """D3's input: errors of the windows that ``fit_entity_models`` held out. An entity with a single window has none, so no threshold."""
    return window_errors(training_windows(normal, metrics, window, stride).where("not train"), models, metrics, window)


def calibrate_thresholds(scores: DataFrame, pct: float = 99.0) -> DataFrame:
    """D3: ``threshold`` of each metric: a percentile of its scores on validation data."""
    return scores.groupBy(*KEYS).agg(F.percentile("score", F.lit(pct / 100)).alias("threshold"))


def flag_scores(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``score`` over its threshold, ``is_anomaly`` where the raw score exceeds it. Metrics without a threshold have no rows."""
    joined = scores.join(thresholds, list(KEYS))
    return joined.select(*KEYS, "ts", (F.col("score") / (F.col("threshold") + TINY)).alias("score"), (F.col("score") > F.col("threshold")).alias("is_anomaly"))


def fit_baselines(normal: DataFrame) -> DataFrame:
    """Median, median absolute deviation, mean, standard deviation and quartiles of each metric's non-null values."""
    known = normal.where("value is not null")
    quart = F.percentile("value", F.array(F.lit(0.25), F.lit(0.75)))
    first = known.groupBy(*KEYS).agg(F.median("value").alias("median"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), quart.alias("q"))
    mad = known.join(first.select(*KEYS, "median"), list(KEYS)).groupBy(*KEYS).agg(F.median(F.abs(F.col("value") - F.col("median"))).alias("mad"))
    floor = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(TINY)).alias(c)
    return first.join(mad, list(KEYS)).select(*KEYS, "median", floor("mad"), "mean", floor("std"), F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))


def zscore_anomaly() -> Column:
    """D6; null if the value or its baseline is."""
    return _at_most_one(F.abs(F.col("value") - F.col("mean")) / F.col("std") / 3)


def mad_anomaly() -> Column:
    """D7; null if the value or its baseline is."""
    return _at_most_one(F.abs(F.col("value") - F.col("median")) / (1.4826 * F.col("mad")) / 3.5)


def iqr_anomaly() -> Column:
    """D8"""
    iqr = F.greatest(F.col("q3") - F.col("q1"), F.lit(TINY))
    low, high = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    out = F.when(F.col("value") < low, (low - F.col("value")) / iqr).when(F.col("value") > high, (F.col("value") - high) / iqr)
    return F.least(out.otherwise(0.0), F.lit(1.0))


def statistical_scores(df: DataFrame, baselines: DataFrame) -> DataFrame:
    """``zscore, mad_score, iqr_score, stat``; a metric without a baseline scores 0, and so does a null value."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    got = df.join(baselines, list(KEYS), "left")
    got = got.withColumns({"zscore": zero(zscore_anomaly()), "mad_score": zero(mad_anomaly()), "iqr_score": F.when(F.col("q1").isNull(), 0.0).otherwise(iqr_anomaly())})
    return got.withColumn("stat", F.greatest("zscore", "mad_score", "iqr_score")).drop("median", "mad", "mean", "std", "q1", "q3")


def _pieces(df: DataFrame, window: int, chunk: int | None):
    """(rows, ordered window): whole series, or chunks of at least ``chunk`` places with the ``window`` rows before each."""
    if not chunk:
        return df.withColumn("__halo", F.lit(False)), _ordered()
    size = max(chunk, window)
    return chunks.with_halo(chunks.by_place(df, size), size, window), chunks.within()


def spike_score(df: DataFrame, window: int = 12, chunk: int | None = None) -> DataFrame:
    """``spike``: the last change against three rolling standard deviations of changes (three at least), back-filled at the start; 0 where there is no change to judge.

    With ``chunk``, rows have ``pos``, and a series is scored in pieces of so many places: each reads the window before it, and the deviation that back-fills its end is carried in.
    """
    got, order = _pieces(df, window, chunk)
    frame = order.rowsBetween(-(window - 1), 0)
    got = got.withColumn("__r", F.col("value") - F.lag("value").over(order))
    got = got.withColumn("__s", F.when(F.count("__r").over(frame) >= 3, F.stddev_samp("__r").over(frame))).where("not __halo")
    got = chunks.carried(got, after={"__next": F.col("__s")}) if chunk else got.withColumn("__next", F.lit(None).cast("double"))
    got = got.withColumn("__s", F.coalesce(F.first("__s", True).over(order.rowsBetween(0, Window.unboundedFollowing)), F.col("__next")))
    scale = F.when(F.col("__s") == 0, TINY).otherwise(F.col("__s"))
    return got.withColumn("spike", F.coalesce(_at_most_one(F.abs("__r") / (3 * scale)), F.lit(0.0))).select(*df.columns, "spike")


def trend_r2(df: DataFrame, window: int = 12, chunk: int | None = None) -> DataFrame:
    """``trend``: R² of a line through exactly ``window`` values; constant or incomplete windows have 0. ``chunk`` as in ``spike_score``."""
    got, order = _pieces(df, window, chunk)
    frame = order.rowsBetween(-(window - 1), 0)
    got = got.withColumn("__p", F.row_number().over(order).cast("double"))
    r2 = F.regr_r2("value", "__p").over(frame)
    flat = F.max("value").over(frame) == F.min("value").over(frame)
    got = got.withColumn("trend", F.when((F.count("value").over(frame) < window) | flat, 0.0).otherwise(r2))
    return got.where("not __halo").select(*df.columns, "trend")


def temporal_scores(df: DataFrame, window: int = 12, chunk: int | None = None) -> DataFrame:
    """``spike, trend, temporal``."""
    return trend_r2(spike_score(df, window, chunk), window, chunk).withColumn("temporal", F.greatest("spike", "trend"))


def agreement_confidence() -> Column:
    """How many of the three detectors exceed 0.6."""
    n = sum(((F.col(c) > 0.6).cast("int") for c in ("l", "stat", "temporal")), F.lit(0))
    return F.when(n == 3, "High").when(n == 2, "Medium").otherwise("Low")


def ensemble_flag(rule: str = "reconstruction") -> Column:
    """The reconstruction detector alone decides, unless ``rule`` is ``weighted``."""
    return F.col("l") > 0.5 if rule == "reconstruction" else F.col("ensemble") > 0.5


def ensemble_scores(reconstruction: DataFrame, statistical: DataFrame, temporal: DataFrame, rule: str = "reconstruction") -> DataFrame:
    """D13 to D15 for the times that have a reconstruction score (already over its threshold), not null."""
    at = [*KEYS, "ts"]
    got = reconstruction.where("score is not null").select(*at, (F.greatest(F.least("score", F.lit(1.5)), F.lit(0.0)) / 1.5).alias("l"))
    got = got.join(statistical.select(*at, "stat"), at).join(temporal.select(*at, "temporal"), at)
    got = got.withColumn("ensemble", 0.40 * F.col("l") + 0.35 * F.col("stat") + 0.25 * F.col("temporal"))
    return got.withColumns({"confidence": agreement_confidence(), "is_anomaly": ensemble_flag(rule)})


def summarise_incident(scores: DataFrame, incident: Column | str = "entity") -> DataFrame:
    """``incident_id, metric, max_score, first_seen`` of the metrics with a flag; the score is over all rows."""
    of = F.col(incident) if isinstance(incident, str) else incident
    got = scores.groupBy(of.alias("incident_id"), "metric").agg(F.max("score").alias("max_score"), F.min(F.when(F.col("is_anomaly"), F.col("ts"))).alias("first_seen"))
    return got.where("first_seen is not null")


def dampen_alerts(flags: DataFrame, required: int = 3, cooldown: int = 6, chunk_seconds: int | None = None) -> DataFrame:
    """``hard_alert`` for each row of ``flags(entity, metric, ts, is_anomaly)``.

    During a cool-down rows are skipped; else flags in a row count up, and the ``required``-th raises an alert and starts
    the cool-down. Only runs of flags matter: the fold walks the runs of a series that are long enough, not its rows.
    With ``chunk_seconds``, rows are numbered and runs found in spans of that length, each by a task of its own.
    """
    if chunk_seconds:
        numbered, runs = chunks.runs(flags, chunk_seconds)
    else:
        numbered = flags.withColumn("__p", F.row_number().over(_ordered()))
        run = numbered.where("is_anomaly").withColumn("__g", F.col("__p") - F.row_number().over(_ordered()))
        runs = run.groupBy(*KEYS, "__g").agg(F.min("__p").alias("lo"), F.max("__p").alias("hi"))
    runs = runs.where(F.col("hi") - F.col("lo") + 1 >= required)
    folded = runs.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct(F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi")))).alias("runs"))
    # within a run that begins at lo with rows up to `free` skipped, alerts fall every required + cooldown rows
    period = required + cooldown

    def step(acc, r):
        begin = F.greatest(r["lo"], acc["free"])
        first = begin + required - 1
        n = F.when(first <= r["hi"], F.floor((r["hi"] - first) / period) + 1).otherwise(0).cast("long")
        new = F.when(n > 0, F.sequence(first, first + (n - 1) * period, F.lit(period).cast("long"))).otherwise(F.array().cast("array<bigint>"))
        free = F.when(n > 0, first + (n - 1) * period + cooldown + 1).otherwise(acc["free"])
        return F.struct(free.cast("long").alias("free"), F.concat(acc["at"], new).alias("at"))

    start = F.struct(F.lit(1).cast("long").alias("free"), F.array().cast("array<bigint>").alias("at"))
    alerts = folded.select(*KEYS, F.explode(F.aggregate("runs", start, step)["at"]).alias("__p"), F.lit(True).alias("hard_alert"))
    return numbered.join(alerts, [*KEYS, "__p"], "left").select(*flags.columns, F.coalesce("hard_alert", F.lit(False)).alias("hard_alert"))


def dampening_stats(dampened: DataFrame) -> DataFrame:
    """Raw flags and hard alerts of each metric."""
    n = lambda c: F.sum(F.col(c).cast("long"))
    return dampened.groupBy(*KEYS).agg(n("is_anomaly").alias("raw_flags"), n("hard_alert").alias("hard_alerts"))


def rebaseline_due(events: DataFrame, as_of: Column, soak_hours: int = 2) -> DataFrame:
    """Each entity's latest event within the day before ``as_of``; ``due`` once it is ``soak_hours`` old."""
    recent = events.where((F.col("ts") <= as_of) & (F.col("ts") >= as_of - F.expr("interval 1 day")))
    last = recent.groupBy("entity").agg(F.max("ts").alias("deployed"))
    return last.withColumn("due", as_of - F.expr(f"interval {soak_hours} hours") >= F.col("deployed"))


def rebaseline(metrics: DataFrame, due: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Baselines and ranges of the entities that are due, from their data since the deployment."""
    since = since_deployment(metrics, due)
    return fit_baselines(since), fit_minmax(since)


def since_deployment(metrics: DataFrame, due: DataFrame) -> DataFrame:
    return metrics.join(due.where("due").select("entity", "deployed"), "entity").where("ts >= deployed").drop("deployed")


def daily_states(metrics: DataFrame, names: list[str], window: int = 12, stride: int = 5, bucket: str = "day") -> DataFrame:
    """Moments of each entity's windows by the ``bucket`` (a unit of ``date_trunc``) in which they begin. Kept and appended to, they are all that a refit reads."""
    rows = wide_windows(metrics, names, window, stride)
    return moments.moment_states(rows, "entity", bucket=F.date_trunc(bucket, "begin").cast("timestamp_ntz"))


def rebaseline_model(metrics: DataFrame, due: DataFrame, states: DataFrame, names: list[str], window: int = 12, stride: int = 5, latent: int = 32, bucket: str = "day") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(models, thresholds, ranges) of each entity that is due, on its scaled data since the deployment.

    A model is a sum of the ``states`` (see ``daily_states``) of the buckets that begin after the deployment, but for the last fifth of them, one at least; the windows of
    those, read and scored, give the thresholds. Scaling moves the moments, so that states of raw values serve every range. Entities with a single bucket have no model yet.
    """
    since = since_deployment(metrics, due)
    bounds = fit_minmax(since)
    fresh = states.join(due.where("due").select("entity", "deployed"), "entity").where("bucket >= deployed")
    order, n = F.row_number().over(Window.partitionBy("entity").orderBy("bucket")), F.count(F.lit(1)).over(Window.partitionBy("entity"))
    placed = fresh.withColumn("train", order <= n - F.greatest(F.floor(n * 0.2), F.lit(1)))
    cut = placed.where("not train").groupBy("entity").agg(F.min("bucket").alias("cut"))
    at = F.sequence(F.lit(0), F.lit(len(names) * window - 1))
    width = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(F.col("hi") - F.col("lo"))
    told = bounds.where(F.col("metric").isin(names)).groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("metric", F.struct("lo", width.alias("width"))))).alias("b"))
    each = lambda field: F.transform(at, lambda i: F.element_at("b", F.array(*[F.lit(m) for m in names])[F.floor(i / window).cast("int")])[field])
    models = moments.models(placed.where("train"), latent, told.select("entity", each("lo").alias("lo"), each("width").alias("width")))
    models = settled(models, "models")
    scaled = apply_minmax(since, bounds)
    held = wide_windows(scaled, names, window, stride).join(cut, "entity").where(F.date_trunc(bucket, "begin") >= F.col("cut"))
    return models, calibrate_thresholds(window_errors(held, models, names, window)), bounds
