"""Cleaning and shaping of metric series (P1-P17). Tables are ``entity, metric, ts, value``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causetrace.operators import chunks

KEYS = ("entity", "metric")


def _series():
    return Window.partitionBy(*KEYS)


def _ordered():
    return _series().orderBy("ts")


def dedupe_keep_last(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Of samples with equal time the one with the largest ``seq``."""
    last = F.row_number().over(Window.partitionBy(*KEYS, "ts").orderBy(F.desc(seq)))
    return df.withColumn("__k", last).where("__k = 1").drop("__k")


#: Places that the grid of one entity may have: 19 years of 5 minutes.
LONGEST = 2_000_000


def times(lo: Column, hi: Column, step: str, longest: int = LONGEST) -> Column:
    """The times from ``lo`` to ``hi``. More than ``longest`` are an error, not a table: one wrong timestamp would make them."""
    count, unit = step.split()
    last = lo + F.expr(f"interval {int(count) * longest} {unit}")
    return F.when(hi <= last, F.sequence(lo, hi, F.expr(f"interval {step}"))).otherwise(F.raise_error(F.concat(F.lit(f"more than {longest} places from "), lo.cast("string"), F.lit(" to "), hi.cast("string"))))


def reindex_grid(df: DataFrame, step: str) -> DataFrame:
    """Every metric of an entity on the grid from the entity's first to its last time, with its place ``pos``; other times vanish. A grid of more than ``LONGEST`` places is an error."""
    span = df.groupBy("entity").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    grid = df.select(*KEYS).distinct().join(span, "entity")
    spine = grid.select(*KEYS, F.posexplode(times(F.col("lo"), F.col("hi"), step)).alias("pos", "ts"))
    return spine.join(df.select(*KEYS, "ts", "value"), [*KEYS, "ts"], "left").select(*KEYS, "ts", F.col("pos").cast("long").alias("pos"), "value")


def missing_share(grid: DataFrame) -> DataFrame:
    return grid.groupBy(*KEYS).agg(F.avg(F.col("value").isNull().cast("double")).alias("missing"))


def drop_sparse_metrics(grid: DataFrame, share: float = 0.5) -> DataFrame:
    """Without metrics of which more than ``share`` of the grid is missing."""
    return grid.join(missing_share(grid).where(F.col("missing") <= share), list(KEYS), "left_semi")


def fill_gaps(grid: DataFrame, limit: int | None = 6, chunk: int | None = None) -> DataFrame:
    """Linear interpolation for at most ``limit`` places of a gap, then the value reached; edges take the nearest value, an empty series 0.

    With ``chunk``, a series is filled in pieces of so many places, each by a task of its own, with the known values next to the piece carried in.
    """
    known = F.when(F.col("value").isNotNull(), F.struct("value", "pos"))
    if chunk:
        rows, order = chunks.carried(chunks.by_place(grid, chunk), {"__b": known}, {"__a": known}), chunks.within("ts")
    else:
        nothing = F.lit(None).cast("struct<value:double,pos:bigint>")
        rows, order = grid.withColumns({"__b": nothing, "__a": nothing}), _ordered()
    before, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("value").isNotNull(), F.col("pos"))
    or_carried = lambda c, side, name: F.coalesce(c, F.col(f"{side}.{name}"))
    marks = rows.withColumns(
        {
            "vp": or_carried(F.last("value", True).over(before), "__b", "value"), "pp": or_carried(F.last(at, True).over(before), "__b", "pos"),
            "vq": or_carried(F.first("value", True).over(after), "__a", "value"), "pq": or_carried(F.first(at, True).over(after), "__a", "pos"),
        }
    )
    steps = F.col("pos") - F.col("pp")
    between = F.col("vp") + (F.col("vq") - F.col("vp")) * (F.least(steps, F.lit(limit)) if limit else steps) / (F.col("pq") - F.col("pp"))
    return marks.withColumn("value", F.coalesce("value", between, "vp", "vq", F.lit(0.0))).select(*grid.columns)


def fill_edges(df: DataFrame, step: str) -> DataFrame:
    """Series aligned on the entity's grid; forward, then backward fill, then 0."""
    grid = reindex_grid(df, step)
    ahead = F.last("value", True).over(_ordered().rowsBetween(Window.unboundedPreceding, 0))
    back = F.first("value", True).over(_ordered().rowsBetween(0, Window.unboundedFollowing))
    return grid.select(*KEYS, "ts", F.coalesce(ahead, back, F.lit(0.0)).alias("value"))


def cap_outliers(df: DataFrame, z: float = 5.0) -> DataFrame:
    """P5: values clipped to mean ± ``z`` standard deviations of their metric; null stays null."""
    stats = df.groupBy(*KEYS).agg(F.avg("value").alias("__m"), F.stddev_samp("value").alias("__s"))
    lo, hi = F.col("__m") - z * F.col("__s"), F.col("__m") + z * F.col("__s")
    capped = F.when((F.col("__s") > 0) & F.col("value").isNotNull(), F.greatest(F.least("value", hi), lo)).otherwise(F.col("value"))
    return df.join(stats, list(KEYS)).withColumn("value", capped).drop("__m", "__s")


def clean_and_impute(df: DataFrame, step: str, share: float = 0.5, limit: int = 6, z: float = 5.0, chunk: int | None = None) -> DataFrame:
    """P1 to P5 in order; ``chunk`` as in ``fill_gaps``."""
    return dedupe_keep_last(df).transform(reindex_grid, step).transform(drop_sparse_metrics, share).transform(fill_gaps, limit, chunk).transform(cap_outliers, z)


def bin_mean(df: DataFrame, step: str) -> DataFrame:
    """Means of the bins that have samples, left-labelled."""
    return df.groupBy(*KEYS, F.window("ts", step)["start"].alias("ts")).agg(F.avg("value").alias("value"))


def resample_mean(df: DataFrame, step: str, interpolate: bool = False) -> DataFrame:
    """Means on a continuous grid of each series; with ``interpolate``, inner gaps are filled linearly."""
    means = bin_mean(df, step)
    span = means.groupBy(*KEYS).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    spine = span.select(*KEYS, F.posexplode(times(F.col("lo"), F.col("hi"), step)).alias("pos", "ts"))
    grid = spine.join(means, [*KEYS, "ts"], "left")
    return (fill_gaps(grid, None) if interpolate else grid).select(*KEYS, "ts", "value")


def to_wide(df: DataFrame, metrics: list[str]) -> DataFrame:
    """One column for each of ``metrics``."""
    return df.groupBy("entity", "ts").pivot("metric", metrics).agg(F.first("value", True))


def to_long(df: DataFrame, metrics: list[str]) -> DataFrame:
    """P8, back: one row for each non-null value."""
    return df.unpivot(["entity", "ts"], metrics, "metric", "value").where("value is not null")


def fit_minmax(normal: DataFrame) -> DataFrame:
    """``lo, hi`` of each metric on normal data."""
    return normal.groupBy(*KEYS).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))


def fill_incident(df: DataFrame) -> DataFrame:
    """Gaps of an incident take the last value before them, at the start the first one after; an empty series stays null."""
    ahead = F.last("value", True).over(_ordered().rowsBetween(Window.unboundedPreceding, 0))
    back = F.first("value", True).over(_ordered().rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn("value", F.coalesce(ahead, back))


def apply_minmax(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """Values scaled to the fitted range and clipped to [0, 1]; a constant metric has scale 1. Null stays null (see ``fill_incident``)."""
    scaled = (F.col("value") - F.col("lo")) / F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(F.col("hi") - F.col("lo"))
    clipped = F.when(scaled.isNotNull(), F.greatest(F.least(scaled, F.lit(1.0)), F.lit(0.0)))
    return df.join(bounds, list(KEYS)).withColumn("value", clipped).drop("lo", "hi")


def sliding_windows(df: DataFrame, size: int = 12, stride: int = 1) -> DataFrame:
    """P10: complete windows of ``size`` values every ``stride`` places, labelled with their last time: ``entity, metric, ts, k, values``."""
    frame = _ordered().rowsBetween(-(size - 1), 0)
    got = df.withColumns({"__p": F.row_number().over(_ordered()) - 1, "values": F.collect_list("value").over(frame)})
    full = got.where((F.size("values") == size) & ((F.col("__p") - size + 1) % stride == 0))
    return full.select(*KEYS, "ts", ((F.col("__p") - size + 1) / stride).cast("long").alias("k"), "values")


def time_split(windows: DataFrame, validation: float = 0.2) -> DataFrame:
    """``part``: train for the first int(n·(1 − validation)) windows in time order, else validation."""
    k, n = F.row_number().over(_ordered()), F.count(F.lit(1)).over(_series())
    return windows.withColumn("part", F.when(k <= F.floor(n * (1 - validation)), "train").otherwise("validation"))


def drop_low_variance(df: DataFrame, least: float = 1e-5) -> DataFrame:
    """Without metrics whose variance is below ``least``."""
    keep = df.groupBy(*KEYS).agg(F.var_samp("value").alias("v")).where(F.col("v") >= least)
    return df.join(keep, list(KEYS), "left_semi")


def average_rank(df: DataFrame) -> DataFrame:
    """Rank of each value in its series, ties averaged, as ``value``."""
    by_value = _series().orderBy("value")
    ties = F.count(F.lit(1)).over(Window.partitionBy(*KEYS, "value"))
    return df.select(*KEYS, "ts", (F.rank().over(by_value) + (ties - 1) / 2).alias("value"))


def pair_correlation(df: DataFrame) -> DataFrame:
    """Pearson correlation of every unordered pair of an entity's metrics over their common times: ``entity, a, b, r``."""
    x = df.select("entity", "ts", F.col("metric").alias("a"), F.col("value").alias("x"))
    y = df.select("entity", "ts", F.col("metric").alias("b"), F.col("value").alias("y"))
    return x.join(y, ["entity", "ts"]).where("a < b").groupBy("entity", "a", "b").agg(F.corr("x", "y").alias("r"))


def spearman_matrix(df: DataFrame) -> DataFrame:
    """Absolute rank correlation of every pair, undefined ones 0."""
    pairs = pair_correlation(average_rank(df))
    return pairs.withColumn("r", F.coalesce(F.abs(F.nanvl("r", F.lit(0.0))), F.lit(0.0)))


def _upgma(names: list[str], similar: dict[tuple[str, str], float], threshold: float) -> list[list[str]]:
    """Average linkage on distances 1 − similarity, cut at 1 − threshold; smallest names merge first on ties."""
    groups = [[n] for n in names]
    far = lambda a, b: sum(1 - min(max(similar.get((min(x, y), max(x, y)), 0.0), 0.0), 1.0) for x in a for y in b) / (len(a) * len(b))
    while len(groups) > 1:
        d, i, j = min((far(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        if d > 1 - threshold + 1e-12:
            break
        groups[i] = sorted(groups[i] + groups.pop(j))
    return groups


def group_correlated(df: DataFrame, threshold: float = 0.95) -> DataFrame:
    """``entity, metric, group`` (smallest member's name). The matrix is distributed; an entity's metrics are grouped in one task."""
    import pandas as pd

    matrix = spearman_matrix(df)
    names = df.select("entity", "metric").distinct()
    rows = names.select("entity", F.col("metric").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("double").alias("r")).unionByName(matrix)

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        members = sorted(pdf[pdf.b.isna()].a)
        pairs = pdf[pdf.b.notna()]
        out = _upgma(members, {(a, b): r for a, b, r in zip(pairs.a, pairs.b, pairs.r, strict=True)}, threshold)
        return pd.DataFrame([(pdf.entity.iloc[0], m, g[0]) for g in out for m in g], columns=["entity", "metric", "group"])

    return rows.groupBy("entity").applyInPandas(group, "entity string, metric string, group string")


def pick_representative(df: DataFrame, groups: DataFrame) -> DataFrame:
    """Of each group the member of highest variance (first name on ties) and all members: ``entity, representative, members``."""
    spread = df.groupBy(*KEYS).agg(F.var_samp("value").alias("v")).join(groups, list(KEYS))
    best = F.min(F.struct(-F.coalesce("v", F.lit(0.0)), "metric"))
    return spread.groupBy("entity", "group").agg(best["metric"].alias("representative"), F.array_sort(F.collect_list("metric")).alias("members")).drop("group")


def reduce_dimensions(df: DataFrame, least: float = 1e-5, threshold: float = 0.95) -> DataFrame:
    """P12 to P15: the metrics to keep and what each stands for."""
    kept = drop_low_variance(df, least)
    return pick_representative(kept, group_correlated(kept, threshold))


def missingness_stats(grid: DataFrame) -> DataFrame:
    """Missing percentage of each metric and of its entity."""
    each = missing_share(grid)
    return each.select(*KEYS, (F.col("missing") * 100).alias("missing_pct"), (F.avg("missing").over(Window.partitionBy("entity")) * 100).alias("mean_missing_pct"))


def split_normal(df: DataFrame, share: float = 0.7) -> Column:
    """Whether a row of a grid (with ``pos``) lies in the first ``share`` of its series."""
    return F.col("pos") < share * F.count(F.lit(1)).over(_series())
