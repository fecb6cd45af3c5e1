"""Data-quality checks, drift, evaluation and the remaining rules of the design."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causetrace.functions.shared import settled
from causetrace.operators.graph import incident_closure
from causetrace.operators.prepare import KEYS, pair_correlation
from causetrace.operators.rank import confidence_label


def _series():
    return Window.partitionBy(*KEYS)


def _ordered():
    return _series().orderBy("ts")


def fill_by_gap_size(grid: DataFrame) -> DataFrame:
    """B1: gaps of one place are interpolated, up to 12 filled forward, up to 288 interpolated; longer ones stay null and are flagged ``long_gap``."""
    before, after = _ordered().rowsBetween(Window.unboundedPreceding, 0), _ordered().rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("value").isNotNull(), F.col("pos"))
    m = grid.withColumns({"vp": F.last("value", True).over(before), "pp": F.last(at, True).over(before), "vq": F.first("value", True).over(after), "pq": F.first(at, True).over(after)})
    last = F.max("pos").over(_series())
    size = F.when(F.col("value").isNull(), F.coalesce("pq", last + 1) - F.coalesce("pp", F.lit(-1)) - 1).otherwise(0)
    line = F.col("vp") + (F.col("vq") - F.col("vp")) * (F.col("pos") - F.col("pp")) / (F.col("pq") - F.col("pp"))
    linear = F.coalesce(line, F.col("vp"))
    m = m.withColumn("gap", size)
    new = F.when(F.col("gap") == 0, F.col("value")).when(F.col("gap") == 1, linear).when(F.col("gap") <= 12, F.col("vp")).when(F.col("gap") <= 288, linear)
    return m.select(*KEYS, "ts", "pos", new.alias("value"), "gap", (F.col("gap") > 288).alias("long_gap"))


def select_by_variance(df: DataFrame, n: int = 20) -> DataFrame:
    """B2: the ``n`` metrics of highest variance of each entity."""
    v = df.groupBy(*KEYS).agg(F.var_samp("value").alias("variance"))
    return v.withColumn("place", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc_nulls_last("variance"), "metric"))).where(F.col("place") <= n)


def select_by_correlation(df: DataFrame, threshold: float = 0.95) -> DataFrame:
    """B2: metrics without an earlier one (by name) that correlates with them beyond ``threshold``."""
    dropped = pair_correlation(df).where(F.abs("r") > threshold).select("entity", F.col("b").alias("metric"))
    return df.select(*KEYS).distinct().join(dropped, list(KEYS), "left_anti")


def gaussian_drift(df: DataFrame, recent: int = 100, threshold: float = 0.5) -> DataFrame:
    """Divergence of the last ``recent`` values from the history before them; ``drift`` beyond ``threshold``."""
    back = F.row_number().over(_series().orderBy(F.desc("ts")))
    got = df.where("value is not null").withColumn("new", back <= recent)
    part = lambda f, new: f(F.when(F.col("new") == new, F.col("value")))
    s = got.groupBy(*KEYS).agg(part(F.avg, False).alias("mh"), part(F.stddev_pop, False).alias("sh"), part(F.avg, True).alias("mr"), part(F.stddev_pop, True).alias("sr"))
    kl = 0.5 * (F.ln(F.col("sr") / F.col("sh")) + (F.col("sh") ** 2 + (F.col("mh") - F.col("mr")) ** 2) / (2 * F.col("sr") ** 2) - 0.5)
    s = s.where("sh > 0 and sr > 0").withColumn("divergence", kl)
    return s.select(*KEYS, "divergence", (F.col("divergence") > threshold).alias("drift"))


def evaluate_rankings(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """``top1, top3, mrr`` over incidents; a root cause that isn't ranked has the rank after the last."""
    n = ranked.groupBy("incident_id").agg(F.count(F.lit(1)).alias("n"))
    hit = ranked.select("incident_id", F.col("metric").alias("root_cause"), "rank")
    got = truth.select("incident_id", "root_cause").join(hit, ["incident_id", "root_cause"], "left").join(n, "incident_id", "left")
    got = got.withColumn("rank", F.coalesce("rank", F.coalesce("n", F.lit(0)) + 1))
    share = lambda k: F.avg((F.col("rank") <= k).cast("double"))
    return got.agg(share(1).alias("top1"), share(3).alias("top3"), F.avg(1 / F.col("rank")).alias("mrr"))


def closure_scorer(nodes: DataFrame, edges: DataFrame, first_seen: DataFrame, step_seconds: int = 300, least: float = 0.5) -> DataFrame:
    """Nodes of severity ``least`` or more, scored by descendants, ancestors, how early they appear, and severity."""
    key = ["incident_id", "metric"]
    paths = incident_closure(edges).where("src <> dst")
    n = lambda c, name: paths.groupBy("incident_id", F.col(c).alias("metric")).agg(F.count(F.lit(1)).alias(name))
    w = Window.partitionBy("incident_id")
    got = nodes.withColumn("size", F.count(F.lit(1)).over(w)).join(first_seen.select(*key, "first_seen"), key, "left")
    late = F.timestamp_diff("SECOND", F.min("first_seen").over(w), F.col("first_seen")) / step_seconds
    got = got.withColumn("early", F.coalesce(F.greatest(1 - late / 1000, F.lit(0.0)), F.lit(0.0)))
    got = got.join(n("src", "below"), key, "left").join(n("dst", "above"), key, "left").fillna(0, ["below", "above"]).where(F.col("anomaly_score") >= least)
    score = 0.4 * F.col("below") / F.col("size") + 0.2 * (1 - F.col("above") / F.col("size")) + 0.3 * F.col("early") + 0.1 * F.col("anomaly_score")
    return got.select(*key, score.alias("score"))


def paths_to_leaves(edges: DataFrame) -> DataFrame:
    """Every simple path from a node to a node without successors, joined by arrows; paths grow by an edge each round until none does."""
    e = edges.select("incident_id", F.col("cause").alias("a"), F.col("effect").alias("b")).distinct()
    inner = e.select("incident_id", F.col("a").alias("node")).distinct()
    now, out = e.select("incident_id", F.col("a").alias("root"), F.col("b").alias("node"), F.array("a", "b").alias("path")), None
    while out is None or not now.isEmpty():
        ended = now.join(inner, ["incident_id", "node"], "left_anti").select("incident_id", "root", F.array_join("path", " → ").alias("path"))
        out = ended if out is None else out.unionByName(ended)
        step = now.alias("p").join(e.alias("e"), (F.col("p.incident_id") == F.col("e.incident_id")) & (F.col("p.node") == F.col("e.a")) & ~F.array_contains("p.path", F.col("e.b")))
        now = settled(step.select("p.incident_id", "p.root", F.col("e.b").alias("node"), F.array_append("p.path", F.col("e.b")).alias("path")))
    return out


def edge_weight_log_p() -> Column:
    """B7"""
    return -F.log10(F.col("p_value") + 1e-10)


def symptom_times(edges: DataFrame, roots: DataFrame, step_seconds: int = 300) -> DataFrame:
    """When each metric below a root (``incident_id, root, started``) should show: its start plus the least sum of lags along a path.

    An incident's graph is small and is walked whole in one group, however far its metrics lie from the root.
    """

    def one(key: tuple, links: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        after: dict[str, list] = {}
        for a, b, lag in zip(links["cause"], links["effect"], links["lag"], strict=True):
            after.setdefault(a, []).append((b, int(lag)))
        rows = []
        for root in sorted(set(starts["root"])):
            least, heap = {}, [(lag, b) for b, lag in after.get(root, ())]
            heapq.heapify(heap)
            while heap:
                total, at = heapq.heappop(heap)
                if at != root and at not in least:
                    least[at] = total
                    for b, lag in after.get(at, ()):
                        heapq.heappush(heap, (total + lag, b))
            rows += [(*key, root, m, t) for m, t in least.items()]
        return pd.DataFrame(rows, columns=["incident_id", "root", "metric", "lag"])

    links = edges.select("incident_id", "cause", "effect", F.col("lag").cast("long").alias("lag")).groupBy("incident_id")
    reach = links.cogroup(roots.select("incident_id", "root").groupBy("incident_id")).applyInPandas(one, "incident_id string, root string, metric string, lag long")
    got = reach.join(roots, ["incident_id", "root"])
    return got.select("incident_id", "root", "metric", "lag", F.timestamp_add("SECOND", F.col("lag") * step_seconds, F.col("started")).alias("expected"))


def frozen_metrics(df: DataFrame, tail: int = 12) -> DataFrame:
    """``frozen``: at most one distinct value in the last ``tail`` rows."""
    back = F.row_number().over(_series().orderBy(F.desc("ts")))
    return df.withColumn("__b", back).where(F.col("__b") <= tail).groupBy(*KEYS).agg((F.countDistinct("value") <= 1).alias("frozen"))


def discontinuities(df: DataFrame, tail: int = 12, factor: float = 5.0, more_than: int = 3) -> DataFrame:
    """``jumps`` among the last ``tail`` changes that exceed ``factor`` mean changes; ``discontinuous`` if over ``more_than``."""
    d = df.withColumn("d", F.abs(F.col("value") - F.lag("value").over(_ordered()))).withColumn("__b", F.row_number().over(_series().orderBy(F.desc("ts"))))
    d = d.withColumn("mean", F.avg("d").over(_series())).where(F.col("__b") <= tail)
    got = d.groupBy(*KEYS).agg(F.coalesce(F.sum((F.col("d") > factor * F.col("mean")).cast("long")), F.lit(0)).alias("jumps"))
    return got.withColumn("discontinuous", F.col("jumps") > more_than)


def out_of_range(df: DataFrame, low: float = -10.0, high: float = 110.0) -> DataFrame:
    """Percentages and rates with a value outside the range."""
    named = df.where(F.col("metric").endswith("_percent") | F.col("metric").endswith("_rate"))
    return named.groupBy(*KEYS).agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where((F.col("lo") < low) | (F.col("hi") > high))


def collection_gap(grid: DataFrame, tail: int = 12) -> DataFrame:
    """Metrics whose last ``tail`` rows are all null though earlier ones aren't."""
    got = grid.groupBy(*KEYS).agg(F.max("pos").alias("end"), F.max(F.when(F.col("value").isNotNull(), F.col("pos"))).alias("seen"))
    return got.select(*KEYS, (F.col("end") - F.col("seen")).alias("silent"), (F.coalesce(F.col("end") - F.col("seen") >= tail, F.lit(False))).alias("gap"))


def validate_ranges(df: DataFrame, rules: DataFrame) -> DataFrame:
    """For each rule (``metric, least, most``) whether the metric is present and within its bounds."""
    got = df.groupBy("metric").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    r = rules.join(got, "metric", "left")
    inside = lambda c, ok: F.coalesce(ok, F.lit(False)).alias(c)
    return r.select("metric", F.col("lo").isNotNull().alias("present"), inside("min_ok", F.col("lo") >= F.col("least")), inside("max_ok", F.col("hi") <= F.col("most")))


def hidden_confounders(df: DataFrame, edges: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Strongly correlated pairs (``df`` by entity = incident) without an edge either way."""
    joined = edges.select(F.col("incident_id").alias("entity"), F.least("cause", "effect").alias("a"), F.greatest("cause", "effect").alias("b"))
    return pair_correlation(df).where(F.abs("r") > threshold).join(joined, ["entity", "a", "b"], "left_anti")


def explanation_gap(nodes: DataFrame, edges: DataFrame, ranked: DataFrame) -> DataFrame:
    """How many anomalies the top cause doesn't reach."""
    top = ranked.where("rank = 1").select("incident_id", F.col("metric").alias("src"))
    reach = incident_closure(edges).join(top, ["incident_id", "src"], "left_semi").select("incident_id", F.col("dst").alias("metric"))
    reach = reach.union(top.select("incident_id", F.col("src").alias("metric"))).distinct().withColumn("told", F.lit(True))
    got = nodes.join(reach, ["incident_id", "metric"], "left")
    return got.groupBy("incident_id").agg(F.count(F.lit(1)).alias("anomalies"), F.sum(F.col("told").isNull().cast("long")).alias("unexplained"))


def sustained_threshold(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Stretches in which a metric breaks its rule (``metric, op, threshold, minutes``) for at least that long.

    Consecutive rows count; a stretch lasts from its first to its last row.
    """
    got = df.join(rules, "metric")
    broken = F.when(F.col("op") == ">", F.col("value") > F.col("threshold")).otherwise(F.col("value") < F.col("threshold"))
    w = Window.partitionBy(*KEYS, "op", "threshold", "minutes").orderBy("ts")
    p = got.withColumn("__p", F.row_number().over(w)).where(broken)
    runs = p.withColumn("__g", F.col("__p") - F.row_number().over(w)).groupBy(*KEYS, "op", "threshold", "minutes", "__g").agg(F.min("ts").alias("began"), F.max("ts").alias("ended"))
    return runs.where(F.timestamp_diff("MINUTE", F.col("began"), F.col("ended")) >= F.col("minutes")).drop("__g")


def threshold_sweep(scores: DataFrame, thresholds: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """Flags at 1, 0.9, 0.8 and 0.7 of the threshold; with ``truth(entity, metric, ts)``, true and false ones too."""
    factor = F.explode(F.array(*[F.lit(x) for x in (1.0, 0.9, 0.8, 0.7)]))
    got = scores.join(thresholds, list(KEYS)).withColumn("factor", factor).withColumn("flag", F.col("score") > F.col("threshold") * F.col("factor"))
    n = lambda c: F.sum(c.cast("long"))
    if truth is None:
        return got.groupBy("factor").agg(n(F.col("flag")).alias("flags"))
    got = got.join(truth.select(*KEYS, "ts").distinct().withColumn("real", F.lit(True)), [*KEYS, "ts"], "left")
    real = F.coalesce("real", F.lit(False))
    return got.groupBy("factor").agg(n(F.col("flag")).alias("flags"), n(F.col("flag") & real).alias("true_positives"), n(F.col("flag") & ~real).alias("false_positives"))


def edge_votes(granger: DataFrame, pc: DataFrame, allowed: DataFrame, first_seen: DataFrame) -> DataFrame:
    """Votes for each tested edge: significance, structure, topology (``allowed(incident_id, cause, effect, ok)``), order and lag."""
    key = ["incident_id", "cause", "effect"]
    t = lambda c: first_seen.select("incident_id", F.col("metric").alias(c), F.col("first_seen").alias(f"__{c}"))
    got = granger.join(pc.select(*key, F.lit(1).alias("pc")).distinct(), key, "full").join(allowed, key, "left")
    got = got.join(t("cause"), ["incident_id", "cause"], "left").join(t("effect"), ["incident_id", "effect"], "left")
    yes = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    votes = yes(F.col("p_value") < 0.05) + F.coalesce("pc", F.lit(0)) + F.when(F.col("ok"), 1).when(~F.col("ok"), -1).otherwise(0) + yes(F.col("__cause") < F.col("__effect")) + yes(F.col("lag").between(1, 5))
    got = got.select(*key, votes.alias("votes"))
    return got.withColumn("confidence", F.when(F.col("votes") >= 4, "HIGH").when(F.col("votes") == 3, "MEDIUM").otherwise("LOW"))


def adjusted_confidence() -> tuple[Column, Column]:
    """(confidence, label) from ``score, agreement, chain_quality, temporally_valid, hours_since_deployment``."""
    c = (F.col("score") + F.col("agreement") + F.col("chain_quality")) / 3
    c = c - F.when(F.col("temporally_valid"), 0.0).otherwise(0.10) + F.when(F.col("hours_since_deployment") <= 1, 0.05).otherwise(0.0)
    c = F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return c, confidence_label(c)


def missing_metric_penalty(present: DataFrame, required: DataFrame) -> DataFrame:
    """``missing, penalty, analysable`` of each entity against the ``required(metric)`` list."""
    want = present.select("entity").distinct().crossJoin(required.select("metric").distinct())
    got = want.join(present.select(*KEYS).distinct().withColumn("has", F.lit(1)), list(KEYS), "left")
    got = got.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("has").isNull().cast("long")).alias("missing"))
    penalty = F.when(F.col("missing") >= 5, 0.30).when(F.col("missing") >= 1, 0.10).otherwise(0.0)
    return got.select("entity", "missing", penalty.alias("penalty"), (F.col("missing") <= 0.5 * F.col("n")).alias("analysable"))


def coverage(modes: DataFrame, present: DataFrame) -> DataFrame:
    """For each failure mode (``mode, metric``) whether all its metrics are there, which aren't, and the covered share of modes."""
    got = modes.join(present.select("metric").distinct().withColumn("has", F.lit(True)), "metric", "left")
    gaps = F.array_sort(F.collect_set(F.when(F.col("has").isNull(), F.col("metric"))))
    got = got.groupBy("mode").agg(F.bool_and(F.coalesce("has", F.lit(False))).alias("covered"), F.array_join(gaps, ",").alias("gaps"))
    share = got.agg((F.avg(F.col("covered").cast("double")) * 100).alias("covered_pct"))
    return got.crossJoin(share)


def quality_report(samples: DataFrame, grid: DataFrame, seq: str = "seq") -> DataFrame:
    """Of each metric the missing share of the grid, repeated and out-of-order times, values beyond 5σ, and whether it has disappeared."""
    arrival = _series().orderBy(seq)
    stats = samples.groupBy(*KEYS).agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    s = samples.withColumn("late", F.col("ts") < F.lag("ts").over(arrival)).join(stats, list(KEYS))
    n = lambda c: F.sum(F.coalesce(c.cast("long"), F.lit(0)))
    s = s.groupBy(*KEYS).agg((F.count("ts") - F.countDistinct("ts")).alias("duplicates"), n(F.col("late")).alias("out_of_order"), n(F.abs(F.col("value") - F.col("m")) > 5 * F.col("s")).alias("beyond_5_sigma"))
    g = grid.groupBy(*KEYS).agg((F.avg(F.col("value").isNull().cast("double")) * 100).alias("missing_pct"), (F.max("pos") - F.max(F.when(F.col("value").isNotNull(), F.col("pos"))) >= 12).alias("disappeared"))
    return s.join(g, list(KEYS))


def zscore_normalise(df: DataFrame) -> DataFrame:
    """(value − mean) / standard deviation of each metric, 0 if constant."""
    stats = df.groupBy(*KEYS).agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    return df.join(stats, list(KEYS)).withColumn("value", F.when(F.col("s") > 0, (F.col("value") - F.col("m")) / F.col("s")).otherwise(0.0)).drop("m", "s")


def explain_candidate() -> Column:
    """Why a candidate ranks where it does, from its factors."""
    said = F.concat_ws(
        "; ",
        F.when(F.col("causal_outflow") > 0.5, "affects many downstream metrics"),
        F.when(F.col("temporal_priority") > 0.7, "appeared early in the incident"),
        F.when(F.col("causal_inflow") > 0.8, "has few upstream causes"),
        F.when(F.col("event_correlation") > 0.5, "follows a recent event"),
    )
    return F.when(said == "", "moderate score over all factors").otherwise(said)
