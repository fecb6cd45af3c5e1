"""Scores, ranking and reports of root-cause candidates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causetrace.functions.shared import dropped, settled
from causetrace.functions.text import fixed
from causetrace.operators.graph import incident_closure

#: Nodes and links of an incident that one group walks.
GROUPED = 1_000_000
#: Factor weights of the two rankers, and their share against PageRank.
WEIGHTS_A = {"causal_outflow": 0.40, "temporal_priority": 0.30, "causal_inflow": 0.20, "anomaly_severity": 0.05, "event_correlation": 0.05}
WEIGHTS_B = {"causal_outflow": 0.30, "temporal_priority": 0.25, "causal_inflow": 0.15, "anomaly_severity": 0.15, "event_correlation": 0.15}
HEURISTIC_SHARE, DAMPING = 0.7, 0.85
#: Least score of each label.
LABELS = (("Critical", 0.95), ("High", 0.85), ("Medium", 0.70), ("Low", 0.50))


def _incident():
    return Window.partitionBy("incident_id")


def degree_scores(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``causal_outflow`` (out-degree over the largest) and ``causal_inflow`` (1 − in-degree over the largest)."""
    n = lambda c, name: edges.groupBy("incident_id", F.col(c).alias("metric")).agg(F.count(F.lit(1)).alias(name))
    got = nodes.select("incident_id", "metric").join(n("cause", "o"), ["incident_id", "metric"], "left").join(n("effect", "i"), ["incident_id", "metric"], "left").fillna(0, ["o", "i"])
    most = lambda c: F.greatest(F.max(c).over(_incident()), F.lit(1))
    return got.select("incident_id", "metric", (F.col("o") / most("o")).alias("causal_outflow"), (1 - F.col("i") / most("i")).alias("causal_inflow"))


def _seconds() -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("first_seen").cast("timestamp_ntz")) / 1e6


def _priority() -> Column:
    """From the first to the last ``t`` of an incident, 1 to 0."""
    lo, hi = F.min("t").over(_incident()), F.max("t").over(_incident())
    return F.coalesce(1 - (F.col("t") - lo) / F.when(hi == lo, 1.0).otherwise(hi - lo), F.lit(0.0))


def temporal_priority(first_seen: DataFrame) -> DataFrame:
    """R2: 1 for the first metric of an incident, 0 for the last and for unknown times; equal times all have 1."""
    got = first_seen.select("incident_id", "metric", _seconds().alias("t"))
    return got.withColumn("temporal_priority", _priority()).drop("t")


def event_factor(correlations: DataFrame) -> DataFrame:
    """The best event correlation of each metric."""
    return correlations.groupBy("incident_id", "metric").agg(F.max("correlation_score").alias("event_correlation"))


def _grouped_pagerank(nodes: DataFrame, edges: DataFrame, rounds: int, tolerance: float, damping: float) -> DataFrame:
    """Each incident's graph as one group: lists of links, no matrix."""

    def one(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = sorted(left["metric"])
        if not names:
            return pd.DataFrame({"incident_id": pd.Series(dtype=object), "metric": pd.Series(dtype=object), "pagerank": pd.Series(dtype=float)})
        at, n = {m: k for k, m in enumerate(names)}, len(names)
        links = [(at[c], at[e], w) for c, e, w in zip(right["cause"], right["effect"], right["w"], strict=True) if c in at and e in at]
        to, of, w = (np.array(x) for x in zip(*links, strict=True)) if links else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        out = np.bincount(of, w, n)
        share = w / np.where(out > 0, out, 1)[of]
        r = np.full(n, 1 / n)
        for _ in range(rounds):
            was = r
            r = (1 - damping) / n + damping * (r[out == 0].sum() / n + np.bincount(to, share * r[of], n))
            if abs(r - was).sum() < n * tolerance:
                break
        return pd.DataFrame({"incident_id": key[0], "metric": names, "pagerank": r})

    grouped = nodes.groupBy("incident_id").cogroup(edges.groupBy("incident_id"))
    return grouped.applyInPandas(one, "incident_id string, metric string, pagerank double").where("metric is not null")


def _joined_pagerank(nodes: DataFrame, edges: DataFrame, rounds: int, tolerance: float, damping: float) -> DataFrame:
    """Every round passes ranks along links by a join; rounds are written to the shared folder. An incident stops when its own ranks have settled."""
    key = ["incident_id", "metric"]
    known = edges.join(nodes.select("incident_id", F.col("metric").alias("cause")), ["incident_id", "cause"], "left_semi").join(nodes.select("incident_id", F.col("metric").alias("effect")), ["incident_id", "effect"], "left_semi")
    out = known.groupBy("incident_id", "effect").agg(F.sum("w").alias("out")).where("out > 0")
    links = settled(known.join(out, ["incident_id", "effect"]).select("incident_id", "cause", F.col("effect").alias("metric"), (F.col("w") / F.col("out")).alias("share")), "links")
    size = nodes.groupBy("incident_id").agg(F.count(F.lit(1)).alias("n"))
    loose = links.select(*key).distinct().withColumn("led", F.lit(True))
    now = settled(nodes.join(size, "incident_id").join(loose, key, "left").select(*key, "n", F.col("led").isNull().alias("loose"), (1 / F.col("n")).alias("r"), F.lit(False).alias("done")), "ranks")
    old = [now]
    for _ in range(rounds):
        gained = links.join(now.where("not done").select(*key, "r"), key).groupBy("incident_id", F.col("cause").alias("metric")).agg(F.sum(F.col("share") * F.col("r")).alias("g"))
        lost = now.where("not done").groupBy("incident_id").agg(F.coalesce(F.sum(F.when(F.col("loose"), F.col("r"))), F.lit(0.0)).alias("lost"))
        both = now.join(lost, "incident_id", "left").join(gained, key, "left")
        new = (1 - damping) / F.col("n") + damping * (F.col("lost") / F.col("n") + F.coalesce("g", F.lit(0.0)))
        then = settled(both.select(*key, "n", "loose", F.when(F.col("done"), F.col("r")).otherwise(new).alias("r"), "done", F.when(F.col("done"), 0.0).otherwise(F.abs(new - F.col("r"))).alias("moved")), "ranks")
        still = then.where("not done").groupBy("incident_id").agg((F.sum("moved") < F.max("n") * tolerance).alias("stops"))
        still = settled(still, "stops")
        for x in old:
            dropped(x)
        old = [then, still]
        now = then.join(still, "incident_id", "left").select(*key, "n", "loose", "r", F.coalesce("stops", F.lit(True)).alias("done"))
        if still.where("not stops").isEmpty():
            break
    return now.select(*key, F.col("r").alias("pagerank"))


def pagerank(nodes: DataFrame, edges: DataFrame, weighted: bool = True, rounds: int = 100, tolerance: float = 1e-6, damping: float = DAMPING, grouped: int = GROUPED) -> DataFrame:
    """``incident_id, metric, pagerank`` on the reversed graph, by power iteration; repeated links add up, links of unknown metrics don't count.

    An incident of at most ``grouped`` nodes and links (any real one: nodes are its metrics) is one group, and all of those run in parallel after one shuffle. Larger graphs, such as those
    of services, iterate by joins, with the same result.
    """
    w = F.col("strength").cast("double") if weighted else F.lit(1.0)
    left, right = nodes.select("incident_id", "metric"), edges.select("incident_id", "cause", "effect", w.alias("w"))
    size = left.select("incident_id").unionByName(right.select("incident_id")).groupBy("incident_id").agg(F.count(F.lit(1)).alias("n"))
    large = settled(size.where(F.col("n") > grouped).select("incident_id"), "large")
    if large.isEmpty():
        return _grouped_pagerank(left, right, rounds, tolerance, damping)
    rest = lambda df, how: df.join(large, "incident_id", how)
    by_joins = _joined_pagerank(settled(rest(left, "left_semi"), "nodes"), rest(right, "left_semi"), rounds, tolerance, damping)
    return _grouped_pagerank(rest(left, "left_anti"), rest(right, "left_anti"), rounds, tolerance, damping).unionByName(by_joins)


def factors(nodes: DataFrame, edges: DataFrame, first_seen: DataFrame, correlations: DataFrame, ranks: DataFrame) -> DataFrame:
    """R1 to R5 side by side for every node; what is unknown counts 0.

    All tables are stacked and added up by metric, partly where they lie, in place of a join for each: one shuffle by metric, and one by incident for its extremes.
    """
    kinds = {"node": "boolean", "anomaly_severity": "double", "o": "bigint", "i": "bigint", "t": "double", "event_correlation": "double", "pagerank": "double"}

    def part(df: DataFrame, metric: str | Column = "metric", **given: Column) -> DataFrame:
        metric = F.col(metric) if isinstance(metric, str) else metric
        return df.select("incident_id", metric.alias("metric"), *[given.get(k, F.lit(None)).cast(v).alias(k) for k, v in kinds.items()])

    one = F.lit(1)
    ends = edges.select("incident_id", F.inline(F.array(F.struct(F.col("cause").alias("metric"), one.alias("o"), F.lit(0).alias("i")), F.struct(F.col("effect").alias("metric"), F.lit(0).alias("o"), one.alias("i")))))
    stacked = part(nodes, node=F.lit(True), anomaly_severity=F.col("anomaly_score")).unionByName(part(ends, o=F.col("o"), i=F.col("i"))).unionByName(part(first_seen, t=_seconds()))
    stacked = stacked.unionByName(part(correlations, event_correlation=F.col("correlation_score"))).unionByName(part(ranks, pagerank=F.col("pagerank")))
    got = stacked.groupBy("incident_id", "metric").agg(*[(F.sum(k) if k in ("o", "i") else F.max(k)).alias(k) for k in kinds])
    most = lambda c: F.greatest(F.max(F.when(F.col("node"), F.col(c))).over(_incident()), F.lit(1))
    share = lambda c: F.coalesce(F.col(c), F.lit(0)) / most(c)
    placed = got.select("incident_id", "metric", "node", share("o").alias("causal_outflow"), (1 - share("i")).alias("causal_inflow"), _priority().alias("temporal_priority"), "anomaly_severity", "event_correlation", "pagerank")
    return placed.where("node").drop("node").fillna(0.0)


def heuristic(weights: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + w * F.col(name)
    return total


def composite_score_a(weights: dict[str, float] = WEIGHTS_A) -> Column:
    """Capped at 1, six decimals."""
    return F.round(F.least(HEURISTIC_SHARE * heuristic(weights) + (1 - HEURISTIC_SHARE) * F.col("pagerank"), F.lit(1.0)), 6)


def composite_score_b(weights: dict[str, float] = WEIGHTS_B) -> Column:
    """Neither capped nor rounded."""
    return HEURISTIC_SHARE * heuristic(weights) + (1 - HEURISTIC_SHARE) * F.col("pagerank")


def confidence_label(score: Column) -> Column:
    """R8"""
    out = F.lit("Very Low")
    for name, least in reversed(LABELS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def downstream_effects(edges: DataFrame) -> DataFrame:
    """Direct successors of each metric, sorted."""
    return edges.groupBy("incident_id", F.col("cause").alias("metric")).agg(F.array_sort(F.collect_set("effect")).alias("downstream_effects"))


def upstream_causes(edges: DataFrame) -> DataFrame:
    """Direct predecessors of each metric, sorted."""
    return edges.groupBy("incident_id", F.col("effect").alias("metric")).agg(F.array_sort(F.collect_set("cause")).alias("upstream_causes"))


def causal_chain(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each metric, then all it reaches, by the fewest steps to it, then by name."""
    placed = F.sort_array(F.collect_list(F.struct("depth", "dst")))
    reach = incident_closure(edges).where("src <> dst").groupBy("incident_id", F.col("src").alias("metric")).agg(F.transform(placed, lambda x: x["dst"]).alias("rest"))
    got = nodes.select("incident_id", "metric").join(reach, ["incident_id", "metric"], "left")
    return got.select("incident_id", "metric", F.concat(F.array("metric"), F.coalesce("rest", F.array().cast("array<string>"))).alias("causal_chain"))


def rank_candidates(scored: DataFrame, score: str = "composite_score") -> DataFrame:
    """``rank`` from 1 by falling score, then metric name."""
    return scored.withColumn("rank", F.row_number().over(_incident().orderBy(F.desc(score), "metric")).cast("long"))


def edge_report(edges: DataFrame) -> DataFrame:
    """Edges by falling strength with rounded figures."""
    place = F.row_number().over(_incident().orderBy(F.desc("strength"), "cause", "effect")).cast("long")
    return edges.select("incident_id", place.alias("place"), "cause", "effect", F.round("strength", 4).alias("strength"), F.round("p_value", 6).alias("p_value"), "lag")


def top(rows: DataFrame, by: str, k: int = 5, tie: str = "metric") -> DataFrame:
    """The ``k`` rows of each incident with the largest ``by``."""
    return rows.withColumn("place", F.row_number().over(_incident().orderBy(F.desc(by), tie)).cast("long")).where(F.col("place") <= k)


def node_category(nodes: DataFrame, edges: DataFrame, ranked: DataFrame) -> DataFrame:
    """``root cause`` (rank 1), ``source`` (nothing causes it) or ``intermediate``."""
    caused = edges.select("incident_id", F.col("effect").alias("metric"), F.lit(True).alias("__in")).distinct()
    got = nodes.select("incident_id", "metric").join(caused, ["incident_id", "metric"], "left").join(ranked.select("incident_id", "metric", "rank"), ["incident_id", "metric"], "left")
    return got.select("incident_id", "metric", F.when(F.col("rank") == 1, "root cause").when(F.col("__in").isNull(), "source").otherwise("intermediate").alias("category"))


def truth_alignment(ranked: DataFrame, truth: DataFrame, k: int = 1) -> DataFrame:
    """Whether a name part of one of the first ``k`` candidates occurs in the truth's chain or root-cause text."""
    parts = lambda c: F.split(F.lower(c), "_")
    told = F.flatten(F.transform("causal_chain", lambda m: F.split(F.lower(m), "_")))
    told = F.concat(told, F.split(F.lower(F.coalesce("root_cause", F.lit(""))), r"[_\s]+")) if k > 1 else told
    hit = F.arrays_overlap(parts(F.col("metric")), F.filter(told, lambda x: x != ""))
    first = ranked.where(F.col("rank") <= k).select("incident_id", "metric")
    got = truth.join(first, "incident_id", "left")
    return got.groupBy("incident_id").agg(F.bool_or(F.coalesce(hit, F.lit(False))).alias("aligned"))


def benchmark_accuracy(top1: DataFrame, top3: DataFrame) -> DataFrame:
    """Percentages of incidents that are right at rank 1 and within 3."""
    share = lambda df, name: df.agg((F.avg(F.col("aligned").cast("double")) * 100).alias(name))
    return share(top1, "top1_pct").crossJoin(share(top3, "top3_pct"))


def markdown_report(ranked: DataFrame) -> DataFrame:
    """``incident_id, report``: summary, confidence, chain, evidence and up to three alternatives as Markdown.

    An incident of which all candidates are null (left join upstream) gets a fixed sentence.
    """
    pct = F.concat(fixed(F.least(F.col("c.composite_score") * 100, F.lit(100.0)), 1), F.lit("%"))
    sorted_rows = F.array_sort(F.collect_list(F.when(F.col("metric").isNotNull(), F.struct("rank", "metric", "composite_score", "confidence", "causal_outflow", "temporal_priority", "causal_inflow", "event_correlation", "downstream_effects"))))
    got = ranked.groupBy("incident_id").agg(sorted_rows.alias("all")).withColumn("c", F.try_element_at("all", F.lit(1)))
    effects = F.coalesce("c.downstream_effects", F.array().cast("array<string>"))
    chain = F.when(F.size(effects) == 0, "It shows no downstream effect.").when(F.size(effects) == 1, F.concat(F.lit("It affects `"), effects[0], F.lit("`."))).otherwise(
        F.concat(F.lit("It affects "), F.size(effects).cast("string"), F.lit(" metrics: "), F.array_join(effects, ", "), F.lit("."))
    )
    line = lambda label, c: F.concat(F.lit(f"- {label}: "), fixed(F.col(f"c.{c}"), 2))
    others = F.transform(F.slice("all", 2, 3), lambda x: F.concat(F.lit("- `"), x["metric"], F.lit("`: "), fixed(F.least(x["composite_score"] * 100, F.lit(100.0)), 1), F.lit("%")))
    text = F.concat_ws(
        "\n",
        F.lit("# Incident report"),
        F.concat(F.lit("Most likely root cause: `"), F.col("c.metric"), F.lit("` ("), F.col("c.confidence"), F.lit(", "), pct, F.lit(")")),
        chain,
        F.lit("## Evidence"),
        line("causal outflow", "causal_outflow"),
        line("temporal priority", "temporal_priority"),
        line("causal inflow", "causal_inflow"),
        line("event correlation", "event_correlation"),
        F.when(F.size(others) > 0, F.concat(F.lit("## Alternatives\n"), F.array_join(others, "\n"))),
    )
    return got.select("incident_id", F.when(F.col("c").isNull(), "No root cause candidates were found.").otherwise(text).alias("report"))


def ranking_table(ranked: DataFrame, shown: int = 3) -> DataFrame:
    """A flat table; long effect lists are cut to ``shown`` names and a count of the rest."""
    d = F.coalesce("downstream_effects", F.array().cast("array<string>"))
    more = F.when(F.size(d) > shown, F.concat(F.lit(" (+"), (F.size(d) - shown).cast("string"), F.lit(" more)"))).otherwise("")
    return ranked.select("incident_id", "rank", "metric", "composite_score", "confidence", *WEIGHTS_A, F.concat(F.array_join(F.slice(d, 1, shown), ", "), more).alias("downstream"))
