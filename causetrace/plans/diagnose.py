"""From metric series and events to ranked root causes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causetrace.functions.shared import settled
from causetrace.operators import causal, detect, graph, prepare, rank


def diagnose(series: DataFrame, incidents: DataFrame, events: DataFrame, topology: DataFrame | None = None, max_lag: int = 10, alpha: float = 0.05, prune: str = "before") -> dict[str, DataFrame]:
    """``ranked, nodes, edges, correlations`` of every incident at once.

    ``series``: ``incident_id, metric, ts, value``; ``incidents``: ``incident_id, metric, max_score, first_seen``. Only anomalous
    metrics are tested. With a topology, edges it contradicts go before anything is ranked, or with ``prune="after"`` only from the
    edges, effects and chains that are reported, so that they still count for the ranking.
    """
    if prune not in ("before", "after"):
        raise ValueError("prune is before or after")
    incidents = settled(incidents, "incidents")  # used by every step below
    active = settled(series.join(incidents.select("incident_id", "metric"), ["incident_id", "metric"], "left_semi"), "active")
    pairs = causal.granger(active, max_lag, alpha).withColumnRenamed("optimal_lag", "lag")
    nodes, edges = graph.build_causal_graph(incidents, pairs)
    if topology is not None and prune == "before":
        edges = graph.refine_by_topology(edges, topology)
    edges = settled(graph.break_cycles(edges, incidents))
    correlations = graph.correlate_events(incidents, events)
    ranks = rank.pagerank(nodes, edges)
    # the best correlation of a metric is that of its closest event
    scored = rank.factors(nodes, edges, incidents, graph.closest_events(incidents, events), ranks)
    scored = scored.withColumn("composite_score", rank.composite_score_a())
    ranked = rank.rank_candidates(scored).withColumn("confidence", rank.confidence_label(F.col("composite_score")))
    if topology is not None and prune == "after":
        edges = settled(graph.refine_by_topology(edges, topology))
    key = ["incident_id", "metric"]
    ranked = settled(ranked, "ranked").join(rank.downstream_effects(edges), key, "left").join(rank.causal_chain(nodes, edges), key, "left")
    return {"ranked": ranked, "nodes": nodes, "edges": edges, "correlations": correlations}


def run_pipeline(normal: DataFrame, incident: DataFrame, metrics: list[str], events: DataFrame, window: int = 12, rule: str = "reconstruction", topology: DataFrame | None = None, max_lag: int = 10, alpha: float = 0.05) -> dict[str, DataFrame]:
    """Scaling, a reconstruction model for each entity, thresholds, ensemble scores, incident summary, diagnosis and report. Tables are ``entity, metric, ts, value``.

    A model is fitted to the first 80 % of the normal windows, its thresholds are percentiles of its errors on the others. ``rule`` is D15's.
    """
    bounds = prepare.fit_minmax(normal)
    a = settled(prepare.apply_minmax(normal, bounds), "normal")
    b = settled(prepare.apply_minmax(prepare.fill_incident(incident), bounds), "incident")
    models = settled(detect.fit_entity_models(a, metrics, window), "models")
    error = lambda df: detect.entity_reconstruction_error(df, models, metrics, window)
    thresholds = detect.calibrate_thresholds(detect.held_out_errors(a, models, metrics, window))
    reconstruction = detect.flag_scores(error(b), thresholds)
    statistical = detect.statistical_scores(b, detect.fit_baselines(a))
    scores = detect.ensemble_scores(reconstruction, statistical, detect.temporal_scores(b), rule)
    scores = settled(scores.withColumn("score", F.col("ensemble")))
    incidents = detect.summarise_incident(scores)
    series = b.select(F.col("entity").alias("incident_id"), "metric", "ts", "value")
    out = diagnose(series, incidents, events, topology, max_lag, alpha)
    return out | {"scores": scores, "thresholds": thresholds, "incidents": incidents, "reports": rank.markdown_report(out["ranked"])}
