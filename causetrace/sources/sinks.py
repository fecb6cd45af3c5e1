"""Report and table sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Factors that a ranked candidate's breakdown shows, where present.
FACTORS = ("causal_outflow", "temporal_priority", "causal_inflow", "anomaly_severity", "event_correlation", "pagerank")


def report_documents(ranked: DataFrame, edges: DataFrame, events: DataFrame, first_seen: DataFrame | None = None, truth: DataFrame | None = None, made: Column | str | None = None) -> DataFrame:
    """``incident_id, report``: one JSON document for each incident of ``ranked``.

    Fields: incident_id, timestamp (``made``), failure_type and ground_truth (of ``truth``: incident_id, failure_type, root_cause, causal_chain; whatever is
    there), root_causes with the breakdown of their scores, downstream effects and chains, causal_graph (nodes and edges; strength four, p six
    decimals), event_correlations, anomaly_detection_times. Where many metrics share their events, let ``events`` hold ``metric, anomaly_time, n_events`` in place of a row for each pair, beside the lists of ``write_event_lists``. Lists are in order of rank, name or time; what is unknown is an empty list or left out.
    """
    of = "incident_id"
    listed = lambda df, name, *cols: df.groupBy(of).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    factors = [F.round(c, 6).alias(c) for c in FACTORS if c in ranked.columns]
    extra = [c for c in ("downstream_effects", "causal_chain") if c in ranked.columns]
    breakdown = [F.struct(*factors).alias("scores_breakdown")] if factors else []
    causes = listed(ranked, "root_causes", "rank", "metric", "composite_score", "confidence", *breakdown, *extra)
    nodes = ranked.groupBy(of).agg(F.array_sort(F.collect_set("metric")).alias("nodes"))
    links = listed(edges, "edges", "cause", "effect", F.round("strength", 4).alias("strength"), "lag", F.round("p_value", 6).alias("p_value"))
    told = [c for c in ("metric", "event_time", "event_description", "event_type", "anomaly_time", "delta_hours", "correlation_score", "n_events") if c in events.columns]
    rows = causes.join(nodes, of).join(links, of, "left").join(listed(events, "event_correlations", *told), of, "left")
    none = lambda c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)).alias(c)
    fields = [F.col(of)]
    if made is not None:
        fields.append((F.lit(made) if isinstance(made, str) else made).alias("timestamp"))
    if truth is not None:
        rows = rows.join(truth, of, "left")
        fields += [F.col(c) for c in ("failure_type",) if c in truth.columns]
        fields.append(F.struct(*[c for c in ("root_cause", "causal_chain") if c in truth.columns]).alias("ground_truth"))
    fields += [F.col("root_causes"), F.struct("nodes", none("edges")).alias("causal_graph"), none("event_correlations")]
    if first_seen is not None:
        at = F.struct("metric", F.col("first_seen").cast("string").alias("at"))
        rows = rows.join(first_seen.where("first_seen is not null").groupBy(of).agg(F.map_from_entries(F.array_sort(F.collect_set(at))).alias("anomaly_detection_times")), of, "left")
        fields.append(F.col("anomaly_detection_times"))
    return rows.select(of, F.to_json(F.struct(*fields)).alias("report"))


def write_report(documents: DataFrame, path: str) -> None:
    """One JSON document on each line."""
    documents.select(F.col("report").alias("value")).write.mode("overwrite").text(path)


def write_event_lists(lists: DataFrame, path: str) -> None:
    """C12's ``event_lists`` as gzipped JSON lines, once for each time of an anomaly; documents refer to them by ``anomaly_time``."""
    times = {c: F.col(c).cast("string") for c in ("anomaly_time", "event_time")}
    lists.withColumns(times).write.mode("overwrite").option("compression", "gzip").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """A flat CSV export; arrays and maps become JSON text."""
    flat = [F.to_json(c).alias(c) if rows.schema[c].dataType.typeName() in ("array", "map", "struct") else F.col(c) for c in rows.columns]
    rows.select(*flat).write.mode("overwrite").option("header", True).csv(path)


write_rankings_csv = write_benchmark_csv = write_metrics_csv = write_csv
