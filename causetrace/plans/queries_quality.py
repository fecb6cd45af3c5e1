"""Registered queries of quality checks and the remaining rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from causetrace.operators import causal, detect, graph, prepare, quality
from causetrace.plans.queries_causal import _RANKED, _TRUTH, _ranked, _seen_nodes, _truth
from causetrace.plans.registry import CLOSED, DAG, EDGES, FILLED, GRAPH, GRID, MARKS, S, SERIES, STAT, dag_edges, filled, first_seen, grid, lagged_edges, nodes, query, samples, scored, series

_HOURLY = GRID.replace("6 hours", "1 hours")
_PAIRS = "r AS (SELECT x.entity, x.metric AS a, y.metric AS b, corr(x.value, y.value) AS r FROM filled x JOIN filled y ON x.entity = y.entity AND x.ts = y.ts AND x.metric < y.metric GROUP BY 1, 2, 3)"


def _hourly(spark, d):
    return prepare.reindex_grid(prepare.bin_mean(samples(spark, d), "1 hours"), "1 hours")


@query(f"""WITH {_HOURLY}, {MARKS}, g AS (SELECT *, CASE WHEN value IS NULL THEN coalesce(pq, max(pos) OVER (PARTITION BY entity, metric) + 1) - coalesce(pp, -1) - 1 ELSE 0 END AS gap FROM marks)
SELECT entity, metric, ts, pos, gap, gap > 288 AS long_gap, round(CASE WHEN gap = 0 THEN value WHEN gap = 1 THEN coalesce(vp + (vq - vp) * (pos - pp) / (pq - pp), vp) WHEN gap <= 12 THEN vp WHEN gap <= 288 THEN coalesce(vp + (vq - vp) * (pos - pp) / (pq - pp), vp) END, 6) AS value FROM g""")
def b1_fill_by_gap_size(spark, d):
    return quality.fill_by_gap_size(_hourly(spark, d)).withColumn("value", F.round("value", 6))


@query(f"WITH {FILLED}, v AS (SELECT entity, metric, var_samp(value) AS v FROM filled GROUP BY 1, 2) SELECT entity, metric, round(v, 4) AS variance, row_number() OVER (PARTITION BY entity ORDER BY v DESC, metric) AS place FROM v QUALIFY place <= 3")
def b2_select_by_variance(spark, d):
    return quality.select_by_variance(filled(spark, d), 3).withColumns({"variance": F.round("variance", 4), "place": F.col("place").cast("long")})


@query(f"WITH {FILLED}, {_PAIRS} SELECT DISTINCT f.entity, f.metric FROM filled f WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.entity = f.entity AND r.b = f.metric AND abs(r.r) > 0.08)")
def b2_select_by_correlation(spark, d):
    return quality.select_by_correlation(filled(spark, d), 0.08)


@query(f"""WITH {FILLED}, n AS (SELECT *, row_number() OVER (PARTITION BY entity, metric ORDER BY ts DESC) <= 40 AS new FROM filled), m AS (SELECT entity, metric, avg(value) FILTER (NOT new) AS mh, stddev_pop(value) FILTER (NOT new) AS sh, avg(value) FILTER (new) AS mr, stddev_pop(value) FILTER (new) AS sr FROM n GROUP BY 1, 2),
k AS (SELECT entity, metric, 0.5 * (ln(sr / sh) + (sh * sh + (mh - mr) * (mh - mr)) / (2 * sr * sr) - 0.5) AS k FROM m WHERE sh > 0 AND sr > 0) SELECT entity, metric, round(k, 6) AS divergence, k > 0.5 AS drift FROM k""")
def b3_gaussian_drift(spark, d):
    return quality.gaussian_drift(filled(spark, d), 40).withColumn("divergence", F.round("divergence", 6))


@query(f"""WITH {_RANKED}{_TRUTH}, n AS (SELECT incident_id, count(*) AS n FROM ranked GROUP BY 1), x AS (SELECT coalesce(r.rank, coalesce(n, 0) + 1) AS k FROM truth t LEFT JOIN ranked r ON r.incident_id = t.incident_id AND r.metric = t.root_cause LEFT JOIN n ON n.incident_id = t.incident_id)
SELECT avg((k <= 1)::INT) AS top1, avg((k <= 3)::INT) AS top3, round(avg(1.0 / k), 6) AS mrr FROM x""")
def b4_evaluate_rankings(spark, d):
    return quality.evaluate_rankings(_ranked(spark, d), _truth(spark, d)).withColumn("mrr", F.round("mrr", 6))


@query(f"""WITH RECURSIVE {GRAPH}{CLOSED}, dn AS (SELECT incident_id, src AS metric, count(*) AS below FROM closure WHERE src <> dst GROUP BY 1, 2), up AS (SELECT incident_id, dst AS metric, count(*) AS above FROM closure WHERE src <> dst GROUP BY 1, 2),
j AS (SELECT n.*, count(*) OVER w AS size, coalesce(below, 0) AS below, coalesce(above, 0) AS above, coalesce(greatest(1 - floor(epoch(s.first_seen) - min(epoch(s.first_seen)) OVER w) / 300 / 1000, 0), 0) AS early FROM nodes n LEFT JOIN seen s USING (incident_id, metric) LEFT JOIN dn USING (incident_id, metric) LEFT JOIN up USING (incident_id, metric) WINDOW w AS (PARTITION BY n.incident_id))
SELECT incident_id, metric, round(0.4 * below / size + 0.2 * (1 - above / size) + 0.3 * early + 0.1 * anomaly_score, 6) AS score FROM j WHERE anomaly_score >= 0.5""")
def b5_closure_scorer(spark, d):
    got = quality.closure_scorer(nodes(spark, d), lagged_edges(spark, d), _seen_nodes(spark, d))
    return got.withColumn("score", F.round("score", 6))


_WALKS = ", walk AS (SELECT incident_id, cause AS root, effect AS node, [cause, effect] AS path, lag AS total FROM edges UNION ALL SELECT w.incident_id, w.root, e.effect, list_append(w.path, e.effect), w.total + e.lag FROM walk w JOIN edges e ON e.incident_id = w.incident_id AND e.cause = w.node WHERE len(w.path) < 9 AND NOT list_contains(w.path, e.effect))"


@query(f"WITH RECURSIVE {DAG}{_WALKS} SELECT incident_id, root, array_to_string(path, ' → ') AS path FROM walk w WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.incident_id = w.incident_id AND e.cause = w.node)")
def b6_paths_to_leaves(spark, d):
    return quality.paths_to_leaves(dag_edges(spark, d))


@query()
def b6_paths_of_acyclic_graph(spark, d):
    """Every edge of the incident, without cycles by C5."""
    return quality.paths_to_leaves(graph.break_cycles(lagged_edges(spark, d), first_seen(spark, d)))


@query(f"WITH {EDGES} SELECT incident_id, cause, effect, round(-log10(p_value + 1e-10), 6) AS weight FROM edges")
def b7_edge_weight_log_p(spark, d):
    return lagged_edges(spark, d).select("incident_id", "cause", "effect", F.round(quality.edge_weight_log_p(), 6).alias("weight"))


@query(f"""WITH {FILLED}, {_PAIRS}, k AS (SELECT entity, max(r) FILTER (a = 'click' AND b = 'error') AS xy, max(r) FILTER (a = 'click' AND b = 'view') AS xz, max(r) FILTER (a = 'error' AND b = 'view') AS yz FROM r GROUP BY 1)
SELECT entity AS incident_id, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS r FROM k""")
def b8_partial_corr(spark, d):
    return causal.partial_corr_test(series(spark, d), "click", "error", ["view"]).select("incident_id", F.round("r", 6).alias("r"))


@query()
def b8_partial_corr_test(spark, d):
    return causal.partial_corr_test(series(spark, d), "click", "error", ["view", "signup"])


@query(f"WITH {FILLED}, q AS (SELECT entity, metric, ts, CASE WHEN metric = 'view' AND pos > 100 THEN 1 ELSE value END AS value FROM filled), n AS (SELECT *, row_number() OVER (PARTITION BY entity, metric ORDER BY ts DESC) AS b FROM q) SELECT entity, metric, count(DISTINCT value) <= 1 AS frozen FROM n WHERE b <= 12 GROUP BY 1, 2")
def b9_frozen_metrics(spark, d):
    f = filled(spark, d).withColumn("value", F.when((F.col("metric") == "view") & (F.col("pos") > 100), 1.0).otherwise(F.col("value")))
    return quality.frozen_metrics(f)


@query(f"""WITH {FILLED}, c AS (SELECT entity, metric, ts, abs(value - lag(value) OVER (PARTITION BY entity, metric ORDER BY ts)) AS dv, row_number() OVER (PARTITION BY entity, metric ORDER BY ts DESC) AS b FROM filled), m AS (SELECT *, avg(dv) OVER (PARTITION BY entity, metric) AS mean FROM c)
SELECT entity, metric, CAST(sum(CASE WHEN dv > 1.5 * mean THEN 1 ELSE 0 END) AS BIGINT) AS jumps, sum(CASE WHEN dv > 1.5 * mean THEN 1 ELSE 0 END) > 3 AS discontinuous FROM m WHERE b <= 12 GROUP BY 1, 2""")
def b10_discontinuities(spark, d):
    return quality.discontinuities(filled(spark, d), factor=1.5)


@query(f"WITH {S} SELECT entity, metric || '_percent' AS metric, min(value) AS lo, max(value) AS hi FROM s GROUP BY 1, 2 HAVING min(value) < -10 OR max(value) > 110")
def b11_out_of_range(spark, d):
    return quality.out_of_range(samples(spark, d).withColumn("metric", F.concat("metric", F.lit("_percent"))))


@query(f"WITH {GRID}, q AS (SELECT entity, metric, pos, CASE WHEN metric = 'view' AND pos > 100 THEN NULL ELSE value END AS value FROM grid) SELECT entity, metric, max(pos) - max(CASE WHEN value IS NOT NULL THEN pos END) AS silent, coalesce(max(pos) - max(CASE WHEN value IS NOT NULL THEN pos END) >= 12, false) AS gap FROM q GROUP BY 1, 2")
def b12_collection_gap(spark, d):
    return quality.collection_gap(grid(spark, d).withColumn("value", F.when((F.col("metric") == "view") & (F.col("pos") > 100), None).otherwise(F.col("value"))))


def _rules(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@query(f"WITH {S}, rules(metric, least, most) AS (VALUES ('click', 0.0, 50.0), ('view', -5.0, 1e9), ('cpu', 0.0, 1.0)), m AS (SELECT metric, min(value) AS lo, max(value) AS hi FROM s GROUP BY 1) SELECT metric, lo IS NOT NULL AS present, coalesce(lo >= least, false) AS min_ok, coalesce(hi <= most, false) AS max_ok FROM rules LEFT JOIN m USING (metric)")
def b13_validate_ranges(spark, d):
    rules = _rules(spark, [("click", 0.0, 50.0), ("view", -5.0, 1e9), ("cpu", 0.0, 1.0)], "metric string, least double, most double")
    return quality.validate_ranges(samples(spark, d), rules)


@query(f"WITH RECURSIVE {EDGES}{_WALKS}, roots AS (SELECT incident_id, metric AS root, min(ts) AS started FROM series GROUP BY 1, 2) SELECT incident_id, root, node AS metric, CAST(min(total) AS BIGINT) AS lag, started + INTERVAL 300 SECOND * min(total) AS expected FROM walk JOIN roots USING (incident_id, root) GROUP BY 1, 2, 3, started")
def b14_symptom_times(spark, d):
    roots = series(spark, d).groupBy("incident_id", F.col("metric").alias("root")).agg(F.min("ts").alias("started"))
    return quality.symptom_times(lagged_edges(spark, d), roots)


@query(f"WITH {EDGES}, r AS (SELECT x.incident_id AS entity, x.metric AS a, y.metric AS b, corr(x.value, y.value) AS r FROM series x JOIN series y ON x.incident_id = y.incident_id AND x.ts = y.ts AND x.metric < y.metric GROUP BY 1, 2, 3) SELECT entity, a, b, round(r, 6) AS r FROM r WHERE abs(r) > 0.02 AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.incident_id = entity AND ((cause = a AND effect = b) OR (cause = b AND effect = a)))")
def b15_hidden_confounders(spark, d):
    return quality.hidden_confounders(filled(spark, d), lagged_edges(spark, d), 0.02).withColumn("r", F.round("r", 6))


@query(f"""WITH RECURSIVE {_RANKED}{CLOSED}, told AS (SELECT c.incident_id, dst AS metric FROM closure c JOIN ranked r ON r.incident_id = c.incident_id AND r.metric = c.src AND r.rank = 1 UNION SELECT incident_id, metric FROM ranked WHERE rank = 1)
SELECT n.incident_id, count(*) AS anomalies, count(*) FILTER (t.metric IS NULL) AS unexplained FROM nodes n LEFT JOIN told t ON t.incident_id = n.incident_id AND t.metric = n.metric GROUP BY 1""")
def b16_explanation_gap(spark, d):
    return quality.explanation_gap(nodes(spark, d), lagged_edges(spark, d), _ranked(spark, d))


@query(f"""WITH {FILLED}, rules(metric, op, threshold, minutes) AS (VALUES ('click', '>', 40.0, 360), ('view', '<', 60.0, 720)), p AS (SELECT f.*, op, threshold, minutes, row_number() OVER (PARTITION BY f.entity, f.metric ORDER BY ts) AS p FROM filled f JOIN rules USING (metric)),
k AS (SELECT * FROM p WHERE CASE WHEN op = '>' THEN value > threshold ELSE value < threshold END), g AS (SELECT *, p - row_number() OVER (PARTITION BY entity, metric ORDER BY ts) AS g FROM k)
SELECT entity, metric, op, threshold, minutes, min(ts) AS began, max(ts) AS ended FROM g GROUP BY entity, metric, op, threshold, minutes, g HAVING date_diff('minute', min(ts), max(ts)) >= minutes""")
def b17_sustained_threshold(spark, d):
    rules = _rules(spark, [("click", ">", 40.0, 360), ("view", "<", 60.0, 720)], "metric string, op string, threshold double, minutes long")
    return quality.sustained_threshold(filled(spark, d).select("entity", "metric", "ts", "value"), rules)


@query(f"WITH {STAT}, t AS (SELECT entity, metric, quantile_cont(score, 0.9) AS threshold FROM stat GROUP BY 1, 2), x AS (SELECT score > threshold * factor AS flag, factor, value > 55 AS truth FROM stat JOIN t USING (entity, metric), (VALUES (1.0), (0.9), (0.8), (0.7)) f(factor)) SELECT CAST(factor AS DOUBLE) AS factor, count(*) FILTER (flag) AS flags, count(*) FILTER (flag AND truth) AS true_positives, count(*) FILTER (flag AND NOT truth) AS false_positives FROM x GROUP BY 1")
def b18_threshold_sweep(spark, d):
    s = scored(spark, d)
    return quality.threshold_sweep(s, detect.calibrate_thresholds(s, 90.0), s.where("value > 55"))


@query()
def b19_adf_report(spark, d):
    return causal.adf_report(series(spark, d))


@query(f"""WITH {GRAPH}, g AS (SELECT incident_id, cause, effect, p_value, lag FROM edges), pc AS (SELECT incident_id, cause, effect FROM edges WHERE strength > 0.1), a AS (SELECT incident_id, cause, effect, length(cause) <> length(effect) AS ok FROM edges)
, v AS (SELECT g.incident_id, g.cause, g.effect, coalesce((g.p_value < 0.05)::INT, 0) + (pc.cause IS NOT NULL)::INT + CASE WHEN ok THEN 1 WHEN NOT ok THEN -1 ELSE 0 END + coalesce((x.first_seen < y.first_seen)::INT, 0) + coalesce((g.lag BETWEEN 1 AND 5)::INT, 0) AS votes
FROM g LEFT JOIN pc USING (incident_id, cause, effect) LEFT JOIN a USING (incident_id, cause, effect) LEFT JOIN seen x ON x.incident_id = g.incident_id AND x.metric = g.cause LEFT JOIN seen y ON y.incident_id = g.incident_id AND y.metric = g.effect)
SELECT incident_id, cause, effect, votes, CASE WHEN votes >= 4 THEN 'HIGH' WHEN votes = 3 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM v""")
def b20_edge_votes(spark, d):
    e = lagged_edges(spark, d)
    allowed = e.select("incident_id", "cause", "effect", (F.length("cause") != F.length("effect")).alias("ok"))
    return quality.edge_votes(e, e.where("strength > 0.1"), allowed, _seen_nodes(spark, d))


@query(f"""WITH {_RANKED}, c AS (SELECT incident_id, metric, (composite_score + causal_outflow + causal_inflow) / 3 - CASE WHEN temporal_priority > 0 THEN 0 ELSE 0.10 END + CASE WHEN rank <= 1 THEN 0.05 ELSE 0 END AS c FROM ranked), d AS (SELECT incident_id, metric, least(greatest(c, 0), 1) AS c FROM c)
SELECT incident_id, metric, round(c, 6) AS confidence, CASE WHEN c >= 0.95 THEN 'Critical' WHEN c >= 0.85 THEN 'High' WHEN c >= 0.70 THEN 'Medium' WHEN c >= 0.50 THEN 'Low' ELSE 'Very Low' END AS label FROM d""")
def b21_adjusted_confidence(spark, d):
    r = _ranked(spark, d).select("incident_id", "metric", F.col("composite_score").alias("score"), F.col("causal_outflow").alias("agreement"), F.col("causal_inflow").alias("chain_quality"), (F.col("temporal_priority") > 0).alias("temporally_valid"), F.col("rank").alias("hours_since_deployment"))
    c, label = quality.adjusted_confidence()
    return r.select("incident_id", "metric", F.round(c, 6).alias("confidence"), label.alias("label"))


@query(f"WITH {S}, q(metric) AS (VALUES ('click'), ('view'), ('cpu'), ('disk')), m AS (SELECT e.entity, count(*) AS n, count(*) FILTER (p.metric IS NULL) AS missing FROM (SELECT DISTINCT entity FROM s) e CROSS JOIN q LEFT JOIN (SELECT DISTINCT entity, metric FROM s) p ON p.entity = e.entity AND p.metric = q.metric GROUP BY 1) SELECT entity, missing, CASE WHEN missing >= 5 THEN 0.30 WHEN missing >= 1 THEN 0.10 ELSE 0 END::DOUBLE AS penalty, missing <= 0.5 * n AS analysable FROM m")
def b22_missing_metric_penalty(spark, d):
    return quality.missing_metric_penalty(samples(spark, d), _rules(spark, [("click",), ("view",), ("cpu",), ("disk",)], "metric string"))


@query(f"""WITH {SERIES}, r AS (SELECT x.incident_id, x.metric AS cause, y.metric AS effect, k AS lag, corr(x.value, y.value) AS r FROM (SELECT unnest(generate_series(0, 4)) AS k) l, series x JOIN series y ON x.incident_id = y.incident_id AND x.metric <> y.metric AND x.pos + k = y.pos GROUP BY 1, 2, 3, 4)
SELECT incident_id, cause, effect, lag, round(r, 6) AS r, lag * 5 AS minutes FROM r QUALIFY row_number() OVER (PARTITION BY incident_id, cause, effect ORDER BY round(abs(r), 9) DESC, lag) = 1""")
def b23_lag_estimates(spark, d):
    got = causal.lag_estimates(series(spark, d), 4)
    return got.withColumns({"r": F.round("r", 6), "lag": F.col("lag").cast("long"), "minutes": F.col("minutes").cast("long")})


@query(f"WITH {S}, modes(mode, metric) AS (VALUES ('front', 'click'), ('front', 'view'), ('host', 'cpu'), ('host', 'click')), m AS (SELECT mode, bool_and(metric IN (SELECT metric FROM s)) AS covered, coalesce(string_agg(DISTINCT metric, ',' ORDER BY metric) FILTER (metric NOT IN (SELECT metric FROM s)), '') AS gaps FROM modes GROUP BY 1) SELECT *, (SELECT avg(covered::INT) * 100 FROM m) AS covered_pct FROM m")
def b24_coverage(spark, d):
    modes = _rules(spark, [("front", "click"), ("front", "view"), ("host", "cpu"), ("host", "click")], "mode string, metric string")
    return quality.coverage(modes, samples(spark, d))


@query(f"""WITH {GRID}, m AS (SELECT entity, metric, date_trunc('minute', ts) AS ts, value, seq, (hash(seq) % 1) AS z FROM s), st AS (SELECT entity, metric, avg(value) AS mean, stddev_samp(value) AS sd FROM m GROUP BY 1, 2), l AS (SELECT *, ts < lag(ts) OVER (PARTITION BY entity, metric ORDER BY seq % 1000, seq) AS late FROM m),
a AS (SELECT l.entity, l.metric, count(*) - count(DISTINCT ts) AS duplicates, count(*) FILTER (late) AS out_of_order, count(*) FILTER (abs(value - mean) > 5 * sd) AS beyond_5_sigma FROM l JOIN st USING (entity, metric) GROUP BY 1, 2),
g AS (SELECT entity, metric, round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) * 100, 6) AS missing_pct, max(pos) - max(CASE WHEN value IS NOT NULL THEN pos END) >= 12 AS disappeared FROM grid GROUP BY 1, 2) SELECT * FROM a JOIN g USING (entity, metric)""")
def b25_quality_report(spark, d):
    raw = samples(spark, d).withColumns({"ts": F.date_trunc("minute", "ts").cast("timestamp_ntz"), "arrived": (F.col("seq") % 1000) * 1000000000 + F.col("seq")})
    return quality.quality_report(raw, grid(spark, d), "arrived").withColumn("missing_pct", F.round("missing_pct", 6))


@query(f"WITH {FILLED}, st AS (SELECT entity, metric, avg(value) AS m, stddev_samp(value) AS sd FROM filled GROUP BY 1, 2) SELECT entity, metric, ts, round(CASE WHEN sd > 0 THEN (value - m) / sd ELSE 0 END, 6) AS value FROM filled JOIN st USING (entity, metric)")
def b26_zscore_normalise(spark, d):
    return quality.zscore_normalise(filled(spark, d)).select("entity", "metric", "ts", F.round("value", 6).alias("value"))


@query(f"""WITH {_RANKED}, e AS (SELECT incident_id, metric, concat_ws('; ', CASE WHEN causal_outflow > 0.5 THEN 'affects many downstream metrics' END, CASE WHEN temporal_priority > 0.7 THEN 'appeared early in the incident' END, CASE WHEN causal_inflow > 0.8 THEN 'has few upstream causes' END, CASE WHEN event_correlation > 0.5 THEN 'follows a recent event' END) AS x FROM factors)
SELECT incident_id, metric, CASE WHEN x = '' THEN 'moderate score over all factors' ELSE x END AS explanation FROM e""")
def b27_explain_candidate(spark, d):
    return _ranked(spark, d).select("incident_id", "metric", quality.explain_candidate().alias("explanation"))
