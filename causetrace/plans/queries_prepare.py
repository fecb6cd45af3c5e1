"""Registered queries of sources and preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from causetrace.functions.shared import new_path
from causetrace.operators import prepare
from causetrace.plans.registry import BINNED, DEPLOY, EDGES, FILL, FILLED, GRID, MARKS, NODES, PARTS, STEP, S, TOPOLOGY, binned, filled, grid, nodes, parts, query, samples, table, traces
from causetrace.plans.registry import deployments as deployment_rows
from causetrace.sources import events as ev
from causetrace.sources import logs, payloads, sinks

METRICS = ["click", "error", "purchase", "signup", "view"]
_OWN_GRID = """own AS (SELECT entity, metric, min(ts) AS lo, max(ts) AS hi FROM binned GROUP BY 1, 2), times AS (SELECT entity, metric, unnest(generate_series(lo, hi, INTERVAL '6 hours')) AS ts FROM own),
grid AS (SELECT t.entity, t.metric, t.ts, b.value, row_number() OVER (PARTITION BY t.entity, t.metric ORDER BY t.ts) - 1 AS pos FROM times t LEFT JOIN binned b USING (entity, metric, ts))"""
_LINEAR = FILL.replace("least(pos - pp, 6)", "(pos - pp)")
_EDGEFILL = "SELECT entity, metric, ts, round(coalesce(vp, vq, 0), 6) AS value FROM marks"


def _rounded(df):
    return df.select("entity", "metric", "ts", F.round("value", 6).alias("value"))


def _range_payloads(spark, d):
    """A payload for each service, event type and day."""
    e = samples(spark, d).withColumn("day", F.to_date("ts"))
    epoch = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    point = F.array(epoch.cast("string"), F.col("value").cast("string"))
    labels = F.create_map(F.lit("__name__"), F.concat(F.lit("svc."), F.col("metric")), F.lit("instance"), F.col("entity"))
    got = e.withColumns({"point": point}).groupBy("entity", "metric", "day").agg(F.collect_list("point").alias("values"))
    return got.select("entity", F.lit("q").alias("query"), F.array(F.struct(labels.alias("metric"), "values")).alias("result"), "day", F.col("metric").alias("__m"))


@query(f"""WITH {BINNED.replace("event_type AS metric", "'svc_' || event_type || '_instance_e' || (user_id // 75) AS metric")}, {_OWN_GRID}, {MARKS}, {_LINEAR}
SELECT entity, metric, ts, round(value, 6) AS value FROM filled""")
def s1_range_payload_to_metrics(spark, d):
    return _rounded(payloads.range_payload_to_metrics(_range_payloads(spark, d), STEP))


#: What is wrong with the payloads of a few days.
_BAD = "CASE WHEN day(ts) = 5 THEN 'not valid' WHEN day(ts) = 6 AND metric = 'click' THEN 'failed: overload' WHEN day(ts) = 7 AND metric = 'view' THEN 'empty' WHEN day(ts) = 8 AND metric = 'error' THEN 'no result' END"


def _bodies(rows, body):
    """Texts of payloads, some broken off, failed, empty or without a result; every second day a bare list."""
    day, metric = F.dayofmonth("day"), F.col("__m")
    text = F.when(day == 5, F.expr("left(body, length(body) - 3)")).when((day == 6) & (metric == "click"), '{"status": "error", "error": "overload", "Datapoint": 1}').when((day == 7) & (metric == "view"), " ")
    text = text.when((day == 8) & (metric == "error"), '{"status": "success"}').otherwise(F.col("body"))
    return rows.withColumn("body", body).withColumn("body", text)


def _range_texts(spark, d):
    p = _range_payloads(spark, d)
    whole = F.to_json(F.struct(F.lit("success").alias("status"), F.struct(F.lit("matrix").alias("resultType"), F.col("result")).alias("data")))
    return _bodies(p, F.when(F.dayofmonth("day") % 2 == 0, F.to_json("result")).otherwise(whole)).select("entity", "query", "body")


_KEPT = BINNED.replace("event_id AS seq FROM events", "event_id AS seq, " + _BAD.replace("metric", "event_type") + " AS bad FROM events").replace("FROM s GROUP", "FROM s WHERE bad IS NULL GROUP")


@query(f"""WITH {_KEPT.replace("event_type AS metric", "'svc_' || event_type || '_instance_e' || (user_id // 75) AS metric")}, {_OWN_GRID}, {MARKS}, {_LINEAR} SELECT entity, metric, ts, round(value, 6) AS value FROM filled""")
def s1_range_payload_text(spark, d):
    """From JSON texts; broken ones are left out."""
    return _rounded(payloads.range_payload_to_metrics(payloads.read_range_payloads(_range_texts(spark, d))[0], STEP))


@query(f"WITH b AS (SELECT DISTINCT 'e' || (user_id // 75) AS entity, event_type AS metric, ts::DATE AS day, {_BAD.replace('metric', 'event_type')} AS reason FROM events) SELECT entity, reason, count(*) AS payloads FROM b WHERE reason IS NOT NULL GROUP BY 1, 2")
def s1_rejected_payloads(spark, d):
    return payloads.read_range_payloads(_range_texts(spark, d))[1].groupBy("entity", "reason").agg(F.count(F.lit(1)).alias("payloads"))


@query(f"""WITH {S}, v AS (SELECT entity, metric, var_samp(value) AS v FROM s GROUP BY 1, 2), top AS (SELECT entity, metric FROM v QUALIFY row_number() OVER (PARTITION BY entity ORDER BY v DESC, metric) <= 3),
binned AS (SELECT entity, metric, time_bucket(INTERVAL '6 hours', ts) AS ts, avg(value) AS value FROM s SEMI JOIN top USING (entity, metric) GROUP BY ALL),
{GRID.split(", ", 2)[2].split("GROUP BY ALL), ", 1)[1]}, {MARKS} {_EDGEFILL}""")
def s2_merge_queries(spark, d):
    raw = samples(spark, d).withColumn("query", F.lit("q"))
    top = payloads.merge_queries(raw.withColumn("ts", F.window("ts", STEP)["start"]), STEP, 3)
    return _rounded(top)


def _datapoints(spark, d):
    e = samples(spark, d).withColumn("day", F.to_date("ts"))
    point = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("Timestamp"), F.col("value").alias("Average"), F.lit(0.0).alias("Sum"))
    rows = e.withColumn("p", point).groupBy("entity", "metric", "day").agg(F.collect_list("p").alias("Datapoints"))
    return rows.select("entity", F.lit("fleet/svc").alias("namespace"), F.array(F.struct(F.lit("type").alias("Name"), F.col("metric").alias("Value"))).alias("dimensions"), "Datapoints", "day", F.col("metric").alias("__m"))


@query(f"""WITH {BINNED.replace("event_type AS metric", "'fleet_svc_metric_' || event_type AS metric")}, {_OWN_GRID}, {MARKS}, {_LINEAR} SELECT entity, metric, ts, round(value, 6) AS value FROM filled""")
def s3_datapoints_to_metrics(spark, d):
    return _rounded(payloads.datapoints_to_metrics(_datapoints(spark, d), 6 * 3600))


@query(f"""WITH {_KEPT.replace("event_type AS metric", "'fleet_svc_metric_' || event_type AS metric")}, {_OWN_GRID}, {MARKS}, {_LINEAR} SELECT entity, metric, ts, round(value, 6) AS value FROM filled""")
def s3_datapoints_text(spark, d):
    """From JSON texts; broken ones are left out."""
    texts = _bodies(_datapoints(spark, d), F.to_json(F.struct(F.lit("load").alias("Label"), "Datapoints"))).select("entity", "namespace", "dimensions", "body")
    return _rounded(payloads.datapoints_to_metrics(payloads.read_datapoint_payloads(texts)[0], 6 * 3600))


@query(f"WITH {GRID}, {MARKS} {_EDGEFILL}")
def s4_merge_series(spark, d):
    return _rounded(payloads.merge_series(binned(spark, d), STEP))


def _json_lines(spark, d):
    e = samples(spark, d)
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    level = F.when(F.col("metric") == "error", "error").when(F.col("metric") == "view", "warning").otherwise("info")
    a = F.to_json(F.struct(stamp.alias("timestamp"), level.alias("level"), F.col("metric").alias("message")))
    b = F.to_json(F.struct(stamp.alias("@timestamp"), level.alias("log.level"), F.col("metric").alias("msg")))
    c = F.to_json(F.struct(F.lit("").alias("time"), stamp.alias("ts"), level.alias("severity")))
    line = F.when(F.col("seq") % 11 == 0, "not json").when(F.col("seq") % 7 == 0, c).when(F.col("seq") % 2 == 0, a).otherwise(b)
    return e.select("entity", "seq", line.alias("line"))


_LEVELS = """CASE WHEN metric = 'error' THEN 'ERROR' WHEN metric = 'view' THEN 'WARN' ELSE 'INFO' END"""


@query(f"WITH {S} SELECT entity, seq, date_trunc('second', ts) AS ts, {_LEVELS} AS level, metric AS message FROM s WHERE seq % 11 <> 0 AND seq % 7 <> 0")
def s5_parse_json_logs(spark, d):
    return logs.parse_json_logs(_json_lines(spark, d)).select("entity", "seq", "ts", "level", "message")


@query(f"""WITH {S} SELECT entity, seq, date_trunc('second', ts) AS ts, CASE WHEN metric = 'error' THEN 'ERROR' WHEN metric = 'view' THEN 'WARN' WHEN metric = 'click' THEN 'DEBUG' ELSE 'INFO' END AS level FROM s WHERE seq % 5 <> 0""")
def s6_parse_text_logs(spark, d):
    e = samples(spark, d)
    word = F.when(F.col("metric") == "error", "Error").when(F.col("metric") == "view", "warning").when(F.col("metric") == "click", "DEBUG").otherwise("")
    syslog = F.concat(F.date_format("ts", "MMM d HH:mm:ss"), F.lit(" host1 app[3]: "), word, F.lit(" happened"))
    iso = F.concat(F.lit("at "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" "), word, F.lit(" happened"))
    line = F.when(F.col("seq") % 5 == 0, F.concat(word, F.lit(" without a time"))).when(F.col("seq") % 2 == 0, syslog).otherwise(iso)
    return logs.parse_text_logs(e.select("entity", "seq", line.alias("line")), 2024).select("entity", "seq", "ts", "level")


_BINS = f"""l AS (SELECT entity, time_bucket(INTERVAL '30 minutes', ts) AS ts, metric FROM s), c AS (SELECT entity, ts, count(*) FILTER (metric = 'error') AS log_error_count, count(*) FILTER (metric = 'view') AS log_warn_count,
count(*) FILTER (metric NOT IN ('error', 'view')) AS log_info_count FROM l GROUP BY 1, 2), b AS (SELECT entity, unnest(generate_series(min(ts), max(ts), INTERVAL '30 minutes')) AS ts FROM l GROUP BY 1),
counts AS (SELECT entity, ts, coalesce(log_error_count, 0) AS log_error_count, coalesce(log_warn_count, 0) AS log_warn_count, coalesce(log_info_count, 0) AS log_info_count,
coalesce(log_error_count, 0) + coalesce(log_warn_count, 0) + coalesce(log_info_count, 0) AS log_total_volume FROM b LEFT JOIN c USING (entity, ts))"""


def _level_rows(spark, d):
    level = F.when(F.col("metric") == "error", "ERROR").when(F.col("metric") == "view", "WARN").otherwise("INFO")
    return samples(spark, d).select("entity", "ts", level.alias("level"))


@query(f"WITH {S}, {_BINS} SELECT * FROM counts")
def s7_bin_log_levels(spark, d):
    return logs.bin_log_levels(_level_rows(spark, d), "30 minutes")


@query(f"""WITH {BINNED}, {_BINS.replace("30 minutes", "6 hours")} SELECT m.entity, m.metric, m.ts, round(m.value, 6) AS value, coalesce(log_error_count, 0) AS log_error_count, coalesce(log_warn_count, 0) AS log_warn_count,
coalesce(log_info_count, 0) AS log_info_count, coalesce(log_total_volume, 0) AS log_total_volume FROM binned m LEFT JOIN counts USING (entity, ts)""")
def s8_merge_logs_with_metrics(spark, d):
    got = logs.merge_logs_with_metrics(binned(spark, d), logs.bin_log_levels(_level_rows(spark, d), STEP))
    return got.withColumn("value", F.round("value", 6))


@query("""WITH e AS (SELECT event_id, ts, event_id % 6 AS k FROM events) SELECT event_id, ts, CASE k WHEN 0 THEN 'Successful ''Build'' deployment on shop' WHEN 1 THEN 'Successful ''Deploy'' deployment on unknown_repo'
WHEN 3 THEN 'manual ' || event_id WHEN 4 THEN 'scaled' ELSE 'Unknown deployment event' END AS description, CASE k WHEN 4 THEN 'config' ELSE 'deployment' END AS type FROM e""")
def s9_webhook_payload_to_event(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("arrived"), (F.col("event_id") % 6).alias("k"))
    text = (
        F.when(F.col("k") == 0, '{"action":"completed","workflow_run":{"conclusion":"success","name":"Build"},"repository":{"name":"shop"}}')
        .when(F.col("k") == 1, '{"action":"completed","workflow_run":{"conclusion":"success"}}')
        .when(F.col("k") == 2, '{"action":"completed","workflow_run":{"conclusion":"failure","name":"Build"},"message":"kept out"}')
        .when(F.col("k") == 3, F.concat(F.lit('{"message":"manual '), F.col("event_id").cast("string"), F.lit('"}')))
        .when(F.col("k") == 4, '{"message":"scaled","type":"config"}')
        .otherwise("{}")
    )
    return ev.webhook_payload_to_event(e.select("event_id", "arrived", text.alias("payload")))


@query(f"WITH {DEPLOY} SELECT entity, date_trunc('second', ts) AS ts, description, type FROM deployments WHERE date_trunc('second', ts) >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY")
def s10_load_events(spark, d):
    lines = deployment_rows(spark, d).select("entity", F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "description", "type")).alias("line"))
    path = new_path(spark, "events")
    lines.select(F.regexp_replace("line", r'"description":"', F.concat(F.lit('"description":"'), F.col("entity"), F.lit(" "))).alias("value")).write.text(path)
    got = ev.load_events(spark, path, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    return got.select(F.substring_index("description", " ", 1).alias("entity"), "ts", F.expr("substring(description, instr(description, ' ') + 1)").alias("description"), "type")


@query(f"WITH {TOPOLOGY} SELECT src, dst, weight, round(avg_latency_ms, 6) AS avg_latency_ms FROM topology")
def s11_traces_to_topology(spark, d):
    return ev.traces_to_topology(traces(spark, d)).withColumn("avg_latency_ms", F.round("avg_latency_ms", 6))


@query(f"WITH {EDGES}{NODES} SELECT incident_id, metric, anomaly_score FROM nodes")
def s13_rankings_csv(spark, d):
    return _through_csv(spark, nodes(spark, d), "incident_id string, metric string, anomaly_score double")


@query(f"WITH {BINNED} SELECT entity, metric, ts, round(value, 6) AS value FROM binned")
def s14_metrics_csv(spark, d):
    return _through_csv(spark, _rounded(binned(spark, d)), "entity string, metric string, ts timestamp_ntz, value double")


def _through_csv(spark, rows, schema):
    """What the CSV sink wrote, read back."""
    path = new_path(spark, "csv")
    sinks.write_csv(rows, path)
    return spark.read.schema(schema).option("header", True).csv(path)


@query(f"WITH {S}, m AS (SELECT *, date_trunc('minute', ts) AS t FROM s) SELECT entity, metric, t AS ts, value, seq FROM m QUALIFY row_number() OVER (PARTITION BY entity, metric, t ORDER BY seq DESC) = 1")
def p1_dedupe_keep_last(spark, d):
    return prepare.dedupe_keep_last(samples(spark, d).withColumn("ts", F.date_trunc("minute", "ts").cast("timestamp_ntz"))).select("entity", "metric", "ts", "value", "seq")


@query(f"WITH {GRID} SELECT entity, metric, ts, pos, round(value, 6) AS value FROM grid")
def p2_reindex_grid(spark, d):
    return grid(spark, d).withColumn("value", F.round("value", 6))


@query(f"WITH {GRID.replace('6 hours', '1 hours')}, keep AS (SELECT entity, metric FROM grid GROUP BY 1, 2 HAVING avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) <= 0.5) SELECT entity, metric, count(value) AS known FROM grid SEMI JOIN keep USING (entity, metric) GROUP BY 1, 2")
def p3_drop_sparse_metrics(spark, d):
    hourly = prepare.reindex_grid(prepare.bin_mean(samples(spark, d), "1 hours"), "1 hours")
    return prepare.drop_sparse_metrics(hourly).groupBy("entity", "metric").agg(F.count("value").alias("known"))


@query(f"WITH {GRID.replace('6 hours', '1 hours')}, {MARKS}, {FILL} SELECT entity, metric, ts, pos, round(value, 6) AS value FROM filled")
def p4_fill_gaps(spark, d):
    hourly = prepare.reindex_grid(prepare.bin_mean(samples(spark, d), "1 hours"), "1 hours")
    return prepare.fill_gaps(hourly).withColumn("value", F.round("value", 6))


_CAPPED = "st AS (SELECT entity, metric, avg(value) AS m, stddev_samp(value) AS sd FROM filled GROUP BY 1, 2), capped AS (SELECT f.entity, f.metric, f.ts, CASE WHEN sd > 0 THEN greatest(least(value, m + {z} * sd), m - {z} * sd) ELSE value END AS value FROM filled f JOIN st USING (entity, metric))"


@query(f"WITH {FILLED}, {_CAPPED.replace('{z}', '1.5')} SELECT entity, metric, ts, round(value, 6) AS value FROM capped")
def p5_cap_outliers(spark, d):
    return _rounded(prepare.cap_outliers(filled(spark, d), 1.5))


_LAST = "binned AS (SELECT entity, metric, time_bucket(INTERVAL '6 hours', ts) AS ts, value FROM s QUALIFY row_number() OVER (PARTITION BY entity, metric, time_bucket(INTERVAL '6 hours', ts) ORDER BY seq DESC) = 1)"


@query(f"""WITH {S}, {_LAST}, {GRID.split("GROUP BY ALL), ", 1)[1].replace("grid AS (SELECT t", "grid0 AS (SELECT t")}, keep AS (SELECT entity, metric FROM grid0 GROUP BY 1, 2 HAVING avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) <= 0.5),
grid AS (SELECT * FROM grid0 SEMI JOIN keep USING (entity, metric)), {MARKS}, {FILL}, {_CAPPED.replace("{z}", "5")} SELECT entity, metric, ts, round(value, 6) AS value FROM capped""")
def p6_clean_and_impute(spark, d):
    raw = samples(spark, d).withColumn("ts", F.window("ts", STEP)["start"])
    return _rounded(prepare.clean_and_impute(raw, STEP))


@query(f"WITH {BINNED}, {_OWN_GRID} SELECT entity, metric, ts, round(value, 6) AS value FROM grid")
def p7_resample_mean(spark, d):
    return _rounded(prepare.resample_mean(samples(spark, d), STEP))


@query(f"WITH {BINNED} SELECT entity, ts, " + ", ".join(f"round(max(value) FILTER (metric = '{m}'), 6) AS {m}" for m in METRICS) + " FROM binned GROUP BY 1, 2")
def p8_to_wide(spark, d):
    wide = prepare.to_wide(binned(spark, d), METRICS)
    return wide.select("entity", "ts", *[F.round(m, 6).alias(m) for m in METRICS])


@query(f"WITH {BINNED} SELECT entity, metric, ts, round(value, 6) AS value FROM binned")
def p8_to_long(spark, d):
    return _rounded(prepare.to_long(prepare.to_wide(binned(spark, d), METRICS), METRICS))


@query(f"""WITH {PARTS}, b AS (SELECT entity, metric, min(value) AS lo, max(value) AS hi FROM normal GROUP BY 1, 2),
open AS (SELECT g.entity, g.metric, g.ts, g.value FROM grid g JOIN halves h USING (entity, metric, ts) WHERE NOT h.is_normal),
told AS (SELECT entity, metric, ts, coalesce(last_value(value IGNORE NULLS) OVER p, first_value(value IGNORE NULLS) OVER q) AS value FROM open
WINDOW p AS (PARTITION BY entity, metric ORDER BY ts ROWS UNBOUNDED PRECEDING), q AS (PARTITION BY entity, metric ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT entity, metric, ts, CASE WHEN value IS NOT NULL THEN round(greatest(least((value - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 1), 0), 6) END AS value FROM told JOIN b USING (entity, metric)""")
def p9_minmax(spark, d):
    """The incident with its gaps, filled and scaled to the range of the normal part."""
    normal, _ = parts(spark, d)
    incident = grid(spark, d).withColumn("__n", prepare.split_normal(F.col("pos"))).where("not __n")
    return _rounded(prepare.apply_minmax(prepare.fill_incident(incident), prepare.fit_minmax(normal)))


_WINDOWS = "w AS (SELECT entity, metric, ts, pos, count(*) OVER f AS n, sum(value) OVER f AS total FROM filled WINDOW f AS (PARTITION BY entity, metric ORDER BY ts ROWS 11 PRECEDING)), win AS (SELECT entity, metric, ts, (pos - 11) // 5 AS k, total FROM w WHERE n = 12 AND (pos - 11) % 5 = 0)"


@query(f"WITH {FILLED}, {_WINDOWS} SELECT entity, metric, ts, k, 12 AS size, round(total, 4) AS total FROM win")
def p10_sliding_windows(spark, d):
    w = prepare.sliding_windows(filled(spark, d), 12, 5)
    return w.select("entity", "metric", "ts", "k", F.size("values").alias("size"), F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query(f"WITH {FILLED}, {_WINDOWS} SELECT entity, metric, ts, k, CASE WHEN row_number() OVER (PARTITION BY entity, metric ORDER BY ts) <= floor(count(*) OVER (PARTITION BY entity, metric) * 0.8) THEN 'train' ELSE 'validation' END AS part FROM win")
def p11_time_split(spark, d):
    return prepare.time_split(prepare.sliding_windows(filled(spark, d), 12, 5)).select("entity", "metric", "ts", "k", "part")


@query(f"WITH {FILLED}, v AS (SELECT entity, metric, var_samp(value) AS v FROM filled GROUP BY 1, 2) SELECT f.entity, f.metric, count(*) AS n FROM filled f JOIN v USING (entity, metric) WHERE v >= 150 GROUP BY 1, 2")
def p12_drop_low_variance(spark, d):
    return prepare.drop_low_variance(filled(spark, d), 150.0).groupBy("entity", "metric").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {FILLED}, r AS (SELECT entity, metric, ts, rank() OVER (PARTITION BY entity, metric ORDER BY value) + (count(*) OVER (PARTITION BY entity, metric, value) - 1) / 2.0 AS r FROM filled)
SELECT x.entity, x.metric AS a, y.metric AS b, round(abs(coalesce(corr(x.r, y.r), 0)), 6) AS r FROM r x JOIN r y ON x.entity = y.entity AND x.ts = y.ts AND x.metric < y.metric GROUP BY 1, 2, 3""")
def p13_spearman_matrix(spark, d):
    return prepare.spearman_matrix(filled(spark, d)).withColumn("r", F.round("r", 6))


@query()
def p14_group_correlated(spark, d):
    return prepare.group_correlated(filled(spark, d), 0.1)


@query(f"""WITH {FILLED}, v AS (SELECT entity, metric, substr(metric, 1, 1) < 'f' AS g, var_samp(value) AS v FROM filled GROUP BY 1, 2, 3)
SELECT entity, arg_min(metric, (-v, metric)) AS representative, string_agg(metric, ',' ORDER BY metric) AS members FROM v GROUP BY entity, g""")
def p15_pick_representative(spark, d):
    f = filled(spark, d)
    groups = f.select("entity", "metric", (F.substring("metric", 1, 1) < "f").cast("string").alias("group")).distinct()
    return prepare.pick_representative(f, groups).withColumn("members", F.array_join("members", ","))


@query()
def p16_reduce_dimensions(spark, d):
    return prepare.reduce_dimensions(filled(spark, d), 1e-5, 0.1)


@query(f"WITH {GRID.replace('6 hours', '1 hours')}, m AS (SELECT entity, metric, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS m FROM grid GROUP BY 1, 2) SELECT entity, metric, round(m * 100, 6) AS missing_pct, round(avg(m) OVER (PARTITION BY entity) * 100, 6) AS mean_missing_pct FROM m")
def p17_missingness_stats(spark, d):
    hourly = prepare.reindex_grid(prepare.bin_mean(samples(spark, d), "1 hours"), "1 hours")
    return prepare.missingness_stats(hourly).select("entity", "metric", F.round("missing_pct", 6).alias("missing_pct"), F.round("mean_missing_pct", 6).alias("mean_missing_pct"))
