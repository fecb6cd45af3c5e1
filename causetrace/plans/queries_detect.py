"""Registered queries of detection and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from causetrace.functions.shared import new_path, settled
from causetrace.operators import detect
from causetrace.plans.registry import BASE, FILLED, INCIDENTS, MAJOR, S, STAT, entity, filled, incidents, major_releases, parts, query, scored, settled_filled
from causetrace.plans.queries_prepare import METRICS
from causetrace.streaming.damping import stream_dampen_alerts, use_rocksdb
from causetrace.streaming.twins import stream_log_counts

_SPIKE = """d0 AS (SELECT *, value - lag(value) OVER (PARTITION BY entity, metric ORDER BY ts) AS r FROM filled), d1 AS (SELECT *, CASE WHEN count(r) OVER f >= 3 THEN stddev_samp(r) OVER f END AS sd FROM d0 WINDOW f AS (PARTITION BY entity, metric ORDER BY ts ROWS 11 PRECEDING)),
d2 AS (SELECT *, first_value(sd IGNORE NULLS) OVER (PARTITION BY entity, metric ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS s2 FROM d1),
spike AS (SELECT entity, metric, ts, pos, value, CASE WHEN r IS NULL OR s2 IS NULL THEN 0 ELSE least(abs(r) / (3 * CASE WHEN s2 = 0 THEN 1e-8 ELSE s2 END), 1) END AS spike FROM d2),
temporal AS (SELECT entity, metric, ts, pos, spike, CASE WHEN count(*) OVER f < 12 OR max(value) OVER f = min(value) OVER f THEN 0 ELSE regr_r2(value, pos) OVER f END AS trend FROM spike WINDOW f AS (PARTITION BY entity, metric ORDER BY ts ROWS 11 PRECEDING))"""
_FLAGS = "flags AS (SELECT entity, metric, ts, pos, value > 55 AS is_anomaly FROM filled)"


def _r(df, *cols):
    return df.select("entity", "metric", "ts", *[F.round(c, 6).alias(c) for c in cols])


def _model(spark, d):
    normal, _ = parts(spark, d)
    return detect.fit_reconstruction_model(normal, METRICS)


@query()
def d1_fit_reconstruction_model(spark, d):
    """The model's mean and first loading of every window place, scored on the incident part."""
    m = _model(spark, d)
    _, incident = parts(spark, d)
    return detect.reconstruction_error(incident, m).groupBy("metric").agg(F.round(F.avg("score"), 4).alias("mean_error"), F.count(F.lit(1)).alias("windows"))


@query()
def d2_reconstruction_error(spark, d):
    _, incident = parts(spark, d)
    return _r(detect.reconstruction_error(incident, _model(spark, d)), "score")


@query(f"WITH {STAT} SELECT entity, metric, round(quantile_cont(score, 0.99), 6) AS threshold FROM stat GROUP BY 1, 2")
def d3_calibrate_thresholds(spark, d):
    return detect.calibrate_thresholds(scored(spark, d)).withColumn("threshold", F.round("threshold", 6))


@query(f"WITH {STAT}, t AS (SELECT entity, metric, quantile_cont(score, 0.9) AS threshold FROM stat GROUP BY 1, 2) SELECT entity, metric, ts, round(score / (threshold + 1e-8), 6) AS score, score > threshold AS is_anomaly FROM stat JOIN t USING (entity, metric)")
def d4_flag_scores(spark, d):
    s = scored(spark, d)
    return detect.flag_scores(s, detect.calibrate_thresholds(s, 90.0)).withColumn("score", F.round("score", 6))


@query(f"WITH {BASE} SELECT entity, metric, round(med, 6) AS median, round(mad, 6) AS mad, round(mean, 6) AS mean, round(std, 6) AS std, round(q1, 6) AS q1, round(q3, 6) AS q3 FROM base")
def d5_fit_baselines(spark, d):
    b = detect.fit_baselines(parts(spark, d)[0])
    return b.select("entity", "metric", *[F.round(c, 6).alias(c) for c in ("median", "mad", "mean", "std", "q1", "q3")])


@query(f"WITH {STAT} SELECT entity, metric, ts, round(zscore, 6) AS zscore FROM stat")
def d6_zscore_anomaly(spark, d):
    return _r(scored(spark, d), "zscore")


@query(f"WITH {STAT} SELECT entity, metric, ts, round(mad_score, 6) AS mad_score FROM stat")
def d7_mad_anomaly(spark, d):
    return _r(scored(spark, d), "mad_score")


@query(f"WITH {STAT} SELECT entity, metric, ts, round(iqr_score, 6) AS iqr_score FROM stat")
def d8_iqr_anomaly(spark, d):
    return _r(scored(spark, d), "iqr_score")


@query(f"WITH {STAT} SELECT entity, metric, ts, score AS stat FROM stat")
def d9_statistical_score(spark, d):
    return _r(scored(spark, d), "stat")


@query(f"WITH {FILLED}, {_SPIKE} SELECT entity, metric, ts, round(spike, 6) AS spike FROM spike")
def d10_spike_score(spark, d):
    return _r(detect.spike_score(filled(spark, d)), "spike")


@query(f"WITH {FILLED}, {_SPIKE} SELECT entity, metric, ts, round(trend, 6) AS trend FROM temporal")
def d11_trend_r2(spark, d):
    return _r(detect.trend_r2(filled(spark, d)), "trend")


@query(f"WITH {FILLED}, {_SPIKE} SELECT entity, metric, ts, round(greatest(spike, trend), 6) AS temporal FROM temporal")
def d12_temporal_score(spark, d):
    return _r(detect.temporal_scores(filled(spark, d)), "temporal")


_ENSEMBLE = f"""{STAT}, {_SPIKE}, e AS (SELECT s.entity, s.metric, s.ts, greatest(least(s.zscore, 1.5), 0) / 1.5 AS l, s.stat, greatest(t.spike, t.trend) AS temporal FROM stat s JOIN temporal t USING (entity, metric, ts)),
ens AS (SELECT *, 0.40 * l + 0.35 * stat + 0.25 * temporal AS ensemble, (l > 0.6)::INT + (stat > 0.6)::INT + (temporal > 0.6)::INT AS votes FROM e)"""


def _ensemble(spark, d):
    """The z-score stands for the reconstruction score, so that SQL can follow."""
    s = scored(spark, d)
    rec = s.select("entity", "metric", "ts", F.col("zscore").alias("score"))
    return detect.ensemble_scores(rec, s, detect.temporal_scores(filled(spark, d)))


@query(f"WITH {_ENSEMBLE} SELECT entity, metric, ts, round(ensemble, 6) AS ensemble FROM ens")
def d13_ensemble_score(spark, d):
    return _r(_ensemble(spark, d), "ensemble")


@query(f"WITH {_ENSEMBLE} SELECT entity, metric, ts, CASE votes WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END AS confidence FROM ens")
def d14_agreement_confidence(spark, d):
    return _ensemble(spark, d).select("entity", "metric", "ts", "confidence")


@query(f"WITH {_ENSEMBLE} SELECT entity, metric, ts, l > 0.5 AS is_anomaly FROM ens")
def d15_ensemble_flag(spark, d):
    return _ensemble(spark, d).select("entity", "metric", "ts", "is_anomaly")


@query(f"WITH {INCIDENTS} SELECT * FROM incidents")
def d16_summarise_incident(spark, d):
    return incidents(spark, d)


def _flags(spark, d):
    return filled(spark, d).select("entity", "metric", "ts", (F.col("value") > 55).alias("is_anomaly"))


_FOLD = f"""{FILLED.replace("WITH ", "")}, {_FLAGS}, steps AS (SELECT entity, metric, 0::BIGINT AS pos, CASE WHEN is_anomaly THEN 1 ELSE 0 END AS run, 0 AS wait, false AS hard FROM flags WHERE pos = 0
UNION ALL SELECT f.entity, f.metric, f.pos, CASE WHEN s.wait > 0 OR NOT f.is_anomaly THEN 0 WHEN s.run + 1 >= 2 THEN 0 ELSE s.run + 1 END, CASE WHEN s.wait > 0 THEN s.wait - 1 WHEN f.is_anomaly AND s.run + 1 >= 2 THEN 6 ELSE 0 END,
s.wait = 0 AND f.is_anomaly AND s.run + 1 >= 2 FROM steps s JOIN flags f ON f.entity = s.entity AND f.metric = s.metric AND f.pos = s.pos + 1)"""


@query(f"WITH RECURSIVE {_FOLD} SELECT f.entity, f.metric, f.ts, f.is_anomaly, s.hard AS hard_alert FROM flags f JOIN steps s USING (entity, metric, pos)")
def d17_dampen_alerts(spark, d):
    return detect.dampen_alerts(_flags(spark, d), 2, 6)


@query(f"WITH RECURSIVE {_FOLD} SELECT entity, metric, CAST(sum(f.is_anomaly::INT) AS BIGINT) AS raw_flags, CAST(sum(s.hard::INT) AS BIGINT) AS hard_alerts FROM flags f JOIN steps s USING (entity, metric, pos) GROUP BY 1, 2")
def d18_dampening_stats(spark, d):
    return detect.dampening_stats(detect.dampen_alerts(_flags(spark, d), 2, 6))


@query(f"WITH {MAJOR} SELECT entity, max(ts) AS deployed, max(ts) <= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 2 HOUR AS due FROM deployments WHERE ts <= TIMESTAMP '2024-01-20 12:00:00' AND ts >= TIMESTAMP '2024-01-19 12:00:00' GROUP BY 1")
def d19_rebaseline_due(spark, d):
    return detect.rebaseline_due(major_releases(spark, d), F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"))


@query(f"""WITH {FILLED}, {MAJOR}, due AS (SELECT entity, max(ts) AS deployed FROM deployments WHERE ts <= TIMESTAMP '2024-01-20 12:00:00' AND ts >= TIMESTAMP '2024-01-19 12:00:00' GROUP BY 1 HAVING max(ts) <= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 2 HOUR)
SELECT entity, metric, round(median(value), 6) AS median, round(avg(value), 6) AS mean, round(min(value), 6) AS lo, round(max(value), 6) AS hi FROM filled JOIN due USING (entity) WHERE ts >= deployed GROUP BY 1, 2""")
def d20_rebaseline(spark, d):
    due = detect.rebaseline_due(major_releases(spark, d), F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"))
    base, bounds = detect.rebaseline(filled(spark, d), due)
    return base.join(bounds, ["entity", "metric"]).select("entity", "metric", *[F.round(c, 6).alias(c) for c in ("median", "mean", "lo", "hi")])


@query()
def d20_rebaseline_model(spark, d):
    """Models of the services that are due, refitted from kept daily states: how many directions each has, and the thresholds from the windows held out."""
    rows = settled_filled(spark, d)
    due = detect.rebaseline_due(major_releases(spark, d), F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"))
    states = settled(detect.daily_states(rows, METRICS, stride=1), "states")
    models, thresholds, _ = detect.rebaseline_model(rows, due, states, METRICS, stride=1)
    known = models.select("entity", F.size("components").alias("components"))
    return thresholds.join(known, "entity").select("entity", "metric", "components", F.round("threshold", 6).alias("threshold"))


def _drained(spark, stream, mode):
    """A stream over the files that are there, run to its end; state, offsets and results lie in the shared folder.

    Each batch has a folder of its own, which a repeated batch writes again; in complete mode the last batch is the whole result.
    """
    out, batches = new_path(spark, "stream"), []

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        batches.append(number)

    q = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", new_path(spark, "offsets")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(stream.schema)
    return rows.parquet(f"{out}/batch={batches[-1]}") if mode == "complete" else rows.option("basePath", out).parquet(out).select(*stream.columns)


def _events_stream(spark, d):
    path = f"{d}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "events.parquet").parquet(d)


_T1 = f"""WITH {S} SELECT entity, time_bucket(INTERVAL '6 hours', ts) AS ts, count(*) FILTER (metric = 'error') AS log_error_count, count(*) FILTER (metric = 'view') AS log_warn_count, count(*) FILTER (metric NOT IN ('error', 'view')) AS log_info_count, count(*) AS log_total_volume FROM s GROUP BY 1, 2"""


def _log_counts(spark, d, mode):
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "view", "WARN").otherwise("INFO")
    rows = _events_stream(spark, d).select(entity().alias("entity"), "ts", level.alias("level"))
    return _drained(spark, stream_log_counts(rows, "6 hours"), mode).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(_T1)
def t1_stream_log_counts(spark, d):
    """In complete mode, so that the newest bins show as well."""
    return _log_counts(spark, d, "complete")


@query(f"SELECT * FROM ({_T1}) WHERE ts + INTERVAL '6 hours' <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL '10 minutes' FROM events)")
def t1_stream_final_counts(spark, d):
    """In append mode: the bins that the watermark has passed, once each."""
    return _log_counts(spark, d, "append")


_T2 = """o AS (SELECT 'e' || (user_id // 75) AS entity, event_type AS metric, ts, value > 40 AS is_anomaly, row_number() OVER (PARTITION BY user_id // 75, event_type ORDER BY ts, event_id) - 1 AS pos FROM events),
steps AS (SELECT entity, metric, 0::BIGINT AS pos, CASE WHEN is_anomaly THEN 1 ELSE 0 END AS run, 0 AS wait, false AS hard FROM o WHERE pos = 0
UNION ALL SELECT f.entity, f.metric, f.pos, CASE WHEN s.wait > 0 OR NOT f.is_anomaly THEN 0 WHEN s.run + 1 >= 3 THEN 0 ELSE s.run + 1 END, CASE WHEN s.wait > 0 THEN s.wait - 1 WHEN f.is_anomaly AND s.run + 1 >= 3 THEN 6 ELSE 0 END,
s.wait = 0 AND f.is_anomaly AND s.run + 1 >= 3 FROM steps s JOIN o f ON f.entity = s.entity AND f.metric = s.metric AND f.pos = s.pos + 1)"""


_T2_ALERTS = f"WITH RECURSIVE {_T2} SELECT entity, metric, ts FROM o JOIN steps USING (entity, metric, pos) WHERE hard"


def _damped(spark, d, delay):
    use_rocksdb(spark)
    rows = _events_stream(spark, d).select(entity().alias("entity"), F.col("event_type").alias("metric"), "ts", F.col("event_id").alias("seq"), (F.col("value") > 40).alias("is_anomaly"))
    return _drained(spark, stream_dampen_alerts(rows, delay=delay), "append").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(_T2_ALERTS)
def t2_stream_dampen_alerts(spark, d):
    """Without a delay the watermark passes every row."""
    return _damped(spark, d, "0 seconds")


@query(f"SELECT * FROM ({_T2_ALERTS}) WHERE ts < (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL '12 hours' + INTERVAL '1 millisecond' FROM events)")
def t2_stream_final_alerts(spark, d):
    """With a delay of half a day: the alerts that no later row can change."""
    return _damped(spark, d, "12 hours")
