"""Metric payloads of monitoring servers as long metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causetrace.operators.prepare import fill_edges, resample_mean

_RESULT = "array<struct<metric: map<string,string>, values: array<array<string>>>>"
RANGE_SCHEMA = f"status string, error string, data struct<resultType: string, result: {_RESULT}>, _broken string"
DATAPOINT_SCHEMA = "Label string, Datapoints array<struct<Timestamp: string, Average: double, Sum: double, Minimum: double, Maximum: double, SampleCount: double>>, _broken string"


def _read(texts: DataFrame, body: Column, schema: str, reason: Column, *columns: Column) -> tuple[DataFrame, DataFrame]:
    """(payloads, rejects) of ``texts``: the columns of what was read, or the row as it came with a ``reason``."""
    names = [F.col(c) for c in texts.columns]
    read = texts.withColumn("__j", F.from_json(body, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    read = read.withColumn("__why", F.when(F.col("body").isNull() | (F.trim("body") == ""), "empty").when(F.col("__j").isNull() | F.col("__j._broken").isNotNull(), "not valid").otherwise(reason))
    kept = [c for c in texts.columns if c != "body"]
    return read.where("__why is null").select(*kept, *columns), read.where("__why is not null").select(*names, F.col("__why").alias("reason"))


def read_range_payloads(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S1's reader: (payloads, rejects) of the JSON texts in ``body`` of ``texts(entity, query, body)``: whole answers of a range query, or their bare list of series.

    Payloads are ``entity, query, result``. A text that is empty, breaks off, has values of other types, reports an error or lacks its result is a reject: the row and its ``reason``. Label order is kept.
    """
    bare = F.ltrim("body").startswith("[")
    body = F.when(bare, F.concat(F.lit('{"status":"success","data":{"result":'), F.col("body"), F.lit("}}"))).otherwise(F.col("body"))
    failed = F.when(F.coalesce(F.col("__j.status"), F.lit("")) != "success", F.concat(F.lit("failed: "), F.coalesce("__j.error", "__j.status", F.lit("no status"))))
    reason = failed.when(F.col("__j.data.result").isNull(), "no result")
    return _read(texts, body, RANGE_SCHEMA, reason, F.col("__j.data.result").alias("result"))


def read_datapoint_payloads(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S3's reader: (payloads, rejects) of the JSON texts in ``body`` of ``texts(entity, namespace, dimensions, body)``; payloads have ``Datapoints`` in place of ``body``. Rejects as in ``read_range_payloads``."""
    reason = F.when(F.col("__j.Datapoints").isNull(), "no result")
    return _read(texts, F.col("body"), DATAPOINT_SCHEMA, reason, F.col("__j.Datapoints").alias("Datapoints"))


def series_name(labels):
    """``__name__`` first, then ``key_value`` of every other label in payload order; other characters become ``_``."""
    entries = F.map_entries(labels)
    rest = F.transform(F.filter(entries, lambda e: e["key"] != "__name__"), lambda e: F.concat(e["key"], F.lit("_"), e["value"]))
    joined = F.array_join(F.filter(F.concat(F.array(F.element_at(labels, "__name__")), rest), lambda x: x.isNotNull()), "_")
    return F.when(F.size(labels) == 0, "unknown_metric").otherwise(F.regexp_replace(joined, r"[^\p{L}\p{N}]", "_"))


def range_payload_samples(payloads: DataFrame) -> DataFrame:
    """``entity, query, metric, ts, value``: one row for each sample of a range-query payload."""
    series = payloads.select("entity", "query", F.explode("result").alias("r"))
    points = series.select("entity", "query", series_name(F.col("r.metric")).alias("metric"), F.explode("r.values").alias("p"))
    micros = (F.try_element_at("p", F.lit(1)).try_cast("double") * 1000000).cast("long")
    ts = F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01").cast("timestamp_ntz"))
    return points.select("entity", "query", "metric", ts.alias("ts"), F.try_element_at("p", F.lit(2)).try_cast("double").alias("value"))


def range_payload_to_metrics(payloads: DataFrame, step: str = "5 minutes") -> DataFrame:
    """Payload series resampled to means on a continuous grid, gaps interpolated linearly."""
    samples = range_payload_samples(payloads).select("entity", "metric", "ts", "value")
    return resample_mean(samples, step, interpolate=True)


def merge_queries(samples: DataFrame, step: str, top_n: int = 5) -> DataFrame:
    """Of each query's series the ``top_n`` of highest variance, aligned on one grid per entity; nulls filled forward, backward, then 0.

    ``samples`` is ``entity, query, metric, ts, value``; ties in variance go by metric name.
    """
    from pyspark.sql import Window

    spread = samples.groupBy("entity", "query", "metric").agg(F.var_samp("value").alias("v"))
    rank = F.row_number().over(Window.partitionBy("entity", "query").orderBy(F.desc_nulls_last("v"), "metric"))
    top = spread.withColumn("k", rank).where(F.col("k") <= top_n).select("entity", "query", "metric")
    kept = samples.join(top, ["entity", "query", "metric"], "left_semi").groupBy("entity", "metric", "ts").agg(F.avg("value").alias("value"))
    return fill_edges(kept, step)


def datapoints_to_metrics(payloads: DataFrame, period: int = 300, stat: str = "Average") -> DataFrame:
    """S3: datapoints of one statistic as means of ``period`` seconds, interpolated; the name joins namespace, ``metric`` and dimension values."""
    name = F.concat(
        F.replace("namespace", F.lit("/"), F.lit("_")), F.lit("_metric"), F.array_join(F.transform("dimensions", lambda d: F.concat(F.lit("_"), d["Value"])), "")
    )
    points = payloads.select("entity", name.alias("metric"), F.explode("Datapoints").alias("p"))
    samples = points.select("entity", "metric", F.to_timestamp_ntz(F.col("p.Timestamp")).alias("ts"), F.col(f"p.{stat}").alias("value"))
    return resample_mean(samples, f"{period} seconds", interpolate=True)


def merge_series(samples: DataFrame, step: str) -> DataFrame:
    """Series of an entity aligned on one grid; nulls filled forward, backward, then 0."""
    return fill_edges(samples.select("entity", "metric", "ts", "value"), step)
