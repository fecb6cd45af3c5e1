"""Deployment events (S9, S10) and call traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "timestamp string, description string, type string"


def webhook_payload_to_event(payloads: DataFrame) -> DataFrame:
    """``ts, description, type`` of webhook payloads (``arrived``, JSON ``payload``)."""
    get = lambda path: F.get_json_object("payload", path)
    workflow = get("$.workflow_run").isNotNull()
    done = (get("$.action") == "completed") & (get("$.workflow_run.conclusion") == "success")
    named = F.concat(F.lit("Successful '"), F.coalesce(get("$.workflow_run.name"), F.lit("Deploy")), F.lit("' deployment on "), F.coalesce(get("$.repository.name"), F.lit("unknown_repo")))
    plain = ~workflow & get("$.message").isNotNull()
    text = F.when(workflow & F.coalesce(done, F.lit(False)), named).when(plain, get("$.message")).otherwise("Unknown deployment event")
    kind = F.when(plain, F.coalesce(get("$.type"), F.lit("deployment"))).otherwise("deployment")
    rest = [c for c in payloads.columns if c not in ("arrived", "payload")]
    return payloads.select(*rest, F.col("arrived").alias("ts"), text.alias("description"), kind.alias("type"))


def recent_events(events: DataFrame, as_of, max_days_old: int = 7) -> DataFrame:
    """Events not older than ``max_days_old`` days at ``as_of``; unparsable times are dropped."""
    ts = F.try_to_timestamp("timestamp").cast("timestamp_ntz")
    return events.withColumn("ts", ts).where(F.col("ts") >= F.lit(as_of) - F.expr(f"interval {max_days_old} days"))


def load_events(spark: SparkSession, path: str, as_of, max_days_old: int = 7) -> DataFrame:
    """Events of a JSON-lines file or folder; a missing path gives an empty table."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema(EVENT_SCHEMA).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], EVENT_SCHEMA)
    return recent_events(rows, as_of, max_days_old)


def traces_to_topology(traces: DataFrame) -> DataFrame:
    """``src, dst, weight, avg_latency_ms`` from ``traceID, spans, processes``.

    A call is a CHILD_OF reference between spans of two known, different services; the mean is over the child's duration. A row is a whole trace, so that parents are looked up
    within it (of equal span ids the first) and only calls are shuffled, added up.
    """
    kept = traces.where(~F.coalesce(F.col("service").startswith("jaeger-"), F.lit(False))) if "service" in traces.columns else traces
    service = lambda s: F.try_element_at("processes", s["processID"])["serviceName"]
    # looked up once a trace, below the rows of its spans
    named = kept.select("spans", F.transform("spans", lambda s: s["spanID"]).alias("ids"), F.transform("spans", service).alias("services"))
    child = named.select("ids", "services", F.posexplode("spans").alias("at", "s")).select("ids", "services", F.col("services")[F.col("at")].alias("dst"), F.col("s.duration").alias("duration"), F.explode("s.references").alias("r"))
    parent = F.try_element_at("services", F.nullif(F.array_position("ids", F.col("r.spanID")).cast("int"), F.lit(0)))
    calls = child.where("r.refType = 'CHILD_OF'").select(parent.alias("src"), "dst", "duration").where("src <> dst")
    return calls.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"), (F.avg("duration") / 1000).alias("avg_latency_ms"))
