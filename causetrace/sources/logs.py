"""Log lines: parsing, level counts and their merge with metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causetrace.operators.prepare import times

#: The keys that are probed, first present wins.
TIME_KEYS = ("timestamp", "time", "@timestamp", "ts", "date")
LEVEL_KEYS = ("level", "severity", "log.level")
#: Levels that count as error, warning and information.
ERROR, WARN, INFO = ("ERROR", "FATAL", "CRITICAL"), ("WARN",), ("INFO", "DEBUG")
COUNTS = ("log_error_count", "log_warn_count", "log_info_count", "log_total_volume")


def _first_present(fields, keys):
    out = F.lit(None).cast("string")
    for k in reversed(keys):
        out = F.when(F.map_contains_key(fields, k), F.element_at(fields, F.lit(k))).otherwise(out)
    return out


def parse_json_logs(lines: DataFrame) -> DataFrame:
    """``ts, level, message`` and the other columns. A line whose first present time key is empty, or that isn't JSON, is dropped."""
    got = lines.withColumn("__f", F.from_json("line", "map<string,string>")).where("__f is not null")
    stamp = _first_present(F.col("__f"), TIME_KEYS)
    level = F.upper(F.coalesce(_first_present(F.col("__f"), LEVEL_KEYS), F.lit("INFO")))
    out = got.withColumns({"__t": stamp, "level": F.when(level == "WARNING", "WARN").otherwise(level), "message": F.coalesce(F.element_at("__f", F.lit("message")), F.element_at("__f", F.lit("msg")), F.lit(""))})
    return out.where("__t is not null and __t <> ''").withColumn("ts", F.try_to_timestamp("__t").cast("timestamp_ntz")).drop("__f", "__t", "line")


def parse_text_logs(lines: DataFrame, year: int) -> DataFrame:
    """Syslog lines (``Mon d HH:MM:SS host proc: msg``, in ``year``) or lines with an ISO time; others are dropped.

    The level is the first level word, case-insensitive, default INFO; the message is the whole line.
    """
    syslog = F.regexp_extract("line", r"^([A-Z][a-z]{2}\s+\d{1,2}\s\d{2}:\d{2}:\d{2})\s\S+\s[^:]+:\s", 1)
    squeezed = F.regexp_replace(syslog, r"\s+", " ")
    iso = F.regexp_extract("line", r"(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})", 0)
    ts = F.when(syslog != "", F.try_to_timestamp(F.concat(F.lit(f"{year} "), squeezed), F.lit("yyyy MMM d HH:mm:ss"))).when(iso != "", F.try_to_timestamp(F.replace(iso, F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm:ss")))
    word = F.upper(F.regexp_extract("line", r"(?i)\b(ERROR|FATAL|CRITICAL|WARNING|WARN|INFO|DEBUG)\b", 1))
    level = F.when(word == "", "INFO").when(word == "WARNING", "WARN").otherwise(word)
    return lines.withColumns({"ts": ts.cast("timestamp_ntz"), "level": level, "message": F.col("line")}).where("ts is not null").drop("line")


def level_counts():
    n = lambda levels: F.sum(F.col("level").isin(*levels).cast("long"))
    return [n(ERROR).alias(COUNTS[0]), n(WARN).alias(COUNTS[1]), n(INFO).alias(COUNTS[2])]


def bin_log_levels(logs: DataFrame, step: str = "5 minutes") -> DataFrame:
    """Counts of each level in continuous bins from the first to the last of each entity; empty bins are 0. More bins of an entity than ``prepare.LONGEST`` are an error."""
    counts = logs.where("ts is not null").groupBy("entity", F.window("ts", step)["start"].alias("ts")).agg(*level_counts())
    span = counts.groupBy("entity").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    spine = span.select("entity", F.explode(times(F.col("lo"), F.col("hi"), step)).alias("ts"))
    full = spine.join(counts, ["entity", "ts"], "left").fillna(0, list(COUNTS[:3]))
    return full.withColumn(COUNTS[3], F.col(COUNTS[0]) + F.col(COUNTS[1]) + F.col(COUNTS[2]))


def merge_logs_with_metrics(metrics: DataFrame, logs: DataFrame) -> DataFrame:
    """Every metric row with the log counts of its entity and time, 0 where there are none."""
    return metrics.join(logs, ["entity", "ts"], "left").fillna(0, [c for c in logs.columns if c.startswith("log_")])
