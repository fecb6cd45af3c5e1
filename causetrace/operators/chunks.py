"""Scans over long series in chunks: summaries of chunks carry what a window would have brought along, so that one series uses many tasks.

Results equal those of the plain windows, whatever the length of a chunk. Only summaries, one row a chunk, meet in a window over the whole series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("entity", "metric")
CHUNK = "__c"
PART = (*KEYS, CHUNK)


def within(order: str = "pos"):
    return Window.partitionBy(*PART).orderBy(order)


def by_place(df: DataFrame, size: int) -> DataFrame:
    """``df`` with its chunk of ``size`` places; ``pos`` counts the rows of a series from 0 without gaps (see ``numbered``)."""
    return df.withColumn(CHUNK, F.floor(F.col("pos") / size))


def carried(rows: DataFrame, before: dict[str, Column] | None = None, after: dict[str, Column] | None = None, order: str = "pos") -> DataFrame:
    """Chunked ``rows`` with, for each name, the last value that isn't null of earlier chunks (``before``) or the first of later ones (``after``)."""
    before, after = before or {}, after or {}
    at = lambda c: F.when(c.isNotNull(), F.struct(F.col(order).alias("at"), c.alias("v")))
    aggs = [F.max(at(c)).alias(k) for k, c in before.items()] + [F.min(at(c)).alias(k) for k, c in after.items()]
    s = rows.groupBy(*PART).agg(*aggs)
    w = Window.partitionBy(*KEYS).orderBy(CHUNK)
    earlier, later = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    s = s.select(*PART, *[F.last(k, True).over(earlier)["v"].alias(k) for k in before], *[F.first(k, True).over(later)["v"].alias(k) for k in after])
    return rows.join(s, list(PART))


def with_halo(rows: DataFrame, size: int, reach: int) -> DataFrame:
    """Chunked ``rows`` and, marked ``__halo``, copies of the last ``reach`` rows of each chunk in the next; ``size`` is at least ``reach``."""
    if size < reach:
        raise ValueError("a chunk is shorter than the rows it needs from the one before")
    edge = rows.where(F.col("pos") % size >= size - reach).withColumn(CHUNK, F.col(CHUNK) + 1)
    real = rows.select(*PART).distinct()
    return rows.withColumn("__halo", F.lit(False)).unionByName(edge.join(real, list(PART), "left_semi").select(*rows.columns).withColumn("__halo", F.lit(True)))


def numbered(df: DataFrame, seconds: int, place: str = "pos") -> DataFrame:
    """``df`` with each row's place in its series by ``ts``, from 0: places within spans of ``seconds``, and how many rows the spans before have."""
    span = F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")) / seconds)
    rows = df.withColumn(CHUNK, span)
    n = rows.groupBy(*PART).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*KEYS).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    got = rows.join(n.select(*PART, before.alias("__n")), list(PART))
    return got.withColumn(place, F.row_number().over(within("ts")) - 1 + F.col("__n")).drop("__n")


def runs(flags: DataFrame, seconds: int) -> tuple[DataFrame, DataFrame]:
    """(``flags`` with ``__p``, a row's place from 1; ``lo, hi`` of every run of set flags). A run that spans several chunks is joined from its pieces."""
    rows = numbered(flags, seconds, "__p").withColumn("__p", F.col("__p") + 1)
    pieces = rows.where("is_anomaly").withColumn("__g", F.col("__p") - F.row_number().over(within("ts")))
    pieces = pieces.groupBy(*PART, "__g").agg(F.min("__p").alias("lo"), F.max("__p").alias("hi"))
    w = Window.partitionBy(*KEYS).orderBy("lo")
    begins = F.coalesce(F.col("lo") != F.lag("hi").over(w) + 1, F.lit(True)).cast("int")
    joined = pieces.withColumn("__b", begins).withColumn("__r", F.sum("__b").over(w))
    return rows.drop(CHUNK), joined.groupBy(*KEYS, "__r").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("__r")
