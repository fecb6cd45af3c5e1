"""Exact document deduplication against a persistent digest index (DataFrame functions only)."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causetrace.llm.common import remove, shared_dir, stage, unstage

#: Fixed value: the white space of the equality rule.
SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Every run of ASCII white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


class DigestIndex:
    """A Parquet table ``(digest, keep_id)``, bucketed and sorted by digest, that outlives a session.

    Opening an existing location registers it again under a name made from the whole location: the bucket layout is in the
    file names, so later anti-joins read the index without a shuffle. Every append adds a file to each bucket it touches;
    with several files a bucket is sorted again on reading, until ``compact()`` leaves one.
    """

    def __init__(self, spark: SparkSession, location: str, buckets: int = 64):
        self.spark, self.location, self.buckets = spark, location, buckets
        self.table = "digest_index_" + hashlib.sha256(location.rstrip("/").encode()).hexdigest()[:32]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT) USING PARQUET "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{location}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append_new(self, groups: DataFrame) -> None:
        """Append the digests of ``groups(digest, keep_id)``, one row each, that the index lacks (sort-merge anti-join).

        Running the same batch again appends nothing, so a failed batch may be repeated.
        """
        new = groups.select("digest", "keep_id").repartition(self.buckets, "digest").join(self.read().hint("merge"), "digest", "left_anti")
        new.select("digest", "keep_id").write.insertInto(self.table)

    def compact(self) -> None:
        """One sorted file for each bucket. The rows are staged first, so that a failed rewrite loses nothing and can be repeated."""
        rows = stage(self.read(), "index")
        rows.repartition(self.buckets, "digest").write.insertInto(self.table, overwrite=True)
        unstage(rows)

    def drop(self) -> None:
        """Remove the table and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        remove(self.spark, self.location)


def exact_dedup(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Deduplicate a batch against the index and itself, then append its new digests.

    Returns every row of ``docs`` as ``doc_id, keep_id, group_size, kept, text_sha256``: of equal
    texts the one already in the index stays, else the smallest doc_id; ``group_size`` counts rows
    of this batch. Null text counts as empty; rows that repeat a doc_id and text share one decision;
    of rows without an id, one is kept if no row of its text has an id, and none if the index knows the text. Other columns are ignored.

    Digests are staged once, each row with a number; groups are partial aggregates, so a text that a third of all rows
    share reaches the index as one row, and only the final attribution join meets its copies,
    as a sort-merge join of two shuffles whose large parts adaptive execution splits (``spark.sql.adaptive.skewJoin``).
    """
    digests = stage(docs.select("doc_id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")
    groups = digests.groupBy("digest").agg(F.min("doc_id").alias("smallest"), F.min("row").alias("first"), F.count(F.lit(1)).alias("group_size"))
    known = index.read().select("digest", F.col("keep_id").alias("known_id"), F.lit(True).alias("known"))
    keep = F.when(F.col("known"), F.col("known_id")).otherwise(F.col("smallest"))
    # a known text may have no id: then nothing of this batch stays for it
    groups = stage(
        groups.repartition(index.buckets, "digest")
        .join(known.hint("merge"), "digest", "left")
        .select("digest", keep.alias("keep_id"), "group_size", F.when(F.col("known").isNull() & F.col("smallest").isNull(), F.col("first")).alias("only")),
        "groups",
    )
    index.append_new(groups)
    return (
        digests.join(groups.hint("merge"), "digest")
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("row") == F.col("only"), F.lit(False)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def fresh_index(spark: SparkSession, tag: str) -> DigestIndex:
    """An empty index in the shared folder, as many buckets as the session shuffles into."""
    return DigestIndex(spark, f"{shared_dir(spark)}/{tag}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions")))
