"""Helpers shared by the training-data operators: shared staging, text access, batches."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one task turns into Python objects at once.
SLICE_ROWS = 256
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach (``spark.checkpoint.dir``).

    Only a local session without that setting gets a temporary folder of its own; on a cluster
    a missing setting is an error, since a machine-local folder would be invisible to the others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="causetrace-shared-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _hadoop_path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stage(df: DataFrame, tag: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage so that later steps survive lost executors without recomputing, and
    computes expensive rows once. Shuffle files of the write go with its end, the written files when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/causetrace-{tag}-{uuid.uuid4().hex}"
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, was) if was else spark.conf.unset(_CLEANUP)
    p, fs = _hadoop_path(spark, path)
    fs.deleteOnExit(p)
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_path = path
    return back


def unstage(df: DataFrame | None) -> None:
    """Delete the files of a ``stage()`` result that nothing reads any more."""
    path = getattr(df, "_staged_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _hadoop_path(spark, path)
    with contextlib.suppress(Exception):
        fs.delete(p, True)


def fresh(docs: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns_of(docs: DataFrame) -> list[Column]:
    """All columns of ``docs`` by name, whatever characters the names have."""
    return [F.col(f"`{c}`") for c in docs.columns]


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_text(
    docs: DataFrame,
    make: Callable[[], Callable[[list], Iterable[dict] | dict[str, list]]],
    schema: str,
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
) -> DataFrame:
    """Run a vectorised text function over every row, a small slice of an Arrow batch at a time.

    ``make()`` is called once per task and returns ``f(texts) -> {column: values}``; the columns
    named in ``keep`` pass through. Null texts arrive as None.
    """
    names = [x.split()[0] for x in schema.split(",")]
    # plain names inside, as any name may come in: dots, blanks, those used here
    arrow_kept = [f"__k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, arrow_kept, strict=True)], F.col(text).alias("__text"))
    full = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + [schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                out = f(part.column(len(arrow_kept)).to_pylist())
                cols = [part.column(i) for i in range(len(arrow_kept))] + [pa.array(out[n], type=types[n]) for n in names]
                yield pa.RecordBatch.from_arrays(cols, names=[*arrow_kept, *names])

    types = {n: _arrow_type(x.split(None, 1)[1]) for n, x in zip(names, schema.split(","), strict=True)}
    return rows.mapInArrow(run, full).toDF(*keep, *names)


def _arrow_type(sql: str) -> pa.DataType:
    sql = sql.strip().lower()
    if sql.startswith("array<"):
        return pa.list_(_arrow_type(sql[6:-1]))
    return {"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}[sql]
