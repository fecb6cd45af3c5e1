"""Streams in several batches: order, late rows, finality."""

import datetime as dt
import os
import random
from collections import Counter

import pandas as pd
import pytest

from causetrace.operators import detect
from causetrace.streaming import damping
from causetrace.streaming.twins import stream_log_counts

T0 = dt.datetime(2024, 1, 1)


def feed(spark, tmp_path, batches, schema):
    """A stream that reads one file a batch, in order."""
    folder = tmp_path / "in"
    folder.mkdir()
    for i, rows in enumerate(batches):
        part = tmp_path / f"part{i}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(part))
        file = next(part.glob("*.parquet"))
        os.rename(file, folder / f"{i:03d}.parquet")
        os.utime(folder / f"{i:03d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drain(stream, tmp_path):
    out = []
    q = stream.writeStream.foreachBatch(lambda df, n: out.extend(df.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return out, q


@pytest.fixture
def rocksdb(spark):
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    damping.use_rocksdb(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)


def test_alerts_do_not_depend_on_batches(rocksdb, tmp_path):
    """Rows shuffled across batches within the delay, equal times too, give the alerts of the batch operator; a row behind the watermark is dropped and counted."""
    r = random.Random(7)
    rows = []
    for m in ("cpu", "mem"):
        for i in range(240):
            rows.append(("e", m, T0 + dt.timedelta(minutes=i - i % 2), i, r.random() < 0.6))  # two rows a time
    rows.append(("gone", "cpu", T0 + dt.timedelta(minutes=3), 0, True))
    order = sorted(rows, key=lambda x: x[2] + dt.timedelta(seconds=r.randrange(540)))
    late = ("e", "cpu", T0 + dt.timedelta(minutes=5), 999, True)
    batches = [order[i : i + 60] for i in range(0, len(order), 60)]
    batches[-1] = [*batches[-1], late]
    stream = feed(rocksdb, tmp_path, batches, "entity string, metric string, ts timestamp, seq long, is_anomaly boolean")
    got, q = drain(damping.stream_dampen_alerts(stream, 3, 4, "10 minutes"), tmp_path)
    passed = max(x[2] for x in rows) - dt.timedelta(minutes=10)
    flags = rocksdb.createDataFrame([(e, m, t + dt.timedelta(microseconds=s), a) for e, m, t, s, a in rows], "entity string, metric string, ts timestamp_ntz, is_anomaly boolean")
    want = [(x.entity, x.metric, x.ts.replace(microsecond=0)) for x in detect.dampen_alerts(flags, 3, 4).where("hard_alert").collect()]
    assert Counter((x.entity, x.metric, x.ts) for x in got) == Counter(x for x in want if x[2] <= passed) and len(got) > 20
    assert damping.late_rows(q) >= 1


def test_fold_resumes():
    """Folding piece by piece is folding whole."""
    r = random.Random(8)
    rows = [(i, 0, r.random() < 0.7) for i in range(200)]
    whole, *_ = damping.fold(rows, 0, 0, 3, 5)
    told, streak, wait = [], 0, 0
    for i in range(0, 200, 7):
        more, streak, wait = damping.fold(rows[i : i + 7], streak, wait, 3, 5)
        told += more
    assert told == whole and whole


def test_bins_appear_once_and_late_lines_are_dropped(spark, tmp_path):
    levels = ["ERROR", "WARN", "INFO"]
    lines = [("e", T0 + dt.timedelta(minutes=i), levels[i % 3]) for i in range(120)]
    late = [("e", T0 + dt.timedelta(minutes=1), "ERROR")] * 4
    batches = [lines[:50], lines[50:100], late + lines[100:]]
    stream = feed(spark, tmp_path, batches, "entity string, ts timestamp, level string")
    got, q = drain(stream_log_counts(stream, "5 minutes", "10 minutes"), tmp_path)
    passed = lines[-1][1] - dt.timedelta(minutes=10)
    want = pd.DataFrame([(t - dt.timedelta(minutes=t.minute % 5), lv) for _, t, lv in lines], columns=["ts", "level"])
    want = {ts: tuple((g["level"] == lv).sum() for lv in levels) for ts, g in want.groupby("ts") if ts + dt.timedelta(minutes=5) <= passed}
    assert {x.ts: tuple(x[c] for c in ("log_error_count", "log_warn_count", "log_info_count")) for x in got} == want
    assert len(got) == len(want) == 21 and damping.late_rows(q) >= 1
    assert sum(x.log_total_volume for x in got) == sum(sum(v) for v in want.values())
