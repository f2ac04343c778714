"""Streams against their batch functions: late, shuffled, cut anywhere, restarted; state that goes."""

import datetime
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from pcq import catalog
from pcq.streaming import sessions

SF = "/root/testdata/sf0.001"
LOG = "session string, seq long, ts timestamp, type string, yaw double, pitch double, zoom double, pan_x double, pan_y double"
START = datetime.datetime(2024, 1, 1)


@pytest.mark.parametrize("name", ["stream_control_sum_33ms", "stream_fps_1s", "camera_lives", "stream_camera_lives"])
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    want = con.sql(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda r: tuple("" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r)
    rows = sorted(map(key, got.select(*columns).collect()))
    assert rows == sorted(map(key, want.project(", ".join(f'"{c}"' for c in columns)).fetchall())) and rows


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def signal(session, seq, seconds, kind="signal", r=random.Random(0)):
    return session, seq, at(seconds), kind, r.uniform(-1, 1), r.uniform(-1, 1), r.uniform(-0.3, 0.3), r.uniform(-2, 2), r.uniform(-2, 2)


def run(spark, tmp_path, batches, make, watch=None):
    """All rows that a stream has sent, started anew for each batch of rows."""
    root = f"{tmp_path}/{random.random()}"
    for rows in batches:
        spark.createDataFrame(rows, LOG).repartition(2).write.mode("append").parquet(f"{root}/in")
        out = make(spark.readStream.schema(LOG).parquet(f"{root}/in"))
        q = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        if watch is not None:
            watch.append(q.lastProgress["stateOperators"][0])
    return spark.read.schema(out.schema).parquet(f"{root}/out")


def rows_of(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_any_order_of_arrival_gives_the_batch_result(spark, tmp_path):
    r = random.Random(7)
    seconds = sorted(r.uniform(0, 5000) for _ in range(300))
    log = [signal(r.choice("abcde"), k, s, r.choice(["signal"] * 6 + ["reset", "switchMode", "ping"]), r) for k, s in enumerate(seconds)]
    log += [signal("a", 1000 + k, 2500.5, r=r) for k in range(5)]  # at the same moment, in the order of seq
    late = [(min(4, int((x[2] - START).total_seconds() // 1000) + r.randint(0, 1)), x) for x in log]
    batches = [[x for k, x in late if k == n] for n in range(5)]
    for own in batches:
        r.shuffle(own)
    batches.append([signal("z", 9999, 50_000.0)])
    watch = []
    got = run(spark, tmp_path, batches, lambda s: sessions.camera_lives(s, "1100 seconds", idle=300), watch)
    want = sessions.lives(spark.createDataFrame(log, LOG).repartition(3), idle=300)
    assert rows_of(got) == rows_of(want) and want.count() > 10
    # Only z, which no one can have outlived yet, is remembered.
    assert watch[-1]["customMetrics"]["numValueStateVars"] >= 1 and got.filter("session = 'z'").count() == 0


def test_signals_behind_the_watermark_change_nothing(spark, tmp_path):
    first = [signal("a", k, 10 * k) for k in range(5)] + [signal("b", 50, 1000)]
    second = [signal("a", 90, 15.0), signal("b", 91, 995.0), signal("a", 92, 2000.0)]
    got = rows_of(run(spark, tmp_path, [first, second, [signal("c", 99, 9000)]], lambda s: sessions.camera_lives(s, "100 seconds", idle=200)))
    kept = [x for x in first + second if x[1] != 90]
    assert got == rows_of(sessions.lives(spark.createDataFrame(kept, LOG), idle=200))


def test_windows_are_sent_once_and_when_they_are_final(spark, tmp_path):
    make = lambda s: sessions.sums(s.withColumnRenamed("yaw", "value"), "10 seconds", ms=1000)
    log = [signal("a", k, k / 4) for k in range(100)]
    got = run(spark, tmp_path, [log[40:], log[:40], [signal("a", 1000, 500.0)]], make).collect()
    # The first batch ends at 24.75 s, so that windows before 14.75 s are closed when the second one comes.
    assert sorted((w.start - START).total_seconds() for w in got) == list(range(10, 25))
    want = {k: sum(x[4] for x in log[4 * k : 4 * k + 4]) for k in range(10, 25)}
    assert all(abs(w.total - want[(w.start - START).total_seconds()]) < 1e-9 and w.n == 4 for w in got)


def test_lives_of_awkward_logs(spark):
    none = spark.createDataFrame([], LOG)
    assert sessions.lives(none).collect() == []
    log = [signal(None, 1, 5.0), signal(None, 2, 4.0), signal("a", 1, 0.0), signal("a", 2, 10.0), signal("a", 3, 19.999999), signal("b", 4, 0.0)]
    got = sessions.lives(spark.createDataFrame(log, LOG), idle=10).select("session", F.col("began") - int(START.replace(tzinfo=datetime.UTC).timestamp()) * 1_000_000, "signals").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(None, 4_000_000, 2), ("a", 0, 1), ("a", 10_000_000, 2), ("b", 0, 1)]))


def test_sessions_share_states(spark, tmp_path):
    """One state holds many sessions, null among them, and gives what the batch gives."""
    log = [signal(s, 10 * k + j, 100.0 * k + j) for k in range(6) for j, s in enumerate(["a", "b", None, "d"]) if (k, s) != (3, "b")]
    got = run(spark, tmp_path, [log[::2], log[1::2], [signal("z", 9999, 50_000.0)]], lambda s: sessions.camera_lives(s, "1000 seconds", idle=150, buckets=1))
    want = sessions.lives(spark.createDataFrame(log, LOG), idle=150)
    texts = lambda df: sorted(map(str, map(tuple, df.collect())))
    assert texts(got) == texts(want) and want.count() == 5
