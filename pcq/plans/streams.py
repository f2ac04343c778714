"""Queries that run as streams: the driver's events arrive late, out of order and in several runs of one restarted query, and
the SQL says what must have come out of them up to the watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch
from ..streaming import sessions
from .queries import control_log, query, r6

#: Days of events in a run, which is also how late one may be; a third of a run's events come with the next one.
DAYS = 8
_US = 86_400_000_000


def timed(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")


def signals(spark: SparkSession, d: str) -> DataFrame:
    """control_log with the time of each signal."""
    return control_log(spark, d, F.col("ts").cast("timestamp").alias("ts"))


def streamed(log: DataFrame, key: str, run: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The rows that run(stream, delay) has sent after the last of log's rows has arrived. Each run starts the query again from
    its checkpoint, with the rows of the next few days and those that are late."""
    spark, root = log.sparkSession, Scratch(log.sparkSession, "stream").root
    micros = F.unix_micros("ts")
    ends = log.agg(F.min(micros).alias("a"), F.max(micros).alias("b")).first()
    late = (F.col(key) % 3 == 0).cast("int")
    dealt = log.withColumn("_run", F.floor((micros - ends["a"]) / (DAYS * _US)) + late)
    for k in range(((ends["b"] or 0) - (ends["a"] or 0)) // (DAYS * _US) + 2):
        dealt.filter(F.col("_run") == k).drop("_run").write.mode("append").parquet(f"{root}/in")
        stream = run(spark.readStream.schema(log.schema).parquet(f"{root}/in"), f"{DAYS} days")
        sent = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
        sent.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


_FINAL = f"final AS (SELECT (max(epoch_us(ts)) - {DAYS * _US}) // 1000 * 1000 AS w FROM events)"


@query(f"""WITH {_FINAL} SELECT (epoch_us(ts) // 33000 * 33000)::BIGINT AS start_us, round(sum(value), 4) AS total, count(*) AS n FROM events, final
GROUP BY start_us, w HAVING sum(value) <> 0 AND start_us + 33000 <= w""")
def stream_control_sum_33ms(spark, d):
    sent = streamed(timed(spark, d), "event_id", sessions.sums)
    return sent.select(F.unix_micros("start").alias("start_us"), F.round("total", 4).alias("total"), "n")


@query(f"WITH {_FINAL} SELECT (epoch_us(ts) // 1000000 * 1000000)::BIGINT AS start_us, count(*) AS fps FROM events, final GROUP BY start_us, w HAVING start_us + 1000000 <= w")
def stream_fps_1s(spark, d):
    return streamed(timed(spark, d), "event_id", sessions.frames).select(F.unix_micros("start").alias("start_us"), "fps")


def _lives_sql(source: str) -> str:
    """Cameras of the events that `source` selects; a pause ends one."""
    return f"""e AS ({source}), c AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY session ORDER BY us, event_id) >= {sessions.IDLE * 1_000_000} THEN 1 ELSE 0 END AS cut FROM e),
l AS (SELECT *, sum(cut) OVER (PARTITION BY session ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS life FROM c),
s AS (SELECT *, row_number() OVER (PARTITION BY session, life ORDER BY us, event_id) AS k FROM l),
f AS (SELECT session, life, 0::BIGINT AS k, 0e0 AS yaw, 0e0 AS pitch, 1e0 AS zoom, 0e0 AS pan_x, 0e0 AS pan_y, 'iso' AS mode, min(us) AS began, max(us) AS latest FROM s GROUP BY session, life UNION ALL
SELECT f.session, f.life, s.k, CASE t WHEN 'error' THEN 0e0 WHEN 'signup' THEN yaw ELSE yaw + v / 100 END,
CASE t WHEN 'error' THEN 0e0 WHEN 'signup' THEN pitch ELSE greatest(-89e0, least(89e0, pitch + (v / 50 - 1) * 180 / 3.141592653589793::DOUBLE)) END,
CASE t WHEN 'error' THEN 1e0 WHEN 'signup' THEN zoom ELSE greatest(0.1e0, least(10e0, zoom * (1 + (v / 1000 - 0.05e0)))) END,
CASE t WHEN 'error' THEN 0e0 WHEN 'signup' THEN pan_x ELSE pan_x + v / 200 * 50 END, CASE t WHEN 'error' THEN 0e0 WHEN 'signup' THEN pan_y ELSE pan_y + (v / 300 - 0.5e0) * 50 END,
CASE t WHEN 'signup' THEN CASE mode WHEN 'iso' THEN 'fps' ELSE 'iso' END ELSE mode END, began, latest FROM f JOIN s ON s.session = f.session AND s.life = f.life AND s.k = f.k + 1),
lives AS (SELECT session, began::BIGINT AS began, latest::BIGINT AS latest, k AS signals, round(yaw, 6) AS yaw, round(pitch, 6) AS pitch, round(zoom, 6) AS zoom, round(pan_x, 6) AS pan_x, round(pan_y, 6) AS pan_y, mode FROM f QUALIFY k = max(k) OVER (PARTITION BY session, life))"""


_EVENT = "user_id::VARCHAR AS session, event_id, epoch_us(ts) AS us, event_type AS t, value AS v"


def _rounded(lives: DataFrame) -> DataFrame:
    return lives.select("session", "began", "latest", "signals", *r6("yaw", "pitch", "zoom", "pan_x", "pan_y"), "mode")


@query(f"WITH RECURSIVE {_lives_sql(f'SELECT {_EVENT} FROM events')} SELECT * FROM lives")
def camera_lives(spark, d):
    return _rounded(sessions.lives(signals(spark, d)))


@query(f"WITH RECURSIVE {_FINAL}, {_lives_sql(f'SELECT {_EVENT} FROM events, final WHERE us <= w')} SELECT lives.* FROM lives, final WHERE latest + {sessions.IDLE * 1_000_000} <= w")
def stream_camera_lives(spark, d):
    return _rounded(streamed(signals(spark, d), "seq", sessions.camera_lives))
