"""Control signals as true streams: windows in event time that close once, and cameras that wait for late signals and forget.

Signals carry ts, the time at which they were sent. They may arrive late and in any order, within a delay; a watermark trails
the latest ts by that delay, and what is behind it is final. So whatever the order of arrival and however it is cut into
batches, a stream gives what the batch function gives for the signals up to the watermark. Signals that arrive behind it are
dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from . import control

#: A camera that gets no signal for so long is forgotten.
IDLE = 24 * 3600
SIGNAL = "ts long, seq long, type string, yaw double, pitch double, zoom double, pan_x double, pan_y double"
CAMERA = "began long, latest long, signals long, yaw double, pitch double, zoom double, pan_x double, pan_y double, mode string"
LIFE = f"session string, {CAMERA}"
_SIGNAL = tuple(f.split()[0] for f in SIGNAL.split(", "))
_CAMERA = tuple(f.split()[0] for f in CAMERA.split(", "))
#: States that a stream's sessions share. More sessions make a state longer, not more calls to the store.
BUCKETS = 512
_TYPES = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
_SIGNALS, _CAMERAS = (pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in f"session string, {own}".split(", ")]) for own in (SIGNAL, CAMERA))
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


class _Signal:
    __slots__ = _SIGNAL

    def __init__(self, values):
        for name, value in zip(_SIGNAL, values, strict=True):
            setattr(self, name, value)


def sums(signals: DataFrame, delay: str, ms: int = control.FLUSH_MS) -> DataFrame:
    """control.sums of a stream (ts, value): a window is sent once, when the watermark passes its end."""
    return control.sums(signals.withWatermark("ts", delay), ms=ms)


def frames(signals: DataFrame, delay: str) -> DataFrame:
    """control.frames of a stream (ts)."""
    return control.frames(signals.withWatermark("ts", delay))


def _fold(state: dict | None, signals: list[_Signal], idle: int) -> tuple[dict | None, list[dict]]:
    """Signals in order on a camera, or on none; the camera then, and those that were forgotten on the way. Times in us."""
    ended = []
    for s in signals:
        if state is not None and s.ts - state["latest"] >= idle:
            ended.append(state)
            state = None
        if state is None:
            state = {"began": s.ts, **control._fresh()}
        state = control._step(state, s) | {"latest": s.ts}
    return state, ended


def lives(log: DataFrame, idle: int = IDLE) -> DataFrame:
    """The cameras of log(session, ts, seq, type, yaw, pitch, zoom, pan_x, pan_y), as a batch: signals in the order of ts and
    seq; one after a pause of `idle` seconds or more starts a new camera. A row for each: LIFE, times in microseconds. Sorted
    signals stream through the fold, so a task holds one camera."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            done = []
            for session, *values in batch.itertuples(index=False):
                if state is not None and session != now:
                    done.append({"session": now, **state})
                    state = None
                now = session
                state, ended = _fold(state, [_Signal(values)], idle * 1_000_000)
                done += [{"session": now, **e} for e in ended]
            if done:
                yield pd.DataFrame(done)[["session", *_CAMERA]]
        if state is not None:
            yield pd.DataFrame([{"session": now, **state}])[["session", *_CAMERA]]

    rows = log.select("session", F.unix_micros("ts").alias("ts"), *_SIGNAL[1:])
    return rows.repartition("session").sortWithinPartitions("session", "ts", "seq").mapInPandas(run, LIFE)


class Cameras(StatefulProcessor):
    """State of a bucket of sessions: their cameras, and the signals that are not final yet, each as one Arrow table, since a call
    to the state store costs more than a session's signals. One timer, at the earliest of these or at the end of a camera's
    patience, wakes the bucket when the watermark gets there."""

    def __init__(self, idle: int):
        self.idle = idle * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cameras = handle.getValueState("cameras", "rows binary")
        # Signals of each batch, as they came; what is left of them after a wake is one table again.
        self.waiting = handle.getListState("waiting", "rows binary")
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [pa.Table.from_pandas(batch[["session", *_SIGNAL]], _SIGNALS, preserve_index=False) for batch in rows if len(batch)]
        if new:
            new = pa.concat_tables(new)
            self.waiting.appendValue((_packed(new),))
            self._wake(pc.min(new["ts"]).as_py(), timerValues)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        final = timerValues.getCurrentWatermarkInMs() * 1000
        self.due.clear()
        held = [_unpacked(raw) for (raw,) in self.waiting.get()] if self.waiting.exists() else []
        held = pa.concat_tables(held) if held else _SIGNALS.empty_table()
        due, later = held.filter(pc.less_equal(held["ts"], final)), held.filter(pc.greater(held["ts"], final))
        states = {r.pop("session"): r for r in _unpacked(self.cameras.get()[0]).to_pylist()} if self.cameras.exists() else {}
        ended = []
        columns = [due[c].to_pylist() for c in ("session", *_SIGNAL)]
        signals = sorted(zip(*columns, strict=True), key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2]))
        for session, own in groupby(signals, key=lambda r: r[0]):
            states[session], gone = _fold(states.get(session), [_Signal(r[1:]) for r in own], self.idle)
            ended += [{"session": session, **e} for e in gone]
        for session, state in list(states.items()):
            if state["latest"] + self.idle <= final:
                ended.append({"session": session, **states.pop(session)})
        if len(due):
            self.waiting.clear()
            if len(later):
                self.waiting.appendValue((_packed(later),))
        if states:
            self.cameras.update((_packed(pa.Table.from_pylist([{"session": k, **v} for k, v in states.items()], _CAMERAS)),))
        else:
            self.cameras.clear()
        times = [pc.min(later["ts"]).as_py()] if len(later) else []
        times += [state["latest"] + self.idle for state in states.values()]
        if times:
            self._wake(min(times), timerValues)
        if ended:
            yield pd.DataFrame(ended)[["session", *_CAMERA]]

    def _wake(self, micros: int, timerValues) -> None:
        at = max(-(-micros // 1000), timerValues.getCurrentWatermarkInMs() + 1)
        set_for = self.due.get()[0] if self.due.exists() else None
        if set_for is None or at < set_for:
            if set_for is not None:
                self.handle.deleteTimer(set_for)
            self.handle.registerTimer(at)
            self.due.update((at,))

    def close(self) -> None:
        pass


def camera_lives(log: DataFrame, delay: str, idle: int = IDLE, buckets: int = BUCKETS) -> DataFrame:
    """lives() of a stream: a camera is sent once, in append mode, when the watermark says that no signal can prolong it; its
    state goes then. Keyed state with timers needs the state store that is set here unless the session names one of its own.
    Sessions share `buckets` states; a checkpoint keeps their number."""
    spark: SparkSession = log.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(name):
        spark.conf.set(name, ROCKS)
    bucket = F.pmod(F.xxhash64("session"), F.lit(buckets)).cast("int").alias("bucket")
    rows = log.withWatermark("ts", delay).select(bucket, "session", F.col("ts").alias("at"), F.unix_micros("ts").alias("ts"), *_SIGNAL[1:])
    return rows.groupBy("bucket").transformWithStateInPandas(Cameras(idle), LIFE, "Append", "EventTime")
