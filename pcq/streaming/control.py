"""Control signals: sums by tumbling window, frame counts, and the camera as an ordered fold; batch and streaming."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The flush interval, and limits of the folded camera.
FLUSH_MS, PITCH_LIMIT, ZOOM_LIMITS, PAN_STEP = 33, 89.0, (0.1, 10.0), 50.0
FOLD_SCHEMA = "session string, signals long, yaw double, pitch double, zoom double, pan_x double, pan_y double, mode string"


def sums(signals: DataFrame, value: str = "value", ms: int = FLUSH_MS) -> DataFrame:
    """Sum and number of signals in tumbling windows; windows that sum to 0 are not sent. Works on streams with a watermark."""
    w = F.window("ts", f"{ms} milliseconds")
    return signals.groupBy(w.alias("_w")).agg(F.sum(value).alias("total"), F.count("*").alias("n")).filter("total <> 0").select(F.col("_w.start").alias("start"), "total", "n")


def frames(signals: DataFrame) -> DataFrame:
    """Rows for each second."""
    return signals.groupBy(F.window("ts", "1 second").alias("_w")).agg(F.count("*").alias("fps")).select(F.col("_w.start").alias("start"), "fps")


def _step(s: dict, row) -> dict:
    """One signal on a camera state."""
    if row.type == "switchMode":
        s["mode"] = "fps" if s["mode"] == "iso" else "iso"
    elif row.type == "reset":
        s |= {"yaw": 0.0, "pitch": 0.0, "zoom": 1.0, "pan_x": 0.0, "pan_y": 0.0}
    elif row.type == "signal":
        s["yaw"] += row.yaw
        s["pitch"] = max(-PITCH_LIMIT, min(PITCH_LIMIT, s["pitch"] + row.pitch * 180 / math.pi))
        s["zoom"] = max(ZOOM_LIMITS[0], min(ZOOM_LIMITS[1], s["zoom"] * (1 + row.zoom)))
        s["pan_x"] += row.pan_x * PAN_STEP
        s["pan_y"] += row.pan_y * PAN_STEP
    s["signals"] += 1
    return s


def _fresh() -> dict:
    return {"signals": 0, "yaw": 0.0, "pitch": 0.0, "zoom": 1.0, "pan_x": 0.0, "pan_y": 0.0, "mode": "iso"}


def camera_fold(log: DataFrame) -> DataFrame:
    """log(session, seq, type, yaw, pitch, zoom, pan_x, pan_y) -> the camera of each session after all its signals, in the
    order of seq. Pings and unknown types count as signals and change nothing. Sorted signals stream through the fold, so a
    session may have any number of them: a task holds one camera."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, {}
        for batch in batches:
            done = []
            for row in batch.itertuples(index=False):
                if row.session != now:
                    if state:
                        done.append({"session": now, **state})
                    now, state = row.session, _fresh()
                state = _step(state, row)
            if done:
                yield pd.DataFrame(done)
        if state:
            yield pd.DataFrame([{"session": now, **state}])

    rows = log.select("session", "seq", "type", "yaw", "pitch", "zoom", "pan_x", "pan_y")
    return rows.repartition("session").sortWithinPartitions("session", "seq").mapInPandas(run, FOLD_SCHEMA)


# What a pixel of drag scales by, and limits of a scale.
SCALE_STEP, SCALE_LIMITS = 0.008, (0.01, 100.0)
DRAG_SCHEMA = "session string, moves long, rot_x double, rot_y double, rot_z double, scale_x double, scale_y double, scale_z double"


def drag_fold(log: DataFrame, ring: list[tuple[float, float, float, float, float]]) -> DataFrame:
    """log(session, seq, mode 'rotate' or 'scale', axis 'x', 'y', 'z' or 'center', sx, sy) -> the transform of each session
    after all its moves. A move counts from the place of the one before. Rotation: the move along the tangent of the nearest
    ring point (x, y, tangent x, tangent y, radius), over its radius, in degrees, kept within a full turn with its sign.
    Scale: 0.8 % for each pixel to the right, on the axis or, for 'center', on all three."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, turn, size, at, moves = None, [], [], None, 0

        def row() -> pd.DataFrame:
            return pd.DataFrame([(now, moves, *turn, *size)], columns=["session", "moves", "rot_x", "rot_y", "rot_z", "scale_x", "scale_y", "scale_z"])

        for batch in batches:
            for session, _, mode, axis, sx, sy in batch.itertuples(index=False):
                if session != now:
                    if now is not None:
                        yield row()
                    now, turn, size, at, moves = session, [0.0] * 3, [1.0] * 3, (sx, sy), 0
                dx, dy, at, moves = sx - at[0], sy - at[1], (sx, sy), moves + 1
                k = "xyz".find(axis)
                if mode == "rotate" and k >= 0:
                    near = min(ring, key=lambda p: (sx - p[0]) ** 2 + (sy - p[1]) ** 2)
                    along = (dx * near[2] + dy * near[3]) / max(near[4] or 1.0, 1.0)
                    turn[k] = math.fmod(turn[k] + math.degrees(along), 360.0)
                elif mode == "scale":
                    for j in range(3) if axis == "center" else [k] if k >= 0 else []:
                        size[j] = max(SCALE_LIMITS[0], min(SCALE_LIMITS[1], size[j] * (1 + dx * SCALE_STEP)))
        if now is not None:
            yield row()

    rows = log.select("session", "seq", "mode", "axis", "sx", "sy")
    return rows.repartition("session").sortWithinPartitions("session", "seq").mapInPandas(run, DRAG_SCHEMA)


def camera_stream(log: DataFrame) -> DataFrame:
    """camera_fold over a stream: keyed state, one row out for each session of a batch. Signals of one batch are ordered by
    seq; later batches come after."""
    state_schema = "signals long, yaw double, pitch double, zoom double, pan_x double, pan_y double, mode string"

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        names = list(_fresh())
        s = dict(zip(names, state.get, strict=True)) if state.exists else _fresh()
        for row in pd.concat(list(batches)).sort_values("seq").itertuples():
            s = _step(s, row)
        state.update(tuple(s[k] for k in names))
        yield pd.DataFrame([{"session": key[0], **s}])

    return log.groupBy("session").applyInPandasWithState(run, FOLD_SCHEMA, state_schema, "update", "NoTimeout")
