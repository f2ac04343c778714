"""Queries that write files from the driver's tables, read them back, and say in SQL what must come out; and queries of the
operators about files, chunks, allocation, drags and turns."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..functions import camera as C
from ..functions import style as S
from ..operators import cache
from ..scratch import Scratch
from ..sources import e57, las, octree_dataset, writers, zones
from ..sources.ply import header as ply_header_of
from ..streaming import control
from .queries import HI, LO, PTS, _lin, _nodes_sql, _range_sql, pts, query

_FP = """fp AS (SELECT event_id, (event_id * 0.25e0)::FLOAT::DOUBLE AS x, user_id::FLOAT::DOUBLE AS y, value::FLOAT::DOUBLE AS z, user_id::FLOAT::DOUBLE AS intensity,
 (event_id % 254 + 2)::INT AS r, (user_id % 254 + 2)::INT AS g, (event_id // 254 % 254 + 2)::INT AS b, (user_id % 5)::INT AS classification, (event_id % 5 + 1)::INT AS return_number, user_id::INT AS source_id FROM events)"""


def file_points(spark: SparkSession, d: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    return spark.read.parquet(f"{d}/events.parquet").select(
        e.alias("point_idx"), (e * 0.25).cast("float").alias("x"), u.cast("float").alias("y"), F.col("value").cast("float").alias("z"), u.cast("float").alias("intensity"),
        (e % 254 + 2).cast("short").alias("r"), (u % 254 + 2).cast("short").alias("g"), (F.floor(e / 254) % 254 + 2).cast("short").alias("b"), (u % 5).cast("short").alias("classification"),
        (e % 5 + 1).cast("short").alias("return_number"), F.lit(5).cast("short").alias("num_returns"), u.cast("int").alias("source_id"), (e + 0.5).alias("gps_time"),
    )


def _written(spark: SparkSession, d: str, form: str, parts: int = 3) -> DataFrame:
    """The points of events, written as files of a form and read back by dispatch."""
    path = f"{Scratch(spark, 'files').root}/{form.replace(' ', '-')}"
    writers.write_points(file_points(spark, d).repartition(parts, "point_idx"), path, form)
    return sources.load(spark, path)


def _doubles(*names: str):
    return [F.col(n).cast("double").alias(n) for n in names]


def _ints(*names: str):
    return [F.col(n).cast("int").alias(n) for n in names]


_XYZ = "x, y, z, intensity"


_LAS_SQL = f"WITH {_FP} SELECT event_id, (round(x * 100) * 0.01e0)::FLOAT::DOUBLE AS x, (round(y * 100) * 0.01e0)::FLOAT::DOUBLE AS y, (round(z * 100) * 0.01e0)::FLOAT::DOUBLE AS z, intensity, r, g, b, classification, return_number, 5 AS num_returns, source_id FROM fp"


def _las_points(p: DataFrame) -> DataFrame:
    return p.select((F.col("gps_time") - 0.5).cast("long").alias("event_id"), *_doubles("x", "y", "z", "intensity"), *_ints("r", "g", "b", "classification", "return_number", "num_returns", "source_id"))


@query(_LAS_SQL)
def las_roundtrip(spark, d):
    return _las_points(_written(spark, d, "las"))


@query(_LAS_SQL)
def laz_roundtrip(spark, d):
    """Compressed by tasks, in chunks, and read back by ranges of whole chunks."""
    return _las_points(_written(spark, d, "laz", parts=16))


def _sorted_files(spark: SparkSession, d: str, form: str) -> str:
    """A folder of files in the order of point_idx, each a range of it."""
    path = f"{Scratch(spark, 'files').root}/{form.replace(' ', '-')}"
    points = file_points(spark, d)
    parts = max(4, -(-points.count() // writers.FILE))
    writers.write_points(points.repartitionByRange(parts, "point_idx").sortWithinPartitions("point_idx"), path, form)
    return path


def _las_row(path: str) -> list[tuple]:
    h = las.header(path)
    return [(h["count"], h["format"], h["length"], *h["version"], h["min"][1], h["max"][1])]


def _ply_rows(path: str) -> list[tuple]:
    return [(n, t, k) for k, (n, t) in enumerate(ply_header_of(path)["fields"])]


def _e57_rows(path: str) -> list[tuple]:
    return [(f.name, f.kind, f.bits) for f in e57.layout(path)[2]]


def _each(spark: SparkSession, path: str, read, schema: str) -> DataFrame:
    """Rows that tasks read from the headers of a folder's files."""

    def run(batches):
        for own in batches:
            yield pd.DataFrame([r for p in own["path"] for r in read(p)], columns=[f.split()[0] for f in schema.split(", ")])

    return zones.paths(spark, path, (".las", ".ply", ".e57")).mapInPandas(run, schema)


@query("SELECT count(*) AS n, 3 AS point_format, 34 AS record_bytes, 1 AS major, 2 AS minor, round(min(user_id), 2)::DOUBLE AS min_y, round(max(user_id), 2)::DOUBLE AS max_y FROM events")
def las_header(spark, d):
    """The headers of all files, put together; plain records, however large an intensity is."""
    found = _each(spark, _sorted_files(spark, d, "las plain"), _las_row, "n long, point_format int, record_bytes int, major int, minor int, min_y double, max_y double")
    return found.groupBy("point_format", "record_bytes", "major", "minor").agg(F.sum("n").alias("n"), F.round(F.min("min_y"), 2).alias("min_y"), F.round(F.max("max_y"), 2).alias("max_y"))


@query("SELECT (event_id // 1000)::INT AS part, count(*) AS n, min(event_id) AS first_point, max(event_id) AS last_point FROM events GROUP BY part")
def las_chunks(spark, d):
    """Ranges of records of all files, numbered through."""
    sources.register(spark)
    read = spark.read.format("las").option("part_records", 1000).load(_sorted_files(spark, d, "las"))
    return read.groupBy(F.floor(F.col("point_idx") / 1000).cast("int").alias("part")).agg(F.count("*").alias("n"), F.min("point_idx").alias("first_point"), F.max("point_idx").alias("last_point"))


_LAS = ", ".join(f"(round({c} * 100) * 0.01e0)::FLOAT::DOUBLE AS {c}" for c in "xyz")
_SHOWN = C.View(zoom=0.9, pan_x=500.0, pan_y=300.0, rot=0.4, tilt_x=10.0, tilt_y=-5.0, center=(500.0, 500.0, 250.0))
_ON = f"{_lin(_SHOWN.screen()[0])} AS sx, {_lin(_SHOWN.screen()[1])} AS sy"


@query(f"""WITH {_FP}, l AS (SELECT event_id, {_LAS}, intensity FROM fp), s AS (SELECT *, {_ON} FROM l)
SELECT event_id, round(sx, 6) AS sx, round(sy, 6) AS sy, intensity FROM s WHERE sx BETWEEN 0 AND {_SHOWN.width} AND sy BETWEEN 0 AND {_SHOWN.height}""")
def las_viewport(spark, d):
    """What a viewport shows of LAS files, by their zone map: ranges that it does not meet are not read."""
    path = _sorted_files(spark, d, "las")
    zones.build(spark, path, f"{path}-zones", records=500)
    shown = zones.shown(spark, f"{path}-zones", _SHOWN)
    return shown.select((F.col("gps_time") - 0.5).cast("long").alias("event_id"), F.round("sx", 6).alias("sx"), F.round("sy", 6).alias("sy"), *_doubles("intensity"))


_ZONES = "zones AS (SELECT (event_id // 500)::INT AS zone, count(*) AS n, " + ", ".join(f"min({c}) AS min_{c}, max({c}) AS max_{c}" for c in ("x", "y", "z", "intensity")) + " FROM fp GROUP BY zone)"
_SPAN = ", ".join(f"{v} AS {n}" for form, own in ((_SHOWN.screen()[0], ("sx_min", "sx_max")), (_SHOWN.screen()[1], ("sy_min", "sy_max"))) for v, n in zip(_range_sql(form), own, strict=True))


@query(f"""WITH {_FP}, {_ZONES}, b AS (SELECT *, {_SPAN} FROM zones)
SELECT zone, n, min_x, max_x, min_intensity, max_intensity, round(sx_min, 6) AS sx_min, round(sy_max, 6) AS sy_max, sx_max >= -40 AND sx_min <= {_SHOWN.width} + 40 AND sy_max >= -40 AND sy_min <= {_SHOWN.height} + 40 AS visible FROM b""")
def visible_chunks(spark, d):
    """Zones of a table of points, each with the screen box that it spans and whether a viewport meets it."""
    own = zones.spans(file_points(spark, d), F.floor(F.col("point_idx") / 500).cast("int"))
    seen = zones.visible(own, _SHOWN, margin=40.0)
    return seen.select("zone", "n", *_doubles("min_x", "max_x", "min_intensity", "max_intensity"), F.round("sx_min", 6).alias("sx_min"), F.round("sy_max", 6).alias("sy_max"), "visible")


def _ply(form: str):
    def run(spark, d):
        return _written(spark, d, form).select(*_doubles("x", "y", "z", "intensity"), *_ints("r", "g", "b"))

    return run


for _name, _form in (("ply_binary_roundtrip", "ply"), ("ply_ascii_roundtrip", "ply ascii"), ("ply_gzip_roundtrip", "ply.gz"), ("e57_roundtrip", "e57"), ("e57_bzip2_roundtrip", "e57 bzip2")):
    _run = _ply(_form)
    _run.__name__ = _name
    query(f"WITH {_FP} SELECT {_XYZ}, r, g, b FROM fp")(_run)


@query("SELECT name, type, place::INT AS place FROM (VALUES ('x', '<f4', 0), ('y', '<f4', 1), ('z', '<f4', 2), ('r', 'u1', 3), ('g', 'u1', 4), ('b', 'u1', 5), ('intensity', '<f4', 6)) t(name, type, place)")
def ply_header(spark, d):
    """The properties that the headers of all files agree on."""
    return _each(spark, _sorted_files(spark, d, "ply"), _ply_rows, "name string, type string, place int").distinct()


@query("SELECT name, kind::INT AS kind, bits::INT AS bits FROM (VALUES ('cartesianX', 5, 64), ('cartesianY', 5, 64), ('cartesianZ', 5, 64), ('intensity', 5, 64), ('colorRed', 4, 32), ('colorGreen', 4, 32), ('colorBlue', 4, 32)) t(name, kind, bits)")
def e57_fields(spark, d):
    """The fields that the trees of all files agree on."""
    return _each(spark, _sorted_files(spark, d, "e57"), _e57_rows, "name string, kind int, bits int").distinct()


@query(f"WITH {_FP} SELECT {_XYZ} FROM fp")
def rxp_roundtrip(spark, d):
    return _written(spark, d, "rxp").select(*_doubles("x", "y", "z", "intensity"))


@query(f"WITH {_FP} SELECT {_XYZ}, true AS has_file FROM fp WHERE event_id % 10 <> 0")
def xyz_roundtrip(spark, d):
    path = f"{Scratch(spark, 'files').root}/points.xyz"
    p = file_points(spark, d).withColumn("intensity", F.when(F.col("point_idx") % 10 != 0, F.col("intensity")))
    writers.write_xyz(p, path, "# ")
    return sources.load(spark, path).select(*_doubles("x", "y", "z", "intensity"), F.col("src").isNotNull().alias("has_file"))


@query("SELECT path, format FROM (VALUES ('a.ply', 'ply'), ('a.PLY.gz', 'ply'), ('b.las', 'las'), ('b.LAZ', 'las'), ('c.xyz', 'xyz'), ('c.txt', 'xyz'), ('c.pts', 'xyz'), ('d.rxp', 'rxp'), ('e.E57', 'e57'), ('x/metadata.json', 'octree'), ('f.obj', NULL)) t(path, format)")
def format_dispatch(spark, d):
    paths = ["a.ply", "a.PLY.gz", "b.las", "b.LAZ", "c.xyz", "c.txt", "c.pts", "d.rxp", "e.E57", "x/metadata.json", "f.obj"]
    return spark.createDataFrame([(p, sources.format_of(p)) for p in paths], "path string, format string")


@query("""WITH l AS (SELECT user_id::VARCHAR || '.txt' AS src, event_id, CASE event_id % 3 WHEN 0 THEN '1 2 3' WHEN 1 THEN '1 2 3 4' ELSE '1,2,3,4,5,6' END AS line, event_id % 4 = 0 AS off FROM events)
SELECT src, CASE len(regexp_split_to_array(arg_min(line, event_id), '[\\s,]+')) WHEN 3 THEN 'xyz' WHEN 4 THEN 'xyzi' ELSE 'xyzrgb' END AS kind FROM l WHERE NOT off GROUP BY src""")
def first_line_kind(spark, d):
    from ..sources.xyz import line_kinds

    e = F.col("event_id")
    text = F.when(e % 3 == 0, "1 2 3").when(e % 3 == 1, "1 2 3 4").otherwise("1,2,3,4,5,6")
    lines = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.col("user_id").cast("string"), F.lit(".txt")).alias("src"), e.alias("place"), F.when(e % 4 == 0, F.concat(F.lit("# "), text)).otherwise(text).alias("value"))
    return line_kinds(lines)


@query("""WITH t AS (SELECT doc_id, strlen(text) AS size, hex(encode(text)) AS h FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, size, least(strlen(h) // 2, 1024) AS n, h FROM t),
p AS (SELECT doc_id, size, list_reduce(list_transform(range(n), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT), lambda a, x: (a * 31 + x) & 4294967295, 0::BIGINT) AS v FROM b)
SELECT doc_id, lower(to_base(abs(CASE WHEN v >= 2147483648 THEN v - 4294967296 ELSE v END), 36)) || '_' || lower(to_base(size, 36)) AS name FROM p""")
def file_fingerprint(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet").filter("text is not null")
    raw = F.encode(F.col("text"), "utf-8")
    return t.select("doc_id", cache.fingerprint(raw, F.octet_length("text")).alias("name"))


@query("SELECT event_id, (user_id % 100)::INT AS chunk, user_id FROM events WHERE user_id % 100 IN (3, 57)")
def chunk_store(spark, d):
    path = f"{Scratch(spark, 'chunks').root}/store"
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", (F.col("user_id") % 100).cast("int").alias("chunk"))
    cache.store_chunks(e, path)
    return spark.read.parquet(path).filter(F.col("chunk").isin(3, 57)).select("event_id", F.col("chunk").cast("int").alias("chunk"), "user_id")


@query("SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'memory' WHEN user_id % 5 = 0 THEN 'store' ELSE 'file' END AS tier FROM events")
def chunk_tiers(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id")
    return cache.found_in(e, e.filter("user_id % 3 = 0"), e.filter("user_id % 5 = 0"), "user_id").select("event_id", "tier")


@query("""WITH t AS (SELECT event_id, 1024 << (event_id % 6)::INT AS side, user_id * 10 * 1048576 AS buf FROM events),
c AS (SELECT event_id, CASE WHEN side >= 16384 THEN 8192 WHEN side >= 8192 THEN 4096 WHEN side >= 4096 THEN 2048 ELSE greatest(512, CASE WHEN buf > 0 THEN buf // 1048576 ELSE 512 END) END AS mb FROM t)
SELECT event_id, least(50000000, floor(200000 * (mb / 512e0)))::BIGINT AS capacity, floor(least(50000000, floor(200000 * (mb / 512e0))) * 0.6e0)::BIGINT AS budget FROM c""")
def capacity_tiers(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    side, buf = F.expr("shiftleft(1024, cast(event_id % 6 as int))"), F.col("user_id") * 10 * 1048576
    cap = cache.batch_capacity(side, buf)
    return e.select("event_id", cap.alias("capacity"), cache.auto_budget(cap).alias("budget"))


@query("""WITH a AS (SELECT user_id % 10 AS k, event_id AS seq, 20 + event_id % 30 AS n FROM events), s AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY seq ROWS UNBOUNDED PRECEDING) - n AS o, min(n) OVER (PARTITION BY k) AS m FROM a)
SELECT k, seq, seq AS id, CAST(o AS BIGINT) AS "offset" FROM s""")
def first_fit_append(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    log = e.select((F.col("user_id") % 10).alias("k"), F.col("event_id").alias("seq"), F.lit("alloc").alias("kind"), F.col("event_id").alias("id"), (20 + F.col("event_id") % 30).alias("count"))
    return cache.first_fit(log, "k", 1 << 60)


@query("""WITH a AS (SELECT user_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events) SELECT k, (2 * i)::BIGINT AS seq, i::BIGINT AS id, CASE WHEN i % 4 < 2 THEN 10 * (i % 4) ELSE 10 * (i % 2) END::BIGINT AS "offset" FROM a""")
def first_fit_reuse(spark, d):
    """Regions of ten points, each freed when the next but one comes: two places are used in turn."""
    from pyspark.sql import Window as W

    i = F.row_number().over(W.partitionBy("k").orderBy("event_id")) - 1
    a = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("k"), "event_id").select("k", i.alias("i"))
    took = a.select("k", (F.col("i") * 2).alias("seq"), F.lit("alloc").alias("kind"), F.col("i").alias("id"), F.lit(10).alias("count"))
    gave = a.filter("i > 0").select("k", (F.col("i") * 2 + 1).alias("seq"), F.lit("free").alias("kind"), (F.col("i") - 1).alias("id"), F.lit(10).alias("count"))
    return cache.first_fit(took.union(gave), "k", 100)


@query("""WITH t AS (SELECT event_id, value AS a, cos(value) AS c, sin(value) AS s FROM events) SELECT event_id, round(-(c + s) / sqrt((c + s) * (c + s) + (c - s) * (c - s) + 1), 6) AS dx, round(-(c - s) / sqrt((c + s) * (c + s) + (c - s) * (c - s) + 1), 6) AS dy, round(1 / sqrt((c + s) * (c + s) + (c - s) * (c - s) + 1), 6) AS dz FROM t""")
def view_direction(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", *[F.round(c, 6).alias(n) for c, n in zip(C.view_direction(F.col("value")), ("dx", "dy", "dz"), strict=True)])


_TAU = "6.283185307179586::DOUBLE"


@query(f"""WITH t AS (SELECT event_id, user_id, value / 100 AS a, value FROM events)
SELECT event_id, round((a + 2 * ({_TAU} / 8)) - floor((a + 2 * ({_TAU} / 8)) / {_TAU}) * {_TAU}, 6) AS left2, round((a - {_TAU} / 4) - floor((a - {_TAU} / 4) / {_TAU}) * {_TAU}, 6) AS right1,
round((0.7853981633974483::DOUBLE - user_id % 8 * ({_TAU} / 8)) - floor((0.7853981633974483::DOUBLE - user_id % 8 * ({_TAU} / 8)) / {_TAU}) * {_TAU}, 6) AS view_angle,
greatest(-89e0, least(89e0, user_id + (value - 245) / 2)) AS tilt FROM t""")
def camera_turns(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("a", F.col("value") / 100)
    return e.select("event_id", F.round(C.turned_step(F.col("a"), 2, 8), 6).alias("left2"), F.round(C.turned_step(F.col("a"), -1, 4), 6).alias("right1"), F.round(C.heading(F.col("user_id") % 8, 8), 6).alias("view_angle"), C.tilted(F.col("user_id").cast("double"), (F.col("value") - 245) / 2).alias("tilt"))


@query("""WITH t AS (SELECT event_id, value / 70 AS a, sqrt(user_id + 2.5e0) * 7e0 AS r, (event_id % 200 - 100)::DOUBLE AS dx, (event_id % 90 - 45)::DOUBLE AS dy, value / 100 AS phi, event_id % 7 - 3e0 AS ahead FROM events),
p AS (SELECT *, greatest(0.1e0, least(1e5, r * (1 + dy / 40))) AS radius, greatest(0.01e0, least(3.141592653589793::DOUBLE - 0.01e0, phi + dy / 60)) AS angle FROM t)
SELECT event_id, round(radius, 6) AS radius, round(angle, 6) AS phi, round(dx + dx * radius * 0.0005e0 * cos(a) - ahead * sin(a), 6) AS x, round(1 + dy * radius * 0.0005e0 + dx, 6) AS y, round(dy - dx * radius * 0.0005e0 * sin(a) - ahead * cos(a), 6) AS z FROM p""")
def orbit_moves(spark, d):
    """Cameras that are dollied, turned, panned, and moved ahead and up."""
    e = spark.read.parquet(f"{d}/events.parquet")
    theta, dx, dy = F.col("value") / 70, (F.col("event_id") % 200 - 100).cast("double"), (F.col("event_id") % 90 - 45).cast("double")
    radius, phi = C.dollied(F.sqrt(F.col("user_id") + 2.5) * 7.0, 1 + dy / 40), C.orbited(F.col("value") / 100, dy / 60)
    at = C.moved(theta, C.panned(theta, radius, (dx, F.lit(1.0), dy), dx, dy), F.col("event_id") % 7 - F.lit(3.0), F.lit(0.0), dx)
    return e.select("event_id", *[F.round(c, 6).alias(n) for n, c in zip(("radius", "phi", "x", "y", "z"), (radius, phi, *at), strict=True)])


@query("SELECT name, tilt_x, tilt_y, round(0.7853981633974483::DOUBLE, 6) AS rot FROM (VALUES ('top', 0e0, 0e0), ('front', 90e0, 0e0), ('right', 90e0, -90e0), ('back', -90e0, 0e0)) t(name, tilt_x, tilt_y)")
def snap_presets(spark, d):
    views = [(n, C.preset(C.View(), n)) for n in C.PRESETS]
    return spark.createDataFrame([(n, v.tilt_x, v.tilt_y, round(v.rot, 6)) for n, v in views], "name string, tilt_x double, tilt_y double, rot double")


@query("""WITH t AS (SELECT event_id, (event_id % 41 - 20) / 19e0 AS u, (event_id // 41 % 41 - 20) / 19e0 AS v, value / 500 AS c FROM events), s AS (SELECT *, u * u + v * v AS q FROM t)
SELECT event_id, round(CASE WHEN q > 1 THEN 0e0 ELSE exp(-q * 3e0) + exp(-q * 1.5e0) * 0.5e0 * 0.8e0 END, 6) AS alpha, round(c * (1 - 0.24e0) + (c * 1.3e0 + 0.1e0) * 0.24e0, 6) AS channel FROM s""")
def splat_glow(spark, d):
    u, v = (F.col("event_id") % 41 - 20) / 19, (F.floor(F.col("event_id") / 41) % 41 - 20) / 19
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.round(S.glow(u, v, 0.8), 6).alias("alpha"), F.round(S.glow_color(F.col("value") / 500, 0.8), 6).alias("channel"))


_RING = [(100 * math.cos(k * math.tau / 32), 100 * math.sin(k * math.tau / 32), -math.sin(k * math.tau / 32), math.cos(k * math.tau / 32), 100.0) for k in range(32)]
_RING_SQL = ", ".join(f"({k}, {x!r}::DOUBLE, {y!r}::DOUBLE, {a!r}::DOUBLE, {b!r}::DOUBLE)" for k, (x, y, a, b, _) in enumerate(_RING))


@query(f"""WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS session, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, value - 245 AS sx, (event_id * 7 % 300 - 150)::DOUBLE AS sy, event_type IN ('view', 'click') AS turning, event_id % 4 AS axis FROM events),
m AS (SELECT *, coalesce(sx - lag(sx) OVER w, 0) AS dx, coalesce(sy - lag(sy) OVER w, 0) AS dy FROM e WINDOW w AS (PARTITION BY session ORDER BY event_id)),
near AS (SELECT session, k, arg_min(tx, row(pow(sx - x, 2) + pow(sy - y, 2), j)) AS tx, arg_min(ty, row(pow(sx - x, 2) + pow(sy - y, 2), j)) AS ty FROM m, (VALUES {_RING_SQL}) r(j, x, y, tx, ty) GROUP BY session, k),
s AS (SELECT m.session, m.k, turning, axis, (dx * tx + dy * ty) / 100e0 * 180 / 3.141592653589793::DOUBLE AS turn, 1 + dx * 0.008e0 AS grow FROM m JOIN near USING (session, k)),
f AS (SELECT session, 0::BIGINT AS k, [0e0, 0e0, 0e0] AS r, [1e0, 1e0, 1e0] AS z FROM s GROUP BY session UNION ALL
SELECT f.session, s.k, list_transform([0, 1, 2], lambda i: CASE WHEN turning AND axis = i THEN (r[i + 1] + turn) - trunc((r[i + 1] + turn) / 360e0) * 360e0 ELSE r[i + 1] END),
list_transform([0, 1, 2], lambda i: CASE WHEN NOT turning AND axis IN (i, 3) THEN greatest(0.01e0, least(100e0, z[i + 1] * grow)) ELSE z[i + 1] END) FROM f JOIN s ON s.session = f.session AND s.k = f.k + 1)
SELECT session, k AS moves, round(r[1], 5) AS rot_x, round(r[2], 5) AS rot_y, round(r[3], 5) AS rot_z, round(z[1], 5) AS scale_x, round(z[2], 5) AS scale_y, round(z[3], 5) AS scale_z FROM f QUALIFY k = max(k) OVER (PARTITION BY session)""")
def drag_fold(spark, d):
    axis = F.element_at(F.array(*[F.lit(a) for a in ("x", "y", "z", "center")]), (F.col("event_id") % 4 + 1).cast("int"))
    log = spark.read.parquet(f"{d}/events.parquet").select(
        F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), F.when(F.col("event_type").isin("view", "click"), "rotate").otherwise("scale").alias("mode"),
        axis.alias("axis"), (F.col("value") - 245).alias("sx"), (F.col("event_id") * 7 % 300 - 150).cast("double").alias("sy"),
    )
    out = control.drag_fold(log, _RING)
    return out.select("session", "moves", *[F.round(c, 5).alias(c) for c in ("rot_x", "rot_y", "rot_z", "scale_x", "scale_y", "scale_z")])


def _dataset(spark, d) -> str:
    path = f"{Scratch(spark, 'files').root}/octree"
    octree_dataset.write_dataset(pts(spark, d).withColumn("intensity", F.col("intensity") / 0.1), path, LO, HI)
    return f"{path}/metadata.json"


@query(f"WITH {PTS} SELECT x::FLOAT::DOUBLE AS x, y::FLOAT::DOUBLE AS y, z::FLOAT::DOUBLE AS z, round(intensity / 0.1e0, 3) AS intensity, classification::INT AS classification, 180 AS r FROM pts")
def octree_points_roundtrip(spark, d):
    return sources.load(spark, _dataset(spark, d)).select(*_doubles("x", "y", "z"), F.round(F.col("intensity").cast("double"), 3).alias("intensity"), *_ints("classification", "r"))


_FILE_NODES = _nodes_sql(5000)
_SPANS = "l AS (SELECT name, num_points * 19 AS s, sum(num_points * 19) OVER (ORDER BY name) - num_points * 19 AS o FROM nodes WHERE is_leaf)"


@query(f"WITH {_FILE_NODES}, {_SPANS} SELECT n.name, depth, num_points, child_mask, is_leaf, min(o)::BIGINT AS byte_offset, CASE WHEN is_leaf THEN sum(s) ELSE 0 END::BIGINT AS byte_size FROM nodes n JOIN l ON starts_with(l.name, n.name) GROUP BY n.name, depth, num_points, child_mask, is_leaf")
def octree_hierarchy_roundtrip(spark, d):
    return octree_dataset.read_nodes(spark, _dataset(spark, d))


@query(f"WITH {_FILE_NODES} SELECT '2.0' AS version, 0e0 AS lx, 1000e0 AS ux, round(sqrt(3e6), 6) AS spacing, 4::BIGINT AS attributes, (SELECT count(*) FROM nodes) AS nodes")
def octree_metadata(spark, d):
    m = spark.read.option("multiLine", True).json(_dataset(spark, d))
    return m.select("version", F.col("boundingBox.lx").alias("lx"), F.col("boundingBox.ux").alias("ux"), F.round("spacing", 6).alias("spacing"), F.size("attributes").cast("long").alias("attributes"), F.col("hierarchy.firstChunkSize").alias("nodes"))


@query(f"WITH {_FILE_NODES}, l AS (SELECT name FROM nodes WHERE is_leaf AND starts_with(name, 'r3')) SELECT l.name AS leaf, count(*) AS n, min(x)::FLOAT::DOUBLE AS lo, max(x)::FLOAT::DOUBLE AS hi FROM paths JOIN l ON starts_with(path, l.name) GROUP BY l.name")
def octree_node_range(spark, d):
    """The filter reaches the reader, which leaves out the blocks of all other nodes."""
    path = _dataset(spark, d)
    sources.register(spark)
    read = spark.read.format("octree").load(path).filter(F.col("src").startswith("r3"))
    return read.groupBy(F.col("src").alias("leaf")).agg(F.count("*").alias("n"), F.min("x").cast("double").alias("lo"), F.max("x").cast("double").alias("hi"))


@query("SELECT k, round(2e0 * f, 6) AS zoom, round(px - (px - 10e0) * f, 6) AS pan_x, round(py - (py - 20e0) * f, 6) AS pan_y FROM (VALUES (0, 640e0, 360e0, 1.1e0), (1, 0e0, 0e0, 0.5e0), (2, 10e0, 20e0, 3e0), (3, -50e0, 900e0, 1e0)) t(k, px, py, f)")
def zoom_at(spark, d):
    asked = [(0, 640.0, 360.0, 1.1), (1, 0.0, 0.0, 0.5), (2, 10.0, 20.0, 3.0), (3, -50.0, 900.0, 1.0)]
    views = [(k, C.zoom_at(C.View(zoom=2.0, pan_x=10.0, pan_y=20.0), x, y, f)) for k, x, y, f in asked]
    return spark.createDataFrame([(k, round(v.zoom, 6), round(v.pan_x, 6), round(v.pan_y, 6)) for k, v in views], "k int, zoom double, pan_x double, pan_y double")


@query("""WITH t AS (SELECT k, tilt, k * 0.37e0 / (3.141592653589793::DOUBLE / 2) AS turn FROM (SELECT unnest(range(17))::INT AS k), (SELECT unnest([-50, 0, 50]) AS tilt)),
s AS (SELECT *, (floor(turn)::INT % 4) AS a, ((floor(turn)::INT + 1) % 4) AS b, turn - floor(turn) AS f FROM t)
SELECT k, tilt, round([5e0, 10, 5, 0][a + 1] + ([5e0, 10, 5, 0][b + 1] - [5e0, 10, 5, 0][a + 1]) * f, 6) AS cx, CASE WHEN tilt > 45 THEN 20e0 WHEN tilt < -45 THEN 0e0 ELSE 10e0 END AS cy,
round([20e0, 10, 0, 10][a + 1] + ([20e0, 10, 0, 10][b + 1] - [20e0, 10, 0, 10][a + 1]) * f, 6) AS cz FROM s""")
def face_center(spark, d):
    rows = [(k, tilt, *C.face_center((0.0, 0.0, 0.0), (10.0, 20.0, 30.0), k * 0.37, tilt)) for k in range(17) for tilt in (-50, 0, 50)]
    return spark.createDataFrame([(k, t, round(x, 6), float(y), round(z, 6)) for k, t, x, y, z in rows], "k int, tilt int, cx double, cy double, cz double")
