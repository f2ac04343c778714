"""Queries over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bindings as B
from ..functions import camera as C
from ..functions import style as S
from ..operators import cache, edits, grid, growing, lod, octree, pick, raster, stats
from ..scratch import Scratch
from ..streaming import control

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SIDE = 1000.0
LO, HI = (0.0,) * 3, (SIDE,) * 3
LEAF = 500
VIEW = C.View(zoom=0.6, pan_x=600.0, pan_y=380.0, rot=0.7, tilt_x=10.0, tilt_y=-5.0, center=(500.0, 500.0, 500.0))
ORBIT = C.Orbit(radius=1800.0, target=(500.0, 500.0, 500.0))
EMB_CAM = C.Orbit(radius=3.0, target=(0.0, 0.0, 0.0))

# SQL: the bindings, and forms of the views above.
LI = """li AS (
  SELECT row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_extendedprice) - 1 AS point_idx,
         l_quantity::FLOAT::DOUBLE AS x, l_extendedprice::FLOAT::DOUBLE AS y, l_partkey::FLOAT::DOUBLE AS z, l_discount::FLOAT::DOUBLE AS intensity,
         CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS classification FROM lineitem)"""
EV = """ev AS (
  SELECT event_id AS point_idx, ((epoch_us(ts) - min(epoch_us(ts)) OVER ()) / 1e6)::FLOAT::DOUBLE AS x, user_id::FLOAT::DOUBLE AS y,
         value::FLOAT::DOUBLE AS z, value::FLOAT::DOUBLE AS intensity,
         CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS classification FROM events)"""
EMB = """emb AS (
  SELECT vec_id AS point_idx, embedding[1]::FLOAT::DOUBLE AS x, embedding[2]::FLOAT::DOUBLE AS y, embedding[3]::FLOAT::DOUBLE AS z,
         embedding[4]::FLOAT::DOUBLE AS intensity, label AS classification FROM embeddings)"""
_SCALE = ", ".join(f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) * 1000e0 AS {c}" for c in "xyz")
PTS = f"{LI}, pts AS (SELECT point_idx, {_SCALE}, intensity, classification FROM li)"
_CELLS = ", ".join(f"least(4095, floor({c} / 1000e0 * 4096e0))::INT AS i{c}" for c in "xyz")
_DIGITS = " || ".join(f"((((ix >> {11 - k}) & 1) * 4 + ((iy >> {11 - k}) & 1) * 2 + ((iz >> {11 - k}) & 1))::VARCHAR)" for k in range(12))
PATHS = f"{PTS}, cells AS (SELECT *, {_CELLS} FROM pts), paths AS (SELECT *, 'r' || {_DIGITS} AS path FROM cells)"


def _nodes_sql(leaf: int) -> str:
    box = ", ".join(
        f"list_sum(list_transform(range(1, length(name)::BIGINT), lambda i: ((substr(name, (i + 1)::INT, 1)::INT >> {2 - k}) & 1) * (1 << (length(name) - 1 - i)::INT)))" + f" AS c{c}" for k, c in enumerate("xyz")
    )
    sides = ", ".join(f"coalesce(c{c}, 0) * (1000e0 / pow(2e0, depth)) AS min_{c}, (coalesce(c{c}, 0) + 1) * (1000e0 / pow(2e0, depth)) AS max_{c}" for c in "xyz")
    return f"""{PATHS}, deep AS (SELECT path, count(*) AS n FROM paths GROUP BY path),
every AS (SELECT substr(path, 1, d + 1) AS name, d AS depth, sum(n)::BIGINT AS num_points FROM deep, (SELECT unnest(range(13))::INT AS d) GROUP BY ALL),
kept AS (SELECT e.* FROM every e LEFT JOIN every p ON p.depth = e.depth - 1 AND p.name = substr(e.name, 1, e.depth) WHERE e.depth = 0 OR p.num_points > {leaf}),
masks AS (SELECT substr(name, 1, depth) AS up, bit_or((1 << substr(name, -1, 1)::INT)) AS m FROM kept WHERE depth > 0 GROUP BY 1),
bare AS (SELECT name, depth, num_points, coalesce(m, 0)::INT AS child_mask, m IS NULL AS is_leaf FROM kept LEFT JOIN masks ON up = name),
placed AS (SELECT *, {box} FROM bare),
nodes AS (SELECT *, sqrt(3e0 * pow(1000e0 / pow(2e0, depth), 2)) / 2e0 AS radius FROM (SELECT name, depth, num_points, child_mask, is_leaf, {sides} FROM placed))"""


NODES = _nodes_sql(LEAF)


def _lin(form, x="x", y="y", z="z") -> str:
    a, b, c, d = (float(v) for v in form)
    return f"({x} * ({a!r}::DOUBLE) + {y} * ({b!r}::DOUBLE) + {z} * ({c!r}::DOUBLE) + ({d!r}::DOUBLE))"


def _range_sql(form) -> tuple[str, str]:
    low = high = f"({float(form[3])!r}::DOUBLE)"
    for a, c in zip(form[:3], "xyz", strict=True):
        p, q = (f"min_{c}", f"max_{c}") if a >= 0 else (f"max_{c}", f"min_{c}")
        low, high = f"({low} + {p} * ({float(a)!r}::DOUBLE))", f"({high} + {q} * ({float(a)!r}::DOUBLE))"
    return low, high


FX, FY, FD = VIEW.screen()
BOXES = f"boxes AS (SELECT *, {_range_sql(FX)[0]} AS sx_min, {_range_sql(FX)[1]} AS sx_max, {_range_sql(FY)[0]} AS sy_min, {_range_sql(FY)[1]} AS sy_max FROM nodes)"


def _seen(margin: float) -> str:
    return f"sx_max >= -{margin} AND sx_min <= {VIEW.width} + {margin} AND sy_max >= -{margin} AND sy_min <= {VIEW.height} + {margin}"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def pts(spark: SparkSession, d: str, index: bool = True) -> DataFrame:
    return B.rescaled(B.points_li(spark, d, index))


def pathed(spark: SparkSession, d: str, index: bool = False) -> DataFrame:
    return octree.with_path(pts(spark, d, index), LO, HI)


def tree(spark: SparkSession, d: str) -> DataFrame:
    return octree.with_box(octree.nodes(pathed(spark, d), LEAF), LO, HI)


def r6(*names: str):
    return [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]


def s6(*names: str) -> str:
    return ", ".join(f"round(({n})::DOUBLE, 6) AS {n}" for n in names)


_B = "min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z"


@query(f"WITH {LI} SELECT count(*) AS n, {_B}, min(intensity) AS i_min, CASE WHEN max(intensity) = min(intensity) THEN max(intensity) + 1 ELSE max(intensity) END AS i_max, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, (min(z) + max(z)) / 2 AS cz FROM li")
def cloud_bounds(spark, d):
    return stats.bounds(B.points_li(spark, d))


@query(f"WITH {EV} SELECT count(*) AS n, {_B}, min(intensity) AS i_min, CASE WHEN max(intensity) = min(intensity) THEN max(intensity) + 1 ELSE max(intensity) END AS i_max, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, (min(z) + max(z)) / 2 AS cz FROM ev")
def cloud_bounds_events(spark, d):
    return stats.bounds(B.points_ev(spark, d))


@query(f"""WITH {LI} SELECT count(*) AS n, CASE WHEN count(*) >= 1000000 THEN format('{{:.1f}}M', count(*) / 1e6) WHEN count(*) >= 1000 THEN round(count(*) / 1000e0)::BIGINT || 'k' ELSE count(*)::VARCHAR END AS label,
true AS has_intensity, false AS has_color, count(DISTINCT classification) AS classes, count(*) * 24 AS gpu_bytes FROM li""")
def cloud_summary(spark, d):
    n = F.count("*")
    out = B.points_li(spark, d).agg(n.alias("n"), F.countDistinct("classification").alias("classes"))
    return out.select("n", stats.short_count(F.col("n")).alias("label"), F.lit(True).alias("has_intensity"), F.lit(False).alias("has_color"), "classes", (F.col("n") * cache.POINT_BYTES).alias("gpu_bytes"))


@query(f"WITH {LI} SELECT count(*) AS n, round(cbrt(greatest((max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z)), 1e-6) / count(*)), 6) AS spacing FROM li")
def cloud_spacing(spark, d):
    return stats.spacing(stats.bounds(B.points_li(spark, d))).select("n", *r6("spacing"))


@query(f"WITH {LI} SELECT point_idx, round((intensity - min(intensity) OVER ()) / (max(intensity) OVER () - min(intensity) OVER ()), 6) AS intensity FROM li")
def intensity_minmax(spark, d):
    return stats.normalised(B.points_li(spark, d, True)).select("point_idx", *r6("intensity"))


@query(f"WITH {LI}, t AS (SELECT point_idx, (intensity - min(intensity) OVER ()) / (max(intensity) OVER () - min(intensity) OVER ()) AS i FROM li) SELECT point_idx, floor(round(i * 255, 6))::INT AS gray FROM t")
def gray_from_intensity(spark, d):
    return stats.normalised(B.points_li(spark, d, True)).select("point_idx", F.floor(F.round(F.col("intensity") * 255, 6)).cast("int").alias("gray"))


@query(f"WITH {EV} SELECT (point_idx // 1000)::INT AS chunk, count(*) AS n, min(intensity) AS i_min, max(intensity) AS i_max, min(z) AS z_min, max(z) AS z_max FROM ev GROUP BY 1")
def chunk_partial_minmax(spark, d):
    chunk = F.floor(F.col("point_idx") / 1000).cast("int")
    return B.points_ev(spark, d).groupBy(chunk.alias("chunk")).agg(F.count("*").alias("n"), F.min("intensity").alias("i_min"), F.max("intensity").alias("i_max"), F.min("z").alias("z_min"), F.max("z").alias("z_max"))


@query("SELECT event_id, least(255, floor(user_id * 700 / 256e0))::INT AS r, least(255, floor(event_id % 65536 / 256e0))::INT AS g, floor(CASE WHEN value <= 1 THEN value * 255 ELSE least(value, 255e0) END)::INT AS b FROM events")
def color_clamp_scale(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    v = F.col("value")
    return e.select("event_id", S.byte_from_16(F.col("user_id") * 700).alias("r"), S.byte_from_16(F.col("event_id") % 65536).alias("g"), S.bytes_from_unit(v, v, v)[0].alias("b"))


@query("SELECT event_id, (user_id & 7)::INT AS return_number, ((user_id >> 3) & 7)::INT AS num_returns, ((user_id >> 4) & 15)::INT AS hi, (user_id & 15)::INT AS lo FROM events")
def bitfields(spark, d):
    u = F.col("user_id")
    return spark.read.parquet(f"{d}/events.parquet").select(
        "event_id", u.bitwiseAND(F.lit(7)).cast("int").alias("return_number"), F.shiftright(u, 3).bitwiseAND(F.lit(7)).cast("int").alias("num_returns"),
        F.shiftright(u, 4).bitwiseAND(F.lit(15)).cast("int").alias("hi"), u.bitwiseAND(F.lit(15)).cast("int").alias("lo"),
    )


@query("SELECT event_id, round(user_id * 0.001e0 + 10e0, 9) AS x, round((event_id - 500) * 0.01e0 - 3e0, 9) AS y FROM events")
def dequantize(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.round(F.col("user_id") * 0.001 + 10.0, 9).alias("x"), F.round((F.col("event_id") - 500) * 0.01 - 3.0, 9).alias("y"))


@query(f"WITH {EV}, t AS (SELECT point_idx, CASE WHEN point_idx % 7 = 0 THEN 0e0 ELSE x END AS x, CASE WHEN point_idx % 11 = 0 THEN 'inf'::DOUBLE ELSE y END AS y, CASE WHEN point_idx % 5 = 0 THEN 0e0 ELSE z END AS z FROM ev) SELECT * FROM t WHERE isfinite(x) AND isfinite(y) AND isfinite(z)")
def finite_filter(spark, d):
    p = B.points_ev(spark, d).select(
        "point_idx", F.when(F.col("point_idx") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("x")).alias("x"),
        F.when(F.col("point_idx") % 11 == 0, F.lit(float("inf"))).otherwise(F.col("y")).alias("y"), F.when(F.col("point_idx") % 5 == 0, F.lit(None)).otherwise(F.col("z")).alias("z"),
    )
    return stats.finite(p)


def _cell_sql(src: str) -> str:
    g = ", ".join(f"least(127, floor(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) * 128))::INT AS g{c}" for c in "xy")
    return f"cells0 AS (SELECT *, {g} FROM {src}), gc AS (SELECT *, gy * 128 + gx AS cell FROM cells0)"


@query(f"WITH {LI}, {_cell_sql('li')} SELECT gx, gy, count(*) AS n FROM gc GROUP BY gx, gy")
def grid_histogram(spark, d):
    return grid.histogram(B.points_li(spark, d))


@query(f"WITH {EV}, {_cell_sql('ev')}, t AS (SELECT cell, count(*) AS n FROM gc GROUP BY cell) SELECT cell, n, (sum(n) OVER (ORDER BY cell) - n)::BIGINT AS start FROM t")
def grid_csr_offsets(spark, d):
    return grid.offsets(B.points_ev(spark, d))


@query(f"WITH {EV}, {_cell_sql('ev')} SELECT point_idx, cell, (row_number() OVER (PARTITION BY cell ORDER BY point_idx) - 1)::INT AS rank, (row_number() OVER (ORDER BY cell, point_idx) - 1)::BIGINT AS place FROM gc")
def grid_point_rank(spark, d):
    return grid.ranked(B.points_ev(spark, d)).select("point_idx", "cell", "rank", "place")


@query(f"WITH {PATHS} SELECT point_idx, path FROM paths")
def octree_path(spark, d):
    return pathed(spark, d, True).select("point_idx", "path")


@query(f"WITH {NODES} SELECT name, depth, num_points, is_leaf FROM nodes")
def octree_nodes(spark, d):
    return octree.nodes(pathed(spark, d), LEAF).select("name", "depth", "num_points", "is_leaf")


@query(f"WITH {NODES} SELECT name, num_points, (row_number() OVER (ORDER BY name))::INT AS dfs FROM nodes WHERE is_leaf")
def octree_leaves(spark, d):
    leaves = octree.nodes(pathed(spark, d), LEAF).filter("is_leaf").select("name", "num_points")
    return B.numbered(leaves, ["name"], "dfs").withColumn("dfs", (F.col("dfs") + 1).cast("int"))


@query(f"WITH {NODES} SELECT name, child_mask FROM nodes")
def octree_child_mask(spark, d):
    return octree.nodes(pathed(spark, d), LEAF).select("name", "child_mask")


@query(f"WITH {NODES} SELECT count(*) AS total_nodes, count(*) FILTER (WHERE is_leaf) AS leaf_nodes, sum(num_points) FILTER (WHERE is_leaf)::BIGINT AS total_points, max(depth) AS max_depth, max(num_points) FILTER (WHERE is_leaf) AS max_leaf_points FROM nodes")
def octree_stats(spark, d):
    return octree.statistics(octree.nodes(pathed(spark, d), LEAF))


@query(f"WITH {_nodes_sql(5000)} SELECT name, depth, num_points, child_mask FROM nodes")
def octree_nodes_converter(spark, d):
    return octree.nodes(pathed(spark, d), octree.LEAF_FILE).select("name", "depth", "num_points", "child_mask")


_BOX = [f"{e}_{c}" for c in "xyz" for e in ("min", "max")]


@query(f"WITH {NODES} SELECT name, {s6(*_BOX, 'radius')}, round(sqrt(3e6) / pow(2e0, depth), 6) AS spacing FROM nodes")
def node_boxes(spark, d):
    return tree(spark, d).select("name", *r6(*_BOX, "radius", "spacing"))


@query(f"WITH {NODES} SELECT p.name, c.name AS child, substr(c.name, -1, 1)::INT AS digit FROM nodes p JOIN nodes c ON substr(c.name, 1, length(c.name) - 1) = p.name AND c.depth > 0")
def node_children(spark, d):
    n = octree.nodes(pathed(spark, d), LEAF).select("name", "depth")
    c = n.filter("depth > 0").select(F.col("name").alias("child"), F.expr("substring(name, 1, depth)").alias("_up"), F.substring("name", -1, 1).cast("int").alias("digit"))
    return n.join(c, n["name"] == c["_up"]).select("name", "child", "digit")


@query(f"WITH {NODES}, l AS (SELECT name, num_points AS n FROM nodes WHERE is_leaf) SELECT point_idx, l.name AS leaf FROM paths JOIN l ON starts_with(path, l.name)")
def point_leaf(spark, d):
    p = pathed(spark, d, True)
    return octree.leaf_of(p, octree.nodes(pathed(spark, d), LEAF)).select("point_idx", "leaf")


@query(f"WITH {NODES} SELECT name, (num_points * 19) AS byte_size, (sum(num_points * 19) OVER (ORDER BY name) - num_points * 19)::BIGINT AS byte_offset FROM nodes WHERE is_leaf")
def leaf_byte_offsets(spark, d):
    n = octree.nodes(pathed(spark, d), LEAF)
    leaves = n.filter("is_leaf").select("name")
    return octree.byte_offsets(n).join(leaves, "name", "left_semi")


@query(f"WITH {NODES}, l AS (SELECT name, num_points * 19 AS s, sum(num_points * 19) OVER (ORDER BY name) - num_points * 19 AS o FROM nodes WHERE is_leaf) SELECT n.name, min(o)::BIGINT AS byte_offset, sum(s)::BIGINT AS byte_size FROM nodes n JOIN l ON starts_with(l.name, n.name) WHERE NOT n.is_leaf GROUP BY n.name")
def parent_byte_ranges(spark, d):
    n = octree.nodes(pathed(spark, d), LEAF)
    return octree.byte_offsets(n).join(n.filter("not is_leaf").select("name"), "name", "left_semi")


_CAP, _DEEP = 200, 3
_fill = f"{EV}, sc AS (SELECT point_idx, {_SCALE} FROM ev), cl AS (SELECT *, {_CELLS} FROM sc), p0 AS (SELECT point_idx, 'r' || {_DIGITS} AS path FROM cl)"
for _k in range(_DEEP):
    _fill += f", q{_k} AS (SELECT *, row_number() OVER (PARTITION BY substr(path, 1, {_k + 1}) ORDER BY point_idx) AS rk FROM p{_k}), p{_k + 1} AS (SELECT point_idx, path FROM q{_k} WHERE rk > {_CAP})"


_filled = " UNION ALL ".join([f"SELECT point_idx, substr(path, 1, {k + 1}) AS node FROM q{k} WHERE rk <= {_CAP}" for k in range(_DEEP)] + [f"SELECT point_idx, substr(path, 1, {_DEEP + 1}) FROM p{_DEEP}"])


def _arrivals(spark: SparkSession, d: str) -> DataFrame:
    return octree.with_path(B.rescaled(B.points_ev(spark, d)), LO, HI).select("point_idx", "path")


@query(f"WITH {_fill} {_filled}")
def octree_streaming_fill(spark, d):
    return octree.streaming_fill(_arrivals(spark, d), _CAP, _DEEP).select("point_idx", "node")


def _grown(spark: SparkSession, d: str, batches: int) -> str:
    """The folder of a tree that has grown by batches of points, one after another."""
    points, root = _arrivals(spark, d), f"{Scratch(spark, 'growing').root}/tree"
    most = points.agg(F.max("point_idx")).first()[0] or 0
    for k in range(batches):
        growing.grow(points.filter(F.floor(F.col("point_idx") * batches / (most + 1)) == k), root, k, _CAP, _DEEP)
    return root


@query(f"WITH {_fill} {_filled}")
def octree_growing(spark, d):
    return growing.placed(spark, _grown(spark, d, 3)).select("point_idx", "node")


@query(f"""WITH {_fill}, g AS ({_filled}), n AS (SELECT node, count(*) AS n FROM g GROUP BY node)
SELECT n.node, n.n, coalesce(bit_or(1 << substr(c.node, -1, 1)::INT), 0)::INT AS child_mask FROM n LEFT JOIN n c ON length(c.node) = length(n.node) + 1 AND starts_with(c.node, n.node) GROUP BY n.node, n.n""")
def octree_growing_nodes(spark, d):
    return growing.nodes(spark, _grown(spark, d, 2))


_GONE = ("r340000000000", "r517777777777")
_REST = "WHERE NOT (path BETWEEN 'r340000000000' AND 'r517777777777')"


@query(f"WITH {NODES.replace('FROM paths GROUP BY path', f'FROM paths {_REST} GROUP BY path')} SELECT name, depth, num_points, child_mask, is_leaf FROM nodes")
def octree_delete(spark, d):
    """A tree whose points between two keys are deleted: what a rebuild without them gives."""
    p = pathed(spark, d)
    first, last = (int(n[1:], 8) for n in _GONE)
    return edits.delete(octree.nodes(p, LEAF), p, first, last, LEAF).select("name", "depth", "num_points", "child_mask", "is_leaf")


@query(f"WITH {NODES} SELECT name, depth, num_points, child_mask, is_leaf FROM nodes")
def octree_insert(spark, d):
    """A tree of the points outside a range of keys, and of every other one in it, into which the rest is inserted."""
    p = pathed(spark, d).withColumn("_late", F.col("path").between(*_GONE) & (F.col("path") < "r5") | (F.pmod(F.xxhash64("key", "x"), F.lit(5)) == 0))
    old, new = p.filter("not _late").drop("_late"), p.filter("_late").drop("_late")
    return edits.insert(octree.nodes(old, LEAF), old, new, LEAF).select("name", "depth", "num_points", "child_mask", "is_leaf")


@query(f"WITH {PTS} SELECT point_idx, round({_lin(FX)}, 6) AS sx, round({_lin(FY)}, 6) AS sy, round({_lin(FD)}, 6) AS depth_key FROM pts")
def project_iso(spark, d):
    return C.project_iso(pts(spark, d), VIEW).select("point_idx", *r6("sx", "sy", "depth_key"))


_M, _V = EMB_CAM.clip(), EMB_CAM.view_matrix()


@query(f"""WITH {EMB}, t AS (SELECT point_idx, {_lin(_M[0])} AS clip_x, {_lin(_M[1])} AS clip_y, {_lin(_M[3])} AS clip_w, -{_lin(_V[2])} AS view_dist FROM emb)
SELECT point_idx, {s6('clip_x', 'clip_y', 'clip_w', 'view_dist')}, round(least(greatest((view_dist - 0.1e0) / 9999.9e0, 0e0), 1e0), 6) AS depth_norm FROM t""")
def project_persp(spark, d):
    return C.project_persp(B.points_emb(spark, d), EMB_CAM).select("point_idx", *r6("clip_x", "clip_y", "clip_w", "view_dist", "depth_norm"))


def _bounds_row(points: DataFrame) -> tuple[tuple, tuple]:
    """One row: the extent, for scalar camera algebra on the driver."""
    r = stats.bounds(points).first()
    return tuple(r[f"min_{c}"] for c in "xyz"), tuple(r[f"max_{c}"] for c in "xyz")


_CORNERS = "(SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j), (SELECT unnest([0, 1]) AS k)"
_BD = f"bd AS (SELECT {_B} FROM li), co AS (SELECT CASE i WHEN 0 THEN min_x ELSE max_x END - (min_x + max_x) / 2 AS x, CASE j WHEN 0 THEN min_y ELSE max_y END - (min_y + max_y) / 2 AS y, CASE k WHEN 0 THEN min_z ELSE max_z END - (min_z + max_z) / 2 AS z FROM bd, {_CORNERS})"
_UNIT = C.View(rot=0.7, tilt_x=10.0, tilt_y=-5.0).screen()


@query(f"WITH {LI}, {_BD}, t AS (SELECT {_lin(C.View(rot=0.7).screen()[2])} AS v FROM co) SELECT round(min(v), 6) AS depth_min, round(CASE WHEN max(v) = min(v) THEN max(v) + 1 ELSE max(v) END, 6) AS depth_max FROM t")
def depth_range(spark, d):
    low, high = C.depth_range(*_bounds_row(B.points_li(spark, d)), 0.7)
    return spark.createDataFrame([(low, high)], "depth_min double, depth_max double").select(*r6("depth_min", "depth_max"))


@query(f"""WITH {LI}, {_BD}, t AS (SELECT {_lin(_UNIT[0])} AS u, {_lin(_UNIT[1])} AS v FROM co),
z AS (SELECT least(1280 * 0.85e0 / (max(u) - min(u)), 720 * 0.85e0 / (max(v) - min(v))) AS zoom, min(u) + max(u) AS mu, min(v) + max(v) AS mv FROM t)
SELECT round(zoom, 9) AS zoom, round(640e0 - mu * 0.5e0 * zoom, 6) AS pan_x, round(360e0 - mv * 0.5e0 * zoom, 6) AS pan_y FROM z""")
def fit_view(spark, d):
    v = C.fit_view(VIEW, *_bounds_row(B.points_li(spark, d)))
    return spark.createDataFrame([(v.zoom, v.pan_x, v.pan_y)], "zoom double, pan_x double, pan_y double").select(F.round("zoom", 9).alias("zoom"), *r6("pan_x", "pan_y"))


_TURN, _GROW, _PIVOT = (10.0, 20.0, 30.0), (1.0, 2.0, 0.5), (500.0, 500.0, 500.0)


def _turned() -> list[tuple[float, ...]]:
    """Rows of Rz Ry Rx after scaling, as linear forms of x, y, z."""
    m = [[_GROW[0], 0.0, 0.0], [0.0, _GROW[1], 0.0], [0.0, 0.0, _GROW[2]]]
    a, b, c = (math.radians(v) for v in _TURN)
    for r in (
        [[1, 0, 0], [0, math.cos(a), -math.sin(a)], [0, math.sin(a), math.cos(a)]],
        [[math.cos(b), 0, math.sin(b)], [0, 1, 0], [-math.sin(b), 0, math.cos(b)]],
        [[math.cos(c), -math.sin(c), 0], [math.sin(c), math.cos(c), 0], [0, 0, 1]],
    ):
        m = [[sum(r[i][k] * m[k][j] for k in range(3)) for j in range(3)] for i in range(3)]
    return [(*row, -sum(v * p for v, p in zip(row, _PIVOT, strict=True))) for row in m]


@query(f"WITH {PTS} SELECT point_idx, " + ", ".join(f"round({_lin(f)}, 6) AS {c}" for c, f in zip("xyz", _turned(), strict=True)) + " FROM pts")
def transform_points(spark, d):
    p = tuple(F.col(c) for c in "xyz")
    return pts(spark, d).select("point_idx", *[F.round(C.linear(f, *p), 6).alias(c) for c, f in zip("xyz", _turned(), strict=True)])


_SB = ("sx_min", "sx_max", "sy_min", "sy_max")


@query(f"WITH {NODES}, {BOXES} SELECT name, {s6(*_SB)} FROM boxes")
def node_screen_boxes(spark, d):
    return lod.screen_boxes(tree(spark, d), VIEW).select("name", *r6(*_SB))


@query(f"WITH {NODES}, {BOXES} SELECT name, num_points FROM boxes WHERE is_leaf AND {_seen(40)}")
def visible_leaves(spark, d):
    return lod.visible_leaves(tree(spark, d), VIEW).select("name", "num_points")


_BUDGET = 5000


@query(f"""WITH {NODES}, {BOXES}, v AS (SELECT name FROM boxes WHERE is_leaf AND {_seen(40)}),
s AS (SELECT point_idx, v.name AS leaf, row_number() OVER (ORDER BY v.name, point_idx) - 1 AS place, count(*) OVER () AS total FROM paths JOIN v ON starts_with(path, v.name)),
t AS (SELECT *, greatest(1, floor(total / {_BUDGET}e0 + 0.5e0))::BIGINT AS stride FROM s)
SELECT point_idx, leaf, place FROM t WHERE place % stride = 0 AND place // stride < {_BUDGET}""")
def stride_sample(spark, d):
    p = pathed(spark, d, True)
    nodes = tree(spark, d)
    return lod.stride_sample(octree.leaf_of(p, nodes).select("point_idx", "leaf"), lod.visible_leaves(nodes, VIEW), _BUDGET).select("point_idx", "leaf", "place")


_ISO_BUDGET, _ISO_PIXEL = 30_000, 120.0
_ISO = f"""WITH RECURSIVE {NODES}, {BOXES},
rated AS (SELECT *, greatest(sx_max - sx_min, sy_max - sy_min) AS size, greatest(sx_max - sx_min, sy_max - sy_min) >= {_ISO_PIXEL} AND child_mask <> 0 AS refined FROM boxes WHERE num_points > 0 AND {_seen(10)}),
walk AS (SELECT * FROM rated WHERE depth = 0 UNION ALL SELECT r.* FROM rated r JOIN walk w ON w.refined AND r.depth = w.depth + 1 AND substr(r.name, 1, r.depth) = w.name),
run AS (SELECT *, CASE WHEN depth = 0 THEN 1.7976931348623157e308 ELSE size END AS weight FROM walk),
acc AS (SELECT *, coalesce(sum(CASE WHEN refined THEN 0 ELSE num_points END) OVER (ORDER BY weight DESC, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM run),
cut AS (SELECT *, max(CASE WHEN before + num_points > {{budget}} THEN 1 ELSE 0 END) OVER (ORDER BY weight DESC, name) AS over FROM acc),
sel AS (SELECT * FROM cut WHERE over = 0 AND NOT refined)"""


@query(_ISO.replace("{budget}", "60000") + " SELECT name, num_points FROM sel")
def lod_iso(spark, d):
    return lod.select_iso(tree(spark, d), VIEW, 60_000, min_pixel=_ISO_PIXEL).select("name", "num_points")


_EYE = ORBIT.position()
_FPS_BUDGET, _FPS_MAX = 200_000, 2500.0


def _fps_sql() -> str:
    num = 0.5 * ORBIT.height / math.tan(math.radians(ORBIT.fov) / 2)
    dist = " + ".join(f"pow((min_{c} + max_{c}) / 2 - ({e!r}::DOUBLE), 2)" for c, e in zip("xyz", _EYE, strict=True))
    inside = " AND ".join(f"{_range_sql(p)[1]} >= 0" for p in ORBIT.planes())
    return f"""WITH RECURSIVE {NODES}, f AS (SELECT *, sqrt({dist}) AS dist FROM nodes WHERE {inside}),
g AS (SELECT *, CASE WHEN depth = 0 OR dist <= radius THEN 1.7976931348623157e308 ELSE radius * ({num!r}::DOUBLE) / dist END AS weight FROM f),
walk AS (SELECT * FROM g WHERE depth = 0 UNION ALL SELECT c.* FROM g c JOIN walk w ON w.dist <= {_FPS_MAX} AND c.depth = w.depth + 1 AND substr(c.name, 1, c.depth) = w.name WHERE c.dist <= {_FPS_MAX} AND (c.dist <= c.radius OR c.weight >= 60e0 OR c.depth <= 2)),
acc AS (SELECT *, coalesce(sum(CASE WHEN dist <= {_FPS_MAX} THEN num_points ELSE 0 END) OVER (ORDER BY weight DESC, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM walk),
cut AS (SELECT *, max(CASE WHEN before + num_points > {_FPS_BUDGET} THEN 1 ELSE 0 END) OVER (ORDER BY weight DESC, name) AS over FROM acc)
SELECT name, num_points FROM cut WHERE over = 0 AND dist <= {_FPS_MAX}"""


@query(_fps_sql())
def lod_fps(spark, d):
    return lod.select_fps(tree(spark, d), ORBIT, _FPS_BUDGET, _FPS_MAX, min_pixel=60.0).select("name", "num_points")


_LOADED = "num_points % 3 = 0"


@query(_ISO.replace("{budget}", "60000") + f", q AS (SELECT * FROM sel WHERE NOT ({_LOADED}) ORDER BY weight DESC, name LIMIT 16) SELECT name, num_points FROM q")
def load_queue_topk(spark, d):
    t = tree(spark, d)
    return lod.load_queue(lod.select_iso(t, VIEW, 60_000, min_pixel=_ISO_PIXEL), t.filter(_LOADED)).select("name", "num_points")


@query(f"WITH {NODES}, {BOXES} SELECT name FROM boxes WHERE is_leaf AND {_seen(40)} AND {_LOADED}")
def visible_semi(spark, d):
    t = tree(spark, d)
    return lod.visible_leaves(t, VIEW).join(t.filter(_LOADED).select("name"), "name", "left_semi").select("name")


@query(f"WITH {NODES}, {BOXES} SELECT name FROM boxes WHERE is_leaf AND {_seen(40)} AND NOT ({_LOADED})")
def unloaded_anti(spark, d):
    t = tree(spark, d)
    return lod.visible_leaves(t, VIEW).join(t.filter(_LOADED).select("name"), "name", "left_anti").select("name")


@query(f"WITH {NODES} SELECT name, (row_number() OVER (ORDER BY round(" + " + ".join(f"pow((min_{c} + max_{c}) / 2 - ({e!r}::DOUBLE), 2)" for c, e in zip("xyz", _EYE, strict=True)) + ", 6), name))::INT AS draw_order FROM nodes WHERE is_leaf")
def depth_sorted_nodes(spark, d):
    d2 = sum(F.pow((F.col(f"min_{c}") + F.col(f"max_{c}")) / 2 - F.lit(e), F.lit(2.0)) for c, e in zip("xyz", _EYE, strict=True))
    leaves = tree(spark, d).filter("is_leaf").select("name", F.round(d2, 6).alias("_d2"))
    return B.numbered(leaves, ["_d2", "name"], "_n").select("name", (F.col("_n") + 1).cast("int").alias("draw_order"))


_EVFX, _EVFY, _ = VIEW.screen()


@query(f"""WITH {EV}, sc AS (SELECT point_idx, {_SCALE} FROM ev), pr AS (SELECT point_idx, {_lin(FX)} AS sx, {_lin(FY)} AS sy FROM sc),
cu AS (SELECT event_id AS cursor_id, (event_id % 1280)::DOUBLE AS cx, (event_id * 7 % 720)::DOUBLE AS cy FROM events),
t AS (SELECT cursor_id, point_idx, (sx - cx) * (sx - cx) + (sy - cy) * (sy - cy) AS d2 FROM pr, cu WHERE (sx - cx) * (sx - cx) + (sy - cy) * (sy - cy) < 400e0)
SELECT cursor_id, arg_min(point_idx, row(d2, point_idx)) AS point_idx, round(min(d2), 6) AS d2 FROM t GROUP BY cursor_id""")
def pick_nearest(spark, d):
    p = C.project_iso(B.rescaled(B.points_ev(spark, d)), VIEW)
    c = spark.read.parquet(f"{d}/events.parquet")
    c = c.select(F.col("event_id").alias("cursor_id"), (F.col("event_id") % 1280).cast("double").alias("cx"), (F.col("event_id") * 7 % 720).cast("double").alias("cy"))
    return pick.pick_nearest(p, c, 20.0).select("cursor_id", "point_idx", *r6("d2"))


@query(f"""WITH {EMB}, p AS (SELECT a.point_idx AS measure_id, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz FROM emb a JOIN emb b ON b.point_idx = a.point_idx + 1 WHERE a.point_idx % 2 = 0)
SELECT measure_id, round(sqrt(dx * dx + dy * dy + dz * dz), 6) AS distance, {s6('dx', 'dy', 'dz')} FROM p""")
def measure_pairs(spark, d):
    p = B.points_emb(spark, d)
    picks = p.select((F.col("point_idx") - F.col("point_idx") % 2).alias("measure_id"), (F.col("point_idx") % 2).alias("seq"), "point_idx")
    return pick.measure(p, picks).select("measure_id", *r6("distance", "dx", "dy", "dz"))


def _rgb(c):
    return [F.round(c[k], 6).alias(k) for k in "rgb"]


@query(f"WITH {PTS}, t AS (SELECT point_idx, least(greatest(z / 1000e0, 0e0), 1e0) AS t FROM pts) SELECT point_idx, round(0.1e0 * (1 - t) + 0.2e0 * t, 6) AS r, round(0.3e0 * (1 - t) + 0.7e0 * t, 6) AS g, round(0.6e0 * (1 - t) + t, 6) AS b FROM t")
def color_height(spark, d):
    return pts(spark, d).select("point_idx", *_rgb(S.height_color(F.col("z") / 1000.0)))


@query(f"WITH {PTS}, t AS (SELECT point_idx, round((intensity - min(intensity) OVER ()) / greatest(max(intensity) OVER () - min(intensity) OVER (), 1e-6), 6) AS r FROM pts) SELECT point_idx, r, r AS g, r AS b FROM t")
def color_intensity(spark, d):
    p = pts(spark, d)
    ends = p.agg(F.min("intensity").alias("lo"), F.max("intensity").alias("hi"))
    return p.crossJoin(F.broadcast(ends)).select("point_idx", *_rgb(S.intensity_color(F.col("intensity"), F.col("lo"), F.col("hi"))))


_DR = C.depth_range(LO, HI, VIEW.rot)


@query(f"WITH {PTS}, t AS (SELECT point_idx, round(({_lin(FD)} - ({_DR[0]!r}::DOUBLE)) / ({_DR[1] - _DR[0]!r}::DOUBLE), 6) AS r FROM pts) SELECT point_idx, r, r AS g, r AS b FROM t")
def color_depth(spark, d):
    t = (F.col("depth_key") - F.lit(_DR[0])) / F.lit(_DR[1] - _DR[0])
    return C.project_iso(pts(spark, d), VIEW).select("point_idx", *_rgb(S.rgb([t, t, t])))


_PALETTE = ", ".join(f"({k}, {r}e0, {g}e0, {b}e0)" for k, (r, g, b) in enumerate(S.CLASS_COLORS))


@query(f"WITH {EMB} SELECT point_idx, r, g, b FROM emb JOIN (VALUES {_PALETTE}) p(k, r, g, b) ON k = least(classification * 2, 15)")
def color_class(spark, d):
    return B.points_emb(spark, d).select("point_idx", *_rgb(S.class_color(F.col("classification") * 2)))


@query(f"""WITH {EMB}, t AS (SELECT point_idx, classification + 0.5e0 AS s, -{_lin(_V[2])} AS vd FROM emb)
SELECT point_idx, least(greatest(s, 1e0), 50e0) AS fixed, round(least(greatest(0.5e0 * 3e0 * s * 0.5e0, 1e0), 12e0), 6) AS iso,
round(least(greatest(s * 0.5e0 * 0.02e0 * (({0.5 * 720!r}::DOUBLE) / tan(radians(60e0) / 2) / greatest(vd, 0.1e0)), 1e0), 12e0), 6) AS persp FROM t""")
def point_size(spark, d):
    p = C.project_persp(B.points_emb(spark, d), EMB_CAM).withColumn("s", F.col("classification") + 0.5)
    s = F.col("s")
    return p.select("point_idx", S.point_size_fixed(s).alias("fixed"), F.round(S.point_size_iso(s, 0.5, 3.0), 6).alias("iso"), F.round(S.point_size_persp(s, F.col("view_dist"), 0.02, 720, 60.0), 6).alias("persp"))


_ZB = f"""{PTS}, pr AS (SELECT point_idx, floor({_lin(FX)})::INT AS px, floor({_lin(FY)})::INT AS py, round(({_lin(FD)} - ({_DR[0]!r}::DOUBLE)) / ({_DR[1] - _DR[0]!r}::DOUBLE), 6) AS depth FROM pts),
zb AS (SELECT px, py, min(depth) AS depth, arg_min(point_idx, row(depth, -point_idx)) AS point_idx FROM pr WHERE px BETWEEN 0 AND 1279 AND py BETWEEN 0 AND 719 GROUP BY px, py)"""


def _pixels(spark, d):
    p = C.project_iso(pts(spark, d), VIEW).withColumn("depth", F.round((F.col("depth_key") - F.lit(_DR[0])) / F.lit(_DR[1] - _DR[0]), 6))
    return raster.zbuffer(p, 1280, 720)


@query(f"WITH {_ZB} SELECT px, py, depth, point_idx FROM zb")
def zbuffer(spark, d):
    return _pixels(spark, d)


_L = [v / (0.5**2 + 0.3**2 + 0.8**2) ** 0.5 for v in (0.5, 0.3, 0.8)]


@query(f"""WITH {_ZB}, nb AS (SELECT a.px, a.py, (coalesce(r.depth, 1e0) - coalesce(l.depth, 1e0)) * 2 AS dx, (coalesce(t.depth, 1e0) - coalesce(b.depth, 1e0)) * 2 AS dy FROM zb a
LEFT JOIN zb r ON r.px = a.px + 1 AND r.py = a.py LEFT JOIN zb l ON l.px = a.px - 1 AND l.py = a.py LEFT JOIN zb t ON t.px = a.px AND t.py = a.py + 1 LEFT JOIN zb b ON b.px = a.px AND b.py = a.py - 1)
SELECT px, py, round(0.3e0 + greatest((-dx * ({_L[0]!r}::DOUBLE) - dy * ({_L[1]!r}::DOUBLE) + ({_L[2]!r}::DOUBLE)) / sqrt(dx * dx + dy * dy + 1), 0e0) * 0.7e0, 6) AS light FROM nb""")
def shade(spark, d):
    return raster.shaded(_pixels(spark, d), (0.5, 0.3, 0.8), 0.3).select("px", "py", *r6("light"))


@query(f"""WITH {_ZB}, g AS (SELECT (i % 1280)::INT AS px, (i // 1280)::INT AS py FROM range({1280 * 720}) t(i))
SELECT py, count(*) AS pixels, count(zb.point_idx) AS covered, round(0.1e0 * (1 - (720 - py - 0.5e0) / 720) + 0.5e0 * ((720 - py - 0.5e0) / 720), 6) AS sky_r FROM g LEFT JOIN zb USING (px, py) GROUP BY py""")
def sky_fill(spark, d):
    filled = raster.sky_fill(_pixels(spark, d), raster.sky(spark, 1280, 720, (0.5, 0.7, 0.9), (0.1, 0.2, 0.3)))
    return filled.groupBy("py").agg(F.count("*").alias("pixels"), F.count("point_idx").alias("covered"), F.round(F.min("r"), 6).alias("sky_r"))


@query(f"""WITH {EV}, e AS (SELECT min(x) AS ax, least(134e0 / (max(x) - min(x)), 134e0 / (max(y) - min(y))) AS s, min(y) AS ay, greatest(1, count(*) // 800) AS k FROM ev)
SELECT point_idx, round(8 + (x - ax) * s, 6) AS mx, round(142 - (y - ay) * s, 6) AS my FROM ev, e WHERE point_idx % k = 0""")
def minimap(spark, d):
    p = B.points_ev(spark, d)
    return raster.minimap(p, p.count()).select("point_idx", *r6("mx", "my"))


_TOUCH = "touches AS (SELECT event_id AS seq, user_id AS node, (event_id % 97 + 1) AS num_points, (event_id % 97 + 1) * 24 AS gpu_bytes FROM events)"


def _touches(spark, d):
    n = F.col("event_id") % 97 + 1
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("seq"), F.col("user_id").alias("node"), n.alias("num_points"), (n * 24).alias("gpu_bytes"))


@query(f"""WITH {_TOUCH}, l AS (SELECT node, max(seq) AS seq, arg_max(num_points, seq) AS num_points, arg_max(gpu_bytes, seq) AS gpu_bytes FROM touches GROUP BY node),
s AS (SELECT *, sum(num_points) OVER (ORDER BY seq DESC) AS p, sum(gpu_bytes) OVER (ORDER BY seq DESC) AS b FROM l) SELECT node, seq, num_points FROM s WHERE p <= 3000 AND b <= 0.9e0 * 100000""")
def lru_evict(spark, d):
    return cache.lru_keep(_touches(spark, d), 3000, 100_000).select("node", "seq", "num_points")


_REGIONS = "regions AS (SELECT user_id AS k, event_id * 10 AS o, (event_id % 40 * 30 + 1) AS c FROM events)"


@query(f"""WITH {_REGIONS}, s AS (SELECT *, CASE WHEN max(o + c) OVER (PARTITION BY k ORDER BY o, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= o THEN 0 ELSE 1 END AS n FROM regions),
i AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY o, c ROWS UNBOUNDED PRECEDING) AS g FROM s) SELECT k, min(o) AS "offset", (max(o + c) - min(o)) AS "count" FROM i GROUP BY k, g""")
def free_region_merge(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("k"), (F.col("event_id") * 10).alias("offset"), (F.col("event_id") % 40 * 30 + 1).alias("count"))
    return cache.merge_regions(e, "k")


@query("""WITH s AS (SELECT event_id % 20 AS k, event_id AS o, CASE WHEN user_id % 3 = 0 THEN 19 ELSE 20 END AS c FROM events),
n AS (SELECT *, CASE WHEN lag(o + c) OVER (PARTITION BY k ORDER BY o) = o THEN 0 ELSE 1 END AS n FROM s), g AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY o ROWS UNBOUNDED PRECEDING) AS g FROM n)
SELECT k, min(o) AS first, sum(c)::BIGINT AS "count", count(*) AS slots FROM g GROUP BY k, g""")
def draw_runs(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return cache.draw_runs(e.select((F.col("event_id") % 20).alias("k"), F.col("event_id").alias("offset"), F.when(F.col("user_id") % 3 == 0, 19).otherwise(20).alias("count")), "k")


@query("""WITH c AS (SELECT event_type AS file_hash, user_id AS id, max(epoch_us(ts)) AS a FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY a DESC, id DESC) AS k FROM c)
SELECT file_hash, id, k::INT AS age_rank FROM r WHERE k > 10""")
def chunk_evict(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("event_type").alias("file_hash"), F.col("user_id").alias("id")).agg(F.max("ts").alias("last_access"))
    return cache.chunks_evicted(e, "file_hash").select("file_hash", "id", "age_rank")


@query("SELECT (epoch_us(ts) // 33000 * 33000)::BIGINT AS start_us, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY 1 HAVING sum(value) <> 0")
def control_sum_33ms(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return control.sums(e).select(F.unix_micros("start").alias("start_us"), F.round("total", 4).alias("total"), "n")


@query("SELECT (epoch_us(ts) // 1000000 * 1000000)::BIGINT AS start_us, count(*) AS fps FROM events GROUP BY 1")
def fps_1s(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return control.frames(e).select(F.unix_micros("start").alias("start_us"), "fps")


def control_log(spark, d, *more):
    v = F.col("value")
    kind = F.when(F.col("event_type") == "error", "reset").when(F.col("event_type") == "signup", "switchMode").otherwise("signal")
    return spark.read.parquet(f"{d}/events.parquet").select(
        F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), kind.alias("type"), (v / 100).alias("yaw"), (v / 50 - 1).alias("pitch"),
        (v / 1000 - 0.05).alias("zoom"), (v / 200).alias("pan_x"), (v / 300 - 0.5).alias("pan_y"), *more,
    )


@query("""WITH RECURSIVE s AS (SELECT user_id::VARCHAR AS session, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, event_type AS t, value AS v FROM events),
f AS (SELECT session, 0::BIGINT AS k, 0e0 AS yaw, 0e0 AS pitch, 1e0 AS zoom, 0e0 AS pan_x, 0e0 AS pan_y, 'iso' AS mode FROM s GROUP BY session UNION ALL
SELECT f.session, s.k, CASE t WHEN 'error' THEN 0e0 WHEN 'signup' THEN yaw ELSE yaw + v / 100 END,
CASE t WHEN 'error' THEN 0e0 WHEN 'signup' THEN pitch ELSE greatest(-89e0, least(89e0, pitch + (v / 50 - 1) * 180 / 3.141592653589793::DOUBLE)) END,
CASE t WHEN 'error' THEN 1e0 WHEN 'signup' THEN zoom ELSE greatest(0.1e0, least(10e0, zoom * (1 + (v / 1000 - 0.05e0)))) END,
CASE t WHEN 'error' THEN 0e0 WHEN 'signup' THEN pan_x ELSE pan_x + v / 200 * 50 END, CASE t WHEN 'error' THEN 0e0 WHEN 'signup' THEN pan_y ELSE pan_y + (v / 300 - 0.5e0) * 50 END,
CASE t WHEN 'signup' THEN CASE mode WHEN 'iso' THEN 'fps' ELSE 'iso' END ELSE mode END FROM f JOIN s ON s.session = f.session AND s.k = f.k + 1)
SELECT session, k AS signals, round(yaw, 6) AS yaw, round(pitch, 6) AS pitch, round(zoom, 6) AS zoom, round(pan_x, 6) AS pan_x, round(pan_y, 6) AS pan_y, mode FROM f QUALIFY k = max(k) OVER (PARTITION BY session)""")
def camera_fold(spark, d):
    return control.camera_fold(control_log(spark, d)).select("session", "signals", *r6("yaw", "pitch", "zoom", "pan_x", "pan_y"), "mode")


@query("""WITH s AS (SELECT i, cos(i * 6.283185307179586::DOUBLE / 32) * 100 AS ax, sin(i * 6.283185307179586::DOUBLE / 32) * 100 AS ay, cos((i + 1) * 6.283185307179586::DOUBLE / 32) * 100 AS bx, sin((i + 1) * 6.283185307179586::DOUBLE / 32) * 100 AS by_ FROM range(32) t(i)),
c AS (SELECT event_id AS cursor_id, (event_id % 250 - 125)::DOUBLE AS x, (event_id * 7 % 250 - 125)::DOUBLE AS y FROM events),
t AS (SELECT *, least(greatest(((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)), 0e0), 1e0) AS t FROM s, c),
q AS (SELECT cursor_id, min(sqrt(pow(x - (ax + t * (bx - ax)), 2) + pow(y - (ay + t * (by_ - ay)), 2))) AS dist FROM t GROUP BY cursor_id) SELECT cursor_id, round(dist, 6) AS dist, dist <= 12 AS hit FROM q""")
def ring_hit_test(spark, d):
    # A ring of 32 segments: each cursor's least distance is an expression, and nothing is joined.
    ends = [(math.cos(k * math.tau / 32) * 100, math.sin(k * math.tau / 32) * 100) for k in range(33)]
    c = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("cursor_id"), (F.col("event_id") % 250 - 125).cast("double").alias("x"), (F.col("event_id") * 7 % 250 - 125).cast("double").alias("y"))
    out = c.select("cursor_id", F.least(*[S.segment_distance(F.col("x"), F.col("y"), *map(F.lit, (*a, *b))) for a, b in zip(ends, ends[1:], strict=False)]).alias("dist"))
    return out.select("cursor_id", F.round("dist", 6).alias("dist"), (F.col("dist") <= 12).alias("hit"))


@query(f"WITH {EV}, {EMB} SELECT 'ev' AS src, count(*) AS n, min(x) AS lo, max(x) AS hi FROM ev UNION ALL SELECT 'emb', count(*), min(x), max(x) FROM emb")
def union_chunks(spark, d):
    both = B.points_ev(spark, d).withColumn("src", F.lit("ev")).unionByName(B.points_emb(spark, d).withColumn("src", F.lit("emb")))
    return both.groupBy("src").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def dedupe_last_wins(spark, d):
    return cache.dedupe_last(spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", "value"), "user_id", "event_id")


@query("""SELECT event_id, round(user_id::DOUBLE, 6) AS x, round(value, 6) AS y, round(value / 2, 6) AS z FROM events WHERE event_id % 10 <> 0""")
def xyz_parse(spark, d):
    from ..sources.xyz import parse_lines

    e = spark.read.parquet(f"{d}/events.parquet")
    text = F.concat_ws(" ", F.col("user_id"), F.format_string("%.9f", "value"), F.format_string("%.9f", F.col("value") / 2))
    lines = e.select("event_id", F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("# "), text)).otherwise(text).alias("value"))
    return parse_lines(lines, double=True).select("event_id", *r6("x", "y", "z"))


@query("SELECT event_id, '#' || lpad(lower(hex(event_id * 7919 % 16777216)), 6, '0') AS code, round((event_id * 7919 % 16777216 // 65536) / 255e0, 6) AS r, round((event_id * 7919 % 16777216 // 256 % 256) / 255e0, 6) AS g, round((event_id * 7919 % 256) / 255e0, 6) AS b FROM events")
def palette_hex(spark, d):
    code = F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.col("event_id") * 7919 % 16777216)), 6, "0"))
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", code.alias("code"))
    return e.select("event_id", "code", *[F.round(c, 6).alias(n) for c, n in zip(S.hex_channels(F.col("code")), "rgb", strict=True)])


@query("SELECT event_id, (floor(value / (6.283185307179586::DOUBLE / 8) + 0.5e0)::BIGINT % 8)::INT AS bin8, (floor(value / (6.283185307179586::DOUBLE / 4) + 0.5e0)::BIGINT % 4)::INT AS bin4 FROM events")
def view_index(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", C.view_index(F.col("value"), 8).alias("bin8"), C.view_index(F.col("value"), 4).alias("bin4"))


@query("SELECT event_id, round(cos(radians(user_id::DOUBLE)) * cos(radians(value)), 6) + 0e0 AS lx, round(cos(radians(user_id::DOUBLE)) * sin(radians(value)), 6) + 0e0 AS ly, round(sin(radians(user_id::DOUBLE)), 6) AS lz FROM events")
def light_direction(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", *[(F.round(c, 6) + 0.0).alias(n) for c, n in zip(S.light_direction(F.col("value"), F.col("user_id").cast("double")), ("lx", "ly", "lz"), strict=True)])


@query("""WITH t AS (SELECT event_id, (event_id % 41 - 20) / 20e0 AS u, (event_id // 41 % 41 - 20) / 20e0 AS v FROM events), r AS (SELECT *, sqrt(u * u + v * v) AS d FROM t), s AS (SELECT *, least(greatest((d - 0.9e0) / 0.1e0, 0e0), 1e0) AS k FROM r)
SELECT event_id, round(CASE WHEN d > 1 THEN 0 ELSE 1 - k * k * (3 - 2 * k) END, 5) AS alpha FROM s""")
def splat_alpha(spark, d):
    u, v = (F.col("event_id") % 41 - 20) / 20, (F.floor(F.col("event_id") / 41) % 41 - 20) / 20
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", u.alias("u"), v.alias("v"))
    return e.select("event_id", F.round(S.splat(F.col("u"), F.col("v")), 5).alias("alpha"))


@query(f"WITH {EMB}, b AS (SELECT {_B} FROM emb), t AS (SELECT *, greatest(max_x - min_x, max_y - min_y, max_z - min_z) AS m FROM b) SELECT point_idx, " + ", ".join(f"round(({c} - (min_{c} + max_{c}) / 2) * (10 / m), 6) AS {c}" for c in "xyz") + " FROM emb, t")
def vr_normalize(spark, d):
    p = B.points_emb(spark, d)
    b = stats.bounds(p).drop("i_min", "i_max", "n")
    m = F.greatest(*[F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"])
    return p.crossJoin(F.broadcast(b)).select("point_idx", *[F.round((F.col(c) - F.col(f"c{c}")) * (10 / m), 6).alias(c) for c in "xyz"])


@query(f"WITH {EV}, n AS (SELECT ceil(count(*) / 100e0)::BIGINT AS s FROM ev) SELECT (point_idx // s)::INT AS chunk, (point_idx // s % 10)::INT AS grid_x, (point_idx // s // 10)::INT AS grid_y, count(*) AS n FROM ev, n GROUP BY ALL")
def file_chunks(spark, d):
    p = B.points_ev(spark, d)
    return stats.chunked(p, 100, p.count()).groupBy("chunk", "grid_x", "grid_y").agg(F.count("*").alias("n"))
