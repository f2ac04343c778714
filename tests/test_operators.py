"""Octree, level of detail, grids, picking and control against plain Python on small clouds."""

import heapq
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from pcq import bindings, catalog, scratch
from pcq.functions import camera as C
from pcq.functions import style as S
from pcq.operators import cache, grid, lod, octree, pick, stats
from pcq.streaming import control

SF = "/root/testdata/sf0.001"


def cloud(spark, rows):
    return spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(rows)], "point_idx long, x double, y double, z double")


def tree_of(points, lo, hi, leaf, depth, name="r", level=0, out=None):
    """A recursive octree, as an oracle."""
    out = {} if out is None else out
    out[name] = len(points)
    if len(points) > leaf and level < depth:
        mid = [(a + b) / 2 for a, b in zip(lo, hi, strict=True)]
        kids = {}
        for p in points:
            kids.setdefault(sum((p[k] >= mid[k]) << (2 - k) for k in range(3)), []).append(p)
        for d, own in kids.items():
            up = [d >> (2 - k) & 1 for k in range(3)]
            tree_of(own, [m if u else a for u, m, a in zip(up, mid, lo, strict=True)], [b if u else m for u, m, b in zip(up, mid, hi, strict=True)], leaf, depth, name + str(d), level + 1, out)
    return out


CLOUDS = {
    "cube8": [(a, b, c) for a in (0, 8) for b in (0, 8) for c in (0, 8)],
    "mid": [(4, 4, 4), (2, 4, 6), (4, 0, 0)] * 5,
    "dup": [(1, 1, 1)] * 300,
    "random": [[random.Random(k).random() * 8, random.Random(-k - 1).random() * 8, random.Random(k * 7).random() ** 3 * 8] for k in range(900)],
}


@pytest.mark.parametrize("name", CLOUDS)
def test_octree_is_the_recursive_one(spark, name):
    rows, lo, hi = CLOUDS[name], (0.0,) * 3, (8.0,) * 3
    p = octree.with_path(cloud(spark, rows), lo, hi, 5)
    got = octree.nodes(p, 10, 5).collect()
    want = tree_of(rows, lo, hi, 10, 5)
    assert {r.name: r.num_points for r in got} == want
    leaves = {r.name for r in got if r.is_leaf}
    assert leaves == {n for n in want if not any(m != n and m.startswith(n) for m in want)}
    assert sum(want[n] for n in leaves) == len(rows) == octree.leaf_of(p, octree.nodes(p, 10, 5), 5).count()
    boxes = {r.name: r for r in octree.with_box(octree.nodes(p, 10, 5), lo, hi).collect()}
    named = {r.name: (r.min_x, r.max_z) for r in octree.with_box(octree.nodes(p, 10, 5).select("name"), lo, hi).collect()}
    assert named == {n: (b.min_x, b.max_z) for n, b in boxes.items()}
    for r in octree.leaf_of(p, octree.nodes(p, 10, 5), 5).collect():
        b = boxes[r.leaf]
        assert b.min_x <= r.x <= b.max_x and b.min_y <= r.y <= b.max_y and b.min_z <= r.z <= b.max_z


def test_flat_and_empty_clouds(spark):
    flat = octree.with_path(cloud(spark, [(1, 2, 3)] * 4), (1.0, 2.0, 3.0), (1.0, 2.0, 3.0), 4)
    assert flat.select("path").distinct().collect() == [("r7777",)]
    empty = spark.createDataFrame([], "point_idx long, x double, y double, z double, intensity double")
    assert octree.nodes(octree.with_path(empty, (0.0,) * 3, (1.0,) * 3), 10).count() == 0
    assert stats.bounds(empty).first().n == 0 and grid.histogram(empty).count() == 0
    one = empty.union(spark.createDataFrame([(0, 1.0, 1.0, 1.0, 5.0)], empty.schema))
    assert stats.bounds(one).first().i_max == 6.0 and grid.histogram(one).collect() == [(0, 0, 1)]


def test_streaming_fill(spark):
    rows = CLOUDS["random"]
    p = octree.with_path(cloud(spark, rows), (0.0,) * 3, (8.0,) * 3, 3)
    held, want = {}, {}
    for k, path in sorted((r.point_idx, r.path) for r in p.collect()):
        for d in range(4):
            node = path[: d + 1]
            if d == 3 or held.get(node, 0) < 20:
                held[node], want[k] = held.get(node, 0) + 1, node
                break
    assert {r.point_idx: r.node for r in octree.streaming_fill(p, 20, 3).collect()} == want


@pytest.mark.parametrize("seed", range(4))
def test_lod_iso_is_the_heap(spark, seed):
    r = random.Random(seed)
    lo, hi = (0.0,) * 3, (8.0,) * 3
    view = C.View(zoom=r.uniform(20, 120), pan_x=640, pan_y=360, rot=r.uniform(0, 6), tilt_x=r.uniform(-60, 60), center=(4.0,) * 3)
    nodes = octree.with_box(octree.nodes(octree.with_path(cloud(spark, CLOUDS["random"]), lo, hi, 6), 20, 6), lo, hi)
    rows = {n.name: n for n in lod.screen_boxes(nodes, view).collect()}
    budget = r.choice([200, 500, 900, 10_000])

    def size(n):
        seen = n.sx_max >= -10 and n.sx_min <= 1290 and n.sy_max >= -10 and n.sy_min <= 730
        return max(n.sx_max - n.sx_min, n.sy_max - n.sy_min) if seen else 0

    heap, taken, total = [(-1e308, "r")], [], 0
    while heap:
        _, name = heapq.heappop(heap)
        n = rows[name]
        if total + n.num_points > budget:
            break
        if not size(n):
            continue
        kids = [m for m in rows.values() if m.name[:-1] == name]
        if size(n) >= 250 and kids:
            for m in kids:
                if size(m):
                    heapq.heappush(heap, (-size(m), m.name))
            continue
        total += n.num_points
        taken.append(name)
    assert sorted(x.name for x in lod.select_iso(nodes, view, budget).collect()) == sorted(taken)


def test_pick(spark):
    r = random.Random(1)
    pts = [(k, r.uniform(0, 100), r.uniform(0, 100)) for k in range(500)] + [(500, 10.0, 10.0), (501, 10.0, 10.0)]
    cur = [(k, r.uniform(-5, 105), r.uniform(-5, 105)) for k in range(40)] + [(40, 10.0, 10.0), (41, 500.0, 500.0)]
    got = {x.cursor_id: x.point_idx for x in pick.pick_nearest(spark.createDataFrame(pts, "point_idx long, sx double, sy double"), spark.createDataFrame(cur, "cursor_id long, cx double, cy double"), 6.0).collect()}
    want = {}
    for c, x, y in cur:
        near = [(((a - x) ** 2 + (b - y) ** 2), k) for k, a, b in pts if (a - x) ** 2 + (b - y) ** 2 < 36]
        if near:
            want[c] = min(near)[1]
    assert got == want


@pytest.mark.parametrize("pairs", [0.1, 3, 1000])
def test_pick_among_dense_points(spark, monkeypatch, pairs):
    """However far cells are halved: crowded and repeated points, cursors in one place, points at exactly the radius, nulls."""
    monkeypatch.setattr(pick, "PAIRS", pairs)
    monkeypatch.setattr(pick, "HALVINGS", 9)
    r = random.Random(4)
    pts = [(r.uniform(-40, 40), r.uniform(-40, 40)) for _ in range(60)] + [(7 + r.gauss(0, 0.01), -3 + r.gauss(0, 0.01)) for _ in range(200)] + [(-11.0, 4.0)] * 30
    pts += [(10 * math.cos(a / 9), 60 + 10 * math.sin(a / 9)) for a in range(57)] + [(5.0, 100.0), (0.0, 0.0), (-0.0, 0.0)]
    pts = [(k, *p) for k, p in enumerate(r.sample(pts, len(pts)))] + [(900, None, 1.0)]
    cur = [(r.uniform(-45, 45), r.uniform(-45, 45)) for _ in range(60)] + [(7.0, -3.0)] * 20 + [(7.005, -3.0), (0.0, 60.0), (-11.0, 4.0), (0.0, 100.0), (-6.0, 0.0), (None, 2.0), (999.0, 0.0)]
    cur = [(k, *c) for k, c in enumerate(cur)]
    want = {}
    for c, x, y in cur:
        near = [((a - x) * (a - x) + (b - y) * (b - y), k) for k, a, b in pts if a is not None and x is not None and (a - x) * (a - x) + (b - y) * (b - y) < 25]
        if near:
            want[c] = min(near)
    found = pick.pick_nearest(spark.createDataFrame(pts, "point_idx long, sx double, sy double").repartition(3), spark.createDataFrame(cur, "cursor_id long, cx double, cy double"), 5.0).collect()
    assert {x.cursor_id: (x.d2, x.point_idx) for x in found} == want and len(found) == len(want)


def test_pick_takes_any_number_of_cursors(spark):
    """Without small tables to broadcast, points and cursors meet in a shuffle."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        r = random.Random(6)
        at = [(k, r.uniform(0, 90), r.uniform(0, 90)) for k in range(300)]
        found = pick.pick_nearest(spark.createDataFrame(at, "point_idx long, sx double, sy double"), spark.createDataFrame(at[::-1], "cursor_id long, cx double, cy double"), 5.0)
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
        assert {x.cursor_id: x.point_idx for x in found.collect()} == {k: k for k in range(300)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_lru_is_the_sequential_one(spark):
    r = random.Random(2)
    log = [(k, f"n{r.randrange(12)}", r.randint(1, 9)) for k in range(200)]
    order = {}
    for _, n, size in log:
        order.pop(n, None)
        order[n] = size
    while sum(order.values()) > 20 or sum(order.values()) * 24 > 0.9 * 600:
        order.pop(next(iter(order)))
    df = spark.createDataFrame([(a, b, c, c * 24) for a, b, c in log], "seq long, node string, num_points long, gpu_bytes long")
    assert {x.node for x in cache.lru_keep(df, 20, 600).collect()} == set(order)


def test_camera_algebra():
    v = C.zoom_at(C.View(zoom=2.0, pan_x=10.0), 100.0, 50.0, 3.0)
    assert v.zoom == 6.0 and 100.0 - (100.0 - 10.0) * 3 == v.pan_x
    cam = C.Orbit().orbit(1.0, 10.0).dolly(1e9)
    assert cam.phi == math.pi - 0.01 and cam.radius == 1e5
    o = C.Orbit(target=(1.0, 2.0, 3.0))
    m = o.clip()
    at = [sum(m[i][k] * p for k, p in enumerate((*o.target, 1.0))) for i in range(4)]
    assert abs(at[0]) < 1e-9 and abs(at[1]) < 1e-9 and math.isclose(at[3], o.radius)
    inside = lambda p: all(sum(a * b for a, b in zip(q, (*p, 1.0), strict=True)) >= 0 for q in o.planes())
    assert inside(o.target) and not inside(tuple(2 * e - t for e, t in zip(o.position(), o.target, strict=True)))
    assert C.depth_range((0, 0, 0), (0, 0, 0), 1.0) == (0.0, 1.0)
    assert C.face_center((0, 0, 0), (2, 4, 6), 0.0, 60) == (1.0, 4, 4)


def test_fit_view_fills_the_viewport(spark):
    lo, hi = (0.0, 0.0, 0.0), (10.0, 20.0, 5.0)
    v = C.fit_view(C.View(rot=0.4, tilt_x=15), lo, hi)
    box = spark.createDataFrame([(*lo, *hi)], "min_x double, min_y double, min_z double, max_x double, max_y double, max_z double")
    b = lod.screen_boxes(box, v).first()
    assert math.isclose(max((b.sx_max - b.sx_min) / 1280, (b.sy_max - b.sy_min) / 720), 0.85) and math.isclose(b.sx_min + b.sx_max, 1280)


def test_styles(spark):
    r = spark.range(1).select(*S.bytes_from_unit(F.lit(0.5), F.lit(1.0), F.lit(0.0))).first()
    assert tuple(r) == (127, 255, 0)
    r = spark.range(1).select(*S.bytes_from_unit(F.lit(300.0), F.lit(-4.0), F.lit(float("nan")))).first()
    assert tuple(r) == (255, 0, 128)
    assert spark.range(1).select(S.class_color(F.lit(200))["g"]).first()[0] == 0.5


def test_numbering_is_global(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"), F.col("id").alias("v"))
    old, scratch.RANGE = scratch.RANGE, 300
    try:
        got = bindings.numbered(df, ["k", "v"]).collect()
    finally:
        scratch.RANGE = old
    assert [r.point_idx for r in sorted(got, key=lambda r: (r.k, r.v))] == list(range(5000))


def test_camera_stream_is_the_batch_fold(spark, tmp_path):
    from pcq.plans.queries import control_log

    log = control_log(spark, SF).filter("cast(session AS int) < 20")
    log.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/in")
    q = control.camera_stream(stream).writeStream.format("memory").queryName("cams").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r.session, r.signals, *(round(r[c], 6) for c in ("yaw", "pitch", "zoom", "pan_x", "pan_y")), r.mode)
    assert sorted(map(key, spark.table("cams").collect())) == sorted(map(key, control.camera_fold(log).collect()))


@pytest.mark.parametrize("name", ["cloud_bounds", "grid_csr_offsets", "octree_stats", "lru_evict", "pick_nearest", "camera_fold"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str(tuple(r)) for r in df.select(*cols).collect())
    rel = con.execute(f"SELECT {', '.join(f'"{c}"' for c in cols)} FROM ({catalog.ORACLES[name]})")
    assert got == sorted(map(str, rel.fetchall()))


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
