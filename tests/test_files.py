"""Files written and read back, E57's bit fields, first-fit allocation, drags, and trees with leaves at many depths."""

import bz2
import math
import random
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pcq import catalog, sources
from pcq.functions import camera as C
from pcq.operators import cache, lod, octree
from pcq.sources import e57, las, laz, records, writers
from pcq.streaming import control

SF = "/root/testdata/sf0.001"
NAMES = ["las_roundtrip", "laz_roundtrip", "las_chunks", "las_header", "las_viewport", "orbit_moves", "visible_chunks", "ply_header", "e57_fields", "ply_ascii_roundtrip", "ply_gzip_roundtrip", "e57_bzip2_roundtrip", "rxp_roundtrip", "xyz_roundtrip", "octree_points_roundtrip", "octree_hierarchy_roundtrip", "octree_node_range", "chunk_tiers", "drag_fold", "first_fit_reuse"]


@pytest.mark.parametrize("name", NAMES)
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "lineitem", "documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda r: tuple("" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r)
    assert sorted(map(key, got.select(*columns).collect())) == sorted(map(key, want.project(", ".join(f'"{c}"' for c in columns)).fetchall()))


def test_e57_fields_of_odd_widths():
    """Bits stand highest first, whatever a field's width; ranges shift and scale."""
    r = random.Random(3)
    node = lambda kind, name, **more: {"kind": kind, "name": name, **more}
    fields = [e57.field_of(node(e57.FLOAT, "a"), single=True), e57.field_of(node(e57.INTEGER, "b"), -3, 9), e57.field_of(node(e57.SCALED, "c", scale=0.5, offset=10.0), 9.0, 40.0), e57.field_of(node(e57.INTEGER, "d"), 7, 7), e57.field_of(node(e57.INTEGER, "e"))]
    assert [f.bits for f in fields] == [32, 4, 6, 0, 32]
    rows = [(struct.unpack(">f", struct.pack(">f", r.uniform(-9, 9)))[0], r.randint(-3, 9), 9.0 + 0.5 * r.randint(0, 62), 7, r.randint(-(1 << 31), (1 << 31) - 1)) for _ in range(50)]
    bits = "".join(f"{struct.unpack('>I', struct.pack('>f', a))[0]:032b}{b + 3:04b}{round((c - 9.0) / 0.5):06b}{e & 0xFFFFFFFF:032b}" for a, b, c, _, e in rows)
    raw = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    got = e57.unpack(raw, 50, fields)
    assert list(zip(*(got[f.name].tolist() for f in fields), strict=True)) == rows


def test_e57_points():
    inf, nan = float("inf"), float("nan")
    p = e57.points_of({"cartesianX": np.array([1.0, nan, inf]), "cartesianZ": np.array([4.0, 5.0, 6.0]), "colorRed": np.array([0.5, 300.0, 1.0]), "colorGreen": np.array([1.0, -4.0, 1.0]), "colorBlue": np.array([0.0, 9.0, 1.0])})
    assert p["x"].tolist() == [1.0, 0.0] and p["y"].tolist() == [0.0, 0.0] and p["r"].tolist() == [127, 255] and p["g"].tolist() == [255, 0]
    assert e57.points_of({})["x"].tolist() == []


def test_damaged_and_empty_files(spark, tmp_path):
    sources.register(spark)
    (tmp_path / "a.e57").write_bytes(b"nothing of the kind")
    with pytest.raises(Exception, match="not an E57"):
        spark.read.format("e57").load(f"{tmp_path}/a.e57").count()
    columns = {c: np.zeros(0) for c in ("x", "y", "z", "r", "g", "b", "intensity", "gps_time", "classification", "source_id", "return_number", "num_returns")}
    for form, (suffix, encode) in writers.ENCODERS.items():
        if form != "rxp":
            folder = f"{tmp_path}/{form.replace(' ', '-')}"
            records.write_bytes(f"{folder}/none{suffix}", encode(columns))
            assert sources.load(spark, folder).count() == 0
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no reader"):
        sources.load(spark, f"{tmp_path}/none")
    cut = writers.e57_bytes({c: np.arange(5.0) for c in ("x", "y", "z", "r", "g", "b", "intensity")}, compressed=True)
    assert bz2.decompress(cut[72 : 64 + int.from_bytes(cut[65:68], "big") * 4].rstrip(b"\0")) is not None
    # A packet that the file does not hold whole ends the points.
    at = 64 + int.from_bytes(cut[65:68], "big") * 4
    (tmp_path / "b.e57").write_bytes(cut)
    assert spark.read.format("e57").load(f"file://{tmp_path}/b.e57").count() == 5 and at < len(cut)


def test_first_fit_against_a_plain_list(spark):
    r = random.Random(9)
    log, want = [], []
    for key in range(3):
        free, live, end, names = [], {}, 0, []
        for seq in range(400):
            if names and r.random() < 0.45:
                name = names.pop(r.randrange(len(names)))
                log.append((key, seq, "free", name, 0))
                if name in live:
                    free = sorted([*free, live.pop(name)])
                    k = 0
                    while k + 1 < len(free):
                        if free[k][0] + free[k][1] >= free[k + 1][0]:
                            free[k : k + 2] = [(free[k][0], free[k][1] + free[k + 1][1])]
                        else:
                            k += 1
                continue
            count = r.randint(1, 30)
            log.append((key, seq, "alloc", seq, count))
            names.append(seq)
            k = next((k for k, f in enumerate(free) if f[1] >= count), None)
            if k is not None:
                offset, n = free.pop(k)
                if n > count:
                    free.insert(k, (offset + count, n - count))
            elif end + count <= 300:
                offset, end = end, end + count
            else:
                offset = -1
            if offset >= 0:
                live[seq] = (offset, count)
            want.append((key, seq, seq, offset))
    df = spark.createDataFrame(log, "k long, seq long, kind string, id long, count long").repartition(4)
    assert sorted(map(tuple, cache.first_fit(df, "k", 300).select("k", "seq", "id", "offset").collect())) == sorted(want)
    assert any(o == -1 for *_, o in want)


def test_drags_keep_their_limits(spark):
    ring = [(100.0, 0.0, 0.0, 1.0, 100.0)]
    log = [("a", 0, "scale", "center", 0.0, 0.0), ("a", 1, "scale", "center", 1e6, 0.0), ("a", 2, "rotate", "z", 1e6, 50.0), ("a", 3, "rotate", "center", 1e6, 90.0), ("b", 0, "scale", "y", 5.0, 5.0), ("b", 1, "scale", "y", -900.0, 5.0)]
    got = {r.session: r for r in control.drag_fold(spark.createDataFrame(log, "session string, seq long, mode string, axis string, sx double, sy double"), ring).collect()}
    assert (got["a"].scale_x, got["a"].scale_z, got["a"].moves) == (100.0, 100.0, 4) and math.isclose(got["a"].rot_z, math.degrees(0.5)) and got["a"].rot_x == 0
    assert (got["b"].scale_x, got["b"].scale_y) == (1.0, 0.01)


def test_leaves_at_many_depths(spark, monkeypatch):
    """Points crowded into a corner: every point finds its own leaf, and ancestors follow from a node's row."""
    r = np.random.default_rng(1)
    xyz = np.concatenate([r.random((400, 3)), r.random((800, 3)) * 0.01, np.full((60, 3), 0.003), r.random((5, 3)) * 1e-4])
    df = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(xyz)], "point_idx long, x double, y double, z double")
    p = octree.with_path(df, (0.0,) * 3, (1.0,) * 3)
    nodes = octree.with_box(octree.nodes(p, 20), (0.0,) * 3, (1.0,) * 3)
    rows = {n.name: n for n in nodes.collect()}
    paths = {r.point_idx: r.path for r in p.collect()}
    count = lambda name: sum(q.startswith(name) for q in paths.values())
    want, todo = set(), ["r"]
    while todo:
        name = todo.pop()
        want.add(name)
        if count(name) > 20 and len(name) <= 12:
            todo += [name + d for d in "01234567" if count(name + d)]
    assert set(rows) == want and all(rows[n].num_points == count(n) for n in want)
    found = {x.point_idx: x.leaf for x in octree.leaf_of(p, nodes).select("point_idx", "leaf").collect()}
    monkeypatch.setattr(octree, "BROADCAST_NODES", 0)
    assert found == {x.point_idx: x.leaf for x in octree.leaf_of(p, octree.nodes(p, 20)).select("point_idx", "leaf").collect()}
    assert len(found) == len(xyz) and all(rows[f].is_leaf and paths[k].startswith(f) for k, f in found.items())
    assert max(n.depth for n in rows.values()) == 12
    assert {x.name for x in nodes.filter(lod._ancestors(lambda j, lo, hi: (hi[0] - lo[0]) > 0.2)).collect()} == {n for n in want if len(n) - 1 <= 3}
    assert C.preset(C.View(), "right").tilt_y == -90.0


def test_orbit_camera_moves():
    """Ahead is where the camera looks, along the ground; right is its right hand; the eye keeps its place to the target."""
    r = random.Random(2)
    for _ in range(20):
        cam = C.Orbit(radius=r.uniform(1, 50), phi=r.uniform(0.1, 3), theta=r.uniform(-4, 4), target=(1.0, 2.0, 3.0))
        right, _, back, _ = cam.view_matrix()
        flat = math.hypot(back[0], back[2])
        ahead = cam.move(ahead=2.0).target
        assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(ahead, (1 - 2 * back[0] / flat, 2.0, 3 - 2 * back[2] / flat), strict=True))
        drag = cam.pan(40.0, 6.0)
        scale = cam.radius * 0.0005
        assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(drag.target, (1 + 40 * scale * right[0], 2 + 6 * scale, 3 + 40 * scale * right[2]), strict=True))
        assert all(math.isclose(a - b, c - d, abs_tol=1e-9) for a, b, c, d in zip(drag.position(), drag.target, cam.position(), cam.target, strict=True))
        assert cam.move(up=5.0).target == (1.0, 7.0, 3.0)


@pytest.mark.parametrize("form", ["las", "laz", "rxp"])
def test_values_beyond_16_bits(spark, tmp_path, form):
    """Intensities and sources that a plain record can't hold come back whole; files that don't need more bytes have none."""
    i = F.col("id")
    far = F.when(i < 500, i).otherwise(i * 1000 - 3)
    df = spark.range(1000).select(i.alias("point_idx"), *[(i / 4).cast("float").alias(c) for c in "xyz"], far.cast("float").alias("intensity"), far.cast("int").alias("source_id"), (i + 0.5).alias("gps_time"))
    assert writers.write_points(df.repartitionByRange(4, "point_idx"), f"{tmp_path}/{form}", form) == 1000
    columns = ["x", "intensity"] if form == "rxp" else ["x", "intensity", "source_id", "gps_time"]
    got = sources.load(spark, f"{tmp_path}/{form}").select(*columns).orderBy("x").collect()
    assert got == df.select(*columns).orderBy("x").collect()
    if form == "las":
        heads = [las.header(str(p)) for p in sorted((tmp_path / form).glob("*.las"))]
        assert sorted({h["length"] for h in heads}) == [34, 42]
        writers.write_points(df, f"{tmp_path}/plain", "las plain")
        assert {las.header(str(p))["length"] for p in (tmp_path / "plain").glob("*.las")} == {34}
        assert sources.load(spark, f"{tmp_path}/plain").agg(F.max("intensity")).first()[0] == 65535


def test_extra_bytes_of_others_are_stepped_over(tmp_path):
    """The columns of this library are found behind extra bytes of other types, and in LAZ behind further records."""
    c = {k: np.arange(5.0) for k in "xyz"} | {k: np.arange(5) for k in ("return_number", "num_returns", "r", "g", "b", "classification", "gps_time", "source_id")} | {"intensity": np.arange(5.0) * 70_000}
    plain = bytearray(writers.las_bytes(c))
    at = 227 + 54
    # The description of the sources becomes one of bytes without a type in front of the intensities.
    plain[at : at + 384] = writers._descriptor(0, "other")[:3] + bytes([4]) + writers._descriptor(0, "other")[4:] + bytes(plain[at : at + 192])
    rows = np.frombuffer(bytes(plain[at + 384 :]), np.uint8).reshape(5, 42)
    moved = np.concatenate([rows[:, :34], rows[:, 38:], rows[:, 34:38]], 1).tobytes()
    for name, data in (("a.las", bytes(plain[: at + 384]) + moved), ("a.laz", laz.compress(bytes(plain[: at + 384]) + moved))):
        (tmp_path / name).write_bytes(data)
        assert las.extra(str(tmp_path / name)) == {"intensity": (38, "<f4")}
        got = las.LasReader({"path": str(tmp_path / name)}).decode(str(tmp_path / name), 0, 5)
        assert got["intensity"].tolist() == c["intensity"].tolist()
    with pytest.raises(ValueError, match="32 bits"):
        writers.las_bytes(c | {"x": np.array([0, 0, 0, 0, 3e7])})


def test_fingerprint_of_odd_heads(spark):
    """Empty, short, signed and long heads, in one pass over bytes and no step of the plan for each byte."""
    heads = [b"", b"a", bytes([255] * 7), bytes(range(256)) * 4, bytes(range(256)) * 5, None]

    def name(raw):
        h = 0
        for b in raw[:1024]:
            h = (h * 31 + b) & 0xFFFFFFFF
        return np.base_repr(abs(h - (1 << 32) if h >= 1 << 31 else h), 36).lower() + "_" + np.base_repr(len(raw), 36).lower()

    df = spark.createDataFrame([(k, h) for k, h in enumerate(heads)], "k int, h binary")
    got = df.select("k", cache.fingerprint(F.col("h"), F.octet_length("h")).alias("name"))
    assert [r.name for r in got.orderBy("k").collect()] == [None if h is None else name(h) for h in heads]
    assert "lambda" not in got._jdf.queryExecution().toString()
