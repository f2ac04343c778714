import gzip
import struct

import numpy as np
import pytest

from pcq import sources
from pcq.sources import octree_dataset
from pcq.sources.xyz import parse_lines


def las_bytes(points, fmt=3, minor=2, count=None):
    sizes = {0: 20, 3: 34, 7: 36}
    head = bytearray(375 if minor >= 4 else 227)
    head[:4] = b"LASF"
    head[24:26] = bytes([1, minor])
    struct.pack_into("<HI", head, 94, len(head), len(head))
    struct.pack_into("<BHI", head, 104, fmt, sizes[fmt], len(points) if count is None else count)
    struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.01, 10, 20, 30)
    if minor >= 4:
        struct.pack_into("<Q", head, 247, len(points))
    body = b""
    for x, y, z, i, c in points:
        rec = bytearray(sizes[fmt])
        struct.pack_into("<iiiH", rec, 0, x, y, z, i)
        rec[14] = 0x21 if fmt >= 6 else 0b010001
        rec[16 if fmt >= 6 else 15] = c
        if fmt == 3:
            struct.pack_into("<d3H", rec, 20, 5.5, 256, 512, 65535)
        if fmt == 7:
            struct.pack_into("<d3H", rec, 22, 5.5, 256, 512, 65535)
        body += rec
    return bytes(head) + body


@pytest.mark.parametrize(("fmt", "minor"), [(0, 2), (3, 2), (7, 4)])
def test_las(spark, tmp_path, fmt, minor):
    pts = [(100 * k, 200 * k, -50 * k, k, k % 5) for k in range(7)]
    (tmp_path / "a.las").write_bytes(las_bytes(pts, fmt, minor))
    got = sources.load(spark, str(tmp_path / "a.las")).orderBy("point_idx").collect()
    assert [r.point_idx for r in got] == list(range(7))
    assert [round(r.x, 3) for r in got] == [10 + k for k in range(7)]
    assert [r.intensity for r in got] == list(range(7))
    assert [r.classification for r in got] == [k % 5 for k in range(7)]
    assert {(r.return_number, r.num_returns) for r in got} == {(1, 2)}
    assert got[0].r == (None if fmt == 0 else 1) and got[0].b == (None if fmt == 0 else 255)
    assert got[0].gps_time == (None if fmt == 0 else 5.5)


def test_las_truncated_and_split(spark, tmp_path):
    (tmp_path / "a.las").write_bytes(las_bytes([(k, k, k, 0, 0) for k in range(10)], count=1000))
    sources.register(spark)
    df = spark.read.format("las").option("part_records", "3").load(str(tmp_path / "a.las"))
    assert df.count() == 10 and df.rdd.getNumPartitions() == 4


def test_laz_is_refused(spark, tmp_path):
    (tmp_path / "a.laz").write_bytes(las_bytes([(1, 1, 1, 0, 0)]))
    with pytest.raises(Exception, match="compressed"):
        sources.load(spark, str(tmp_path / "a.laz")).count()


HEAD = "ply\nformat {} 1.0\ncomment x\nelement vertex 3\nproperty float x\nproperty float y\nproperty double z\nproperty {c} red\nproperty {c} green\nproperty {c} blue\nproperty float scalar_Intensity\nend_header\n"


@pytest.mark.parametrize("zipped", [False, True])
def test_ply_binary(spark, tmp_path, zipped):
    kind = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f8"), ("r", "u1"), ("g", "u1"), ("b", "u1"), ("i", "<f4")])
    rows = np.array([(k, 2 * k, 3 * k, 10 + k, 20, 255, 0.5) for k in range(3)], kind)
    raw = HEAD.format("binary_little_endian", c="uchar").encode() + rows.tobytes()
    path = tmp_path / ("a.ply.gz" if zipped else "a.ply")
    path.write_bytes(gzip.compress(raw) if zipped else raw)
    got = sources.load(spark, str(path)).orderBy("point_idx").collect()
    assert [(r.x, r.y, r.z, r.r, r.b, r.intensity) for r in got] == [(k, 2 * k, 3 * k, 10 + k, 255, 0.5) for k in range(3)]


def test_ply_ascii_scales_float_colours(spark, tmp_path):
    text = HEAD.format("ascii", c="float") + "1 2 3 0.5 1 2 7\n\n4 5\n6 7 8 0 0 0 9\n"
    (tmp_path / "a.ply").write_text(text)
    got = sources.load(spark, str(tmp_path / "a.ply")).orderBy("point_idx").collect()
    assert [(r.x, r.r, r.g, r.b, r.intensity) for r in got] == [(1, 127, 255, 255, 7), (6, 0, 0, 0, 9)]


@pytest.mark.parametrize("bad", ["ply\nformat binary_big_endian 1.0\nelement vertex 0\nend_header\n", "ply\nformat ascii 1.0\nelement vertex 1\nproperty list uchar int x\nend_header\n", "no"])
def test_ply_refuses(spark, tmp_path, bad):
    (tmp_path / "a.ply").write_text(bad)
    with pytest.raises(Exception, match="supported|not a PLY"):
        sources.load(spark, str(tmp_path / "a.ply")).count()


def test_xyz(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("3\n# c\n// d\n1 2 3\r\n1,2,3,7\n4\t5 6 0.5 0.25 1\n4 5 6 300 20 10\nx y z\n7.5abc 8 9\n\n")
    got = {(r.x, r.y, r.z, r.r, r.g, r.b, r.intensity) for r in sources.load(spark, str(tmp_path / "a.xyz")).collect()}
    assert got == {(1, 2, 3, 180, 180, 200, None), (1, 2, 3, 7, 7, 7, 7), (4, 5, 6, 127, 63, 255, 0.5), (4, 5, 6, 255, 20, 10, 300), (7.5, 8, 9, 180, 180, 200, None)}


def test_xyz_empty(spark):
    assert parse_lines(spark.createDataFrame([], "value string")).count() == 0


@pytest.mark.parametrize("stride", [26, 29])
def test_rxp(spark, tmp_path, stride):
    body = b"".join((struct.pack("<3dH", k + 1.5, k, -k, k * 10) + bytes([1, 2, 3]))[:stride] for k in range(50))
    (tmp_path / "a.rxp").write_bytes(b"\0" * 1024 + body)
    got = sources.load(spark, str(tmp_path / "a.rxp")).orderBy("point_idx").collect()
    assert len(got) == 50 and got[3].x == 4.5 and got[3].intensity == 30 and got[3].g == (2 if stride == 29 else None)


def test_unknown_suffix(spark):
    with pytest.raises(ValueError, match="no reader"):
        sources.load(spark, "a.docx")


def test_octree_dataset_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    xyz = rng.random((500, 3)).astype(np.float32)
    rows = [(k, *map(float, p), k % 256, 0, 7, float(k % 11) / 10, k % 9) for k, p in enumerate(xyz)]
    df = spark.createDataFrame(rows, "point_idx long, x float, y float, z float, r int, g int, b int, intensity float, classification int")
    stats = octree_dataset.write_dataset(df, str(tmp_path / "d"), (0.0,) * 3, (1.0,) * 3, leaf_size=50)
    assert stats["total_points"] == 500 and stats["bytes"] == 500 * 19
    back = sources.load(spark, str(tmp_path / "d" / "metadata.json")).collect()
    key = lambda r: (r.x, r.y, r.z, r.r, r.b, round(r.intensity, 2), r.classification)
    assert sorted(map(key, back)) == sorted((*map(float, p), k % 256, 7, round(k % 11 / 10, 2), k % 9) for k, p in enumerate(xyz))
    nodes = octree_dataset.read_nodes(spark, str(tmp_path / "d")).collect()
    assert sum(n.num_points for n in nodes if n.is_leaf) == 500 and len(nodes) == stats["total_nodes"]
    leaf = next(n.name for n in nodes if n.is_leaf)
    one = spark.read.format("octree").option("nodes", leaf).load(str(tmp_path / "d"))
    assert {r.src for r in one.collect()} == {leaf}
    assert spark.read.format("octree_hierarchy").load(str(tmp_path / "d")).count() == len(nodes)


def test_convert(spark, tmp_path):
    from pcq.convert import main

    (tmp_path / "a.las").write_bytes(las_bytes([(100 * k, 7 * k % 1000, k * k % 500, k, k % 5) for k in range(300)]))
    made = main([str(tmp_path / "a.las"), str(tmp_path / "out"), "--leaf-size", "40"])
    assert made["total_points"] == 300
    back = sources.load(spark, str(tmp_path / "out" / "metadata.json")).collect()
    assert len(back) == 300 and max(r.intensity for r in back) == 1.0
    (tmp_path / "b.xyz").write_text("1 2 3\n4 5 6\n")
    assert main([str(tmp_path / "b.xyz"), str(tmp_path / "out2")])["total_points"] == 2
