"""Octree datasets: filters that prune blocks, the sink's commit, odd hierarchies; files of records pruned by their headers."""

import json
import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from pcq import sources
from pcq.sources import octree_dataset, records, writers

LO, HI = (0.0,) * 3, (1.0,) * 3


@pytest.fixture(scope="module")
def cloud(spark):
    r = np.random.default_rng(3)
    xyz = np.concatenate([r.random((900, 3)), r.random((300, 3)) * 0.05, np.full((30, 3), 0.7)]).astype(np.float32)
    rows = [(k, *map(float, p), k % 256, k % 7, float(k % 11) / 10) for k, p in enumerate(xyz)]
    return spark.createDataFrame(rows, "point_idx long, x float, y float, z float, r int, classification int, intensity float").repartition(3)


@pytest.fixture(scope="module")
def dataset(spark, cloud, tmp_path_factory):
    """A dataset of several parts."""
    path = str(tmp_path_factory.mktemp("dataset") / "d")
    kept, octree_dataset.PART_BYTES = octree_dataset.PART_BYTES, 4000
    made = octree_dataset.write_dataset(cloud, path, LO, HI, leaf_size=25)
    octree_dataset.PART_BYTES = kept
    assert made["total_points"] == 1230 and made["bytes"] == 1230 * 19 and len(octree_dataset.files_of(path)) > 3
    return path


def read(spark, path):
    sources.register(spark)
    return spark.read.format("octree").load(path)


def planned(path, *filters):
    """Blocks that a reader plans under filters."""
    reader = octree_dataset.OctreeReader({"path": path})
    assert reader.pushFilters(list(filters)) == list(filters)
    return [b for p in reader.partitions() for b in reader.blocks(p)], len(reader.partitions())


def key(r):
    return r.src, r.point_idx, r.x, r.y, r.z, r.r, r.classification, r.depth, r.key


FILTERS = [
    "startswith(src, 'r7')", "src = 'r000'", "src in ('r4', 'r51', 'r000')", "depth <= 2", "depth = 3 and x < 0.25", "key >= 576460752303423488 and key < 720575940379279360", "x >= 0.75 and y < 0.125",
    "x = 0.7f", "z > 2", "x > 0.5 or y > 0.5", "intensity > 0.5 and src >= 'r3' and src < 'r5'", "src > 'r2' and startswith(src, 'r') and x is not null",
]


@pytest.mark.parametrize("condition", FILTERS)
def test_filters_keep_all_rows(spark, dataset, condition):
    rows = read(spark, dataset).collect()
    everything = spark.createDataFrame(rows, read(spark, dataset).schema)
    assert sorted(map(key, read(spark, dataset).filter(condition).collect())) == sorted(map(key, everything.filter(condition).collect()))


def test_filters_spare_bytes(spark, dataset):
    nodes = [n for n in octree_dataset.read_nodes(spark, dataset).collect() if n.is_leaf]
    every, parts = planned(dataset)
    assert sum(b[2] for b in every) == 1230 * 19 and len(every) == len(nodes)
    some, fewer = planned(dataset, D.StringStartsWith(("src",), "r7"))
    assert {b[0] for b in some} == {n.name for n in nodes if n.name.startswith("r7")} and fewer < parts
    some, _ = planned(dataset, D.GreaterThanOrEqual(("x",), 0.75), D.LessThan(("y",), 0.125))
    assert 0 < sum(b[2] for b in some) < 1230 * 19 / 4
    some, _ = planned(dataset, D.EqualTo(("depth",), 2))
    assert {b[0] for b in some} == {n.name for n in nodes if n.depth == 2}
    low, high = octree_dataset.first_key("r31"), octree_dataset.first_key("r32") - 1
    some, _ = planned(dataset, D.GreaterThanOrEqual(("key",), low), D.LessThanOrEqual(("key",), high))
    assert {b[0] for b in some} == {n.name for n in nodes if low <= octree_dataset.first_key(n.name) <= high} != set()
    assert planned(dataset, D.EqualTo(("src",), "nothing"))[0] == []


def test_pruned_parts_are_not_opened(spark, dataset, tmp_path):
    """With the other parts' files gone, a filter still finds its rows, and a full read fails."""
    import shutil

    path = str(tmp_path / "d")
    shutil.copytree(dataset, path)
    want = sorted(map(key, read(spark, path).filter("startswith(src, 'r7')").collect()))
    for part in octree_dataset.files_of(path):
        if not part["first"] <= "r7" <= part["last"] and not part["first"].startswith("r7"):
            os.remove(f"{path}/{part['octree']}")
    assert want and sorted(map(key, read(spark, path).filter("startswith(src, 'r7')").collect())) == want
    with pytest.raises(Exception, match="No such file|FileNotFound"):
        read(spark, path).collect()


def test_hierarchy_in_parts(spark, dataset, cloud):
    """Offsets run through all parts; points are in the order of point_idx within a leaf."""
    nodes = sorted(octree_dataset.read_nodes(spark, dataset).collect())
    at = 0
    for n in nodes:
        assert n.byte_offset == at
        at += n.byte_size
        assert n.byte_size == (19 * n.num_points if n.is_leaf else 0)
    assert at == 1230 * 19
    assert {n.name for n in nodes if n.name.startswith("r0")} == {r["name"] for r in octree_dataset.read_nodes(spark, dataset).filter("startswith(name, 'r0')").collect()}
    rows = read(spark, dataset).collect()
    assert sorted(r.point_idx for r in rows) == list(range(1230))
    own = {(r.x, r.y, r.z, r.r, r.classification): r.point_idx for r in cloud.collect() if r.x != np.float32(0.7)}
    by_leaf = {}
    for r in sorted(rows, key=lambda r: r.point_idx):
        if r.x != np.float32(0.7):
            by_leaf.setdefault(r.src, []).append(own[r.x, r.y, r.z, r.r, r.classification])
    assert all(x == sorted(x) for x in by_leaf.values())


def test_points_beyond_the_box_are_found(spark, tmp_path):
    rows = [(k, x, 0.5, 0.5) for k, x in enumerate([-3.0, -0.001, 0.2, 0.6, 0.999, 1.0, 5.0] * 4)]
    df = spark.createDataFrame(rows, "point_idx long, x float, y float, z float")
    octree_dataset.write_dataset(df, str(tmp_path / "d"), LO, HI, leaf_size=3)
    for condition in ("x > 2", "x < -1", "x >= 1", "x < 0", "x > 0.1 and x < 0.7"):
        assert read(spark, str(tmp_path / "d")).filter(condition).count() == df.filter(condition).count() > 0


def test_a_failed_job_leaves_nothing(spark, cloud, tmp_path):
    path = str(tmp_path / "d")

    @F.udf("float")
    def fails(k):
        if k == 1000:
            raise ValueError("lost")
        return 0.5

    @F.udf("long")
    def too_many(n):
        return n + 1

    with pytest.raises(Exception, match="lost"):
        octree_dataset.write_dataset(cloud.withColumn("intensity", fails("point_idx")), path, LO, HI, leaf_size=25)
    assert not os.path.exists(path) or os.listdir(path) == []
    # A node's row that does not fit its points fails in the sink's own task, after other tasks have written.
    head = json.dumps({"boundingBox": {}, "attributes": []})
    points = cloud.limit(40).select(F.lit("r").alias("name"), F.lit(True).alias("is_point"), "point_idx", "x", "y", "z", F.lit(1).alias("r"), F.lit(1).alias("g"), F.lit(1).alias("b"), "intensity", "classification")
    root = spark.createDataFrame([("r", False, 41, 0, True)], "name string, is_point boolean, num_points long, child_mask int, is_leaf boolean")
    bad = root.unionByName(points, allowMissingColumns=True).coalesce(1).sortWithinPartitions("name", "is_point")
    spark.dataSource.register(octree_dataset.OctreeSource)
    with pytest.raises(Exception, match="node r has 40 points, not 41"):
        bad.write.format("octree").mode("overwrite").option("metadata", head).save(path)
    assert not os.path.exists(path) or os.listdir(path) == []
    octree_dataset.write_dataset(cloud, path, LO, HI, leaf_size=400)
    before = sorted(map(key, read(spark, path).collect())), sorted(os.listdir(path))
    with pytest.raises(Exception, match="lost"):
        octree_dataset.write_dataset(cloud.withColumn("intensity", fails("point_idx")), path, LO, HI, leaf_size=25)
    with pytest.raises(Exception, match="holds a dataset already"):
        bad.write.format("octree").mode("append").option("metadata", head).save(path)
    assert (sorted(map(key, read(spark, path).collect())), sorted(os.listdir(path))) == before
    # A new dataset takes the old one's place, and leaves none of its files.
    octree_dataset.write_dataset(cloud.limit(30), path, LO, HI)
    assert read(spark, path).count() == 30 and len(os.listdir(path)) == 3


def test_joined_files(spark, dataset, tmp_path):
    out = str(tmp_path / "one")
    octree_dataset.join_files(spark, dataset, out)
    assert sorted(os.listdir(out)) == ["hierarchy.bin", "metadata.json", "octree.bin"]
    assert sorted(map(key, read(spark, out).collect())) == sorted(map(key, read(spark, dataset).collect()))
    assert sorted(octree_dataset.read_nodes(spark, out).collect()) == sorted(octree_dataset.read_nodes(spark, dataset).collect())
    assert sorted(map(key, read(spark, out).filter("startswith(src, 'r7')").collect())) == sorted(map(key, read(spark, dataset).filter("startswith(src, 'r7')").collect()))
    small = spark.read.format("octree").option("part_bytes", 3000).load(out)
    assert small.count() == 1230 and small.rdd.getNumPartitions() > 4


def test_hierarchy_entries_of_fixed_size():
    """Without a name flag an entry is the root if it comes first, and has no name otherwise; a cut entry ends the list."""
    fixed = lambda mask, n, at, size: struct.pack("<BBIqq", 0, mask, n, at, size)
    named = lambda name, mask, n, at, size: bytes([0x80 | len(name)]) + name + struct.pack("<BBIqq", mask, 0, n, at, size)
    raw = fixed(1, 9, 0, 0) + named(b"r0", 0, 5, 0, 95) + fixed(0, 4, 95, 76) + named(b"r0", 0, 6, 7, 114)
    want = [("r", 0, 9, 1, False, 0, 0), ("r0", 1, 6, 0, True, 7, 114)]
    assert octree_dataset.entries(raw) == want
    assert octree_dataset.entries(raw + named(b"r1", 0, 5, 0, 95)[:-1]) == want
    assert octree_dataset.entries(raw + b"\x82") == want and octree_dataset.entries(b"") == []


def test_pushed_ranges_of_names():
    r = random.Random(2)
    names = ["".join(r.choice("ab") for _ in range(r.randint(0, 4))) for _ in range(60)]
    for _ in range(400):
        low, high = sorted(r.choices(names, k=2))
        s = r.choice(names)
        pushed = records.Pushed([D.StringStartsWith(("n",), s)])
        if any(low <= n <= high and n.startswith(s) for n in names):
            assert pushed.meets("n", low, high)
        if low == high:
            assert pushed.meets("n", low, high) == low.startswith(s)


def test_las_files_are_pruned_by_their_headers(spark, tmp_path):
    for k in range(4):
        columns = {c: np.zeros(50) for c in ("r", "g", "b", "intensity", "gps_time", "classification", "source_id", "return_number", "num_returns")}
        records.write_bytes(f"{tmp_path}/{k}.las", writers.las_bytes(columns | {c: np.linspace(k, k + 0.5, 50) for c in "xyz"}))
    sources.register(spark)
    df = spark.read.format("las").load(str(tmp_path))
    from pcq.sources.las import LasReader

    for condition, files in (("x > 1.9", 2), ("y <= 0.5 and z >= 0", 1), ("src = '3.las'", 1), ("point_idx between 60 and 70", 1), ("x = 2", 1), ("z < 1.2", 2)):
        rows = [r.point_idx for r in df.collect()]
        want = [r.point_idx for r in spark.createDataFrame(df.collect(), df.schema).filter(condition).collect()]
        got = df.filter(condition)
        assert sorted(r.point_idx for r in got.collect()) == sorted(want) and len(rows) == 200
        assert got.select(F.spark_partition_id()).rdd.getNumPartitions() == files, condition
    reader = LasReader({"path": str(tmp_path)})
    assert reader.pushFilters([D.GreaterThan(("x",), 9.0)]) and [p.count for p in reader.partitions()] == [0]


def las_folder(path):
    """Three files whose points move along x."""
    r = np.random.default_rng(5)
    for k in range(3):
        n = (700, 0, 530)[k]
        columns = {c: np.zeros(n) for c in ("r", "g", "b", "gps_time", "classification", "source_id", "return_number", "num_returns")}
        columns |= {"x": np.linspace(1000 * k, 1000 * k + 900, n), "y": r.random(n) * 400, "z": r.random(n) * 300, "intensity": np.arange(n) % 50}
        records.write_bytes(f"{path}/{k}.las", writers.las_bytes(columns))


def test_zone_maps(spark, tmp_path):
    """A viewport by the index equals a full scan with a filter, reads fewer ranges, and opens none of the others."""
    from pcq.functions.camera import View
    from pcq.sources import zones

    las_folder(tmp_path / "las")
    index = zones.build(spark, str(tmp_path / "las"), str(tmp_path / "index"), records=100)
    rows = index.collect()
    assert sorted((os.path.basename(r.path), r.first, r["count"], r.base) for r in rows) == [("0.las", a, 100, a) for a in range(0, 700, 100)] + [("2.las", a, min(100, 530 - a), 700 + a) for a in range(0, 530, 100)]
    scan = sources.load(spark, str(tmp_path / "las"))
    own = lambda df: sorted((r.point_idx, r.src, r.x, r.y, r.z, r.intensity) for r in df.collect())
    assert own(zones.load(spark, str(tmp_path / "index"))) == own(scan)
    box = zones.in_box((100.0, 0.0, 0.0), (260.0, 500.0, 500.0))
    assert index.filter(box).count() == 3
    inside = "x between 100 and 260"
    assert own(zones.load(spark, str(tmp_path / "index"), box).filter(inside)) == own(scan.filter(inside)) != []
    assert zones.load(spark, str(tmp_path / "index"), zones.in_box((5000.0,) * 3, (6000.0,) * 3)).count() == 0
    for view in (View(zoom=0.9, pan_x=100.0, pan_y=300.0), View(zoom=0.5, pan_x=-300.0, pan_y=100.0, rot=0.1), View(zoom=0.01)):
        assert own(zones.shown(spark, str(tmp_path / "index"), view)) == own(zones.on_screen(scan, view)) != []
    near = zones.in_view(View(zoom=0.9, pan_x=100.0, pan_y=300.0))
    met = {(r.path, r.first) for r in index.filter(near).collect()}
    assert 0 < len(met) < len(rows)
    # Ranges that are not met hold other bytes now; the view is as it was.
    want = own(zones.shown(spark, str(tmp_path / "index"), View(zoom=0.9, pan_x=100.0, pan_y=300.0)))
    for r in rows:
        if (r.path, r.first) not in met:
            with open(r.path.removeprefix("file:"), "r+b") as f:
                f.seek(227 + 34 * r.first)
                f.write(b"\x07" * 34 * r["count"])
    assert own(zones.shown(spark, str(tmp_path / "index"), View(zoom=0.9, pan_x=100.0, pan_y=300.0))) == want
    with open(tmp_path / "las" / "0.las", "ab") as f:
        f.write(b"more")
    with pytest.raises(Exception, match="has changed since"):
        zones.load(spark, str(tmp_path / "index")).count()
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        zones.build(spark, str(tmp_path / "las"), str(tmp_path / "index"))


def test_zones_of_odd_files(spark, tmp_path):
    """No records, no intensity, coordinates that are not numbers, and files without ranges."""
    from pcq.sources import zones

    head = b"ply\nformat binary_little_endian 1.0\nelement vertex %d\nproperty float x\nproperty float y\nproperty float z\nend_header\n"
    nan = float("nan")
    rows = np.array([(nan, nan, nan), (nan, nan, nan), (1, nan, 3), (2, 5, 3)], "<f4")
    records.write_bytes(f"{tmp_path}/p/a.ply", head % 4 + rows.tobytes())
    records.write_bytes(f"{tmp_path}/p/b.ply", head % 0)
    found = sorted(zones.build(spark, f"{tmp_path}/p", f"{tmp_path}/index", records=2).collect(), key=lambda r: r.first)
    assert [(r.min_x, r.max_x, r.min_y, r.max_y, r.min_intensity) for r in found] == [(None,) * 5, (1.0, 2.0, 5.0, 5.0, None)]
    assert zones.load(spark, f"{tmp_path}/index").count() == 4
    assert zones.load(spark, f"{tmp_path}/index", zones.in_box((0.0,) * 3, (9.0,) * 3)).count() == 2
    records.write_bytes(f"{tmp_path}/e/a.e57", b"")
    assert zones.headers(spark, f"{tmp_path}/e").collect() == []


def test_files_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "FILE", 70)
    df = spark.range(500).select(F.col("id").alias("point_idx"), *[F.col("id").cast("float").alias(c) for c in "xyz"]).coalesce(1)
    for form in ("las", "ply", "rxp"):
        assert writers.write_points(df, f"{tmp_path}/{form}", form) == 500
        assert len(os.listdir(tmp_path / form)) == 8
        assert sorted(r.x for r in sources.load(spark, f"{tmp_path}/{form}").collect()) == list(range(500))


COLUMNS = ("x", "y", "z", "r", "g", "b", "intensity")


@pytest.mark.parametrize("packed", [False, True])
def test_e57_blocks(spark, tmp_path, monkeypatch, packed):
    """Whatever the blocks, packets are found by tasks, and points are those of a walk along the chain."""
    from pcq.sources import e57, e57_blocks

    r = np.random.default_rng(1)
    monkeypatch.setattr(writers, "PACKET", 90)
    for k, n in enumerate((4000, 0, 1700)):
        records.write_bytes(f"{tmp_path}/{k}.e57", writers.e57_bytes({c: r.integers(0, 200, n).astype(float) for c in COLUMNS}, compressed=packed))
    sources.register(spark)
    own = lambda df: sorted((r.point_idx, r.src, r.x, r.y, r.z, r.r, r.intensity) for r in df.collect())
    want = own(spark.read.format("e57").load(str(tmp_path)))
    assert len(want) == 5700 and own(sources.load(spark, str(tmp_path))) == want
    again = []
    stitched = e57_blocks._stitched
    monkeypatch.setattr(e57_blocks, "_stitched", lambda spark, rows: again.append([r for r in rows if r["records"]]) or stitched(spark, rows))
    for size in (900, 5000, 30_000):
        found = e57_blocks.read_points(spark, str(tmp_path), size)
        assert own(found) == want and found.rdd.getNumPartitions() == len(e57_blocks.blocks(spark, str(tmp_path), size))
    # Guesses are as good as always right, so that nothing is walked twice.
    places = {(f"{tmp_path}/{k}.e57", p[0]) for k in (0, 2) for p in e57.packets(f"{tmp_path}/{k}.e57")}
    assert all((r["path"], r["first"]) in places for rows in again for r in rows)


def test_e57_blocks_with_wrong_guesses(spark, tmp_path, monkeypatch):
    """Records that look like packets lead guesses astray; the stitch walks such blocks anew."""
    from pcq.sources import e57, e57_blocks

    n = 3000
    fake = np.frombuffer(b"\x00" + (16).to_bytes(3, "big") + (1).to_bytes(4, "big"), ">f8")[0]
    columns = {c: np.full(n, fake) for c in ("x", "y", "z", "intensity")} | {c: np.ones(n) for c in "rgb"}
    monkeypatch.setattr(writers, "PACKET", 60)
    records.write_bytes(f"{tmp_path}/a.e57", writers.e57_bytes(columns))
    # Guesses are made in tasks; here they are given, all of them wrong but the first.
    rows, at = [], 64
    end = 64 + sum(p[1] for p in e57.packets(f"{tmp_path}/a.e57"))
    for low in range(64, end, 10_000):
        rows.append({"path": f"{tmp_path}/a.e57", "begin": 64, "end": end, "low": low, "high": min(low + 10_000, end), "first": low + 4, "exit": low + 5000, "records": 1})
    found = e57_blocks._stitched(spark, rows)
    assert found[0][1] == at and [f[3] for f in found] == sorted(f[3] for f in found)
    with open(f"{tmp_path}/a.e57", "rb") as f:
        chain = e57_blocks._chain(f"{tmp_path}/a.e57", _Reads(f))
        assert sum(n for _, first, high, _ in found for *_, n in chain.walk(first, high)) == n


class _Reads:
    def __init__(self, f):
        self.f = f

    def read_at(self, n, at):
        self.f.seek(at)
        return self.f.read(n)


def test_ascii_ply_is_split(spark, tmp_path):
    """Several tasks read one file; rows are numbered through, odd lines dropped, and what is beyond the header's number."""
    head = "ply\nformat ascii 1.0\ncomment 1 2 3 4\nelement vertex {}\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nend_header\n"
    for k, (n, most) in enumerate(((3000, 3000), (500, 200), (100, 400))):
        lines = [f"{i} {i / 2} {-i} {i % 256} 0 9" + (" more" if i % 7 == 0 else "") + ("\n\n1 2 3" if i % 5 == 0 else "") for i in range(n)]
        (tmp_path / f"a {k}.ply").write_text(head.format(most) + "\n".join(lines) + "\n")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = sources.load(spark, str(tmp_path))
        rows = sorted(df.collect())
        assert len({r.parts for r in df.filter("src = 'a 0.ply'").select(F.spark_partition_id().alias("parts")).collect()}) > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept[0])
        spark.conf.set("spark.sql.files.openCostInBytes", kept[1])
    want = [(base + i, float(i), i / 2, float(-i), i % 256, f"a {k}.ply") for k, base, n in ((0, 0, 3000), (1, 3000, 200), (2, 3200, 100)) for i in range(n)]
    assert [(r.point_idx, r.x, r.y, r.z, r.r, r.src) for r in rows] == want


def test_gzip_is_a_stream(tmp_path):
    """Members follow one another; a file that is cut short gives what is there."""
    import gzip

    from pcq.sources.ply import PlyReader

    raw = writers.ply_bytes({c: np.arange(1000.0) % 250 for c in COLUMNS})
    (tmp_path / "a.ply.gz").write_bytes(gzip.compress(raw[:5000]) + gzip.compress(raw[5000:]))
    reader = PlyReader({"path": f"{tmp_path}/a.ply.gz"})
    assert [p.count for p in reader.partitions()] == [1000]
    got = [reader.decode(f"{tmp_path}/a.ply.gz", at, 300)["x"].tolist() for at in range(0, 1000, 300)]
    assert sum(got, []) == (np.arange(1000.0) % 250).tolist()
    (tmp_path / "b.ply.gz").write_bytes(gzip.compress(raw[:-190]))
    assert len(reader.decode(f"{tmp_path}/b.ply.gz", 900, 300)["x"]) == 90


def test_short_ranges_share_tasks(spark, monkeypatch):
    """Tasks follow the records, not the number of ranges."""
    from pyspark.sql import functions as F

    from pcq.sources import zones

    ranges = spark.range(3000).select(F.lit("a.las").alias("path"), F.lit(5).cast("long").alias("count"))
    assert zones._dealt(ranges).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(zones, "TASK", 500)
    assert zones._dealt(ranges).rdd.getNumPartitions() == 30
    assert zones._dealt(ranges.limit(2)).rdd.getNumPartitions() == 2 and zones._dealt(ranges.limit(0)).rdd.getNumPartitions() == 1


def test_points_are_worked_out_once(spark, cloud, tmp_path, monkeypatch):
    """Writing a dataset reads its points once, and deals its parts evenly by the leaves' counts."""
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    monkeypatch.setattr(octree_dataset, "PART_BYTES", 4000)
    octree_dataset.write_dataset(cloud.mapInPandas(watched, cloud.schema), str(tmp_path / "d"), LO, HI, leaf_size=25)
    assert seen.value == 1230
    parts = octree_dataset.files_of(str(tmp_path / "d"))
    assert len(parts) == 6 and all(p["size"] <= 4000 + 30 * 19 for p in parts) and all(a["last"] < b["first"] for a, b in zip(parts, parts[1:], strict=False))
