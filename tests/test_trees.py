"""Trees that grow by batches, and node tables that are edited, against a build of all points."""

import os
import random
import shutil

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pcq import catalog
from pcq.operators import edits, growing, octree

SF = "/root/testdata/sf0.001"
LO, HI = (0.0,) * 3, (1.0,) * 3


@pytest.mark.parametrize("name", ["octree_streaming_fill", "octree_growing", "octree_growing_nodes", "octree_delete", "octree_insert"])
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(str(tuple(r)) for r in got.select(*columns).collect())
    assert rows == sorted(str(r) for r in want.project(", ".join(columns)).fetchall()) and rows


def cloud(spark, n, seed=1, depth=6):
    """Points spread and crowded, some in one place."""
    r = np.random.default_rng(seed)
    xyz = np.concatenate([r.random((n, 3)), r.random((n // 2, 3)) * 0.05, np.full((n // 10, 3), 0.3)])
    r.shuffle(xyz)
    df = spark.createDataFrame([(k, *map(float, p), f"n{k}") for k, p in enumerate(xyz)], "point_idx long, x double, y double, z double, note string").repartition(3)
    return octree.with_path(df, LO, HI, depth)


@pytest.mark.parametrize("most", [500_000, 40, 0])
def test_points_find_their_leaf(spark, monkeypatch, most):
    """By sorted first keys, or merged with leaves in ranges of keys; points outside all leaves are left out."""
    p = cloud(spark, 600).cache()
    nodes = octree.nodes(p, 20, 6).filter("not startswith(name, 'r3')").cache()
    leaves = [r.name for r in nodes.filter("is_leaf").collect()]
    monkeypatch.setattr(octree, "BROADCAST_NODES", most)
    found = octree.leaf_of(p, nodes, 6).collect()
    want = {r.point_idx: (leaf, r.note) for r in p.collect() for leaf in leaves if r.path.startswith(leaf)}
    assert {r.point_idx: (r.leaf, r.note) for r in found} == want and len(found) == len(want) < 960
    assert octree.leaf_of(p, nodes.filter("false"), 6).collect() == []


def filled(rows, cap, depth):
    """Points one by one, as (point_idx, path) in the order of arrival."""
    held, out = {}, {}
    for k, path in rows:
        for d in range(depth + 1):
            node = path[: d + 1]
            if d == depth or held.get(node, 0) < cap:
                held[node], out[k] = held.get(node, 0) + 1, node
                break
    return out, held


@pytest.mark.parametrize("bounds", [[0, 800], [0, 5, 6, 6, 300, 800]])
def test_batches_grow_the_tree_of_one(spark, tmp_path, bounds):
    p = cloud(spark, 500).drop("key").cache()
    rows = sorted((r.point_idx, r.path) for r in p.select("point_idx", "path").collect())
    root = f"{tmp_path}/tree"
    for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        assert growing.grow(p.filter(F.col("point_idx").between(a, b - 1)), root, k, 12, 6)
    want, held = filled(rows, 12, 6)
    found = growing.placed(spark, root).collect()
    assert {r.point_idx: r.node for r in found} == want and len(found) == len(rows) and all(r.note == f"n{r.point_idx}" for r in found)
    nodes = {r.node: (r.n, r.child_mask) for r in growing.nodes(spark, root).collect()}
    assert nodes == {n: (c, sum(1 << int(m[-1]) for m in held if m[:-1] == n)) for n, c in held.items()}


def test_a_batch_counts_once(spark, tmp_path):
    """A batch handed over again changes nothing; one that stopped before its version was written is placed again."""
    p = cloud(spark, 200).drop("key").cache()
    root = f"{tmp_path}/tree"
    with pytest.raises(ValueError, match="before batch 0"):
        growing.grow(p, root, 1, 9, 6)
    with pytest.raises(ValueError, match="no batch"):
        growing.placed(spark, root)
    first, second = p.filter("point_idx < 150"), p.filter("point_idx >= 150")
    assert growing.grow(first, root, 0, 9, 6) and not growing.grow(first, root, 0, 9, 6)
    before = sorted(growing.placed(spark, root).collect())
    assert growing.grow(second, root, 1, 9, 6)
    after, nodes = sorted(growing.placed(spark, root).collect()), sorted(growing.nodes(spark, root).collect())
    os.remove(f"{root}/nodes/version=1/_SUCCESS")
    assert sorted(growing.placed(spark, root).collect()) == before
    assert growing.grow(second, root, 1, 9, 6)
    assert sorted(growing.placed(spark, root).collect()) == after and sorted(growing.nodes(spark, root).collect()) == nodes
    assert growing.grow(second.limit(0), root, 2, 9, 6) and sorted(growing.nodes(spark, root).collect()) == nodes


def test_a_stream_grows_the_tree(spark, tmp_path):
    p = cloud(spark, 300).cache()
    rows = sorted((r.point_idx, r.path) for r in p.select("point_idx", "path").collect())
    schema = "point_idx long, x double, y double, z double"
    for k in range(3):
        p.filter(F.floor(F.col("point_idx") / 180) == k).select("point_idx", "x", "y", "z").write.mode("append").parquet(f"{tmp_path}/in")
        stream = growing.grow_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/tree", LO, HI, 15, 6)
        q = stream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
    want, _ = filled(rows, 15, 6)
    assert {r.point_idx: r.node for r in growing.placed(spark, f"{tmp_path}/tree").collect()} == want
    # The last micro-batch once more, as after a failure between its end and Spark's own note of it.
    shutil.rmtree(f"{tmp_path}/state/commits")
    os.makedirs(f"{tmp_path}/state/commits")
    stream = growing.grow_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/tree", LO, HI, 15, 6)
    stream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert {r.point_idx: r.node for r in growing.placed(spark, f"{tmp_path}/tree").collect()} == want


def table(nodes):
    return sorted(tuple(r) for r in nodes.select(*edits.COLUMNS).collect())


def test_deletes_equal_rebuilds(spark):
    p = cloud(spark, 400).cache()
    nodes = octree.nodes(p, 20, 6)
    r = random.Random(5)
    keys = sorted(x.key for x in p.select("key").collect())
    top = 8**6 - 1
    ranges = [(0, top), (5, 4), (keys[3], keys[3]), (0, keys[-2]), (0o300000, 0o377777), tuple(sorted(r.choices(range(top), k=2))), tuple(sorted(r.choices(keys, k=2)))]
    for first, last in ranges:
        rest = p.filter(~F.col("key").between(first, last))
        assert table(edits.delete(nodes, p, first, last, 20, 6)) == table(octree.nodes(rest, 20, 6)), (first, last)


def test_inserts_equal_rebuilds(spark, monkeypatch):
    p = cloud(spark, 400).cache()
    want = table(octree.nodes(p, 20, 6))
    for late in ("key < 5000", "point_idx % 2 = 0", "true", "x = 0.3", "point_idx > 10"):
        old, new = p.filter(f"not ({late})"), p.filter(late)
        assert table(edits.insert(octree.nodes(old, 20, 6), old, new, 20, 6)) == want, late
    monkeypatch.setattr(octree, "BROADCAST_NODES", 0)
    old, new = p.filter("point_idx % 3 > 0"), p.filter("point_idx % 3 = 0")
    assert table(edits.insert(octree.nodes(old, 20, 6), old, new, 20, 6)) == want


def test_an_edit_reads_the_leaves_at_its_ends(spark):
    """Of the points, a deletion of whole nodes reads none, and one that cuts leaves only theirs."""
    p = cloud(spark, 400).cache()
    nodes = octree.nodes(p, 20, 6).cache()

    class Watched:
        def __init__(self):
            self.conditions = []

        def filter(self, condition):
            self.conditions.append(p.filter(condition))
            return self.conditions[-1]

    whole = Watched()
    edits.delete(nodes, whole, 0o300000, 0o377777, 20, 6).collect()
    assert whole.conditions == []
    leaf = next(r for r in nodes.filter("is_leaf and num_points > 5 and depth < 6").collect())
    first = (leaf.key << 3 * (6 - leaf.depth)) + 1
    some = Watched()
    edits.delete(nodes, some, first, 8**6 - 1, 20, 6).collect()
    assert sum(c.count() for c in some.conditions) <= leaf.num_points
