"""Compressed LAS: chunks that decode to their LAS twin, apart from each other, and files that can't be read."""

import os
import struct

import numpy as np
import pytest

from pcq import sources
from pcq.sources import las, laz, records, writers, zones

HEAD = 227


def las_file(fmt: int, body: np.ndarray) -> bytes:
    head = bytearray(HEAD)
    head[:4] = b"LASF"
    head[24:26] = bytes([1, 2])
    struct.pack_into("<HI", head, 94, HEAD, HEAD)
    struct.pack_into("<BHI", head, 104, fmt, body.shape[1], len(body))
    struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.01, 0, 0, 0)
    return bytes(head) + body.tobytes()


def columns(n: int, **own) -> dict:
    zero = {c: np.zeros(n) for c in ("x", "y", "z", "r", "g", "b", "intensity", "gps_time", "classification", "source_id", "return_number", "num_returns")}
    return zero | {c: np.asarray(v, float) for c, v in own.items()}


def scan(n: int, seed: int = 3) -> dict:
    """A scan line by line: returns, grey and coloured points, a time that jumps."""
    rng, t = np.random.default_rng(seed), np.arange(n)
    own = {"x": t % 500 * 0.25, "y": t // 500 + rng.normal(0, 0.1, n), "z": np.sin(t / 70) * 20 + rng.normal(0, 0.02, n), "intensity": rng.integers(0, 900, n), "classification": rng.choice([2, 2, 2, 6], n)}
    own |= {"return_number": 1 + t % 3, "num_returns": np.full(n, 3), "source_id": t // 200, "gps_time": 1e5 + t // 3 * 1e-4 + (t > n / 2) * 1e9, "r": t // 9 % 256, "g": np.where(t % 2, t // 9 % 256, 7), "b": t // 9 % 256}
    return columns(n, **own)


def back(path, data: bytes) -> bytes:
    path.write_bytes(data)
    h = las.header(str(path))
    return laz.read(str(path), h, 0, h["count"])


@pytest.mark.parametrize("fmt", range(6))
@pytest.mark.parametrize("more", [0, 3])
def test_random_records_of_every_format(tmp_path, fmt, more):
    """Every byte at random: all coordinates, flags, times and colours that a record can hold, extreme ones among them."""
    rng = np.random.default_rng(fmt)
    for n, chunk in ((0, 10), (1, 10), (11, 10), (600, 250), (600, [1, 399, 200])):
        body = rng.integers(0, 256, (n, las.SIZES[fmt] + more), dtype=np.uint8)
        body[rng.random(n) < 0.2] = 0
        body[rng.random(n) < 0.2, :12] = 255
        plain = las_file(fmt, body)
        assert back(tmp_path / f"{n}-{isinstance(chunk, list)}.laz", laz.compress(plain, chunk)) == plain[HEAD:]


def test_times_in_sequences(tmp_path):
    """Steps that repeat, double, turn and jump, and four sequences that take turns: every way to code a time, as integers."""
    rng = np.random.default_rng(5)
    steps = rng.choice([0, 1000, 1000, 1000, 2003, 15_000, 700_000, -1000, -4000, -90_000, 3], 4000)
    times = (np.cumsum(steps) + np.int64(4 << 60) + rng.choice([0, 1 << 40, 1 << 44, 1 << 50, 1 << 52], 4000, p=[0.6, 0.1, 0.1, 0.1, 0.1])).astype("<i8")
    body = np.zeros((4000, 28), np.uint8)
    body[:, 20:] = times.view(np.uint8).reshape(-1, 8)
    seen = set()
    choice = laz.TimeItem._choice
    laz.TimeItem._choice = lambda self, v: seen.add(choice(self, v)) or choice(self, v)
    try:
        plain = las_file(1, body)
        packed = laz.compress(plain, 4000)
    finally:
        laz.TimeItem._choice = choice
    assert back(tmp_path / "a.laz", packed) == plain[HEAD:]
    assert {0, 1, 2, 15, laz.MULTI, laz.MULTI + 4, laz.MULTI + 10, laz.SAME, laz.FULL, laz.FULL + 1, laz.FULL + 2, laz.FULL + 3} <= seen


def test_carries_run_through_the_output():
    """A coder whose base overflows after many bytes of 255."""
    c, model = laz.Encoder(), laz.Model(2)
    rng = np.random.default_rng(1)
    bits = [1] * 3000 + rng.integers(0, 2, 3000).tolist() + [0] * 3000
    for b in bits:
        c.symbol(model, b)
        c.even(7, 127)
    d, model = laz.Decoder(c.done()), laz.Model(2)
    assert [(d.symbol(model), d.even(7))[0] for _ in bits] == bits


def test_model_frequencies():
    """A symbol's share follows its count; counts halve before they sum to more than 2^15."""
    m = laz.Model(4)
    assert m.low == [0, 8192, 16384, 24576] and m.left == 5
    for _ in range(100_000):
        m.saw(2)
    assert sum(m.counts) <= 2 * (1 << 15) and m.low[3] - m.low[2] > 32_000


def test_equals_its_las_twin(spark, tmp_path):
    plain = writers.las_bytes(scan(3000))
    packed = laz.compress(plain, 700)
    assert len(packed) < len(plain) / 3
    for name, data in (("a.las", plain), ("a.laz", packed)):
        (tmp_path / name).write_bytes(data)
    rows = lambda name: sources.load(spark, str(tmp_path / name)).drop("src").orderBy("point_idx").collect()
    assert rows("a.laz") == rows("a.las") and len(rows("a.laz")) == 3000
    # A folder may hold both.
    assert sources.load(spark, str(tmp_path)).count() == 6000


def test_tasks_read_their_chunks_only(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "a.laz")
    (tmp_path / "a.laz").write_bytes(laz.compress(writers.las_bytes(scan(3000)), 200))
    sources.register(spark)
    df = spark.read.format("las").option("part_records", 500).load(path)
    # Ranges are whole chunks: three chunks of 200 points for 500.
    assert df.rdd.getNumPartitions() == 5
    assert df.filter("point_idx between 1300 and 1900").rdd.getNumPartitions() == 2
    h = las.header(path)
    laz.table(path, h["offset"], 200, 3000), laz.described(path, h["start"], h["records"], h["offset"])
    got = []
    plain = laz.read_bytes
    monkeypatch.setattr(laz, "read_bytes", lambda p, at, n: got.append(n) or plain(p, at, n))
    part = laz.read(path, h, 1200, 600)
    assert part == laz.read(path, h, 1100, 800)[100 * h["length"] : 700 * h["length"]]
    assert sum(got[:3]) < os.path.getsize(path) / 3
    # A read that goes on opens nothing again.
    got.clear()
    assert laz.read(path, h, 2000, 50) + laz.read(path, h, 2050, 50) == laz.read(path, h, 2000, 100) and len(got) == 2


def test_zones_of_compressed_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.laz").write_bytes(laz.compress(writers.las_bytes(scan(900, k)), 250))
    zones.build(spark, str(tmp_path / "in"), str(tmp_path / "index"), records=250)
    read = lambda df: {(r.src, r.point_idx, r.x, r.y, r.z) for r in df.filter("y < 0.5").collect()}
    assert read(zones.load(spark, str(tmp_path / "index"), zones.in_box((-1, -9, -99), (999, 0.5, 99)))) == read(sources.load(spark, str(tmp_path / "in")))


def test_one_chunk_for_all(spark, tmp_path):
    """A file without chunks is one chunk, behind no table: one task reads it, in batches that go on."""
    packed = bytearray(laz.compress(writers.las_bytes(scan(400)), 400))
    start = struct.unpack_from("<I", packed, 96)[0]
    struct.pack_into("<H", packed, HEAD + 54, 1)
    table = struct.unpack_from("<q", packed, start)[0]
    data = bytes(packed[:start] + packed[start + 8 : table])
    (tmp_path / "a.laz").write_bytes(data)
    df = spark.read.format("las").option("part_records", 10).load(str(tmp_path / "a.laz"))
    assert df.rdd.getNumPartitions() == 1 and df.count() == 400
    h = las.header(str(tmp_path / "a.laz"))
    whole = laz.read(str(tmp_path / "a.laz"), h, 0, 400)
    assert whole == writers.las_bytes(scan(400))[HEAD:]
    assert b"".join(laz.read(str(tmp_path / "a.laz"), h, at, 100) for at in range(0, 400, 100)) == whole


def test_table_told_at_the_end(tmp_path):
    plain = writers.las_bytes(scan(500))
    packed = bytearray(laz.compress(plain, 200))
    start = struct.unpack_from("<I", packed, 96)[0]
    at = packed[start : start + 8]
    packed[start : start + 8] = struct.pack("<q", -1)
    assert back(tmp_path / "a.laz", bytes(packed + at)) == plain[HEAD:]


def test_what_cannot_be_read(tmp_path):
    plain = writers.las_bytes(scan(500))
    packed = laz.compress(plain, 200)
    with pytest.raises(ValueError, match="cut"):
        back(tmp_path / "cut.laz", packed[: len(packed) // 2])
    with pytest.raises(ValueError, match="no record says how"):
        back(tmp_path / "plain.laz", plain)
    layered = bytearray(packed)
    struct.pack_into("<H", layered, HEAD + 54, 3)
    with pytest.raises(ValueError, match="in a way that is not read"):
        back(tmp_path / "layered.laz", bytes(layered))
    with pytest.raises(ValueError, match="formats 0 to 5"):
        laz.compress(las_file(7, np.zeros((3, 36), np.uint8)))


def test_writer(spark, tmp_path):
    points = spark.range(300).selectExpr("id AS point_idx", "float(id) AS x", "float(id % 7) AS y", "float(0) AS z", "float(id) AS intensity")
    assert writers.write_points(points.repartition(3), str(tmp_path / "out"), "laz") == 300
    assert len(records.files(str(tmp_path / "out"), (".laz",))) == 3
    assert sorted(r.x for r in sources.load(spark, str(tmp_path / "out")).collect()) == [float(k) for k in range(300)]
