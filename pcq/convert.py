"""Command line: a point file to an octree dataset. python -m pcq.convert scan.las out/ [--leaf-size N] [--max-depth N]"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from . import sources
from .operators import stats
from .operators.octree import DEPTH, LEAF_FILE
from .sources.octree_dataset import write_dataset


def main(argv: list[str] | None = None) -> dict:
    """Bounds come from the points themselves. Memory needs no switch: Spark sorts and spills."""
    a = argparse.ArgumentParser(prog="pcq.convert", description=__doc__)
    a.add_argument("input")
    a.add_argument("output", help="a folder that driver and executors share")
    a.add_argument("--leaf-size", type=int, default=LEAF_FILE)
    a.add_argument("--max-depth", type=int, default=DEPTH)
    o = a.parse_args(argv)
    spark = SparkSession.builder.appName("pcq-convert").getOrCreate()
    points = stats.finite(sources.load(spark, o.input))
    if "point_idx" not in points.columns:
        from pyspark.sql import functions as F

        points = points.withColumn("point_idx", F.monotonically_increasing_id())
    ends = stats.bounds(stats.normalised(points)).first()
    if not ends["n"]:
        raise SystemExit(f"{o.input} holds no points")
    lo, hi = (tuple(float(ends[f"{e}_{c}"]) for c in "xyz") for e in ("min", "max"))
    made = write_dataset(stats.normalised(points), o.output, lo, hi, o.leaf_size, o.max_depth)
    print(json.dumps(made))
    return made


if __name__ == "__main__":
    main()
