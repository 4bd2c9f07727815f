"""Cells of bodies and regions in batches, against single cells tested one by one."""

import math
import random
import time

from pyspark.sql import functions as F

from runaudit.functions import geometry as G

ARM = G.Limits((0.5, 0.4), 0.05, (-3.2, -2.6), (3.2, 2.6), (2.0, 2.5), (8.0, 10.0))
SIZE, HALF, SPAN = 0.08, 1 << 19, 1 << 20


def plain(q0, q1):
    out, x, y, a = set(), 0.0, 0.0, 0.0
    for q, length in zip((q0, q1), ARM.link_lengths):
        a += q
        c, s = math.cos(a), math.sin(a)
        for ix in range(-15, 15):
            for iy in range(-15, 15):
                dx, dy = (ix + 0.5) * SIZE - x, (iy + 0.5) * SIZE - y
                if 0 <= dx * c + dy * s <= length and abs(dy * c - dx * s) <= ARM.link_radius:
                    out.add((ix + HALF) * SPAN + iy + HALF)
        x, y = x + length * c, y + length * s
    return out


def test_cells_overlaps_and_reach(spark):
    rng = random.Random(4)
    rows = [(i, rng.uniform(-3, 3), rng.uniform(-2.5, 2.5)) for i in range(60)] + [(60, None, 0.0)]
    df = spark.createDataFrame(rows, "i int, q0 double, q1 double")
    q = [F.col("q0"), F.col("q1")]
    discs = [(0.3, 0.2, 0.25), (-0.4, 0.1, 0.3)]
    asked = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("cx", "cy", "r"), d)]) for d in discs])
    got = df.withColumn("cells", G.body_cells(q, ARM, SIZE)).select(
        "*", G.disc_overlaps(F.col("cells"), SIZE, asked).alias("n"), G.region_reach(F.col("cells"), SIZE).alias("far")
    ).orderBy("i").collect()
    assert got[60]["cells"] is None and got[60]["n"] is None and got[60]["far"] is None
    for r in got[:60]:
        want = plain(r["q0"], r["q1"])
        assert r["cells"] == sorted(want)
        at = [((c // SPAN - HALF + 0.5) * SIZE, (c % SPAN - HALF + 0.5) * SIZE) for c in want]
        assert r["n"] == [sum(math.hypot(x - cx, y - cy) <= rad for x, y in at) for cx, cy, rad in discs]
        assert abs(r["far"] - max(math.hypot(abs(x) + SIZE / 2, abs(y) + SIZE / 2) for x, y in at)) < 1e-12


def test_regions_of_many_frames_take_little_time(spark):
    n = 60_000
    q, v = [F.col("id") % 628 / 100.0 - 3.14, F.col("id") % 520 / 100.0 - 2.6], [F.lit(0.5), F.lit(-0.5)]
    poses = G.reachable_poses(q, v, ARM, 0.1, 0.05, G.controls(ARM))
    cells = spark.range(0, n, 1, 4).select(G.region_cells(poses, ARM, SIZE).alias("c"))
    start = time.time()
    assert cells.agg(F.count("c"), F.min(F.size("c")) > 0).first() == (n, True)
    assert time.time() - start < 45  # interpreted cell by cell: minutes
