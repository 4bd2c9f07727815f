"""Dyadic range joins against all pairs."""

import random

from pyspark.sql import functions as F

from runaudit.operators import intervals as I
from runaudit.operators import ranges


def drawn(rng, n):
    out = []
    for i in range(n):
        a = rng.choice([0, 1, 64, 1e3, 1e6]) * rng.random() - 5
        out.append((rng.randrange(3), i, a, a + rng.choice([0, 0.5, 1, 7, 9, 63, 64, 65, 1e3, 1e5, -1]) * rng.choice([1, rng.random()])))
    return out


def test_points_and_windows(spark):
    rng = random.Random(3)
    ivs, wins = drawn(rng, 250), drawn(rng, 120)
    pts = [(rng.randrange(4), i, rng.choice([0, 1, 64, 1e3, 1e6]) * rng.random() - 5) for i in range(400)]
    pts += [(r, 1000 + i, e) for i, (r, _, a, z) in enumerate(ivs[:60]) for e in (a, z)]
    iv = spark.createDataFrame(ivs, "run_id int, iv int, a double, z double")
    win = spark.createDataFrame(wins, "run_id int, win int, w0 double, w1 double")
    pt = spark.createDataFrame(pts, "run_id int, pt int, t double")
    want = sorted((p, i) for r, p, t in pts for q, i, a, z in ivs if q == r and a <= t <= z)
    for few in (False, True):
        for unit in (0.25, 1.0, 10.0):
            got = ranges.points_in(pt, iv, ["run_id"], "t", "a", "z", unit, few_points=few)
            assert sorted((r.pt, r.iv) for r in got.collect()) == want
    both = sorted((i, w) for q, i, a, z in ivs for r, w, b, y in wins if q == r and a <= z and b <= y and a <= y and b <= z)
    assert sorted((r.iv, r.win) for r in ranges.overlapping(iv, win, ["run_id"], "a", "z", "w0", "w1").collect()) == both


def test_an_interval_has_two_cells_at_most(spark):
    lengths = [0.0, 0.4, 1.0, 2.0, 8.0, 8.1, 1e4, 1e9, 4e15]
    rows = [(i, s, s + n) for i, n in enumerate(lengths) for s in (0.0, -3.7, 12345.5)]
    got = ranges.placed(spark.createDataFrame(rows, "iv int, a double, z double"), "a", "z", 1.0)
    per = got.groupBy("iv", "a").agg(F.count(F.lit(1)).alias("n"), F.max("_level").alias("level")).collect()
    assert len(per) == len(rows) and max(r.n for r in per) == 2
    assert all(2.0**r.level >= min(lengths[r.iv], 1e15) / 8 / 8 for r in per)


def test_one_interval_over_a_whole_run(spark):
    """The run's only interval is as long as the run, and every frame meets it once."""
    frames = spark.range(200_000).select(F.lit(1).alias("run_id"), F.col("id").alias("frame_idx"), (F.col("id") * 0.1).alias("t"))
    whole = spark.createDataFrame([(1, "w", 0.0, 19_999.95)], "run_id int, name string, a double, z double")
    got = ranges.points_in(frames, whole, ["run_id"], "t", "a", "z")
    assert got.count() == 200_000
    assert ranges.placed(whole, "a", "z", 1.0).count() <= 2
    binned = I.explode_bins(whole, "a", "z", F.lit(0.1), bin_frames=1)
    assert binned.select(F.count(F.lit(1)), F.countDistinct("bin"), F.min("bin"), F.max("bin")).first()[:] == (200_000, 200_000, 0, 199_999)


def test_empty_sides(spark):
    none = spark.createDataFrame([], "run_id int, a double, z double")
    some = spark.createDataFrame([(1, 0.5), (None, 1.0), (1, None)], "run_id int, t double")
    assert ranges.points_in(some, none, ["run_id"], "t", "a", "z").count() == 0
    odd = spark.createDataFrame([(1, None, 2.0), (1, 3.0, 1.0), (None, 0.0, 9.0)], "run_id int, a double, z double")
    assert ranges.points_in(some, odd, ["run_id"], "t", "a", "z").count() == 0
