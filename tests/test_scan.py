"""Two-level helpers against plain loops, with one run holding most rows and
chunks of a few rows, so every value crosses chunk borders."""

import random

from pyspark.sql import functions as F

from runaudit.operators import intervals as I
from runaudit.operators.scan import Fold, Scan, number_rows, running, spans


def rows(seed, n=400):
    rng = random.Random(seed)
    out, at = [], {}
    for _ in range(n):
        run = 0 if rng.random() < 0.6 else rng.randrange(1, 5)
        at[run] = at.get(run, -1) + rng.choice([1, 1, 1, 2])
        out.append((run, at[run], rng.choice([None, 1, 2, 3]), rng.choice([1.0, 2.0])))
    return out


def by_run(data):
    g = {}
    for r in sorted(data):
        g.setdefault(r[0], []).append(r)
    return g


def test_running_values(spark):
    data = rows(5)
    df = spark.createDataFrame(data, "run_id long, i long, v int, c double").withColumn("chunk", F.floor(F.col("i") / 4))
    got = running(
        df, ["run_id"], "chunk", ["i"],
        [
            Scan("lag", "lag", F.col("v")), Scan("last", "last", F.col("v")),
            Scan("last_in", "last", F.col("v"), inclusive=True), Scan("top", "max", F.col("v")),
            Scan("total", "sum", F.col("v"), inclusive=True),
        ],
    )
    got = {(r["run_id"], r["i"]): (r["lag"], r["last"], r["last_in"], r["top"], r["total"]) for r in got.collect()}
    for run, rs in by_run([r[:2] + (r[2] or 0,) + r[3:] for r in data]).items():
        seen = []
        for _, i, v, _ in rs:
            v = v or None
            prior = [x for x in seen if x is not None]
            now = prior + ([v] if v else [])
            want = (
                seen[-1] if seen else None, prior[-1] if prior else None, now[-1] if now else None,
                max(prior) if prior else None, sum(now),
            )
            assert got[(run, i)] == want
            seen.append(v)


def test_number_rows(spark):
    data = rows(6)
    df = spark.createDataFrame(data, "run_id long, i long, v int, c double")
    got = number_rows(df, ["run_id"], ["i"], F.floor(F.col("i") / 7), "n")
    got = {(r["run_id"], r["i"]): r["n"] for r in got.collect()}
    for run, rs in by_run([r[:2] for r in data]).items():
        assert [got[r] for r in rs] == list(range(len(rs)))


def naive_spans(rs, breaks):
    out = []
    for r in rs:
        if out and not breaks(out[-1][-1], r):
            out[-1].append(r)
        else:
            out.append([r])
    return out


def test_spans_by_value_never_merge_within_a_chunk(spark):
    for seed in range(4):
        data = [(r[0], r[1], r[3]) for r in rows(seed)]
        df = spark.createDataFrame(data, "run_id long, i long, c double").withColumn("chunk", F.floor(F.col("i") / 5))
        got = spans(
            df, ["run_id"], "chunk", ["i"], lambda p, c: p["c"] != c["c"], ["c"],
            [Fold("a", "min", F.col("i")), Fold("z", "max", F.col("i")), Fold("n", "sum", F.lit(1)), Fold("c", "first", F.col("c"))],
        )
        got = sorted(tuple(r) for r in got.select("run_id", "a", "z", "n", "c").collect())
        want = sorted(
            (run, g[0][1], g[-1][1], len(g), g[0][2])
            for run, rs in by_run(data).items() for g in naive_spans(rs, lambda p, c: p[2] != c[2])
        )
        assert got == want


def test_coalesce_against_loop(spark):
    for seed in range(3):
        data = [(r[0], r[1], r[3]) for r in rows(seed + 10)]
        obs = spark.createDataFrame(data, "run_id long, frame_idx long, compare double").select(
            "*", F.lit("SEPARATION").alias("type"), F.lit("human").alias("entity_id"),
            (F.col("frame_idx") * 0.02).alias("t"), F.lit(None).cast("double").alias("overlap_area"),
            F.col("compare").alias("min_distance"),
        )
        got = I.coalesce_intervals(obs, chunk_rows=6)
        got = sorted((r["run_id"], r["frame_first"], r["frame_last"], r["compare"]) for r in got.collect())
        want = sorted(
            (run, g[0][1], g[-1][1], g[0][2])
            for run, rs in by_run(data).items()
            for g in naive_spans(rs, lambda p, c: p[1] + 1 != c[1] or p[2] != c[2])
        )
        assert got == want


def test_merge_looks_at_the_previous_row_only(spark):
    rng = random.Random(9)
    data, t = [], 0.0
    for k in range(300):
        run = 0 if rng.random() < 0.7 else 1
        t += rng.choice([0.02, 0.03, 0.032, 0.1])
        data.append((run, "human", t, t + rng.choice([0.0, 0.01, 0.5]), k))
    df = spark.createDataFrame(data, "run_id long, entity_id string, t_start double, t_end double, frame_first long")
    got = I.merge_adjacent(df, F.lit(0.02), [], chunk_rows=8)
    got = sorted((r["run_id"], r["t_start"], r["t_end"], r["intervals"]) for r in got.collect())
    want = []
    for run, rs in by_run([(d[0], d[2], d[4], d[3]) for d in data]).items():
        for g in naive_spans(rs, lambda p, c: c[1] - p[3] > 0.02 * 1.5):
            want.append((run, g[0][1], g[-1][3], len(g)))
    assert got == sorted(want)


def frames(spark, spec):
    """spec: list of (frame, value) or frame; one run, one entity."""
    rows = [(0, k, float(v)) for k, v in spec]
    return spark.createDataFrame(rows, "run_id long, frame_idx long, compare double").select(
        "*", F.lit("CONTACT").alias("type"), F.lit("human").alias("entity_id"),
        (F.col("frame_idx") * 0.02).alias("t"), F.lit(None).cast("double").alias("overlap_area"),
        F.lit(None).cast("double").alias("min_distance"),
    )


def test_held_gap_and_step(spark):
    for n in (6, 25, 120):
        assert I.coalesce_intervals(frames(spark, [(i, 1) for i in range(n)]), chunk_rows=10).count() == 1
    gap = frames(spark, [(i, 1) for i in (0, 1, 2, 3, 6, 7, 8)])
    runs = spark.createDataFrame([(0, 9)], "run_id long, frame_count long")
    tr = I.transitions(I.presence_spans(gap, chunk_rows=2), runs).collect()
    assert sorted((r["change"], r["frame_idx"]) for r in tr) == [("began", 0), ("began", 6), ("ceased", 3)]
    step = frames(spark, [(i, 1 if i < 4 else 2) for i in range(8)])
    assert I.coalesce_intervals(step, chunk_rows=3).count() == 2
    assert I.presence_spans(step, chunk_rows=3).count() == 1


def test_covering_join_against_pairs(spark):
    rng = random.Random(4)
    pts = [(rng.randrange(2), round(rng.uniform(0, 5), 2)) for _ in range(120)]
    iv = []
    for k in range(60):
        a = round(rng.uniform(0, 5), 2)
        iv.append((rng.randrange(2), a, round(a + rng.choice([0, 0.1, 2.0]), 2), k))
    p = spark.createDataFrame(sorted(set(pts)), "run_id long, t double")
    q = spark.createDataFrame(iv, "run_id long, t_start double, t_end double, k long")
    got = I.covering(p, q, ("run_id",), F.lit(0.02), bin_frames=8)
    got = sorted((r["run_id"], r["t"], r["k"]) for r in got.collect())
    want = sorted((r, t, k) for r, t in set(pts) for s, a, b, k in iv if r == s and a <= t <= b)
    assert got == want


def test_a_crowded_day_is_spread(spark):
    """Nine tenths of a run's rows lie inside one day; the layout cuts by rows, and the as-of pass stays exact."""
    from runaudit.operators import records as R
    from runaudit.operators.scan import ranged

    rng = random.Random(2)
    times = sorted([100 + rng.random() for _ in range(900)] + [rng.uniform(0, 1000) for _ in range(100)])
    decl = [(7, f"d{i}", i, t, 0.001 if i % 3 else 50.0) for i, t in enumerate(times) if i % 4 == 0]
    verd = [(7, f"v{i}", i, t) for i, t in enumerate(times) if i % 4]
    d = spark.createDataFrame(decl, "run_id long, declaration_id string, seq long, t_issued double, horizon double")
    v = spark.createDataFrame(verd, "run_id long, verdict_id string, seq long, t double")
    laid = ranged(v, ["run_id"], ["t"], parts=8).groupBy("chunk").count().collect()
    assert len(laid) == 8 and max(r["count"] for r in laid) < 2 * len(verd) / 8
    got = {(r.verdict_id, r.declaration_id, r.in_force) for r in R.asof_declaration(d, v, parts=8).collect()}
    want = set()
    for _, name, _, t in verd:
        last = max((x for x in decl if x[3] <= t), key=lambda x: (x[3], x[2]), default=None)
        want.add((name, last and last[1], last and t <= last[3] + last[4]))
    assert got == want
    gaps = {r.verdict_id: r.last_heard for r in R.watchdog_gaps(d, v, 5.0, 0.0, parts=8).collect()}
    assert gaps == {name: max([x[3] for x in decl if x[3] <= t], default=0.0) for _, name, _, t in verd}
