import hashlib
import hmac
import random

from pyspark.sql import functions as F

from runaudit.functions import canonical as K
from runaudit.functions import geometry as G
from runaudit.functions import scalars as S


def col(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def test_fixed_text_of_any_finite_double(spark):
    rng = random.Random(4)
    vals = [2.0**63, -(2.0**63), 2.0**64 + 2.0**12, 1e22, 1e23, -1e300, 1.7976931348623157e308, 2.0**1023, 9007199254740993.0 * 2**40]
    vals += [rng.choice([-1, 1]) * rng.uniform(1, 2) * 2.0 ** rng.randint(50, 1022) for _ in range(200)]
    for decimals in (3, 6, 9):
        more = vals + [rng.uniform(-1, 1) * 2.0 ** rng.randint(0, 60) for _ in range(200)]
        got = [r[0] for r in col(spark, more).orderBy("i").select(S.fixed_text(F.col("v"), decimals)).collect()]
        assert got == [f"{v + 0.0:.{decimals}f}" if float(f"{v:.{decimals}f}") else f"{0:.{decimals}f}" for v in more]
    odd = [float("nan"), float("inf"), float("-inf")]
    assert [r[0] for r in col(spark, odd).select(S.fixed_text(F.col("v"))).collect()] == [None] * 3


def test_fixed_text_matches_exact_rounding(spark):
    rng = random.Random(1)
    vals = [k * 5e-7 for k in range(-2000, 2000)] + [rng.uniform(-1e5, 1e5) for _ in range(500)]
    vals += [0.0, -0.0, -1e-9, 1e-9, 0.5, 2.5, 1.0000005, 4e9, 4.6e9, 5e9 + 2**-20, -7e9 - 0.4999995, 2.0**53 + 2, 9.9e17, 6e9 + 1 - 2**-20]
    got = [r[0] for r in col(spark, vals).orderBy("i").select(S.fixed_text(F.col("v"))).collect()]
    # Python formats the stored value exactly; -0.000000 is written 0.000000
    want = [f"{v:.6f}" for v in vals]
    want = ["0.000000" if w == "-0.000000" else w for w in want]
    assert got == want


def test_buckets_are_half_even_and_refuse(spark):
    vals = [0.005 * k for k in range(200)] + [-1.0, float("nan"), float("inf")]
    got = [r[0] for r in col(spark, vals).orderBy("i").select(S.distance_bucket(F.col("v"))).collect()]
    assert got[:200] == [round(v / 0.01) for v in vals[:200]]
    assert got[200:] == [None, None, None]


def test_area_keeps_two_figures(spark):
    vals = [0.0, 0.834, 0.0125, 12345.0, 0.095]
    got = [r[0] for r in col(spark, vals).orderBy("i").select(S.quantize_area(F.col("v"))).collect()]
    assert got[0] == 0.0 and [f"{g:.3g}" for g in got[1:]] == ["0.83", "0.012", "1.2e+04", "0.095"]


def test_instants_need_an_offset(spark):
    texts = ["2026-08-21T09:00:00Z", "2026-08-21T09:00:00+02:00", "2026-08-21T09:00:00", "soon"]
    d = col(spark, texts, "string").orderBy("i")
    got = [r[0] for r in d.select(S.format_instant(S.parse_instant(F.col("v")))).collect()]
    assert got == ["2026-08-21T09:00:00.000000Z", "2026-08-21T07:00:00.000000Z", None, None]


def test_hmac_is_hmac(spark):
    for key in (b"k", b"x" * 64, b"long" * 40):
        d = col(spark, ["", "message", "ü"], "string").orderBy("i")
        got = [r[0] for r in d.select(K.hmac_sha256(key, K.utf8(F.col("v")))).collect()]
        assert got == [hmac.new(key, m.encode(), hashlib.sha256).hexdigest() for m in ("", "message", "ü")]


def test_body_distance_against_dense_sampling(spark):
    import math

    arm = G.Limits((0.5, 0.4), 0.05, (-3.2, -2.6), (3.2, 2.6), (2.0, 2.5), (8.0, 10.0))
    rng = random.Random(2)
    rows = [(rng.uniform(-3, 3), rng.uniform(-2.5, 2.5), rng.uniform(-1.5, 1.5), rng.uniform(-1.5, 1.5)) for _ in range(40)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, q0 double, q1 double, x double, y double")
    d = G.body_disc_distance([F.col("q0"), F.col("q1")], arm, F.col("x"), F.col("y"), F.lit(0.25))
    got = [r[0] for r in df.orderBy("i").select(d).collect()]
    for (q0, q1, x, y), g in zip(rows, got):
        best, bx, by, a = 9.0, 0.0, 0.0, 0.0
        for q, length in ((q0, 0.5), (q1, 0.4)):
            a += q
            for i in range(101):
                for j in (-1, -0.5, 0, 0.5, 1):
                    u, v = length * i / 100, 0.05 * j
                    px, py = bx + u * math.cos(a) - v * math.sin(a), by + u * math.sin(a) + v * math.cos(a)
                    best = min(best, math.hypot(px - x, py - y))
            bx, by = bx + length * math.cos(a), by + length * math.sin(a)
        assert abs(g - max(best - 0.25, 0)) < 0.03


def test_outer_radius_contains_every_sampled_pose(spark):
    arm = G.Limits((0.5, 0.4), 0.05, (-3.1, -2.6), (3.1, 2.6), (2.0, 2.5), (8.0, 10.0))
    rng = random.Random(3)
    rows = [(i, rng.uniform(-3, 3), rng.uniform(-2.5, 2.5), rng.uniform(-2, 2), rng.uniform(-2.5, 2.5)) for i in range(30)]
    df = spark.createDataFrame(rows, "i int, q0 double, q1 double, v0 double, v1 double")
    q, v = [F.col("q0"), F.col("q1")], [F.col("v0"), F.col("v1")]
    poses = G.reachable_poses(q, v, arm, 0.2, 0.02, G.controls(arm, 8))
    tips = F.array_max(F.transform(poses, lambda p: G.tip_reach([p[0], p[1]], arm)))
    out = df.select(tips.alias("tip"), G.outer_radius(q, v, arm, F.lit(0.2), 0.02).alias("r")).collect()
    assert all(r["tip"] <= r["r"] + 1e-9 <= arm.bound + 1e-6 for r in out)
    assert any(r["r"] < arm.bound - 0.01 for r in out)


def test_tip_reach_is_a_root_of_squares(spark):
    """Poses of equal elbow differ in the last bit alone, and the action class hangs on it."""
    import math

    arm = G.Limits((0.5, 0.4), 0.05, (-3.1, -2.6), (3.1, 2.6), (2.0, 2.5), (8.0, 10.0))
    rows = [(i, (i % 628) / 100.0 - 3.14, (i * 7 % 520) / 100.0 - 2.6) for i in range(2000)]
    df = spark.createDataFrame(rows, "i int, q0 double, q1 double")
    got = df.select("q0", "q1", G.tip_reach([F.col("q0"), F.col("q1")], arm).alias("r")).collect()

    def by_hand(a, b):
        x, y = 0.5 * math.cos(a) + 0.4 * math.cos(a + b), 0.5 * math.sin(a) + 0.4 * math.sin(a + b)
        return math.sqrt(x * x + y * y)

    # sines of the two libraries may differ in a last bit now and then
    assert sum(r.r != by_hand(r.q0, r.q1) for r in got) < len(got) // 50


def test_tip_reach_of_rows_is_that_of_the_statement(spark):
    """segments whose ends are equally far are classed by the last bit of the reach. Poses repeat after 81,640
    events, so these are all there are."""
    import duckdb

    arm = G.Limits((0.5, 0.4), 0.05, (-3.1, -2.6), (3.1, 2.6), (2.0, 2.5), (8.0, 10.0))
    q = [(F.col("id") % 628) / 100.0 - 3.14, (F.col("id") % 520) / 100.0 - 2.6]
    got = spark.range(81640).select("id", G.tip_reach_of_rows(q, arm).alias("r")).collect()
    want = duckdb.connect().execute("""
      SELECT id, sqrt(pow(0.5 * cos(q0) + 0.4 * cos(q0 + q1), 2) + pow(0.5 * sin(q0) + 0.4 * sin(q0 + q1), 2)) FROM (
        SELECT id, (id % 628) / 100.0::DOUBLE - 3.14::DOUBLE AS q0, (id % 520) / 100.0::DOUBLE - 2.6::DOUBLE AS q1 FROM (SELECT unnest(range(81640)) AS id))""").fetchall()
    assert {r.id: r.r for r in got} == dict(want)
    odd = spark.createDataFrame([(None, 0.1), (float("nan"), 0.1), (0.0, 0.0)], "a double, b double")
    assert [r.r for r in odd.select(G.tip_reach_of_rows([F.col("a"), F.col("b")], arm).alias("r")).collect()] == [None, None, 0.9]
