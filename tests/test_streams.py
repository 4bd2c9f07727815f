"""Text frame streams: line numbers and headers, by the lines of the files themselves."""

import os
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from oracle_check import compare
from runaudit.sources import frames as FR
from runaudit.streaming import live as L

HEADER = "t,q_0,qd_0,human_x,human_y,human_vx,human_vy"


def row(t):
    return f"{t:.6f},0.1,0.2,1.0,2.0,0.0,0.0"


def test_quarantine_names_the_line(spark, tmp_path):
    files = {
        "a": ["# k=v", "", HEADER, row(0), "nan" + row(1)[8:], row(2), HEADER, "t,what", row(3) + ",9", row(4)],
        "b": [row(0), row(1)],
        "c": ["t,not,a,header", row(0)],
    }
    for name, lines in files.items():
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
    good, bad = FR.read_frames(FR.read_lines(spark, str(tmp_path)), [])
    assert sorted(r.t for r in good.collect()) == [0.0, 2.0, 4.0]
    got = sorted((r.file[-5:-4], r.line, r.reason) for r in bad.collect())
    assert got == [
        ("a", 5, "not a finite number"), ("a", 7, FR.SECOND_HEADER), ("a", 8, FR.SECOND_HEADER), ("a", 9, "wrong number of fields"),
        ("b", 1, "file has no header"), ("b", 2, "file has no header"), ("c", 2, "unknown header"),
    ]
    assert all(r.value == files[r.file[-5:-4]][r.line - 1] for r in bad.collect())


def test_lines_of_a_file_read_in_blocks(spark, tmp_path):
    lines = [HEADER] + [row(i) if i % 97 else f"bad {i} " + "x" * (i % 50) for i in range(4000)]
    (tmp_path / "long.csv").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    try:
        read = FR.read_lines(spark, str(tmp_path))
        assert read.select("block").distinct().count() > 5
        good, bad = FR.read_frames(read, [])
        assert good.count() == 4000 - 42
        found = bad.select("line", "value").collect()
        assert len(found) == 42 and all(lines[r.line - 1] == r.value for r in found)
        every = FR.line_numbers(read, read).agg(F.min("line"), F.max("line"), F.count_distinct("line")).first()
        assert tuple(every) == (1, 4001, 4001)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_watchdog_hears_each_run_from_its_own_start(spark, tmp_path):
    """Run 2 is listened to from 1000 on; in run 1, 500 passes in silence, then an offer expires."""
    rows = [(1, 500.0, 1, 0, None, 50.0), (1, 600.0, 0, 1, 10.0, 50.0), (1, 605.0, 1, 2, None, 50.0), (1, 611.0, 1, 3, None, 50.0),
            (2, 1300.0, 1, 0, None, 1000.0), (2, 1401.0, 1, 1, None, 1000.0)]
    ev = spark.createDataFrame(rows, "run_id long, t double, side int, seq long, horizon double, t_start double")
    src = L.as_stream(ev, str(tmp_path / "in"))
    out = L.run_available(L.stream_watchdog(src, 400.0), str(tmp_path / "out"), str(tmp_path / "check"))
    got = sorted(tuple(r) for r in out.collect())
    assert got == [(1, 500.0, "watchdog_expiry"), (1, 611.0, "stale_declaration"), (2, 1401.0, "watchdog_expiry")]


def test_watchdog_query_equals_its_statement(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("test tables are not here")
    ok, _, _, note = compare(spark, sf, entry.queries()["stream_watchdog"], entry.oracle_sql()["stream_watchdog"])
    assert ok, note


def test_intervals_of_many_keys_share_a_call(spark, tmp_path):
    """Two batches: an interval goes on in the second, another key is silent until the watermark passes it."""
    shape = "run_id long, type string, entity_id string, frame_idx long, t double, compare double, at timestamp"
    at = F.timestamp_micros((F.col("second") * 1e6).cast("long"))

    def batch(rows):
        return spark.createDataFrame(rows, shape.replace("at timestamp", "second double")).withColumn("at", at).drop("second")

    first = [(r, "S", e, i, i / 10, float(i // 3), 1000 + i / 10) for r in range(30) for e in "ab" for i in range(5)]
    later = [(r, "S", "a", i, i / 10, float(i // 3), 1000 + i / 10) for r in range(30) for i in (5, 6, 9)]
    last = [(99, "S", "z", 0, 0.0, 1.0, 2000.0)]
    path = str(tmp_path / "in")
    os.mkdir(path)
    seen = L.stream_intervals(spark.readStream.schema(batch(last).schema).option("maxFilesPerTrigger", 1).parquet(path), groups=4)
    for rows in (first, later, last):
        batch(rows).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are taken in order of their age
    out = L.run_available(seen, str(tmp_path / "out"), str(tmp_path / "check"))
    got = {tuple(r)[:7] for r in out.collect()}
    want = set()
    for r in range(30):
        for e, spans in (("a", [(0, 2), (3, 5), (6, 6), (9, 9)]), ("b", [(0, 2), (3, 4)])):
            want |= {(r, "S", e, a, z, a / 10, z / 10) for a, z in spans}
    assert got - {(99, "S", "z", 0, 0, 0.0, 0.0)} == want
    assert out.count() == len(got)


def test_streams_share_bundles(spark, tmp_path):
    """Short streams are written to a few files together and read back as single ones, also where a bundle is cut into blocks."""
    n = 400
    key = spark.range(n).select(F.col("id").alias("run_id"))
    odd = F.when((F.col("run_id") % 9 == 4) & (F.col("frame_idx") == 3), F.lit("a\tb")).otherwise(F.concat(F.col("frame_idx").cast("string"), F.lit(".000000,0.1,0.2,1.0,2.0,0.0,0.0")))
    lines = key.select("run_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("frame_idx"))
    lines = lines.select("run_id", (F.col("frame_idx") / 4).cast("long").alias("chunk"), "frame_idx", odd.alias("line"))
    head = key.select("run_id", F.lit(HEADER).alias("line"))
    note = key.select("run_id", F.concat(F.lit("# run="), F.col("run_id").cast("string")).alias("line"))
    path = str(tmp_path / "bundles")
    FR.write_bundles(lines, head, note, path)
    assert len([f for f in os.listdir(path) if f.endswith(".txt")]) < 40
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    try:
        read = FR.read_bundles(spark, path)
        assert read.select("file").distinct().count() == 2 * n
        good, bad = FR.read_frames(read, ["run_id"])
        odd_runs = [i for i in range(n) if i % 9 == 4]
        assert sorted((r.run_id, r.t) for r in good.collect()) == [(i, float(k)) for i in range(n) for k in range(7) if not (k == 3 and i % 9 == 4)]
        assert sorted((r.run_id, r.line, r.value) for r in bad.collect()) == [(i, 6, "a\tb") for i in odd_runs]
        assert sorted(tuple(r) for r in FR.provenance(read, ["run_id"]).collect()) == [(i, "run", str(i)) for i in range(n)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_watchdog_of_many_runs_shares_a_call(spark, tmp_path):
    """F8: 40 runs in 4 groups over two batches: alarms are those of each run alone, one event after the other."""
    import random

    rng = random.Random(5)
    shape = "run_id long, t double, side int, seq long, horizon double, t_start double"
    rows = []
    for r in [*range(40), None]:
        t = 0.0
        for i in range(12):
            t += rng.choice((0.0, 3.0, 30.0))
            side = rng.choice((0, 1, 1))
            rows.append((r, t, side, i, rng.choice((5.0, 40.0)) if side == 0 else None, -20.0 if r == 7 else 0.0))
    first, later = [x for x in rows if x[3] < 6 and x[0] != 3], [x for x in rows if x[3] >= 6 or x[0] == 3]
    path = str(tmp_path / "in")
    os.mkdir(path)
    seen = L.stream_watchdog(spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(path), 25.0, groups=4)
    for part in (first, later):
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are taken in order of their age
    got = L.run_available(seen, str(tmp_path / "out"), str(tmp_path / "check")).collect()
    want = []
    for r in {x[0] for x in rows}:
        heard = expires = None
        for part in (first, later):
            for _, t, side, _, horizon, began in sorted((x for x in part if x[0] == r), key=lambda x: x[1:4]):
                heard = began if heard is None else heard
                if side == 0:
                    heard, expires = max(heard, t), t + horizon
                elif t - heard > 25.0:
                    want.append((r, t, "watchdog_expiry"))
                elif expires is not None and t > expires:
                    want.append((r, t, "stale_declaration"))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and len({w[2] for w in want}) == 2
