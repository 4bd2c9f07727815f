"""Checks a stream must pass before evidence is built from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runaudit import vocab as V
from runaudit.functions import scalars as S
from runaudit.operators.intervals import with_chunk
from runaudit.operators.scan import Scan, running


def time_base(frames: DataFrame) -> DataFrame:
    """Exact distinct instants against frames. Instants are first grouped
    on (run, bucket), so a hot run is spread over its instants."""
    per = (
        frames.select("run_id", S.time_bucket(F.col("t")).alias("b"))
        .groupBy("run_id", "b")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return per.groupBy("run_id").agg(
        F.sum("n").alias("frames"), F.count(F.lit(1)).alias("instants")
    ).withColumn("resolves_frames", F.col("frames") == F.col("instants"))


def frame_period_check(frames: DataFrame, chunk_rows: int = V.CHUNK_ROWS) -> DataFrame:
    """A10: at least two frames, time advances, no gap off by over 10 ms."""
    g = running(
        with_chunk(frames.select("run_id", "frame_idx", "t"), chunk_rows),
        ["run_id"], "chunk", ["frame_idx"], [Scan("_prev", "lag", F.col("t"))],
    ).withColumn("gap", F.col("t") - F.col("_prev"))
    first = g.groupBy("run_id").agg(
        F.min_by("gap", F.when(F.col("gap").isNotNull(), F.col("frame_idx"))).alias("period"),
        F.count(F.lit(1)).alias("frames"),
        F.min("gap").alias("_lo"),
        F.max("gap").alias("_hi"),
    )
    worst = F.greatest(F.col("_hi") - F.col("period"), F.col("period") - F.col("_lo"))
    verdict = (
        F.when(F.col("frames") < 2, F.lit("too few frames"))
        .when(F.col("period") <= 0, F.lit("time does not advance"))
        .when(worst > V.TIME_TOL_S, F.lit("period is not uniform"))
        .otherwise(F.lit("uniform"))
    )
    return first.select(
        "run_id", "frames", verdict.alias("finding"),
        F.rint(F.col("period") * 1e6).cast("long").alias("period_us"),
        F.rint(worst * 1e6).cast("long").alias("worst_us"),
    )


def entity_set_check(per_frame: DataFrame, runs: DataFrame, reserved: str = "human") -> DataFrame:
    """Ids unique, attributes constant over the run, reserved id free."""
    e = per_frame.groupBy("run_id", "entity_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(F.struct("kind", "cx", "cy", "r")).alias("_lo"),
        F.max(F.struct("kind", "cx", "cy", "r")).alias("_hi"),
    )
    return (
        e.join(runs.select("run_id", "frame_count"), "run_id")
        .select(
            "run_id", "entity_id",
            F.when(F.col("entity_id") == reserved, F.lit("reserved id is taken"))
            .when(F.col("rows") > F.col("frame_count"), F.lit("duplicate id"))
            .when(F.col("rows") < F.col("frame_count"), F.lit("set changed"))
            .when(F.col("_lo") != F.col("_hi"), F.lit("attributes changed"))
            .otherwise(F.lit("static"))
            .alias("finding"),
        )
    )


def set_equality(asks: DataFrame, told: DataFrame, true: DataFrame, cols: list[str]) -> DataFrame:
    """Equal sets per run, by two exceptAll differences."""
    missing = true.exceptAll(told).groupBy("run_id").agg(F.count(F.lit(1)).alias("missing"))
    invented = told.exceptAll(true).groupBy("run_id").agg(F.count(F.lit(1)).alias("invented"))
    zero = F.lit(0).cast("long")
    return (
        asks.join(missing, "run_id", "left")
        .join(invented, "run_id", "left")
        .select(
            "run_id", F.coalesce("missing", zero).alias("missing"),
            F.coalesce("invented", zero).alias("invented"),
        )
        .withColumn("equal", (F.col("missing") == 0) & (F.col("invented") == 0))
    )
