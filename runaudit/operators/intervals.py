"""Temporal intervals: coalescing, merging, coverage and transitions.

Frames: run_id, frame_idx, t. Observations: frames plus type, entity_id,
compare, and the edge metric. Edges: one row per interval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runaudit import vocab as V
from runaudit.functions import scalars as S
from runaudit.operators.scan import Fold, spans

REL = ("run_id", "type", "entity_id")


def with_chunk(df: DataFrame, chunk_rows: int, by: str = "frame_idx") -> DataFrame:
    return df.withColumn("chunk", F.floor(F.col(by) / F.lit(chunk_rows)).cast("long"))


def coalesce_intervals(obs: DataFrame, chunk_rows: int = V.CHUNK_ROWS) -> DataFrame:
    """Consecutive frames with one quantized value form one interval."""
    return spans(
        with_chunk(obs, chunk_rows),
        REL,
        "chunk",
        ["frame_idx"],
        lambda p, c: (p["frame_idx"] + 1 != c["frame_idx"]) | (p["compare"] != c["compare"]),
        ["frame_idx", "compare"],
        [
            Fold("frame_first", "min", F.col("frame_idx")),
            Fold("frame_last", "max", F.col("frame_idx")),
            Fold("t_start", "first", F.col("t")),
            Fold("t_end", "last", F.col("t")),
            Fold("compare", "first", F.col("compare")),
            Fold("overlap_area", "first", F.col("overlap_area")),
            Fold("min_distance", "first", F.col("min_distance")),
        ],
    )


def presence_spans(obs: DataFrame, chunk_rows: int = V.CHUNK_ROWS) -> DataFrame:
    """Maximal frame spans in which a relationship held, whatever its value."""
    return spans(
        with_chunk(obs.select(*REL, "frame_idx", "t"), chunk_rows),
        REL,
        "chunk",
        ["frame_idx"],
        lambda p, c: p["frame_idx"] + 1 != c["frame_idx"],
        ["frame_idx"],
        [
            Fold("frame_first", "min", F.col("frame_idx")),
            Fold("frame_last", "max", F.col("frame_idx")),
            Fold("t_first", "first", F.col("t")),
            Fold("t_last", "last", F.col("t")),
        ],
    )


def transitions(presence: DataFrame, runs: DataFrame) -> DataFrame:
    """Began and ceased events (W4). Ceased is stamped at the last frame it
    held; a relationship alive on the run's last frame has not ceased."""
    began = presence.select(
        *REL, F.lit("began").alias("change"), F.col("frame_first").alias("frame_idx"),
        F.col("t_first").alias("t"),
    )
    ceased = (
        presence.join(runs.select("run_id", "frame_count"), "run_id")
        .filter(F.col("frame_last") < F.col("frame_count") - 1)
        .select(
            *REL, F.lit("ceased").alias("change"), F.col("frame_last").alias("frame_idx"),
            F.col("t_last").alias("t"),
        )
    )
    return began.unionByName(ceased)


def merge_adjacent(
    edges: DataFrame,
    period: Column,
    folds: list[Fold],
    keys: tuple[str, ...] = ("run_id", "entity_id"),
    chunk_rows: int = V.CHUNK_ROWS,
) -> DataFrame:
    """Merge intervals whose start lies within 1.5 periods of the previous
    row's end - the previous row, not the furthest end so far (W2)."""
    limit = period * F.lit(1.0 + V.ADJACENCY_SLACK_FRAMES)
    rows = edges.withColumn("_limit", limit).withColumn("_period", period)
    rows = rows.withColumn(
        "chunk", F.floor(F.col("t_start") / (F.col("_period") * chunk_rows)).cast("long")
    )
    merged = spans(
        rows,
        keys,
        "chunk",
        ["t_start", "frame_first"],
        lambda p, c: c["t_start"] - p["t_end"] > c["_limit"],
        ["t_start", "t_end", "_limit"],
        [
            Fold("t_start", "first", F.col("t_start")),
            Fold("t_end", "last", F.col("t_end")),
            Fold("_period", "first", F.col("_period")),
            Fold("intervals", "sum", F.lit(1)),
            *folds,
        ],
    )
    return merged.withColumn(
        "frames", S.frames_in(F.col("t_start"), F.col("t_end"), F.col("_period"))
    ).drop("_period")


def time_bin(t: Column, period: Column, bin_frames: int = V.BIN_FRAMES) -> Column:
    return F.floor(t / (period * bin_frames)).cast("long")


BLOCK_BINS = 4096  # bins a cell may hold at once


def explode_bins(
    df: DataFrame, start: str, end: str, period: Column, bin_frames: int = V.BIN_FRAMES
) -> DataFrame:
    """Put an interval into every time bin it touches, so a range join has an
    equality key and one run never meets itself pairwise. Blocks of bins are
    dealt first, so that no cell holds all bins of a long interval."""
    a, z = (time_bin(F.col(c), period, bin_frames) for c in (start, end))
    block = lambda b: F.floor(b / F.lit(BLOCK_BINS)).cast("long")
    first = F.col("_block") * BLOCK_BINS
    bins = F.sequence(F.greatest(a, first), F.least(z, first + BLOCK_BINS - 1))
    return (
        df.withColumn("_block", F.explode(F.sequence(block(a), block(z))))
        .withColumn("bin", F.explode(bins))
        .drop("_block")
    )


def covering(
    points: DataFrame,
    intervals: DataFrame,
    keys: tuple[str, ...],
    period: Column,
    point: str = "t",
    start: str = "t_start",
    end: str = "t_end",
    bin_frames: int = V.BIN_FRAMES,
    how: str = "inner",
) -> DataFrame:
    """Point-in-closed-interval join on (keys, time bin)."""
    p = points.withColumn("bin", time_bin(F.col(point), period, bin_frames)).alias("p")
    q = explode_bins(intervals, start, end, period, bin_frames).alias("q")
    cond = F.col("p.bin") == F.col("q.bin")
    for k in keys:
        cond = cond & (F.col(f"p.{k}") == F.col(f"q.{k}"))
    cond = cond & F.col(f"p.{point}").between(F.col(f"q.{start}"), F.col(f"q.{end}"))
    extra = [c for c in intervals.columns if c not in points.columns]
    return p.join(q, cond, how).select("p.*", *[F.col(f"q.{c}") for c in extra])


def region_at(asks: DataFrame, envelope_edges: DataFrame, period: Column) -> DataFrame:
    """The one region in force at an instant; none or several is refused."""
    hit = covering(asks, envelope_edges, ("run_id",), period, how="left")
    return (
        hit.groupBy("run_id", "t")
        .agg(F.count("region_id").alias("matches"), F.max("region_id").alias("_region"))
        .select(
            "run_id",
            "t",
            "matches",
            F.when(F.col("matches") == 1, F.lit(V.ANSWERED)).otherwise(F.lit(V.CNE)).alias("verdict"),
            F.when(F.col("matches") == 1, F.col("_region")).alias("region_id"),
        )
    )


def expand_to_frames(edges: DataFrame, frames: DataFrame, period: Column) -> DataFrame:
    """One row per frame each scene interval covers."""
    scene = edges.filter(F.col("type").isin(*V.SCENE_EDGES))
    return covering(frames.select("run_id", "frame_idx", "t"), scene, ("run_id",), period)


def silent_filter(frames: DataFrame, windows: DataFrame, period: Column) -> DataFrame:
    """Drop frames inside any closed silent window."""
    w = explode_bins(windows, "t0", "t1", period).alias("w")
    f = frames.withColumn("bin", time_bin(F.col("t"), period)).alias("f")
    return f.join(
        w,
        (F.col("f.run_id") == F.col("w.run_id"))
        & (F.col("f.bin") == F.col("w.bin"))
        & F.col("f.t").between(F.col("w.t0"), F.col("w.t1")),
        "left_anti",
    ).drop("bin")


def retained_frames(presence: DataFrame, edges: DataFrame, runs: DataFrame) -> DataFrame:
    """Frames whose region geometry is kept (W7): the first and last frame, the
    first and last frame of every INTERSECTS or CONTACT span, and the frame
    each INTERSECTS interval opens on. Built from spans, not from frames."""
    ends = runs.filter(F.col("frame_count") > 0).select(
        "run_id", F.explode(F.array(F.lit(0).cast("long"), F.col("frame_count") - 1)).alias("frame_idx")
    )
    evidence = presence.filter(F.col("type").isin("INTERSECTS", "CONTACT")).select(
        "run_id", F.explode(F.array("frame_first", "frame_last")).alias("frame_idx")
    )
    opened = edges.filter(F.col("type") == "INTERSECTS").select(
        "run_id", F.col("frame_first").alias("frame_idx")
    )
    return ends.unionByName(evidence).unionByName(opened).distinct()


def region_timeline(
    digests: DataFrame, retained: DataFrame, chunk_rows: int = V.CHUNK_ROWS
) -> DataFrame:
    """HAS_ENVELOPE intervals (W6): frames sharing a digest, starting at the
    first retained frame; an island with no retained frame is dropped."""
    marked = digests.join(retained.withColumn("_kept", F.lit(True)), ["run_id", "frame_idx"], "left")
    kept = F.coalesce(F.col("_kept"), F.lit(False))
    islands = spans(
        with_chunk(marked, chunk_rows),
        ["run_id"],
        "chunk",
        ["frame_idx"],
        lambda p, c: (p["frame_idx"] + 1 != c["frame_idx"]) | (p["digest"] != c["digest"]),
        ["frame_idx", "digest"],
        [
            Fold("region_id", "first", F.col("digest")),
            Fold("frame_last", "max", F.col("frame_idx")),
            Fold("t_end", "last", F.col("t")),
            Fold("frame_first", "min", F.when(kept, F.col("frame_idx"))),
            Fold("t_start", "min", F.when(kept, F.col("t"))),
        ],
    )
    return islands.filter(F.col("frame_first").isNotNull())


def interpolate_knots(points: DataFrame, knots: DataFrame, parts: int | None = None) -> DataFrame:
    """Piecewise-linear value and slope at t; the first and last segment hold
    outside the knots' span (J13).

    Points and knots lie in one layout sorted by range; the segment of a point is
    the last knot at or before it, found by a two-level running value, so no
    pairwise range join is needed."""
    from runaudit.operators.scan import Scan, ranged, running

    back = ranged(knots.withColumn("_neg", -F.col("t")), ["run_id"], ["_neg"], parts)
    k = running(back, ["run_id"], "chunk", ["_neg"], [Scan("_next", "lag", F.struct("t", "v"))])
    ends = knots.groupBy("run_id").agg(
        F.min("t").alias("_t0"), F.max("t").alias("_t1"), F.count(F.lit(1)).alias("_knots")
    )
    seg = k.filter(F.col("_next").isNotNull()).select(
        "run_id", "t", F.struct(F.col("t").alias("ta"), F.col("v").alias("va"),
        F.col("_next.t").alias("tb"), F.col("_next.v").alias("vb")).alias("_seg"),
        F.lit(0).alias("_kind"), F.lit(None).cast(points.schema["point_id"].dataType).alias("point_id"),
    )
    first = (
        seg.groupBy("run_id").agg(F.min_by("_seg", "t").alias("_first"))
    )
    both = seg.unionByName(
        points.select("run_id", "t", F.lit(None).cast(seg.schema["_seg"].dataType).alias("_seg"),
        F.lit(1).alias("_kind"), "point_id")
    )
    found = running(
        ranged(both, ["run_id"], ["t", "_kind"], parts), ["run_id"], "chunk", ["t", "_kind", "point_id"],
        [Scan("_at", "last", F.col("_seg"), inclusive=True)],
    ).filter(F.col("_kind") == 1)
    out = found.join(first, "run_id", "left").withColumn("_s", F.coalesce("_at", "_first"))
    slope = (F.col("_s.vb") - F.col("_s.va")) / (F.col("_s.tb") - F.col("_s.ta"))
    return out.join(ends, "run_id", "left").select(
        "run_id", "point_id", "t",
        (F.col("_s.va") + slope * (F.col("t") - F.col("_s.ta"))).alias("value"),
        slope.alias("slope"),
    )
