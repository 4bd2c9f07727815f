"""Replan segments and the declarations a policy emits over them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runaudit.functions import geometry as G


def _next(t: np.ndarray, i: int, interval: float) -> int:
    """First position whose time is at least `interval` after t[i], by the
    subtraction itself: t[i] + interval may round to the other side."""
    j = int(np.searchsorted(t, t[i] + interval))
    while j > i + 1 and t[j - 1] - t[i] >= interval:
        j -= 1
    while j < len(t) and t[j] - t[i] < interval:
        j += 1
    return max(j, i + 1)


def _greedy(t: np.ndarray, start: int, own: int, interval: float) -> tuple[list[int], int]:
    """Cuts from `start` inside the first `own` positions, and the one after."""
    cuts = []
    i = start
    while i < own:
        cuts.append(i)
        i = _next(t, i, interval)
    return cuts, i


def cut_frames(frames: DataFrame, interval: float, chunk_span: float) -> DataFrame:
    """The frames declarations are issued at: frame 0, then greedily the
    first frame at least `interval` after the last cut.

    The rule is sequential, but inside one chunk of time only the entry frame
    matters, and the entry lies within one interval of the chunk's start. So
    every chunk maps each possible entry to its exit (in parallel), a small
    table of those maps is walked per run, and the chunks then emit their cuts
    (in parallel). Chunks carry the next chunk's first interval of frames.
    """
    if chunk_span < 2 * interval:
        raise ValueError("a chunk must span at least two intervals")
    f = frames.select(
        "run_id", "frame_idx", "t", F.floor(F.col("t") / F.lit(chunk_span)).cast("long").alias("own")
    )
    ghost = (F.col("t") - F.col("own") * F.lit(chunk_span) <= interval) & (F.col("own") > 0)
    # one row per chunk the frame is seen in: its own, and the one before it
    seen = f.withColumn(
        "chunk", F.explode(F.when(ghost, F.array(F.col("own"), F.col("own") - 1)).otherwise(F.array("own")))
    )

    def maps(key, pdf):
        pdf = pdf.sort_values("frame_idx")
        run, chunk = key
        own = int((pdf["own"] == chunk).sum())
        t, idx = pdf["t"].to_numpy(), pdf["frame_idx"].to_numpy()
        if own == 0:
            return pd.DataFrame({"run_id": [], "chunk": [], "entry": [], "exit": [], "late": []}).astype(
                {"run_id": "int64", "chunk": "int64", "entry": "int64", "exit": "Int64", "late": "bool"}
            )
        near = int(np.searchsorted(t[:own], chunk * chunk_span + interval, side="right"))
        entries = range(0, min(near + 1, own))
        exits = [_greedy(t, e, own, interval)[1] for e in entries]
        return pd.DataFrame(
            {
                "run_id": run, "chunk": chunk, "entry": [int(idx[e]) for e in entries],
                "exit": pd.array([int(idx[x]) if x < len(idx) else None for x in exits], "Int64"),
                "late": [e >= near for e in entries],
            }
        )

    table = seen.groupBy("run_id", "chunk").applyInPandas(
        maps, "run_id long, chunk long, entry long, exit long, late boolean"
    )

    def walk(key, pdf):
        out, want, last = [], None, None
        for chunk, rows in pdf.sort_values(["chunk", "entry"]).groupby("chunk"):
            rows = rows.set_index("entry")
            if last is None:
                entry = rows.index[0]
            elif want is not None:
                if want not in rows.index:
                    continue
                entry = want
            elif chunk == last + 1:
                late = rows.index[rows["late"]]
                if len(late) == 0:
                    continue
                entry = late[0]
            else:
                entry = rows.index[0]
            out.append((key[0], chunk, int(entry)))
            exit_ = rows.loc[entry, "exit"]
            want, last = (None if pd.isna(exit_) else int(exit_)), chunk
        return pd.DataFrame(out, columns=["run_id", "chunk", "entry"])

    entries = table.groupBy("run_id").applyInPandas(walk, "run_id long, chunk long, entry long")

    def emit(key, pdf):
        pdf = pdf.sort_values("frame_idx")
        t, idx = pdf["t"].to_numpy(), pdf["frame_idx"].to_numpy()
        start = int(np.searchsorted(idx, pdf["entry"].iloc[0]))
        cuts, _ = _greedy(t, start, len(t), interval)
        return pd.DataFrame({"run_id": key[0], "frame_idx": idx[cuts], "t": t[cuts]})

    joined = f.withColumnRenamed("own", "chunk").join(entries, ["run_id", "chunk"])
    return joined.groupBy("run_id", "chunk").applyInPandas(
        emit, "run_id long, frame_idx long, t double"
    )


def segments(cuts: DataFrame, runs: DataFrame, chunk_rows: int = 65536) -> DataFrame:
    """Consecutive cuts bound a segment; segments share their end frame and
    the last one ends with the run."""
    from runaudit.operators.scan import Scan, number_rows, running

    n = number_rows(cuts, ["run_id"], ["frame_idx"], F.floor(F.col("frame_idx") / chunk_rows), "seq")
    n = n.withColumn("_neg", -F.col("seq")).withColumn("_chunk", F.floor(F.col("_neg") / chunk_rows).cast("long"))
    nxt = running(n, ["run_id"], "_chunk", ["_neg"], [Scan("_next", "lag", F.col("frame_idx"))])
    return nxt.join(runs.select("run_id", "frame_count"), "run_id").select(
        "run_id", "seq", F.col("frame_idx").alias("first_frame"),
        F.coalesce("_next", F.col("frame_count") - 1).alias("last_frame"), F.col("t").alias("t_issued"),
    )


def emit_declarations(
    frames: DataFrame, segs: DataFrame, q: list[str], limits: G.Limits, horizon: float,
    cell: float, bin_frames: int = 256,
) -> DataFrame:
    """One unsigned declaration per segment: window, action class (M8) and
    the region the body covers over it. Frames meet segments on frame bins; the
    region is the segment's distinct cells, whose number the workspace bounds."""
    b = F.explode(
        F.sequence(F.floor(F.col("first_frame") / bin_frames), F.floor(F.col("last_frame") / bin_frames))
    )
    s = segs.withColumn("bin", b)
    qc = [F.col(c) for c in q]
    f = frames.select(
        "run_id", "frame_idx", *q, F.floor(F.col("frame_idx") / bin_frames).alias("bin"),
        G.tip_reach_of_rows(qc, limits).alias("reach"), G.body_cells(qc, limits, cell).alias("cells"),
    )
    j = f.join(s, ["run_id", "bin"]).filter(F.col("frame_idx").between(F.col("first_frame"), F.col("last_frame")))
    keys = ["run_id", "seq", "t_issued"]
    moved = F.lit(False)
    for c in q:
        moved = moved | (F.min(c) != F.max(c))
    start = F.max(F.when(F.col("frame_idx") == F.col("first_frame"), F.col("reach")))
    end = F.max(F.when(F.col("frame_idx") == F.col("last_frame"), F.col("reach")))
    action: Column = (
        F.when(~moved, F.lit("hold")).when(end > start, F.lit("reach")).when(end < start, F.lit("retract"))
        .otherwise(F.lit("traverse"))
    )
    kinds = j.groupBy(*keys).agg(action.alias("action_class"))
    # collect_set holds distinct cells only: at most the workspace's cell count
    region = (
        j.select(*keys, F.explode("cells").alias("cell")).groupBy(*keys)
        .agg(F.sort_array(F.collect_set("cell")).alias("region"))
    )
    return kinds.join(region, keys).withColumn("horizon", F.lit(horizon))
