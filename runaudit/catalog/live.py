"""Streaming queries: a replay of the bound tables as file streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from runaudit.catalog import register
from runaudit.catalog.motion import WATCHDOG, events, signed_offers
from runaudit.operators.scan import shared_path
from runaudit.sources.bindings import Records, Scene
from runaudit.streaming import live as L

# event times start well after the initial watermark, which is time zero
EPOCH_US = 1_700_000_000_000_000


@register
def stream_intervals(spark, sf):
    """X1 over all events: closed intervals, equal to the batch intervals."""
    obs = Scene(spark, sf).observations().select(
        "run_id", "type", "entity_id", "frame_idx", "t", "compare",
        F.timestamp_micros(EPOCH_US + (F.col("t") * 1e6).cast("long")).alias("at"),
    )
    root = shared_path(spark, "live")
    full = obs.unionByName(L.closing_rows(obs))
    src = L.as_stream(full, f"{root}/in")
    out = L.run_available(L.stream_intervals(src), f"{root}/out", f"{root}/check")
    return out.filter(F.col("compare") >= 0).select(
        "run_id", "type", "entity_id", "frame_first", "frame_last", "t_start", "t_end"
    )


@register
def stream_watchdog(spark, sf):
    """X2 over all offers and actions."""
    root = shared_path(spark, "watch")
    rc = Records(spark, sf)
    # regions and signatures say nothing about silence: unstored, they are never computed
    ev = events(rc, signed_offers(rc)).select("run_id", "t", "side", "seq", "horizon", "t_start")
    src = L.as_stream(ev, f"{root}/in")
    return L.run_available(L.stream_watchdog(src, WATCHDOG), f"{root}/out", f"{root}/check")
