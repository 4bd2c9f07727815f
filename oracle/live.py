"""DuckDB statements for the streaming replays: the batch results."""

from oracle import motion as _m  # noqa: F401  (defines shared expressions)
from oracle.ctes import build

SQL: dict[str, str] = {}

SQL["stream_intervals"] = build(
    "SELECT run_id, type, entity_id, frame_first, frame_last, t_start, t_end FROM edges", "edges")
SQL["stream_watchdog"] = build("""
  SELECT run_id, t, CASE WHEN t - heard > 400 THEN 'watchdog_expiry' ELSE 'stale_declaration' END AS kind FROM ev1
  WHERE side = 1 AND (t - heard > 400 OR t > ot + oh)""", "ev1")
