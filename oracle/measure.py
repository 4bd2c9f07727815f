"""DuckDB statements for the report, levels, grades and sizing."""

from oracle import integrity as _i  # noqa: F401  (defines shared expressions)
from oracle import records as _r  # noqa: F401
from oracle import scene as _s  # noqa: F401
from oracle.ctes import AREA2, DEFS, DIST, EDGES, OBS, build, define

SQL: dict[str, str] = {}

define("e30", "SELECT * FROM edges30 WHERE type = 'INTERSECTS'", "edges30")
define("ib", "SELECT b.* FROM bound b JOIN probes p ON p.run_id = b.run_id AND p.t_probe = b.t WHERE b.t <> 100.0 OR true", "bound", "probes")
define("ib1", "SELECT DISTINCT * FROM ib", "ib")
define("iv", """
  SELECT b.run_id, v.* EXCLUDE (run_id, t), v.t AS vt FROM ib1 b JOIN vrows v ON v.run_id = b.run_id AND reason = 'answered' AND v.t BETWEEN b.t0 AND b.t1""", "ib1", "vrows")
define("ifirst", "SELECT * FROM iv WHERE outcome <> 'PERMIT' QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY seq) = 1", "iv")
define("ivis", """
  SELECT run_id, entity_id, g, min(t_start) AS s FROM (SELECT *, sum(op) OVER (PARTITION BY run_id, entity_id ORDER BY t_start) AS g FROM (
    SELECT e.*, CASE WHEN t_start - lag(t_end) OVER (PARTITION BY e.run_id, entity_id ORDER BY t_start) <= 45 THEN 0 ELSE 1 END AS op
    FROM e30 e JOIN ib1 b ON b.run_id = e.run_id AND reason = 'answered' AND t_start <= b.t1 AND t_end >= b.t0)) GROUP BY 1, 2, 3""", "e30", "ib1")
define("vcs", """
  SELECT run_id, CASE WHEN bool_or(state = 'BROKEN') THEN 'BROKEN' WHEN bool_or(state <> 'VERIFIED') THEN 'COULD-NOT-EVALUATE' ELSE 'VERIFIED' END AS state,
    sum(records_walked)::BIGINT AS walked FROM vc GROUP BY 1""", "vc")
define("inc", """
  SELECT b.run_id, b.t, CASE WHEN reason = 'answered' THEN 'ANSWERED' ELSE 'COULD-NOT-EVALUATE' END AS verdict, reason, state AS integrity, walked AS records_walked,
    in_force, CASE WHEN reason = 'answered' THEN t0 END AS window_start, CASE WHEN reason = 'answered' THEN t1 END AS window_end,
    CASE WHEN reason = 'answered' THEN coalesce(n, 0) END AS adjudications, CASE WHEN reason = 'answered' THEN coalesce(r, 0) END AS refused,
    CASE WHEN reason = 'answered' THEN coalesce(f, '') END AS faults, CASE WHEN reason = 'answered' THEN coalesce(r, 0) > 0 END AS incident,
    i.verdict_id AS first_verdict_id, i.vt AS first_t, i.outcome AS first_outcome, i.fault AS first_fault, i.declaration_id AS first_declaration_id,
    i.region_id AS first_region_id, i.area AS first_area,
    CASE WHEN reason = 'answered' THEN x.verdict_id END AS earliest_verdict_id, CASE WHEN reason = 'answered' THEN x.t END AS earliest_t,
    CASE WHEN reason = 'answered' THEN CASE WHEN ru.run_id IS NOT NULL THEN 'ANSWERED' ELSE 'COULD-NOT-EVALUATE' END END AS scene_verdict,
    CASE WHEN reason = 'answered' AND ru.run_id IS NOT NULL THEN coalesce(vis, 0) END AS scene_visits,
    CASE WHEN reason = 'answered' AND ru.run_id IS NOT NULL THEN coalesce(vent, 0) END AS assumptions,
    CASE WHEN state = 'VERIFIED' THEN '' ELSE 'integrity,' END || CASE WHEN reason = 'answered' THEN 'declared,violation,enforcement,scene' ELSE 'declared' END
      || CASE WHEN state = 'VERIFIED' THEN ',integrity' ELSE '' END AS clause_order
  FROM ib1 b LEFT JOIN vcs c ON c.run_id = b.run_id
  LEFT JOIN (SELECT run_id, count(*) AS n, count(*) FILTER (WHERE outcome <> 'PERMIT') AS r,
      string_agg(DISTINCT fault, ',' ORDER BY fault) FILTER (WHERE outcome <> 'PERMIT') AS f FROM iv GROUP BY 1) a ON a.run_id = b.run_id
  LEFT JOIN ifirst i ON i.run_id = b.run_id
  LEFT JOIN (SELECT * FROM verd WHERE outcome <> 'PERMIT' QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY t, seq) = 1) x ON x.run_id = b.run_id
  LEFT JOIN (SELECT run_id, count(*) AS vis, count(DISTINCT entity_id) AS vent FROM ivis GROUP BY 1) s ON s.run_id = b.run_id
  LEFT JOIN ru ON ru.run_id = b.run_id""", "ib1", "vcs", "iv", "ifirst", "verd", "ivis", "ru")
SQL["incident_report"] = build("""
  SELECT *, 'the policy stayed inside the bound it declared and had in force at t=' || t::VARCHAR AS goal,
    'Read what was declared and in force at the instant, every action judged while those declarations ran, and the bound that was applied; then check both record chains.' AS strategy,
    'Only the scene clause depends on perceived entities. Declarations, verdicts and chains come from the machine''s own state, so an error of perception cannot turn a refusal into a permit.' AS justification
  FROM inc""", "inc")
SQL["incident_evidence"] = build("""
  SELECT b.run_id, b.t, 'declared' AS clause, k AS kind, CASE k WHEN 'declaration' THEN declaration_id ELSE region_id END AS ref, 'A' AS layer
  FROM ib1 b JOIN drows d ON d.run_id = b.run_id AND reason = 'answered' AND b.t BETWEEN t_issued AND t_issued + horizon, (VALUES ('declaration'), ('envelope')) v(k)
  UNION ALL SELECT run_id, t, c, 'verdict', first_verdict_id, 'A' FROM inc, (VALUES ('violation'), ('enforcement')) v(c) WHERE first_verdict_id IS NOT NULL
  UNION ALL SELECT run_id, t, 'enforcement', 'envelope', first_region_id, 'A' FROM inc WHERE first_region_id IS NOT NULL
  UNION ALL SELECT b.run_id, b.t, 'scene', 'intersects', entity_id, 'B' FROM ivis JOIN ib1 b USING (run_id)""", "ib1", "drows", "inc", "ivis")

_A = AREA2.format(a="0.5::DOUBLE - d")
define("hdist", "SELECT * FROM dist WHERE entity_id = 'human'", "dist")
define("hobs", OBS.format(f="hdist", area=_A).replace("0.2::DOUBLE", "0.01::DOUBLE"), "hdist")
define("hedges", EDGES.format(o="hobs"), "hobs")
define("hlog", "SELECT * FROM olog WHERE entity_id = 'human'", "olog")
LEV = "(VALUES ('occurrence'), ('transition'), ('per-frame')) l(level)"
define("hn", "SELECT run_id, count(*) AS n FROM hobs GROUP BY 1", "hobs")
SQL["level_views"] = build(f"""
  SELECT ru.run_id, level, CASE level WHEN 'transition' THEN (SELECT count(*) FROM hedges e WHERE e.run_id = ru.run_id) WHEN 'per-frame' THEN n ELSE 0 END AS edges,
    CASE level WHEN 'occurrence' THEN (SELECT count(*) FROM hlog o WHERE o.run_id = ru.run_id) ELSE 0 END AS occurrences
  FROM ru JOIN hn USING (run_id), {LEV}""", "ru", "hn", "hedges", "hlog")
define("gt", "SELECT run_id, count(*) AS frames, min(d) AS min_distance, bool_or(d < 0.05) AS contact FROM hdist GROUP BY 1", "hdist")
define("near", "SELECT h.run_id, h.t FROM hdist h JOIN gt USING (run_id) WHERE d - min_distance <= 0.01::DOUBLE", "hdist", "gt")
SQL["ground_truth"] = build("""
  SELECT gt.*, candidates, t_first FROM gt JOIN (SELECT run_id, count(*) AS candidates, min(t) AS t_first FROM near GROUP BY 1) n USING (run_id)""", "gt", "near")
define("cutf", """
  SELECT h.run_id, h.frame_idx, h.d, round_even(h.d / 0.01::DOUBLE, 0) * 0.01::DOUBLE AS a, h.run_id % 11 = 0 AND e.frame_first % 7 = 0 AS cut
  FROM hdist h JOIN hedges e ON e.run_id = h.run_id AND e.type = 'SEPARATION' AND h.frame_idx BETWEEN e.frame_first AND e.frame_last""", "hdist", "hedges")
SQL["timeline_grade"] = build("""
  SELECT run_id, count(*) AS frames, count(*) FILTER (WHERE NOT cut) AS answered,
    CASE WHEN bool_or(cut) THEN 'COULD-NOT-EVALUATE' WHEN max(abs(a - d)) FILTER (WHERE NOT cut) <= 0.01 THEN 'AGREE' ELSE 'DISAGREE' END AS verdict,
    round_even(max(abs(a - d)) FILTER (WHERE NOT cut) * 1e6, 0)::BIGINT AS worst_um FROM cutf GROUP BY 1""", "cutf")
define("ans", f"""
  SELECT gt.run_id, level, frames, gt.contact AS true_contact, c.bucket AS min_cm,
    CASE level WHEN 'occurrence' THEN round_even(c.frame_idx * 0.02::DOUBLE / 1.0::DOUBLE, 0) * 1.0::DOUBLE ELSE c.frame_idx * 0.02::DOUBLE END AS t_close,
    CASE level WHEN 'occurrence' THEN 1.0::DOUBLE ELSE 0.01::DOUBLE END AS time_tol_s,
    CASE WHEN level = 'occurrence' AND gt.run_id % 3 = 0 THEN NULL ELSE gt.contact END AS contact,
    CASE WHEN level <> 'occurrence' THEN frames END AS timeline
  FROM gt JOIN closest c ON c.run_id = gt.run_id AND c.entity_id = 'human', {LEV}""", "gt", "closest")
SQL["answers_at_level"] = build("SELECT run_id, level, min_cm, t_close, time_tol_s, contact, timeline FROM ans", "ans")
define("sg", """
  SELECT run_id, level, 'min_separation' AS query, 'AGREE' AS verdict FROM ans
  UNION ALL SELECT run_id, level, 'did_contact_occur', CASE WHEN contact IS NULL THEN 'COULD-NOT-EVALUATE' WHEN contact = true_contact THEN 'AGREE' ELSE 'DISAGREE' END FROM ans
  UNION ALL SELECT run_id, level, 'separation_timeline', CASE WHEN timeline IS NULL THEN 'COULD-NOT-EVALUATE' ELSE 'AGREE' END FROM ans
  UNION ALL SELECT a.run_id, level, 'time_of_closest_approach', CASE WHEN o <= 0.01 THEN 'AGREE' WHEN o <= time_tol_s THEN 'COULD-NOT-EVALUATE' ELSE 'DISAGREE' END
    FROM ans a JOIN (SELECT a.run_id AS r, a.level AS l, min(abs(t_close - n.t)) AS o FROM ans a JOIN near n USING (run_id) GROUP BY 1, 2) m ON r = a.run_id AND l = level""", "ans", "near")
SQL["resolution_grades"] = build("SELECT * FROM sg", "sg")
define("rt", """
  SELECT p.*, coalesce(v, 0) AS verdicts, coalesce(r, 0) AS refused,
    (SELECT count(*) FROM decl d WHERE d.run_id = p.run_id AND t_probe BETWEEN t_issued AND t_issued + horizon) AS in_force,
    (SELECT count(*) FROM verd x WHERE x.run_id = p.run_id AND x.declaration_id = probe_declaration_id) AS adjudications
  FROM probes p LEFT JOIN (SELECT run_id, count(*) AS v, count(*) FILTER (WHERE outcome <> 'PERMIT') AS r FROM verd GROUP BY 1) x USING (run_id)""", "probes", "decl", "verd")
SQL["record_truth"] = build("SELECT * FROM rt", "rt")
define("vflags", """
  SELECT p.run_id, bool_or(d.order_key % 41 = 0) AS lost FROM probes p JOIN decl d ON d.run_id = p.run_id AND t_probe BETWEEN t_issued AND t_issued + horizon GROUP BY 1""", "probes", "decl")
define("vdiff", """
  SELECT v.run_id, bool_or(ch AND (outcome <> 'PERMIT' OR true)) AS viol, bool_or(ch AND v.declaration_id = p.probe_declaration_id) AS adj,
    bool_or(outcome = 'CLAMP' AND NOT ch AND v.declaration_id = p.probe_declaration_id) AS clamp
  FROM (SELECT *, run_id % 7 = 2 AND seq % 13 = 4 AND outcome <> 'VETO' AS ch FROM verd) v JOIN probes p ON p.run_id = v.run_id GROUP BY 1""", "verd", "probes")
define("rg", f"""
  SELECT p.run_id, level, query, CASE query
      WHEN 'declared_bound' THEN CASE WHEN level = 'occurrence' OR f.lost THEN 'COULD-NOT-EVALUATE' ELSE 'AGREE' END
      WHEN 'violations' THEN CASE WHEN coalesce(viol, false) THEN 'DISAGREE' ELSE 'AGREE' END
      WHEN 'verdicts' THEN CASE WHEN coalesce(adj, false) THEN 'DISAGREE' WHEN level = 'occurrence' AND coalesce(clamp, false) THEN 'COULD-NOT-EVALUATE' ELSE 'AGREE' END
      ELSE CASE WHEN p.run_id % 9 = 1 OR d.run_id IS NULL THEN 'COULD-NOT-EVALUATE' WHEN p.run_id % 9 IN (2, 3) THEN 'DISAGREE' ELSE 'AGREE' END END AS verdict
  FROM probes p LEFT JOIN vflags f ON f.run_id = p.run_id LEFT JOIN vdiff d ON d.run_id = p.run_id, {LEV},
    (VALUES ('declared_bound'), ('violations'), ('verdicts'), ('verify_chain')) q(query)""", "probes", "vflags", "vdiff")
SQL["record_level_grades"] = build("SELECT * FROM rg", "rg")
define("allg", "SELECT * FROM sg UNION ALL SELECT * FROM rg", "sg", "rg")
SQL["level_verdict"] = build("""
  SELECT run_id, level, CASE WHEN bool_or(verdict = 'DISAGREE') THEN 'DISAGREE' WHEN bool_or(verdict <> 'AGREE') THEN 'COULD-NOT-EVALUATE' ELSE 'AGREE' END AS verdict
  FROM allg GROUP BY 1, 2""", "allg")
SQL["level_lost"] = build("""
  SELECT run_id, level, coalesce(string_agg(query, ',' ORDER BY query) FILTER (WHERE verdict <> 'AGREE'), '') AS lost, count(*) FILTER (WHERE verdict = 'AGREE') AS kept
  FROM allg GROUP BY 1, 2""", "allg")
SQL["crossover"] = build("""
  SELECT f.run_id, crossed_at, smallest, largest, count(*) FILTER (WHERE frame_idx > crossed_at AND value / 100.0::DOUBLE < 1.0) AS fell_back
  FROM fr f JOIN (SELECT run_id, min(frame_idx) FILTER (WHERE value / 100.0::DOUBLE >= 1.0) AS crossed_at, min(frame_idx) AS smallest, max(frame_idx) AS largest
                  FROM fr GROUP BY 1) x USING (run_id) GROUP BY 1, 2, 3, 4""", "fr")
SQL["rate_multiple"] = """
  SELECT user_id AS run_id, arg_min(value, event_id) AS low, arg_max(value, event_id) AS high,
    CASE WHEN count(*) > 1 AND arg_min(value, event_id) > 0 THEN arg_max(value, event_id) / arg_min(value, event_id) END AS multiple FROM events GROUP BY 1"""
SQL["retention_projection"] = """
  SELECT run_id, h AS bytes_per_hour, h * 4380.0::DOUBLE AS retained_bytes, CASE WHEN h > 0 THEN (1e12 * 4380 / 24.0)::DOUBLE / (h * 4380.0::DOUBLE) END AS sensor_ratio FROM (
    SELECT user_id AS run_id, CASE WHEN count(*) > 1 THEN sum(octet_length(encode(props)))::BIGINT * 3600.0::DOUBLE / ((count(*) - 1) * 0.02::DOUBLE) END AS h FROM events GROUP BY 1)"""
define("flog", DEFS["log"][1].replace("UNION ALL\n    SELECT run_id, 4,", """UNION ALL
    SELECT e.run_id, 2, e.seq, e.ordinal, e.type, 'A', NULL, e.t, NULL FROM evs e WHERE e.run_id IN (SELECT run_id FROM ru)
    UNION ALL
    SELECT run_id, 4,"""), *DEFS["log"][0], "evs")
define("ev_rows", """
  SELECT run_id, 'edges' AS "table", type AS kind, entity_id AS what, frame_first AS n1, frame_last AS n2 FROM edges
  UNION ALL SELECT run_id, 'edges', 'HAS_ENVELOPE', region_id, frame_first, frame_last FROM envs
  UNION ALL SELECT run_id, 'occurrences', type, coalesce(entity_id, ''), seq, round_even(t / 1.0::DOUBLE, 0)::BIGINT FROM flog
  UNION ALL SELECT DISTINCT run_id, 'regions', 'region', region_id, 0, 0 FROM envs
  UNION ALL SELECT run_id, 'retained', 'frame', '', frame_idx, 0 FROM kept
  UNION ALL SELECT run_id, 'records', kind, record_id, seq, round_even(t, 0)::BIGINT FROM recs WHERE run_id IN (SELECT run_id FROM ru)
  UNION ALL SELECT run_id, 'record_edges', type, src_id || '>' || dst_id, round_even(t_start, 0)::BIGINT, round_even(t_end, 0)::BIGINT FROM att WHERE run_id IN (SELECT run_id FROM ru)""",
  "edges", "envs", "flog", "kept", "recs", "att", "ru")
SQL["evidence_rows"] = build("SELECT * FROM ev_rows", "ev_rows")
SQL["build_evidence"] = build("""SELECT run_id, "table", count(*) AS rows FROM ev_rows GROUP BY 1, 2""", "ev_rows")
define("hc", "SELECT * FROM obs WHERE entity_id = 'human'", "obs")
define("rungs", "SELECT * FROM (VALUES (10::BIGINT), (20::BIGINT), (40::BIGINT), (1099511627776::BIGINT)) r(rung)")
SQL["scaling_ladder"] = build("""
  SELECT rung, (SELECT count(*) FROM fr WHERE frame_idx < rung) AS frames,
    (SELECT sum(octet_length(encode(printf('%.6f', t) || ',' || printf('%.6f', value))))::BIGINT FROM fr WHERE frame_idx < rung) AS stream_bytes,
    (SELECT count(*) FROM edges WHERE entity_id = 'human' AND frame_first < rung) AS intervals FROM rungs""", "fr", "edges", "rungs")
SQL["crossover_fallbacks"] = build("""
  SELECT f.run_id, frame_idx AS frames, value / 100.0::DOUBLE AS ratio
  FROM fr f JOIN (SELECT run_id, min(frame_idx) AS first_at FROM fr WHERE value / 100.0::DOUBLE >= 1.0 GROUP BY 1) x ON x.run_id = f.run_id
  WHERE frame_idx > first_at AND value / 100.0::DOUBLE < 1.0""", "fr")
define("rate_seg", """
  SELECT run_id, t AS ta, value / 100.0::DOUBLE AS va, lead(t) OVER w AS tb, lead(value / 100.0::DOUBLE) OVER w AS vb FROM fr
  WINDOW w AS (PARTITION BY run_id ORDER BY frame_idx)""", "fr")
define("rate_pts", """
  SELECT run_id, rate, k, k / rate::DOUBLE AS t FROM (
    SELECT run_id, rate, unnest(range(round_even(t_last * rate, 0)::BIGINT + 1)) AS k FROM ru, (VALUES (50), (100), (250), (1000)) r(rate) WHERE frame_count > 1)""", "ru")
define("rate_frames", """
  SELECT p.run_id, p.rate, p.k, round_even(p.t / 0.01::DOUBLE, 0)::BIGINT AS b, s.va + (s.vb - s.va) / (s.tb - s.ta) * (p.t - s.ta) AS d
  FROM rate_pts p ASOF JOIN (SELECT * FROM rate_seg WHERE tb IS NOT NULL) s ON s.run_id = p.run_id AND p.t >= s.ta""", "rate_pts", "rate_seg")
define("rate_cmp", """
  SELECT *, round_even(d / 0.01::DOUBLE, 0)::BIGINT AS c FROM rate_frames""", "rate_frames")
SQL["control_rates"] = build("""
  SELECT run_id, rate::BIGINT AS rate, count(*) AS frames, count(DISTINCT b) AS instants, sum(CASE WHEN before = c THEN 0 ELSE 1 END)::BIGINT AS intervals,
    round_even(max(abs(d - said * 0.01::DOUBLE)) * 1e6, 0)::BIGINT AS worst_error_e6
  FROM (SELECT *, lag(c) OVER (PARTITION BY run_id, rate ORDER BY k) AS before, first_value(c) OVER (PARTITION BY run_id, rate, b ORDER BY k) AS said FROM rate_cmp)
  GROUP BY 1, 2""", "rate_cmp")
SQL["layer_independence"] = build("""
  SELECT s.run_id, count(rg.query) AS graded, coalesce(string_agg(DISTINCT rg.query || '@' || rg.level, ',' ORDER BY rg.query || '@' || rg.level) FILTER (WHERE rg.verdict <> 'AGREE'), '') AS "where",
    count(rg.query) > 0 AND count(*) FILTER (WHERE rg.verdict <> 'AGREE') = 0 AS independent
  FROM (SELECT DISTINCT run_id FROM allg) s LEFT JOIN rg ON rg.run_id = s.run_id GROUP BY 1""", "allg", "rg")
