"""DuckDB statements for the motion queries."""

from oracle.ctes import AREA2, build, define

SQL: dict[str, str] = {}

define("mv", """
  SELECT run_id, frame_idx, t, event_id, (event_id % 628) / 100.0::DOUBLE - 3.14::DOUBLE AS q0, (event_id % 520) / 100.0::DOUBLE - 2.6::DOUBLE AS q1,
    ((event_id * 7) % 400) / 100.0::DOUBLE - 2.0::DOUBLE AS qd0, ((event_id * 11) % 500) / 100.0::DOUBLE - 2.5::DOUBLE AS qd1,
    ((event_id * 13) % 300) / 100.0::DOUBLE - 1.5::DOUBLE AS hx, ((event_id * 17) % 300) / 100.0::DOUBLE - 1.5::DOUBLE AS hy FROM fr""", "fr")
define("discs", """
  SELECT m.*, e.* FROM mv m, (VALUES ('crate', 1.6::DOUBLE, 1.2::DOUBLE, 0.25::DOUBLE), ('pillar', -1.2, 0.9, 0.3), ('pallet', 2.2, -0.8, 0.2)) e(entity_id, cx, cy, r)
  UNION ALL SELECT *, 'human', hx, hy, 0.25 FROM mv""", "mv")
define("links", """
  SELECT *, 0.0::DOUBLE AS x1, 0.0::DOUBLE AS y1, q0 AS a1, 0.5::DOUBLE * cos(q0) AS x2, 0.5::DOUBLE * sin(q0) AS y2, q0 + q1 AS a2 FROM discs""", "discs")
define("uv", """
  SELECT *, (cx - x1) * cos(a1) + (cy - y1) * sin(a1) AS u1, (cy - y1) * cos(a1) - (cx - x1) * sin(a1) AS v1,
    (cx - x2) * cos(a2) + (cy - y2) * sin(a2) AS u2, (cy - y2) * cos(a2) - (cx - x2) * sin(a2) AS v2 FROM links""", "links")
SQL["observe"] = build("""
  SELECT run_id, frame_idx, entity_id, round_even(d / 0.01::DOUBLE, 0)::BIGINT AS distance_bucket, d <= 0 AS contact FROM (
    SELECT *, greatest(least(
      sqrt(pow(greatest(abs(u1 - 0.25) - 0.25, 0), 2) + pow(greatest(abs(v1) - 0.05, 0), 2)),
      sqrt(pow(greatest(abs(u2 - 0.2) - 0.2, 0), 2) + pow(greatest(abs(v2) - 0.05, 0), 2))) - r, 0) AS d FROM uv)""", "uv")
define("box", """
  SELECT *, greatest(q0 - d0, -pi()) AS lo0, least(q0 + d0, pi()) AS hi0, greatest(q1 - d1, -2.6) AS lo1, least(q1 + d1, 2.6) AS hi1 FROM (
    SELECT *, s0 * t0 + 4.0 * t0 * t0 + 2.0 * (0.1 - t0) AS d0, s1 * t1 + 5.0 * t1 * t1 + 2.5 * (0.1 - t1) AS d1 FROM (
      SELECT *, least(greatest((2.0 - s0) / 8.0, 0), 0.1::DOUBLE) AS t0, least(greatest((2.5 - s1) / 10.0, 0), 0.1::DOUBLE) AS t1 FROM (
        SELECT *, least(abs(qd0) + 0.2::DOUBLE, 2.0::DOUBLE) AS s0, least(abs(qd1) + 0.25::DOUBLE, 2.5::DOUBLE) AS s1 FROM mv)))""", "mv")
define("grid", """
  SELECT *, lo0 + (hi0 - lo0) * i / greatest(steps - 1, 1) AS a FROM (SELECT *, unnest(range(steps)) AS i FROM (
    SELECT *, CASE WHEN hi0 = lo0 THEN 1 ELSE ceil((hi0 - lo0) * 0.9 / 0.05)::BIGINT + 1 END AS steps FROM box))""", "box")
SQL["outer_radius"] = build("""
  SELECT run_id, frame_idx, CASE WHEN q0 BETWEEN -pi() AND pi() AND q1 BETWEEN -2.6 AND 2.6 AND abs(qd0) <= 2 AND abs(qd1) <= 2.5
    THEN round_even(least(greatest(0.55, far + slack + 0.05), 0.95) * 1e4, 0)::BIGINT END AS radius_e4
  FROM (SELECT run_id, frame_idx, any_value(q0) AS q0, any_value(q1) AS q1, any_value(qd0) AS qd0, any_value(qd1) AS qd1,
      max(CASE WHEN steps > 1 THEN 0.5 * (hi0 - lo0) / (steps - 1) * 0.9 ELSE 0 END) AS slack,
      max(CASE WHEN turn - 2 * pi() * floor(turn / (2 * pi())) <= hi1 - lo1 THEN 0.9
        ELSE greatest(0.5, sqrt(pow(bx + 0.4 * cos(a + lo1), 2) + pow(yb + 0.4 * sin(a + lo1), 2)), sqrt(pow(bx + 0.4 * cos(a + hi1), 2) + pow(yb + 0.4 * sin(a + hi1), 2))) END) AS far
    FROM (SELECT *, 0.5 * cos(a) AS bx, 0.5 * sin(a) AS yb, atan2(0.5 * sin(a), 0.5 * cos(a)) - (a + lo1) AS turn FROM grid) GROUP BY 1, 2)""", "grid")


def step(src, dt):
    return f"""
  SELECT run_id, frame_idx, u0, u1,
    least(greatest(p0 + least(greatest(w0 + 0.5 * u0 * {dt}, -2.0), 2.0) * {dt}, -pi()), pi()) AS p0,
    least(greatest(p1 + least(greatest(w1 + 0.5 * u1 * {dt}, -2.5), 2.5) * {dt}, -2.6), 2.6) AS p1,
    least(greatest(w0 + u0 * {dt}, -2.0), 2.0) AS w0, least(greatest(w1 + u1 * {dt}, -2.5), 2.5) AS w1 FROM {src}"""


define("s0", """
  SELECT run_id, frame_idx, u0, u1, q0 AS p0, q1 AS p1, qd0 AS w0, qd1 AS w1
  FROM mv, (VALUES (-8.0::DOUBLE, -10.0::DOUBLE), (-8.0, 10.0), (8.0, -10.0), (8.0, 10.0)) u(u0, u1)""", "mv")
define("s1", step("s0", "0.05::DOUBLE"), "s0")
define("s2", step("s1", "0.05::DOUBLE"), "s1")
define("poses", """
  SELECT DISTINCT run_id, frame_idx, p0, p1 FROM (SELECT run_id, frame_idx, p0, p1 FROM s0 UNION ALL
    SELECT run_id, frame_idx, p0, p1 FROM s1 UNION ALL SELECT run_id, frame_idx, p0, p1 FROM s2)""", "s0", "s1", "s2")


def raster(src, radius, first="0.5", key="frame_idx"):
    """Distinct cells of the body at every pose of src(run_id, key, p0, p1)."""
    return f"""
  SELECT DISTINCT run_id, {key}, (ix + 524288) * 1048576 + (iy + 524288) AS cell FROM (
    SELECT *, unnest(range(floor((least(y, y + len * sin(a)) - {radius}) / 0.08)::BIGINT, floor((greatest(y, y + len * sin(a)) + {radius}) / 0.08)::BIGINT + 1)) AS iy FROM (
      SELECT *, unnest(range(floor((least(x, x + len * cos(a)) - {radius}) / 0.08)::BIGINT, floor((greatest(x, x + len * cos(a)) + {radius}) / 0.08)::BIGINT + 1)) AS ix FROM (
        SELECT run_id, {key}, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, p0 AS a, {first}::DOUBLE AS len FROM {src}
        UNION ALL SELECT run_id, {key}, {first}::DOUBLE * cos(p0), {first}::DOUBLE * sin(p0), p0 + p1, 0.4::DOUBLE FROM {src})))
  WHERE ((ix + 0.5) * 0.08::DOUBLE - x) * cos(a) + ((iy + 0.5) * 0.08::DOUBLE - y) * sin(a) BETWEEN 0 AND len
    AND abs(((iy + 0.5) * 0.08::DOUBLE - y) * cos(a) - ((ix + 0.5) * 0.08::DOUBLE - x) * sin(a)) <= {radius}::DOUBLE"""


define("reach_c", raster("poses", "0.05"), "poses")
SQL["reach_cells"] = build("""
  SELECT m.run_id, m.frame_idx, count(cell) AS cells, coalesce(sum(cell), 0)::BIGINT AS cell_sum,
    sha256(coalesce(string_agg(cell::VARCHAR, ',' ORDER BY cell), '')) AS digest
  FROM mv m LEFT JOIN reach_c c ON c.run_id = m.run_id AND c.frame_idx = m.frame_idx GROUP BY 1, 2""", "mv", "reach_c")
_A = AREA2.format(a="n * (0.08::DOUBLE * 0.08::DOUBLE)")
SQL["reach_overlap"] = build(f"""
  SELECT run_id, frame_idx, entity_id, n AS cells, {_A} AS overlap_area FROM (
    SELECT d.run_id, d.frame_idx, d.entity_id, count(*) AS n FROM discs d JOIN reach_c c ON c.run_id = d.run_id AND c.frame_idx = d.frame_idx
    WHERE sqrt(pow(((cell // 1048576 - 524288) + 0.5) * 0.08::DOUBLE - cx, 2) + pow(((cell % 1048576 - 524288) + 0.5) * 0.08::DOUBLE - cy, 2)) <= r
    GROUP BY 1, 2, 3)""", "discs", "reach_c")
define("hg", """
  SELECT DISTINCT run_id, frame_idx // 5 AS frame_idx, run_id * 3 + frame_idx // 5 // 2 * 37 AS k FROM fr""", "fr")
define("g0", """
  SELECT run_id, frame_idx, u0, u1, (k % 628) / 100.0::DOUBLE - 3.14::DOUBLE AS p0, (k % 520) / 100.0::DOUBLE - 2.6::DOUBLE AS p1, 0.5::DOUBLE AS w0, -0.5::DOUBLE AS w1
  FROM hg, (VALUES (-8.0::DOUBLE, -10.0::DOUBLE), (-8.0, 10.0), (8.0, -10.0), (8.0, 10.0)) u(u0, u1)""", "hg")
define("g1", step("g0", "0.05::DOUBLE"), "g0")
define("g2", step("g1", "0.05::DOUBLE"), "g1")
define("gposes", """
  SELECT DISTINCT run_id, frame_idx, p0, p1 FROM (SELECT run_id, frame_idx, p0, p1 FROM g0 UNION ALL
    SELECT run_id, frame_idx, p0, p1 FROM g1 UNION ALL SELECT run_id, frame_idx, p0, p1 FROM g2)""", "g0", "g1", "g2")
define("reach_g", raster("gposes", "0.05"), "gposes")
define("gdig", "SELECT run_id, frame_idx AS g, sha256(string_agg(cell::VARCHAR, ',' ORDER BY cell)) AS region_id FROM reach_g GROUP BY 1, 2", "reach_g")
SQL["reach_timeline"] = build("""
  SELECT run_id, region_id, min(frame_idx) FILTER (WHERE kept) AS frame_first, max(frame_idx) AS frame_last, min(t) FILTER (WHERE kept) AS t_start, max(t) AS t_end
  FROM (SELECT f.run_id, f.frame_idx, f.t, d.region_id, k.frame_idx IS NOT NULL AS kept,
          f.frame_idx - row_number() OVER (PARTITION BY f.run_id, d.region_id ORDER BY f.frame_idx) AS island
        FROM fr f JOIN gdig d ON d.run_id = f.run_id AND d.g = f.frame_idx // 5 LEFT JOIN kept k ON k.run_id = f.run_id AND k.frame_idx = f.frame_idx)
  GROUP BY run_id, region_id, island HAVING count(*) FILTER (WHERE kept) > 0""", "fr", "gdig", "kept")
define("pose0", "SELECT run_id, frame_idx, q0 AS p0, q1 AS p1 FROM mv", "mv")
define("body_c", raster("pose0", "0.05"), "pose0")
define("wide_c", raster("pose0", "0.15"), "pose0")
SQL["escape_cells"] = build("""
  SELECT b.run_id, b.frame_idx, count(*) AS body_cells, count(*) FILTER (WHERE w.cell IS NULL) AS escaped
  FROM body_c b LEFT JOIN wide_c w ON w.run_id = b.run_id AND w.frame_idx = b.frame_idx // 4 * 4 AND w.cell = b.cell GROUP BY 1, 2""", "body_c", "wide_c")
define("cuts", """
  SELECT run_id, 0::BIGINT AS frame_idx, 0.0::DOUBLE AS t, 0::BIGINT AS seq FROM ru
  UNION ALL
  SELECT c.run_id, n.frame_idx, n.t, c.seq + 1 FROM cuts c, LATERAL (
    SELECT f.frame_idx, f.t FROM fr f WHERE f.run_id = c.run_id AND f.frame_idx > c.frame_idx AND f.frame_idx < c.frame_idx + 20 AND f.t - c.t >= 0.3::DOUBLE
    ORDER BY f.frame_idx LIMIT 1) n""", "ru", "fr")
define("segs", """
  SELECT c.run_id, seq, frame_idx AS first_frame, coalesce(lead(frame_idx) OVER (PARTITION BY c.run_id ORDER BY seq), frame_count - 1) AS last_frame, t AS t_issued
  FROM cuts c JOIN ru USING (run_id)""", "cuts", "ru")
SQL["replan_segments"] = build("SELECT * FROM segs", "segs")
define("mh", """
  SELECT * REPLACE (CASE WHEN run_id % 4 = 0 THEN 0.3::DOUBLE ELSE q0 END AS q0, CASE WHEN run_id % 4 = 0 THEN 0.4::DOUBLE ELSE q1 END AS q1) FROM mv""", "mv")
define("poseh", "SELECT run_id, frame_idx, q0 AS p0, q1 AS p1 FROM mh", "mh")
define("bodyh", raster("poseh", "0.05"), "poseh")
SQL["emit_declarations"] = build("""
  SELECT s.run_id, s.seq, s.t_issued, 0.3::DOUBLE AS horizon, k.action_class, c.cells FROM segs s
  JOIN (SELECT s.run_id, s.seq, CASE WHEN min(q0) = max(q0) AND min(q1) = max(q1) THEN 'hold' WHEN e > b THEN 'reach' WHEN e < b THEN 'retract' ELSE 'traverse' END AS action_class
        FROM (SELECT s.*, m.q0, m.q1, max(CASE WHEN m.frame_idx = first_frame THEN r END) OVER w AS b, max(CASE WHEN m.frame_idx = last_frame THEN r END) OVER w AS e
              FROM segs s JOIN (SELECT *, sqrt(pow(0.5 * cos(q0) + 0.4 * cos(q0 + q1), 2) + pow(0.5 * sin(q0) + 0.4 * sin(q0 + q1), 2)) AS r FROM mh) m
                ON m.run_id = s.run_id AND m.frame_idx BETWEEN first_frame AND last_frame WINDOW w AS (PARTITION BY s.run_id, s.seq)) s GROUP BY 1, 2, b, e) k
    ON k.run_id = s.run_id AND k.seq = s.seq
  JOIN (SELECT s.run_id, s.seq, count(DISTINCT cell) AS cells FROM segs s JOIN bodyh b ON b.run_id = s.run_id AND b.frame_idx BETWEEN first_frame AND last_frame GROUP BY 1, 2) c
    ON c.run_id = s.run_id AND c.seq = s.seq""", "segs", "mh", "bodyh")

PASSIVATING = """('no_declaration', 'stale_declaration', 'envelope_overclaim', 'out_of_vocabulary_action', 'unattributed',
  'replay_or_reorder', 'watchdog_expiry', 'escalation_failure')"""
UNIT_Q = "run_id % 628 / 100.0::DOUBLE - 3.14::DOUBLE AS p0, run_id % 200 / 100.0::DOUBLE - 1.0::DOUBLE AS p1"
define("unit_pose", f"SELECT run_id, 0 AS k, {UNIT_Q} FROM (SELECT DISTINCT run_id FROM decl)", "decl")
define("unit_wide", raster("unit_pose", "0.15", key="k"), "unit_pose")
define("unit_long", raster("unit_pose", "0.15", first="0.8", key="k"), "unit_pose")
define("unit_reach", """
  SELECT run_id, far, count(*) AS cells, max(sqrt(pow(abs(((cell // 1048576 - 524288) + 0.5) * 0.08::DOUBLE) + 0.04::DOUBLE, 2)
    + pow(abs(((cell % 1048576 - 524288) + 0.5) * 0.08::DOUBLE) + 0.04::DOUBLE, 2))) - (0.5::DOUBLE + 0.4::DOUBLE + 0.15::DOUBLE + 0.08::DOUBLE / sqrt(2.0::DOUBLE)) AS excess
  FROM (SELECT run_id, false AS far, cell FROM unit_wide UNION ALL SELECT run_id, true, cell FROM unit_long) GROUP BY 1, 2""", "unit_wide", "unit_long")
SQL["envelope_excess"] = build("""
  SELECT d.run_id, declaration_id, cells, round_even(excess * 1e4, 0)::BIGINT AS excess_e4, excess > 0 AS overclaim
  FROM decl d JOIN unit_reach u ON u.run_id = d.run_id AND u.far = (order_key % 60 = 1)""", "decl", "unit_reach")
define("act_pose", f"""
  SELECT run_id, seq, p0 + CASE WHEN seq % 7 = 3 THEN 0.35::DOUBLE ELSE seq * 13 % 10 / 200.0::DOUBLE END AS p0, p1
  FROM (SELECT run_id, seq, {UNIT_Q} FROM verd)""", "verd")
define("act_cells", raster("act_pose", "0.05", key="seq"), "act_pose")
define("act_out", """
  SELECT a.run_id, a.seq, max(CASE WHEN w.cell IS NULL THEN 1 ELSE 0 END) AS out_wide, max(CASE WHEN l.cell IS NULL THEN 1 ELSE 0 END) AS out_long
  FROM act_cells a LEFT JOIN unit_wide w ON w.run_id = a.run_id AND w.cell = a.cell LEFT JOIN unit_long l ON l.run_id = a.run_id AND l.cell = a.cell GROUP BY 1, 2""",
  "act_cells", "unit_wide", "unit_long")
CLAMPED = """
  SELECT o.run_id, o.t, o.side, o.seq, o.declaration_id, CASE WHEN x THEN 'CLAMP' ELSE outcome END AS outcome,
    CASE WHEN x THEN 'declaration_action_mismatch' ELSE fault END AS fault FROM (
    SELECT o.*, coalesce(outcome = 'PERMIT' AND CASE WHEN d.order_key % 60 = 1 THEN out_long ELSE out_wide END = 1, false) AS x
    FROM {src} o LEFT JOIN act_out a ON o.side = 1 AND a.run_id = o.run_id AND a.seq = o.seq
    LEFT JOIN decl d ON d.run_id = o.run_id AND d.declaration_id = o.declaration_id) o"""
define("ev", """
  SELECT e.*, s.t_start FROM (
    SELECT d.run_id, t_issued AS t, 0 AS side, seq, declaration_id, CASE WHEN order_key % 40 = 7 THEN seq - 1 ELSE seq END AS claimed, horizon * 8 AS horizon,
      CASE WHEN order_key % 70 = 2 THEN 'lunge' ELSE action_class END AS action_class,
      CASE WHEN order_key % 50 = 3 THEN 'unattributed' WHEN order_key % 70 = 2 THEN 'out_of_vocabulary_action' WHEN excess > 0 THEN 'envelope_overclaim' END AS offer_fault
    FROM decl d JOIN unit_reach u ON u.run_id = d.run_id AND u.far = (order_key % 60 = 1)
    UNION ALL SELECT v.run_id, v.t, 1, v.seq, NULL, NULL, NULL, NULL, NULL FROM verd v) e
  JOIN (SELECT run_id, min(t_issued) AS t_start FROM decl GROUP BY 1) s ON s.run_id = e.run_id""", "decl", "verd", "unit_reach")
define("ev1", """
  SELECT *, row_number() OVER w AS pos, max(claimed) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS maxseq,
    greatest(coalesce(max(CASE WHEN side = 0 THEN t END) OVER w, t_start), t_start) AS heard,
    last_value(CASE WHEN side = 0 THEN declaration_id END IGNORE NULLS) OVER w AS oid, last_value(CASE WHEN side = 0 THEN t END IGNORE NULLS) OVER w AS ot,
    last_value(CASE WHEN side = 0 THEN horizon END IGNORE NULLS) OVER w AS oh
  FROM ev WINDOW w AS (PARTITION BY run_id ORDER BY t, side, seq)""", "ev")
FIND = """CASE WHEN offer_fault IN ('unattributed', 'out_of_vocabulary_action') THEN offer_fault WHEN claimed <= {m} THEN 'replay_or_reorder' ELSE offer_fault END"""
define("ev2", f"""
  SELECT *, CASE WHEN side = 0 THEN {FIND.format(m='maxseq')} WHEN t - heard > 400 THEN 'watchdog_expiry' WHEN oid IS NULL THEN 'no_declaration'
      WHEN t > ot + oh THEN 'stale_declaration' END AS cand FROM ev1""", "ev1")
define("ev3", f"""
  SELECT e.*, f.p AS fp, coalesce(pos > f.p, false) AS aft, CASE WHEN side = 0 THEN {FIND.format(m='f.m')} END AS later
  FROM ev2 e LEFT JOIN (SELECT run_id, min(pos) AS p, arg_min(maxseq, pos) AS m FROM (SELECT run_id, pos, coalesce(maxseq, -99) AS maxseq FROM ev2 WHERE cand IN {PASSIVATING}) GROUP BY 1) f ON f.run_id = e.run_id""", "ev2")
define("ev4", """
  SELECT *, CASE WHEN aft AND side = 0 THEN coalesce(later, CASE WHEN action_class <> 'escalate' THEN 'escalation_failure' END) WHEN NOT aft THEN cand END AS f0 FROM ev3""", "ev3")
define("ev5", f"""
  SELECT *, CASE WHEN aft AND side = 1 THEN last_value(CASE WHEN f0 IN {PASSIVATING} THEN f0 END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY pos) ELSE f0 END AS fault FROM ev4""", "ev4")
define("ev6", """
  SELECT run_id, t, side, seq, CASE WHEN side = 0 THEN declaration_id WHEN NOT aft AND (outcome = 'PERMIT' OR fault = 'stale_declaration') THEN oid END AS declaration_id, outcome, fault FROM (
    SELECT *, CASE WHEN aft AND side = 1 THEN 'SAFE_STATE' WHEN fault IN ('watchdog_expiry', 'escalation_failure') THEN 'SAFE_STATE'
      WHEN fault IS NOT NULL THEN 'VETO' WHEN side = 1 THEN 'PERMIT' END AS outcome FROM ev5) WHERE outcome IS NOT NULL""", "ev5")
SQL["adjudicate_sql"] = build(CLAMPED.format(src="ev6"), "ev6", "act_out", "decl")
# the same as a state machine: one row a run and event, in order
define("ma", """
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY t, side, seq) AS pos FROM (
    SELECT * FROM ev UNION ALL
    SELECT run_id, t, 2, seq, NULL, NULL, NULL, NULL, NULL, t_start FROM ev WHERE side = 1 AND run_id % 3 = 0 AND seq % 4 = 1)""", "ev")
define("ms", f"""
  SELECT run_id, 0::BIGINT AS pos, NULL::DOUBLE AS t, NULL::INTEGER AS side, NULL::BIGINT AS seq, NULL::VARCHAR AS named, NULL::VARCHAR AS outcome, NULL::VARCHAR AS finding,
    min(t_start) AS heard, NULL::VARCHAR AS oid, NULL::DOUBLE AS oend, NULL::BIGINT AS lastseq, NULL::VARCHAR AS fault, false AS acked, NULL::INTEGER AS cs, NULL::BIGINT AS cq
  FROM ma GROUP BY run_id
  UNION ALL
  SELECT run_id, pos, t, side, seq,
    CASE WHEN side = 0 THEN declaration_id WHEN side = 1 AND fault IS NULL AND (f IS NULL OR f = 'stale_declaration') THEN oid END,
    CASE WHEN side = 2 THEN CASE WHEN fault IS NULL OR acked THEN 'REFUSED' ELSE 'ACKNOWLEDGED' END
      WHEN side = 0 THEN CASE WHEN f IS NULL THEN NULL WHEN f = 'escalation_failure' THEN 'SAFE_STATE' ELSE 'VETO' END
      WHEN fault IS NOT NULL OR f = 'watchdog_expiry' THEN 'SAFE_STATE' WHEN f IS NULL THEN 'PERMIT' ELSE 'VETO' END,
    CASE WHEN side = 2 THEN CASE WHEN fault IS NULL THEN 'nothing_to_acknowledge' WHEN acked THEN 'already_acknowledged' ELSE fault END
      WHEN side = 1 AND fault IS NOT NULL THEN fault ELSE f END,
    CASE WHEN side = 0 THEN greatest(heard, t) ELSE heard END,
    CASE WHEN f IS NOT NULL THEN NULL WHEN taken THEN declaration_id ELSE oid END, CASE WHEN taken THEN t + horizon ELSE oend END,
    CASE WHEN taken THEN claimed ELSE lastseq END, CASE WHEN f IS NOT NULL THEN f WHEN taken THEN NULL ELSE fault END,
    CASE WHEN f IS NOT NULL OR taken THEN false WHEN side = 2 THEN fault IS NOT NULL ELSE acked END,
    CASE WHEN f IS NOT NULL THEN side ELSE cs END, CASE WHEN f IS NOT NULL THEN seq ELSE cq END
  FROM (SELECT *, side = 0 AND f IS NULL AND (fault IS NULL OR acked) AS taken FROM (
    SELECT e.run_id, e.pos, e.t, e.side, e.seq, e.declaration_id, e.claimed, e.horizon, m.heard, m.oid, m.oend, m.lastseq, m.fault, m.acked, m.cs, m.cq,
      CASE WHEN e.side = 0 THEN CASE WHEN offer_fault IN ('unattributed', 'out_of_vocabulary_action') THEN offer_fault WHEN claimed <= lastseq THEN 'replay_or_reorder' WHEN offer_fault IS NOT NULL THEN offer_fault
          WHEN m.fault IS NOT NULL AND NOT m.acked AND action_class <> 'escalate' THEN 'escalation_failure' END
        WHEN e.side = 1 AND m.fault IS NULL THEN CASE WHEN e.t - m.heard > 400 THEN 'watchdog_expiry' WHEN m.oid IS NULL THEN 'no_declaration' WHEN e.t > m.oend THEN 'stale_declaration' END END AS f
    FROM ms m JOIN ma e ON e.run_id = m.run_id AND e.pos = m.pos + 1))""", "ma")
define("ma_out", """
  SELECT run_id, t, side, seq, named AS declaration_id, outcome, finding AS fault FROM ms WHERE side < 2 AND outcome IS NOT NULL""", "ms")
SQL["adjudicate"] = build(CLAMPED.format(src="ma_out"), "ma_out", "act_out", "decl")
SQL["acknowledge"] = build("""
  SELECT run_id, t, seq, outcome, finding AS fault, CASE WHEN outcome = 'ACKNOWLEDGED' THEN cs END AS cause_side, CASE WHEN outcome = 'ACKNOWLEDGED' THEN cq END AS cause_seq
  FROM ms WHERE side = 2""", "ms")
