"""DuckDB statements for the scene queries."""

from oracle.ctes import build, define

SQL: dict[str, str] = {}

define("sedges", """
  SELECT * FROM edges WHERE NOT (run_id % 5 = 0 OR run_id % 7 = 0)
    AND NOT (run_id % 11 = 0 AND type = 'SEPARATION' AND entity_id = 'obs_a' AND frame_first % 7 = 0)""", "edges")
define("asks", """
  SELECT run_id, e AS entity_id, e <> 'nobody' AS declared
  FROM ru, (VALUES ('human'), ('obs_a'), ('spare'), ('nobody')) v(e)""", "ru")
define("trans", """
  SELECT p.run_id, type, entity_id, 'began' AS change, frame_first AS frame_idx, t_first AS t FROM pres p
  UNION ALL
  SELECT p.run_id, type, entity_id, 'ceased', frame_last, p.t_last FROM pres p JOIN ru USING (run_id)
  WHERE frame_last < frame_count - 1""", "pres", "ru")
define("kept", """
  SELECT run_id, 0::BIGINT AS frame_idx FROM ru UNION SELECT run_id, frame_count - 1 FROM ru
  UNION SELECT run_id, frame_first FROM pres WHERE type IN ('INTERSECTS', 'CONTACT')
  UNION SELECT run_id, frame_last FROM pres WHERE type IN ('INTERSECTS', 'CONTACT')
  UNION SELECT run_id, frame_first FROM edges WHERE type = 'INTERSECTS'""", "ru", "pres", "edges")
define("envs", """
  SELECT run_id, region_id, max(frame_idx) AS frame_last, max(t) AS t_end,
         min(frame_idx) FILTER (WHERE kept) AS frame_first, min(t) FILTER (WHERE kept) AS t_start
  FROM (SELECT f.*, k.frame_idx IS NOT NULL AS kept,
               f.frame_idx - row_number() OVER (PARTITION BY f.run_id, region_id ORDER BY f.frame_idx) AS g
        FROM (SELECT run_id, frame_idx, t, sha256(floor(value / 200.0)::BIGINT::VARCHAR) AS region_id FROM fr) f
        LEFT JOIN kept k ON k.run_id = f.run_id AND k.frame_idx = f.frame_idx)
  GROUP BY run_id, region_id, g HAVING count(*) FILTER (WHERE kept) > 0""", "fr", "kept")
define("log", """
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY phase, f, sub, entity_id NULLS FIRST, type) - 1 AS seq FROM (
    SELECT run_id, 0 AS phase, 0 AS f, 0 AS sub, 'run_began' AS type, 'A' AS layer, NULL AS entity_id, t_first AS t, NULL::BIGINT AS value_cm FROM ru
    UNION ALL
    SELECT run_id, 1, CASE change WHEN 'ceased' THEN frame_idx + 1 ELSE frame_idx END, CASE change WHEN 'ceased' THEN 0 ELSE 1 END,
      CASE type || change WHEN 'INTERSECTSbegan' THEN 'envelope_entered' WHEN 'INTERSECTSceased' THEN 'envelope_left'
        WHEN 'CONTACTbegan' THEN 'contact_began' ELSE 'contact_ended' END, 'B', entity_id, t, NULL
    FROM trans WHERE type IN ('INTERSECTS', 'CONTACT')
    UNION ALL
    SELECT c.run_id, 3, 0, 0, 'closest_approach', 'B', entity_id, c.frame_idx * 0.02::DOUBLE, bucket FROM closest c
    UNION ALL
    SELECT run_id, 4, 0, 0, 'run_ended', 'A', NULL, t_last, NULL FROM ru)""", "ru", "trans", "closest")
define("olog", """
  SELECT run_id, seq, type, layer, entity_id, round_even(t / 1.0::DOUBLE, 0) * 1.0::DOUBLE AS t, value_cm FROM log""", "log")

SQL["coalesce_intervals"] = build("""
  SELECT run_id, type, entity_id, frame_first, frame_last, t_start, t_end, overlap_area,
         round_even(min_distance / 0.2::DOUBLE, 0)::BIGINT AS distance_bucket FROM edges""", "edges")
MERGE = """
  SELECT *, sum(op) OVER (PARTITION BY run_id, entity_id ORDER BY t_start, frame_first) AS grp FROM (
    SELECT *, CASE WHEN t_start - lag(t_end) OVER (PARTITION BY run_id, entity_id ORDER BY t_start, frame_first)
        <= 0.02::DOUBLE * 1.5::DOUBLE THEN 0 ELSE 1 END AS op FROM {src})"""
SPAN = """
  min(t_start) AS t_start, arg_max(t_end, frame_first) AS t_end,
  (round_even((arg_max(t_end, frame_first) - min(t_start)) / 0.02::DOUBLE, 0) + 1)::BIGINT AS frames"""
SQL["merge_adjacent"] = build(f"""
  SELECT run_id, entity_id, {SPAN}, count(*) AS intervals,
         round_even(min(min_distance) / 0.2::DOUBLE, 0)::BIGINT AS distance_bucket
  FROM ({MERGE.format(src="(SELECT * FROM edges WHERE type = 'SEPARATION' AND min_distance <= 1.0)")})
  GROUP BY run_id, entity_id, grp""", "edges")
SQL["relationship_transitions"] = build("SELECT * FROM trans", "trans")
SQL["retained_frames"] = build("SELECT * FROM kept", "kept")
SQL["region_timeline"] = build(
    "SELECT run_id, region_id, frame_first, frame_last, t_start, t_end FROM envs", "envs")
SQL["region_at"] = build("""
  SELECT a.run_id, a.t, count(e.region_id) AS matches,
         CASE WHEN count(e.region_id) = 1 THEN 'ANSWERED' ELSE 'COULD-NOT-EVALUATE' END AS verdict,
         CASE WHEN count(e.region_id) = 1 THEN max(e.region_id) END AS region_id
  FROM (SELECT run_id, t::DOUBLE AS t FROM ru, (VALUES (0.1), (0.3), (9.0)) v(t)) a
  LEFT JOIN envs e ON e.run_id = a.run_id AND a.t BETWEEN e.t_start AND e.t_end
  GROUP BY 1, 2""", "ru", "envs")
SQL["expand_to_frames"] = build("""
  SELECT f.run_id, f.frame_idx, type, entity_id, frame_first, overlap_area,
         round_even(min_distance / 0.2::DOUBLE, 0)::BIGINT AS distance_bucket
  FROM fr f JOIN edges e ON e.run_id = f.run_id AND f.t BETWEEN e.t_start AND e.t_end""", "fr", "edges")
SQL["silent_filter"] = build(
    "SELECT run_id, frame_idx, t, event_type FROM fr WHERE event_type <> 'signup'", "fr")
SQL["unknown_entity"] = build("""
  SELECT run_id, entity_id, CASE WHEN declared THEN 'ANSWERED' ELSE 'QUERY-ERROR' END AS verdict,
    CASE WHEN NOT declared THEN 'entity ''' || entity_id || ''' is not declared in this run; it declares human, obs_a, spare' END AS message FROM asks""", "asks")
SQL["available_layers"] = build("""
  SELECT run_id, run_id IN (SELECT run_id FROM sedges) AS edge_layer,
         (run_id % 5 = 0 AND run_id % 7 <> 0) AS occurrence_layer FROM ru""", "sedges", "ru")
WINDOW = """CASE WHEN t1 < t0 THEN 'QUERY-ERROR' WHEN t0 < t_first - 0.01::DOUBLE OR t1 > t_last + 0.01::DOUBLE
  THEN 'QUERY-ERROR' ELSE 'ANSWERED' END"""
WHY = """CASE WHEN t1 < t0 THEN 'window runs backwards' WHEN t0 < t_first - 0.01::DOUBLE OR t1 > t_last + 0.01::DOUBLE
  THEN 'window is not inside the run' ELSE 'answered' END"""
SQL["window_check"] = build(f"""
  SELECT run_id, t0, t1, {WINDOW} AS verdict, {WHY} AS reason FROM (
    SELECT *, 0.0::DOUBLE AS t0, 0.5::DOUBLE AS t1 FROM ru UNION ALL SELECT *, 0.5, 0.2 FROM ru
    UNION ALL SELECT *, 0.0, 1.3 FROM ru UNION ALL SELECT *, -0.005, t_last FROM ru)""", "ru")

define("lay", """
  SELECT run_id, NOT (run_id % 5 = 0 OR run_id % 7 = 0) AS el, (run_id % 5 = 0 AND run_id % 7 <> 0) AS ol FROM ru""", "ru")
define("samples", """
  SELECT f.run_id, a.entity_id, f.frame_idx, f.t,
         arg_min(e.min_distance, e.frame_first) AS distance
  FROM fr f JOIN asks a ON a.run_id = f.run_id
  LEFT JOIN sedges e ON e.run_id = f.run_id AND e.entity_id = a.entity_id AND e.type = 'SEPARATION'
    AND f.t BETWEEN e.t_start AND e.t_end
  GROUP BY 1, 2, 3, 4""", "fr", "asks", "sedges")
define("tl", """
  SELECT a.run_id, a.entity_id,
    CASE WHEN NOT declared THEN 'entity is not declared in this run' WHEN NOT el THEN 'no edge layer'
         WHEN NOT EXISTS (SELECT 1 FROM sedges s WHERE s.run_id = a.run_id AND s.entity_id = a.entity_id AND s.type = 'SEPARATION')
           THEN 'no SEPARATION interval'
         WHEN EXISTS (SELECT 1 FROM samples s WHERE s.run_id = a.run_id AND s.entity_id = a.entity_id AND s.distance IS NULL)
           THEN 'intervals do not cover every frame' ELSE 'answered' END AS reason
  FROM asks a JOIN lay USING (run_id)""", "asks", "lay", "sedges", "samples")
VERDICT = """CASE reason WHEN 'answered' THEN 'ANSWERED' WHEN 'entity is not declared in this run'
  THEN 'QUERY-ERROR' ELSE 'COULD-NOT-EVALUATE' END"""
SQL["separation_timeline"] = build(f"""
  SELECT tl.run_id, tl.entity_id, {VERDICT} AS verdict, reason, s.frame_idx, s.t,
         round_even(s.distance / 0.2::DOUBLE, 0)::BIGINT AS distance_bucket
  FROM tl LEFT JOIN samples s ON s.run_id = tl.run_id AND s.entity_id = tl.entity_id AND reason = 'answered'""",
  "tl", "samples")
define("visits", f"""
  SELECT run_id, entity_id, {SPAN}, max(overlap_area) AS max_overlap_area
  FROM ({MERGE.format(src="(SELECT * FROM sedges WHERE type = 'INTERSECTS')")}) GROUP BY run_id, entity_id, grp""", "sedges")
SQL["first_envelope_intersection"] = build(f"""
  SELECT b.run_id, b.entity_id, {VERDICT} AS verdict, reason, t_first, coalesce(visits, 0) AS visits,
         v.t_start, v.t_end, v.frames, v.max_overlap_area
  FROM (SELECT a.run_id, a.entity_id, m.t_first, m.visits,
          CASE WHEN NOT declared THEN 'entity is not declared in this run' WHEN NOT el THEN 'no edge layer'
               WHEN NOT EXISTS (SELECT 1 FROM sedges s WHERE s.run_id = a.run_id AND s.entity_id = a.entity_id)
               THEN 'no relationship with this entity' ELSE 'answered' END AS reason
        FROM asks a JOIN lay USING (run_id) LEFT JOIN
          (SELECT run_id, entity_id, min(t_start) AS t_first, count(*) AS visits FROM visits GROUP BY 1, 2) m
          ON m.run_id = a.run_id AND m.entity_id = a.entity_id) b
  LEFT JOIN visits v ON v.run_id = b.run_id AND v.entity_id = b.entity_id AND reason = 'answered'""",
  "asks", "lay", "sedges", "visits")
define("risk", f"""
  SELECT run_id, entity_id, {SPAN}, count(*) AS intervals,
         round_even(min(min_distance) / 0.2::DOUBLE, 0)::BIGINT AS min_bucket
  FROM ({MERGE.format(src="(SELECT * FROM sedges WHERE type = 'SEPARATION' AND min_distance <= 1.0)")})
  GROUP BY run_id, entity_id, grp""", "sedges")
SQL["risk_spans"] = build("SELECT * FROM risk", "risk")
SQL["frames_at_risk"] = build(f"""
  SELECT run_id, entity_id, {VERDICT} AS verdict, reason,
     CASE WHEN reason = 'answered' THEN coalesce(f, 0) END AS frames, CASE WHEN reason = 'answered' THEN coalesce(s, 0) END AS spans,
     CASE WHEN reason = 'answered' THEN coalesce(b, 0) END AS breached, n AS intervals, min_bucket
  FROM (SELECT a.run_id, a.entity_id, f, s, b, n, min_bucket,
          CASE WHEN NOT declared THEN 'entity is not declared in this run' WHEN NOT el THEN 'no edge layer'
               WHEN n IS NULL THEN 'no SEPARATION interval' ELSE 'answered' END AS reason
        FROM asks a JOIN lay USING (run_id)
        LEFT JOIN (SELECT run_id, entity_id, count(*) AS n FROM sedges WHERE type = 'SEPARATION' GROUP BY 1, 2) c USING (run_id, entity_id)
        LEFT JOIN (SELECT run_id, entity_id, sum(frames)::BIGINT AS f, count(*) AS s, sum(intervals)::BIGINT AS b, min(min_bucket) AS min_bucket
                   FROM risk GROUP BY 1, 2) r USING (run_id, entity_id))""", "asks", "lay", "sedges", "risk")
define("reach", """
  SELECT run_id, t0, t1, CASE WHEN r = 'answered' AND NOT el THEN 'no edge layer' ELSE r END AS reason FROM (
    SELECT w.*, el, CASE WHEN t1 > t_last + 0.01::DOUBLE THEN 'window is not inside the run' ELSE 'answered' END AS r
    FROM (SELECT *, 0.1::DOUBLE AS t0, 0.6::DOUBLE AS t1 FROM ru) w JOIN lay USING (run_id))""", "ru", "lay")
define("inside", """
  SELECT DISTINCT s.run_id, entity_id FROM sedges s JOIN reach r ON r.run_id = s.run_id AND reason = 'answered'
  WHERE type = 'INTERSECTS' AND t_start <= round_even(0.6 / 0.01::DOUBLE, 0) * 0.01::DOUBLE
    AND t_end >= round_even(0.1 / 0.01::DOUBLE, 0) * 0.01::DOUBLE""", "sedges", "reach")
SQL["reachable_entities"] = build("""
  SELECT r.run_id, r.t0, r.t1, CASE reason WHEN 'answered' THEN 'ANSWERED' WHEN 'no edge layer' THEN 'COULD-NOT-EVALUATE'
      ELSE 'QUERY-ERROR' END AS verdict, reason,
    CASE WHEN reason = 'answered' THEN (SELECT count(*) FROM inside i WHERE i.run_id = r.run_id) END AS inside,
    3::BIGINT AS declared, i.entity_id
  FROM reach r LEFT JOIN inside i ON i.run_id = r.run_id""", "reach", "inside")
SQL["reachable_set_equal"] = build("""
  SELECT r.run_id, count(*) FILTER (WHERE t.entity_id IS NOT NULL AND i.entity_id IS NULL) AS missing,
         count(*) FILTER (WHERE i.entity_id IS NOT NULL AND t.entity_id IS NULL) AS invented,
         count(*) FILTER (WHERE (i.entity_id IS NULL) <> (t.entity_id IS NULL)) = 0 AS equal
  FROM reach r LEFT JOIN (VALUES ('human'), ('obs_a')) e(e) ON true
  LEFT JOIN inside i ON i.run_id = r.run_id AND i.entity_id = e
  LEFT JOIN (SELECT DISTINCT run_id, entity_id FROM dist WHERE d < 0.5 AND t BETWEEN 0.095 AND 0.605) t
    ON t.run_id = r.run_id AND t.entity_id = e
  WHERE reason = 'answered' GROUP BY 1""", "reach", "inside", "dist")
define("close", """
  SELECT a.run_id, a.entity_id, declared, el, ol, e.d AS ed, e.ts AS et, e.n AS en, o.value_cm AS ov, o.t AS ot,
    CASE WHEN el THEN 'edge' WHEN ol THEN 'occurrence' END AS layer0
  FROM asks a JOIN lay USING (run_id)
  LEFT JOIN (SELECT run_id, entity_id, min(min_distance) AS d, arg_min(t_start, struct_pack(m := min_distance, t := t_start)) AS ts, count(*) AS n
             FROM sedges WHERE type = 'SEPARATION' GROUP BY 1, 2) e USING (run_id, entity_id)
  LEFT JOIN (SELECT run_id, entity_id, value_cm, t FROM olog WHERE type = 'closest_approach' AND run_id % 5 = 0 AND run_id % 7 <> 0) o
    USING (run_id, entity_id)""", "asks", "lay", "sedges", "olog")
define("close2", """
  SELECT *, CASE WHEN reason = 'answered' THEN layer0 END AS layer FROM (
    SELECT *, CASE WHEN NOT declared THEN 'entity is not declared in this run' WHEN layer0 IS NULL THEN 'no layer at all'
      WHEN layer0 = 'edge' AND en IS NULL THEN 'no SEPARATION interval'
      WHEN layer0 = 'occurrence' AND ov IS NULL THEN 'no closest_approach occurrence' ELSE 'answered' END AS reason FROM close)""", "close")
SQL["min_separation"] = build(f"""
  SELECT run_id, entity_id, {VERDICT} AS verdict, reason, layer,
    CASE layer WHEN 'edge' THEN round_even(ed * 100, 0)::BIGINT WHEN 'occurrence' THEN ov END AS value_cm,
    CASE WHEN layer IS NOT NULL THEN 0.01::DOUBLE END AS distance_tol_m FROM close2""", "close2")
SQL["time_of_closest_approach"] = build(f"""
  SELECT run_id, entity_id, {VERDICT} AS verdict, reason, layer,
    CASE layer WHEN 'edge' THEN et WHEN 'occurrence' THEN ot END AS value,
    CASE layer WHEN 'edge' THEN 0.01::DOUBLE WHEN 'occurrence' THEN 1.0::DOUBLE END AS time_tol_s FROM close2""", "close2")
SQL["did_contact_occur"] = build(f"""
  SELECT run_id, entity_id, {VERDICT} AS verdict, reason, CASE WHEN reason = 'answered' THEN layer0 END AS layer,
    CASE WHEN reason = 'answered' THEN (CASE WHEN el THEN c > 0 ELSE coalesce(b, 0) > 0 END) END AS value
  FROM (SELECT a.run_id, a.entity_id, el, c, b, CASE WHEN el THEN 'edge' WHEN ol THEN 'occurrence' END AS layer0,
      CASE WHEN NOT declared THEN 'entity is not declared in this run' WHEN NOT el AND NOT ol THEN 'no layer at all'
        WHEN el AND n IS NULL THEN 'no relationship with this entity'
        WHEN ol AND run_id % 3 = 0 THEN 'no occurrence retention rule' ELSE 'answered' END AS reason
    FROM asks a JOIN lay USING (run_id)
    LEFT JOIN (SELECT run_id, entity_id, count(*) AS n, count(*) FILTER (WHERE type = 'CONTACT') AS c FROM sedges GROUP BY 1, 2) e USING (run_id, entity_id)
    LEFT JOIN (SELECT run_id, entity_id, count(*) AS b FROM olog WHERE type = 'contact_began' GROUP BY 1, 2) o USING (run_id, entity_id))""",
  "asks", "lay", "sedges", "olog")
SQL["closest_approach"] = build(
    "SELECT run_id, entity_id, frame_idx, bucket, frame_idx * 0.02::DOUBLE AS t FROM closest", "closest")
SQL["occurrence_log"] = build("SELECT * FROM olog", "olog")
SQL["time_base"] = build("""
  SELECT run_id, count(*) AS frames, count(DISTINCT b) AS instants, count(*) = count(DISTINCT b) AS resolves_frames
  FROM (SELECT run_id, round_even((CASE WHEN run_id % 2 = 0 THEN t ELSE frame_idx * 0.004::DOUBLE END) / 0.01::DOUBLE, 0) AS b FROM fr)
  GROUP BY 1""", "fr")
SQL["frame_period_check"] = build("""
  SELECT run_id, frames, CASE WHEN frames < 2 THEN 'too few frames' WHEN period <= 0 THEN 'time does not advance'
      WHEN greatest(hi - period, period - lo) > 0.01 THEN 'period is not uniform' ELSE 'uniform' END AS finding,
    round_even(period * 1e6, 0)::BIGINT AS period_us, round_even(greatest(hi - period, period - lo) * 1e6, 0)::BIGINT AS worst_us
  FROM (SELECT run_id, count(*) AS frames, min(gap) AS lo, max(gap) AS hi, arg_min(gap, frame_idx) FILTER (WHERE gap IS NOT NULL) AS period
    FROM (SELECT run_id, frame_idx, t - lag(t) OVER (PARTITION BY run_id ORDER BY frame_idx) AS gap FROM
      (SELECT run_id, frame_idx, t + CASE WHEN run_id % 9 = 0 AND frame_idx >= 20 THEN 0.013::DOUBLE ELSE 0.0::DOUBLE END AS t FROM fr))
    GROUP BY 1)""", "fr")
SQL["entity_set_check"] = build("""
  SELECT run_id, 'crate' AS entity_id, CASE WHEN run_id % 10 = 0 AND frame_count > 30 THEN 'attributes changed' ELSE 'static' END AS finding FROM ru
  UNION ALL
  SELECT run_id, CASE WHEN run_id % 14 = 0 THEN 'human' ELSE 'pallet' END,
    CASE WHEN run_id % 14 = 0 THEN 'reserved id is taken' ELSE 'static' END FROM ru""", "ru")
TYPES = "(VALUES ('HAS_ENVELOPE'), ('INTERSECTS'), ('SEPARATION'), ('CONTACT'), ('DECLARED'), ('ADJUDICATED'), ('ENFORCED'), ('FOLLOWS')) t(type)"
SQL["edge_counts"] = build(f"""
  SELECT ru.run_id, t.type, count(e.type) AS edges FROM ru CROSS JOIN {TYPES}
  LEFT JOIN edges e ON e.run_id = ru.run_id AND e.type = t.type GROUP BY 1, 2""", "ru", "edges")
SQL["edge_scan"] = build("""
  SELECT run_id, type, entity_id, t_start, t_end, frame_first, overlap_area FROM edges
  WHERE type = 'INTERSECTS' AND entity_id = 'human'""", "edges")
SQL["occurrence_scan"] = build("""
  SELECT run_id, seq, type, entity_id, t FROM olog WHERE type = 'contact_began' AND entity_id = 'obs_a'""", "olog")
SQL["interpolate_knots"] = build("""
  SELECT run_id, frame_idx, round_even((va + sl * (t - ta)) * 1000, 0)::BIGINT AS value_milli, round_even(sl * 10, 0)::BIGINT AS slope_deci
  FROM (SELECT f.run_id, f.frame_idx, f.t, s.ta, s.va, (s.vb - s.va) / (s.tb - s.ta) AS sl
    FROM fr f LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ta) AS n,
                          count(*) OVER (PARTITION BY run_id) AS total FROM
        (SELECT run_id, t AS ta, (event_id % 500)::DOUBLE AS va, lead(t) OVER w AS tb, lead((event_id % 500)::DOUBLE) OVER w AS vb
         FROM fr WHERE frame_idx % 4 = 0 AND frame_idx > 0 WINDOW w AS (PARTITION BY run_id ORDER BY frame_idx)) WHERE tb IS NOT NULL) s
    ON s.run_id = f.run_id AND (f.t >= s.ta OR n = 1) AND (f.t < s.tb OR n = total))""", "fr")
SQL["run_meta_pivot"] = """
  SELECT user_id AS run_id, arg_min(props::JSON ->> 'k', struct_pack(a := ts, b := event_id)) AS k_first,
    arg_max(props::JSON ->> 'k', struct_pack(a := ts, b := event_id)) AS k_last, count(*)::VARCHAR AS frames
  FROM events GROUP BY 1"""
SQL["scalar_quantization"] = """
  SELECT event_id, round_even((value / 1000.0::DOUBLE) / 0.01::DOUBLE, 0)::BIGINT AS distance_bucket,
    round_even(event_id * 0.005::DOUBLE / 0.01::DOUBLE, 0)::BIGINT AS time_bucket,
    round_even(value * pow(10.0, 1 - floor(log10(value))), 0) / pow(10.0, 1 - floor(log10(value))) AS area,
    (round_even(value * 50.0::DOUBLE, 0) + 1)::BIGINT AS frames_at_50hz,
    CASE WHEN event_id > 0 THEN round_even(event_id * 2.5::DOUBLE, 0)::BIGINT END AS sensor_bytes,
    CASE WHEN event_id % 3 = 0 THEN 'COULD-NOT-EVALUATE'
         WHEN abs(value - (value + 0.01::DOUBLE * (event_id % 4))) <= 0.015 THEN 'AGREE' ELSE 'DISAGREE' END AS agreement
  FROM events"""
