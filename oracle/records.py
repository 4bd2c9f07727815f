"""DuckDB statements for the record queries."""

from oracle.ctes import build, define

SQL: dict[str, str] = {}

define("recs", """
  SELECT run_id, 'Declaration' AS kind, declaration_id AS record_id, seq, t_issued AS t FROM decl
  UNION ALL SELECT run_id, 'Verdict', verdict_id, seq, t FROM verd""", "decl", "verd")
define("foll", """
  SELECT run_id, kind, record_id AS src_id, p AS dst_id, least(t, pt) AS t_start, greatest(t, pt) AS t_end
  FROM (SELECT *, lag(record_id) OVER w AS p, lag(t) OVER w AS pt, FROM recs
        WINDOW w AS (PARTITION BY run_id, kind ORDER BY seq)) WHERE p IS NOT NULL""", "recs")
define("att", """
  SELECT run_id, 'DECLARED' AS type, declaration_id AS src_id,
    'env_' || substr(sha256('declared' || chr(0) || declaration_id), 1, 16) AS dst_id, t_issued AS t_start, t_issued + horizon AS t_end FROM decl
  UNION ALL SELECT run_id, 'ADJUDICATED', verdict_id, declaration_id, t, t FROM verd WHERE declaration_id IS NOT NULL
  UNION ALL SELECT run_id, 'ENFORCED', verdict_id, 'env_' || substr(sha256('clamped' || chr(0) || verdict_id), 1, 16), t, t FROM verd WHERE outcome = 'CLAMP'
  UNION ALL SELECT run_id, 'FOLLOWS', src_id, dst_id, t_start, t_end FROM foll""", "decl", "verd", "foll")
PASSIVATING = """('no_declaration', 'stale_declaration', 'envelope_overclaim', 'out_of_vocabulary_action', 'unattributed',
  'replay_or_reorder', 'watchdog_expiry', 'escalation_failure')"""
define("pas", f"""
  SELECT *, coalesce(lag(aft) OVER (PARTITION BY run_id ORDER BY seq), false) AS bef FROM (
    SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY seq), false) AS aft FROM (
      SELECT *, CASE WHEN fault IN {PASSIVATING} THEN true WHEN outcome IN ('PERMIT', 'CLAMP') THEN false END AS mark FROM verd))""", "verd")
define("evs", """
  SELECT run_id, verdict_id, seq, t, 0 AS ordinal, 'reintegrated' AS type FROM pas WHERE bef AND outcome IN ('PERMIT', 'CLAMP')
  UNION ALL SELECT * FROM (SELECT run_id, verdict_id, seq, t, 1,
    CASE WHEN outcome = 'SAFE_STATE' AND fault = 'escalation_failure' THEN 'escalation_failed'
         WHEN outcome = 'SAFE_STATE' AND NOT bef THEN 'safe_state_entered' WHEN outcome = 'VETO' THEN 'declaration_vetoed'
         WHEN outcome = 'CLAMP' THEN 'action_clamped' END AS type FROM pas) WHERE type IS NOT NULL""", "pas")
define("probes", """
  SELECT n.run_id, n.n AS declarations, d.t_issued AS t_probe, coalesce(r.id, n.d0) AS probe_declaration_id
  FROM (SELECT run_id, count(*) AS n, arg_min(declaration_id, seq) AS d0 FROM decl GROUP BY 1) n
  JOIN decl d ON d.run_id = n.run_id AND d.seq = n.n // 2
  LEFT JOIN (SELECT run_id, arg_min(declaration_id, seq) AS id FROM verd WHERE outcome <> 'PERMIT' AND declaration_id IS NOT NULL GROUP BY 1) r
    ON r.run_id = n.run_id""", "decl", "verd")

SQL["record_scan"] = build("SELECT run_id, kind, record_id, seq, t FROM recs", "recs")
SQL["record_gate"] = build("SELECT * FROM gate", "gate")
SQL["declaration_rows"] = build("SELECT * FROM drows", "drows")
SQL["verdict_rows"] = build("SELECT * FROM vrows", "vrows")
define("bound", """
  SELECT b.run_id, b.t, CASE WHEN refusal IS NOT NULL THEN refusal WHEN n IS NULL THEN 'no declaration in the record'
      WHEN k IS NULL THEN 'nothing in force at t' WHEN miss > 0 THEN 'a declaration in force lost its region' ELSE 'answered' END AS reason,
    coalesce(k, 0) AS in_force, coalesce(n, 0) AS declarations, t0, t1
  FROM (SELECT run_id, t_probe AS t FROM probes UNION ALL SELECT run_id, 100.0 FROM rr) b
  LEFT JOIN gate USING (run_id) LEFT JOIN (SELECT run_id, count(*) AS n FROM decl GROUP BY 1) c USING (run_id)
  LEFT JOIN (SELECT p.run_id, p.t, count(*) AS k, count(*) FILTER (WHERE region_id IS NULL) AS miss, min(t_issued) AS t0, max(t_issued + horizon) AS t1
             FROM (SELECT run_id, t_probe AS t FROM probes UNION ALL SELECT run_id, 100.0 FROM rr) p
             JOIN drows d ON d.run_id = p.run_id AND p.t BETWEEN t_issued AND t_issued + horizon GROUP BY 1, 2) x
    ON x.run_id = b.run_id AND x.t = b.t""", "probes", "rr", "gate", "drows", "decl")
RV = "CASE WHEN reason = 'answered' THEN 'ANSWERED' ELSE 'COULD-NOT-EVALUATE' END"
SQL["declared_bound"] = build(f"""
  SELECT b.run_id, b.t, {RV} AS verdict, reason, in_force, declarations, t0, t1, declaration_id, seq, t_issued, horizon,
    action_class, region_id, area, t_issued + horizon AS t_expires
  FROM bound b LEFT JOIN drows d ON d.run_id = b.run_id AND reason = 'answered' AND b.t BETWEEN t_issued AND t_issued + horizon""",
  "bound", "drows")
SQL["violations"] = build(f"""
  SELECT run_id, 1000.0::DOUBLE AS t0, 2000.0::DOUBLE AS t1, {RV} AS verdict, reason,
    CASE WHEN reason = 'answered' THEN coalesce(n, 0) END AS adjudications, CASE WHEN reason = 'answered' THEN coalesce(r, 0) END AS refused,
    CASE WHEN reason = 'answered' THEN coalesce(f, '') END AS faults, CASE WHEN reason = 'answered' THEN v END AS first_verdict_id
  FROM (SELECT rr.run_id, coalesce(refusal, 'answered') AS reason, n, r, f, v FROM rr JOIN gate USING (run_id) LEFT JOIN
    (SELECT run_id, count(*) AS n, count(*) FILTER (WHERE outcome <> 'PERMIT') AS r,
       string_agg(DISTINCT fault, ',' ORDER BY fault) FILTER (WHERE outcome <> 'PERMIT') AS f,
       arg_min(verdict_id, seq) FILTER (WHERE outcome <> 'PERMIT') AS v FROM verd WHERE t BETWEEN 1000 AND 2000 GROUP BY 1) x USING (run_id))""",
  "rr", "gate", "verd")
SQL["violation_actions"] = build("""
  SELECT *, 1000.0::DOUBLE AS t0, 2000.0::DOUBLE AS t1 FROM vrows WHERE t BETWEEN 1000 AND 2000 AND outcome <> 'PERMIT'""", "vrows")
SQL["verdicts"] = build("""
  SELECT b.run_id, b.declaration_id, verdict, reason, (SELECT count(*) FROM vrows x WHERE x.run_id = b.run_id AND x.declaration_id = b.declaration_id) AS adjudications,
    v.verdict_id, v.seq, v.t, v.outcome, v.fault, v.region_id, v.area
  FROM (SELECT a.*, CASE WHEN refusal IS NOT NULL THEN 'COULD-NOT-EVALUATE' WHEN a.declaration_id = 'd-none' THEN 'QUERY-ERROR' ELSE 'ANSWERED' END AS verdict,
          CASE WHEN refusal IS NOT NULL THEN refusal WHEN a.declaration_id = 'd-none' THEN 'no such declaration in this run' ELSE 'answered' END AS reason
        FROM (SELECT run_id, probe_declaration_id AS declaration_id FROM probes UNION ALL SELECT run_id, 'd-none' FROM rr) a JOIN gate USING (run_id)) b
  LEFT JOIN vrows v ON v.run_id = b.run_id AND v.declaration_id = b.declaration_id AND verdict = 'ANSWERED'""",
  "probes", "rr", "gate", "vrows")
SQL["outcome_matrix"] = build("""
  SELECT run_id, declaration_id, outcome, count(*) AS n FROM verd WHERE declaration_id IS NOT NULL GROUP BY 1, 2, 3""", "verd")
SQL["first_refusal"] = build("""
  SELECT run_id, t, seq, verdict_id, outcome, fault FROM verd WHERE outcome <> 'PERMIT'
  QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY t, seq) = 1""", "verd")
SQL["asof_declaration"] = build("""
  SELECT v.run_id, v.verdict_id, v.t, d.declaration_id, v.t <= d.t_issued + d.horizon AS in_force
  FROM verd v LEFT JOIN decl d ON d.run_id = v.run_id AND d.t_issued <= v.t
  QUALIFY row_number() OVER (PARTITION BY v.run_id, v.verdict_id ORDER BY d.t_issued DESC, d.seq DESC) = 1""", "verd", "decl")
SQL["watchdog_gaps"] = build("""
  SELECT run_id, verdict_id, t, h AS last_heard, t - h > 90.0 AS expired FROM (
    SELECT v.run_id, v.verdict_id, v.t, greatest(coalesce(max(d.t_issued), 0.0), 0.0) AS h
    FROM verd v LEFT JOIN decl d ON d.run_id = v.run_id AND d.t_issued <= v.t GROUP BY 1, 2, 3)""", "verd", "decl")
SQL["replay_flags"] = build("""
  SELECT run_id, declaration_id, seq, order_key AS claimed, m AS max_seq_before, coalesce(order_key <= m, false) AS replayed FROM (
    SELECT *, max(order_key) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM decl)""", "decl")
SQL["passivation_spans"] = build(f"""
  SELECT run_id, min(seq) AS seq_first, max(seq) AS seq_last, arg_min(t, seq) AS t_first, arg_max(t, seq) AS t_last,
    arg_max(sticky, seq) AS last_fault, count(*) AS verdicts
  FROM (SELECT *, last_value(CASE WHEN fault IN {PASSIVATING} THEN fault END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY seq) AS sticky,
          seq - row_number() OVER (PARTITION BY run_id, aft ORDER BY seq) AS g FROM pas) WHERE aft GROUP BY run_id, g""", "pas")
SQL["enforcement_events"] = build("SELECT * FROM evs", "evs")
SQL["attestation_edges"] = build("SELECT * FROM att", "att")
define("left_recs", "SELECT * FROM recs WHERE NOT (kind = 'Verdict' AND seq % 97 = 13)", "recs")
SQL["dangling_links"] = build("""
  SELECT e.* FROM (SELECT run_id, kind, 'source' AS "end", src_id AS record_id FROM foll UNION ALL SELECT run_id, kind, 'target', dst_id FROM foll) e
  LEFT JOIN (SELECT DISTINCT run_id, kind, record_id FROM left_recs) r ON r.run_id = e.run_id AND r.kind = e.kind AND r.record_id = e.record_id
  WHERE r.record_id IS NULL""", "foll", "left_recs")
SQL["due_declarations"] = build("""
  SELECT run_id, declaration_id, CASE WHEN t_issued >= 0 AND t_issued::BIGINT % 3 = 0 THEN t_issued::BIGINT // 3 END AS frame_idx FROM decl""", "decl")
SQL["probe_declaration"] = build("SELECT * FROM probes", "probes")
define("ref0", "SELECT run_id, verdict_id, seq, t, outcome, fault, declaration_id FROM verd WHERE outcome <> 'PERMIT'", "verd")
define("ref1", """
  SELECT run_id, verdict_id, seq, t, outcome, CASE WHEN seq % 29 = 3 THEN 'stale_declaration' ELSE fault END AS fault, declaration_id
  FROM ref0 WHERE seq % 31 <> 7""", "ref0")
SQL["violations_diff"] = build("""
  SELECT *, 'missing' AS side FROM (SELECT * FROM ref0 EXCEPT ALL SELECT * FROM ref1)
  UNION ALL SELECT *, 'invented' FROM (SELECT * FROM ref1 EXCEPT ALL SELECT * FROM ref0)""", "ref0", "ref1")
SQL["node_counts"] = build("""
  SELECT rr.run_id, k.kind, count(n.kind) AS nodes FROM rr
  CROSS JOIN (VALUES ('RobotConfig'), ('Envelope'), ('Entity'), ('Declaration'), ('Verdict'), ('Occurrence')) k(kind)
  LEFT JOIN (SELECT run_id, kind FROM recs UNION ALL SELECT run_id, 'Envelope' FROM decl WHERE order_key % 41 <> 0
             UNION ALL SELECT run_id, 'Envelope' FROM verd WHERE outcome = 'CLAMP') n ON n.run_id = rr.run_id AND n.kind = k.kind
  GROUP BY 1, 2""", "rr", "recs", "decl", "verd")
define("ins", """
  SELECT l_partkey AS part_id, CASE WHEN l_partkey % 10 = 0 AND l_linenumber = 7 THEN 'pallet' ELSE 'crate' END AS kind,
    (l_partkey % 30) / 100.0::DOUBLE AS r FROM lineitem""")
SQL["idempotent_merge"] = build("""
  SELECT part_id, min(kind) AS kind, min(r) AS r, count(*) AS inserts FROM ins GROUP BY 1 HAVING count(DISTINCT kind) = 1""", "ins")
SQL["merge_conflicts"] = build("SELECT part_id, count(*) AS inserts FROM ins GROUP BY 1 HAVING count(DISTINCT kind) > 1", "ins")
SQL["geometry_attach"] = build("""
  SELECT run_id, declaration_id AS region_id, CASE WHEN order_key % 4 > 0 THEN 'kept' WHEN order_key % 3 = 0 THEN 'late' END AS geometry FROM decl""", "decl")
define("bad_v", """
  SELECT run_id, verdict_id, CASE WHEN seq % 47 = 5 THEN 'MAYBE' ELSE outcome END AS outcome, CASE WHEN seq % 43 = 5 THEN NULL ELSE fault END AS fault,
    CASE WHEN seq % 37 = 5 THEN NULL ELSE clamp_area END AS clamp_area FROM verd""", "verd")
SQL["validate_records"] = build("""
  SELECT run_id, declaration_id AS row_id, 'horizon not positive' AS rule FROM decl WHERE order_key % 53 = 0
  UNION ALL SELECT run_id, declaration_id, 'unknown action class' FROM decl WHERE order_key % 59 = 0
  UNION ALL SELECT run_id, declaration_id, 'bad mac' FROM decl WHERE order_key % 61 = 0
  UNION ALL SELECT run_id, verdict_id, 'unknown outcome' FROM bad_v WHERE outcome = 'MAYBE'
  UNION ALL SELECT run_id, verdict_id, 'fault absent iff permitted' FROM bad_v WHERE (outcome = 'PERMIT') <> (fault IS NULL)
  UNION ALL SELECT run_id, verdict_id, 'bound iff clamped' FROM bad_v WHERE (outcome = 'CLAMP') <> (clamp_area IS NOT NULL)""", "decl", "bad_v")
define("regs", """
  SELECT run_id, 'env_' || substr(sha256('declared' || chr(0) || declaration_id), 1, 16) AS region_id, 'declared' AS source FROM decl WHERE order_key % 41 <> 0
  UNION ALL SELECT run_id, 'env_' || substr(sha256('clamped' || chr(0) || verdict_id), 1, 16), 'clamped' FROM verd WHERE outcome = 'CLAMP'""", "decl", "verd")
SQL["validate_edges"] = build("""
  SELECT run_id, row_id, rule FROM (SELECT *, type || '>' || src_id || '>' || dst_id AS row_id FROM att) a,
    (VALUES ('wrong layer'), ('area iff INTERSECTS'), ('ends before it starts'), ('target does not exist')) r(rule)
  WHERE (rule = 'wrong layer' AND src_id LIKE '%33') OR (rule = 'area iff INTERSECTS' AND src_id LIKE '%55')
     OR (rule = 'ends before it starts' AND src_id LIKE '%77')
     OR (rule = 'target does not exist' AND type = 'DECLARED' AND dst_id NOT IN (SELECT region_id FROM regs))""", "att", "regs")
SQL["validate_regions"] = build("""
  SELECT run_id, region_id AS row_id, rule FROM (SELECT *, ascii(substr(region_id, 20, 1)) AS n FROM regs),
    (VALUES ('neither geometry nor configuration'), ('horizon absent iff clamped'), ('outer bound iff computed')) r(rule)
  WHERE (rule = 'neither geometry nor configuration' AND n % 5 = 0) OR (rule = 'horizon absent iff clamped' AND source = 'clamped' AND n = 97)
     OR (rule = 'outer bound iff computed' AND n = 98)""", "regs")
define("bad_o", """
  SELECT run_id, verdict_id || '-' || ordinal AS row_id, CASE WHEN seq % 51 = 3 THEN seq - 1 ELSE seq END AS s, seq, type,
    seq % 50 = 9 AS unk FROM evs""", "evs")
SQL["validate_occurrences"] = build("""
  SELECT run_id, row_id, 'unknown type' AS rule FROM bad_o WHERE unk
  UNION ALL SELECT run_id, row_id, 'entity iff about one' FROM bad_o WHERE NOT unk AND seq % 45 = 9
  UNION ALL SELECT run_id, row_id, 'value iff measured' FROM bad_o WHERE NOT unk AND seq % 46 = 9
  UNION ALL SELECT run_id, row_id, 'blank reason' FROM bad_o WHERE seq % 44 = 9
  UNION ALL SELECT run_id, row_id, 'date format' FROM bad_o WHERE seq % 40 = 9
  UNION ALL SELECT run_id, row_id, 'instant format' FROM bad_o WHERE seq % 41 = 9
  UNION ALL SELECT run_id, s::VARCHAR, 'seq is not unique' FROM bad_o GROUP BY run_id, s HAVING count(*) > 1""", "bad_o")
