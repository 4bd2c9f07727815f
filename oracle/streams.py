"""DuckDB statements for the text stream queries."""

from oracle.ctes import build, define

SQL: dict[str, str] = {}


def six(x):
    return f"CASE WHEN printf('%.6f', {x}) = '-0.000000' THEN '0.000000' ELSE printf('%.6f', {x}) END"


BIG = "value * pow(2.0::DOUBLE, frame_idx * 7 % 105)"
define("ln", f"""
  SELECT run_id, event_id, frame_idx, {six('t')} AS t, {six('(event_id % 628) / 100.0::DOUBLE - 3.14::DOUBLE')} AS q0,
    {six('(event_id % 520) / 100.0::DOUBLE - 2.6::DOUBLE')} AS q1, {six('value / 1000.0::DOUBLE')} AS qd0, {six('-value / 3000.0::DOUBLE')} AS qd1,
    {six('value / 7.0::DOUBLE')} AS hx, {six('value / 64.0::DOUBLE')} AS hvy, event_id % 50 AS fault FROM fr""", "fr")
SQL["scan_frames"] = build("""
  SELECT run_id, t::DOUBLE AS t, q0::DOUBLE AS q_0, qd1::DOUBLE AS qd_1, hx::DOUBLE AS human_x, 0.0::DOUBLE AS human_y, hvy::DOUBLE AS human_vy,
    (1 + run_id % 2)::BIGINT AS obstacles, CASE WHEN run_id % 2 = 0 THEN 'crate' ELSE 'pillar' END AS last_obstacle
  FROM ln WHERE fault NOT IN (7, 8, 9, 10, 11)""", "ln")
SQL["frame_quarantine"] = build("""
  SELECT run_id, 5 + frame_idx % 16384 AS line, CASE fault WHEN 8 THEN 'wrong number of fields' WHEN 11 THEN 'header inside the data' ELSE 'not a finite number' END AS reason,
    sha256(CASE WHEN fault = 11 THEN 't,' ELSE '' END || CASE fault WHEN 7 THEN 'nan' WHEN 9 THEN 'abc' WHEN 10 THEN 'Infinity' ELSE t END || ',' || concat_ws(',', q0, q1, qd0, qd1, hx, '0.000000', '0.500000', hvy)
      || ',crate,box,1.600000,1.200000' || CASE WHEN run_id % 2 = 0 AND fault = 8 THEN '' ELSE ',0.250000' END
      || CASE WHEN run_id % 2 = 1 THEN ',pillar,box,-1.200000,0.900000' || CASE WHEN fault = 8 THEN '' ELSE ',0.300000' END ELSE '' END) AS row_digest
  FROM ln WHERE fault IN (7, 8, 9, 10, 11)""", "ln")
SQL["header_layouts"] = build("""
  SELECT 2::BIGINT AS joints, (1 + run_id % 2)::BIGINT AS obstacles, true AS valid, count(*) AS files
  FROM (SELECT DISTINCT run_id, frame_idx // 16384 AS c FROM fr) GROUP BY 2""", "fr")
SQL["provenance_kv"] = build("""
  SELECT run_id, 'scenario' AS key, 'run ' || run_id AS value FROM ru UNION ALL SELECT run_id, 'frames', frame_count::VARCHAR FROM ru""", "ru")
SQL["software_stamps"] = build("""
  SELECT run_id, 'engine+env-' || substr(sha256(printf('%.9f', 0.1::DOUBLE + run_id % 5 / 20.0::DOUBLE) || chr(0) || (4 + run_id % 3) || chr(0) || run_id % 7 || chr(0) || '0.050000000'), 1, 8) AS sw_version
  FROM ru""", "ru")
SQL["record_instants"] = build(f"""
  SELECT run_id, frame_idx, CASE WHEN run_id % 6 <> 0 THEN strftime(i, '%Y-%m-%dT%H:%M:%S.%fZ') END AS t_utc,
    CASE WHEN run_id % 6 <> 0 THEN strftime(i, '%Y/%m/%d') END AS date, {six('value / 3.0::DOUBLE - 40.0::DOUBLE')} AS fixed,
    CASE WHEN abs({BIG}) < pow(2.0::DOUBLE, 53) THEN {six('(' + BIG + ')')} ELSE ({BIG})::HUGEINT::VARCHAR || '.000000' END AS large,
    substr(sha256(run_id || chr(0) || '' || chr(0) || event_type), 1, 16) AS digest, frame_idx % 5 <> 0 AS id_ok
  FROM (SELECT *, CASE WHEN run_id % 2 = 0 THEN TIMESTAMP '2026-01-05 08:30:00.25' ELSE TIMESTAMP '2026-01-05 06:30:00' END
    + to_microseconds(round_even(t * 1e6, 0)::BIGINT) AS i FROM fr)""", "fr")
