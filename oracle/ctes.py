"""Shared common table expressions of the DuckDB statements.

`build(body, *names)` prefixes the body with the named expressions and the
ones they need, in order.
"""

from __future__ import annotations

import re

DEFS: dict[str, tuple[tuple[str, ...], str]] = {}


def define(name: str, sql: str, *needs: str) -> None:
    DEFS[name] = (needs, sql)


def build(body: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in DEFS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({DEFS[n][1]})" for n in order)
    again = any(re.search(rf"\b(FROM|JOIN)\s+{n}\b", DEFS[n][1]) for n in order)
    return f"WITH {'RECURSIVE ' if again else ''}{ctes}\n{body}"


# --- scene ---------------------------------------------------------------------
define("fr0", """
  SELECT user_id AS run_id, event_id, event_type, value, ts,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx
  FROM events""")
define("fr", "SELECT *, frame_idx * 0.02::DOUBLE AS t FROM fr0", "fr0")
define("fr30", "SELECT *, frame_idx * 30.0::DOUBLE AS t FROM fr0", "fr0")
define("ru", """
  SELECT user_id AS run_id, count(*) AS frame_count, 0.0::DOUBLE AS t_first,
         (count(*) - 1) * 0.02::DOUBLE AS t_last
  FROM events GROUP BY 1""")
define("ents", """
  SELECT run_id, e AS entity_id FROM ru, (VALUES ('human'), ('obs_a'), ('spare')) v(e)""", "ru")
DIST = """
  SELECT run_id, frame_idx, t, 'human' AS entity_id, value / 100.0::DOUBLE AS d FROM {f}
  UNION ALL
  SELECT run_id, frame_idx, t, 'obs_a', ((event_id * 37) % 500) / 100.0::DOUBLE FROM {f}"""
define("dist", DIST.format(f="fr"), "fr")
define("dist30", DIST.format(f="fr30"), "fr30")
AREA2 = "(round_even(({a}) * pow(10.0, 1 - floor(log10({a}))), 0) / pow(10.0, 1 - floor(log10({a}))))"
OBS = """
  SELECT run_id, frame_idx, t, entity_id, 'SEPARATION' AS type,
         round_even(d / 0.2::DOUBLE, 0) AS cmp, NULL::DOUBLE AS overlap_area,
         round_even(d / 0.2::DOUBLE, 0) * 0.2::DOUBLE AS min_distance FROM {f}
  UNION ALL
  SELECT run_id, frame_idx, t, entity_id, 'INTERSECTS', {area}, {area}, NULL FROM {f} WHERE d < 0.5
  UNION ALL
  SELECT run_id, frame_idx, t, entity_id, 'CONTACT', 1.0, NULL, NULL FROM {f} WHERE d < 0.05"""
_A = AREA2.format(a="0.5::DOUBLE - d")
define("obs", OBS.format(f="dist", area=_A), "dist")
define("obs30", OBS.format(f="dist30", area=_A), "dist30")
EDGES = """
  SELECT run_id, type, entity_id, min(frame_idx) AS frame_first, max(frame_idx) AS frame_last,
         min(t) AS t_start, max(t) AS t_end, first(overlap_area) AS overlap_area,
         first(min_distance) AS min_distance, first(cmp) AS cmp
  FROM (SELECT *, frame_idx - row_number() OVER
          (PARTITION BY run_id, type, entity_id, cmp ORDER BY frame_idx) AS g FROM {o})
  GROUP BY run_id, type, entity_id, cmp, g"""
define("edges", EDGES.format(o="obs"), "obs")
define("edges30", EDGES.format(o="obs30"), "obs30")
PRES = """
  SELECT run_id, type, entity_id, min(frame_idx) AS frame_first, max(frame_idx) AS frame_last,
         min(t) AS t_first, max(t) AS t_last
  FROM (SELECT *, frame_idx - row_number() OVER
          (PARTITION BY run_id, type, entity_id ORDER BY frame_idx) AS g FROM {o})
  GROUP BY run_id, type, entity_id, g"""
define("pres", PRES.format(o="obs"), "obs")
define("smeta", """
  SELECT *, NOT (run_id % 5 = 0 OR run_id % 7 = 0) AS keeps_edges,
         (run_id % 5 = 0 AND run_id % 7 <> 0) AS keeps_occ,
         run_id % 3 <> 0 AS has_rule FROM ru""", "ru")
define("closest", """
  SELECT run_id, entity_id, arg_min(frame_idx, bucket * 1000000 + frame_idx) AS frame_idx,
         min(bucket) AS bucket FROM
    (SELECT run_id, entity_id, frame_idx, t, round_even(d / 0.01::DOUBLE, 0)::BIGINT AS bucket FROM dist)
  GROUP BY 1, 2""", "dist")

# --- records ------------------------------------------------------------------------
define("rr", """
  SELECT c_custkey AS run_id, 'unit-' || c_nationkey AS unit, lower(c_mktsegment) AS operator
  FROM customer""")
define("rmeta", """
  SELECT run_id, CASE WHEN run_id % 13 = 0 THEN 'absent' ELSE 'present' END AS attestation_records,
         CASE WHEN run_id % 17 <> 0 THEN 'every record' END AS attestation_retention FROM rr""", "rr")
define("gate", """
  SELECT run_id, CASE WHEN attestation_records <> 'present' THEN 'no record stream'
                      WHEN attestation_retention IS NULL THEN 'no retention rule' END AS refusal
  FROM rmeta""", "rmeta")
_OA = AREA2.format(a="o_totalprice")
define("decl", f"""
  SELECT o_custkey AS run_id, 'd' || o_orderkey AS declaration_id, o_orderkey AS order_key,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS seq,
         date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::DOUBLE AS t_issued,
         (30 + o_orderkey % 60)::DOUBLE AS horizon,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'reach' WHEN '2-HIGH' THEN 'hold'
           WHEN '3-MEDIUM' THEN 'retract' WHEN '4-NOT SPECIFIED' THEN 'traverse'
           WHEN '5-LOW' THEN 'escalate' END AS action_class,
         {_OA} AS area
  FROM orders""")
_LA = AREA2.format(a="l_extendedprice")
define("verd0", """
  SELECT o.o_custkey AS run_id, l.*,
         row_number() OVER (PARTITION BY o.o_custkey ORDER BY l_shipdate, l_orderkey, l_linenumber,
           l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag,
           l_linestatus) - 1 AS seq,
         CASE WHEN l_returnflag = 'N' THEN 'PERMIT' WHEN l_returnflag = 'A' THEN 'CLAMP'
              WHEN l_linestatus = 'F' THEN 'VETO' ELSE 'SAFE_STATE' END AS outcome
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""")
define("verd1", """
  SELECT *, CASE outcome WHEN 'CLAMP' THEN 'declaration_action_mismatch'
      WHEN 'VETO' THEN (CASE l_suppkey % 6 WHEN 0 THEN 'no_declaration' WHEN 1 THEN 'stale_declaration'
        WHEN 2 THEN 'envelope_overclaim' WHEN 3 THEN 'out_of_vocabulary_action'
        WHEN 4 THEN 'unattributed' ELSE 'replay_or_reorder' END)
      WHEN 'SAFE_STATE' THEN (CASE WHEN l_linenumber % 2 = 0 THEN 'watchdog_expiry'
        ELSE 'escalation_failure' END) END AS fault FROM verd0""", "verd0")
define("verd", f"""
  SELECT run_id, 'v-' || run_id || '-' || seq AS verdict_id,
         CASE WHEN fault IN ('no_declaration', 'watchdog_expiry') THEN NULL
              ELSE 'd' || l_orderkey END AS declaration_id,
         seq, date_diff('day', DATE '1995-01-01', l_shipdate::DATE)::DOUBLE AS t, outcome, fault,
         CASE WHEN outcome = 'CLAMP' THEN {_LA} END AS clamp_area FROM verd1""", "verd1")
define("drows", """
  SELECT run_id, declaration_id, seq, t_issued, horizon, action_class,
         CASE WHEN order_key % 41 <> 0 THEN 'env_' || substr(sha256('declared' || chr(0) || declaration_id), 1, 16) END AS region_id,
         CASE WHEN order_key % 41 <> 0 THEN area END AS area FROM decl""", "decl")
define("vrows", """
  SELECT v.run_id, verdict_id, CASE WHEN d.declaration_id IS NOT NULL THEN v.declaration_id END AS declaration_id,
         v.seq, t, outcome, fault,
         CASE WHEN outcome = 'CLAMP' THEN 'env_' || substr(sha256('clamped' || chr(0) || verdict_id), 1, 16) END AS region_id,
         clamp_area AS area FROM verd v LEFT JOIN decl d ON d.run_id = v.run_id AND d.declaration_id = v.declaration_id""", "verd", "decl")
