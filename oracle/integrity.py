"""DuckDB statements for the chain queries: the fold is a recursive query."""

import hashlib

from oracle.ctes import DEFS, build, define
from oracle import records as _records  # noqa: F401  (defines shared expressions)

SQL: dict[str, str] = {}
FS, RS = "chr(31)", "chr(30)"
G0 = "0" * 64


def blob(raw: bytes) -> str:
    return "'" + "".join(f"\\x{b:02X}" for b in raw) + "'::BLOB"


def field(name, tag, text, nullable=False):
    t = f"coalesce({text}, '')" if nullable else text
    g = f"CASE WHEN {text} IS NULL THEN 'n' ELSE '{tag}' END" if nullable else f"'{tag}'"
    return f"'{name}' || {FS} || {g} || {FS} || octet_length(encode({t})) || {FS} || {t} || {RS}"


def hexed(text):
    return f"lower(hex(encode({text})))"


def fixed(x):
    return f"printf('%.6f', {x})"


D_HEAD = " || ".join([
    f"'Declaration' || {RS}", field("declaration_id", "s", "declaration_id"), field("seq", "i", "seq::VARCHAR"),
    field("t_issued", "f", fixed("t_issued")), field("horizon", "f", fixed("horizon")),
    field("action_class", "s", "action_class"), field("declared_envelope", "x", hexed("'region:' || declaration_id")),
])
V_HEAD = " || ".join([
    f"'Verdict' || {RS}", field("verdict_id", "s", "verdict_id"), field("declaration_id", "s", "declaration_id", True),
    field("seq", "i", "seq::VARCHAR"), field("t", "f", fixed("t")), field("outcome", "s", "outcome"),
    field("fault", "s", "fault", True),
    field("clamped_envelope", "x", "CASE WHEN outcome = 'CLAMP' THEN " + hexed("'clamp:' || verdict_id") + " END", True),
])
POLICY, ENFORCE, WITNESS = b"policy-test-key", b"enforcement-test-key", b"witness-test-key"


def hmac(key, msg):
    k = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in k), bytes(b ^ 0x5C for b in k)
    return f"sha256({blob(outer)} || unhex(sha256({blob(inner)} || {msg})))"


def signing(head, prev):
    return f"({blob(b'runaudit-chain-signing-v1' + bytes(1))} || encode({head} || {field('prev_hash', 's', prev)}))"


def mac_of(chain, head, prev):
    s = signing(head, prev)
    return f"CASE WHEN {chain} = 'policy' THEN {hmac(POLICY, s)} ELSE {hmac(ENFORCE, s)} END"


def full(head, prev, mac):
    return f"{head} || {field('prev_hash', 's', prev)} || {field('mac', 's', mac)}"


def link_hash(base, head, prev, mac):
    return (f"sha256({blob(b'runaudit-chain-link-v1' + bytes(1))} || {base} || "
            f"{blob(b'runaudit-chain-record-v1' + bytes(1))} || encode({full(head, prev, mac)}))")


define("heads_in", f"""
  SELECT run_id, 'policy' AS chain, seq, declaration_id AS record_id, {D_HEAD} AS head FROM decl
  UNION ALL SELECT run_id, 'enforcement', seq, verdict_id, {V_HEAD} FROM verd""", "decl", "verd")
STEP = f"""
  SELECT run_id, chain, seq, record_id, head, prev_hash, mac, {link_hash('unhex(prev_hash)', 'head', 'prev_hash', 'mac')} AS own_hash
  FROM (SELECT *, {mac_of('chain', 'head', 'prev_hash')} AS mac FROM ({{src}}))"""
define("sealed", STEP.format(src=f"SELECT *, '{G0}' AS prev_hash FROM heads_in WHERE seq = 0") + " UNION ALL " +
       STEP.format(src="SELECT h.*, s.own_hash AS prev_hash FROM sealed s JOIN heads_in h ON h.run_id = s.run_id AND h.chain = s.chain AND h.seq = s.seq + 1"),
       "heads_in")
define("dlast", "SELECT run_id, max(seq) AS last FROM decl GROUP BY 1", "decl")
define("alt0", f"""
  SELECT d.run_id, 'policy' AS chain, d.seq, declaration_id AS record_id,
    {D_HEAD} AS head, CASE WHEN d.run_id % 9 = 4 AND d.seq = 0 THEN '{"1" * 64}' ELSE s.prev_hash END AS prev_hash, s.mac
  FROM (SELECT * REPLACE (CASE WHEN run_id % 7 = 3 AND seq % 5 = 1 THEN horizon + 1 ELSE horizon END AS horizon) FROM decl) d
  JOIN dlast l ON l.run_id = d.run_id JOIN (SELECT run_id AS sr, seq AS ss, prev_hash, mac FROM sealed WHERE chain = 'policy') s ON sr = d.run_id AND ss = d.seq
  WHERE NOT (d.run_id % 19 = 5 AND d.seq = l.last)
  UNION ALL
  SELECT run_id, chain, seq, record_id, head, CASE WHEN run_id % 29 = 7 AND seq = 1 THEN 'zz' ELSE prev_hash END,
    CASE WHEN run_id % 23 = 6 AND seq % 4 = 0 THEN '' ELSE mac END
  FROM sealed WHERE chain = 'enforcement' AND NOT (run_id % 11 = 0 AND seq = 2)""".replace("field('seq'", "field('seq'"), "decl", "dlast", "sealed")
define("alt", f"""
  SELECT *, CASE WHEN prev_hash <> 'zz' THEN {link_hash('unhex(CASE WHEN prev_hash <> $$zz$$ THEN prev_hash ELSE $$00$$ END)', 'head', 'prev_hash', 'mac')} END AS own_hash FROM alt0""", "alt0")
define("lk", f"""
  SELECT *, CASE WHEN prev_hash = expected THEN 'ok' WHEN predecessor_id IS NULL THEN 'genesis' ELSE 'link' END AS link FROM (
    SELECT *, lag(record_id) OVER w AS predecessor_id, coalesce(lag(own_hash) OVER w, '{G0}') AS expected FROM alt
    WINDOW w AS (PARTITION BY run_id, chain ORDER BY seq))""", "alt")
define("mc", f"""
  SELECT *, CASE WHEN NOT regexp_full_match(mac, '[0-9a-f]{{64}}') THEN 'could-not-evaluate'
      WHEN mac = ({mac_of('chain', 'head', 'prev_hash')}) THEN 'valid' ELSE 'invalid' END AS mac_state FROM lk""", "lk")
define("stated", "SELECT run_id, chain, count(*) AS stated FROM sealed WHERE run_id % 37 <> 8 GROUP BY 1, 2", "sealed")
define("dang", """
  SELECT e.run_id, CASE e.kind WHEN 'Declaration' THEN 'policy' ELSE 'enforcement' END AS chain, e.record_id
  FROM (SELECT run_id, kind, src_id AS record_id FROM foll UNION ALL SELECT run_id, kind, dst_id FROM foll) e
  WHERE NOT EXISTS (SELECT 1 FROM alt0 r WHERE r.record_id = e.record_id)""", "foll", "alt0")
define("vc0", """
  SELECT m.run_id, c.chain, m.attestation_records = 'present' AS present, stated, coalesce(n, 0) AS records, coalesce(macs, 0) AS macs,
    coalesce(broken, 0) AS broken, coalesce(unchecked, 0) AS unchecked, coalesce(unread, 0) AS unread, coalesce(linkbad, 0) AS linkbad, coalesce(dg, 0) AS dangling
  FROM rmeta m CROSS JOIN (VALUES ('policy'), ('enforcement')) c(chain)
  LEFT JOIN stated s ON s.run_id = m.run_id AND s.chain = c.chain
  LEFT JOIN (SELECT run_id, chain, count(*) AS n, count(*) FILTER (WHERE mac_state <> 'could-not-evaluate') AS macs,
      count(*) FILTER (WHERE link <> 'ok' OR mac_state = 'invalid') AS broken, count(*) FILTER (WHERE link <> 'ok') AS linkbad,
      count(*) FILTER (WHERE own_hash IS NULL) AS unread,
      count(*) FILTER (WHERE own_hash IS NULL OR mac_state = 'could-not-evaluate') AS unchecked FROM mc GROUP BY 1, 2) x
    ON x.run_id = m.run_id AND x.chain = c.chain
  LEFT JOIN (SELECT run_id, chain, count(*) AS dg FROM dang GROUP BY 1, 2) d ON d.run_id = m.run_id AND d.chain = c.chain""",
  "rmeta", "stated", "mc", "dang")
VC = """
  SELECT run_id, chain, CASE WHEN present AND records > 0 AND ({broken} > 0 OR dangling > 0 OR stated <> records) THEN 'BROKEN'
      WHEN {cne} OR NOT present OR records = 0 OR stated IS NULL OR unchecked > 0 THEN 'COULD-NOT-EVALUATE' ELSE 'VERIFIED' END AS state,
    CASE WHEN present THEN records ELSE 0 END AS records_walked, CASE WHEN present THEN records ELSE 0 END AS links_checked,
    CASE WHEN present THEN {macs} ELSE 0 END AS macs_checked, CASE WHEN present THEN stated END AS stated_records FROM vc0"""
define("vc", VC.format(broken="broken", cne="false", macs="macs"), "vc0")

SQL["canonical_text"] = build(f"""
  SELECT run_id, chain, record_id, sha256(encode({full('head', 'prev_hash', 'mac')})) AS text_digest,
    octet_length(encode({full('head', 'prev_hash', 'mac')})) AS bytes FROM sealed""", "sealed")
SQL["chain_hashes"] = build("SELECT run_id, chain, seq, record_id, prev_hash, own_hash FROM sealed", "sealed")
SQL["chain_links"] = build("SELECT run_id, chain, seq, record_id, predecessor_id, expected, link FROM lk", "lk")
define("fin", "SELECT *, row_number() OVER (PARTITION BY run_id, chain ORDER BY seq) AS n, count(*) OVER (PARTITION BY run_id, chain) AS total FROM alt0", "alt0")
define("fold", f"""
  SELECT run_id, chain, n, total, {link_hash("unhex('" + G0 + "')", 'head', 'prev_hash', 'mac')} AS h FROM fin WHERE n = 1
  UNION ALL SELECT f.run_id, f.chain, f.n, f.total, {link_hash('unhex(p.h)', 'f.head', 'f.prev_hash', 'f.mac')}
  FROM fold p JOIN fin f ON f.run_id = p.run_id AND f.chain = p.chain AND f.n = p.n + 1""", "fin")
SQL["chain_heads"] = build("SELECT run_id, chain, h AS chain_head FROM fold WHERE n = total", "fold")
SQL["mac_check"] = build("SELECT run_id, chain, record_id, mac_state FROM mc", "mc")
SQL["verify_chain"] = build("SELECT * FROM vc", "vc")
SQL["verify_chain_keyless"] = build(VC.format(broken="linkbad", cne="true", macs="0"), "vc0")
SQL["chain_failures"] = build("""
  SELECT run_id, chain, kind, state, record_id, seq FROM (
    SELECT run_id, chain, unnest(list_concat(
        CASE WHEN link <> 'ok' THEN [{'kind': link, 'state': 'BROKEN'}] ELSE [] END,
        CASE WHEN own_hash IS NULL THEN [{'kind': 'unreadable', 'state': 'COULD-NOT-EVALUATE'}] ELSE [] END,
        CASE mac_state WHEN 'invalid' THEN [{'kind': 'mac', 'state': 'BROKEN'}]
          WHEN 'could-not-evaluate' THEN [{'kind': 'mac', 'state': 'COULD-NOT-EVALUATE'}] ELSE [] END), recursive := true), record_id, seq
    FROM mc WHERE run_id % 13 <> 0)
  UNION ALL SELECT run_id, chain, 'no-record-stream', 'COULD-NOT-EVALUATE', NULL, NULL FROM vc0 WHERE NOT present
  UNION ALL SELECT run_id, chain, 'no-count', 'COULD-NOT-EVALUATE', NULL, NULL FROM vc0 WHERE present AND stated IS NULL
  UNION ALL SELECT run_id, chain, 'no-records', 'COULD-NOT-EVALUATE', NULL, NULL FROM vc0 WHERE present AND records = 0
  UNION ALL SELECT run_id, chain, 'count', 'BROKEN', NULL, NULL FROM vc0 WHERE present AND records > 0 AND stated <> records
  UNION ALL SELECT run_id, chain, 'dangling-link', 'BROKEN', record_id, NULL FROM dang JOIN vc0 USING (run_id, chain) WHERE present AND records > 0""",
  "mc", "vc0", "dang")
SQL["chain_state"] = build("""
  SELECT run_id, CASE WHEN bool_or(state = 'BROKEN') THEN 'BROKEN' WHEN bool_or(state <> 'VERIFIED') THEN 'COULD-NOT-EVALUATE' ELSE 'VERIFIED' END AS state,
    sum(records_walked)::BIGINT AS records_walked FROM vc GROUP BY 1""", "vc")
define("h0", f"""
  SELECT run_id, coalesce(max(own_hash) FILTER (WHERE chain = 'policy'), '{G0}') AS d, coalesce(max(own_hash) FILTER (WHERE chain = 'enforcement'), '{G0}') AS v
  FROM (SELECT * FROM sealed QUALIFY row_number() OVER (PARTITION BY run_id, chain ORDER BY seq DESC) = 1) GROUP BY 1""", "sealed")
define("h1", f"""
  SELECT run_id, coalesce(max(h) FILTER (WHERE chain = 'policy'), '{G0}') AS d, coalesce(max(h) FILTER (WHERE chain = 'enforcement'), '{G0}') AS v
  FROM fold WHERE n = total GROUP BY 1""", "fold")
SQL["verify_commitment"] = build(f"""
  SELECT run_id, CASE WHEN reason LIKE '%moved' OR reason = 'signature does not verify' THEN 'INVALID'
      WHEN reason = 'heads match and are signed' THEN 'VALID' ELSE 'COULD-NOT-EVALUATE' END AS state, reason FROM (
    SELECT a.run_id, CASE a.run_id % 31 WHEN 3 THEN 'states no commitment' WHEN 1 THEN 'closed without a witness' WHEN 2 THEN 'unknown scheme'
        WHEN 5 THEN 'commitment is incomplete' ELSE CASE
        WHEN a.d <> coalesce(b.d, '{G0}') AND a.v <> coalesce(b.v, '{G0}') THEN 'declaration_head, verdict_head moved'
        WHEN a.d <> coalesce(b.d, '{G0}') THEN 'declaration_head moved' WHEN a.v <> coalesce(b.v, '{G0}') THEN 'verdict_head moved'
        WHEN a.run_id % 31 = 4 THEN 'heads match; another witness offered' WHEN a.run_id % 31 = 6 THEN 'signature does not verify'
        ELSE 'heads match and are signed' END END AS reason
    FROM h0 a LEFT JOIN h1 b USING (run_id))""", "h0", "h1")
SQL["tamper_detect"] = build("""
  SELECT run_id, declaration_id AS record_id, seq, 'set horizon' AS op, horizon::VARCHAR AS before, '9.5' AS after, 0::BIGINT AS bad_macs,
    CASE WHEN last >= 2 THEN 2 END::BIGINT AS first_break FROM decl JOIN dlast USING (run_id) WHERE seq = 1""", "decl", "dlast")
