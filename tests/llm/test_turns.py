import hashlib
import random
import re
import zlib

from runaudit.llm import queries, turns

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]")
LEGAL = {"su", "ua", "au"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        named = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        fault = zlib.crc32(f"{named[0]}:{named[1]}".encode()) % 20
        role, text = named[2:]
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if fault == 3 else 1)
    return out


def cheapest(said):
    """(cost, audit, repaired) over whole audits, one for each end of what was written."""
    best = {"": (0, "", ())}

    def put(found):
        more = {}
        for end, (cost, audit, text) in found.items():
            role = {"": "user", "s": "user", "a": "user", "u": "assistant"}[end]
            more[role[0]] = min(more.get(role[0], (1 << 60,)), (cost + 5, audit + "I", (*text, (role, ""))))
        return more

    def with_put(found):
        out = dict(found)
        for _ in range(2):
            found = put(found)
            for end, new in found.items():
                out[end] = min(out.get(end, (1 << 60,)), new)
        return out

    for role, text, fault in said:
        new = {}
        for end, (cost, audit, done) in with_put(best).items():
            ways = [(end, (cost + 2, audit + "D", done))]
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                if role[:1] == "s" and not end or end + role[:1] in {"u", *LEGAL}:
                    ways.append((role[:1], (cost + extra, audit + "K", (*done, (role, text)))))
                other = "assistant" if end == "u" else "user"
                ways.append((other[0], (cost + 1 + extra, audit + "R", (*done, (other, text)))))
            for then, way in ways:
                new[then] = min(new.get(then, (1 << 60,)), way)
        best = new
    return min(v for end, v in with_put(best).items() if end in ("", "a"))


def by_hand(rows):
    """What a conversation's rows, after damage, come to."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0))
    seen, said = set(), []
    for _, _, role, text in rows:
        found = WORD.findall(text)
        fault = "blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else None
        seen.add((role, text))
        said.append((role, text, fault))
    numbers = [r[1] for r in rows if r[1] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    wrong = sum(a[0][:1] + b[0][:1] not in LEGAL for a, b in zip(said, said[1:], strict=False))
    cost, audit, text = cheapest(said)
    faults = [sum(x[2] == f for x in said) for f in ("blank", "duplicate", "truncated")]
    sha = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in text).encode()).hexdigest()
    return (gaps, *faults, wrong, cost, audit, sha)


def flat(r):
    return (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)


def test_search_meets_whole_audits():
    rng = random.Random(5)
    roles = {0: "tool", 1: "system", 2: "user", 3: "assistant"}
    for _ in range(600):
        codes = rng.choice([[0, 1, 2, 3], [2, 3], [1, 2, 3], [2, 2, 3]])
        kinds = bytes(rng.choice(codes) | 4 * (rng.random() < 0.15) | 8 * (rng.random() < 0.3) for _ in range(rng.randint(1, 25)))
        cuts = sorted(rng.sample(range(1, len(kinds)), min(len(kinds) - 1, rng.randint(0, 4))))
        parts = [kinds[a:z] for a, z in zip([0, *cuts], [*cuts, len(kinds)], strict=True)]
        states, total = turns.meetings([turns.passage(p) for p in parts])
        audit = "".join(turns.search(p, a, z) for p, a, z in zip(parts, states, states[1:], strict=False)) + "I" * turns.CLOSING[states[-1]]
        said = [(roles[k & 3], "x", "blank" if k & 4 else "truncated" if k & 8 else None) for k in kinds]
        assert (total, audit) == cheapest(said)[:2]


def test_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: flat(r) for r in queries.op11_conversation_repair(spark, SF).collect()}
    want = {}
    for r in damaged(rows):
        want.setdefault(r[0], []).append(r)
    assert got == {c: by_hand(want.get(c, [])) for c in {r[0] for r in rows}}


def table(spark, tmp_path, rows):
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(path)
    return str(tmp_path)


def test_long_conversation_in_many_chunks(spark, tmp_path):
    """A conversation with most turns, cut to chunks of 16 turns, beside short ones."""
    rng = random.Random(9)
    texts = ["Yes.", "No", "Well, so be it!", "  ", "Then what?", "x"]
    rows = [(7, i, rng.choice(["user", "assistant", "user", "assistant", "system", "tool"]), f"{i % 211} " + rng.choice(texts)) for i in range(1500)]
    rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(texts)) for c in range(8, 30) for t in range(rng.randint(1, 5))]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    summary, left = turns.repair(turns.damage(docs), chunk=16)
    sums = {r.conv: r.sha256 for r in turns.digests(left).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    got = {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, sums.get(r.conv, nothing)) for r in summary.collect()}
    want = {}
    for r in damaged(rows):
        want.setdefault(r[0], []).append(r)
    assert got == {c: by_hand(v) for c, v in want.items()}


def test_odd_rows(spark, tmp_path):
    rows = [
        (None, None, None, None), (None, 1, "user", "Hi."), (None, 3, "assistant", "Ho."), (1, None, "user", "A."), (1, None, "user", "A."),
        (1, 5, "assistant", "B."), (1, 5, "assistant", "B."), (2, 1, "", "C."), (2, 2, None, "D"), (3, 4, "user", None), (4, 0, "system", "s."),
    ]
    got = {r.conv_id: flat(r) for r in queries.op11_conversation_repair(spark, table(spark, tmp_path, rows)).collect()}
    want = {}
    for r in damaged(rows):
        want.setdefault(r[0], []).append(r)
    assert got == {c: by_hand(want.get(c, [])) for c in {r[0] for r in rows}}
    many = spark.createDataFrame([(1, 0, "user", "Same.")] * 500, "conv_id long, turn long, role string, text string")
    summary, left = turns.repair(many.withColumn("conv", many.conv_id).withColumn("h1", many.turn), chunk=64)
    (one,) = summary.collect()
    assert (one.duplicate, one.audit, one.cost, left.count()) == (499, "D" * 500, 1000, 0)


def test_empty_table(spark, tmp_path):
    assert queries.op11_conversation_repair(spark, table(spark, tmp_path, [])).count() == 0
