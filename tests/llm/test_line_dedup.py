import random

import brute

from runaudit.llm import line_dedup


def by_hand(docs, k, min_words=None):
    """doc -> (lines, deleted, text) with every window of k lines, and of fewer with
    `min_words` words, held against all earlier ones."""
    if min_words is not None and k > 1:
        return _merged(docs, [_gone(docs, k), *(_gone(docs, n, min_words) for n in range(1, k))])
    return _merged(docs, [_gone(docs, k)])


def _merged(docs, found):
    out = {}
    for d, t in ((d, t) for d, t in docs if d is not None):
        raw, gone = (t or "").split("\n"), set().union(*(f.get(d, ()) for f in found))
        at = {j for j, x in enumerate(raw) if brute.words(x)}
        out[d] = (len(at), len(gone & at), "\n".join(x for j, x in enumerate(raw) if j not in gone))
    return out


def _gone(docs, k, min_words=0):
    first, places = {}, {}
    for d, t in sorted((r for r in docs if r[0] is not None), key=lambda r: r[0]):
        raw = (t or "").split("\n")
        at = [j for j, x in enumerate(raw) if brute.words(x)]
        places[d] = (raw, at)
        for i in range(len(at) - k + 1):
            first.setdefault(tuple(raw[j] for j in at[i : i + k]), (d, i))
    out = {}
    for d, (raw, at) in places.items():
        gone = out.setdefault(d, set())
        for i in range(len(at) - k + 1):
            window = tuple(raw[j] for j in at[i : i + k])
            if first[window] < (d, i) and len(brute.words(" ".join(window))) >= min_words:
                gone.update(range(at[i], at[i + k - 1] + 1))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(8)
    texts = ["\n".join(rnd.choice(["a", "b", "c d", "", " \t", "é", "long line " * 9]) for _ in range(rnd.randrange(30))) for _ in range(80)]
    texts += ["", "\n\n", "same\n" * 500, texts[0], texts[1] + "\nmore", "x\ny\nz\nx\ny\nz\nx\ny\nz"]
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(d, t, "r") for d, t in docs], "doc_id long, text string, row string")
    for k in (1, 2, 3, 4):
        got = {r.doc_id: (r.n_lines, r.n_deleted, r.text) for r in line_dedup.dedup_lines(df, k).collect()}
        want = by_hand(docs, k)
        if k == 1:  # windows of one line do not reach over the blank lines inside a run
            got, want = ({d: r[:2] for d, r in x.items()} for x in (got, want))
        assert got == want, k
    long = [(d, "\n".join(x * rnd.choice([1, 1, 30]) for x in t.split("\n"))) for d, t in docs]
    df = spark.createDataFrame([(d, t, "r", 1, 2) for d, t in long], "doc_id long, text string, _row string, _runs int, _left int")
    got = {r.doc_id: (r.n_lines, r.n_deleted, r.text) for r in line_dedup.dedup_lines(df, min_words=50).collect()}
    want = by_hand(long, 3, 50)
    assert got == want and got != by_hand(long, 3)


def test_many_runs_in_a_long_text(spark):
    """A text of 60,000 lines with thousands of runs takes time in proportion to its lines."""
    block = "\n".join(f"line {i}" for i in range(6))
    text = "\n".join(f"{block}\nown {i}" for i in range(8000))
    (got,) = line_dedup.dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert got.n_deleted == 7999 * 6 and got.text == "\n".join([block, *(f"own {i}" for i in range(8000))])


def test_maximal_runs(spark):
    docs = [(1, "a\nb\nc\nd\ne"), (2, "x\na\nb\nc\nd\ny"), (3, "c\nd\ne")]
    runs = line_dedup.repeated_runs(spark.createDataFrame(docs, "doc_id long, text string"), 3, "text", "doc_id")
    assert sorted((r.doc, r.start, r.last, r.n_lines, r.source, r.source_line) for r in runs.collect()) == [(2, 1, 4, 4, 1, 0), (3, 0, 2, 3, 1, 2)]


def test_long_runs_of_few_lines(spark):
    """With min_words, one or two lines of that many words go; lines first met apart count together."""
    a, b, long = "a " * 30 + "a", "b " * 30 + "b", "c " * 60 + "c"
    docs = [(1, f"x\n{a}\ny\n{long}"), (2, f"{b}\nz"), (3, f"p\n{a}\n\n{b}\nq"), (4, f"r\n{a}\n{b}\ns"), (5, f"t\n{long}\nu\n{a}"), (6, "x\nz")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df, min_words=50).collect()}
    assert got == {**dict(docs), 4: "r\ns", 5: f"t\nu\n{a}"}
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()} == dict(docs)


def test_native_plan(spark):
    df = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    plan = line_dedup.dedup_lines(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_odd_tables(spark):
    schema = "doc_id long, text string, n_lines string"
    assert line_dedup.dedup_lines(spark.createDataFrame([], schema)).count() == 0
    t = "a\nb\nc"
    rows = [(None, t, ""), (None, None, ""), (1, None, ""), (2, t, ""), (2, t, ""), (3, t, "")]
    got = sorted((r.doc_id or 0, r.n_deleted, r.text or "-") for r in line_dedup.dedup_lines(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 0, "-"), (0, 0, t), (1, 0, "-"), (2, 0, t), (2, 0, t), (3, 3, "-")]
