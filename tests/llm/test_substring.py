import hashlib
import random

import brute

from runaudit.llm import rlz, suffix_array

SF = "/root/testdata/sf0.01"


def hard_texts(rnd):
    """Passages shared at odd offsets, overlaps, copies, loops and short texts."""
    pool = [f"w{i}" for i in range(3000)]
    passage = [rnd.choice(pool) for _ in range(70)]
    other = [rnd.choice(pool) for _ in range(120)]
    out = []
    for _ in range(60):
        t = [rnd.choice(pool) for _ in range(rnd.randrange(120))]
        for source in (passage, other):
            if rnd.random() < 0.6:
                a = rnd.randrange(len(source) - 45)
                at = rnd.randrange(len(t) + 1)
                t[at:at] = source[a : a + rnd.randrange(45, 80)]
        out.append(" ".join(t))
    out += ["x " * 400, "x " * 49, "y x " * 90, "", None, "\n\t ", "é ñ ü " * 40, out[3], out[3] + " tail", out[5].replace(" ", "\n")]
    rnd.shuffle(out)
    return out


def check(df, docs):
    want = brute.removed_by_windows(docs, 50)
    left = {d: [w for w, g in zip(brute.words(t), want[d], strict=True) if not g] for d, t in docs}
    got = {r.doc: r for r in rlz.parse(df).collect()}
    assert {d: (r.n_words, r.n_removed, r.kept) for d, r in got.items()} == {
        d: (len(want[d]), sum(want[d]), " ".join(left[d])) for d, _ in docs
    }
    marked = {d: [False] * len(w) for d, w in want.items()}
    for r in suffix_array.repeated_spans(df).collect():
        assert r.n_words >= 50 and r.source < r.doc
        marked[r.doc][r.start : r.start + r.n_words] = [True] * r.n_words
    assert marked == want


def test_against_brute_force(spark):
    docs = list(enumerate(hard_texts(random.Random(11))))
    check(spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, source long"), docs)


def test_given_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    check(df, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_odd_tables(spark):
    schema = "doc_id long, text string"
    empty = spark.createDataFrame([], schema)
    assert rlz.parse(empty).count() == 0 and suffix_array.repeated_spans(empty).count() == 0
    text = " ".join(map(str, range(60)))
    df = spark.createDataFrame([(None, text), (7, text), (7, text), (7, "a " + text), (8, text), (None, None)], schema)
    got = sorted((r.doc or 0, r.n_words, r.n_removed) for r in rlz.parse(df).collect())
    assert got == [(0, 0, 0), (0, 60, 0), (7, 60, 0), (7, 60, 0), (7, 61, 0), (8, 60, 60)]
    assert [(r.doc, r.n_words, r.source) for r in suffix_array.repeated_spans(df).collect()] == [(8, 60, 7)]
    assert hashlib.sha256(b"").hexdigest()
