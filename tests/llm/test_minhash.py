import random

import brute
import pytest

from runaudit.llm import minhash
from runaudit.llm.components import components

SF = "/root/testdata/sf0.01"


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def near_copies(n, rnd):
    """A base text, copies of copies with a word changed here and there, others."""
    base = [f"w{rnd.randrange(4000)}" for _ in range(160)]
    texts = [" ".join(base)]
    for _ in range(n):
        copy = rnd.choice(texts).split()
        for _ in range(rnd.randrange(4)):
            copy[rnd.randrange(len(copy))] = f"x{rnd.randrange(9)}"
        texts.append(" ".join(copy))
    return texts


def test_against_brute_force(spark):
    rnd = random.Random(3)
    texts = near_copies(120, rnd) + ["A b c", "a B C", "", None, " \t\n", "one two three four FIVE six", "x " * 3000, "x " * 3001]
    texts += texts[:7]
    rnd.shuffle(texts)
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(d, t, "other") for d, t in docs], "doc_id long, text string, component string")
    for percent in (80, 85):
        got, want = rows(minhash.near_duplicates(df, percent)), brute.near(docs, percent)
        assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == want
        assert all(r.kept == (r.component_id == d) for d, r in got.items())


def test_given_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute.near([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], 85)
    got = rows(minhash.near_duplicates(df, 85))
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == want


def test_repeated_keys_in_mixed_buckets(spark, monkeypatch):
    """Texts that share bands but are not linked, and keys that have several of them."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rnd = random.Random(8)
    docs = [(rnd.randrange(45), t) for t in near_copies(90, rnd)]
    sets = [(d, brute.shingles(t)) for d, t in docs]
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if 100 * len(x & y) >= 95 * len(x | y)]
    found = brute.components({d for d, _ in docs}, links)
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 95).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((d, len(s), found[d]) for d, s in sets)
    assert 10 < len(set(found.values())) < 45


def test_odd_tables(spark):
    schema = "doc_id long, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    same = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (4, None), (9, "a b c d e f")]
    got = minhash.near_duplicates(spark.createDataFrame(same, schema)).collect()
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in got if r.doc_id) == [(4, 4, True)] * 3 + [(9, 4, False)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components(spark, shape):
    rnd = random.Random(5)
    n = 60
    edges = {"path": [(i, i + 1) for i in range(n)], "star": [(n, i) for i in range(n)]}.get(shape) or [
        (rnd.randrange(200), rnd.randrange(200)) for _ in range(120)
    ]
    df = spark.createDataFrame([*edges, (5, 5), edges[0]], "a long, b long")
    want = brute.components({x for e in edges for x in e if e[0] != e[1]}, edges)
    assert {r.node: r.component for r in components(df).collect()} == want
