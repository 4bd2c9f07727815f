import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from brute import words

from runaudit.llm import periodic, queries

SF = "/root/testdata/sf0.01"


def planted(doc_id, text):
    w, h = words(text), zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return w[:a] + [w[a + (i - a) % p] for i in range(a, n)]


def every_run(w):
    """(start, length, period) by comparing the words at every lag."""
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i) + 1
    return sorted((a, n, q) for (a, n), q in found.items())


def collapsed(w, found):
    gone = set()
    for a, n, q in found:
        gone.update(range(a + q, a + n))
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def drawn(rng):
    n, letters = rng.randint(0, 500), rng.choice([1, 2, 3, 10, 1000])
    w = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randint(0, 4) if n > 3 else 0):
        a, p = rng.randrange(n), rng.randint(1, max(1, n // rng.choice([3, 4, 6, 20])))
        for i in range(a + p, min(n, a + rng.randint(1, n))):
            w[i] = w[i - p]
        if rng.random() < 0.3:
            w[rng.randrange(n)] = rng.randrange(letters)
    return w


def test_runs_of_drawn_words():
    rng = random.Random(11)
    value = np.random.default_rng(2).integers(0, 1 << 63, 1000, np.uint64)
    for _ in range(40):
        docs = [drawn(rng) for _ in range(6)]
        n = np.array([len(d) for d in docs])
        got = periodic.runs(value[np.array(sum(docs, []), int)], n).tolist()
        for i, d in enumerate(docs):
            assert [tuple(r[1:]) for r in got if r[0] == i] == every_run(d)


def test_periods_at_the_ends_of_scales():
    """A run of just three periods, for each period about the ends of the scales."""
    edges = [p for s, t in periodic.scales(2000) for p in (s - 1, s, s + 1, t - 1)]
    for p in [1, 2, 7, 8, 9, *edges]:
        for extra in (-1, 0, 1):
            length = max(24, 3 * p) + extra
            w = [f"x{i}" for i in range(5)] + [f"p{i % p}" for i in range(length)] + [f"y{i}" for i in range(5)]
            hashes, n = periodic.WordHashes().of([" ".join(w).encode()])
            got = [tuple(r[1:]) for r in periodic.runs(hashes, n).tolist()]
            assert got == ([(5, length, p)] if extra >= 0 else [])


def test_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op13_periodic_runs(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    compared = with_runs = 0
    for r in got:
        w = planted(r.doc_id, texts[r.doc_id])
        assert r.n_words == len(w)
        if len(w) > 1500:  # the comparison at every lag is quadratic
            continue
        found, compared = every_run(w), compared + 1
        lines = "".join(f"{a},{n},{q}\n" for a, n, q in found)
        assert (r.n_runs, r.runs_sha256) == (len(found), hashlib.sha256(lines.encode()).hexdigest())
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, found).encode()).hexdigest()
        best = min(found, key=lambda f: (-Fraction(f[1], f[2]), f[0], f[2]), default=None)
        assert (r.start, r.length, r.period) == (best or (None, None, None))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        with_runs += bool(found)
    assert compared > 900 and with_runs > 60


def test_odd_rows(spark):
    long = " ".join(f"w{i % 40}" for i in range(300_000))
    rows = [(None, None, "x"), (1, "", "x"), (1, "", "x"), (2, "a " * 24, "x"), (3, "a " * 23, "x"), (None, " \n\t", None), (4, long, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = sorted(periodic.collapse(docs).collect(), key=lambda r: (r.doc_id or 0, r.n_words))
    assert [(r.doc_id, r.n_words, [tuple(x) for x in r.runs]) for r in got] == [
        (None, 0, []), (None, 0, []), (1, 0, []), (1, 0, []), (2, 24, [(0, 24, 1)]), (3, 23, []), (4, 300_000, [(0, 300_000, 40)]),
    ]
    assert got[4].collapsed == "a" and got[6].collapsed == " ".join(f"w{i}" for i in range(40))
    assert periodic.collapse(docs.where("doc_id > 9")).count() == 0
    assert periodic.plant(docs).count() == len(rows)
