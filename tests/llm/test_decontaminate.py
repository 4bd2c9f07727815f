import random

import numpy as np

from runaudit.llm import decontaminate

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, item_id string"


def edits(item, text):
    """Least edit distance of the item to any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def edited(words, n, rnd):
    out = list(words)
    for _ in range(n):
        at, how = rnd.randrange(len(out)), rnd.randrange(3)
        if how == 0:
            out[at] = f"e{rnd.randrange(999)}"
        elif how == 1:
            del out[at]
        else:
            out.insert(at, f"e{rnd.randrange(999)}")
    return out


def test_recall_and_precision(spark):
    rnd = random.Random(2)
    pool = [f"w{i}" for i in range(400)]
    items = [[rnd.choice(pool) for _ in range(rnd.randrange(12, 60))] for _ in range(60)]
    docs, want = [], {}
    for d in range(400):
        t = [rnd.choice(pool) for _ in range(rnd.randrange(150))]
        if d % 2:
            i = rnd.randrange(len(items))
            got = edited(items[i], rnd.randrange(1 + len(items[i]) // 10), rnd)
            at = rnd.randrange(len(t) + 1)
            t[at:at] = got
            want[d, i] = True
        docs.append((d, " ".join(t).upper() if d % 3 else " ".join(t), "x"))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    rows = decontaminate.matches(spark.createDataFrame(docs, SCHEMA).drop("item_id"), bench).collect()
    found = {(r.doc_id, r.item_id) for r in rows}
    assert len(found & set(want)) >= 0.95 * len(want)
    for r in rows:
        exact = edits(items[r.item_id], docs[r.doc_id][1].lower().split())
        assert exact <= r.distance <= len(items[r.item_id]) // 5


def test_every_edit_rate_up_to_the_limit(spark):
    """No match within the limit is missed, and its distance is the least one, at each rate by itself."""
    rnd = random.Random(9)
    pool = [f"w{i}" for i in range(400)]
    items = [[rnd.choice(pool) for _ in range(rnd.randrange(5, 60))] for _ in range(40)]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    docs, rate = [], {}
    for percent in (5, 10, 15, 20):
        for i, x in enumerate(items):
            t = [rnd.choice(pool) for _ in range(80)]
            at = rnd.randrange(len(t) + 1)
            t[at:at] = edited(x, len(x) * percent // 100, rnd)
            rate[len(docs)] = (percent, i)
            docs.append((len(docs), " ".join(t), "x"))
    got = decontaminate.matches(spark.createDataFrame(docs, SCHEMA).drop("item_id"), bench).collect()
    found = {(r.doc_id, r.item_id): r.distance for r in got}
    for percent in (5, 10, 15, 20):
        hit = [(d, i) in found for d, (p, i) in rate.items() if p == percent]
        assert sum(hit) == len(hit), (percent, sum(hit), len(hit))
    for (d, i), distance in found.items():
        assert distance == edits(items[i], docs[d][1].split())


def test_recall_of_sampling_alone(capsys):
    """Of copies with just so many edits, the share that the sampled walks find without the pieces."""
    rnd = random.Random(12)
    pool = [f"w{i}" for i in range(5000)]
    known = decontaminate.WordHashes()
    items = [[rnd.choice(pool) for _ in range(rnd.randrange(16, 60))] for _ in range(150)]
    index = decontaminate.Index.of([known.of([" ".join(x).encode()])[0] | np.uint64(1) for x in items], list(range(150)), 20)
    share = {}
    for percent in (0, 5, 10, 15, 20):
        texts = []
        for x in items * 2:
            around = [[rnd.choice(pool) for _ in range(20)] for _ in range(2)]
            texts.append(" ".join(around[0] + edited(x, len(x) * percent // 100, rnd) + around[1]).encode())
        hashes, n = known.of(texts)
        first = np.cumsum(n + 1) - n - 1
        laid = np.zeros(len(hashes) + len(n), np.uint64)
        laid[np.arange(len(hashes)) + np.repeat(np.arange(len(n)), n)] = hashes | np.uint64(1)
        owner = np.repeat(np.arange(len(n)), n + 1)
        hit = np.zeros(len(texts), bool)
        with np.errstate(over="ignore"):
            alive = index.alive(laid, 20)
            assert all(alive[a + 20 : a + 30].all() for a in first)  # the pair filter drops no match
            for place, _, item in index.candidates(laid, pieced=False):
                text = owner[place]
                hit[text[(item == text % 150) & (np.abs(place - first[text] - 20) <= 12)]] = True
        share[percent] = hit.mean()
    with capsys.disabled():
        print(" recall of sampled walks by edit rate:", share)
    assert share[0] == 1.0 and min(share.values()) >= 0.9


def test_exact_copies_are_always_found(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = [r.text for r in bench.orderBy("item_id").collect()]
    docs = [(i, f"before {t} after") for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(texts)]
    rows = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    ids = [r.item_id for r in bench.orderBy("item_id").collect()]
    exact = {(r.doc_id, r.item_id) for r in rows if r.distance == 0}
    assert {(i, k) for i, k in enumerate(ids)} | {(1000 + i, k) for i, k in enumerate(ids)} <= exact


def test_items_of_one_to_three_words_inside_a_sentence(spark):
    rnd = random.Random(3)
    pool = [f"w{i}" for i in range(300)]
    items = [[f"i{i}" if k == 0 else rnd.choice(pool) for k in range(1 + i % 3)] for i in range(60)]
    docs = [(i, " ".join([rnd.choice(pool) for _ in range(9)] + x + [rnd.choice(pool) for _ in range(9)])) for i, x in enumerate(items)]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    rows = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.start, r.n_words, r.distance) for r in rows) == [(i, i, 9, len(x), 0) for i, x in enumerate(items)]


def test_distance():
    def a(s):
        return np.array([hash(c) & 0xFFFF for c in s], np.uint64)

    assert decontaminate.distance(a("abcd"), a("abcdxx"), 1) == (0, 4)
    assert decontaminate.distance(a("abcd"), a("abxcd"), 1) == (1, 5)
    assert decontaminate.distance(a("abcd"), a("zzzz"), 1)[0] == 2


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "one two", "c"), (3, "one two", "c"), (None, "ONE two", "c")], SCHEMA)
    bench = spark.createDataFrame([("i", "one two", 5), ("j", None, 6), ("k", " ", 7)], "item_id string, text string, doc_id long")
    empty = bench.limit(0)
    got = decontaminate.matches(docs, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.distance) for r in got) == [(0, "i", 0), (3, "i", 0), (3, "i", 0)]
    assert decontaminate.matches(docs, empty).count() == 0 and decontaminate.matches(docs.limit(0), bench).count() == 0
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [1, 2]
