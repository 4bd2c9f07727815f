import math
import random
import re
from collections import Counter

import brute
from pyspark.sql import functions as F

from runaudit.llm import grams, quality_classifier, quality_rules

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def base(text):
    w = brute.words(text)
    lines = [x for x in (text or "").split("\n") if brute.words(x)]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return (
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
        len(w) < 50 or 100 * len(covered) > 50 * len(w),
    )


def hashed(text):
    ids, n = grams.bucket_ids([(text or "").encode()])
    assert n[0] == len(ids) == max(0, len((text or "").encode()) - 4)
    return ids.tolist()


def test_counts_and_ratio_against_brute_force(spark):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["é", "a|b", "ça", "xx", "yy#", "zz"]) for _ in range(rnd.randrange(140))) for _ in range(60)]
    texts += ["", None, " \n\t", "a b c a b c", "l1 x\nl1 x\n\n \nl2\nl1 x", "漢字 " * 60, "one " * 5000]
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(d, t, "k") for d, t in docs], "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(d, d % 3 != 0, 0) for d in range(60)], "doc_id long, quality boolean, toxic int").select(
        "doc_id", F.col("quality").cast("int").alias("quality"), "toxic"
    )
    rows = {r.doc_id: r for r in quality_rules.judge(df, labels).collect()}
    said = grams.labelled(df, labels, "text").collect()
    raw, good = Counter(g for t in texts for g in hashed(t)), Counter(
        g for r in said if r._good and not r._held for g in hashed(r.text)
    )
    share = sum(good.values()) / sum(raw.values())
    for d, t in docs:
        r = rows[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(t), t
        each = [math.log((good[g] + share) / (raw[g] + 1) / share) for g in hashed(t)]
        assert abs(r.log_ratio - sum(each) / max(1, len(each))) < 1e-4
        assert not (r.base_failed and r.kept)
    kept, lost = ([rows[d].log_ratio for d in rows if not rows[d].base_failed and rows[d].kept == k] for k in (True, False))
    assert not kept or not lost or min(kept) >= max(lost)


def test_held_out_rows(spark):
    """Labelled rows that no model has seen: fine ones stay, bad ones go."""
    df, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    test = F.pmod(F.xxhash64(F.lit("test"), "doc_id"), F.lit(3)) == 0
    rows = quality_rules.judge(df, labels.where(~test)).join(labels.where(test), "doc_id").where("not base_failed").collect()
    fine = [r.kept for r in rows if r.quality == 1 and r.toxic == 0]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(fine) >= 0.97 * len(fine) and sum(bad) <= 0.1 * len(bad)


def test_held_out_toxic_rows(spark):
    """Toxic rows of good quality that neither model nor cut has seen go, and fine ones stay."""
    sf = SF.replace("sf0.01", "sf0.1")
    df, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    test = F.pmod(F.xxhash64(F.lit("test"), "doc_id"), F.lit(3)) == 0
    rows = quality_rules.judge(df, labels.where(~test)).join(labels.where(test), "doc_id").where("not base_failed").collect()
    fine = [r.kept for r in rows if r.quality == 1 and r.toxic == 0]
    toxic = [r.kept for r in rows if r.quality == 1 and r.toxic == 1]
    print(f"fine kept {sum(fine)} of {len(fine)}, toxic kept {sum(toxic)} of {len(toxic)}")
    assert sum(fine) >= 0.97 * len(fine) and sum(toxic) <= 0.25 * len(toxic)


def test_draws(spark):
    df, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    target = grams.labelled(df, labels, "text").where("_good")
    rows = quality_classifier.resample(df, target, 300).collect()
    by_draw = sorted(rows, key=lambda r: -r.draw)
    assert len(rows) == 1000 and sum(r.kept for r in rows) == 300
    assert {r.doc_id for r in by_draw[:300]} == {r.doc_id for r in rows if r.kept}
    assert quality_classifier.resample(df, target, 5000).where("kept").count() == 1000
    assert quality_classifier.resample(df, target, 0).where("kept").count() == 0
    noise = spark.range(20000).select(quality_classifier.gumbel(F.col("id"), 1).alias("g")).agg(F.avg("g"), F.stddev("g")).first()
    assert abs(noise[0] - 0.5772) < 0.05 and abs(noise[1] - 1.2825) < 0.05


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, None, 2), (None, "some text " * 60, 3), (4, "", 5), (4, "ab", 5)], "doc_id long, text string, n_words long")
    none = spark.createDataFrame([], LABELS)
    got = quality_rules.judge(df, none, keep=tuple(df.columns)).collect()
    assert len(got) == 4 and sorted(r.n_words for r in got) == [0, 0, 1, 120]
    assert len(got) == 4 and all(r.log_ratio == 0 for r in got)
    assert quality_rules.judge(df.limit(0), none).count() == 0
    some = spark.createDataFrame([(4, 1, None), (None, 1, 0), (1, 0, 1)], LABELS)
    assert quality_rules.judge(df, some).count() == 4
    drawn = quality_classifier.resample(df, df.where("doc_id = 4"), 2).collect()
    assert len(drawn) == 4 and sum(r.kept for r in drawn) >= 2
    assert quality_classifier.resample(df.limit(0), df, 2).count() == 0
