import brute
import corpus_pipeline
from pyspark.sql import functions as F
from test_line_dedup import by_hand
from test_tokens import BYTE, check_packing, plain

from runaudit.llm.common import stored

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_on_their_own_inputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, SF), name)
        assert out.columns == COLUMNS
        kept[name] = (rows(docs), rows(out))
        docs = out
    before, after = kept["quality_rules"]
    assert 0.5 * len(before) < len(after) and set(after) <= set(before)
    assert all(len(brute.words(r.text)) >= 50 for r in after.values())

    before, after = kept["line_dedup"]
    want = by_hand([(d, r.text) for d, r in before.items()], 3, 50)
    assert {d: r.text for d, r in after.items()} == {d: t for d, (n, gone, t) in want.items() if not gone or gone < n}
    assert all(r.n_chars == len(r.text) for r in after.values())

    before, after = kept["minhash"]
    found = brute.near([(d, r.text) for d, r in before.items()], 80)
    assert set(after) == {d for d, (_, c) in found.items() if c == d}

    before, after = kept["decontaminate"]
    items = [r.text.lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for d in set(before) - set(after):
        words = set(before[d].text.lower().split())
        assert any(len(words & set(i)) >= 0.7 * len(set(i)) for i in items)
    for r in after.values():
        text = " ".join(r.text.lower().split())
        assert not any(f" {' '.join(i)} " in f" {text} " for i in items)

    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    check_packing(packed, {d: plain(BYTE, 1)(r.text) for d, r in rows(docs).items()}, 2048)


def test_run_is_the_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(got.columns)


def test_odd_rows_pass_every_stage(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    odd = [(None, None, None, None, None), (1, "", "", "", 0), (2, None, None, None, None), (2, "x " * 30000, "en", "s", 60000)]
    df = spark.createDataFrame(odd, schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df, SF).count() >= 0
        assert stage(spark, df.limit(0), SF).count() == 0
    assert stage(spark, df, SF).agg(F.sum("length")).first()[0] > 0


def test_repeated_rows_in_each_stage(spark):
    """Rows equal in all columns: judged alike, one text to the line stage, one kept by `near`, judged alike by
    `benchmark`, packed each for itself."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    twice = docs.unionByName(docs)
    quality, lines, near, benchmark, pack = (f for _, f in corpus_pipeline.STAGES)

    def times(df, key="doc_id"):
        return {r[key]: r["count"] for r in df.groupBy(key).count().collect()}

    assert set(times(quality(spark, twice, SF)).values()) == {2}
    assert set(times(lines(spark, twice, SF)).values()) == {2}
    assert times(near(spark, twice, SF)) == times(near(spark, docs, SF)) and set(times(near(spark, twice, SF)).values()) == {1}
    assert set(times(benchmark(spark, twice, SF)).values()) == {2}
    packed = pack(spark, twice, SF)
    assert packed.count() == packed.select("sequence_id", "offset").distinct().count()
