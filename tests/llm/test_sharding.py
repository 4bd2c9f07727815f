import zlib

import numpy as np
from pyspark.sql import functions as F

from runaudit.llm import queries, sharding

SF = "/root/testdata/sf0.01"


def jump_by_hand(key, shards):
    at, ahead = -1, 0
    while ahead < shards:
        at = ahead
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        ahead = int((at + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return at


def test_jump():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 500, np.uint64) * np.uint64(2) + np.uint64(1)
    for shards in (1, 2, 7, 40, 1000):
        assert sharding.jump(keys, shards).tolist() == [jump_by_hand(int(k), shards) for k in keys]


def test_documents(spark):
    got = queries.op5_sharding(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in got) == sorted(texts)
    slots = {}
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 40) and 0 <= r.shard < 40
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, shard string"
    empty = spark.createDataFrame([], schema)
    assert sharding.assign(empty, "doc_id", 4, [F.col("doc_id")]).count() == 0
    rows = [(None, None, "x"), (None, "t", "y"), (3, "t", "z"), (3, "t", "z")]
    df = sharding.assign(spark.createDataFrame(rows, schema), "doc_id", 4, [F.col("doc_id"), F.col("text")])
    got = df.collect()
    assert len({(r.shard, r.slot) for r in got}) == 4
    assert len({r.shard for r in got if r.doc_id is None}) == 1 and len({r.shard for r in got if r.doc_id == 3}) == 1
    sharding.write(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
