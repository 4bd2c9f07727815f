import os
import random
import subprocess
import sys
import zlib
from functools import cache
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from runaudit.llm import packing, queries, token_files
from runaudit.llm.tokens import encoder

SF = "/root/testdata/sf0.01"
WORD, BYTE = (public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))


@cache
def plain(file, end):
    made = Tokenizer.from_file(file)
    return lambda t: np.array([*made.encode(t or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize(("file", "end"), [(WORD, 2), (BYTE, 1)])
def test_encoder_is_exact(file, end):
    rnd = random.Random(1)
    letters = "ab \n\t'sèΣ́漢字１٣ 　\r\x0b\x1c\x85!?…’ ll N<|endoftext|> ÉßµªİZ.,;"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(30))) for _ in range(4000)]
    texts += ["a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|> y.", "<|ENDOFTEXT|> z"]
    texts += ["", None, " ", "\n", "Don't stop, it's  fine.\nReally fine. ", "é" * 3000, "word " * 4000]
    for t in texts:
        assert encoder(file, end)(t) == plain(file, end)(t).tobytes(), t


def test_token_files(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want, at = {}, 0
    for r in docs.orderBy("doc_id").collect():
        ids = plain(WORD, 2)(r.text)
        want[r.doc_id] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op3_token_files(spark, SF).collect()}
    assert got == want
    path = str(tmp_path / "delta")
    token_files.write(docs, path, WORD, 2, delta=True)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.digest(spark, path).collect()} == want


def test_odd_token_files(spark, tmp_path):
    rows = [(None, "x"), (1, None), (1, None), (2, ""), (3, "long " * 9000)]
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "a"), WORD, 2)
    got = sorted(token_files.digest(spark, str(tmp_path / "a")).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 2), (1, 2, 1), (1, 3, 1), (2, 4, 1), (3, 5, 9001)]
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "b"), WORD, 2)
    assert token_files.digest(spark, str(tmp_path / "b")).count() == 0


def check_packing(rows, ids, length):
    held = {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert (len(part), zlib.crc32(part.tobytes()), r.doc_tokens) == (r.length, r.ids_crc32, len(ids[r.doc_id]))
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *accumulate(n for _, n in parts)][:-1] and sum(n for _, n in parts) <= length
    assert sorted(held) == list(range(len(held)))
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    assert set(pieces) == set(ids)
    for d, parts in pieces.items():
        parts.sort()
        assert [s for s, _ in parts] == [0, *accumulate(n for _, n in parts)][:-1] and sum(n for _, n in parts) == len(ids[d])
    return len(held), sum(map(len, ids.values()))


def test_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    ids = {r.doc_id: plain(BYTE, 1)(r.text) for r in docs}
    used, total = check_packing(queries.op10_packing(spark, SF).collect(), ids, 2048)
    assert used * 2048 <= 1.03 * total + 2048


def test_odd_packing(spark):
    rows = [(1, None, 9), (2, "", 9), (3, "word " * 2047, 9), (4, "word " * 5000, 9)] + [(10 + i, "a b c", 9) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset long")
    named = packing.pieces(df, BYTE, 1, 2048).selectExpr("*", "length _class", "start _rank", "start _b", "1 _off", "2 sequence_id", "length __b")
    again = packing.pack(named, 2048, [F.col("doc_id"), F.col("start")])
    assert {(r._class, r._rank, r._b, r._off) for r in again.collect()} == {(r.length, r.start, r.start, 1) for r in named.collect()}
    order = [F.col("doc_id"), F.col("start")]
    got = packing.pack(packing.pieces(df, BYTE, 1, 2048), 2048, order).collect()
    check_packing(got, {r[0]: plain(BYTE, 1)(r[1]) for r in rows}, 2048)
    twice = packing.pack(packing.pieces(df.union(df), BYTE, 1, 64), 64, order).collect()
    assert len({(r.sequence_id, r.offset) for r in twice}) == len(twice)
    assert packing.pack(packing.pieces(df.limit(0), BYTE, 1, 2048), 2048, order).count() == 0


def test_packing_is_the_same_with_any_threads(tmp_path):
    """The solver ends in time and gives one packing, whatever threads a linear algebra library has."""
    code = """
import hashlib
import numpy as np
from runaudit.llm import packing
rng = np.random.default_rng(4)
demand = np.bincount(np.minimum(255, rng.gamma(1.3, 40, 3000).astype(int)), minlength=256)
found = packing.rounded(demand, packing.column_generation(demand))
print(hashlib.sha256(repr([(c.tolist(), t) for c, t in found]).encode()).hexdigest())
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    said = []
    for threads in ("1", "8"):
        env = {**os.environ, "OPENBLAS_NUM_THREADS": threads, "OMP_NUM_THREADS": threads, "PYTHONPATH": root}
        said.append(subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=180, check=True).stdout)
    assert said[0] == said[1] and len(said[0].strip()) == 64


def test_inverse():
    a = np.random.default_rng(5).integers(0, 9, (40, 40)).astype(float)
    assert np.abs((packing.inverted(a)[:, :, None] * a[None]).sum(axis=1) - np.eye(40)).max() < 1e-8


def test_column_generation_meets_its_bound():
    demand = np.bincount(np.random.default_rng(3).integers(0, 64, 5000), minlength=64)
    patterns = packing.rounded(demand, packing.column_generation(demand))
    assert (sum(c * t for c, t in patterns) == demand).all()
    assert all((c * np.arange(1, 65)).sum() <= 64 for c, _ in patterns)
    assert sum(t for _, t in patterns) <= 1.01 * (demand @ np.arange(1, 65)) / 64 + 8
