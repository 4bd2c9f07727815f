import hashlib
import os
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from runaudit.llm import pieces, queries

SF = "/root/testdata/sf0.01"
FILE = public_tokenizers.path("piece_bpe_32k.model")
MAPS = os.path.join(os.path.dirname(sentencepiece.__file__), "package_data")
ALPHABET = "abc  \t\n▁ﬁⅣ１é́̈日本語ｶﾞ\x00　\xa0€😀ﷺ-</s><unk>0123ÅΩ"


def variant(charmap, prefix, trim, by_bytes):
    """The public model with another normaliser, which a file on disk need not have."""
    spec = sentencepiece_model_pb2.ModelProto()
    with open(FILE, "rb") as f:
        spec.ParseFromString(f.read())
    if charmap:
        with open(os.path.join(MAPS, charmap), "rb") as f:
            spec.normalizer_spec.precompiled_charsmap = f.read()
    spec.normalizer_spec.add_dummy_prefix, spec.normalizer_spec.remove_extra_whitespaces = prefix, trim
    if not by_bytes:
        spec.trainer_spec.byte_fallback = False
        kept = [p for p in spec.pieces if p.type != pieces.BYTE]
        del spec.pieces[:]
        spec.pieces.extend(kept)
    return spec.SerializeToString()


@pytest.mark.parametrize(
    "config",
    [(None, True, False, True), ("nfkc.bin", True, True, True), ("nmt_nfkc_cf.bin", True, True, True), ("nmt_nfkc.bin", False, False, True),
     ("nfkc_cf.bin", True, True, False), (None, False, True, False)],
)
def test_against_the_library(config):
    raw = variant(*config)
    library, ours = sentencepiece.SentencePieceProcessor(model_proto=raw), pieces.Model(raw)
    rng = random.Random(3)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    for text, (ids, spans) in zip(texts, ours.encode(texts), strict=True):
        want = library.encode(text, return_type="proto")
        assert ids.tolist() == [p.id for p in want.pieces]
        assert [tuple(x) for x in spans.tolist()] == [(p.begin, p.end) for p in want.pieces]
        assert ours.decode(ids.astype(np.int64)) == library.decode(ids.tolist())
    for _ in range(1500):  # ids that no text has
        ids = [rng.choice([rng.randrange(300), rng.randrange(len(ours.surface))]) for _ in range(rng.randint(0, 8))]
        assert ours.decode(np.array(ids, np.int64)) == library.decode(ids)


def test_longest_prefix():
    """Source strings of the map of one to several characters, each replaced whole."""
    with open(os.path.join(MAPS, "nfkc.bin"), "rb") as f:
        chars = pieces.CharMap(f.read())
    got = list(chars.prefixes("aﬁＡ́ｶﾞx"))
    assert [(new.decode(), taken) for new, taken in got] == [("a", 1), ("fi", 3), ("\xc1", 5), ("ガ", 6), ("x", 1)]


def test_forgotten_parts(monkeypatch):
    monkeypatch.setattr(pieces, "PARTS", 5)
    monkeypatch.setattr(pieces, "BATCH", 3)
    with open(FILE, "rb") as f:
        ours = pieces.Model(f.read())
    library = sentencepiece.SentencePieceProcessor(model_file=FILE)
    texts = [f"one two three {i} four five {i * 7} six seven eight one two {i + 1}" for i in range(30)]
    assert [ids.tolist() for ids, _ in ours.encode(texts)] == [library.encode(t) for t in texts]
    assert [ids.tolist() for ids, _ in ours.encode(texts[::-1])] == [library.encode(t) for t in texts[::-1]]


def test_documents(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=FILE)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op12_sentencepiece(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        text = texts[r.doc_id] or ""
        ids = library.encode(text)
        assert (r.n_tokens, r.spanned_bytes) == (len(ids), len(text.encode()))
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_rows(spark):
    long = "wörd " * 200_000 + "x" * 5000
    rows = [(None, None, 1), (1, "", 2), (2, "a", 3), (2, "a", 3), (None, "  \n", 4), (3, long, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    library = sentencepiece.SentencePieceProcessor(model_file=FILE)
    encoded = pieces.encode(docs, FILE)
    got = encoded.collect()
    assert sorted((r.doc_id or 0, r.n_tokens, tuple(r.ids)) for r in got) == sorted(
        (d or 0, len(library.encode(t or "")), tuple(library.encode(t or ""))) for d, t, _ in rows
    )
    back = pieces.decode(encoded, FILE, ["doc_id"]).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in back) == sorted((d or 0, t or "") for d, t, _ in rows)
    assert pieces.encode(docs.where("doc_id > 9"), FILE).count() == 0
