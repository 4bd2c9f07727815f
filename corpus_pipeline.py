"""A corpus made ready for training: five stages over `documents`.

Every stage takes what its predecessor kept, whole, and all but the last return
the columns of `documents`. Null and empty texts fail the quality rules, so later
stages see them only if called by themselves; each says in its operator's
docstring what it does with them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runaudit.llm import decontaminate, line_dedup, minhash, packing, quality_rules
from runaudit.llm.common import load, stored

SEQUENCE = 2048
MIN_WORDS = 50  # a repeated run of so many words goes, however few its lines


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and the likelihood-ratio test. Repeated rows are judged alike."""
    judged = quality_rules.judge(docs, load(spark, sf_dir, "labels"), keep=tuple(docs.columns))
    return judged.where("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated runs of three lines or 50 words; `n_chars` counts what is left. One
    whose every line was there before goes. Repeated rows are one text, and all stay."""
    left = line_dedup.dedup_lines(docs, min_words=MIN_WORDS).where("n_deleted = 0 or n_deleted < n_lines")
    changed = F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", changed).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each group of near-duplicates. Of rows equal in doc_id and text one
    stays; only rows whose doc_id is found twice are compared for that."""
    gone = minhash.near_duplicates(docs, percent=80).where("not kept").select("doc_id")
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = stored(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "repeated")
    if again.isEmpty():
        return kept
    once = kept.join(again, "doc_id", "left_anti").select(*docs.columns)
    return once.unionByName(kept.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Repeated rows are judged alike."""
    return decontaminate.clean(docs, load(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its place in a sequence; repeated rows have places of their own."""
    file = public_tokenizers.path("byte_bpe_50k.json")
    cut = packing.pieces(docs, file, end=1, length=SEQUENCE)
    return packing.pack(cut, SEQUENCE, [F.col("doc_id"), F.col("start"), F.col("ids_crc32")])


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("minhash", near),
    ("decontaminate", benchmark),
    ("packing", pack),
]

ORACLE_SQL = None  # tokenizer, models and edit distances are beyond SQL; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def statements() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
