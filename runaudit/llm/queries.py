"""The corpus operators over their whole tables, as registered queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runaudit.llm import (
    decontaminate, grams, line_dedup, minhash, packing, periodic, pieces, quality_classifier, quality_rules, rlz, sharding,
    suffix_array, token_files, turns,
)
from runaudit.llm.common import folder, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards by its doc_id."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = load(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(raw) + F.lit(16)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    return sharding.assign(rows, "doc_id", 40, order).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


@query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents drawn on; as large a share is kept as labels call fine."""
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    k = round(docs.count() * quality_classifier.fine_share(labels))
    target = grams.labelled(docs, labels, "text").where("_good")
    return quality_classifier.resample(docs, target, k)


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality_rules.judge(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token files, read back."""
    path = f"{folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write(load(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end=2)
    return token_files.digest(spark, path)


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2,048 ids."""
    file = public_tokenizers.path("byte_bpe_50k.json")
    cut = packing.pieces(load(spark, sf_dir, "documents"), file, end=1, length=2048)
    return packing.pack(cut, 2048, [F.col("doc_id"), F.col("start"), F.col("ids_crc32")]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


@query
def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingles are alike to 85 %."""
    return minhash.near_duplicates(load(spark, sf_dir, "documents"), percent=85)


@query
def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document holds too."""
    found = suffix_array.repeated_spans(load(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), "start", "n_words", F.col("source").alias("source_doc_id"))


@query
def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without windows of earlier ones."""
    return rlz.parse(load(spark, sf_dir, "documents")).select(
        F.col("doc").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256")
    )


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without runs of three lines, or of 50 words, that were there before."""
    return line_dedup.dedup_lines(load(spark, sf_dir, "documents"), min_words=50).select(
        "doc_id", "n_lines", "n_deleted", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


SQL["op9_line_dedup"] = r"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS j
  FROM documents
), lines AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY j) AS i
  FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), runs AS (
  SELECT doc_id, i, j, line AS a, lead(line) OVER w AS b, lead(line, 2) OVER w AS c, lead(j) OVER w AS last2, lead(j, 2) OVER w AS last,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS wa, len(regexp_extract_all(lead(line) OVER w, '[^\x20\x09-\x0D]+')) AS wb
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY j)
), firsts AS (
  SELECT doc_id, i, j, last, first_value(doc_id) OVER w AS fd, first_value(i) OVER w AS fi
  FROM runs WHERE last IS NOT NULL WINDOW w AS (PARTITION BY a, b, c ORDER BY doc_id, i)
  UNION ALL
  SELECT doc_id, i, j, last2, first_value(doc_id) OVER w, first_value(i) OVER w
  FROM runs WHERE last2 IS NOT NULL AND wa + wb >= 50 WINDOW w AS (PARTITION BY a, b ORDER BY doc_id, i)
  UNION ALL
  SELECT doc_id, i, j, j, first_value(doc_id) OVER w, first_value(i) OVER w
  FROM runs WHERE wa >= 50 WINDOW w AS (PARTITION BY a ORDER BY doc_id, i)
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(j, last)) AS j
  FROM firsts WHERE fd < doc_id OR (fd = doc_id AND fi < i)
)
SELECT doc_id, count(*) FILTER (regexp_matches(line, '[^\x20\x09-\x0D]')) AS n_lines,
       count(*) FILTER (gone.j IS NOT NULL AND regexp_matches(line, '[^\x20\x09-\x0D]')) AS n_deleted,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY raw.j) FILTER (gone.j IS NULL), '')) AS kept_sha256
FROM raw LEFT JOIN gone USING (doc_id, j) GROUP BY doc_id
"""


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents, up to a fifth of their words edited."""
    return decontaminate.matches(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged, with the cheapest edits that put it right."""
    rows = load(spark, sf_dir, "conversations")
    summary, left = turns.repair(turns.damage(rows))
    sums = turns.digests(left).withColumnRenamed("conv", "_c")
    known = rows.select("conv_id").distinct()
    found = known.join(summary, F.col("conv_id").eqNullSafe(F.col("conv")), "left").join(sums, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return found.select(
        "conv_id",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


@query
def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces and back again."""
    file = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.encode(load(spark, sf_dir, "documents"), file, decoded=True).select(
        "doc_id", "n_tokens", "n_bytes", F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("spanned_bytes"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every document, and what is left without them."""
    found = periodic.collapse(periodic.plant(load(spark, sf_dir, "documents")))
    best = F.col("strongest")
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select(
        "doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"),
        *(best[c].alias(c) for c in ("start", "length", "period")),
        F.expr("(1000 * strongest.length) div strongest.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
