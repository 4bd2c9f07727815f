"""Token ids as Parquet list columns.

Documents are laid out by range of their id, one sorted range to a file, with
the ids as a list column and `doc_id`, `n_tokens` beside it. Ids of a vocabulary
below 2^16 are dictionary coded; for larger ones the delta encoding of writer
version 2 can be chosen. Row groups and pages are small enough that the page
index leads a reader with a filter on `doc_id`, or one that reads only
`n_tokens`, to the few pages it needs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runaudit.llm.common import slices
from runaudit.llm.tokens import encoder, lists, texts

ROW_GROUP = 32 << 20  # bytes
PAGE_ROWS = 512


def encode(docs: DataFrame, file: str, end: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids) of each whole text; null text is empty."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(file, end)
        for batch in slices(batches, text):
            rows = [ids_of(t) for t in texts(batch, text)]
            n = pa.array(np.fromiter((len(x) // 4 for x in rows), np.int64, len(rows)))
            yield pa.RecordBatch.from_arrays([batch.column(0), n, lists(rows)], names=[key, "n_tokens", "ids"])

    schema = docs.select(key).schema.add("n_tokens", "long").add("ids", T.ArrayType(T.IntegerType()))
    return docs.select(key, text).mapInArrow(encoded, schema)


def write(
    docs: DataFrame, path: str, file: str, end: int, text: str = "text", key: str = "doc_id", delta: bool = False
) -> None:
    """Write the files, in ascending order of `key`, null first. Rows with equal keys are in
    the order of their texts' hash. An empty table gives a readable empty one."""
    order = [F.col(key), F.xxhash64(text)]
    ranged = docs.select(key, text).repartitionByRange(*order).sortWithinPartitions(*order)
    (
        encode(ranged, file, end, text, key)
        .write.option("parquet.block.size", ROW_GROUP)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.enable.dictionary", not delta)
        .option("parquet.writer.version", "v2" if delta else "v1")
        .option("compression", "zstd")
        .parquet(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def offsets(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, start): ids of all documents before it, from the key and
    count columns alone. A file is one range of keys, so its rows are summed in
    place and the files' totals, one row each, give the offsets."""
    rows = read(spark, path).select(
        key, "n_tokens", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")
    )
    files = rows.groupBy("_file").agg(F.sum("n_tokens").alias("_sum"), F.min(key).alias("_a"), F.max(key).alias("_z"))
    before = Window.orderBy("_a", "_z", "_file").rowsBetween(Window.unboundedPreceding, -1)
    at = files.select("_file", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_file").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(at, "_file")
        .select(key, "n_tokens", (F.col("_off") + F.col("_in")).alias("start"), "_file", "_row")
    )


def checksums(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_crc32, _file, _row) from the ids read back."""
    rows = read(spark, path).select(
        key, "ids", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")
    )

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1)
            ends, values = ids.offsets.to_numpy().astype(np.int64), ids.values.to_numpy().astype("<u4")
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(ends)), pa.array(crc, pa.int64()), batch.column(2), batch.column(3)],
                names=[key, "n_tokens", "ids_crc32", "_file", "_row"],
            )

    kept = rows.select(key).schema.add("n_tokens", "long").add("ids_crc32", "long").add("_file", "string").add("_row", "long")
    return rows.mapInArrow(summed, kept)


def digest(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Per document of the files: its place in the stream of all ids, its length
    and the checksum of its ids, all read back."""
    at = offsets(spark, path, key).select("_file", "_row", "start")
    return checksums(spark, path, key).join(at, ["_file", "_row"]).select(key, "start", "n_tokens", "ids_crc32")
