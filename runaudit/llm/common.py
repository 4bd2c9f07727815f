"""Helpers shared by the corpus operators.

Python runs only inside Spark tasks, on Arrow batches cut to a bounded size;
every text is handled whole. Words are maximal runs of bytes other than space
and 0x09-0x0D, which is what `bytes.split()` finds.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD_CACHE = 1 << 18  # words a task remembers the hash of; more only costs hashing them again
SLICE_BYTES = 1 << 20  # text handled at once; one longer text is a slice of its own

_ODD = np.uint64(0x9E3779B97F4A7C15)


def folder(spark: SparkSession) -> str:
    """The folder that all executors share. Only a local session without one
    gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="spark-llm-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spare(columns: Sequence[str], *names: str) -> list[str]:
    """Names that no column has (in any case): each as given, or with underscores before it."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def gapless(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str, blocks: int = 256) -> DataFrame:
    """0-based gapless number within keys. Rows are dealt to hashed blocks and
    numbered there, so that no key is a single task; a block's offset comes from
    the block counts, of which there are (number of keys) * blocks at most. Names of columns
    do not matter, but `out` is replaced."""
    df = df.drop(out)
    block, place, before_, count = spare([*df.columns, out], "_b", "_rn", "_off", "_n")
    keyed = df.withColumn(block, F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy(*keys, block).agg(F.count(F.lit(1)).alias(count))
    offsets = counts.select(*keys, block, F.coalesce(F.sum(count).over(before), F.lit(0)).alias(before_))
    local = Window.partitionBy(*keys, block).orderBy(*order)
    numbered = keyed.withColumn(place, F.row_number().over(local))
    return (
        numbered.join(offsets, [*keys, block])
        .withColumn(out, (F.col(before_) + F.col(place) - 1).cast("long"))
        .drop(block, place, before_)
    )


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about SLICE_BYTES of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.array([len(x.as_buffer() or b"") if x.is_valid else 0 for x in column.cast(pa.binary())])
        part = np.cumsum(sizes) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def utf8(batch: pa.RecordBatch, text: str) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    column = batch.column(batch.schema.get_field_index(text))
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """64-bit hash of a word as 8 bytes, remembered for the words seen lately."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= WORD_CACHE:
            self.clear()
        got = self[word] = xxhash.xxh3_64_digest(word)
        return got

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words one after another, and each text's number of words."""
        split = [t.split() for t in texts]
        n = np.fromiter(map(len, split), np.int64, len(split))
        joined = b"".join(b"".join(map(self.__getitem__, words)) for words in split)
        return np.frombuffer(joined, np.uint64), n


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of a 64-bit value over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(h: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Polynomial hash of each k consecutive values, by doubling; shorter by k - 1."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    power, size, total, done = np.uint64(base), 1, None, 0
    grown, low = h, np.uint64(1)
    n = len(h) - k + 1
    with np.errstate(over="ignore"):
        while True:
            if k & size:
                total = grown[done : done + n] if total is None else total * power + grown[done : done + n]
                done += size
            if done == k:
                return mix(total ^ low)
            grown = grown[:-size] * power + grown[size:]
            power = power * power
            size *= 2


def starts(n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of n words laid end to end: for every word, its text and its place
    there, and whether k words of the same text begin at it."""
    text = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return text, place, place + k <= n[text] if len(text) else np.zeros(0, bool)


def sliding(values: np.ndarray, w: int, least: bool = True) -> np.ndarray:
    """Minimum (or maximum) of each w consecutive values; shorter by w - 1."""
    f = np.minimum if least else np.maximum
    size, out = 1, values
    while size * 2 <= w:
        out = f(out[:-size], out[size:])
        size *= 2
    return f(out[: len(values) - w + 1], out[w - size : w - size + len(values) - w + 1])


def table(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)
