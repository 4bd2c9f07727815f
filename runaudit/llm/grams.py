"""Hashed n-gram models of target and raw text.

Text is cut to overlapping character 5-grams of its bytes, hashed into a fixed
number of buckets. Two multinomials over the buckets, one fitted on trusted
rows and one on the whole corpus, give each gram a log-likelihood ratio. The
bucket vectors have a fixed size, so sending them to every task is safe at any
corpus size, while their counts come from every gram of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runaudit.llm.common import slices, table, utf8

GRAM = 5
BUCKETS = 1 << 18
PASSAGE = 16  # grams over which a peak is taken: a word or two


def bucket_ids(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every gram of every text, end to end, and each text's number of
    grams. A text shorter than a gram has none."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
    n = np.maximum(size - GRAM + 1, 0)
    if len(data) < GRAM:
        return np.zeros(0, np.int64), n
    h = data[: len(data) - GRAM + 1].copy()
    for i in range(1, GRAM):
        h *= np.uint32(0x01000193)
        h += data[i : len(data) - GRAM + 1 + i]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h >>= np.uint32(32 - int(buckets).bit_length() + 1)
    first = np.cumsum(size) - size
    inside = np.zeros(len(data) + 1, np.int32)  # grams across two texts are left out
    np.add.at(inside, first[n > 0], 1)
    np.add.at(inside, (first + n)[n > 0], -1)
    return h[np.cumsum(inside[: len(h)]) > 0].astype(np.int64), n


def counts(docs: DataFrame, text: str) -> DataFrame:
    """(bucket, n) over the grams of all rows. Every task adds up what it reads
    and sends the buckets it has seen."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in slices(batches, text):
            total += np.bincount(bucket_ids(utf8(batch, text))[0], minlength=BUCKETS)
        seen = np.flatnonzero(total)
        yield table(bucket=seen, n=total[seen])

    return docs.select(text).mapInArrow(partial, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def vector(docs: DataFrame, text: str) -> np.ndarray:
    got, out = counts(docs, text).toPandas(), np.zeros(BUCKETS)  # BUCKETS rows at most
    out[got["bucket"].to_numpy(int)] = got["n"]
    return out


@dataclass(frozen=True)
class Ratio:
    """log p_target(bucket) - log p_raw(bucket) for every bucket."""

    weights: np.ndarray

    @staticmethod
    def fit(raw: DataFrame, target: DataFrame, text: str, prior: float = 1.0) -> Ratio:
        """Both models share a prior: `prior` grams a bucket, spread as in the raw
        corpus. Without any target gram all weights are 0."""
        corpus, trusted = vector(raw, text), vector(target, text)
        if not trusted.sum() or not corpus.sum():
            return Ratio(np.zeros(BUCKETS, np.float32))
        share = trusted.sum() / corpus.sum()
        smooth = (trusted + prior * share) / (corpus + prior)
        return Ratio(np.log(smooth / share).astype(np.float32))

    def means(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's number of grams and mean log ratio (0 without any)."""
        ids, n = bucket_ids(texts)
        return n, self.mean_of(ids, n)

    def mean_of(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.weights[ids], dtype=np.float64)])
        end = np.cumsum(n)
        return np.round((total[end] - total[end - n]) / np.maximum(n, 1), 9)

    def peak_of(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Each text's largest mean log ratio over PASSAGE consecutive grams, or over all
        it has if fewer (0 without any). Sums are whole numbers, so equal texts have equal peaks."""
        total = np.concatenate([[0], np.cumsum(np.round(self.weights * 65536.0).astype(np.int64)[ids])])
        end = np.cumsum(n)
        out = (total[end] - total[end - n]) / np.maximum(n, 1)
        long = n >= PASSAGE
        if long.any():
            sums = np.append(total[PASSAGE:] - total[:-PASSAGE], 0)
            cuts = np.stack([(end - n)[long], end[long] - PASSAGE + 1], axis=1).ravel()
            out[long] = np.maximum.reduceat(sums, cuts)[::2] / PASSAGE
        return out / 65536.0

    def score(self, docs: DataFrame, text: str, keep: list[str], peak: bool = False) -> DataFrame:
        """`keep` columns, `n_grams` and `log_ratio`, the mean or the peak."""
        sent = docs.sparkSession.sparkContext.broadcast(self)  # BUCKETS floats

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text):
                ids, n = bucket_ids(utf8(batch, text))
                found = sent.value.peak_of(ids, n) if peak else sent.value.mean_of(ids, n)
                yield table(**{c: batch.column(batch.schema.get_field_index(c)) for c in keep}, n_grams=n, log_ratio=found)

        out = docs.select(*keep).schema.add("n_grams", "long").add("log_ratio", "double")
        return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(scored, out)


def labelled(docs: DataFrame, labels: DataFrame, text: str, key: str = "doc_id", bound: int = 1 << 16) -> DataFrame:
    """(text, _good, _low, _toxic, _held) of labelled rows: _good is true where every label
    of the key is fine (quality 1, not toxic), _low and _toxic where one is of low quality or toxic, _held for a quarter of the keys, on which no
    model is fitted. At most `bound` keys are taken, those with the
    least hash, so they can be sent to every task and no text is shuffled."""
    some = said(labels, key).orderBy(F.xxhash64(key), key).limit(bound)
    return docs.select(key, text).join(F.broadcast(some), key).select(text, "_good", "_low", "_toxic", "_held")


def said(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, _good, _low, _toxic, _held) of every labelled key."""
    held = (F.pmod(F.xxhash64(F.lit("held"), key), F.lit(4)) == 0).alias("_held")
    flags = [F.min(fine()).alias("_good"), F.max(low()).alias("_low"), F.max(toxic()).alias("_toxic")]
    return labels.where(F.col(key).isNotNull()).groupBy(key).agg(*flags).select("*", held)


def low() -> Column:
    return F.coalesce(F.col("quality"), F.lit(0)) != 1


def toxic() -> Column:
    return F.coalesce(F.col("toxic"), F.lit(0)) != 0


def fine() -> Column:
    return ~low() & ~toxic()
