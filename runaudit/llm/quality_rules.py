"""Quality rules: plain counts of a text and two likelihood-ratio tests.

Every document gets the mean log-likelihood ratio of its hashed n-grams between
a trusted-target and a raw-corpus multinomial, and is kept at or above one
threshold. Toxic texts are like fine ones but for a few words, which a mean over the
whole text drowns: a second ratio, of rows labelled toxic to labelled rows fine or toxic, is
taken where it is largest over a short passage, and must not exceed a threshold of its own.
Both thresholds come from labelled rows that no model has seen: over a histogram of their
scores, the cut that best parts rows labelled fine from those of low quality, or from toxic ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runaudit.llm.common import WordHashes, rolling, slices, starts, stored, table, utf8
from runaudit.llm.grams import Ratio, bucket_ids, labelled, said

BINS = 8192  # of the scores of labelled rows, over -SPAN..SPAN
SPAN = 4.0
TOXIC_SPAN = 16.0
TOXIC_PRIOR = 10.0  # grams a bucket; with fewer, one rare word of one toxic row looks like a mark
CLEAN_WEIGHT = 4.0  # a clean row lost counts as much as so many bad rows kept
TOXIC_CLEAN_WEIGHT = 8.0  # the same for toxic rows, which are few: one of them must not outweigh several clean ones
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOLS = re.compile(rb"[#*$%&|<>]")
_CONTINUATION = bytes(range(0x80, 0xC0))


def repeated_words(hashes: np.ndarray, n: np.ndarray, width: int = 3) -> np.ndarray:
    """Per text, the words that lie in a window of `width` words found twice or
    more in that text."""
    text, _, begins = starts(n, width)
    at = np.flatnonzero(begins)
    if not len(at):
        return np.zeros(len(n), np.int64)
    grams = rolling(hashes, width)[at]
    order = np.lexsort((grams, text[at]))
    same = (grams[order][1:] == grams[order][:-1]) & (text[at][order][1:] == text[at][order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(hashes), bool)
    for i in range(width):
        covered[at[twice] + i] = True
    return np.bincount(text[covered], minlength=len(n))


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def measures(docs: DataFrame, ratio: Ratio, toxic: Ratio, text: str, keep: list[str]) -> DataFrame:
    """`keep` columns, the counts of each whole text and its `log_ratio` and
    `toxic_ratio`; null text is empty."""
    sent = docs.sparkSession.sparkContext.broadcast((ratio, toxic))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in slices(batches, text):
            texts = utf8(batch, text)
            hashes, n = known.of(texts)
            grams = bucket_ids(texts)
            spaces = [len(t) - len(t.translate(None, b" \t\n\v\f\r")) for t in texts]
            points = [len(t.translate(None, _CONTINUATION)) for t in texts]
            yield table(
                **{c: batch.column(batch.schema.get_field_index(c)) for c in keep},
                n_words=n,
                word_chars=np.array(points, np.int64) - np.array(spaces, np.int64),
                n_symbols=np.array([len(_SYMBOLS.findall(t)) for t in texts], np.int64),
                n_dup_lines=np.array([duplicate_lines(t) for t in texts], np.int64),
                n_repeat_words=repeated_words(hashes, n),
                log_ratio=sent.value[0].mean_of(*grams),
                toxic_ratio=sent.value[1].peak_of(*grams),
            )

    out = docs.select(*keep).schema
    for c in COUNTS:
        out = out.add(c, "long")
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(measured, out.add("log_ratio", "double").add("toxic_ratio", "double"))


def threshold(scored: DataFrame, span: float = SPAN, weight: float = CLEAN_WEIGHT) -> float:
    """The cut on `log_ratio` that loses fewest rows labelled `_good`, each
    counted `weight` times, and lets fewest others through, by share. Keeps
    everything where one of the two labels is missing."""
    step = 2 * span / BINS
    bins = F.least(F.greatest(F.floor((F.col("log_ratio") + span) / step), F.lit(0)), F.lit(BINS - 1))
    got = scored.groupBy(bins.alias("bin"), "_good").count().toPandas()  # 2 * BINS rows at most
    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for at, counted in ((good, got[got["_good"].astype(bool)]), (bad, got[~got["_good"].astype(bool)])):
        np.add.at(at, counted["bin"].to_numpy(int) + 1, counted["count"])
    if not good.sum() or not bad.sum():
        return float("-inf")
    lost, through = np.cumsum(good) / good.sum(), 1 - np.cumsum(bad) / bad.sum()
    cost = weight * lost + through
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    return float(best[len(best) // 2] * step - span)  # the middle of a flat stretch


def ratios(docs: DataFrame, ratio: Ratio, toxic: Ratio, text: str, key: str) -> DataFrame:
    """(key, log_ratio, toxic_ratio) of every row: what thresholds are taken from, without its text."""
    sent = docs.sparkSession.sparkContext.broadcast((ratio, toxic))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            grams = bucket_ids(utf8(batch, text))
            yield table(**{key: batch.column(0)}, log_ratio=sent.value[0].mean_of(*grams), toxic_ratio=sent.value[1].peak_of(*grams))

    return docs.select(key, text).mapInArrow(scored, docs.select(key).schema.add("log_ratio", "double").add("toxic_ratio", "double"))


def judge(
    docs: DataFrame, labels: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), key: str = "doc_id", bound: int = 1 << 16
) -> DataFrame:
    """Counts, `log_ratio`, `toxic_ratio`, `base_failed` and `kept` of each document, beside the
    columns `keep`; of those, columns with the names of the counts are replaced.

    A text fails the base rules with fewer than 50 words, or more than half of its
    words in repeated windows; null and empty texts fail. Equal texts get equal
    verdicts. Without usable labels only the base rules decide. An empty table
    gives no rows. The models are fitted on `bound` labelled keys at most; the thresholds
    come from all labelled rows that are held from them.
    """
    some = labelled(docs, labels, text, key, bound)
    ratio = Ratio.fit(docs, some.where("_good and not _held"), text)
    toxic = Ratio.fit(some.where("(_good or _toxic) and not _held"), some.where("_toxic and not _held"), text, TOXIC_PRIOR)
    scored = ratios(docs.where(F.col(key).isNotNull()), ratio, toxic, text, key)
    held = stored(scored.join(said(labels, key).where("_held"), key).select("_good", "_low", "_toxic", "log_ratio", "toxic_ratio"), "held")
    cut = threshold(held.where("_good or _low"))
    marked = held.where("_good or _toxic").select("_good", (-F.col("toxic_ratio")).alias("log_ratio"))
    toxic_cut = -threshold(marked, TOXIC_SPAN, TOXIC_CLEAN_WEIGHT)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        measures(docs, ratio, toxic, text, [c for c in keep if c not in (*COUNTS, "log_ratio", "toxic_ratio")])
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= F.lit(cut)) & (F.col("toxic_ratio") <= F.lit(toxic_cut)))
    )
