"""Importance resampling towards trusted text.

A document's importance weight is the likelihood ratio of two hashed n-gram
models, target over raw. Adding Gumbel noise to the log weights and taking the
k largest draws k documents without replacement in proportion to the weights.
The noise is a hash of the document's key and the seed, so a lost task that runs
again draws the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runaudit.llm.common import stored
from runaudit.llm.grams import Ratio, fine

TEMPER = 200.0  # grams a text counts for: its mean log ratio times this is the log weight
DIGIT = 1 << 12


def gumbel(key: Column, seed: int) -> Column:
    """Standard Gumbel noise from a key."""
    unit = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(unit))


def kth_largest(df: DataFrame, value: str, k: int) -> int | None:
    """The k-th largest of a column of longs in 0..2^48-1, digit by digit: each
    pass counts one digit of 12 bits among the values that share the digits found
    so far, so the driver gets 4,096 counts at a time and no sort is needed."""
    found, left = 0, k
    for shift in (36, 24, 12, 0):
        digit = F.shiftright(F.col(value), shift) % DIGIT
        same = df.where(F.shiftright(F.col(value), shift + 12) == found)
        for d, n in sorted(same.groupBy(digit.alias("d")).count().collect(), reverse=True):
            if n >= left:
                found = found * DIGIT + d
                break
            left -= n
        else:
            return None
    return found


def resample(docs: DataFrame, target: DataFrame, k: int, text: str = "text", key: str = "doc_id", seed: int = 7) -> DataFrame:
    """Every document with `n_grams`, `log_ratio`, `log_weight`, `draw` (weight plus
    noise) and `kept`: whether it is among the k largest draws. Rows that tie with
    the k-th at 2^-24 of a unit are all kept. Texts without a gram (null, empty, shorter than
    one gram) have weight -infinity's stand-in, the least draw. With k beyond the
    number of rows all are kept; an empty table gives no rows.

    `target` holds trusted texts under the same column name.
    """
    ratio = Ratio.fit(docs, target, text)
    scored = ratio.score(docs, text, [key])
    weight = F.when(F.col("n_grams") == 0, F.lit(-4.0e6)).otherwise(F.col("log_ratio") * TEMPER)
    scored = scored.withColumn("log_weight", weight).withColumn("draw", F.col("log_weight") + gumbel(F.col(key), seed))
    whole = F.floor((F.col("draw") + F.lit(float(1 << 23))) * F.lit(float(1 << 24))).cast("long")
    scored = stored(scored.withColumn("_at", whole), "draws")
    cut = kth_largest(scored, "_at", k) if k > 0 else 1 << 62
    return scored.withColumn("kept", F.col("_at") >= F.lit(-1 if cut is None else cut)).drop("_at")


def fine_share(labels: DataFrame) -> float:
    """Share of fine labels; 1 without labels."""
    good, all_ = labels.agg(F.sum(fine().cast("int")), F.count(F.lit(1))).first()
    return (good or 0) / all_ if all_ else 1.0
