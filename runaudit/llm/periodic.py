"""Periodic runs of words by multi-scale minimizers.

A run is a stretch of words with smallest period q, long enough to hold PERIODS
of them, that no neighbour extends. Periods up to DIRECT are too short for
sampling: the text is compared with itself at each such lag. The longer ones are
dealt to scales of periods s..t-1, t = 3s/2. At a scale, the grams of t-1 words
are hashed, and those that are the least of some window of grams are marked. A
gram there covers a whole period, so inside a run it recurs at the period and no
sooner; a window with its gram covers 2s words at most, so in three periods it
recurs whole, and marks the same place. Neighbouring marks of one gram
whose distance lies in the scale are thus seeds for every run of it. A seed is
extended left and right as long as words one distance apart agree, which gives
the run exactly; a stretch found with a multiple of its period is found with the
period too, and the smaller one is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runaudit.llm.common import WordHashes, rolling, slices, sliding, table, utf8

WORDS, PERIODS = 24, 3  # a run has so many words and so many periods at least
DIRECT = 15  # longest period that is found by comparing at its lag
BLOCK = 64  # words of the first comparison of an extension


def scales(longest: int) -> Iterator[tuple[int, int]]:
    """(s, t): periods s..t-1 that a text of `longest` words can hold PERIODS times."""
    s = DIRECT + 1
    while PERIODS * s <= longest:
        yield s, s + s // 2
        s += s // 2


def long_enough(length: np.ndarray, period: np.ndarray | int) -> np.ndarray:
    return length >= np.maximum(WORDS, PERIODS * period)


def lag_runs(x: np.ndarray, q: int) -> np.ndarray:
    """(start, length, q) of the stretches in which words q apart agree."""
    same = np.flatnonzero(x[:-q] == x[q:])
    cut = np.flatnonzero(np.diff(same) != 1) + 1
    a, z = same[np.concatenate([[0], cut])[: len(same)]], same[np.concatenate([cut, [len(same)]])[: len(same)] - 1]
    length = z - a + 1 + q
    got = np.stack([a, length, np.full(len(a), q)], axis=1)
    return got[long_enough(length, q)]


def seeds(x: np.ndarray, s: int, t: int) -> np.ndarray:
    """(distance, place) of neighbouring equal minimizers whose distance is in s..t-1."""
    size = t - 1
    width = 2 * s - size + 1
    grams = rolling(x, size)
    if len(grams) < width:
        return np.zeros((0, 2), np.int64)
    pad = np.zeros(width - 1, np.uint64)
    least = np.concatenate([pad, sliding(grams, width), pad])
    place = np.flatnonzero(grams == sliding(least, width, least=False))
    gram = grams[place]
    order = np.argsort(gram, kind="stable")
    place, gram = place[order], gram[order]
    distance = np.diff(place)
    near = (gram[1:] == gram[:-1]) & (distance >= s) & (distance < t)
    return np.stack([distance[near], place[:-1][near]], axis=1)


def agreeing(x: np.ndarray, at: int, d: int) -> tuple[int, int]:
    """The widest lo..hi around `at` in which every word equals the one d later."""
    hi, size = at, BLOCK
    while True:
        one, two = x[hi : hi + size], x[hi + d : hi + d + size]
        unlike = np.flatnonzero(one[: len(two)] != two)
        if len(unlike):
            hi += int(unlike[0])
            break
        hi += len(two)
        if len(two) < size:
            break
        size *= 2
    lo, size = at, BLOCK
    while lo:
        a = max(0, lo - size)
        unlike = np.flatnonzero(x[a:lo] != x[a + d : lo + d])
        if len(unlike):
            lo = a + int(unlike[-1]) + 1
            break
        lo, size = a, size * 2
    return lo, hi


def seed_runs(x: np.ndarray, s: int, t: int) -> np.ndarray:
    """(start, length, period) of the stretches around the seeds of a scale."""
    found = seeds(x, s, t)
    out, done = [], (0, -1)  # distance, and where its last stretch ends
    for d, at in found[np.lexsort((found[:, 1], found[:, 0]))].tolist():
        if done[0] == d and at < done[1]:
            continue
        lo, hi = agreeing(x, at, d)
        done = d, hi
        if hi + d - lo >= max(WORDS, PERIODS * d):
            out.append((lo, hi + d - lo, d))
    return np.array(out, np.int64).reshape(-1, 3)


def runs(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(text, start, length, period) of all runs of texts of n words laid end to end,
    in order of text, start and period."""
    x = np.empty(len(hashes) + len(n), np.uint64)
    ends = np.cumsum(n + 1)
    first = ends - n - 1
    x[ends - 1] = np.arange(len(n), dtype=np.uint64) * np.uint64(2)  # no word, and not twice the same
    inside = np.ones(len(x), bool)
    inside[ends - 1] = False
    x[inside] = hashes | np.uint64(1)
    found = [lag_runs(x, q) for q in range(1, min(DIRECT, len(x) - 1) + 1)]
    origin, size = np.arange(len(x)), np.repeat(n, n + 1)
    for s, t in scales(int(n.max(initial=0))):
        wide = size >= PERIODS * s
        x, origin, size = x[wide], origin[wide], size[wide]
        got = seed_runs(x, s, t)
        got[:, 0] = origin[got[:, 0]]
        found.append(got)
    all_ = np.concatenate([np.zeros((0, 3), np.int64), *found])
    all_ = all_[np.lexsort((all_[:, 2], all_[:, 1], all_[:, 0]))]
    again = np.zeros(len(all_), bool)
    again[1:] = (all_[1:, :2] == all_[:-1, :2]).all(axis=1)  # the same stretch with a larger period
    all_ = all_[~again]
    text = np.searchsorted(first, all_[:, 0], "right") - 1
    all_ = np.column_stack([text, all_[:, 0] - first[text], all_[:, 1:]])
    return all_[np.lexsort((all_[:, 3], all_[:, 1], all_[:, 0]))]


def strongest(found: np.ndarray) -> int | None:
    """Row of the (start, length, period) with the greatest length / period, the first
    by start and period of equal ones."""
    best = None
    for i, (_, length, period) in enumerate(found.tolist()):
        if best is None or length * best[2] > best[1] * period:
            best = i, length, period
    return best and best[0]


RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def collapse(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, runs, strongest, collapsed) for every row of `docs`.

    `runs` lists every maximal run of WORDS words and PERIODS periods or more as
    (start, length, period) by start, then period; `strongest` is the one with the most
    periods (ties: least start, then period; null without runs); `collapsed` is the
    text's words joined by one space, without those a run holds after its first period.
    Null and empty texts have no words. Every row stands for itself, so repeated rows
    and null keys give rows alike. A text is handled whole. An empty table gives no
    rows; other columns are not read.
    """

    def collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in slices(batches, text):
            raw = utf8(batch, text)
            hashes, n = known.of(raw)
            found = runs(hashes, n)
            cuts = np.searchsorted(found[:, 0], np.arange(len(n) + 1))
            change = np.zeros(len(hashes) + 1, np.int64)
            begin = (np.cumsum(n) - n)[found[:, 0]] + found[:, 1]
            np.add.at(change, begin + found[:, 3], 1)
            np.add.at(change, begin + found[:, 2], -1)
            dropped = np.cumsum(change[:-1]) > 0
            rows, best, left, at = [], [], [], 0
            for i, one in enumerate(raw):
                words = one.split()
                gone = dropped[at : at + len(words)]
                at += len(words)
                mine = found[cuts[i] : cuts[i + 1], 1:]
                rows.append([dict(zip(RUN.names, r, strict=True)) for r in mine.tolist()])
                top = strongest(mine)
                best.append(None if top is None else rows[-1][top])
                if len(mine):
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                left.append(b" ".join(words).decode())
            entry = pa.struct([(c, pa.int64()) for c in RUN.names])
            yield table(
                **{key: batch.column(0)},
                n_words=n,
                runs=pa.array(rows, pa.list_(entry)),
                strongest=pa.array(best, entry),
                collapsed=pa.array(left, pa.string()),
            )

    schema = docs.select(key).schema.add("n_words", "long").add("runs", T.ArrayType(RUN)).add("strongest", RUN).add("collapsed", "string")
    return docs.select(key, text).mapInArrow(collapsed, schema)


def plant(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, text): texts as they are, but a run laid into those whose key's crc32 is a
    multiple of 10, from a word that the crc32 gives on to the end, with a period that it
    gives too. A null key counts as the empty string."""

    def planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            out = []
            for raw, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = (raw or "").encode().split() if h % 10 == 0 else []
                if words:
                    g, n = h // 10, len(words)
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    raw = b" ".join(words[:a] + [words[a + i % p] for i in range(n - a)]).decode()
                out.append(raw)
            yield table(**{key: batch.column(0), text: pa.array(out, pa.string())})

    hashed = docs.select(key, text, F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")).alias("_crc"))
    return hashed.mapInArrow(planted, docs.select(key, text).schema)
