"""Packing of token pieces by column generation for the cutting-stock problem.

A document's ids are cut into full sequences and a remainder. Remainders are
rounded up to classes of UNIT tokens, and the class histogram, whose size does
not depend on the corpus, is the demand of a linear program over patterns: ways
to fill one sequence. The program starts from one-class patterns; its dual
prices go into a knapsack dynamic program that finds the pattern worth most;
while one is worth more than a sequence, it joins the program. The solution is
rounded down, the few pieces left over are packed first-fit-decreasing, and the
ranked pieces of each class take their places in the patterns.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runaudit.llm.common import gapless, slices, spare, stored
from runaudit.llm.tokens import encoder, texts

UNIT = 8  # tokens; a piece wastes fewer than this by rounding
GAP = 1e-3  # generation stops when this close to a bound on the optimum
_EPS = 1e-9


def pieces(docs: DataFrame, file: str, end: int, length: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece: (key, start, length, ids_crc32, doc_tokens). A document
    of n ids with the end id gives n // length full pieces and the remainder; null text
    has the end id alone."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(file, end)
        for batch in slices(batches, text):
            rows = [ids_of(t) for t in texts(batch, text)]
            at, start, size, crc, total = [], [], [], [], []
            for i, ids in enumerate(rows):
                for a in range(0, len(ids), 4 * length):
                    part = ids[a : a + 4 * length]
                    at.append(i)
                    start.append(a // 4)
                    size.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(len(ids) // 4)
            columns = [batch.column(0).take(pa.array(at, pa.int64()))]
            columns += [pa.array(x, pa.int64()) for x in (start, size, crc, total)]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "start", "length", "ids_crc32", "doc_tokens"])

    schema = docs.select(key).schema
    for c in ("start", "length", "ids_crc32", "doc_tokens"):
        schema = schema.add(c, "long")
    return docs.select(key, text).mapInArrow(cut, schema)


def best_pattern(value: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack over classes 1..room of size 1..room: the counts of the
    most valuable filling, by dynamic programming over the room used."""
    best = np.zeros(room + 1)
    took = np.zeros(room + 1, np.int64)
    size = np.arange(1, room + 1)
    for r in range(1, room + 1):
        worth = value[:r] + best[r - size[:r]]
        k = int(np.argmax(worth))
        if worth[k] > best[r - 1] + _EPS:
            best[r], took[r] = worth[k], k + 1
        else:
            best[r] = best[r - 1]
    counts, r = np.zeros(room, np.int64), room
    while r > 0:
        if took[r]:
            counts[took[r] - 1] += 1
            r -= took[r]
        else:
            r -= 1
    return float(best[room]), counts


def inverted(matrix: np.ndarray) -> np.ndarray:
    """Inverse by elimination with the largest pivot. Only element-wise operations: threads of
    a linear algebra library cannot stall the driver, nor change the last digits."""
    size = len(matrix)
    rows = np.hstack([matrix.astype(float), np.eye(size)])
    for i in range(size):
        pivot = i + int(np.argmax(np.abs(rows[i:, i])))
        rows[[i, pivot]] = rows[[pivot, i]]
        rows[i] /= rows[i, i]
        factor = rows[:, i].copy()
        factor[i] = 0
        rows -= factor[:, None] * rows[i]
    return rows[:, size:]


def column_generation(demand: np.ndarray, rounds: int = 4000) -> list[tuple[np.ndarray, float]]:
    """Patterns over the classes with demand and how often each is used, by the
    revised simplex method; the basis starts with one pattern per class."""
    room, used = len(demand), np.flatnonzero(demand)
    if not len(used):
        return []
    basis = np.diag(room // (used + 1)).astype(float)  # columns are patterns
    inverse, amount = np.diag(1 / np.diag(basis)), demand[used] / np.diag(basis)
    bound = demand @ np.arange(1, room + 1) / room  # no packing uses fewer sequences
    for turn in range(rounds):
        value = np.zeros(room)
        value[used] = np.maximum(inverse.sum(axis=0), 0.0)  # each sequence costs 1
        worth, counts = best_pattern(value, room)
        bound = max(bound, amount.sum() / worth)
        if amount.sum() <= bound * (1 + GAP):
            break
        held = counts[used]
        some = np.flatnonzero(held)
        step = (inverse[:, some] * held[some]).sum(axis=1)
        ratio = np.where(step > _EPS, amount / np.where(step > _EPS, step, 1), np.inf)
        out = int(np.argmin(ratio))
        amount = np.maximum(amount - ratio[out] * step, 0)
        amount[out] = ratio[out]
        basis[:, out] = held
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        if turn % 500 == 499:  # against rounding errors
            inverse = inverted(basis)
    return [(_spread(basis[:, j], used, room), amount[j]) for j in range(len(used)) if amount[j] > _EPS]


def _spread(column: np.ndarray, used: np.ndarray, room: int) -> np.ndarray:
    counts = np.zeros(room, np.int64)
    counts[used] = np.round(column).astype(np.int64)
    return counts


def rounded(demand: np.ndarray, solution: list[tuple[np.ndarray, float]]) -> list[tuple[np.ndarray, int]]:
    """Whole uses of patterns that meet the demand exactly: the solution rounded
    down, then the rest, fewer pieces than the patterns hold, first-fit-decreasing."""
    left, out = demand.astype(np.int64).copy(), []
    for counts, amount in solution:
        fits = [left[c] // counts[c] for c in np.flatnonzero(counts)]
        times = min([int(amount + 1e-6), *map(int, fits)])
        if times > 0:
            out.append((counts, times))
            left -= counts * times
    bins: list[tuple[list[int], int]] = []
    for c in np.flatnonzero(left)[::-1]:
        for _ in range(int(left[c])):
            for i, (held, free) in enumerate(bins):
                if free >= c + 1:
                    bins[i] = ([*held, int(c)], free - c - 1)
                    break
            else:
                bins.append(([int(c)], len(demand) - int(c) - 1))
    for held, times in Counter(tuple(h) for h, _ in bins).items():
        out.append((np.bincount(held, minlength=len(demand)), times))
    return out


@dataclass(frozen=True)
class Places:
    """For each class the ranks at which its runs in the patterns begin, and for
    each run the first sequence and the pieces of the class in one sequence."""

    begins: list[np.ndarray]
    sequence: list[np.ndarray]
    each: list[np.ndarray]

    @staticmethod
    def of(patterns: list[tuple[np.ndarray, int]], room: int) -> Places:
        rank = np.zeros(room, np.int64)
        runs: list[list[tuple[int, int, int]]] = [[] for _ in range(room)]
        first = 0
        for counts, times in patterns:
            for c in np.flatnonzero(counts):
                runs[c].append((int(rank[c]), first, int(counts[c])))
                rank[c] += counts[c] * times
            first += times
        split = [np.array(r, np.int64).reshape(-1, 3).T for r in runs]
        return Places([s[0] for s in split], [s[1] for s in split], [s[2] for s in split])

    def find(self, classes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ranks), np.int64)
        for c in np.unique(classes):
            rows = classes == c
            run = np.searchsorted(self.begins[c], ranks[rows], "right") - 1
            out[rows] = self.sequence[c][run] + (ranks[rows] - self.begins[c][run]) // self.each[c][run]
        return out


def pack(cut: DataFrame, length: int, order: list[Column], size: str = "length") -> DataFrame:
    """Adds `sequence_id` and `offset` to pieces of 1..`length` tokens. A sequence
    holds `length` at most, and its pieces lie end to end from 0. Equal pieces get
    places of their own. Columns of any other name stay, those two are replaced. An empty
    table gives no rows.

    The packing depends on the pieces alone, not on the machine: the solver adds and
    multiplies in one order.
    """
    room = length // UNIT
    cut = cut.drop("sequence_id", "offset")
    of_class, rank = spare([*cut.columns, "sequence_id", "offset"], "_class", "_rank")
    cut = stored(cut.withColumn(of_class, (F.ceil(F.col(size) / UNIT) - 1).cast("int")), "pieces")
    demand = np.zeros(room, np.int64)
    for c, n in cut.groupBy(of_class).count().collect():  # room rows at most
        demand[c] = n
    places = Places.of(rounded(demand, column_generation(demand)), room)
    ranked = gapless(cut, [of_class], order, rank)

    @F.pandas_udf("long")
    def place(classes: pd.Series, ranks: pd.Series) -> pd.Series:
        return pd.Series(places.find(classes.to_numpy(), ranks.to_numpy()))

    inside = Window.partitionBy("sequence_id").orderBy(F.desc(size), *order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranked.withColumn("sequence_id", place(of_class, rank))
        .withColumn("offset", F.coalesce(F.sum(size).over(inside), F.lit(0)))
        .drop(of_class, rank)
    )
