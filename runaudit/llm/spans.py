"""Repeated word windows across documents: the steps that the substring
operators share.

A window of 50 words holds 20-word grams at 31 places. The first of the least of
their hashes is its anchor: its place depends on the window's words alone, so equal windows
have equal anchors. The windows of one anchor follow one another; their words together are
the anchor's reach, some 65 words around it.

Only anchors whose gram two documents hold can lie in a repeated window. Such a match is
extended left and right at once: where the whole reach is that of an earlier document,
one row settles all its windows. Where a match begins or ends within the reach, it is extended
word by word: one anchor for every different reach is compared by each window, by a 128-bit digest
of all its words, and what is found holds for every anchor of that reach.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runaudit.llm.common import WordHashes, rolling, slices, starts, stored, table, utf8

GRAM = 20
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(doc, row, text): the row hash tells rows apart that share a doc id."""
    return docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))


def kind(rows: DataFrame) -> str:
    return rows.schema["doc"].dataType.simpleString()


def first_least(values: np.ndarray, w: int) -> np.ndarray:
    """Place of the first least of each w consecutive values; shorter by w - 1."""
    size, at = 1, np.arange(len(values))

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[b] < values[a], b, a)

    while size * 2 <= w:
        at = better(at[:-size], at[size:])
        size *= 2
    n = len(values) - w + 1
    return better(at[:n], at[w - size : w - size + n])


def reaches(hashes: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of n words laid end to end, for each anchor: its text, the place there of its first
    window, the number of its windows, and its gram."""
    none = np.zeros(0, np.int64)
    text, place, opens = starts(n, window)
    span = window - GRAM + 1
    if len(hashes) < window or not opens.any():
        return none, none, none, np.zeros(0, np.uint64)
    grams = rolling(hashes, GRAM)
    begin = np.flatnonzero(opens)
    anchor = first_least(grams, span)[begin]
    cut = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(begin) != 1)) + 1
    first = np.concatenate([[0], cut])
    count = np.diff(np.concatenate([first, [len(begin)]]))
    return text[begin[first]], place[begin[first]], count, grams[anchor[first]]


def anchors(rows: DataFrame, window: int) -> DataFrame:
    """(doc, row, start, count, gram, h1, h2): a row for every anchor, h1 and h2 being the
    128-bit digest of its reach."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in slices(batches, "text"):
            hashes, n = known.of(utf8(batch, "text"))
            text, start, count, gram = reaches(hashes, n, window)
            raw = memoryview(hashes.tobytes())
            begin = 8 * ((np.cumsum(n) - n)[text] + start)
            end = begin + 8 * (count + window - 1)
            whole = b"".join([xxhash.xxh3_128_digest(raw[a:z]) for a, z in zip(begin.tolist(), end.tolist(), strict=True)])
            digest = np.frombuffer(whole, np.int64).reshape(-1, 2)
            doc, row = (batch.column(batch.schema.get_field_index(c)).take(pa.array(text)) for c in ("doc", "row"))
            yield table(
                doc=doc,
                row=row,
                start=start.astype(np.int32),
                count=count.astype(np.int32),
                gram=gram.view(np.int64),
                h1=digest[:, 0],
                h2=digest[:, 1],
            )

    fields = f"doc {kind(rows)}, row long, start int, count int, gram long, h1 long, h2 long"
    return rows.where("doc is not null").mapInArrow(found, fields)


def windows(rows: DataFrame, reps: DataFrame, window: int) -> DataFrame:
    """(doc, h1, h2, at, w1, w2): digests of each window of the anchors in `reps`, at places 0, 1, ... of
    their reach."""
    at = reps.groupBy("doc", "row").agg(F.collect_list(F.struct("start", "count", "h1", "h2")).alias("at"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in slices(batches, "text"):
            hashes, n = known.of(utf8(batch, "text"))
            one, two = rolling(hashes, window), rolling(hashes, window, 0xD6E8FEB86659FD93)
            lists = batch.column(2)
            of = np.repeat(np.arange(len(n)), np.diff(lists.offsets.to_numpy()))
            places = lists.flatten()
            start, count, h1, h2 = (places.field(c).to_numpy() for c in ("start", "count", "h1", "h2"))
            spot = np.repeat((np.cumsum(n) - n)[of] + start, count)
            offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            yield table(
                doc=batch.column(0).take(pa.array(np.repeat(of, count))),
                h1=np.repeat(h1, count),
                h2=np.repeat(h2, count),
                at=offset.astype(np.int32),
                w1=one[spot + offset].view(np.int64),
                w2=two[spot + offset].view(np.int64),
            )

    held = rows.join(at, ["doc", "row"]).select("doc", "text", "at")
    return held.mapInArrow(digests, f"doc {kind(rows)}, h1 long, h2 long, at int, w1 long, w2 long")


def shared_grams(marks: DataFrame) -> DataFrame:
    """Grams that two documents hold."""
    return marks.groupBy("gram").agg(F.min("doc").alias("_a"), F.max("doc").alias("_z")).where("_a < _z").select("gram")


def earlier(rows: DataFrame, window: int, shared: Callable[[DataFrame], DataFrame] = shared_grams) -> DataFrame:
    """(doc, row, hits): for each text the anchors with windows that a smaller doc holds too,
    as structs (start, count, source, parts). All windows start..start + count - 1 are held by
    `source`, if it is not null, but where a struct (at, source) of `parts` names a smaller one for
    the window start + at; if it is null, only those are."""
    marks = stored(anchors(rows, window), "anchors")
    grams = stored(shared(marks), "grams")  # a table, so that a common gram's join can be split
    near = stored(marks.join(grams, "gram"), "near")
    reach = ["h1", "h2"]
    classes = stored(near.groupBy(*reach).agg(F.min("doc").alias("source"), F.min("gram").alias("gram")), "reaches")
    several = classes.groupBy("gram").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("gram")
    mixed = classes.join(several, "gram").select(*reach, "source")
    reps = (
        near.join(mixed, reach).where(F.col("doc") == F.col("source"))
        .groupBy(*reach).agg(F.min(F.struct("doc", "row", "start", "count")).alias("_r")).select("_r.*", *reach)
    )
    held = stored(windows(rows, reps, window), "windows")
    first = held.groupBy("w1", "w2").agg(F.min("doc").alias("source"), F.max("doc").alias("_z")).where("source < _z")
    parts = (
        held.join(first.drop("_z"), ["w1", "w2"]).where("source < doc")
        .groupBy(*reach).agg(F.collect_list(F.struct("at", "source")).alias("parts"))
    )
    found = classes.select(*reach, "source").join(parts, reach, "left")
    met = near.join(found, reach).where("source < doc or parts is not null")
    source = F.when(F.col("source") < F.col("doc"), F.col("source")).alias("source")
    return met.groupBy("doc", "row").agg(F.collect_list(F.struct("start", "count", source, "parts")).alias("hits"))


def held_windows(hits: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Places of a text's windows that a smaller doc holds, in order, and the least such doc of each."""
    pos: list[int] = []
    source: list = []
    for hit in sorted(hits, key=lambda h: h["start"]):
        of = [hit["source"]] * hit["count"]
        for part in hit["parts"] or ():
            of[part["at"]] = part["source"]
        for i, s in enumerate(of):
            if s is not None:
                pos.append(hit["start"] + i)
                source.append(s)
    return np.array(pos, np.int64), np.array(source, object)


def factors(pos: np.ndarray, source: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """(start, length, source): from the first window on, a factor runs as long as
    every next window is held by the same source; the next one begins with the
    first window that reaches beyond it, so factors overlap at their boundary."""
    cut = np.flatnonzero((np.diff(pos) != 1) | (source[1:] != source[:-1])) + 1
    first = np.concatenate([[0], cut]) if len(pos) else cut
    last = np.concatenate([cut, [len(pos)]])[: len(first)] - 1
    return [(int(pos[a]), int(pos[z] - pos[a] + window), source[a]) for a, z in zip(first, last, strict=True)]
