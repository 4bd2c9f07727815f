"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Text and items are sequences of lower-cased words. The CGK walk reads a sequence
with a random step function for each of its steps: it writes the word it stands
on and, by that word's bit, stays or moves on. Sequences a small edit distance
apart soon walk in step again, so their embeddings differ in few places (Hamming
distance). Bit sampling reads an embedding at a few random steps; item-sized windows that agree
with an item on all samples of a table are candidates, and several tables over several
walks reach the target recall.

Before that, windows that cannot hold an item are left out: k edits of an item of n words
leave n - 1 - 2k of its word pairs, so a window with fewer known pairs holds none. What
is left is little, and there the items' pieces are looked up too: an item that
may take k edits is cut to k + 1 pieces, one of which stays whole. They add what sampling
missed and are the only way for items too short for a walk. Each
candidate is then checked by its exact edit distance.

Items go to the tasks in blocks of a bounded number and size; the texts are never
shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runaudit.llm.common import WordHashes, mix, rolling, slices, spare, table, utf8

BLOCK_ITEMS, BLOCK_WORDS = 1024, 1 << 17
CHUNK = 1 << 15  # words looked up together
KNOWN_BITS = 18  # leading bits of a piece's hash in the first lookup
TABLE_BITS = 14  # the same for the keys of a table, of which there are many
PAIR_BITS = 20  # bits by which an item's word pairs are known
WALKS, TABLES, SAMPLES = 10, 4, 4
SHORTEST = 8  # words of an item that a walk can tell from another
CLASS = 1.25  # items of a class are at most so many times as long as its shortest
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
FLAGS = 1 << 12  # bits by which an item's words are known in the count filter


def lowered(texts: list[bytes]) -> list[bytes]:
    return [t.decode().lower().encode() for t in texts]


def pieces(n: int, limit: int) -> list[tuple[int, int]]:
    """(offset, words) of the pieces of an item of n words; `limit` edits leave one whole."""
    parts = min(limit + 1, n)
    cuts = [n * i // parts for i in range(parts + 1)]
    return [(a, z - a) for a, z in zip(cuts, cuts[1:], strict=False)]


def step_bits(hashes: np.ndarray, walk: int, step: int) -> np.ndarray:
    """Whether the walk moves on from each word at this step. It stays on 0."""
    odd = np.uint64((0x9E3779B97F4A7C15 * (2 * (walk * 1_000_003 + step) + 1)) & 0xFFFFFFFFFFFFFFFF | 1)
    return ((hashes * odd) >> np.uint64(63)).astype(np.int32)


def sampled_steps(least: int, walk: int, t: int) -> list[int]:
    """The steps at which table t of a walk reads windows of a class: so early that no walk
    has left the shortest item of the class."""
    return sorted(np.random.default_rng([least, walk, t]).choice(least, SAMPLES, replace=False).tolist())


def embed(laid: np.ndarray, leasts: list[int]) -> Iterator[tuple[tuple[int, int, int], np.ndarray]]:
    """Keys of the windows that open at each word, by (least, walk, table). All windows walk on
    together, since a step needs only the place each has reached."""
    for walk in range(WALKS):
        wanted: dict[int, list] = {}
        for least in leasts:
            for t in range(TABLES):
                for k, s in enumerate(sampled_steps(least, walk, t)):
                    wanted.setdefault(s, []).append((k, (least, walk, t)))
        keys: dict = {}
        place = np.arange(len(laid), dtype=np.int32)
        for s in range(max(wanted, default=-1) + 1):
            if s in wanted:
                word = laid[place]
                for k, name in wanted[s]:
                    keys[name] = word * _SPREAD if k == 0 else (keys[name] + word) * _SPREAD
                    if k == SAMPLES - 1:
                        yield name, keys.pop(name)
            place += step_bits(laid, walk, s)[place]


def pair_bits(laid: np.ndarray) -> np.ndarray:
    """Of every two neighbouring words."""
    return (mix(laid[:-1] * _SPREAD + laid[1:]) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def lookup(have: np.ndarray, key: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in key, place in have) of all equal values; `have` is sorted, `known` says which
    leading bits it holds."""
    hit = np.flatnonzero(known[(key >> np.uint64(65 - len(known).bit_length())).astype(np.int64)])
    a, z = np.searchsorted(have, key[hit], "left"), np.searchsorted(have, key[hit], "right")
    more = z > a
    hit, a, z = hit[more], a[more], z[more]
    each = z - a
    return np.repeat(hit, each), np.repeat(a, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)


def leading(hashes: np.ndarray, bits: int = KNOWN_BITS) -> np.ndarray:
    known = np.zeros(1 << bits, bool)
    known[(hashes >> np.uint64(64 - bits)).astype(np.int64)] = True
    return known


@dataclass(frozen=True)
class Index:
    """A block of items: words, where the pieces of each length come from, and the
    items under each key of a table."""

    items: list[np.ndarray]
    ids: list
    classes: dict[int, int]  # least number of words of a class -> most
    pairs: np.ndarray  # word pairs that an item may hold
    single: np.ndarray  # items of one word
    tables: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]  # -> leading bits, sorted keys, items
    keys: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # words -> leading bits, sorted hashes, items, offsets
    flags: np.ndarray  # per item, the words it may hold

    @staticmethod
    def of(items: list[np.ndarray], ids: list, percent: int) -> Index:
        flags = np.zeros((len(items), FLAGS), bool)
        cut: dict[int, list] = {}
        for i, x in enumerate(items):
            flags[i, (x % np.uint64(FLAGS - 1)).astype(np.int64)] = True
            for offset, size in pieces(len(x), len(x) * percent // 100):
                cut.setdefault(size, []).append((i, offset))
        keys = {}
        for size, places in cut.items():
            hashes = rolling(np.concatenate([items[i][o : o + size] for i, o in places]), size)[::size]
            order = np.argsort(hashes, kind="stable")
            item, offset = np.array(places, np.int64)[order].T
            keys[size] = (leading(hashes), hashes[order], item, offset)
        size = np.array([len(x) for x in items], np.int64)
        classes: dict[int, int] = {}
        for n in sorted(set(size.tolist())):
            least = max(classes, default=0)
            if n > least * CLASS:
                least = n
            classes[least] = n
        laid = np.concatenate([np.append(x, np.uint64(0)) for x in items])
        first = np.cumsum(size + 1) - size - 1
        pairs = np.zeros(1 << PAIR_BITS, bool)
        inside = np.delete(np.arange(len(laid) - 1), np.concatenate([first[1:] - 1, first + size - 1]))
        pairs[pair_bits(laid)[inside]] = True
        least_of = np.array(sorted(classes), np.int64)
        member = least_of[np.searchsorted(least_of, size, "right") - 1]
        tables = {}
        with np.errstate(over="ignore"):
            for name, key in embed(laid, [c for c in classes if c >= SHORTEST]):
                rows = np.flatnonzero(member == name[0])
                rows = rows[np.argsort(key[first[rows]], kind="stable")]
                tables[name] = (leading(key[first[rows]], TABLE_BITS), key[first[rows]], rows)
        single = np.unique([x[0] for x in items if len(x) == 1]).astype(np.uint64)
        return Index(items, ids, classes, pairs, single, tables, keys, flags)

    def alive(self, laid: np.ndarray, percent: int) -> np.ndarray:
        """Words that some item may touch, by the known pairs around them."""
        total = np.concatenate([[0], np.cumsum(self.pairs[pair_bits(laid)])]) if len(laid) > 1 else np.zeros(1, np.int64)
        change = np.zeros(len(laid) + 1, np.int64)

        def mark(at: np.ndarray, before: int, after: int) -> None:
            np.add.at(change, np.maximum(at - before, 0), 1)
            np.add.at(change, np.minimum(at + after, len(laid)), -1)

        for least, most in self.classes.items():
            limit = most * percent // 100
            need, at = least - 1 - 2 * limit, np.arange(len(laid))
            if most == 1:
                at = np.flatnonzero(np.isin(laid, self.single))
            elif need > 0:
                end = np.minimum(at + least + limit - 1, len(total) - 1)
                at = np.flatnonzero(total[end] - total[np.minimum(at, len(total) - 1)] >= need)
            mark(at, 2 * limit, most + 2 * limit)
        return np.cumsum(change[:-1]) > 0

    def candidates(self, laid: np.ndarray, sampled: bool = True, pieced: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place, offset, item): an item would begin `offset` words before a place in `laid`, by its
        keys or by its pieces. A piece holds no 0, so none reaches over the end of a text."""
        for name, key in embed(laid, sorted({c for c, _, _ in self.tables})) if sampled else ():
            known, have, item = self.tables[name]
            place, spot = lookup(have, key, known)
            yield place, np.zeros_like(place), item[spot]
        for size, (known, have, item, offset) in self.keys.items() if pieced else ():
            place, spot = lookup(have, rolling(laid, size), known)
            yield place, offset[spot], item[spot]


def distance(item: np.ndarray, text: np.ndarray, limit: int, free: bool = False) -> tuple[int, int]:
    """Least edit distance in words between the item and a prefix of the text (any
    stretch of it if `free`), and where that ends; limit + 1 if it is larger."""
    ramp = np.arange(len(text) + 1)
    row = np.zeros_like(ramp) if free else ramp
    for i, word in enumerate(item.tolist(), 1):
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (text != word))
        new[0] = i
        row = np.minimum.accumulate(new - ramp) + ramp  # insertions
        if row.min() > limit:
            return limit + 1, 0
    best = int(row.min())
    ends = np.flatnonzero(row == best)
    return best, int(ends[np.argmin(np.abs(ends - len(item)))])


def blocks(benchmark: DataFrame, text: str, key: str, percent: int) -> Iterator[Index]:
    """Items with words, as indexes of bounded size; an item longer than a block is
    a block of its own."""
    known = WordHashes()
    items: list[np.ndarray] = []
    ids: list = []
    for row in benchmark.select(key, text).toLocalIterator():
        words = known.of(lowered([(row[1] or "").encode()]))[0] | np.uint64(1)
        if not len(words):
            continue
        if items and (len(items) >= BLOCK_ITEMS or sum(map(len, items)) + len(words) > BLOCK_WORDS):
            yield Index.of(items, ids, percent)
            items, ids = [], []
        items.append(words)
        ids.append(row[0])
    if items:
        yield Index.of(items, ids, percent)


def _enough(index: Index, flag: np.ndarray, first: np.ndarray, n: np.ndarray, met: np.ndarray, percent: int) -> np.ndarray:
    """Candidates whose surroundings hold as many of the item's words as a match
    within the limit must have. Counts by flag bits are never too low."""
    text, begin, item = met.T
    size = np.array([len(x) for x in index.items])[item]
    limit = size * percent // 100
    open_, close = np.maximum(first[text], begin - limit), np.minimum(first[text] + n[text], begin + size + limit)
    keep = np.zeros(len(met), bool)
    for c in range(0, len(met), 4096):
        part = slice(c, c + 4096)
        wide = int((close[part] - open_[part]).max(initial=0))
        spot = open_[part, None] + np.arange(wide)
        inside = spot < close[part, None]
        held = index.flags[item[part, None], flag[np.minimum(spot, len(flag) - 1)]] & inside
        keep[part] = held.sum(axis=1) >= size[part] - limit[part]
    return keep


def _matches(index: Index, laid: np.ndarray, first: np.ndarray, n: np.ndarray, percent: int) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, words, distance) of the best match of an item in a text."""
    owner = np.repeat(np.arange(len(n)), n + 1)  # the 0 after a text is its own
    flag = (laid % np.uint64(FLAGS - 1)).astype(np.int32)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    place = np.flatnonzero(index.alive(laid, percent))
    for lo in range(0, len(place), CHUNK):
        # a window that opens in the chunk may go on in what follows
        at = place[lo : lo + CHUNK + max(index.classes.values()) * 2]
        gap = np.flatnonzero(np.diff(at) != 1) + 1
        left = np.insert(laid[at], gap, 0)
        origin = np.append(np.insert(at, gap, at[gap - 1]), at[-1])
        some = [np.zeros((0, 3), np.int64)]
        for spot, offset, item in index.candidates(np.append(left, np.uint64(0))):
            here = origin[spot]
            some.append(np.stack([owner[here], here - offset, item], axis=1))
        met = np.unique(np.concatenate(some), axis=0)
        met = met[_enough(index, flag, first, n, met, percent)]
        for text, begin, i in met.tolist():
            item = index.items[i]
            limit = len(item) * percent // 100
            found = best.get((text, i))
            if found:
                limit = found[0] - 1
            if limit < 0:
                continue
            a, z = max(int(first[text]), begin - limit), min(int(first[text] + n[text]), begin + len(item) + limit)
            d, end = distance(item, laid[a:z], limit, free=True)
            if d <= limit:
                size = distance(item[::-1], laid[a : a + end][::-1], d)[1]
                best[text, i] = (d, a + end - size, size)
    return [(t, i, b - int(first[t]), size, d) for (t, i), (d, b, size) in best.items()]


def matches(
    docs: DataFrame, benchmark: DataFrame, percent: int = 20, text: str = "text", key: str = "doc_id", item_key: str = "item_id"
) -> DataFrame:
    """(key, item_key, start, n_words, distance): for each text and item, the best
    place with an edit distance of at most `percent` % of the item's words.

    A text shorter than an item can match it too. Null and empty texts and items
    match nothing. Rows that repeat a key, or items that repeat an id, give a row each.
    An empty table on either side gives no rows.
    """
    fields = docs.select(key).schema
    for f in benchmark.select(item_key).schema:
        fields = fields.add(f)
    for c in ("start", "n_words", "distance"):
        fields = fields.add(c, "long")
    item_type = pa.array(pd.Series([], dtype="int64")).type if fields[1].dataType.simpleString() in ("bigint", "int") else pa.string()
    spark, out = docs.sparkSession, None
    for index in blocks(benchmark, text, item_key, percent):
        sent = spark.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = WordHashes()
            for batch in slices(batches, text):
                hashes, n = known.of(lowered(utf8(batch, text)))
                laid = np.zeros(len(hashes) + len(n), np.uint64)  # a 0 after each text
                first = np.cumsum(n + 1) - n - 1
                laid[np.arange(len(hashes)) + np.repeat(np.arange(len(n)), n)] = hashes | np.uint64(1)
                with np.errstate(over="ignore"):
                    got = _matches(sent.value, laid, first, n, percent)
                columns = list(zip(*got, strict=True)) or [()] * 5
                yield table(
                    **{key: batch.column(batch.schema.get_field_index(key)).take(pa.array(columns[0], pa.int64()))},
                    **{item_key: pa.array([sent.value.ids[i] for i in columns[1]], item_type)},
                    **{c: pa.array(v, pa.int64()) for c, v in zip(("start", "n_words", "distance"), columns[2:], strict=True)},
                )

        part = docs.select(key, text).mapInArrow(search, fields)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else spark.createDataFrame([], fields)


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = 20, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`docs` without the rows whose text holds an item."""
    (row,) = spare(docs.columns, "_row")
    marked = docs.withColumn(row, F.xxhash64(text))
    bad = matches(marked, benchmark, percent, text, row).select(row).distinct()
    return marked.join(bad, row, "left_anti").select(*docs.columns)
