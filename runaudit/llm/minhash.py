"""Near-duplicate documents by MinHash.

A document's set is its distinct word shingles. HASHES universal hash functions
each keep their least value over the set; BANDS bands of ROWS minima are the
keys that candidates share, the signatures verify them roughly, and the texts
exactly. Links are joined to components.

A bucket is never turned into all of its pairs. Equal sets are one node. In a
bucket every member is checked against the least and the greatest member; only
members that are then still in other components than the bucket's commonest are
checked against the members outside their component, in blocks. Links between members of one
component could not change the result, so no link is lost that the bands found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runaudit.llm.common import WordHashes, mix, rolling, slices, starts, stored, table, utf8
from runaudit.llm.components import components

SHINGLE = 5
ROWS, BANDS = 4, 24
HASHES = ROWS * BANDS
SLACK = 4.5  # standard errors a signature may lie below the threshold
BLOCK = 512  # members of a bucket that are compared at once with as many others
SET = ["node", "s1", "s2"]  # a node's set: one document may have several
COLUMNS = 1 << 14  # shingles counted at once


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    drawn = np.random.default_rng(20_240_229).integers(0, 1 << 63, (2, HASHES), np.uint64)
    return drawn[0] * np.uint64(2) + np.uint64(1), drawn[1]


def shingle_sets(texts: list[bytes], known: WordHashes) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, A-Z lower-cased. With
    fewer words than a shingle, the whole sequence is one; no words give none."""
    hashes, n = known.of([t.lower() for t in texts])
    _, _, begins = starts(n, SHINGLE)
    grams = rolling(hashes, SHINGLE) if len(hashes) >= SHINGLE else np.zeros(0, np.uint64)
    ends = np.cumsum(n)
    out = []
    for end, size in zip(ends.tolist(), n.tolist(), strict=True):
        if size >= SHINGLE:
            out.append(np.unique(grams[end - size : end - SHINGLE + 1]))
        elif size:
            out.append(np.array([xxhash.xxh3_64_intdigest(hashes[end - size : end].tobytes(), size)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def identity(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, as two longs."""
    one, two = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64).tolist()
    return one, two


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """Signatures, one row of HASHES unsigned 32-bit minima per non-empty set."""
    a, b = _coefficients()
    flat = np.concatenate(sets)
    first = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), HASHES), np.uint32)
    with np.errstate(over="ignore"):
        for h in range(HASHES):
            out[:, h] = np.minimum.reduceat(((flat * a[h] + b[h]) >> np.uint64(32)).astype(np.uint32), first)
    return out


def band_keys(signed: np.ndarray) -> np.ndarray:
    """One 64-bit key per set and band."""
    rows = signed.reshape(len(signed), BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        keys = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for r in range(ROWS):
            keys = mix(keys + rows[:, :, r])
    return keys


def signatures(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(key, n_shingles, s1, s2, bands, signature); s1 and s2 identify the set."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in slices(batches, text):
            sets = shingle_sets(utf8(batch, text), known)
            size = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(size)
            s1, s2 = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
            bands: list = [None] * len(sets)
            packed: list = [None] * len(sets)
            if len(full):
                got = minima([sets[i] for i in full])
                keys = band_keys(got)
                for j, i in enumerate(full):
                    s1[i], s2[i] = identity(sets[i])
                    bands[i] = keys[j].view(np.int64)
                    packed[i] = got[j].tobytes()
            yield table(
                **{key: batch.column(batch.schema.get_field_index(key))},
                n_shingles=size,
                s1=s1,
                s2=s2,
                bands=pa.array(bands, pa.list_(pa.int64())),
                signature=pa.array(packed, pa.binary()),
            )

    out = docs.select(key).schema
    for c in ("n_shingles", "s1", "s2"):
        out = out.add(c, "long")
    fields = f"{key} {docs.schema[key].dataType.simpleString()}, n_shingles long, s1 long, s2 long, bands array<long>, signature binary"
    return docs.select(key, text).mapInArrow(signed, fields)


def agree(pairs: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """Pairs of nodes whose signatures agree about as often as the threshold asks for."""
    floor = HASHES * max(0.0, threshold - SLACK * (threshold * (1 - threshold) / HASHES) ** 0.5)
    a, b = (signed.select(F.struct(*SET).alias(c), F.col("signature").alias(f"_s{c}")) for c in "ab")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, HASHES) for i in (2, 3))
                enough = pa.array((one == two).sum(axis=1) >= floor)
                yield batch.select([0, 1]).filter(enough)

    both = pairs.join(a, "a").join(b, "b").select(F.col("a.node").alias("a"), F.col("b.node").alias("b"), "_sa", "_sb")
    return both.mapInArrow(close, "a long, b long").distinct()


def verified(pairs: DataFrame, docs: DataFrame, text: str, key: str, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union on their full sets."""
    a = docs.select(F.col(key).alias("a"), F.col(text).alias("_ta"))
    b = docs.select(F.col(key).alias("b"), F.col(text).alias("_tb"))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for whole in batches:
            for batch in slices(iter([whole]), "_tb"):
                one, two = (shingle_sets(utf8(batch, c), known) for c in ("_ta", "_tb"))
                both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(one, two, strict=True)], np.int64)
                union = np.array([len(x) + len(y) for x, y in zip(one, two, strict=True)], np.int64) - both
                yield batch.select([0, 1]).filter(pa.array(100 * both >= percent * union))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "_ta", "_tb").mapInArrow(exact, "a long, b long")


def star_pairs(buckets: DataFrame) -> DataFrame:
    """Each set of a bucket with the bucket's least and greatest one, as structs of SET."""
    one = F.struct(*SET)
    ends = buckets.groupBy("band").agg(F.min(one).alias("_lo"), F.max(one).alias("_hi")).where("_lo < _hi")
    met = buckets.join(ends, "band").select(one.alias("_one"), "_lo", "_hi")
    low = met.where("_one > _lo").select(F.col("_lo").alias("a"), F.col("_one").alias("b"))
    high = met.where("_one < _hi and _one > _lo").select(F.col("_one").alias("a"), F.col("_hi").alias("b"))
    return low.union(high).where("a.node != b.node").distinct()


def rest_blocks(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """(band, i, j, left, node, s1, s2, component): buckets that still hold several
    components, cut to blocks. Members outside the bucket's commonest component are
    on the left, each in one block i and beside every block j; all members are on the right,
    each in one block j and beside every block i. So every pair that could
    join two components meets in one (band, i, j), of 2 * BLOCK members or so."""
    placed = buckets.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    counts = placed.groupBy("band", "component").agg(F.count(F.lit(1)).alias("_n"))
    main = counts.groupBy("band").agg(
        F.max_by("component", F.struct("_n", "component")).alias("_main"),
        F.ceil(F.sum("_n") / BLOCK).cast("int").alias("_j"),
        F.ceil((F.sum("_n") - F.max("_n")) / BLOCK).cast("int").alias("_i"),
        F.count(F.lit(1)).alias("_k"),
    )
    mixed = placed.join(stored(main.where("_k > 1").drop("_k"), "mixed"), "band")
    spot = F.xxhash64(*SET, F.lit("block"))

    def side(rows, i, j, left):
        return rows.select("band", i.alias("i"), j.alias("j"), F.lit(left).alias("left"), *SET, "component")

    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = side(mixed.where("component != _main"), F.pmod(spot, F.col("_i")).cast("int"), every("_j"), True)
    return one.unionAll(side(mixed, every("_i"), F.pmod(spot, F.col("_j")).cast("int"), False))


def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of every (band, i, j), which lie together, as one batch."""
    left = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if left is not None:
            batch = pa.concat_batches([left, batch])
        keys = np.stack([batch.column(c).to_numpy() for c in range(3)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()]
        for a, z in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, z - a)
        left = batch.slice(cuts[-1])
    if left is not None:
        yield left


def sides(block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows on the left, rows on the right, and which of them differ in component."""
    left, part = block.column("left").to_numpy(zero_copy_only=False), block.column("component").to_numpy()
    one, two = np.flatnonzero(left), np.flatnonzero(~left)
    return one, two, part[one][:, None] != part[two][None, :]


def close_rows(block: pa.RecordBatch, floor: float) -> np.ndarray:
    """Rows with a partner whose signature agrees in `floor` places. A pair counts in
    the first band that it shares alone."""
    one, two, near = sides(block)
    if not near.any():
        return one[:0]
    signed = np.frombuffer(b"".join(block.column("signature").to_pylist()), np.uint32).reshape(-1, HASHES)
    here = int(np.flatnonzero(band_keys(signed[:1])[0].view(np.int64) == block.column(0)[0].as_py())[0])
    same = np.zeros(near.shape, np.int16)
    for band in range(BANDS):
        equal = [signed[one, h][:, None] == signed[two, h][None, :] for h in range(band * ROWS, (band + 1) * ROWS)]
        for e in equal:
            same += e
        if band < here:
            near &= ~np.logical_and.reduce(equal)
    near &= same >= floor
    return np.sort(np.concatenate([one[near.any(axis=1)], two[near.any(axis=0)]]))


def exact_links(block: pa.RecordBatch, percent: int) -> list[tuple[int, int]]:
    """Links between components, one for a row on the left and a component."""
    one, two, apart = sides(block)
    sets = [np.frombuffer(x, np.uint64) for x in block.column("shingles").to_pylist()]
    if not len(one) or not len(two):
        return []
    size = np.array([len(x) for x in sets])
    shared = np.intersect1d(np.concatenate([sets[k] for k in one]), np.concatenate([sets[k] for k in two]))
    both = np.zeros(apart.shape)
    at = [np.searchsorted(shared, x[np.isin(x, shared, assume_unique=True)]) for x in sets]
    for lo in range(0, len(shared), COLUMNS):
        held = np.zeros((len(sets), min(COLUMNS, len(shared) - lo)), np.float32)
        for k, x in enumerate(at):
            held[k, x[(x >= lo) & (x < lo + COLUMNS)] - lo] = 1
        both += held[one] @ held[two].T
    union = size[one][:, None] + size[two][None, :] - both
    x, y = np.nonzero(apart & (100 * both >= percent * union))
    node, part = block.column("node").to_numpy(), block.column("component").to_numpy()
    return list({(int(node[one[a]]), int(part[two[b]])): (int(node[one[a]]), int(node[two[b]])) for a, b in zip(x, y, strict=True)}.values())


def rest_links(
    buckets: DataFrame, found: DataFrame, nodes: DataFrame, docs: DataFrame, limit: float, text: str, key: str, percent: int
) -> DataFrame:
    """Links between the components that star links left apart: blocks are compared
    by signature first, then exactly. Pairs stay inside the tasks; what comes out
    is members, and one link per member and component."""
    floor = HASHES * max(0.0, limit - SLACK * (limit * (1 - limit) / HASHES) ** 0.5)
    fields = "band long, i int, j int, left boolean, node long, s1 long, s2 long, component long"
    names = [f.split()[0] for f in fields.split(", ")]
    block = ["band", "i", "j"]

    def together(df: DataFrame) -> DataFrame:
        return df.repartition(*block).sortWithinPartitions(*block)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in each_block(batches):
            rows = close_rows(got, floor)
            if len(rows):
                yield got.select(names).take(pa.array(rows))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in each_block(batches):
            if found := exact_links(got, percent):
                yield table(a=[a for a, _ in found], b=[b for _, b in found])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in slices(batches, text):
            sets = shingle_sets(utf8(batch, text), known)
            named = np.array([identity(x) for x in sets], np.int64).reshape(-1, 2)
            shingles = pa.array([x.tobytes() for x in sets], pa.binary())
            yield table(node=batch.column(0), s1=named[:, 0], s2=named[:, 1], shingles=shingles)

    signed = rest_blocks(buckets, found).join(nodes.select(*SET, "signature"), SET).select(*names, "signature")
    kept = stored(together(signed).mapInArrow(close, fields), "rest")
    if kept.isEmpty():
        return kept.select(F.col("node").alias("a"), F.col("node").alias("b"))
    some = docs.join(kept.select(F.col("node").alias(key)).distinct(), key).select(key, text)
    sets = stored(some.mapInArrow(listed, "node long, s1 long, s2 long, shingles binary").dropDuplicates(SET), "sets")
    full = kept.join(sets, SET).select(*names, "shingles")
    return stored(together(full).mapInArrow(linked, "a long, b long"), "links")


def near_duplicates(docs: DataFrame, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row of `docs`.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their
    sets; component_id is the least key that can be reached, kept marks the row
    that carries it. Keys are longs. Empty sets (null or empty text, no words) are
    linked with nothing. Rows that repeat a key are one node with the links of all
    its texts; of them, rows with equal sets stay together. A row with a null key has no
    links and a null component, and is kept. An empty table gives no rows.
    """
    signed = stored(signatures(docs, text, key), "signatures")
    sets = signed.where(F.col(key).isNotNull() & (F.col("n_shingles") > 0))
    firsts = sets.groupBy("s1", "s2").agg(F.min(key).alias("node"))
    equal = sets.select(key, "s1", "s2").join(firsts, ["s1", "s2"]).select(F.col("node").alias("a"), F.col(key).alias("b"))
    nodes = stored(
        sets.join(firsts, ["s1", "s2"]).where(F.col(key) == F.col("node")).select("node", "s1", "s2", "bands", "signature").dropDuplicates(["node", "s1", "s2"]),
        "nodes",
    )
    buckets = nodes.select(*SET, F.explode("bands").alias("band"))
    crowded = buckets.groupBy("band").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("band")
    buckets = stored(buckets.join(crowded, "band"), "buckets")

    limit = percent / 100
    links = stored(verified(agree(star_pairs(buckets), nodes, limit), docs, text, key, percent), "links")
    found = components(links)
    links = links.union(rest_links(buckets, found, nodes, docs, limit, text, key, percent))
    found = components(links.union(equal))
    placed = signed.select(key, "n_shingles").join(found, F.col(key) == F.col("node"), "left")
    return placed.select(
        key,
        "n_shingles",
        F.coalesce("component", key).alias("component_id"),
        F.coalesce(F.coalesce("component", key) == F.col(key), F.lit(True)).alias("kept"),
    )
