"""Substring dedup by a sparse suffix array.

Only the suffixes at anchors are retained: the content-selected places whose gram has the
least hash in some window of the wanted length, which equal passages have in
common. They are sorted by their leading gram and dealt to tasks by range, and each is
compared with its neighbour. Where neighbours of different documents agree on the gram, the match is
extended left and right: over the whole reach of the anchor at once, and window by window
where that differs (see `spans`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from runaudit.llm import spans
from runaudit.llm.common import table


def sorted_shared(marks: DataFrame) -> DataFrame:
    """Leading grams on which neighbouring suffixes of different documents agree. A range
    of equal grams may be cut between tasks: the first and the last
    suffix of every task come out too and are compared among themselves."""
    order = ["gram", "doc"]
    kind = spans.kind(marks)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is None:
                yield batch.slice(0, 1)
            else:
                batch = pa.concat_batches([last, batch])
            gram, doc = batch.column(0).to_numpy(), batch.column(1)
            same = np.flatnonzero(gram[1:] == gram[:-1])
            unlike = pc.not_equal(doc.take(pa.array(same)), doc.take(pa.array(same + 1)))
            ends = same[unlike.to_numpy(zero_copy_only=False)]
            _, once = np.unique(gram[ends], return_index=True)
            yield batch.take(pa.array(np.unique(np.concatenate([ends[once], ends[once] + 1])), pa.int64()))
            last = batch.slice(batch.num_rows - 1)
        if last is not None:
            yield last

    ranged = marks.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    return spans.shared_grams(ranged.mapInArrow(neighbours, f"gram long, doc {kind}"))


def repeated_spans(docs: DataFrame, window: int = 50, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc, row, start, n_words, source): the passages of `window` words or more of
    each document that a document with a smaller key holds too, cut where the
    least such document changes; start counts words from 0.

    Null keys have no order and give no rows, nor do null or empty texts; rows that
    repeat a key do not count as repeats of each other. An empty table gives no
    rows.
    """
    rows = spans.keyed(docs, text, key)
    kind = spans.kind(rows)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict = {c: [] for c in ("i", "start", "n_words", "source")}
            for i, hits in enumerate(batch.column(2).to_pylist()):
                for a, n, s in spans.factors(*spans.held_windows(hits), window):
                    for c, v in zip(out, (i, a, n, s), strict=True):
                        out[c].append(v)
            doc, row = (batch.column(k).take(pa.array(out["i"], pa.int64())) for k in (0, 1))
            made = {c: pa.array(out[c], pa.int64()) for c in ("start", "n_words")}
            yield table(doc=doc, row=row, **made, source=pa.array(out["source"], batch.schema.field("doc").type))

    fields = f"doc {kind}, row long, start long, n_words long, source {kind}"
    return spans.earlier(rows, window, sorted_shared).select("doc", "row", "hits").mapInArrow(merged, fields)
