"""Substring dedup by relative Lempel-Ziv parsing.

The reference is the corpus itself in document order. Its phrases, the windows of
`window` words, are indexed in blocks dealt by their anchors, each phrase with the
least document that holds it; every phrase of a document is looked up in the one
block that could hold it, so no block of any document goes unread. From those
references a document is parsed from left to right: a factor goes on word by word while
the same earlier document holds the next phrase. Factors overlap where they meet, so windows across
a boundary are checked like all others. Words inside factors are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runaudit.llm import spans
from runaudit.llm.common import slices, stored, table, utf8


def parse(docs: DataFrame, window: int = 50, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc, row, text, n_words, n_removed, kept, factors) for every row of `docs`:
    `kept` is the words that are left, joined by one space, `factors` the
    (start, length, source) that were found.

    A word is removed if a window of `window` words that covers it also starts in
    a document with a smaller key. Null keys have no order: those rows stay whole
    and are no reference. Null and empty texts have no words. Rows that repeat a key
    are judged against smaller keys only. An empty table gives no rows.
    """
    rows = spans.keyed(docs, text, key)
    hits = stored(spans.earlier(rows, window), "hits")

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out: dict = {c: [] for c in ("n_words", "n_removed", "kept", "factors")}
            for raw, hit in zip(utf8(batch, "text"), batch.column(3).to_pylist(), strict=True):
                words = raw.split()
                got = spans.factors(*spans.held_windows(hit), window) if hit else []
                keep = np.ones(len(words), bool)
                for a, n, _ in got:
                    keep[a : a + n] = False
                left = [w for w, k in zip(words, keep.tolist(), strict=True) if k] if got else words
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(left))
                out["kept"].append(b" ".join(left).decode())
                out["factors"].append([{"start": a, "length": n, "source": s} for a, n, s in got])
            kinds = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.string()}
            made = {c: pa.array(out[c], kinds[c]) for c in kinds}
            source_kind = batch.schema.field("doc").type
            entry = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("source", source_kind)])
            made["factors"] = pa.array(out["factors"], pa.list_(entry))
            yield table(doc=batch.column(0), row=batch.column(1), **made)

    joined = rows.join(hits, ["doc", "row"], "left")
    fields = f"doc {spans.kind(rows)}, row long, n_words long, n_removed long, kept string"
    fields += f", factors array<struct<start: long, length: long, source: {spans.kind(rows)}>>"
    return joined.select("doc", "row", "text", "hits").mapInArrow(parsed, fields)


