"""Line dedup by a suffix array over line-ID sequences, in DataFrame operations.

A document is the sequence of its lines that hold a word. Prefix doubling ranks
its suffixes: by their first line, then by twice as many lines from the ranks of
a suffix and of the one that starts where its prefix ends. A rank is the first
occurrence of the prefix, so equal ranks are equal prefixes; suffixes with a
prefix of their own drop out at once, since longer prefixes have none either.
Doubling ends at `min_lines`: a class of equal ranks is then an interval of the
suffix array whose longest common prefix has that many lines. Its first suffix
stays, and windows of the others that follow one another on the source's diagonal
form the maximal repeated runs, which are deleted.

Classes are aggregated before they are shuffled, and a class is joined back to
its members by a join that can be split, so no common line is a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runaudit.llm.common import spare, stored

_WORD = r"[^\x20\x09-\x0D]"


def raw_lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def numbered(text: str) -> Column:
    """Lines with a word, each with its place among all lines."""
    placed = F.transform(raw_lines(text), lambda x, j: F.struct(x.alias("line"), j.alias("j")))
    return F.filter(placed, lambda s: s["line"].rlike(_WORD))


def classes(rows: DataFrame, name: list[str]) -> DataFrame:
    """Suffixes whose prefix, called `name`, is found twice or more, with its first
    occurrence (fd, fi). Rows of one text are repeats of each other too."""
    first = (
        rows.groupBy(*name)
        .agg(F.min(F.struct("doc", "i")).alias("_f"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .select(*name, F.col("_f.doc").alias("fd"), F.col("_f.i").alias("fi"))
    )
    return rows.join(first, name).select("doc", "row", "i", "j", "last", "fd", "fi")


def doubled(ranked: DataFrame, step: int) -> DataFrame:
    """Rank by longer prefixes: those of a suffix and of the one `step` lines on."""
    on = ranked.select(
        "doc", "row", (F.col("i") - step).alias("i"), F.col("last").alias("_last"), F.col("fd").alias("gd"), F.col("fi").alias("gi")
    )
    pairs = ranked.join(on, ["doc", "row", "i"]).select(
        "doc", "row", "i", "j", F.col("_last").alias("last"), F.col("fd").alias("ad"), F.col("fi").alias("ai"), "gd", "gi"
    )
    return stored(classes(pairs, ["ad", "ai", "gd", "gi"]), "ranks")


def named_lines(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(doc, row, i, j, last, words, h1, h2): lines with a word; i counts them, j all lines of the text."""
    lines = docs.where(F.col(key).isNotNull()).select(
        F.col(key).alias("doc"), F.xxhash64(text).alias("row"), F.posexplode(numbered(text)).alias("i", "s")
    )
    return lines.select(
        "doc", "row", "i", F.col("s.j").alias("j"), F.col("s.j").alias("last"),
        F.regexp_count("s.line", F.lit(_WORD + "+")).alias("words"),
        F.xxhash64("s.line").alias("h1"), F.xxhash64(F.lit("second"), "s.line").alias("h2"),
    ).distinct()


def later(ranked: DataFrame) -> DataFrame:
    return ranked.where("fd < doc or (fd = doc and fi < i)")


def repeated_runs(docs: DataFrame, min_lines: int, text: str, key: str, min_words: int | None = None) -> DataFrame:
    """(doc, row, start, last, n_lines, source, source_line): maximal runs of lines
    that start earlier, in order of (key, line), somewhere else. start and last count all
    lines of the text, source_line those with a word. Runs have `min_lines` lines, or else
    `min_words` words."""
    named = stored(named_lines(docs, text, key), "lines")
    ranked, size, found = stored(classes(named, ["h1", "h2"]), "ranks"), 1, None

    def windows(ranked: DataFrame, size: int) -> DataFrame:
        return later(ranked).select("doc", "row", "i", "j", "last", "fd", "fi", F.lit(size).alias("size"))

    while size < min_lines:
        if min_words is not None:  # windows of few lines count where their words do
            few = windows(ranked, size)
            at = few.select("doc", "row", "i", F.explode(F.sequence(F.col("i"), F.col("i") + size - 1)).alias("_at"))
            counted = named.select("doc", "row", F.col("i").alias("_at"), "words")
            enough = at.join(counted, ["doc", "row", "_at"]).groupBy("doc", "row", "i").agg(F.sum("words").alias("_w"))
            few = few.join(enough.where(F.col("_w") >= min_words).drop("_w"), ["doc", "row", "i"], "left_semi")
            found = few if found is None else found.unionAll(few)
        step = min(size, min_lines - size) if min_words is None else 1
        ranked, size = doubled(ranked, step), size + step
    whole = windows(ranked, size)
    found = whole if found is None else found.unionAll(whole)
    diagonal = ["doc", "row", "fd", F.col("fi") - F.col("i"), "size"]
    along = Window.partitionBy(*diagonal).orderBy("i")
    runs = found.withColumn("_run", F.col("i") - F.row_number().over(along))
    return runs.groupBy("doc", "row", "fd", (F.col("fi") - F.col("i")).alias("_d"), "size", "_run").agg(
        F.min("j").alias("start"),
        F.max("last").alias("last"),
        (F.count(F.lit(1)) + F.col("size") - 1).alias("n_lines"),
        F.min("fi").alias("source_line"),
    ).select("doc", "row", "start", "last", "n_lines", F.col("fd").alias("source"), "source_line")


def dedup_lines(
    docs: DataFrame, min_lines: int = 3, text: str = "text", key: str = "doc_id", min_words: int | None = None
) -> DataFrame:
    """Every row of `docs` with all its columns; `text` without the repeated runs,
    `n_lines` and `n_deleted` counting its lines with a word, before and of those deleted.

    A line goes if `min_lines` consecutive lines around it, blank lines apart, also
    start at an earlier place: in a document with a smaller key, or further up in the
    same one. With `min_words`, fewer lines do if together they have so many words; without
    it, shorter runs stay however long their lines are. Columns of any name stay, but for
    `n_lines` and `n_deleted`, which are replaced. Blank lines inside a deleted run go with it. Null keys have no order:
    those rows stay whole. Null text stays null and has no lines. Rows equal in
    key and text are one text. An empty table gives no rows.
    """
    found = repeated_runs(docs, min_lines, text, key, min_words).select("doc", "row", "start", "last")
    kept_columns = [c for c in docs.columns if c.lower() not in ("n_lines", "n_deleted")]
    doc_, row_, runs_, mine, left_ = spare([*docs.columns, "n_lines", "n_deleted"], "_doc", "_r", "_runs", "_row", "_left")
    # every run is cut to the lines it deletes, once: a line in many runs is one row
    lines = found.select("doc", "row", F.explode(F.sequence("start", "last")).alias("j")).distinct()
    gone = lines.groupBy(F.col("doc").alias(doc_), F.col("row").alias(row_)).agg(F.array_sort(F.collect_list("j")).alias(runs_))
    inside = docs.select(*kept_columns).withColumn(mine, F.xxhash64(text))
    joined = inside.join(gone, (F.col(key) == F.col(doc_)) & (F.col(mine) == F.col(row_)), "left")
    # a flag for each line up to the last deleted one, so that lines and flags pass side by side
    before = lambda k: F.coalesce(F.get(F.col(runs_), k - 1), F.lit(-1))
    step = lambda k: F.concat(
        F.array_repeat(F.lit(False), F.get(F.col(runs_), k) - before(k) - 1), F.array(F.lit(True))
    )
    flags = F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs_) - 1), step))
    free = F.zip_with(raw_lines(text), flags, lambda x, gone: F.when(gone, F.lit(None)).otherwise(x))
    words = lambda lines: F.size(F.filter(lines, lambda x: x.rlike(_WORD))).cast("long")
    left = F.when(F.col(runs_).isNull(), F.col(text)).otherwise(F.array_join(free, "\n"))
    return (
        joined.withColumn(left_, left)
        .withColumn("n_lines", words(raw_lines(text)))
        .withColumn("n_deleted", F.col("n_lines") - words(raw_lines(left_)))
        .withColumn(text, F.col(left_))
        .select(*kept_columns, "n_lines", "n_deleted")
    )
