"""Frame streams as text: one header, optional `# key=value` block, fixed
six-decimal rows.

Files differ in layout (joints, obstacles), so rows are parsed from text by
positions each file's own header gives: one plan for any mix of layouts, and
no file list passes through the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runaudit.functions import scalars as S

PERSON = ("human_x", "human_y", "human_vx", "human_vy")
OBSTACLE = ("id", "kind", "x", "y", "r")


def expected_header(joints: Column, obstacles: Column) -> Column:
    """The only header a stream of this many joints and obstacles has."""

    def names(count, *patterns):
        return F.when(count > 0, F.flatten(F.transform(
            F.sequence(F.lit(0), count - 1),
            lambda i: F.array(*[F.concat(F.lit(a), i.cast("string"), F.lit(b)) for a, b in patterns]),
        ))).otherwise(F.array().cast("array<string>"))

    parts = F.concat(
        F.array(F.lit("t")),
        names(joints, ("q_", "")),
        names(joints, ("qd_", "")),
        F.array(*[F.lit(c) for c in PERSON]),
        names(obstacles, *[("obs_", f"_{c}") for c in OBSTACLE]),
    )
    return F.array_join(parts, ",")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line beside its file and the directory's partition columns. `block` is where the
    part of the file begins that one task reads, `place` grows along it."""
    return spark.read.text(path).select(
        "*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
    )


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """`read_lines` of streams that `write_bundles` wrote: `file` is a stream's own name, and the
    keys are read from it."""
    lines = spark.read.text(path).select(
        F.split("value", "\t", 2).alias("v"), F.col("_metadata.file_path").alias("bundle"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"),
    )
    name = F.split(F.col("v")[0], "/")
    return lines.select(
        F.col("v")[1].alias("value"), name[0].cast("long").alias("run_id"), name[1].cast("long").alias("chunk"),
        F.concat_ws("#", "bundle", F.col("v")[0]).alias("file"), "block", "place",
    )


def line_numbers(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Adds `line`, the 1-based number in its file, to some of `lines`. Lines are counted a
    block at a time, and the counts of the blocks before are added; no file is one task."""
    counts = lines.groupBy("file", "block").agg(F.min("place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.select("file", "block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        rows.join(blocks, ["file", "block"])
        .withColumn("line", F.col("_before") + F.col("place") - F.col("_first") + 1)
        .drop("_before", "_first")
    )


def _content(lines: DataFrame) -> DataFrame:
    return lines.filter(~F.col("value").startswith("#") & (F.trim("value") != ""))


def header_layouts(lines: DataFrame) -> DataFrame:
    """S2 per file: the first line that is no comment, with its joints and obstacles, and
    whether it is exactly the header of those. NULL if it is no header at all."""
    first = _content(lines).groupBy("file").agg(F.min(F.struct("block", "place", "value")).alias("h"))
    h = first.select("file", F.col("h.value").alias("header"), F.col("h.block").alias("block"), F.col("h.place").alias("place")).filter(
        F.col("header").startswith("t,")
    ).select(
        "file", "header", "block", "place",
        F.size(F.regexp_extract_all("header", F.lit(r"(?:^|,)(q_\d+)"), 1)).alias("joints"),
        F.size(F.regexp_extract_all("header", F.lit(r"(?:^|,)(obs_\d+_id)"), 1)).alias("obstacles"),
    )
    return h.withColumn(
        "valid", F.col("header") == expected_header(F.col("joints"), F.col("obstacles"))
    )


SECOND_HEADER = "header inside the data"

def provenance(lines: DataFrame, keys: list[str]) -> DataFrame:
    """key=value rows of the comment block."""
    kv = F.split(F.trim(F.expr("substring(value, 2)")), "=", 2)
    return (
        lines.filter(F.col("value").startswith("#") & F.col("value").contains("="))
        .select(*keys, F.trim(kv[0]).alias("key"), F.trim(kv[1]).alias("value"))
        .distinct()
    )


def read_frames(lines: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Typed frames and the quarantine of rows that do not fit.

    Short rows, text where a number belongs, NaN and infinities, and headers after the
    first line go to the quarantine with a reason and the line of the file; nothing is
    dropped silently.
    """
    layout = header_layouts(lines).select(
        "file", "joints", "obstacles", "valid", F.struct("block", "place").alias("_header")
    )
    j, o = F.col("joints"), F.col("obstacles")
    here = F.struct("block", "place")
    # every field is read as a number once, before rows are dealt: later on it would be read again for each use
    read = F.transform(F.split("value", ","), lambda x: x.try_cast("double"))
    numbers = _content(lines).withColumn("_n", F.transform(read, lambda x: F.when(S.finite(x), x)))
    p = numbers.join(layout, "file", "left").filter(F.col("_header").isNull() | (here != F.col("_header")))
    def num(i: Column) -> Column:
        return F.get(F.col("_n"), i)

    def nums(start: Column, count: Column) -> Column:
        # a short row is padded: it is refused for its length, and its missing fields are NULL
        field = F.transform(F.sequence(F.lit(0), count - 1), lambda i: num(start + i))
        whole = F.when(F.size("_n") >= start + count, F.slice("_n", start + 1, count)).otherwise(field)
        return F.when(count > 0, whole).otherwise(F.array().cast("array<double>"))

    at = 1 + 2 * j
    objects = F.when(
        o > 0,
        F.transform(
            F.sequence(F.lit(0), o - 1),
            lambda i: F.struct(
                F.get(F.split("value", ","), at + 4 + 5 * i).alias("entity_id"),
                F.get(F.split("value", ","), at + 5 + 5 * i).alias("kind"),
                num(at + 6 + 5 * i).alias("cx"), num(at + 7 + 5 * i).alias("cy"),
                num(at + 8 + 5 * i).alias("r"),
            ),
        ),
    )
    typed = p.select(
        *keys, "file", "block", "place", "value", "valid",
        (F.size("_n") == 1 + 2 * j + 4 + 5 * o).alias("_whole"),
        num(F.lit(0)).alias("t"), nums(F.lit(1), j).alias("q"), nums(1 + j, j).alias("qd"),
        F.struct(
            num(at).alias("x"), num(at + 1).alias("y"), num(at + 2).alias("vx"), num(at + 3).alias("vy")
        ).alias("human"),
        objects.alias("objects"),
    )
    holes = reduce(
        lambda a, b: a | b,
        [
            F.col("t").isNull(), F.exists("q", lambda x: x.isNull()), F.exists("qd", lambda x: x.isNull()),
            *[F.col(f"human.{c}").isNull() for c in ("x", "y", "vx", "vy")],
            F.coalesce(F.exists("objects", lambda b: b.cx.isNull() | b.cy.isNull() | b.r.isNull()), F.lit(False)),
        ],
    )
    reason = (
        F.when(F.col("valid").isNull(), F.lit("file has no header"))
        .when(~F.col("valid"), F.lit("unknown header"))
        .when(F.col("value").startswith("t,"), F.lit(SECOND_HEADER))
        .when(~F.col("_whole"), F.lit("wrong number of fields"))
        .when(holes, F.lit("not a finite number"))
    )
    marked = typed.withColumn("reason", reason)
    good = marked.filter(F.col("reason").isNull()).select(*keys, "t", "q", "qd", "human", "objects")
    bad = marked.filter(F.col("reason").isNotNull()).select(*keys, "file", "block", "place", "value", "reason")
    return good, line_numbers(bad, lines).select(*keys, "file", "line", "value", "reason")


def frame_line(t, q, qd, person, obstacles) -> Column:
    """One row of a stream; obstacles are (id, kind, x, y, r) Columns."""

    def texts(*xs):
        # one formatting expression per group of numbers keeps the plan small
        return F.array_join(F.transform(F.array(*xs), lambda x: S.fixed_text(x)), ",")

    cells = [texts(t, *q, *qd, *person)]
    for oid, kind, x, y, r in obstacles:
        cells += [oid, kind, texts(x, y, r)]
    return F.concat_ws(",", *cells)


def _streams(lines: DataFrame, headers: DataFrame, comments: DataFrame) -> DataFrame:
    """Every stream's comment block, header and rows, dealt by stream and in order."""
    minus = F.lit(-1).cast("long")
    files = lines.select("run_id", "chunk").distinct()
    head = files.join(headers, "run_id").select("run_id", "chunk", F.lit(1).alias("_o"), minus.alias("frame_idx"), "line")
    note = files.join(comments, "run_id").select("run_id", "chunk", F.lit(0).alias("_o"), minus.alias("frame_idx"), "line")
    body = lines.select("run_id", "chunk", F.lit(2).alias("_o"), "frame_idx", "line")
    return (
        body.unionByName(head).unionByName(note)
        .repartition("run_id", "chunk")
        .sortWithinPartitions("run_id", "chunk", "_o", "frame_idx", "line")
    )


def write_frames(
    lines: DataFrame, headers: DataFrame, comments: DataFrame, path: str
) -> None:
    """Text files per (run_id, chunk), each with its comment block and
    header. A long run becomes several files, so no task writes a whole run.

    lines: run_id, chunk, frame_idx, line; headers and comments: run_id, line.
    """
    (
        _streams(lines, headers, comments)
        .select("run_id", "chunk", F.col("line").alias("value"))
        .write.partitionBy("run_id", "chunk").mode("overwrite").text(path)
    )


def write_bundles(lines: DataFrame, headers: DataFrame, comments: DataFrame, path: str) -> None:
    """S5 for many short runs: the streams of `write_frames`, many to a text file. Each line stands behind
    its stream's name (run_id/chunk) and a tab. A file costs some 30 ms to make, to list and to open,
    whatever it holds, so files grow with the rows here, and not with the runs."""
    name = F.concat_ws("/", F.col("run_id").cast("string"), F.col("chunk").cast("string"))
    _streams(lines, headers, comments).select(F.concat_ws("\t", name, "line").alias("value")).write.mode("overwrite").text(path)
