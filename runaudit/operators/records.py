"""Edges, events and states derived from the two record tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runaudit import vocab as V
from runaudit.operators.scan import Scan, dealt, ranged, running
from runaudit.sources.bindings import region_id

EDGE_COLUMNS = ("run_id", "type", "src_id", "dst_id", "t_start", "t_end")


def attestation_edges(
    declarations: DataFrame, verdicts: DataFrame, regions: DataFrame | None = None,
    chunk_rows: int = V.CHUNK_ROWS,
) -> DataFrame:
    """B1: DECLARED, ADJUDICATED only where a declaration is named, ENFORCED
    only for a clamp, FOLLOWS between consecutive records of one kind."""
    declared = declarations.select(
        "run_id", F.lit("DECLARED").alias("type"), F.col("declaration_id").alias("src_id"),
        region_id("declared", F.col("declaration_id")).alias("dst_id"),
        F.col("t_issued").alias("t_start"), (F.col("t_issued") + F.col("horizon")).alias("t_end"),
    )
    if regions is not None:
        declared = declared.join(
            regions.filter(F.col("source") == "declared").select("run_id", F.col("region_id").alias("dst_id")),
            ["run_id", "dst_id"], "left_semi",
        ).select(*EDGE_COLUMNS)
    adjudicated = verdicts.filter(F.col("declaration_id").isNotNull()).select(
        "run_id", F.lit("ADJUDICATED").alias("type"), F.col("verdict_id").alias("src_id"),
        F.col("declaration_id").alias("dst_id"), F.col("t").alias("t_start"), F.col("t").alias("t_end"),
    )
    enforced = verdicts.filter(F.col("outcome") == "CLAMP").select(
        "run_id", F.lit("ENFORCED").alias("type"), F.col("verdict_id").alias("src_id"),
        region_id("clamped", F.col("verdict_id")).alias("dst_id"),
        F.col("t").alias("t_start"), F.col("t").alias("t_end"),
    )
    return (
        declared.unionByName(adjudicated)
        .unionByName(enforced)
        .unionByName(follows(declarations, verdicts, chunk_rows).drop("kind"))
    )


def record_union(declarations: DataFrame, verdicts: DataFrame) -> DataFrame:
    d = declarations.select(
        "run_id", F.lit("Declaration").alias("kind"), F.col("declaration_id").alias("record_id"),
        "seq", F.col("t_issued").alias("t"),
    )
    v = verdicts.select(
        "run_id", F.lit("Verdict").alias("kind"), F.col("verdict_id").alias("record_id"),
        "seq", "t",
    )
    return d.unionByName(v)


def follows(declarations: DataFrame, verdicts: DataFrame, chunk_rows: int = V.CHUNK_ROWS) -> DataFrame:
    """FOLLOWS [min t, max t] from each record to the one before it in its chain."""
    recs = record_union(declarations, verdicts).withColumn(
        "chunk", F.floor(F.col("seq") / chunk_rows).cast("long")
    )
    linked = running(
        recs, ["run_id", "kind"], "chunk", ["seq", "record_id"],
        [Scan("_prev", "lag", F.struct("record_id", "t"))],
    ).filter(F.col("_prev").isNotNull())
    return linked.select(
        "run_id", F.lit("FOLLOWS").alias("type"), "kind", F.col("record_id").alias("src_id"),
        F.col("_prev.record_id").alias("dst_id"),
        F.least("t", "_prev.t").alias("t_start"), F.greatest("t", "_prev.t").alias("t_end"),
    )


def dangling_links(edges: DataFrame, records: DataFrame) -> DataFrame:
    """FOLLOWS endpoints with no surviving record of that kind."""
    ends = edges.filter(F.col("type") == "FOLLOWS").select(
        "run_id", "kind",
        F.explode(
            F.array(
                F.struct(F.lit("source").alias("end"), F.col("src_id").alias("record_id")),
                F.struct(F.lit("target").alias("end"), F.col("dst_id").alias("record_id")),
            )
        ).alias("e"),
    ).select("run_id", "kind", "e.end", "e.record_id")
    return ends.join(
        records.select("run_id", "kind", "record_id"), ["run_id", "kind", "record_id"], "left_anti"
    )


def passivation(verdicts: DataFrame, chunk_rows: int = V.CHUNK_ROWS) -> DataFrame:
    """Sticky passivation before and after each verdict. A PERMIT or CLAMP
    ends it; a passivating fault starts or renews it."""
    passivating = F.coalesce(F.col("fault").isin(*V.PASSIVATING_FAULTS), F.lit(False))
    mark = (
        F.when(passivating, F.struct(F.lit(True).alias("on"), F.col("fault").alias("fault")))
        .when(
            F.col("outcome").isin("PERMIT", "CLAMP"),
            F.struct(F.lit(False).alias("on"), F.lit(None).cast("string").alias("fault")),
        )
    )
    v = verdicts.withColumn("chunk", F.floor(F.col("seq") / chunk_rows).cast("long"))
    return running(
        v, ["run_id"], "chunk", ["seq", "verdict_id"],
        [
            Scan("_before", "last", mark),
            Scan("_after", "last", mark, inclusive=True),
        ],
    ).select(
        *verdicts.columns,
        F.coalesce(F.col("_before.on"), F.lit(False)).alias("passivated_before"),
        F.coalesce(F.col("_after.on"), F.lit(False)).alias("passivated_after"),
        F.col("_after.fault").alias("passivation_fault"),
    )


def enforcement_events(verdicts: DataFrame, chunk_rows: int = V.CHUNK_ROWS) -> DataFrame:
    """B2: occurrences a verdict gives rise to; a PERMIT alone gives none."""
    p = passivation(verdicts, chunk_rows)
    escalation = (F.col("outcome") == "SAFE_STATE") & (F.col("fault") == "escalation_failure")
    back = F.when(
        F.col("passivated_before") & F.col("outcome").isin("PERMIT", "CLAMP"), F.lit("reintegrated")
    )
    own = (
        F.when(escalation, F.lit("escalation_failed"))
        .when(
            (F.col("outcome") == "SAFE_STATE") & ~F.col("passivated_before"),
            F.lit("safe_state_entered"),
        )
        .when(F.col("outcome") == "VETO", F.lit("declaration_vetoed"))
        .when(F.col("outcome") == "CLAMP", F.lit("action_clamped"))
    )
    pairs = F.array(
        F.struct(F.lit(0).alias("ordinal"), back.alias("type")),
        F.struct(F.lit(1).alias("ordinal"), own.alias("type")),
    )
    return (
        p.select("run_id", "verdict_id", "seq", "t", F.explode(pairs).alias("e"))
        .select("run_id", "verdict_id", "seq", "t", "e.ordinal", "e.type")
        .filter(F.col("type").isNotNull())
    )


def passivation_spans(verdicts: DataFrame, chunk_rows: int = V.CHUNK_ROWS) -> DataFrame:
    """Maximal stretches of verdicts during which a run stood passivated."""
    from runaudit.operators.scan import Fold, spans

    p = passivation(verdicts, chunk_rows).withColumn(
        "chunk", F.floor(F.col("seq") / chunk_rows).cast("long")
    )
    s = spans(
        p, ["run_id"], "chunk", ["seq", "verdict_id"],
        lambda a, b: a["passivated_after"] != b["passivated_after"],
        ["passivated_after"],
        [
            Fold("on", "first", F.col("passivated_after")),
            Fold("seq_first", "min", F.col("seq")),
            Fold("seq_last", "max", F.col("seq")),
            Fold("t_first", "first", F.col("t")),
            Fold("t_last", "last", F.col("t")),
            Fold("last_fault", "last", F.col("passivation_fault")),
            Fold("verdicts", "sum", F.lit(1)),
        ],
    )
    return s.filter("on").drop("on")


def asof_declaration(
    declarations: DataFrame, verdicts: DataFrame, parts: int | None = None
) -> DataFrame:
    """The latest declaration issued at or before each action, by one
    ordered pass over both streams instead of a range join."""
    d = declarations.select(
        "run_id", F.col("t_issued").alias("t"), F.lit(0).alias("_side"), F.col("seq").alias("_seq"),
        F.struct("seq", "declaration_id", "t_issued", "horizon").alias("_decl"),
        F.lit(None).cast("string").alias("verdict_id"),
    )
    v = verdicts.select(
        "run_id", "t", F.lit(1).alias("_side"), F.col("seq").alias("_seq"),
        F.lit(None).cast(d.schema["_decl"].dataType).alias("_decl"), "verdict_id",
    )
    both = ranged(d.unionByName(v), ["run_id"], ["t", "_side", "_seq"], parts)
    return (
        running(
            both, ["run_id"], "chunk", ["t", "_side", "_seq"],
            [Scan("_in", "last", F.col("_decl"), inclusive=True)],
        )
        .filter(F.col("_side") == 1)
        .select(
            "run_id", "verdict_id", "t",
            F.col("_in.declaration_id").alias("declaration_id"),
            (F.col("t") <= F.col("_in.t_issued") + F.col("_in.horizon")).alias("in_force"),
        )
    )


def watchdog_gaps(
    declarations: DataFrame, verdicts: DataFrame, period: float, t_start: float,
    parts: int | None = None,
) -> DataFrame:
    """Actions later than `period` after the last message heard; any
    offer counts as heard, a refused one too."""
    d = declarations.select(
        "run_id", F.col("t_issued").alias("t"), F.lit(0).alias("_side"), F.col("seq").alias("_seq"),
        F.lit(None).cast("string").alias("verdict_id"), F.col("t_issued").alias("_heard"),
    )
    v = verdicts.select(
        "run_id", "t", F.lit(1).alias("_side"), F.col("seq").alias("_seq"), "verdict_id",
        F.lit(None).cast("double").alias("_heard"),
    )
    both = ranged(d.unionByName(v), ["run_id"], ["t", "_side", "_seq"], parts)
    heard = F.greatest(F.coalesce(F.col("_last"), F.lit(t_start)), F.lit(t_start))
    return (
        running(
            both, ["run_id"], "chunk", ["t", "_side", "_seq"],
            [Scan("_last", "max", F.col("_heard"), inclusive=True)],
        )
        .filter(F.col("_side") == 1)
        .select(
            "run_id", "verdict_id", "t", heard.alias("last_heard"),
            (F.col("t") - heard > period).alias("expired"),
        )
    )


def replay_flags(
    offers: DataFrame, key: list[str], order: list[str], seq: str, chunk: str
) -> DataFrame:
    """An offer whose seq does not exceed every seq offered before it."""
    r = running(offers, key, chunk, order, [Scan("max_seq_before", "max", F.col(seq))])
    return r.withColumn(
        "replayed", F.coalesce(F.col(seq) <= F.col("max_seq_before"), F.lit(False))
    )


def due_declarations(
    frames: DataFrame, declarations: DataFrame, digits: int = 9
) -> tuple[DataFrame, DataFrame]:
    """Declarations delivered on the frame they are due, and the leftovers."""
    f = frames.withColumn("_k", F.bround("t", digits))
    d = declarations.withColumn("_k", F.bround("t_issued", digits))
    due = d.join(f.select("run_id", "_k", "frame_idx"), ["run_id", "_k"]).drop("_k")
    left = d.join(f.select("run_id", "_k"), ["run_id", "_k"], "left_anti").drop("_k")
    return due, left


def due_at_period(declarations: DataFrame, runs: DataFrame, digits: int = 9) -> DataFrame:
    """J1 where a run's frames come at a constant period: declarations with the frame they are due on, NULL for
    the leftovers. runs: run_id, t_first, frame_period_s, frame_count. The frame is found from the instant,
    so no frame is listed and nothing but the declarations is moved."""
    j = declarations.join(runs.select("run_id", "t_first", "frame_period_s", "frame_count"), "run_id", "left")
    i = F.rint((F.col("t_issued") - F.col("t_first")) / F.col("frame_period_s"))
    at = F.bround(F.col("t_first") + i * F.col("frame_period_s"), digits) == F.bround("t_issued", digits)
    due = at & (i >= 0) & (i < F.col("frame_count"))
    return j.select(*declarations.columns, F.when(due, i.cast("long")).alias("frame_idx"))


def probe_declarations(declarations: DataFrame, verdicts: DataFrame) -> DataFrame:
    """O2: the middle declaration's instant, and the declaration of the first
    refusal that names one (else the first declaration). Positions are seq,
    so the middle is an equality join and no run is ranked in one task."""
    mid = middle_instants(declarations)
    refused = (
        verdicts.filter((F.col("outcome") != V.PERMIT) & F.col("declaration_id").isNotNull())
        .groupBy("run_id")
        .agg(F.min(F.struct("seq", "declaration_id")).alias("_r"))
    )
    return mid.join(refused, "run_id", "left").select(
        "run_id", "declarations", "t_probe",
        F.coalesce("_r.declaration_id", "_d0.declaration_id").alias("probe_declaration_id"),
    )


def middle_instants(declarations: DataFrame) -> DataFrame:
    """The instant of each run's middle declaration, beside their number and the first of them."""
    n = declarations.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("declarations"), F.min(F.struct("seq", "declaration_id")).alias("_d0")
    )
    return n.join(
        declarations.select("run_id", "seq", F.col("t_issued").alias("t_probe")), "run_id"
    ).filter(F.col("seq") == F.floor(F.col("declarations") / 2))


def lost_links(alive: DataFrame, dead: DataFrame) -> DataFrame:
    """J8 for records told apart into those that survive and those that do not: the same rows as
    `dangling_links` of all their FOLLOWS edges. An end dangles where no survivor has its name, so only
    such records are asked for their neighbours, and no edge is listed or moved.

    Both are `record_union` rows; a record stands in one of them."""
    key = ["run_id", "kind"]
    lost = dead.select(*key, "seq", "record_id").join(
        dealt(alive.select(*key, "record_id")), [*key, "record_id"], "left_anti"
    )
    pos = F.struct("seq", "record_id")
    ends = alive.unionByName(dead).groupBy(*key).agg(F.min(pos).alias("_first"), F.max(pos).alias("_last"))
    # a record is the source of the edge to the one before it, and the target of the edge of the one after
    end = F.array_compact(
        F.array(
            F.when(F.col("_pos") > F.col("_first"), F.lit("source")),
            F.when(F.col("_pos") < F.col("_last"), F.lit("target")),
        )
    )
    return lost.withColumn("_pos", pos).join(dealt(ends), key).select(*key, F.explode(end).alias("end"), "record_id")
