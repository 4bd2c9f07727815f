"""The incident report: one row per (run, instant), evidence in long form."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runaudit import vocab as V
from runaudit.operators import intervals as I
from runaudit.operators.ranges import overlapping, points_in
from runaudit.operators.scan import Fold, dealt
from runaudit.plans import questions as Q

STRATEGY = (
    "Read what was declared and in force at the instant, every action judged while those "
    "declarations ran, and the bound that was applied; then check both record chains."
)
JUSTIFICATION = (
    "Only the scene clause depends on perceived entities. Declarations, verdicts and chains come "
    "from the machine's own state, so an error of perception cannot turn a refusal into a permit."
)


@dataclass
class Report:
    summary: DataFrame
    evidence: DataFrame


def _pick(name: str, prefix: str) -> list[Column]:
    fields = ("verdict_id", "t", "outcome", "fault", "declaration_id", "region_id", "area")
    return [F.col(f"{name}.{f}").alias(f"{prefix}_{f}") for f in fields]


def windows(bound: Q.Answer) -> DataFrame:
    """From the first issue to the last expiry of what was in force at t, of answered asks."""
    return bound.summary.filter(F.col("verdict") == V.ANSWERED).select("run_id", "t", "t0", "t1")


def in_window(verdicts: DataFrame, window: DataFrame, out: str) -> DataFrame:
    """Verdicts beside whether they lie between the ends of their run's windows: narrow rows, and one join
    by run, so that only what a report can read meets its region."""
    ends = window.groupBy("run_id").agg(F.min("t0").alias("_t0"), F.max("t1").alias("_t1"))
    return verdicts.join(ends, "run_id", "left").withColumn(
        out, F.coalesce(F.col("t").between(F.col("_t0"), F.col("_t1")), F.lit(False))
    ).drop("_t0", "_t1")


def incident_report(
    bound: Q.Answer, window: DataFrame, verdicts: DataFrame, every_verdict: DataFrame,
    chain_states: DataFrame, intersects: DataFrame, scene_runs: DataFrame, period: Column,
) -> Report:
    """Q12. `bound` answers the asks, `window` is `windows` of it, `verdicts` are the joined
    record rows, of the verdicts inside a window at least, and `every_verdict` is the record as it is.
    `chain_states` is one row per run, `intersects` the INTERSECTS intervals, and `scene_runs`
    the runs that hold any layer B edge.

    A run whose bound cannot be told keeps its row, refused. What chains say stands in the
    summary alone, so evidence is told without walking them.
    """
    keys = ["run_id", "t"]
    ok = F.col("verdict") == V.ANSWERED

    inside = points_in(verdicts.withColumnRenamed("t", "vt"), window, ["run_id"], "vt", "t0", "t1")
    refused = F.col("outcome") != V.PERMIT
    item = F.struct(
        "seq", "verdict_id", F.col("vt").alias("t"), "outcome", "fault", "declaration_id", "region_id", "area"
    )
    found = inside.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("adjudications"),
        F.count(F.when(refused, 1)).alias("refused"),
        # at most nine members: the fault vocabulary is closed
        F.array_join(F.sort_array(F.collect_set(F.when(refused, F.col("fault")))), ",").alias("faults"),
        F.min(F.when(refused, item)).alias("first"),
    )
    earliest = (
        every_verdict.filter(refused)
        .groupBy("run_id")
        .agg(F.min(F.struct("t", "seq", "verdict_id", "fault")).alias("earliest"))
    )

    visits = (
        I.merge_adjacent(
            overlapping(intersects, window, ["run_id"], "t_start", "t_end", "t0", "t1"),
            period, [], keys=("run_id", "t", "entity_id"),
        )
    )
    scene = visits.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("visits"), F.sum("frames").alias("scene_frames"),
        F.count_distinct("entity_id").alias("scene_entities"),
    )
    b_layer = scene_runs.select("run_id").distinct().withColumn("_scene", F.lit(True))

    zero = F.lit(0).cast("long")
    base = (
        bound.summary.join(dealt(chain_states), "run_id", "left")
        .join(dealt(found), keys, "left")
        .join(dealt(earliest), "run_id", "left")
        .join(dealt(scene), keys, "left")
        .join(b_layer, "run_id", "left")
    )
    integrity = F.coalesce("state", F.lit(V.CNE))
    has_scene = F.coalesce("_scene", F.lit(False))
    content = F.when(ok, F.lit("declared,violation,enforcement,scene")).otherwise(F.lit("declared"))
    summary = base.select(
        *keys, "verdict", "reason", integrity.alias("integrity"),
        F.coalesce("records_walked", zero).alias("records_walked"), "in_force",
        F.when(ok, F.col("t0")).alias("window_start"), F.when(ok, F.col("t1")).alias("window_end"),
        F.when(ok, F.coalesce("adjudications", zero)).alias("adjudications"),
        F.when(ok, F.coalesce("refused", zero)).alias("refused"),
        F.when(ok, F.coalesce("faults", F.lit(""))).alias("faults"),
        F.when(ok, F.coalesce("refused", zero) > 0).alias("incident"),
        *_pick("first", "first"),
        F.when(ok, F.col("earliest.verdict_id")).alias("earliest_verdict_id"),
        F.when(ok, F.col("earliest.t")).alias("earliest_t"),
        F.when(ok, F.when(has_scene, F.lit(V.ANSWERED)).otherwise(F.lit(V.CNE))).alias("scene_verdict"),
        F.when(ok & has_scene, F.coalesce("visits", zero)).alias("scene_visits"),
        F.when(ok & has_scene, F.coalesce("scene_entities", zero)).alias("assumptions"),
        # an unverified record is said first: every other clause rests on it
        F.when(integrity == V.VERIFIED, F.concat(content, F.lit(",integrity")))
        .otherwise(F.concat(F.lit("integrity,"), content))
        .alias("clause_order"),
        F.concat(
            F.lit("the policy stayed inside the bound it declared and had in force at t="),
            F.col("t").cast("string"),
        ).alias("goal"),
        F.lit(STRATEGY).alias("strategy"),
        F.lit(JUSTIFICATION).alias("justification"),
    )

    a, b = F.lit(V.LAYER_A), F.lit(V.LAYER_B)

    def rows(df, clause, kind, ref, layer):
        return df.select(
            *keys, F.lit(clause).alias("clause"), F.lit(kind).alias("kind"),
            ref.alias("ref"), layer.alias("layer"),
        )

    held = bound.rows.join(window.select(*keys), keys, "left_semi")
    first = window.join(found, keys).select(*keys, *_pick("first", "first"))
    first = first.filter(F.col("first_verdict_id").isNotNull())
    evidence = (
        rows(held, "declared", "declaration", F.col("declaration_id"), a)
        .unionByName(rows(held, "declared", "envelope", F.col("region_id"), a))
        .unionByName(rows(first, "violation", "verdict", F.col("first_verdict_id"), a))
        .unionByName(rows(first, "enforcement", "verdict", F.col("first_verdict_id"), a))
        .unionByName(
            rows(
                first.filter(F.col("first_region_id").isNotNull()), "enforcement", "envelope",
                F.col("first_region_id"), a,
            )
        )
        .unionByName(rows(visits, "scene", "intersects", F.col("entity_id"), b))
    )
    return Report(summary, evidence)
