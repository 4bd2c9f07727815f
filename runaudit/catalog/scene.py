"""Queries over the scene side: frames, observations, intervals, questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from runaudit import vocab as V
from runaudit.catalog import register
from runaudit.functions import scalars as S
from runaudit.operators import checks as C
from runaudit.operators import intervals as I
from runaudit.operators.scan import Fold, durable
from runaudit.plans import build as B
from runaudit.plans import questions as Q
from runaudit.sources.bindings import Scene, table


def bucket(col, quantum=0.2):
    return F.rint(F.col(col) / F.lit(quantum)).cast("long")


def stored_edges(sc: Scene):
    """Scene edges as the runs' artifacts keep them: some runs keep none, and
    every 11th lost part of one entity's separation history."""
    r = F.col("run_id")
    lost = (
        (r % 11 == 0) & (F.col("type") == "SEPARATION") & (F.col("entity_id") == "obs_a")
        & (F.col("frame_first") % 7 == 0)
    )
    obs = sc.observations().filter(~((r % 5 == 0) | (r % 7 == 0)))
    return durable(I.coalesce_intervals(obs).filter(~lost))


def stored_occurrences(sc: Scene):
    r = F.col("run_id")
    keep = (r % 5 == 0) & (r % 7 != 0)
    return durable(
        B.scene_occurrences(
            sc.observations().filter(keep), sc.distances().filter(keep), sc.runs().filter(keep)
        )
    )


def asks(sc: Scene):
    """Ask every run about its three declared entities and one it never declared."""
    return sc.runs().select(
        "run_id",
        F.explode(
            F.array(F.lit("human"), F.lit("obs_a"), F.lit("spare"), F.lit("nobody"))
        ).alias("entity_id"),
    )


def layers(sc: Scene):
    """Layer flags read off the stored tables' run ids alone."""
    m = sc.meta()
    return m.select(
        "run_id", F.col("keeps_edges").alias("edge_layer"),
        F.col("keeps_occurrences").alias("occurrence_layer"),
    )


@register
def coalesce_intervals(spark, sf):
    e = I.coalesce_intervals(Scene(spark, sf).observations())
    return e.select(
        "run_id", "type", "entity_id", "frame_first", "frame_last", "t_start", "t_end",
        "overlap_area", bucket("min_distance").alias("distance_bucket"),
    )


@register
def merge_adjacent(spark, sf):
    sc = Scene(spark, sf)
    near = I.coalesce_intervals(sc.observations()).filter(
        (F.col("type") == "SEPARATION") & (F.col("min_distance") <= 1.0)
    )
    m = I.merge_adjacent(near, sc.step, [Fold("min_distance", "min", F.col("min_distance"))])
    return m.select(
        "run_id", "entity_id", "t_start", "t_end", "frames", "intervals",
        bucket("min_distance").alias("distance_bucket"),
    )


@register
def relationship_transitions(spark, sf):
    sc = Scene(spark, sf)
    return I.transitions(I.presence_spans(sc.observations()), sc.runs())


@register
def retained_frames(spark, sf):
    sc = Scene(spark, sf)
    obs = sc.observations()
    return I.retained_frames(I.presence_spans(obs), I.coalesce_intervals(obs), sc.runs())


@register
def region_timeline(spark, sf):
    sc = Scene(spark, sf)
    obs = durable(sc.observations())
    kept = I.retained_frames(I.presence_spans(obs), I.coalesce_intervals(obs), sc.runs())
    return I.region_timeline(sc.digests(), kept).select(
        "run_id", "region_id", "frame_first", "frame_last", "t_start", "t_end"
    )


@register
def region_at(spark, sf):
    sc = Scene(spark, sf)
    obs = durable(sc.observations())
    kept = I.retained_frames(I.presence_spans(obs), I.coalesce_intervals(obs), sc.runs())
    env = I.region_timeline(sc.digests(), kept).select("run_id", "region_id", "t_start", "t_end")
    ask = sc.runs().select("run_id", F.explode(F.array(F.lit(0.1), F.lit(0.3), F.lit(9.0))).alias("t"))
    return I.region_at(ask, env, sc.step)


@register
def expand_to_frames(spark, sf):
    sc = Scene(spark, sf)
    e = I.coalesce_intervals(sc.observations())
    return I.expand_to_frames(e, sc.frames(), sc.step).select(
        "run_id", "frame_idx", "type", "entity_id", "frame_first", "overlap_area",
        bucket("min_distance").alias("distance_bucket"),
    )


@register
def silent_filter(spark, sf):
    sc = Scene(spark, sf)
    return I.silent_filter(sc.frames(), sc.silent_windows(), sc.step).select(
        "run_id", "frame_idx", "t", "event_type"
    )


@register
def unknown_entity(spark, sf):
    sc = Scene(spark, sf)
    d = Q.with_known(Q.declared_entities(asks(sc), sc.entities()), sc.entities())
    return d.select(
        "run_id", "entity_id",
        F.when(F.col("declared"), F.lit(V.ANSWERED)).otherwise(F.lit(V.QUERY_ERROR)).alias("verdict"),
        Q.unknown_message(F.col("entity_id"), F.col("declared"), F.col("known")).alias("message"),
    )


@register
def available_layers(spark, sf):
    sc = Scene(spark, sf)
    return Q.available_layers(sc.runs(), stored_edges(sc), stored_occurrences(sc))


@register
def window_check(spark, sf):
    sc = Scene(spark, sf)
    w = sc.runs().select(
        "run_id",
        F.explode(
            F.array(
                F.struct(F.lit(0.0).alias("t0"), F.lit(0.5).alias("t1")),
                F.struct(F.lit(0.5).alias("t0"), F.lit(0.2).alias("t1")),
                F.struct(F.lit(0.0).alias("t0"), F.lit(1.3).alias("t1")),
                F.struct(F.lit(-0.005).alias("t0"), F.col("t_last").alias("t1")),
            )
        ).alias("w"),
    ).select("run_id", "w.t0", "w.t1")
    return Q.window_check(w, sc.runs())


@register
def separation_timeline(spark, sf):
    sc = Scene(spark, sf)
    a = Q.separation_timeline(
        asks(sc), sc.entities(), layers(sc), sc.frames(), stored_edges(sc), sc.step
    )
    return a.table(["run_id", "entity_id"]).select(
        "run_id", "entity_id", "verdict", "reason", "frame_idx", "t",
        bucket("distance").alias("distance_bucket"),
    )


@register
def first_envelope_intersection(spark, sf):
    sc = Scene(spark, sf)
    a = Q.first_envelope_intersection(
        asks(sc), sc.entities(), layers(sc), stored_edges(sc), sc.step
    )
    return a.table(["run_id", "entity_id"])


@register
def frames_at_risk(spark, sf):
    sc = Scene(spark, sf)
    a = Q.frames_at_risk(
        asks(sc), sc.entities(), layers(sc), stored_edges(sc), sc.step, threshold=1.0
    )
    return a.summary.withColumn("min_bucket", bucket("min_distance")).drop("min_distance")


@register
def risk_spans(spark, sf):
    sc = Scene(spark, sf)
    a = Q.frames_at_risk(
        asks(sc), sc.entities(), layers(sc), stored_edges(sc), sc.step, threshold=1.0
    )
    return a.rows.withColumn("min_bucket", bucket("min_distance")).drop("min_distance")


@register
def reachable_entities(spark, sf):
    sc = Scene(spark, sf)
    w = sc.runs().select("run_id", F.lit(0.1).alias("t0"), F.lit(0.6).alias("t1"))
    a = Q.reachable_entities(w, sc.runs(), sc.entities(), layers(sc), stored_edges(sc))
    return a.table(["run_id", "t0", "t1"])


@register
def reachable_set_equal(spark, sf):
    """The entity set a window reports against the set the frames give."""
    sc = Scene(spark, sf)
    w = sc.runs().select("run_id", F.lit(0.1).alias("t0"), F.lit(0.6).alias("t1"))
    a = Q.reachable_entities(w, sc.runs(), sc.entities(), layers(sc), stored_edges(sc))
    told = a.rows.select("run_id", "entity_id")
    answered = a.summary.filter(F.col("verdict") == V.ANSWERED).select("run_id")
    true = (
        sc.distances()
        .filter((F.col("distance") < 0.5) & F.col("t").between(0.095, 0.605))
        .select("run_id", "entity_id").distinct().join(answered, "run_id", "left_semi")
    )
    return C.set_equality(answered, told, true, ["entity_id"])


@register
def min_separation(spark, sf):
    sc = Scene(spark, sf)
    d = Q.min_separation(asks(sc), sc.entities(), layers(sc), stored_edges(sc), stored_occurrences(sc))
    return d.withColumn("value_cm", F.rint(F.col("value") * 100).cast("long")).drop("value")


@register
def time_of_closest_approach(spark, sf):
    sc = Scene(spark, sf)
    return Q.time_of_closest_approach(
        asks(sc), sc.entities(), layers(sc), stored_edges(sc), stored_occurrences(sc), sc.meta()
    )


@register
def did_contact_occur(spark, sf):
    sc = Scene(spark, sf)
    return Q.did_contact_occur(
        asks(sc), sc.entities(), layers(sc), stored_edges(sc), stored_occurrences(sc), sc.meta()
    )


@register
def closest_approach(spark, sf):
    c = B.closest_approach(Scene(spark, sf).distances())
    return c.select("run_id", "entity_id", "frame_idx", "bucket", "t")


@register
def occurrence_log(spark, sf):
    sc = Scene(spark, sf)
    log = B.scene_occurrences(sc.observations(), sc.distances(), sc.runs())
    return log.withColumn("value_cm", F.rint(F.col("value") * 100).cast("long")).drop("value")


@register
def time_base(spark, sf):
    sc = Scene(spark, sf)
    # half the frame period, so pairs of frames share an instant in odd runs
    f = sc.frames().withColumn(
        "t", F.when(F.col("run_id") % 2 == 0, F.col("t")).otherwise(F.col("frame_idx") * 0.004)
    )
    return C.time_base(f)


@register
def frame_period_check(spark, sf):
    sc = Scene(spark, sf)
    # every ninth run stutters once
    f = sc.frames().withColumn(
        "t",
        F.col("t") + F.when((F.col("run_id") % 9 == 0) & (F.col("frame_idx") >= 20), 0.013).otherwise(0.0),
    )
    return C.frame_period_check(f)


@register
def entity_set_check(spark, sf):
    sc = Scene(spark, sf)
    f = sc.frames()
    moved = (F.col("run_id") % 10 == 0) & (F.col("frame_idx") == 30)
    name = F.when(F.col("run_id") % 14 == 0, F.lit("human")).otherwise(F.lit("pallet"))
    e = f.select(
        "run_id", "frame_idx",
        F.explode(
            F.array(
                F.struct(F.lit("crate").alias("entity_id"), F.lit("box").alias("kind"),
                         F.when(moved, 1.7).otherwise(1.6).alias("cx"), F.lit(1.2).alias("cy"), F.lit(0.25).alias("r")),
                F.struct(name.alias("entity_id"), F.lit("box").alias("kind"),
                         F.lit(2.2).alias("cx"), F.lit(-0.8).alias("cy"), F.lit(0.2).alias("r")),
            )
        ).alias("e"),
    ).select("run_id", "frame_idx", "e.*")
    return C.entity_set_check(e, f.groupBy("run_id").agg(F.count(F.lit(1)).alias("frame_count")))


@register
def edge_counts(spark, sf):
    return B.edge_counts(I.coalesce_intervals(Scene(spark, sf).observations()), Scene(spark, sf).runs())


@register
def edge_scan(spark, sf):
    """INTERSECTS edges of one entity in (t_start, frame) order."""
    e = B.read_edges(I.coalesce_intervals(Scene(spark, sf).observations()), edge_type="INTERSECTS", dst="human")
    return e.select("run_id", "type", "entity_id", "t_start", "t_end", "frame_first", "overlap_area")


@register
def occurrence_scan(spark, sf):
    sc = Scene(spark, sf)
    log = B.scene_occurrences(sc.observations(), sc.distances(), sc.runs())
    return B.read_occurrences(log, kind="contact_began", entity_id="obs_a").select(
        "run_id", "seq", "type", "entity_id", "t"
    )


@register
def interpolate_knots(spark, sf):
    """J13 over events: every fourth frame is a knot, all frames are asked."""
    sc = Scene(spark, sf)
    f = sc.frames()
    knots = f.filter((F.col("frame_idx") % 4 == 0) & (F.col("frame_idx") > 0)).select(
        "run_id", "t", (F.col("event_id") % 500).cast("double").alias("v")
    )
    pts = f.select("run_id", F.col("frame_idx").alias("point_id"), "t")
    r = I.interpolate_knots(pts, knots)
    return r.select(
        "run_id", F.col("point_id").alias("frame_idx"),
        F.rint(F.col("value") * 1000).cast("long").alias("value_milli"),
        F.rint(F.col("slope") * 10).cast("long").alias("slope_deci"),
    )


@register
def run_meta_pivot(spark, sf):
    """key/value provenance rows, pivoted over the known keys."""
    from runaudit.sources import store

    return store.pivot_meta(provenance_rows(Scene(spark, sf)), ["k_first", "k_last", "frames"])


def provenance_rows(sc: Scene):
    ev = table(sc.spark, sc.sf_dir, "events").select(
        F.col("user_id").alias("run_id"), "ts", "event_id",
        F.get_json_object("props", "$.k").alias("k"),
    )
    a = ev.groupBy("run_id").agg(
        F.min_by("k", F.struct("ts", "event_id")).alias("k_first"),
        F.max_by("k", F.struct("ts", "event_id")).alias("k_last"),
        F.count(F.lit(1)).cast("string").alias("frames"),
    )
    return a.select(
        "run_id",
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in ("k_first", "k_last", "frames")])
        ).alias("kv"),
    ).select("run_id", "kv.key", "kv.value")


@register
def scalar_quantization(spark, sf):
    """M1, M2, M16, M17 side by side on every event."""
    ev = table(spark, sf, "events")
    v = F.col("value")
    return ev.select(
        "event_id",
        S.distance_bucket(v / 1000.0).alias("distance_bucket"),
        S.time_bucket(F.col("event_id") * 0.005).alias("time_bucket"),
        S.quantize_area(v).alias("area"),
        S.frames_at_rate(v, F.lit(50.0)).alias("frames_at_50hz"),
        S.sensor_projection_bytes(F.col("event_id"), F.lit(2.5)).alias("sensor_bytes"),
        S.agreement(v, F.when(F.col("event_id") % 3 > 0, v + 0.01 * (F.col("event_id") % 4)), 0.015).alias("agreement"),
    )
