"""Queries over the record side: declarations, verdicts and their relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from runaudit import vocab as V
from runaudit.catalog import register
from runaudit.operators import records as R
from runaudit.operators import validate as VA
from runaudit.operators.scan import durable
from runaudit.plans import build as B
from runaudit.plans import questions as Q
from runaudit.sources import store
from runaudit.sources.bindings import Records, region_id, table


def rows(rc: Records, deal=lambda df: df):
    """Declaration and verdict rows with their regions, by stored edges. `deal` is put around what is joined to them."""
    d, v = rc.declarations(), rc.verdicts()
    reg = deal(rc.regions())
    e = deal(edges(rc))
    return Q.declaration_rows(d, e, reg), Q.verdict_rows(v, d, e, reg)


def edges(rc: Records):
    """DECLARED and ENFORCED edges as stored (a lost region takes its edge)."""
    d = rc.declarations().filter(F.col("order_key") % 41 != 0)
    v = rc.verdicts().filter(F.col("outcome") == "CLAMP")
    return d.select(
        "run_id", F.lit("DECLARED").alias("type"), F.col("declaration_id").alias("src_id"),
        region_id("declared", F.col("declaration_id")).alias("dst_id"),
    ).unionByName(
        v.select(
            "run_id", F.lit("ENFORCED").alias("type"), F.col("verdict_id").alias("src_id"),
            region_id("clamped", F.col("verdict_id")).alias("dst_id"),
        )
    )


def probes(rc: Records):
    return R.probe_declarations(rc.declarations(), rc.verdicts())


@register
def record_scan(spark, sf):
    """Both record kinds, verbatim, in (seq, id) order within a run."""
    rc = Records(spark, sf)
    return R.record_union(rc.declarations(), rc.verdicts()).orderBy("run_id", "kind", "seq", "record_id")


@register
def record_gate(spark, sf):
    return Q.record_gate(Records(spark, sf).meta())


@register
def declaration_rows(spark, sf):
    return rows(Records(spark, sf))[0]


@register
def verdict_rows(spark, sf):
    return rows(Records(spark, sf).stored())[1]


@register
def declared_bound(spark, sf):
    rc = Records(spark, sf).stored()
    ask = probes(rc).select("run_id", F.col("t_probe").alias("t"))
    # a second ask per customer, at an instant few declarations reach
    late = rc.runs().select("run_id", F.lit(100.0).alias("t"))
    a = Q.declared_bound(ask.unionByName(late), rc.meta(), rows(rc)[0])
    return a.table(["run_id", "t"])


@register
def violations(spark, sf):
    rc = Records(spark, sf).stored()
    ask = rc.runs().select("run_id", F.lit(1000.0).alias("t0"), F.lit(2000.0).alias("t1"))
    return Q.violations(ask, rc.meta(), rows(rc)[1]).summary


@register
def violation_actions(spark, sf):
    rc = Records(spark, sf).stored()
    ask = rc.runs().select("run_id", F.lit(1000.0).alias("t0"), F.lit(2000.0).alias("t1"))
    return Q.violations(ask, rc.meta(), rows(rc)[1]).rows


@register
def verdicts(spark, sf):
    rc = Records(spark, sf).stored()
    ask = probes(rc).select("run_id", F.col("probe_declaration_id").alias("declaration_id"))
    wrong = rc.runs().select("run_id", F.lit("d-none").alias("declaration_id"))
    asks = durable(ask.unionByName(wrong))
    # only verdicts on a declaration that is asked about meet their regions
    v = durable(rc.verdicts().join(asks, ["run_id", "declaration_id"], "left_semi"))
    named = Records(rc.spark, rc.sf_dir, {**rc.kept, "verdicts": v})
    a = Q.verdicts_of(asks, rc.meta(), rc.declarations(), rows(named)[1])
    return a.table(["run_id", "declaration_id"])


@register
def outcome_matrix(spark, sf):
    return Q.outcome_matrix(Records(spark, sf).verdicts())


@register
def first_refusal(spark, sf):
    return Q.first_refusal(Records(spark, sf).verdicts())


@register
def asof_declaration(spark, sf):
    rc = Records(spark, sf)
    return R.asof_declaration(rc.declarations(), rc.verdicts())


@register
def watchdog_gaps(spark, sf):
    rc = Records(spark, sf)
    return R.watchdog_gaps(rc.declarations(), rc.verdicts(), period=90.0, t_start=0.0)


@register
def replay_flags(spark, sf):
    """Offers in issue order carry their order key as the claimed sequence."""
    d = Records(spark, sf).declarations()
    offers = d.select("run_id", "declaration_id", "seq", F.col("order_key").alias("claimed")).withColumn(
        "chunk", F.floor(F.col("seq") / V.CHUNK_ROWS).cast("long")
    )
    r = R.replay_flags(offers, ["run_id"], ["seq"], "claimed", "chunk")
    return r.drop("chunk")


@register
def passivation_spans(spark, sf):
    return R.passivation_spans(Records(spark, sf).verdicts())


@register
def enforcement_events(spark, sf):
    return R.enforcement_events(Records(spark, sf).verdicts())


@register
def attestation_edges(spark, sf):
    rc = Records(spark, sf).stored()
    return R.attestation_edges(rc.declarations(), rc.verdicts())


@register
def dangling_links(spark, sf):
    """Records removed after their links were written: every 97th verdict."""
    rc = Records(spark, sf).stored()
    d, v = rc.declarations(), rc.verdicts()
    left = R.record_union(d, v).filter(~((F.col("kind") == "Verdict") & (F.col("seq") % 97 == 13)))
    return R.dangling_links(R.follows(d, v), left)


@register
def due_declarations(spark, sf):
    """Frames every third day; declarations land on one or are left over."""
    rc = Records(spark, sf)
    d = rc.declarations()
    last = F.greatest(F.max("t_issued"), F.lit(0.0))
    runs = d.groupBy("run_id").agg(
        F.lit(0.0).alias("t_first"), F.lit(3.0).alias("frame_period_s"), (F.floor(last / 3) + 1).alias("frame_count")
    )
    return R.due_at_period(d, runs).select("run_id", "declaration_id", "frame_idx")


@register
def probe_declaration(spark, sf):
    return probes(Records(spark, sf).stored())


@register
def violations_diff(spark, sf):
    """Refusals missing from, and invented in, an altered copy."""
    v = Q_refused(Records(spark, sf).stored().verdicts())
    k = F.col("seq")
    altered = v.filter(k % 31 != 7).withColumn(
        "fault", F.when(k % 29 == 3, F.lit("stale_declaration")).otherwise(F.col("fault"))
    )
    missing = v.exceptAll(altered).withColumn("side", F.lit("missing"))
    invented = altered.exceptAll(v).withColumn("side", F.lit("invented"))
    return missing.unionByName(invented)


def Q_refused(v):
    return v.filter(F.col("outcome") != V.PERMIT).select(
        "run_id", "verdict_id", "seq", "t", "outcome", "fault", "declaration_id"
    )


@register
def node_counts(spark, sf):
    rc = Records(spark, sf).stored()
    nodes = R.record_union(rc.declarations(), rc.verdicts()).select("run_id", "kind").unionByName(
        rc.regions().select("run_id", F.lit("Envelope").alias("kind"))
    )
    return B.node_counts(nodes, rc.runs())


@register
def idempotent_merge(spark, sf):
    """Entities re-inserted on every line item; equal payloads collapse."""
    return store.merge_nodes(_inserts(spark, sf), "part_id", ["kind", "r"])[0]


@register
def merge_conflicts(spark, sf):
    return store.merge_nodes(_inserts(spark, sf), "part_id", ["kind", "r"])[1]


def _inserts(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_partkey").alias("part_id"),
        F.when((F.col("l_partkey") % 10 == 0) & (F.col("l_linenumber") == 7), F.lit("pallet")).otherwise(F.lit("crate")).alias("kind"),
        (F.col("l_partkey") % 30 / 100.0).alias("r"),
    )


@register
def geometry_attach(spark, sf):
    """Late areas fill only the regions that have none."""
    d = Records(spark, sf).declarations()
    have = d.select(
        "run_id", F.col("declaration_id").alias("region_id"),
        F.when(F.col("order_key") % 4 > 0, F.lit("kept")).alias("geometry"),
    )
    late = d.filter(F.col("order_key") % 3 == 0).select(
        "run_id", F.col("declaration_id").alias("region_id"), F.lit("late").alias("geometry")
    )
    return store.attach_geometry(have, late)


def damaged(rc: Records):
    """Record tables with one breach of each constraint planted."""
    k = F.col("seq")
    d = rc.declarations().select(
        "run_id", "declaration_id", "seq", "t_issued",
        F.when(F.col("order_key") % 53 == 0, F.lit(0.0)).otherwise(F.col("horizon")).alias("horizon"),
        F.when(F.col("order_key") % 59 == 0, F.lit("lunge")).otherwise(F.col("action_class")).alias("action_class"),
        F.sha2("declaration_id", 256).alias("prev_hash"),
        F.when(F.col("order_key") % 61 == 0, F.lit("ab")).otherwise(F.lit("")).alias("mac"),
    )
    v = rc.verdicts().select(
        "run_id", "verdict_id", "declaration_id", "seq", "t",
        F.when(k % 47 == 5, F.lit("MAYBE")).otherwise(F.col("outcome")).alias("outcome"),
        F.when(k % 43 == 5, F.lit(None)).otherwise(F.col("fault")).alias("fault"),
        F.when(k % 37 == 5, F.lit(None)).otherwise(F.col("clamp_area")).alias("clamp_area"),
        F.sha2("verdict_id", 256).alias("prev_hash"), F.lit("").alias("mac"),
    )
    return d, v


@register
def validate_records(spark, sf):
    d, v = damaged(Records(spark, sf))
    return VA.validate_records(d, v)


@register
def validate_edges(spark, sf):
    rc = Records(spark, sf).stored()
    d, v = rc.declarations(), rc.verdicts()
    e = R.attestation_edges(d, v).select(
        "run_id", "type", "src_id", "dst_id", "t_start",
        F.when(F.col("src_id").endswith("77"), F.col("t_start") - 1).otherwise(F.col("t_end")).alias("t_end"),
        F.when(F.col("src_id").endswith("33"), F.lit("B")).otherwise(F.lit("A")).alias("layer"),
        F.when(F.col("src_id").endswith("55"), F.lit(0.5)).alias("overlap_area"),
        F.lit(None).cast("double").alias("min_distance"),
    )
    nodes = R.record_union(d, v).select("run_id", F.col("record_id").alias("node_id"), "kind").unionByName(
        rc.regions().select("run_id", F.col("region_id").alias("node_id"), F.lit("Envelope").alias("kind"))
    )
    return VA.validate_edges(e, nodes)


@register
def validate_regions(spark, sf):
    rc = Records(spark, sf)
    r = rc.regions()
    n = F.ascii(F.substring("region_id", 20, 1))
    r = r.select(
        "run_id", "region_id", "source", "area",
        F.when(n % 5 != 0, F.lit("cells")).alias("geometry"),
        F.lit(None).cast("string").alias("config_id"),
        F.when((F.col("source") == "declared") | (n == 97), F.lit(30.0)).alias("horizon"),
        F.when(n == 98, F.lit(1.0)).alias("outer_radius"),
        F.when(n == 98, F.lit(1.0)).alias("outer_area"),
    )
    return VA.validate_regions(r)


@register
def validate_occurrences(spark, sf):
    ev = R.enforcement_events(Records(spark, sf).verdicts())
    k = F.col("seq")
    o = ev.select(
        "run_id", F.concat_ws("-", "verdict_id", "ordinal").alias("occurrence_id"),
        F.when(k % 51 == 3, k - 1).otherwise(k).alias("seq"),
        F.when(k % 50 == 9, F.lit("teleported")).otherwise(F.col("type")).alias("type"),
        F.lit("A").alias("layer"),
        F.when(k % 44 == 9, F.lit(" ")).otherwise(F.col("type")).alias("reason"), "t",
        F.when(k % 40 == 9, F.lit("1995-01-02")).otherwise(F.lit("1995/01/02")).alias("date"),
        F.when(k % 41 == 9, F.lit("1995-01-02T00:00:00")).otherwise(F.lit("1995-01-02T00:00:00.000000Z")).alias("t_utc"),
        F.when(k % 45 == 9, F.lit("human")).alias("entity_id"),
        F.when(k % 46 == 9, F.lit(1.0)).alias("value"),
    )
    return VA.validate_occurrences(o)
