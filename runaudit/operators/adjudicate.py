"""Declared-versus-done: one verdict per action, and per refused offer.

Events: run_id, t, side (0 offer, 1 action, 2 acknowledgment), seq, optionally
t_start (when listening to the run began), and
  offers:  declaration_id, claimed, horizon, action_class, offer_fault - the
           row-local finding (unattributed, out_of_vocabulary_action or
           envelope_overclaim), NULL when there is none
Whether an action leaves the region in force is found afterwards, by
`clamp_escapes`: a clamped action changes nothing for those that follow.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runaudit import vocab as V
from runaudit.functions import geometry as G
from runaudit.operators.scan import Scan, durable, running

COLUMNS = ("run_id", "t", "side", "seq", "declaration_id", "outcome", "fault")
CAUSE = ("cause_side", "cause_seq")  # of an acknowledgment: the event that passivated
ACKNOWLEDGED, REFUSED = "ACKNOWLEDGED", "REFUSED"
NOTHING_TO_ACKNOWLEDGE, ALREADY_ACKNOWLEDGED = "nothing_to_acknowledge", "already_acknowledged"


def offer_fault(attributed: Column, action_class: Column, excess: Column) -> Column:
    """The row-local findings about an offer. The first two precede the replay
    check and overclaim follows it; an offer with both is a replay."""
    return (
        F.when(~attributed, F.lit("unattributed"))
        .when(~action_class.isin(*V.ACTION_CLASSES), F.lit("out_of_vocabulary_action"))
        .when(excess > 0, F.lit("envelope_overclaim"))
    )


def overclaim(region: Column, size: float, limits: G.Limits) -> Column:
    """M7: how far a region of cells reaches beyond the bound of the body. A cell stands for a
    point in it, so its furthest corner may lie half a diagonal outside."""
    return G.region_reach(region, size) - F.lit(limits.bound + size / math.sqrt(2))


def _started(events: DataFrame, t_start: float | None) -> DataFrame:
    return events if t_start is None else events.withColumn("t_start", F.lit(float(t_start)))


def _offer_finding(last_seq: Column) -> Column:
    early = F.col("offer_fault").isin("unattributed", "out_of_vocabulary_action")
    replay = F.coalesce(F.col("claimed") <= last_seq, F.lit(False))
    return (
        F.when(F.coalesce(early, F.lit(False)), F.col("offer_fault"))
        .when(replay, F.lit("replay_or_reorder"))
        .otherwise(F.col("offer_fault"))
    )


def adjudicate_windows(
    events: DataFrame, watchdog: float, t_start: float | None, chunk_span: float
) -> DataFrame:
    """Without acknowledgments, as ordered scans.

    Until a run's first passivating finding every offer was accepted, so what
    is in force, last heard and last accepted are plain running values. From
    that finding on nothing is accepted: the last accepted seq is frozen, and
    every action carries the latest finding about an offer.
    """
    ev = _started(events, t_start).filter("side < 2").withColumn("chunk", F.floor(F.col("t") / chunk_span).cast("long"))
    is_offer = F.col("side") == 0
    opened = F.when(is_offer, F.struct("declaration_id", "t", "horizon"))
    one = durable(
        running(
            ev, ["run_id"], "chunk", ["t", "side", "seq"],
            [
                Scan("_seq", "max", F.when(is_offer, F.col("claimed"))),
                Scan("_heard", "max", F.when(is_offer, F.col("t")), inclusive=True),
                Scan("_open", "last", opened, inclusive=True),
            ],
        )
    )
    heard = F.greatest(F.coalesce("_heard", "t_start"), F.col("t_start"))
    expires = F.col("_open.t") + F.col("_open.horizon")
    action = (
        F.when(F.col("t") - heard > watchdog, F.lit("watchdog_expiry"))
        .when(F.col("_open").isNull(), F.lit("no_declaration"))
        .when(F.col("t") > expires, F.lit("stale_declaration"))
    )
    found = one.withColumn(
        "candidate", F.when(is_offer, _offer_finding(F.col("_seq"))).otherwise(action)
    )
    first = (
        found.filter(F.col("candidate").isin(*V.PASSIVATING_FAULTS))
        .groupBy("run_id")
        .agg(F.min(F.struct("t", "side", "seq", "_seq", "candidate")).alias("_first"))
    )
    j = found.join(first, "run_id", "left")
    here = F.struct("t", "side", "seq")
    at = F.struct("_first.t", "_first.side", "_first.seq")
    after = F.col("_first").isNotNull() & (here > at)
    later = _offer_finding(F.col("_first._seq"))
    late_offer = F.when(later.isNotNull(), later).when(
        F.col("action_class") != "escalate", F.lit("escalation_failure")
    )
    j = j.withColumn("_after", after).withColumn(
        "fault", F.when(after & is_offer, late_offer).when(~after, F.col("candidate"))
    )
    mark = F.when(
        F.coalesce(F.col("fault").isin(*V.PASSIVATING_FAULTS), F.lit(False)), F.col("fault")
    )
    sticky = running(
        j, ["run_id"], "chunk", ["t", "side", "seq"], [Scan("_sticky", "last", mark)]
    )
    fault = F.when(F.col("_after") & ~is_offer, F.col("_sticky")).otherwise(F.col("fault"))
    out = sticky.withColumn("fault", fault).withColumn(
        "outcome",
        F.when(F.col("_after") & ~is_offer, F.lit("SAFE_STATE"))
        .when(F.col("fault").isin("watchdog_expiry", "escalation_failure"), F.lit("SAFE_STATE"))
        .when(F.col("fault").isNotNull(), F.lit("VETO"))
        .when(~is_offer, F.lit("PERMIT")),
    )
    named = F.when(is_offer, F.col("declaration_id")).when(
        ~F.col("_after") & ((F.col("outcome") == "PERMIT") | (F.col("fault") == "stale_declaration")),
        F.col("_open.declaration_id"),
    )
    return out.filter(F.col("outcome").isNotNull()).select(
        "run_id", "t", "side", "seq", named.alias("declaration_id"), "outcome", "fault"
    )


def adjudicate(
    events: DataFrame, watchdog: float, t_start: float | None, chunk_span: float
) -> DataFrame:
    """E1 with E5. Runs nobody acknowledged are evaluated by windows; a run
    with acknowledgments goes through the ordered state machine, streamed
    through a sorted partition with a few scalars of state."""
    acked = events.filter("side = 2").select("run_id").distinct()
    return adjudicate_windows(
        events.join(acked, "run_id", "left_anti"), watchdog, t_start, chunk_span
    ).unionByName(
        adjudicate_ordered(events.join(acked, "run_id", "left_semi"), watchdog, t_start)
    )


def adjudicate_ordered(events: DataFrame, watchdog: float, t_start: float | None = None) -> DataFrame:
    return _ordered(events, watchdog, t_start).filter("side < 2").select(*COLUMNS)


def acknowledgments(events: DataFrame, watchdog: float, t_start: float | None = None) -> DataFrame:
    """E5: a row per acknowledgment. One of the passivation in force names its fault and the
    event that raised it; one without a passivation, or a second one of the same, is REFUSED
    and clears nothing."""
    acked = events.filter("side = 2").select("run_id").distinct()
    found = _ordered(events.join(acked, "run_id", "left_semi"), watchdog, t_start).filter("side = 2")
    return found.select("run_id", "t", "seq", "outcome", "fault", *CAUSE)


def _ordered(events: DataFrame, watchdog: float, t_start: float | None) -> DataFrame:
    ordered = (
        _started(events, t_start).select(
            "run_id", "t", "side", "seq", "declaration_id", "claimed", "horizon", "action_class",
            "offer_fault", "t_start",
        )
        # not by run_id itself: Spark leaves that out where each part of a union is dealt by run_id already, and then
        # merges partitions of each part by itself, which tears runs
        .repartition(F.xxhash64("run_id"))
        .sortWithinPartitions("run_id", "t", "side", "seq")
    )
    passivating = frozenset(V.PASSIVATING_FAULTS)
    schema = events.select("run_id", F.col("t").cast("double"), F.col("side").cast("int"), F.col("seq").cast("long")).schema
    for c in ("declaration_id", "outcome", "fault"):
        schema = schema.add(c, "string")
    schema = schema.add("cause_side", "integer").add("cause_seq", "long")
    names = schema.names

    def machine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = s = None
        for batch in batches:
            out: dict[str, list] = {c: [] for c in names}
            for row in batch.to_pylist():
                if s is None or row["run_id"] != run:
                    run, s = row["run_id"], _State(row["t_start"])
                verdict = s.step(row, watchdog)
                if verdict is None:
                    continue
                outcome, fault, named, renews = verdict
                if renews and fault in passivating:
                    s.passivate(fault, row)
                cause = s.cause if row["side"] == 2 and outcome == ACKNOWLEDGED else (None, None)
                for c, v in zip(names, (run, row["t"], row["side"], row["seq"], named, outcome, fault, *cause), strict=True):
                    out[c].append(v)
            kinds = [batch.schema.field("run_id").type, pa.float64(), pa.int32(), pa.int64(), *[pa.string()] * 3, pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(out[c], k) for c, k in zip(names, kinds, strict=True)], names=names)

    return ordered.mapInArrow(machine, schema)


def clamp_escapes(verdicts: DataFrame, bodies: DataFrame, regions: DataFrame) -> DataFrame:
    """A permitted action whose body leaves the region in force is clamped.

    `bodies` holds the cells the body takes at an action (run_id, seq, body), `regions` those
    of a declaration (run_id, declaration_id, region). A declaration whose region is lost
    contains nothing, so it permits nothing. Arrays of cells are bounded by the arm's workspace.
    """
    named = verdicts.join(regions, ["run_id", "declaration_id"], "left").join(
        bodies.withColumn("side", F.lit(1)), ["run_id", "side", "seq"], "left"
    )
    return clamp_found(named, F.col("body"), F.col("region"))


def clamp_found(named: DataFrame, body: Column, region: Column) -> DataFrame:
    """`clamp_escapes` of verdicts that tell both sets of cells by themselves, so that no cells are moved.
    NULL is a set without cells."""
    none = F.array().cast("array<long>")
    out = escape_cells(F.coalesce(body, none), F.coalesce(region, none))
    escapes = (F.col("outcome") == "PERMIT") & (F.size(out) > 0)
    return named.select(
        "run_id", "t", "side", "seq", "declaration_id",
        F.when(escapes, F.lit("CLAMP")).otherwise(F.col("outcome")).alias("outcome"),
        F.when(escapes, F.lit("declaration_action_mismatch")).otherwise(F.col("fault")).alias("fault"),
    )


class _State:
    """What enforcement remembers between events."""

    def __init__(self, t_start: float) -> None:
        self.heard = t_start
        self.open = None
        self.last_seq = None
        self.fault = None
        self.acked = False
        self.cause = (None, None)

    def passivate(self, fault: str, event: dict) -> None:
        self.fault, self.acked, self.open = fault, False, None
        self.cause = event["side"], event["seq"]

    def step(self, e: dict, watchdog: float):
        """(outcome, fault, declaration, renews passivation) or None."""
        if e["side"] == 2:
            return self._acknowledge()
        return self._offer(e) if e["side"] == 0 else self._action(e, watchdog)

    def _acknowledge(self):
        if self.fault is None:
            return REFUSED, NOTHING_TO_ACKNOWLEDGE, None, False
        if self.acked:
            return REFUSED, ALREADY_ACKNOWLEDGED, None, False
        self.acked = True
        return ACKNOWLEDGED, self.fault, None, False

    def _offer(self, e: dict):
        self.heard = max(self.heard, e["t"])
        local = e["offer_fault"]
        if local not in ("unattributed", "out_of_vocabulary_action"):
            if self.last_seq is not None and e["claimed"] <= self.last_seq:
                local = "replay_or_reorder"
        if local is not None:
            return "VETO", local, e["declaration_id"], True
        if self.fault is not None and not self.acked:
            if e["action_class"] == "escalate":
                return None
            return "SAFE_STATE", "escalation_failure", e["declaration_id"], True
        self.open, self.last_seq = e, e["claimed"]
        self.fault, self.acked = None, False
        return None

    def _action(self, e: dict, watchdog: float):
        if self.fault is not None:
            return "SAFE_STATE", self.fault, None, False
        if e["t"] - self.heard > watchdog:
            return "SAFE_STATE", "watchdog_expiry", None, True
        if self.open is None:
            return "VETO", "no_declaration", None, True
        name = self.open["declaration_id"]
        if e["t"] > self.open["t"] + self.open["horizon"]:
            return "VETO", "stale_declaration", name, True
        return "PERMIT", None, name, False


def escape_cells(body: Column, declared: Column) -> Column:
    """Body cells outside the declared region; the workspace bounds both."""
    return F.array_except(body, declared)
