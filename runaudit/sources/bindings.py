"""Bind the star-schema and event tables to the audit schemas.

events        -> frames, observations, silent windows, region digests
orders        -> declarations        lineitem x orders -> verdicts
customer      -> the runs dimension of the record side

Every table is a lazy DataFrame over the given Parquet; where a user, customer or
order is hot, positions are numbered in two levels (see operators.scan.number_rows), so
that it is spread over its days.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from runaudit import vocab as V
from runaudit.functions import scalars as S
from runaudit.operators.scan import durable, number_rows

PERIOD = 0.02
COARSE_QUANTUM = 0.2
EPOCH = "1995-01-01"
DAY = "day"


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is read from the footer once per path."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


_MOST: dict[str, int] = {}


def most(spark: SparkSession, sf_dir: str, name: str, key: str) -> int:
    """The most rows a key of a given table holds, counted once per path. It decides how rows are
    numbered, never what is numbered."""
    path = f"{sf_dir}/{name}.parquet#{key}"
    if path not in _MOST:
        n = table(spark, sf_dir, name).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        _MOST[path] = n.agg(F.max("n")).first()[0] or 0
    return _MOST[path]


# --------------------------------------------------------------------------
# scene side
# --------------------------------------------------------------------------
@dataclass
class Scene:
    spark: SparkSession
    sf_dir: str
    period: float = PERIOD
    kept: dict[str, DataFrame] = field(default_factory=dict)

    def stored(self) -> Scene:
        """Write the numbered frames once, for plans that read them often."""
        if "frames" not in self.kept:
            self.kept["frames"] = durable(self.frames())
        return self

    @property
    def step(self) -> Column:
        return F.lit(self.period)

    def frames(self) -> DataFrame:
        if "frames" in self.kept:
            return self.kept["frames"]
        ev = table(self.spark, self.sf_dir, "events").select(
            F.col("user_id").alias("run_id"), "ts", "event_id", "event_type", "value"
        )
        numbered = number_rows(
            ev, ["run_id"], ["ts", "event_id"], F.date_trunc("hour", "ts"), "frame_idx",
            crowd=most(self.spark, self.sf_dir, "events", "user_id") > V.CROWD_ROWS,
        )
        return numbered.withColumn("t", F.col("frame_idx") * F.lit(self.period))

    def runs(self) -> DataFrame:
        n = (
            table(self.spark, self.sf_dir, "events")
            .groupBy(F.col("user_id").alias("run_id"))
            .agg(F.count(F.lit(1)).alias("frame_count"))
        )
        return n.select(
            "run_id",
            "frame_count",
            F.lit(0.0).alias("t_first"),
            ((F.col("frame_count") - 1) * F.lit(self.period)).alias("t_last"),
            F.lit(self.period).alias("frame_period_s"),
        )

    def entities(self) -> DataFrame:
        """Three declared entities per run; nothing ever observed the third."""
        return self.runs().select(
            "run_id",
            F.explode(F.array(F.lit("human"), F.lit("obs_a"), F.lit("spare"))).alias("entity_id"),
        )

    def distances(self, *keep: str) -> DataFrame:
        f = self.frames()
        pairs = F.array(
            F.struct(F.lit("human").alias("entity_id"), (F.col("value") / 100.0).alias("d")),
            F.struct(
                F.lit("obs_a").alias("entity_id"),
                (((F.col("event_id") * 37) % 500) / 100.0).alias("d"),
            ),
        )
        return f.select(
            "run_id", "frame_idx", "t", *keep, F.explode(pairs).alias("p")
        ).select("run_id", "frame_idx", "t", *keep, "p.entity_id", F.col("p.d").alias("distance"))

    def observations(self, quantum: float = COARSE_QUANTUM) -> DataFrame:
        d = F.col("distance")
        area = S.quantize_area(F.lit(0.5) - d)
        null = F.lit(None).cast("double")

        def row(kind, compare, overlap, separation):
            return F.struct(
                F.lit(kind).alias("type"),
                compare.cast("double").alias("compare"),
                overlap.alias("overlap_area"),
                separation.alias("min_distance"),
            )

        bucket = S.distance_bucket(d, quantum)
        rows = F.array_compact(
            F.array(
                row("SEPARATION", bucket, null, bucket * F.lit(quantum)),
                F.when(d < 0.5, row("INTERSECTS", area, area, null)),
                F.when(d < 0.05, row("CONTACT", F.lit(1.0), null, null)),
            )
        )
        return self.distances().select(
            "run_id", "frame_idx", "t", "entity_id", F.explode(rows).alias("o")
        ).select("run_id", "frame_idx", "t", "entity_id", "o.*")

    def silent_windows(self) -> DataFrame:
        return (
            self.frames()
            .filter(F.col("event_type") == "signup")
            .select("run_id", F.col("t").alias("t0"), F.col("t").alias("t1"))
        )

    def digests(self) -> DataFrame:
        key = F.floor(F.col("value") / 200.0).cast("string")
        return self.frames().select("run_id", "frame_idx", "t", F.sha2(key, 256).alias("digest"))

    def meta(self) -> DataFrame:
        """What each run's artifact holds and states. Every fifth run keeps only
        occurrences, every seventh keeps neither layer, and every third does
        not state its occurrence retention rule."""
        r = F.col("run_id")
        return self.runs().select(
            "*",
            (~((r % 5 == 0) | (r % 7 == 0))).alias("keeps_edges"),
            ((r % 5 == 0) & (r % 7 != 0)).alias("keeps_occurrences"),
            F.when(r % 3 != 0, F.lit("relationship changes")).alias("occurrence_retention"),
            F.lit(V.OCCURRENCE_RESOLUTION_S).alias("occurrence_time_resolution_s"),
        )


# --------------------------------------------------------------------------
# record side
# --------------------------------------------------------------------------
def _days(ts: str) -> Column:
    return F.datediff(F.col(ts), F.lit(EPOCH).cast("date")).cast("double")


def _pick(index: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index + 1).cast("int"))


VETO_FAULTS = (
    "no_declaration",
    "stale_declaration",
    "envelope_overclaim",
    "out_of_vocabulary_action",
    "unattributed",
    "replay_or_reorder",
)
PRIORITY_ACTIONS = {
    "1-URGENT": "reach",
    "2-HIGH": "hold",
    "3-MEDIUM": "retract",
    "4-NOT SPECIFIED": "traverse",
    "5-LOW": "escalate",
}


@dataclass
class Records:
    spark: SparkSession
    sf_dir: str
    kept: dict[str, DataFrame] = field(default_factory=dict)

    def stored(self) -> Records:
        """Write both record tables once, for plans that read them often."""
        for name in ("declarations", "verdicts"):
            if name not in self.kept:
                self.kept[name] = durable(getattr(self, name)())
        return self

    def runs(self) -> DataFrame:
        c = table(self.spark, self.sf_dir, "customer")
        return c.select(
            F.col("c_custkey").alias("run_id"),
            F.concat(F.lit("unit-"), F.col("c_nationkey").cast("string")).alias("unit"),
            F.lower("c_mktsegment").alias("operator"),
        )

    def meta(self) -> DataFrame:
        """Every 13th run was built without records; every 17th does not state
        its record retention rule."""
        r = F.col("run_id")
        return self.runs().select(
            "run_id",
            F.when(r % 13 == 0, F.lit("absent")).otherwise(F.lit(V.RECORDS_PRESENT)).alias(
                "attestation_records"
            ),
            F.when(r % 17 != 0, F.lit("every record")).alias("attestation_retention"),
        )

    def last_positions(self) -> DataFrame:
        """The position of each run's last declaration, from counts alone."""
        o = table(self.spark, self.sf_dir, "orders").groupBy(F.col("o_custkey").alias("run_id"))
        return o.agg((F.count(F.lit(1)) - 1).alias("_last"))

    def declarations(self) -> DataFrame:
        if "declarations" in self.kept:
            return self.kept["declarations"]
        o = table(self.spark, self.sf_dir, "orders")
        d = number_rows(
            o.select(
                F.col("o_custkey").alias("run_id"),
                "o_orderkey", "o_orderdate", "o_orderpriority", "o_totalprice",
            ),
            ["run_id"],
            ["o_orderdate", "o_orderkey"],
            F.to_date("o_orderdate"),
            "seq",
            crowd=most(self.spark, self.sf_dir, "orders", "o_custkey") > V.CROWD_ROWS,
        )
        action = F.create_map(*[F.lit(x) for kv in PRIORITY_ACTIONS.items() for x in kv])
        return d.select(
            "run_id",
            F.concat(F.lit("d"), F.col("o_orderkey").cast("string")).alias("declaration_id"),
            F.col("o_orderkey").alias("order_key"),
            "seq",
            _days("o_orderdate").alias("t_issued"),
            (F.lit(30) + F.col("o_orderkey") % 60).cast("double").alias("horizon"),
            F.try_element_at(action, F.col("o_orderpriority")).alias("action_class"),
            S.quantize_area(F.col("o_totalprice")).alias("area"),
        )

    def verdicts(self) -> DataFrame:
        if "verdicts" in self.kept:
            return self.kept["verdicts"]
        o = table(self.spark, self.sf_dir, "orders").select(
            F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("run_id")
        )
        li = table(self.spark, self.sf_dir, "lineitem").join(o, "l_orderkey")
        ties = [
            "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax",
            "l_returnflag", "l_linestatus",
        ]
        # rows of an order lie together after the join: their place among each other is found there, so that
        # only it, and not every column of the order, goes on to the numbering within runs
        place = F.row_number().over(Window.partitionBy("l_orderkey", "l_shipdate").orderBy(*ties))
        flag, status = F.col("l_returnflag"), F.col("l_linestatus")
        outcome = F.when(flag == "N", F.lit(0)).when(flag == "A", F.lit(1)).when(status == "F", F.lit(2)).otherwise(F.lit(3))
        narrow = li.select(
            "run_id", "l_shipdate", "l_orderkey", place.alias("_place"), outcome.cast("byte").alias("_outcome"),
            F.when(outcome == 2, F.col("l_suppkey") % 6).cast("byte").alias("_veto"),
            (F.col("l_linenumber") % 2 == 0).alias("_even"), F.when(outcome == 1, F.col("l_extendedprice")).alias("_price"),
        )
        # a run has no more verdicts than its orders times the lines of the longest order
        bound = most(self.spark, self.sf_dir, "orders", "o_custkey") * most(self.spark, self.sf_dir, "lineitem", "l_orderkey")
        v = number_rows(
            narrow, ["run_id"], ["l_shipdate", "l_orderkey", "_place"], F.to_date("l_shipdate"), "seq",
            crowd=bound > V.CROWD_ROWS,
        )
        outcome = _pick(F.col("_outcome"), V.OUTCOMES)
        fault = (
            F.when(F.col("outcome") == "CLAMP", F.lit("declaration_action_mismatch"))
            .when(F.col("outcome") == "VETO", _pick(F.col("_veto"), VETO_FAULTS))
            .when(
                F.col("outcome") == "SAFE_STATE",
                F.when(F.col("_even"), F.lit("watchdog_expiry")).otherwise(F.lit("escalation_failure")),
            )
        )
        nameless = F.coalesce(
            F.col("fault").isin("no_declaration", "watchdog_expiry"), F.lit(False)
        )
        return (
            v.withColumn("outcome", outcome)
            .withColumn("fault", fault)
            .select(
                "run_id",
                F.concat_ws("-", F.lit("v"), F.col("run_id").cast("string"), F.col("seq").cast("string")).alias("verdict_id"),
                F.when(
                    ~nameless, F.concat(F.lit("d"), F.col("l_orderkey").cast("string"))
                ).alias("declaration_id"),
                "seq",
                _days("l_shipdate").alias("t"),
                "outcome",
                "fault",
                F.when(F.col("outcome") == "CLAMP", S.quantize_area(F.col("_price"))).alias("clamp_area"),
            )
        )

    def regions(self) -> DataFrame:
        """Declared and clamped regions; every 41st declaration lost its own."""
        d = self.declarations().filter(F.col("order_key") % 41 != 0)
        v = self.verdicts().filter(F.col("outcome") == "CLAMP")
        return d.select(
            "run_id",
            region_id("declared", F.col("declaration_id")).alias("region_id"),
            F.lit("declared").alias("source"),
            "area",
        ).unionByName(
            v.select(
                "run_id",
                region_id("clamped", F.col("verdict_id")).alias("region_id"),
                F.lit("clamped").alias("source"),
                F.col("clamp_area").alias("area"),
            )
        )


def region_id(source: str, record_id: Column) -> Column:
    return F.concat(F.lit("env_"), S.digest(F.lit(source), record_id))
