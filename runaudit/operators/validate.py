"""Table constraints as violation rows: one row per (rule, offending row).

Row rules are evaluated in one pass: each row explodes into the rules it
breaks. References are anti-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runaudit import vocab as V
from runaudit.functions import scalars as S

OUT = ("run_id", "row_id", "rule")


def _broken(df: DataFrame, row_id: str, rules: dict[str, Column]) -> DataFrame:
    """Rules are conditions that must not hold; NULL counts as not holding."""
    found = F.array_compact(
        F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])
    )
    return df.select("run_id", F.col(row_id).alias("row_id"), F.explode(found).alias("rule"))


def _unlike(cond: Column, present: Column) -> Column:
    return cond != present


def validate_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """V1."""
    t = F.col("type")
    known = t.isin(*V.EDGE_TYPES)
    area, dist = F.col("overlap_area").isNotNull(), F.col("min_distance").isNotNull()
    e = edges.withColumn("_id", F.concat_ws(">", "type", "src_id", "dst_id"))
    rows = _broken(
        e, "_id",
        {
            "unknown type": ~known,
            "wrong layer": known & (F.col("layer") != S.edge_layer(t)) & (t != "HAS_ENVELOPE"),
            "area iff INTERSECTS": known & _unlike(t == "INTERSECTS", area),
            "distance iff SEPARATION": known & _unlike(t == "SEPARATION", dist),
            "negative distance": F.col("min_distance") < 0,
            "ends before it starts": F.col("t_end") < F.col("t_start"),
        },
    )
    kinds = {k: (s, d) for k, (_, s, d, _) in V.EDGE_TYPES.items() if s}
    src = F.create_map(*[F.lit(x) for k, (s, _) in kinds.items() for x in (k, s)])
    dst = F.create_map(*[F.lit(x) for k, (_, d) in kinds.items() for x in (k, d)])
    # only an end, the other end and the type are moved: the name of the edge and the rules follow from them
    ends = edges.select(
        "run_id", "type",
        F.explode(
            F.array(
                F.struct(F.lit(True).alias("is_src"), F.col("src_id").alias("node_id"), F.col("dst_id").alias("other")),
                F.struct(F.lit(False).alias("is_src"), F.col("dst_id").alias("node_id"), F.col("src_id").alias("other")),
            )
        ).alias("x"),
    ).select("run_id", "type", "x.*")
    # nodes are dealt once, by the columns of the join; a missing end and one of the wrong kind are told in one pass
    n = nodes.select("run_id", "node_id", "kind").repartition("run_id", "node_id").distinct()
    is_src = F.col("is_src")
    want = F.when(is_src, F.try_element_at(src, t)).otherwise(F.try_element_at(dst, t))
    missing = F.when(is_src, F.lit("source does not exist")).otherwise(F.lit("target does not exist"))
    rule = F.when(F.col("kind").isNull(), missing).when(F.col("kind") != want, F.lit("endpoint of the wrong kind"))
    row_id = F.when(is_src, F.concat_ws(">", "type", "node_id", "other")).otherwise(F.concat_ws(">", "type", "other", "node_id"))
    refs = ends.join(n, ["run_id", "node_id"], "left").withColumn("rule", rule).filter(F.col("rule").isNotNull()).select(
        "run_id", row_id.alias("row_id"), "rule"
    )
    return rows.unionByName(refs)


def validate_occurrences(occ: DataFrame) -> DataFrame:
    """V2."""
    t = F.col("type")
    known = t.isin(*V.OCCURRENCE_TYPES)
    about = t.isin(*[k for k, v in V.OCCURRENCE_TYPES.items() if v[1]])
    valued = t.isin(*[k for k, v in V.OCCURRENCE_TYPES.items() if v[2]])
    rows = _broken(
        occ, "occurrence_id",
        {
            "unknown type": ~known,
            "wrong layer": known & (F.col("layer") != S.occurrence_layer(t)),
            "entity iff about one": known & _unlike(about, F.col("entity_id").isNotNull()),
            "value iff measured": known & _unlike(valued, F.col("value").isNotNull()),
            "blank reason": F.col("reason").isNull() | (F.trim("reason") == ""),
            "date format": ~F.col("date").rlike(r"^\d{4}/\d{2}/\d{2}$"),
            "instant format": ~F.col("t_utc").rlike(S.INSTANT_PATTERN),
        },
    )
    # seq is unique per run: group on (run, seq), which spreads a hot run
    twice = (
        occ.groupBy("run_id", "seq").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
        .select("run_id", F.col("seq").cast("string").alias("row_id"), F.lit("seq is not unique").alias("rule"))
    )
    return rows.unionByName(twice)


def validate_regions(regions: DataFrame) -> DataFrame:
    """V3."""
    s = F.col("source")
    computed, clamped = s == "computed", s == "clamped"
    return _broken(
        regions, "region_id",
        {
            "unknown source": ~s.isin(*V.REGION_SOURCES),
            "neither geometry nor configuration": F.col("geometry").isNull() & F.col("config_id").isNull(),
            "horizon absent iff clamped": _unlike(clamped, F.col("horizon").isNull()),
            "outer bound iff computed": _unlike(computed, F.col("outer_radius").isNotNull())
            | _unlike(computed, F.col("outer_area").isNotNull()),
            "outer bound not positive": (F.col("outer_radius") <= 0) | (F.col("outer_area") <= 0),
            "negative area": F.col("area") < 0,
        },
    )


def validate_records(declarations: DataFrame, verdicts: DataFrame) -> DataFrame:
    """V4."""

    def signed(mac: str) -> Column:
        return (F.col(mac) != V.UNSIGNED) & ~S.is_hash(F.col(mac))

    d = _broken(
        declarations, "declaration_id",
        {
            "bad id": ~S.valid_record_id(F.col("declaration_id")),
            "negative seq": F.col("seq") < 0,
            "horizon not positive": ~(F.col("horizon") > 0),
            "unknown action class": ~F.col("action_class").isin(*V.ACTION_CLASSES),
            "bad prev_hash": ~S.is_hash(F.col("prev_hash")),
            "bad mac": signed("mac"),
        },
    )
    out, fault = F.col("outcome"), F.col("fault")
    v = _broken(
        verdicts, "verdict_id",
        {
            "bad id": ~S.valid_record_id(F.col("verdict_id")),
            "negative seq": F.col("seq") < 0,
            "unknown outcome": ~out.isin(*V.OUTCOMES),
            "unknown fault": fault.isNotNull() & ~fault.isin(*V.FAULTS),
            "fault absent iff permitted": _unlike(out == V.PERMIT, fault.isNull()),
            "bound iff clamped": _unlike(out == "CLAMP", F.col("clamp_area").isNotNull()),
            "bad prev_hash": ~S.is_hash(F.col("prev_hash")),
            "bad mac": signed("mac"),
        },
    )
    return d.unionByName(v)
