"""Building evidence tables from observations, and scanning them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runaudit import vocab as V
from runaudit.functions import scalars as S
from runaudit.operators import intervals as I
from runaudit.operators.scan import number_rows


def closest_approach(distances: DataFrame, quantum: float = V.DISTANCE_TOL_M) -> DataFrame:
    """A4: smallest bucket, earliest frame on a tie; raw distances would let
    noise below the resolution pick the frame."""
    b = distances.withColumn("_b", S.distance_bucket(F.col("distance"), quantum))
    return (
        b.groupBy("run_id", "entity_id")
        .agg(F.min(F.struct(F.col("_b").alias("bucket"), "frame_idx", "t")).alias("m"))
        .select(
            "run_id", "entity_id", "m.bucket", "m.frame_idx", "m.t",
            (F.col("m.bucket") * F.lit(quantum)).alias("distance"),
        )
    )


def scene_occurrences(
    observations: DataFrame, distances: DataFrame, runs: DataFrame,
    enforcement: DataFrame | None = None, resolution_s: float = V.OCCURRENCE_RESOLUTION_S,
) -> DataFrame:
    """The numbered occurrence log of each run.

    Order: run_began; per frame the ceased then the begun relationships (what
    ceased is noticed one frame later, and stamped with the frame before);
    enforcement events; closest approaches; run_ended. Numbering is two-level
    with the phase and frame block as the bucket, so no run is sorted whole.
    """
    material = observations.filter(F.col("type").isin(*V.MATERIAL_EDGES))
    tr = I.transitions(I.presence_spans(material), runs)
    names = F.create_map(
        *[
            F.lit(x)
            for t, (b, c) in V.MATERIAL_EDGES.items()
            for x in (t + "/began", b, t + "/ceased", c)
        ]
    )
    null_d, null_s = F.lit(None).cast("double"), F.lit(None).cast("string")
    zero = F.lit(0).cast("long")

    def event(df, phase, frame, sub, kind, t, entity=null_s, value=null_d, ordinal=zero):
        return df.select(
            "run_id", F.lit(phase).alias("_phase"), frame.cast("long").alias("_frame"),
            sub.cast("long").alias("_sub"), ordinal.cast("long").alias("_ord"),
            kind.alias("type"), t.alias("t"), entity.alias("entity_id"), value.alias("value"),
        )

    ceased = F.col("change") == "ceased"
    log = event(runs, 0, zero, zero, F.lit("run_began"), F.col("t_first"))
    log = log.unionByName(
        event(
            tr, 1,
            F.when(ceased, F.col("frame_idx") + 1).otherwise(F.col("frame_idx")),
            F.when(ceased, 0).otherwise(1),
            F.try_element_at(names, F.concat_ws("/", "type", "change")),
            F.col("t"), F.col("entity_id"),
        )
    )
    if enforcement is not None:
        log = log.unionByName(
            event(enforcement, 2, F.col("seq"), F.col("ordinal"), F.col("type"), F.col("t"))
        )
    log = log.unionByName(
        event(
            closest_approach(distances), 3, zero, zero, F.lit("closest_approach"), F.col("t"),
            F.col("entity_id"), F.col("distance"),
        )
    )
    log = log.unionByName(event(runs, 4, zero, zero, F.lit("run_ended"), F.col("t_last")))
    block = F.col("_phase") * F.lit(1 << 40) + F.floor(F.col("_frame") / V.CHUNK_ROWS)
    numbered = number_rows(
        log, ["run_id"], ["_phase", "_frame", "_sub", "_ord", "entity_id", "type"],
        block.cast("long"), "seq",
    )
    q = F.lit(resolution_s)
    return numbered.select(
        "run_id", "seq", "type", S.occurrence_layer(F.col("type")).alias("layer"), "entity_id",
        (F.rint(F.col("t") / q) * q).alias("t"), "value",
    )


def read_edges(
    edges: DataFrame, edge_type: str | None = None, layer: str | None = None, dst: str | None = None
) -> DataFrame:
    """S7. An unknown type or layer is an error, not an empty answer."""
    if edge_type is not None:
        if edge_type not in V.EDGE_TYPES:
            raise ValueError(f"{edge_type!r} is not an edge type; known: {list(V.EDGE_TYPES)}")
        edges = edges.filter(F.col("type") == edge_type)
    if layer is not None:
        if layer not in (V.LAYER_A, V.LAYER_B):
            raise ValueError(f"{layer!r} is not a layer")
        edges = edges.filter(S.edge_layer(F.col("type")) == layer)
    if dst is not None:
        edges = edges.filter(F.col("entity_id") == dst)
    return edges.orderBy("run_id", "t_start", "frame_first")


def read_occurrences(
    occurrences: DataFrame, kind: str | None = None, entity_id: str | None = None,
    layer: str | None = None,
) -> DataFrame:
    """S8, in (t, seq) order within a run."""
    if kind is not None:
        if kind not in V.OCCURRENCE_TYPES:
            raise ValueError(f"{kind!r} is not an occurrence type; known: {list(V.OCCURRENCE_TYPES)}")
        occurrences = occurrences.filter(F.col("type") == kind)
    if entity_id is not None:
        occurrences = occurrences.filter(F.col("entity_id") == entity_id)
    if layer is not None:
        occurrences = occurrences.filter(F.col("layer") == layer)
    return occurrences.orderBy("run_id", "t", "seq")


def edge_counts(edges: DataFrame, runs: DataFrame) -> DataFrame:
    """Edges per type, every type present at zero."""
    return _counted(edges.select("run_id", "type"), runs, "type", tuple(V.EDGE_TYPES), "edges")


def node_counts(nodes: DataFrame, runs: DataFrame) -> DataFrame:
    """Nodes per kind, every kind present at zero."""
    return _counted(nodes.select("run_id", "kind"), runs, "kind", V.NODE_KINDS, "nodes")


def _counted(rows, runs, column, vocabulary, out):
    every = runs.select("run_id", F.explode(F.array(*[F.lit(k) for k in vocabulary])).alias(column))
    n = rows.groupBy("run_id", column).agg(F.count(F.lit(1)).alias(out))
    return every.join(n, ["run_id", column], "left").select(
        "run_id", column, F.coalesce(out, F.lit(0).cast("long")).alias(out)
    )
