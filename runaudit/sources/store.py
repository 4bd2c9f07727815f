"""Reading and writing evidence tables as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runaudit import vocab as V


def pivot_meta(meta: DataFrame, keys: list[str] | tuple[str, ...] = V.META_KEYS) -> DataFrame:
    """(run_id, key, value) rows to one row per run over known keys."""
    return meta.groupBy("run_id").pivot("key", list(keys)).agg(F.first("value"))


def merge_nodes(rows: DataFrame, id_col: str, payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """Idempotent insert. Repeats of one id with one payload collapse; an
    id with two payloads is a conflict and is not merged. One aggregation,
    min and max of the payload, decides both; no set of payloads is kept."""
    p = F.struct(*payload)
    g = rows.groupBy(id_col).agg(
        F.min(p).alias("_lo"), F.max(p).alias("_hi"), F.count(F.lit(1)).alias("inserts")
    )
    same = F.col("_lo").eqNullSafe(F.col("_hi"))
    merged = g.filter(same).select(id_col, "_lo.*", "inserts")
    conflicts = g.filter(~same).select(id_col, "inserts")
    return merged, conflicts


def attach_geometry(regions: DataFrame, geometry: DataFrame) -> DataFrame:
    """Fill a region's missing geometry once; a present one is kept."""
    return (
        regions.join(geometry.withColumnRenamed("geometry", "_new"), ["run_id", "region_id"], "left")
        .withColumn("geometry", F.coalesce("geometry", "_new"))
        .drop("_new")
    )


def write_table(df: DataFrame, path: str, partition: list[str] | None = None, codec: str = "zstd") -> None:
    w = df.write.mode("overwrite").option("compression", codec)
    if partition:
        w = w.partitionBy(*partition)
    w.parquet(path)


def stored_sizes(spark: SparkSession, root: str, tables: list[str]) -> DataFrame:
    """Bytes and files per stored table, from file metadata alone."""
    parts = [
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", "true")
        .load(f"{root}/{t}")
        .select(F.lit(t).alias("table"), "length")
        for t in tables
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("table").agg(
        F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("files")
    )
