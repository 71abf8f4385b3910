"""Sinks: parquet / CSV tables, one-row JSON summaries, graph persistence with
a re-read verification.  Output folders default to a sub-folder of the
session's shared checkpoint location (never a machine-local temp dir)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubflow.session import ensure_checkpoint_dir


def artifact_dir(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/hubflow-artifacts/{name}-{uuid.uuid4().hex[:12]}"


def write_parquet(df: DataFrame, path: str, partition_by=None, mode: str = "overwrite") -> str:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.parquet(path)
    return path


def write_csv(df: DataFrame, path: str, mode: str = "overwrite",
              timestamp_format: str = "yyyy-MM-dd HH:mm:ss") -> str:
    (df.write.mode(mode).option("header", True).option("timestampFormat", timestamp_format)
     .option("timestampNTZFormat", timestamp_format).csv(path))
    return path


def write_summary_json(summary: DataFrame, path: str) -> str:
    """A one-row summary frame as a JSON document (one partition: one row)."""
    summary.coalesce(1).write.mode("overwrite").json(path)
    return path


def persist_graph(vertices: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """Write vertex and edge tables, read them back, compare counts (one row)."""
    write_parquet(vertices, f"{path}/vertices")
    write_parquet(edges, f"{path}/edges")
    spark = vertices.sparkSession
    rv = spark.read.parquet(f"{path}/vertices")
    re_ = spark.read.parquet(f"{path}/edges")
    counts = (vertices.agg(F.count(F.lit(1)).alias("nodes_written"))
              .crossJoin(rv.agg(F.count(F.lit(1)).alias("nodes_read")))
              .crossJoin(edges.agg(F.count(F.lit(1)).alias("edges_written")))
              .crossJoin(re_.agg(F.count(F.lit(1)).alias("edges_read"))))
    return counts.withColumn("verified", (F.col("nodes_written") == F.col("nodes_read"))
                             & (F.col("edges_written") == F.col("edges_read")))
