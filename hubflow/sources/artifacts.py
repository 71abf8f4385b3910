"""Artefacts of a run: a table beside a manifest that is written last.

The manifest holds the table's kind, schema, row count and an order-free digest.  A table
whose writing was cut short has none, so it can't be read; one whose files were changed
doesn't agree with it.  Typed readers check the columns that the later stages need.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hubflow.sources.sinks import write_parquet
from hubflow.sources.trips import require_columns

# FIXED VALUES — columns that the readers of each kind of artefact rely on, in natural order
KINDS = {
    "vertices": ["hub_id", "outbound_trips", "inbound_trips"],
    "edges": ["source_center", "destination_center", "route_type", "time_of_day", "edge_weight"],
    "metrics": ["facility_id", "betweenness_centrality", "in_degree", "out_degree", "degree_asymmetry"],
    "corridors": ["source_id", "destination_id", "median_delay_ratio", "breach_severity_score"],
    "predictions": ["model", "actual_eta", "predicted_eta"],
}


class ArtifactError(RuntimeError):
    """An artefact that is incomplete or was changed."""


def _facts(df: DataFrame) -> tuple[int, int]:
    """(rows, digest): the digest is the exclusive or of the rows' hashes and doesn't depend on their order."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0)).alias("x")).first()
    return row["n"], row["x"]


def write_artifact(df: DataFrame, path: str, kind: str) -> str:
    """Write ``df`` as an artefact of ``kind``: the table, then the manifest over what was really written."""
    require_columns(df, KINDS[kind])
    spark = df.sparkSession
    write_parquet(df, f"{path}/table")
    back = spark.read.parquet(f"{path}/table")
    rows, digest = _facts(back)
    manifest = json.dumps({"kind": kind, "schema": back.schema.jsonValue(), "rows": rows, "digest": str(digest)})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return path


def read_manifest(spark: SparkSession, path: str) -> dict:
    """The manifest of an artefact; raises if it has none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        raise ArtifactError(f"{path} has no manifest: it was not written to its end")
    return json.loads(spark.read.text(f"{path}/manifest").first()[0])


def read_artifact(spark: SparkSession, path: str, kind: str, verify: bool = True) -> DataFrame:
    """The table of an artefact of ``kind`` with the manifest's schema; ``verify`` reads it once to compare rows and digest."""
    manifest = read_manifest(spark, path)
    if manifest["kind"] != kind:
        raise ArtifactError(f"{path} is an artefact of kind {manifest['kind']}, not {kind}")
    df = require_columns(spark.read.schema(StructType.fromJson(manifest["schema"])).parquet(f"{path}/table"), KINDS[kind])
    if verify:
        rows, digest = _facts(df)
        if (rows, str(digest)) != (manifest["rows"], manifest["digest"]):
            raise ArtifactError(f"{path} does not agree with its manifest: {rows} rows of {manifest['rows']}")
    return df
