"""Sources and sinks: CSV shard scan, contracts, coercion, prediction cleaning, fallbacks."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from hubflow.schema import TRIP_SCHEMA
from hubflow.sources import sinks
from hubflow.sources.predictions import clean_predictions, drop_counts, labelled_predictions
from hubflow.sources.trips import (coerce_numeric, read_parquet_or_clean, read_trips_csv, require_columns,
                                   trips_from_tables)

SF = "/root/testdata/sf0.001"


def _full(spark):
    t = trips_from_tables(spark, SF)
    return t.select(*[F.col(f.name) if f.name in t.columns else F.lit(None).cast(f.dataType).alias(f.name)
                      for f in TRIP_SCHEMA.fields])


def test_csv_shards_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="hubflow-csv-")
    full = _full(spark)
    sinks.write_csv(full.filter(F.col("data") == "training"), f"{d}/data_part_1.csv")
    sinks.write_csv(full.filter(F.col("data") == "test"), f"{d}/data_part_2.csv")
    back = read_trips_csv(spark, d, timestamp_format="yyyy-MM-dd HH:mm:ss")
    assert back.count() == full.count()
    assert back.agg(F.sum("actual_time")).first()[0] == pytest.approx(full.agg(F.sum("actual_time")).first()[0])
    assert back.select("shard").distinct().count() >= 2
    assert dict(back.dtypes)["trip_creation_time"] == "timestamp_ntz"


def test_parquet_or_clean_fallback(spark):
    d = tempfile.mkdtemp(prefix="hubflow-pq-")
    full = _full(spark)
    sinks.write_csv(full, f"{d}/raw/data_part_1.csv")
    cleaned = read_parquet_or_clean(spark, f"{d}/missing.parquet", f"{d}/raw")
    assert 0 < cleaned.count() < full.count()
    sinks.write_parquet(cleaned, f"{d}/clean.parquet")
    again = read_parquet_or_clean(spark, f"{d}/clean.parquet", f"{d}/raw")
    assert again.count() == cleaned.count()


def test_required_columns_and_coercion(spark):
    df = spark.createDataFrame([("1.5", "x"), ("abc", "y"), ("NaN", "z")], "a string, b string")
    with pytest.raises(KeyError, match="missing"):
        require_columns(df, ["a", "c"])
    vals = [r["a"] for r in coerce_numeric(df, ["a"]).collect()]
    assert vals == [1.5, None, None]


def test_prediction_cleaning_and_counts(spark):
    df = spark.createDataFrame([(10.0, 11.0), (0.0, 1.0), (float("inf"), 1.0), (5.0, float("nan")), (None, 2.0)],
                               "actual_eta double, predicted_eta double")
    assert clean_predictions(df).count() == 1
    c = drop_counts(df).first()
    assert (c["rows_in"], c["dropped_non_finite"], c["dropped_zero_actual"], c["rows_out"]) == (5, 3, 1, 1)
    lab = labelled_predictions({"m1": df, "m2": df})
    assert sorted(r["model"] for r in lab.collect()) == ["m1", "m2"]


def test_graph_persist_verified(spark):
    v = spark.createDataFrame([("a",), ("b",)], "v string")
    e = spark.createDataFrame([("a", "b", 1.0)], "src string, dst string, weight double")
    r = sinks.persist_graph(v, e, tempfile.mkdtemp(prefix="hubflow-graph-")).first()
    assert r["verified"] and r["nodes_read"] == 2 and r["edges_read"] == 1


def test_summary_json(spark):
    d = tempfile.mkdtemp(prefix="hubflow-json-")
    sinks.write_summary_json(spark.range(1).select(F.lit(3).alias("n_nodes")), f"{d}/summary")
    assert spark.read.json(f"{d}/summary").first()["n_nodes"] == 3
    assert any(f.endswith(".json") for f in os.listdir(f"{d}/summary"))
