"""Work of the shared steps on larger tables: what is moved, sorted and built per row."""

import numpy as np
from pyspark.sql import functions as F

from hubflow.operators.hubs import hub_labels
from hubflow.operators.models import labelled_rows
from hubflow.sources.trips import trips_from_tables

SF = "/root/testdata/sf0.001"


def test_view_works_out_line_values_before_the_shuffle(spark):
    top = trips_from_tables(spark, SF).select("factor", "is_cutoff")._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
    assert "l_extendedprice" not in top and "l_linestatus" not in top


def test_labels_are_hashed_not_sorted(spark):
    rows = [("A", "a2", "B", "b1", 2), ("A", "a1", "B", "b0", 1), ("C", None, "A", "a0", None), ("B", "b9", None, "x", 5), ("C", "c", "A", "z", 4)]
    df = spark.createDataFrame(rows, "source_center string, source_name string, destination_center string, destination_name string, row_ord bigint")
    out = hub_labels(df)
    # source side first; a row without an order comes first in its side
    assert {r["hub_id"]: r["label"] for r in out.collect()} == {"A": "a1", "B": "b9", "C": None}
    plan = hub_labels(df)._jdf.queryExecution().sparkPlan().toString()
    assert [line for line in plan.splitlines() if "SortAggregate" in line and "min(o" in line] == []
    assert any("HashAggregate" in line and "min(o" in line for line in plan.splitlines())


def test_features_are_built_for_the_taken_rows_only(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def feature(v):
        calls.add(1)
        return float(v)

    df = spark.range(0, 5000, 1, 4).select((F.col("id") % 700).alias("trip_creation_time"), F.col("id").alias("row_ord"), "id",
                                           F.when(F.col("id") % 7 > 0, F.col("id") * 2.0).alias("actual_eta"))
    matrix, y = labelled_rows(df.withColumn("x", feature("id")), ["x"], rows=100)
    best = (df.where("actual_eta is not null").orderBy(F.xxhash64("trip_creation_time", "row_ord"), "trip_creation_time", "row_ord").limit(100)
            .orderBy("trip_creation_time", "row_ord").collect())
    assert y.tolist() == [r["actual_eta"] for r in best] and np.array_equal(matrix[:, 0], [float(r["id"]) for r in best])
    assert calls.value <= 300
