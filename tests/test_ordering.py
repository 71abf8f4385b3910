"""Global positions and time splits: correct and invariant to input layout."""

import datetime as dt

from pyspark.sql import functions as F

from hubflow.operators import splits as SP
from hubflow.operators.ordering import global_position


def _frame(spark, n=500):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(hours=(i * 37) % 97)) for i in range(n)]
    return spark.createDataFrame(rows, "row_ord long, trip_creation_time timestamp_ntz")


def test_global_position_is_sorted_index(spark):
    df = _frame(spark)
    got = {r["row_ord"]: r["pos"] for r in global_position(df, ["trip_creation_time", "row_ord"]).collect()}
    want = {k: i for i, (_, k) in enumerate(sorted((r[1], r[0]) for r in df.collect()))}
    assert got == want


def test_chronological_split_invariant_to_partitioning(spark):
    df = _frame(spark)
    a = {r["row_ord"]: r["split"] for r in SP.chronological_split(df.repartition(7)).collect()}
    b = {r["row_ord"]: r["split"] for r in SP.chronological_split(df.repartition(2).orderBy(F.rand(3))).collect()}
    assert a == b and sum(v == "train" for v in a.values()) == 400


def test_val_tail_and_folds(spark):
    df = _frame(spark, 100).withColumn("is_train", F.col("row_ord") < 80)
    s = [r["split"] for r in SP.val_tail(df, frac=0.1).collect()]
    assert s.count("val") == 8 and s.count("test") == 20 and s.count("train") == 72
    f = SP.fold_summary(SP.expanding_folds(_frame(spark, 60), k=5)).orderBy("test_fold").collect()
    assert [(r["test_rows"], r["train_rows"]) for r in f] == [(10, 10), (10, 20), (10, 30), (10, 40), (10, 50)]
