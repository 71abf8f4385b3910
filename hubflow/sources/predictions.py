"""Prediction sources: coerce, drop non-finite and zero actuals, label by model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubflow.functions.cleaning import finite_only


def _finite_value(v):
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))


def clean_predictions(df: DataFrame, actual: str = "actual_eta", predicted: str = "predicted_eta",
                      keep=()) -> DataFrame:
    """Two numeric columns; ±inf/NaN/unparseable dropped; zero actual dropped."""
    cols = [F.expr(f"try_cast(`{c}` as double)").alias(c) for c in (actual, predicted)]
    return finite_only(df.select(*keep, *cols), [actual, predicted]).filter(F.col(actual) != 0)


#: A comparison of models on fewer usable predictions is marked.
FEW_PREDICTIONS = 100


def drop_counts(df: DataFrame, actual: str = "actual_eta", predicted: str = "predicted_eta", by: str | None = None) -> DataFrame:
    """One-pass report (a row per ``by``, else one) of how many rows each drop rule removes; too_few marks under 100 usable rows."""
    a = F.expr(f"try_cast(`{actual}` as double)")
    p = F.expr(f"try_cast(`{predicted}` as double)")
    bad = ~(_finite_value(a) & _finite_value(p))
    return df.groupBy(*([by] if by else [])).agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(bad).alias("dropped_non_finite"),
        F.count_if(~bad & (a == 0)).alias("dropped_zero_actual"),
        F.count_if(~bad & (a != 0)).alias("rows_out"),
    ).withColumn("too_few", F.col("rows_out") < FEW_PREDICTIONS)


def read_predictions(spark: SparkSession, path: str, actual: str = "actual_eta",
                     predicted: str = "predicted_eta") -> DataFrame:
    reader = spark.read.option("header", True)
    df = reader.parquet(path) if path.endswith(".parquet") else reader.csv(path)
    return clean_predictions(df, actual, predicted)


def labelled_predictions(frames: dict[str, DataFrame], actual: str = "actual_eta",
                         predicted: str = "predicted_eta") -> DataFrame:
    """{label: frame} -> one frame with a ``model`` column (union by name)."""
    parts = [clean_predictions(df, actual, predicted).withColumn("model", F.lit(label))
             for label, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
