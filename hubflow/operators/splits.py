"""Time-ordered splits as filters on a boundary row.

The boundary of an 80/20 cut, of a validation tail or of expanding folds is the row at a
known rank in (time, tie) order; it is found by refining counts (``selection``), so no
row is sorted, moved or written to split a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubflow.operators.selection import boundaries


def _from(ts: str, tie: str, boundary: tuple) -> Column:
    """True from the boundary row on, in (ts, tie) order, nulls first."""
    t, k = boundary
    later = F.col(ts).isNotNull() if t is None else F.coalesce(F.col(ts) > F.lit(t), F.lit(False))
    tied = F.lit(True) if k is None else F.coalesce(F.col(tie) >= F.lit(k), F.lit(False))
    return later | (F.col(ts).eqNullSafe(F.lit(t)) & tied)


def chronological_split(df: DataFrame, ts: str = "trip_creation_time", tie: str = "row_ord",
                        train_frac: float = 0.8) -> DataFrame:
    """Adds ``split`` ∈ {train, test}: the first int(n·frac) rows by time are train."""
    n = df.count()
    cut = int(n * train_frac)
    if cut >= n:
        return df.withColumn("split", F.lit("train"))
    return df.withColumn("split", F.when(_from(ts, tie, boundaries(df, ts, tie, [cut])[0]), "test").otherwise("train"))


def split_report(split: DataFrame, ts: str = "trip_creation_time") -> DataFrame:
    """Rows per side, time range per side, the split timestamp (first test row)."""
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.min(ts).alias("first_ts"),
                                      F.max(ts).alias("last_ts"))


def val_tail(df: DataFrame, ts: str = "trip_creation_time", tie: str = "row_ord", frac: float = 0.1,
             is_train: str = "is_train") -> DataFrame:
    """Most recent max(1, int(n_train·frac)) training rows become ``val``; others keep train/test."""
    train = df.filter(F.col(is_train))
    n = train.count()
    if not n:
        tagged = train.withColumn("split", F.lit("train"))
    else:
        first = boundaries(train, ts, tie, [n - max(1, int(n * frac))])[0]
        tagged = train.withColumn("split", F.when(_from(ts, tie, first), "val").otherwise("train"))
    test = df.filter(~F.col(is_train)).withColumn("split", F.lit("test"))
    return tagged.unionByName(test)


def expanding_folds(df: DataFrame, ts: str = "trip_creation_time", tie: str = "row_ord", k: int = 5) -> DataFrame:
    """Time-series folds: test size n // (k+1); fold i tests the rows at ranks
    [n - (k-i)·size, n - (k-i-1)·size) and trains on everything before (``fold_start`` rows).
    Adds test_fold (NULL before the first fold), fold_start, fold_size; fewer than k + 1 rows make folds of
    size 0: no row is tested."""
    n = df.count()
    size = n // (k + 1)
    fold = F.lit(None).cast("int")
    if size:
        starts = [n - size * (k - i) for i in range(k)]
        for i, first in enumerate(boundaries(df, ts, tie, starts)):
            fold = F.when(_from(ts, tie, first), F.lit(i)).otherwise(fold)
    out = df.withColumn("test_fold", fold).withColumn("fold_size", F.lit(size).cast("bigint"))
    return out.withColumn("fold_start", F.lit(n).cast("bigint") - F.col("fold_size") * (F.lit(k) - F.col("test_fold")))


def fold_summary(folds: DataFrame) -> DataFrame:
    """Per fold: train rows (positions before the fold) and test rows."""
    per = folds.filter(F.col("test_fold").isNotNull()).groupBy("test_fold").agg(
        F.count(F.lit(1)).alias("test_rows"), F.min("fold_start").alias("test_start"))
    return per.withColumn("train_rows", F.col("test_start"))
