"""Fit-on-train / apply-to-both encoders: target encoding and median imputation.

Fitting produces a small parameter DataFrame (one row per category, or one
row of medians); applying it is a join / cross join with that frame, so the
test side never influences the parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_target_encoding(train: DataFrame, col: str, target: str, smoothing: float = 1.0,
                        min_leaf: int = 20, mode: str = "sigmoid", single_to_prior: bool = True) -> DataFrame:
    """Per category: smoothed target mean.  Also returns the prior on every row.

    sigmoid:    s = 1 / (1 + exp(-(n - min_leaf) / smoothing)); enc = prior·(1-s) + mean·s
    m_estimate: enc = (n·mean + smoothing·prior) / (n + smoothing)
    """
    prior = train.agg(F.avg(target).alias("prior"))
    stats = (train.filter(F.col(col).isNotNull()).groupBy(col)
             .agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("mean")))
    stats = stats.crossJoin(F.broadcast(prior))  # prior is one row
    n, mean, pr = F.col("n"), F.col("mean"), F.col("prior")
    if mode == "sigmoid":
        s = F.lit(1.0) / (F.lit(1.0) + F.exp(-(n - F.lit(min_leaf)) / F.lit(smoothing)))
        enc = pr * (F.lit(1.0) - s) + mean * s
        if single_to_prior:
            enc = F.when(n == 1, pr).otherwise(enc)
    elif mode == "m_estimate":
        enc = (n * mean + F.lit(smoothing) * pr) / (n + F.lit(smoothing))
    else:
        raise ValueError(f"unknown mode {mode}")
    return stats.select(col, enc.alias("encoding"), "prior", "n")


def apply_target_encoding(df: DataFrame, params: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Unknown or missing category -> training prior."""
    out = out or f"{col}_te"
    prior = params.agg(F.first("prior").alias("__prior"))
    return (df.join(params.select(col, F.col("encoding").alias("__enc")), col, "left")
            .crossJoin(F.broadcast(prior))
            .withColumn(out, F.coalesce(F.col("__enc"), F.col("__prior"))).drop("__enc", "__prior"))


def fit_medians(train: DataFrame, cols) -> DataFrame:
    """Exact training medians (one row; sort-based when the table is large)."""
    from hubflow.operators.corridors import skew_safe_quantiles
    return skew_safe_quantiles(train, [], [(c, c, 0.5) for c in cols]).select(*cols)


def apply_medians(df: DataFrame, medians: DataFrame, cols) -> DataFrame:
    m = medians.select(*[F.col(c).alias(f"__m_{c}") for c in cols])
    j = df.crossJoin(F.broadcast(m))
    return j.withColumns({c: F.coalesce(F.col(c), F.col(f"__m_{c}")) for c in cols}).drop(
        *[f"__m_{c}" for c in cols])
