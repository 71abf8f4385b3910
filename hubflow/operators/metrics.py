"""Prediction metrics, leaderboard and error percentiles (one aggregate each)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prediction_table(df: DataFrame, actual: str = "actual_eta", predicted: str = "predicted_eta",
                     guard: float | None = 1e-6, tol: float = 0.15) -> DataFrame:
    """abs_error, pct_error, within flag per row."""
    err = F.col(predicted) - F.col(actual)
    den = F.greatest(F.abs(F.col(actual)), F.lit(guard)) if guard is not None else F.abs(F.col(actual))
    return (df.withColumn("abs_error", F.abs(err))
            .withColumn("pct_error", F.try_divide(F.abs(err), den) * 100.0)
            .withColumn("within_15pct", F.abs(err) <= F.lit(tol) * den))


def regression_metrics(pred: DataFrame, by: str | None = "model", actual: str = "actual_eta",
                       predicted: str = "predicted_eta", router: str | None = "osrm_predicted_eta",
                       denominator: str = "actual", tol: float = 0.15) -> DataFrame:
    """n, MAE, RMSE, MAPE, SLA adherence (%), plus the router on the same rows.

    Rows with a zero denominator have no percentage error and don't count in the MAPE.
    """
    y, p = F.col(actual), F.col(predicted)
    if denominator == "actual":
        den = F.abs(y)
    elif denominator == "guarded":
        den = F.greatest(F.abs(y), F.lit(1e-6))
    elif denominator == "estimate":
        den = F.abs(F.col(router))
    else:
        raise ValueError(denominator)
    aggs = [F.count(F.lit(1)).alias("n_samples"), F.avg(F.abs(p - y)).alias("mae"),
            F.sqrt(F.avg((p - y) * (p - y))).alias("rmse"),
            (F.avg(F.try_divide(F.abs(p - y), den)) * 100).alias("mape"),
            (F.avg((F.abs(p - y) <= F.lit(tol) * den).cast("double")) * 100).alias("sla_adherence")]
    if router is not None:
        r = F.col(router)
        aggs += [F.avg(F.abs(r - y)).alias("router_mae"), F.sqrt(F.avg((r - y) * (r - y))).alias("router_rmse"),
                 (F.avg((F.abs(r - y) <= F.lit(tol) * den).cast("double")) * 100).alias("router_sla_adherence")]
    g = pred.groupBy(by) if by else pred
    out = g.agg(*aggs)
    if router is not None:
        out = (out.withColumn("mae_reduction_pct", F.try_divide(F.col("router_mae") - F.col("mae"), F.col("router_mae")) * 100)
               .withColumn("sla_gain_pp", F.col("sla_adherence") - F.col("router_sla_adherence")))
    return out


def leaderboard(metrics: DataFrame, baseline: str, by: str = "model") -> DataFrame:
    """Per model: metrics, delta and % vs the baseline model, best-model flags."""
    base = metrics.filter(F.col(by) == baseline).select(
        F.col("mae").alias("__bmae"), F.col("rmse").alias("__brmse"), F.col("sla_adherence").alias("__bsla"))
    best = metrics.agg(F.min_by(by, F.struct("mae", by)).alias("__best_mae"),
                       F.min_by(by, F.struct("rmse", by)).alias("__best_rmse"),
                       F.max_by(by, F.struct("sla_adherence", F.col(by))).alias("__best_sla"))
    j = metrics.crossJoin(F.broadcast(base)).crossJoin(F.broadcast(best))  # both one row
    return j.select(
        by, "n_samples", "mae", "rmse", "sla_adherence",
        (F.col("mae") - F.col("__bmae")).alias("mae_delta"),
        F.try_divide((F.col("mae") - F.col("__bmae")) * 100, F.col("__bmae")).alias("mae_delta_pct"),
        (F.col("rmse") - F.col("__brmse")).alias("rmse_delta"),
        (F.col("sla_adherence") - F.col("__bsla")).alias("sla_delta_pp"),
        (F.col(by) == F.col("__best_mae")).alias("best_mae"),
        (F.col(by) == F.col("__best_rmse")).alias("best_rmse"),
        (F.col(by) == F.col("__best_sla")).alias("best_sla"))


def error_percentiles(pred: DataFrame, qs=(0.10, 0.25, 0.50, 0.75, 0.90, 0.95), by: str = "model",
                      actual: str = "actual_eta", predicted: str = "predicted_eta") -> DataFrame:
    from hubflow.operators.corridors import skew_safe_quantiles
    e = pred.select(by, F.abs(F.col(predicted) - F.col(actual)).alias("__e"))
    return skew_safe_quantiles(e, [by], [(f"p{int(round(q * 100)):02d}", "__e", q) for q in qs])
