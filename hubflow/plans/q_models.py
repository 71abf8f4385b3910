"""Model-stage queries: preprocess, time splits, encoders, closed-form and
boosted-tree predictions, metrics and leaderboard."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from hubflow.functions.features import model_preprocess
from hubflow.operators import encoding as N
from hubflow.operators import metrics as M
from hubflow.operators import models as ML
from hubflow.operators import splits as SP
from hubflow.plans import sqltext as S
from hubflow.operators.ordering import global_position
from hubflow.plans.common import features, keep, memo, trips
from hubflow.plans.registry import query

_MP_COLS = ["trip_id", "source_hub_id", "dest_hub_id", "actual_eta", "osrm_predicted_eta", "distance_km",
            "osrm_distance_km", "hour_of_day", "day_of_week", "is_weekend", "is_cutoff", "route_type",
            "start_scan_to_end_scan", "row_ord"]


def prepped(spark, sf):
    return model_preprocess(trips(spark, sf))


def split_table(spark, sf):
    """The model rows, written once: boundary, encoders, medians and fits read them many times."""
    rows = memo(spark, sf, "model_rows", lambda: prepped(spark, sf).select(*_MP_COLS, "trip_creation_time"))
    return keep(spark, sf, "model_split", lambda: SP.chronological_split(rows))


def r(df, digits, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("model_preprocess", f"with {S.MODEL} select {', '.join(_MP_COLS)} from mp")
def q_model_preprocess(spark, sf):
    return prepped(spark, sf).select(*_MP_COLS)


@query("chrono_split", f"with {S.MODEL} select row_ord, pos, split from split")
def q_chrono_split(spark, sf):
    """The split is a filter on one boundary; the position that the table shows beside it is numbered apart, on the two keys."""
    narrow = split_table(spark, sf).select("row_ord", "trip_creation_time", "split")
    return global_position(narrow, ["trip_creation_time", "row_ord"], "pos").select("row_ord", "pos", "split")


@query("split_report", f"""with {S.MODEL}
select split, count(*) as rows, min(trip_creation_time) as first_ts, max(trip_creation_time) as last_ts
from split group by 1""")
def q_split_report(spark, sf):
    return SP.split_report(split_table(spark, sf))


@query("val_tail", f"""with {S.FEAT},
t as (select *, row_number() over (order by trip_creation_time, row_ord) - 1 as p, count(*) over () as n
  from feat where data = 'training')
select row_ord, case when p >= n - greatest(1, floor(n * 0.1)) then 'val' else 'train' end as split from t
union all select row_ord, 'test' from feat where data <> 'training'""")
def q_val_tail(spark, sf):
    f = features(spark, sf).withColumn("is_train", F.col("data") == "training")
    return SP.val_tail(f, frac=0.1).select("row_ord", "split")


@query("expanding_folds", f"""with {S.MODEL},
t as (select row_ord, row_number() over (order by trip_creation_time, row_ord) - 1 as pos, count(*) over () as n
  from tr)
select row_ord, pos, case when pos >= n - floor(n / 6) * 5 then cast(floor((pos - (n - floor(n / 6) * 5)) / floor(n / 6))
  as integer) end as test_fold from t""")
def q_expanding_folds(spark, sf):
    tr = split_table(spark, sf).filter(F.col("split") == "train").select("row_ord", "trip_creation_time")
    return global_position(SP.expanding_folds(tr, k=5), ["trip_creation_time", "row_ord"], "pos").select("row_ord", "pos", "test_fold")


@query("target_encode", f"""with {S.MODEL},
pr as (select avg(actual_eta) as prior from tr),
st as (select source_hub_id, count(*) as n, avg(actual_eta) as mean from tr group by 1)
select source_hub_id, round(case when n = 1 then prior
  else prior * (1 - 1 / (1 + exp(-(n - 20) / 1.0))) + mean * (1 / (1 + exp(-(n - 20) / 1.0))) end, 8) as encoding,
  round(prior, 8) as prior, n from st, pr""")
def q_target_encode(spark, sf):
    tr = split_table(spark, sf).filter(F.col("split") == "train")
    return r(N.fit_target_encoding(tr, "source_hub_id", "actual_eta", smoothing=1.0, min_leaf=20), 8,
             "encoding", "prior")


@query("impute_median", f"""with {S.MODEL}
select {', '.join(f'median({c}) as {c}' for c in ML.NUMERIC_FEATURES)} from tr""")
def q_impute_median(spark, sf):
    tr = split_table(spark, sf).filter(F.col("split") == "train")
    return N.fit_medians(tr, ML.NUMERIC_FEATURES).withColumns(
        {c: F.col(c).cast("double") for c in ML.NUMERIC_FEATURES})


def closed_form_predictions(spark, sf):
    """Router, global-median-ratio and corridor-median-ratio predictors (test rows)."""
    def build():
        sp = split_table(spark, sf)
        tr = sp.filter(F.col("split") == "train")
        te = sp.filter(F.col("split") == "test")
        ratio = F.col("actual_eta") / F.col("osrm_predicted_eta")
        from hubflow.operators.corridors import skew_safe_quantiles
        trr = tr.withColumn("__ratio", ratio)
        g = skew_safe_quantiles(trr, [], [("g", "__ratio", 0.5)])
        cm = skew_safe_quantiles(trr, ["source_hub_id", "dest_hub_id"], [("r", "__ratio", 0.5)])
        base = te.select("row_ord", "source_hub_id", "dest_hub_id", "actual_eta", "osrm_predicted_eta")
        router = base.select(F.lit("router").alias("model"), "row_ord", "actual_eta",
                             F.col("osrm_predicted_eta").alias("predicted_eta"), "osrm_predicted_eta")
        gm = base.crossJoin(F.broadcast(g)).select(
            F.lit("global_median").alias("model"), "row_ord", "actual_eta",
            (F.col("g") * F.col("osrm_predicted_eta")).alias("predicted_eta"), "osrm_predicted_eta")
        cmp = (base.join(cm, ["source_hub_id", "dest_hub_id"], "left").crossJoin(F.broadcast(g)).select(
            F.lit("corridor_median").alias("model"), "row_ord", "actual_eta",
            (F.coalesce(F.col("r"), F.col("g")) * F.col("osrm_predicted_eta")).alias("predicted_eta"),
            "osrm_predicted_eta"))
        return reduce(lambda a, b: a.unionByName(b), [router, gm, cmp])
    return memo(spark, sf, "closed_form_predictions", build)


@query("predictions", f"""with {S.MODEL}
select model, row_ord, actual_eta, round(predicted_eta, 8) as predicted_eta,
  round(abs(predicted_eta - actual_eta), 8) as abs_error,
  round(abs(predicted_eta - actual_eta) / greatest(abs(actual_eta), 1e-6) * 100.0, 8) as pct_error,
  abs(predicted_eta - actual_eta) <= 0.15 * greatest(abs(actual_eta), 1e-6) as within_15pct from pred""")
def q_predictions(spark, sf):
    p = M.prediction_table(closed_form_predictions(spark, sf))
    return r(p.select("model", "row_ord", "actual_eta", "predicted_eta", "abs_error", "pct_error", "within_15pct"),
             8, "predicted_eta", "abs_error", "pct_error")


_MET = ["mae", "rmse", "mape", "sla_adherence", "router_mae", "router_rmse", "router_sla_adherence",
        "mae_reduction_pct", "sla_gain_pp"]


@query("regression_metrics", f"""with {S.MODEL}
select model, n_samples, {', '.join(f'round({c}, 6) as {c}' for c in _MET[:7])},
  round((router_mae - mae) / router_mae * 100, 6) as mae_reduction_pct,
  round(sla_adherence - router_sla_adherence, 6) as sla_gain_pp from met""")
def q_regression_metrics(spark, sf):
    return r(M.regression_metrics(closed_form_predictions(spark, sf)), 6, *_MET)


@query("leaderboard", f"""with {S.MODEL},
bl as (select mae bmae, rmse brmse, sla_adherence bsla from met where model = 'router')
select model, n_samples, round(mae, 6) as mae, round(rmse, 6) as rmse, round(sla_adherence, 6) as sla_adherence,
  round(mae - bmae, 6) as mae_delta, round((mae - bmae) * 100 / bmae, 6) as mae_delta_pct,
  round(rmse - brmse, 6) as rmse_delta, round(sla_adherence - bsla, 6) as sla_delta_pp,
  model = (select arg_min(model, (mae, model)) from met) as best_mae,
  model = (select arg_min(model, (rmse, model)) from met) as best_rmse,
  model = (select arg_max(model, (sla_adherence, model)) from met) as best_sla
from met, bl""")
def q_leaderboard(spark, sf):
    lb = M.leaderboard(M.regression_metrics(closed_form_predictions(spark, sf)), baseline="router")
    return r(lb, 6, "mae", "rmse", "sla_adherence", "mae_delta", "mae_delta_pct", "rmse_delta", "sla_delta_pp")


@query("error_percentiles", f"""with {S.MODEL}
select model, {', '.join(f'round(quantile_cont(abs(predicted_eta - actual_eta), {q}), 6) as p{int(round(q * 100)):02d}'
                         for q in (0.10, 0.25, 0.50, 0.75, 0.90, 0.95))} from pred group by 1""")
def q_error_percentiles(spark, sf):
    return r(M.error_percentiles(closed_form_predictions(spark, sf)), 6, "p10", "p25", "p50", "p75", "p90", "p95")


# ---------------------------------------------------------------------------
# Boosted-tree regressors (rows-only checks; quality is a range, not equality)
# ---------------------------------------------------------------------------
def encoded(spark, sf):
    sp = split_table(spark, sf)
    return ML.encode_features(sp.filter(F.col("split") == "train"), sp.filter(F.col("split") == "test"))


def gbt_model(spark, sf):
    key = (spark.sparkContext.applicationId, sf, "gbt_model")
    if key not in _MODELS:
        tr, te = encoded(spark, sf)
        _MODELS[key] = (ML.search_eta_model(tr, ML.feature_columns()), tr, te)
    return _MODELS[key]


_MODELS: dict = {}


@query("gbt_eta")
def q_gbt_eta(spark, sf):
    model, _, te = gbt_model(spark, sf)
    return M.prediction_table(ML.predict(model, te, keep=("trip_id", "row_ord")))


@query("gbt_metrics")
def q_gbt_metrics(spark, sf):
    model, _, te = gbt_model(spark, sf)
    return M.regression_metrics(ML.predict(model, te, keep=("row_ord",)).withColumn("model", F.lit("gbt")))


@query("importances")
def q_importances(spark, sf):
    model, _, _ = gbt_model(spark, sf)
    return ML.importances(model, spark)


@query("learning_curve")
def q_learning_curve(spark, sf):
    """Fit on the earlier nine tenths of the training rows, loss also on the most recent tenth; the test rows aren't looked at."""
    sp = split_table(spark, sf).withColumn("is_train", F.col("split") == "train").drop("split")
    tagged = SP.val_tail(sp, frac=0.1)
    tr, va = ML.encode_features(tagged.filter(F.col("split") == "train"), tagged.filter(F.col("split") == "val"))
    return ML.learning_curve(ML.search_eta_model(tr, ML.feature_columns(), val=va), spark)


@query("fold_summary", f"""with {S.MODEL},
t as (select row_ord, row_number() over (order by trip_creation_time, row_ord) - 1 as pos, count(*) over () as n
  from tr),
f as (select pos, case when pos >= n - floor(n / 6) * 5 then cast(floor((pos - (n - floor(n / 6) * 5)) / floor(n / 6))
  as integer) end as test_fold from t)
select test_fold, count(*) as test_rows, min(pos) as test_start, min(pos) as train_rows from f
where test_fold is not null group by 1""")
def q_fold_summary(spark, sf):
    tr = split_table(spark, sf).filter(F.col("split") == "train").drop("split")
    return SP.fold_summary(SP.expanding_folds(tr, k=5))


@query("chrono_sorted", f"with {S.MODEL} select row_ord, trip_creation_time from mp order by trip_creation_time, row_ord")
def q_chrono_sorted(spark, sf):
    return prepped(spark, sf).select("row_ord", "trip_creation_time").orderBy("trip_creation_time", "row_ord")


@query("gbt_search")
def q_gbt_search(spark, sf):
    """The random search itself: each of the 20 seeded draws with its setting and its mean error on 5 expanding folds; the least is refit."""
    model, _, _ = gbt_model(spark, sf)
    settings = ML.draw_params(ML.DRAWS)
    scores = spark.createDataFrame(model.scores, "draw int, fold int, mae double")
    drawn = spark.createDataFrame([(i, *p.values()) for i, p in enumerate(settings)], "draw int, " + ", ".join(f"{k} {'int' if isinstance(v, int) else 'double'}" for k, v in settings[0].items()))
    per = scores.groupBy("draw").agg(F.avg("mae").alias("cv_mae"), F.count("*").alias("folds"))
    best = per.agg(F.min(F.struct("cv_mae", "draw")).alias("b")).select(F.col("b.draw").alias("best"))
    return drawn.join(per, "draw").crossJoin(F.broadcast(best)).withColumn("refit", F.col("draw") == F.col("best")).drop("best")
