"""Profiling queries over raw and cleaned trips (EDA stage)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hubflow.functions import cleaning as B
from hubflow.operators import profile as P
from hubflow.operators.hubs import hub_features
from hubflow.plans import sqltext as S
from hubflow.plans.common import features, r10, training, trips
from hubflow.plans.registry import query

_nulls = " union all ".join(
    f"select '{c}' as column_name, count(*) filter (where {c} is null) as null_count, "
    f"round(count(*) filter (where {c} is null) * 100.0 / count(*), 3) as null_pct from trips"
    for c in S.TRIP_VIEW_COLUMNS)


@query("null_audit", f"with {S.TRIPS} {_nulls}")
def q_null_audit(spark, sf):
    return B.null_audit(trips(spark, sf))


@query("rule_breakdown", f"""with {S.NONULL}
select 'actual_time < 1 min' as rule, count(*) filter (where actual_time < 1.0) as rows_hit from nonull
union all select 'osrm_time < 1 min', count(*) filter (where osrm_time < 1.0) from nonull
union all select 'factor < 0.2 (too fast)', count(*) filter (where factor < 0.2) from nonull
union all select 'factor > 10 (implausible)', count(*) filter (where factor > 10.0) from nonull
union all select 'segment_factor < 0 (error)', count(*) filter (where segment_factor < 0) from nonull
union all select 'distance <= 0.1 km', count(*) filter (where actual_distance_to_destination < 0.1) from nonull""")
def q_rule_breakdown(spark, sf):
    return B.rule_breakdown(B.drop_critical_nulls(trips(spark, sf)))


@query("drop_report", f"""with {S.NONULL}
select count(*) as rows_before, count(*) filter (where {S.CLEAN_WHERE}) as rows_after,
  count(*) - count(*) filter (where {S.CLEAN_WHERE}) as rows_dropped,
  round((count(*) - count(*) filter (where {S.CLEAN_WHERE})) * 100.0 / count(*), 10) as drop_pct
from nonull""")
def q_drop_report(spark, sf):
    return r10(B.drop_report(B.drop_critical_nulls(trips(spark, sf))), "drop_pct")


@query("tod_summary", f"""with {S.FEAT}
select time_of_day, count(factor) as count, avg(factor) as mean, median(factor) as median,
  round(stddev_samp(factor), 10) as std from feat group by 1""")
def q_tod_summary(spark, sf):
    return r10(P.tod_summary(features(spark, sf)), "std")


@query("hourly_band", f"""with {S.FEAT}
select hour_of_day, avg(factor) as mean, median(factor) as median, round(stddev_samp(factor), 10) as std,
  round(avg(factor) - stddev_samp(factor), 10) as band_lo, round(avg(factor) + stddev_samp(factor), 10) as band_hi
from feat group by 1""")
def q_hourly_band(spark, sf):
    return r10(P.hourly_band(features(spark, sf)), "std", "band_lo", "band_hi")


@query("dow_median", f"""with {S.FEAT}
select day_of_week, median(factor) as median_factor from feat group by 1""")
def q_dow_median(spark, sf):
    return P.dow_median(features(spark, sf))


@query("route_hour_median", f"""with {S.FEAT}
select route_type, hour_of_day, median(factor) as median_factor from feat group by 1, 2""")
def q_route_hour_median(spark, sf):
    return P.route_hour_median(features(spark, sf))


@query("cutoff_by_hour", f"""with {S.FEAT}
select hour_of_day, avg(cast(is_cutoff as double)) * 100 as cutoff_pct, count(*) as segments,
  (select avg(cast(is_cutoff as double)) * 100 from feat) as global_cutoff_pct
from feat group by 1""")
def q_cutoff_by_hour(spark, sf):
    return P.cutoff_by_hour(features(spark, sf))


_DESC_COLS = ["actual_time", "osrm_time", "factor", "segment_factor"]
_QS = [0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
_desc = " union all ".join(
    f"select '{c}' as column_name, count({c}) as count, avg({c}) as mean, round(stddev_samp({c}), 10) as std, "
    f"min({c}) as min, " + ", ".join(f"round(quantile_cont({c}, {q}), 10) as p{int(round(q * 100)):02d}" for q in _QS)
    + f", max({c}) as max from feat" for c in _DESC_COLS)


@query("describe_factor", f"with {S.FEAT} {_desc}")
def q_describe(spark, sf):
    out = P.describe(features(spark, sf), _DESC_COLS, _QS)
    return r10(out, "std", *[f"p{int(round(q * 100)):02d}" for q in _QS])


@query("describe_by_cutoff", f"""with {S.FEAT}
select is_cutoff, 'factor' as column_name, count(factor) as count, avg(factor) as mean,
  round(stddev_samp(factor), 10) as std, min(factor) as min,
  round(quantile_cont(factor, 0.25), 10) as p25, round(quantile_cont(factor, 0.5), 10) as p50,
  round(quantile_cont(factor, 0.75), 10) as p75, round(quantile_cont(factor, 0.95), 10) as p95,
  max(factor) as max from feat group by 1""")
def q_describe_by_cutoff(spark, sf):
    out = P.describe(features(spark, sf), ["factor"], [0.25, 0.5, 0.75, 0.95], by="is_cutoff")
    return r10(out, "std", "p25", "p50", "p75", "p95")


@query("baseline_deviation", f"""with {S.FEAT}
select avg(abs(actual_time - osrm_time)) as osrm_mae_min, avg(factor) as mean_factor,
  median(factor) as median_factor,
  round(avg(case when abs(greatest(least((actual_time - osrm_time) / osrm_time * 100.0, 200.0), -50.0)) <= 15.0
    then 1.0 else 0.0 end) * 100, 10) as pct_within_15
from feat""")
def q_baseline_deviation(spark, sf):
    return r10(P.baseline_deviation(features(spark, sf)), "pct_within_15")


@query("table_profile", f"""with {S.FEAT}
select (select count(*) from trips) as raw_rows, count(*) as clean_rows,
  count(*) filter (where data = 'training') as training_rows, count(*) filter (where data = 'test') as test_rows,
  min(cast(trip_creation_time as date)) as first_date, max(cast(trip_creation_time as date)) as last_date,
  count(*) filter (where route_type = 'FTL') as ftl_rows, count(*) filter (where route_type = 'Carting') as carting_rows,
  round(avg(cast(is_cutoff as double)) * 100, 10) as cutoff_rate_pct,
  (select count(*) from (select source_center from feat union select destination_center from feat)) as distinct_hubs,
  (select count(*) from (select distinct source_center, destination_center, route_type from feat)) as distinct_edges
from feat""")
def q_table_profile(spark, sf):
    t = trips(spark, sf)
    return r10(P.table_profile(t, features(spark, sf)), "cutoff_rate_pct")


@query("tod_distribution", f"""with {S.FEAT}
select time_of_day, count(*) as segments from feat group by 1""")
def q_tod_distribution(spark, sf):
    return P.tod_distribution(features(spark, sf))


_CORR_COLS = ["avg_congestion_factor", "cutoff_rate", "avg_dwell_time_min", "unique_destinations",
              "unique_sources", "ftl_ratio", "p75_delay_ratio", "outbound_trips", "weekend_congestion_delta"]


def _corr_sql():
    from hubflow.plans.q_corridors import HUB_SQL
    pairs = " union all ".join(
        f"select '{a}' as col_a, '{b}' as col_b, round(covar_samp({a}, {b}) / nullif(stddev_samp({a}) * stddev_samp({b}), 0), 8) as corr from hubs"
        for a in _CORR_COLS for b in _CORR_COLS)
    return HUB_SQL.replace("select coalesce(ob.hub_id", ", hubs as (select coalesce(ob.hub_id", 1) + ") " + pairs


@query("feature_correlation", _corr_sql())
def q_feature_correlation(spark, sf):
    out = P.correlation(hub_features(training(spark, sf)), _CORR_COLS)
    return out.withColumn("corr", F.round("corr", 8))


@query("histogram_factor", f"""with {S.NONULL},
v as (select greatest(least(factor, 10.0), 0.0) as v from nonull where factor is not null),
r as (select min(v) lo, max(v) hi from v)
select cast(least(floor((v - lo) / ((hi - lo) / 80)), 79) as integer) as bin,
  lo + least(floor((v - lo) / ((hi - lo) / 80)), 79) * ((hi - lo) / 80) as bin_lo,
  lo + (least(floor((v - lo) / ((hi - lo) / 80)), 79) + 1) * ((hi - lo) / 80) as bin_hi, count(*) as count
from v, r group by all""")
def q_histogram_factor(spark, sf):
    return P.histogram(B.drop_critical_nulls(trips(spark, sf)), "factor", 80, clip_lo=0.0, clip_hi=10.0)


@query("kde_factor", f"""with {S.FEAT},
st as (select route_type, count(*) n, stddev_samp(factor) sd, min(factor) mn, max(factor) mx from feat group by 1),
g as (select route_type, n, sd * pow(n, -0.2) h, mn - (mx - mn) / 2 g0, (mx - mn) * 2 / 199 step
      from st where sd > 0),
grid as (select g.*, i as grid_index, g0 + i * step as x from g, range(200) t(i))
select grid.route_type, grid_index, round(x, 10) as x,
  round(sum(exp(-0.5 * ((x - f.factor) / h) * ((x - f.factor) / h)) / (n * h * sqrt(2 * pi()))), 10) as density
from grid join feat f on f.route_type = grid.route_type
group by 1, 2, 3""")
def q_kde_factor(spark, sf):
    out = P.kde(features(spark, sf), "factor", points=200, by="route_type")
    return out.withColumns({"x": F.round("x", 10), "density": F.round("density", 10)})


@query("box_stats", f"""with {S.FEAT},
q as (select route_type, quantile_cont(factor, 0.25) q1, median(factor) med, quantile_cont(factor, 0.75) q3,
  count(*) n from feat group by 1)
select q.route_type, q1, med as median, q3, q3 - q1 as iqr, n,
  min(factor) filter (where factor between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as whisker_lo,
  max(factor) filter (where factor between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as whisker_hi,
  count(*) filter (where not (factor between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1))) as outliers
from feat join q using (route_type) group by all""")
def q_box_stats(spark, sf):
    return P.box_stats(features(spark, sf), "factor", "route_type")


@query("error_curve", f"""with {S.FEAT}
select cast(row_number() over (order by pct_error, row_ord) - 1 as bigint) as rank, pct_error from (
  select greatest(least((actual_time - osrm_time) / osrm_time * 100.0, 200.0), -50.0) as pct_error, row_ord
  from feat)""")
def q_error_curve(spark, sf):
    return P.error_curve(features(spark, sf))


@query("sample_rows")
def q_sample_rows(spark, sf):
    return P.sample_rows(features(spark, sf), 5000, seed=42)


@query("ratio_consistency", f"""with {S.FEAT}
select max(abs(delay_ratio - factor)) as max_abs_diff, max(abs(delay_ratio - factor)) < 1e-4 as consistent
from feat""")
def q_ratio_consistency(spark, sf):
    return (features(spark, sf).agg(F.max(F.abs(F.col("delay_ratio") - F.col("factor"))).alias("max_abs_diff"))
            .withColumn("consistent", F.col("max_abs_diff") < 1e-4))
