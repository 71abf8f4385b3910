"""The data behind the published charts (histograms, density curves, medians) and the artefacts of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubflow.functions import cleaning as B
from hubflow.operators import hubs as H
from hubflow.operators import profile as P
from hubflow.operators.audit import winsorise
from hubflow.plans import sqltext as S
from hubflow.plans.common import features, route_times, training, trips
from hubflow.plans.q_audit import BC_SQL, CHRONIC_SQL, graph_of, metrics_of
from hubflow.plans.q_corridors import edge_table
from hubflow.plans.registry import query


def histograms(df: DataFrame, cols: dict[str, int]) -> DataFrame:
    """One histogram a column over its own range: (series, bin, bin_lo, bin_hi, count); cols: column -> number of bins."""
    out = None
    for c, bins in cols.items():
        h = P.histogram(df, c, bins).select(F.lit(c).alias("series"), "bin", F.round("bin_lo", 10).alias("bin_lo"), F.round("bin_hi", 10).alias("bin_hi"), "count")
        out = h if out is None else out.unionByName(h)
    return out


def histograms_sql(table: str, cols: dict[str, int]) -> str:
    parts = []
    for c, bins in cols.items():
        at = f"least(floor((v - lo) / ((hi - lo) / {bins})), {bins - 1})"
        parts.append(f"""select '{c}' as series, cast({at} as integer) as bin, round(lo + {at} * ((hi - lo) / {bins}), 10) as bin_lo,
  round(lo + ({at} + 1) * ((hi - lo) / {bins}), 10) as bin_hi, count(*) as count
from (select v, case when mn = mx then mn - 0.5 else mn end as lo, case when mn = mx then mx + 0.5 else mx end as hi
  from (select cast({c} as double) as v, min(cast({c} as double)) over () as mn, max(cast({c} as double)) over () as mx from {table} where {c} is not null)) group by all""")
    return "\nunion all\n".join(parts)


TIMES = {"osrm_time": 80, "actual_time": 80}


@query("histogram_times", f"with {S.NONULL} {histograms_sql('nonull', TIMES)}")
def q_histogram_times(spark, sf):
    return histograms(B.drop_critical_nulls(trips(spark, sf)), TIMES)


@query("histogram_edge_weight", f"with {S.EDGES} {histograms_sql('edges', {'edge_weight': 60})}")
def q_histogram_edge_weight(spark, sf):
    return histograms(edge_table(spark, sf), {"edge_weight": 60})


@query("histogram_hub_congestion", f"with {S.FEAT}{S.HUBS_TAIL} {histograms_sql('hubs', {'avg_congestion_factor': 50})}")
def q_histogram_hub_congestion(spark, sf):
    return histograms(H.hub_features(training(spark, sf)), {"avg_congestion_factor": 50})


METRICS = {"betweenness_centrality": 40, "in_degree": 30, "out_degree": 30}


@query("histogram_metrics", f"with recursive {S.AUDIT}{BC_SQL} {histograms_sql('metrics', METRICS)}")
def q_histogram_metrics(spark, sf):
    return histograms(metrics_of(spark, sf), METRICS)


@query("histogram_corridor_ratio", f"with {S.AUDIT} {histograms_sql('corr', {'weight': 60})}")
def q_histogram_corridor_ratio(spark, sf):
    return histograms(graph_of(spark, sf)[1], {"weight": 60})


def _curves(df: DataFrame) -> DataFrame:
    """Curves of (series, v), rounded for comparison."""
    out = P.binned_kde(df, "v", "series")
    return out.withColumns({"x": F.round("x", 8), "density": F.round("density", 9)})


def curves_sql(values: str) -> str:
    """The binned curves in SQL; ``values`` selects series, v."""
    return f"""vals as (select series, cast(v as double) as v from ({values}) where v is not null),
st as (select series, count(*) n, stddev_samp(v) * pow(count(*), -0.2) h, min(v) mn, min(v) - (max(v) - min(v)) / 2 g0, (max(v) - min(v)) * 2 / 199 step
  from vals group by 1 having stddev_samp(v) > 0),
pos as (select series, (v - mn) / (h / {P.BINS_PER_BANDWIDTH}) as p from vals join st using (series)),
nodes as (select series, bin, sum(c) as c from (select series, floor(p) as bin, 1 - (p - floor(p)) as c from pos
  union all select series, floor(p) + 1, p - floor(p) from pos) group by 1, 2),
grid as (select st.*, i as grid_index, g0 + i * step as x from st, range(200) t(i))
select g.series, cast(grid_index as integer) as grid_index, round(x, 8) as x,
  round(coalesce(sum(c * exp(-0.5 * ((x - (mn + bin * (h / {P.BINS_PER_BANDWIDTH}))) / h) ** 2)), 0.0) / (max(n) * max(h) * sqrt(2 * pi())), 9) as density
from grid g left join nodes on nodes.series = g.series and abs(x - (mn + bin * (h / {P.BINS_PER_BANDWIDTH}))) <= {P.REACH} * h group by g.series, grid_index, x"""


def _series(df: DataFrame, **cols) -> DataFrame:
    """(series, v) with one series a column."""
    return df.select(F.inline(F.array(*[F.struct(F.lit(k).alias("series"), c.cast("double").alias("v")) for k, c in cols.items()])))


@query("kde_times", f"""with {S.NONULL},
c as (select quantile_cont(actual_time, 0.99) as cap from nonull),
few as (select * from nonull, c where actual_time <= cap),
{curves_sql("select 'osrm' as series, osrm_time as v from few union all select 'actual', actual_time from few")}""")
def q_kde_times(spark, sf):
    """Router and actual times of the trips up to the 99th percentile of the actual time."""
    from hubflow.operators.selection import exact_quantile
    nn = B.drop_critical_nulls(trips(spark, sf))
    few = nn.filter(F.col("actual_time") <= F.lit(exact_quantile(nn, "actual_time", 0.99)).cast("double"))
    return _curves(_series(few, osrm=F.col("osrm_time"), actual=F.col("actual_time")))


@query("kde_times_by_route", f"""with {S.FEAT},
c as (select route_type, quantile_cont(actual_time, 0.98) as ca, quantile_cont(osrm_time, 0.98) as co from feat group by 1),
{curves_sql("select 'actual ' || route_type as series, least(actual_time, ca) as v from feat join c using (route_type) union all select 'osrm ' || route_type, least(osrm_time, co) from feat join c using (route_type)")}""")
def q_kde_times_by_route(spark, sf):
    """Times by route type, each capped at its own 98th percentile."""
    f = winsorise(winsorise(route_times(spark, sf), "actual_time", 0.98, by="route_type", out="a").drop("__capped"), "osrm_time", 0.98, by="route_type", out="o")
    cols = [F.struct(F.concat(F.lit(f"{name} "), F.col("route_type")).alias("series"), F.col(c).cast("double").alias("v")) for name, c in (("actual", "a"), ("osrm", "o"))]
    return _curves(f.select(F.inline(F.array(*cols))))


@query("kde_factor_by_cutoff", f"""with {S.FEAT},
{curves_sql("select cast(is_cutoff as varchar) as series, greatest(least(factor, 8.0), 0.0) as v from feat")}""")
def q_kde_factor_by_cutoff(spark, sf):
    return _curves(features(spark, sf).select(F.col("is_cutoff").cast("string").alias("series"), B.clip(F.col("factor"), 0.0, 8.0).alias("v")))


@query("kde_ratio_by_tod", f"""with {S.FEAT},
{curves_sql("select time_of_day as series, greatest(least(delay_ratio, 6.0), 0.0) as v from feat")}""")
def q_kde_ratio_by_tod(spark, sf):
    return _curves(features(spark, sf).select(F.col("time_of_day").alias("series"), B.clip(F.col("delay_ratio"), 0.0, 6.0).alias("v")))


@query("kde_edge_weight_by_route", f"""with {S.EDGES},
{curves_sql("select route_type as series, edge_weight as v from edges")}""")
def q_kde_edge_weight_by_route(spark, sf):
    return _curves(edge_table(spark, sf).select(F.col("route_type").alias("series"), F.col("edge_weight").alias("v")))


@query("overall_medians", f"""with {S.EDGES}{S.HUBS_TAIL}
select (select median(edge_weight) from edges) as edge_weight_median, (select median(avg_congestion_factor) from hubs) as hub_congestion_median""")
def q_overall_medians(spark, sf):
    """Overall medians of the edge weight and of the hubs' congestion."""
    from hubflow.operators.corridors import skew_safe_quantiles
    e = skew_safe_quantiles(edge_table(spark, sf), [], [("edge_weight_median", "edge_weight", 0.5)])
    h = skew_safe_quantiles(H.hub_features(training(spark, sf)), [], [("hub_congestion_median", "avg_congestion_factor", 0.5)])
    return e.select("edge_weight_median").crossJoin(h.select("hub_congestion_median"))  # one row each


@query("segment_features", f"""with {S.FEAT}
select row_ord, case when segment_osrm_time > 0 then segment_actual_time / segment_osrm_time end as segment_delay_ratio,
  osrm_distance / nullif(osrm_time / 60.0, 0) as speed_kmph from feat""")
def q_segment_features(spark, sf):
    """Segment delay ratio and router speed of every cleaned trip row."""
    return features(spark, sf).select("row_ord", "segment_delay_ratio", "speed_kmph")


@query("artifacts_read_back", f"""with recursive {S.AUDIT}{BC_SQL}{CHRONIC_SQL}{S.EDGES_TAIL}
select 'metrics' as kind, count(*) as rows, round(sum(betweenness_centrality), 8) as total from metrics
union all select 'corridors', count(*), round(sum(breach_severity_score), 6) from chronic
union all select 'edges', count(*), round(sum(edge_weight), 6) from edges""")
def q_artifacts_read_back(spark, sf):
    """Metric, corridor and edge tables written with their manifests and read back by the typed readers."""
    from hubflow.operators.audit import chronic_corridors
    from hubflow.sources.artifacts import read_artifact, write_artifact
    from hubflow.sources.sinks import artifact_dir
    v, e = graph_of(spark, sf)
    tables = {"metrics": (metrics_of(spark, sf), "betweenness_centrality", 8), "corridors": (chronic_corridors(e, v), "breach_severity_score", 6),
              "edges": (edge_table(spark, sf), "edge_weight", 6)}
    out = None
    for kind, (df, col, digits) in tables.items():
        back = read_artifact(spark, write_artifact(df, artifact_dir(spark, kind), kind), kind)
        row = back.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("rows"), F.round(F.sum(col), digits).alias("total"))
        out = row if out is None else out.unionByName(row)
    return out


@query("model_run_summary")
def q_model_run_summary(spark, sf):
    """The model run's summary as it was written to JSON and read back: metrics on the test rows, rows of the fit (all labelled ones) and chosen setting."""
    from hubflow.operators import metrics as M
    from hubflow.operators import models as ML
    from hubflow.plans.q_models import gbt_model
    from hubflow.sources.sinks import artifact_dir, write_summary_json
    model, _, te = gbt_model(spark, sf)
    m = M.regression_metrics(ML.predict(model, te, keep=("row_ord",)).withColumn("model", F.lit("gbt")))
    summary = m.select("model", "n_samples", "mae", "rmse", "mape", "sla_adherence", "router_mae", "router_rmse", "router_sla_adherence",
                       F.lit(model.rows).alias("fit_rows_at_most"), *[F.lit(v).alias(k) for k, v in model.params.items()])
    return spark.read.schema(summary.schema).json(write_summary_json(summary, artifact_dir(spark, "model-summary")))
