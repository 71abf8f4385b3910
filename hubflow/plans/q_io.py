"""Source/sink queries (CSV shard scan, graph persistence) and run summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hubflow.functions import cleaning as B
from hubflow.operators import corridors as C
from hubflow.operators import profile as P
from hubflow.plans import sqltext as S
from hubflow.plans.common import features, memo, route_times, trips
from hubflow.plans.registry import query
from hubflow.schema import TRIP_SCHEMA
from hubflow.sources import sinks
from hubflow.sources.predictions import drop_counts
from hubflow.sources.trips import read_trips_csv


@query("csv_roundtrip", f"""with {S.TRIPS}
select count(*) as rows, count(distinct trip_uuid) as trips, sum(actual_time) as total_actual_time,
  min(trip_creation_time) as first_ts, max(trip_creation_time) as last_ts,
  count(*) filter (where source_center is null) as null_sources, 2 as shards from trips""")
def q_csv_roundtrip(spark, sf):
    """Trips written as CSV shards (one per upstream split), scanned back with the typed reader."""
    t = trips(spark, sf)
    full = t.select(*[F.col(f.name) if f.name in t.columns else F.lit(None).cast(f.dataType).alias(f.name)
                      for f in TRIP_SCHEMA.fields])
    out = sinks.artifact_dir(spark, "csv-shards")
    for split in ("training", "test"):
        sinks.write_csv(full.filter(F.col("data") == split), f"{out}/data_part_{split}.csv")
    back = read_trips_csv(spark, out, timestamp_format="yyyy-MM-dd HH:mm:ss")
    return back.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("trip_uuid").alias("trips"),
                    F.sum("actual_time").alias("total_actual_time"),
                    F.min("trip_creation_time").alias("first_ts"), F.max("trip_creation_time").alias("last_ts"),
                    F.count_if(F.col("source_center").isNull()).alias("null_sources"),
                    F.countDistinct(F.regexp_extract(F.col("_metadata.file_path"), r"(data_part_[a-z]+)", 1))
                    .alias("shards"))


@query("graph_roundtrip", f"""with {S.AUDIT}
select (select count(*) from labels) as nodes_written, (select count(*) from labels) as nodes_read,
  (select count(*) from corr) as edges_written, (select count(*) from corr) as edges_read, true as verified""")
def q_graph_roundtrip(spark, sf):
    from hubflow.plans.q_audit import graph_of
    v, e = graph_of(spark, sf)
    return sinks.persist_graph(v, e, sinks.artifact_dir(spark, "audit-graph"))


@query("eda_summary", f"""with {S.FEAT}
select (select count(*) from nonull) as raw_rows, count(*) as clean_rows,
  round(((select count(*) from nonull) - count(*)) * 100.0 / (select count(*) from nonull), 3) as drop_pct,
  (select count(*) from (select source_center from feat union select destination_center from feat)) as n_unique_hubs,
  (select count(*) from (select distinct source_center, destination_center, route_type from feat)) as n_unique_edges,
  round(avg(abs(actual_time - osrm_time)), 3) as osrm_baseline_mae_min,
  round(avg(cast(is_cutoff as double)) * 100, 2) as global_cutoff_rate_pct,
  round(median(factor), 4) as median_delay_factor, round(avg(factor), 4) as mean_delay_factor,
  round(avg(case when abs(greatest(least((actual_time - osrm_time) / osrm_time * 100.0, 200.0), -50.0)) <= 15.0
    then 1.0 else 0.0 end) * 100, 2) as pct_within_15pct_osrm,
  count(*) filter (where route_type = 'FTL') as ftl_rows, count(*) filter (where route_type = 'Carting') as carting_rows
from feat, (select 1) one(x)""".replace("with b as", "with b as").replace(
    S.FEAT, S.FEAT + """,
nonull as (select * from trips where source_center is not null and destination_center is not null
  and actual_time is not null and osrm_time is not null)"""))
def q_eda_summary(spark, sf):
    t = trips(spark, sf)
    nn = B.drop_critical_nulls(t)
    f = features(spark, sf)
    rep = nn.agg(F.count(F.lit(1)).alias("raw_rows"))
    prof = P.table_profile(t, f)
    dev = P.baseline_deviation(f)
    out = (rep.crossJoin(prof.select("clean_rows", F.col("distinct_hubs").alias("n_unique_hubs"),
                                     F.col("distinct_edges").alias("n_unique_edges"), "ftl_rows", "carting_rows",
                                     F.round("cutoff_rate_pct", 2).alias("global_cutoff_rate_pct")))
           .crossJoin(dev.select(F.round("osrm_mae_min", 3).alias("osrm_baseline_mae_min"),
                                 F.round("median_factor", 4).alias("median_delay_factor"),
                                 F.round("mean_factor", 4).alias("mean_delay_factor"),
                                 F.round("pct_within_15", 2).alias("pct_within_15pct_osrm"))))
    return out.withColumn("drop_pct", F.round((F.col("raw_rows") - F.col("clean_rows")) * 100.0 / F.col("raw_rows"), 3))


@query("pipeline_summary", f"""with {S.EDGES}{S.HUBS_TAIL}
select (select count(*) from (select hub_id from hubs union select source_center from edges
  union select destination_center from edges)) as n_nodes,
  count(*) as n_edges, 13 as n_node_features, 14 as n_edge_attributes,
  min(edge_weight) as weight_min, median(edge_weight) as weight_median, round(avg(edge_weight), 10) as weight_mean,
  max(edge_weight) as weight_max,
  round(count(*) filter (where low_support) * 100.0 / count(*), 10) as low_support_edges_pct from edges""")
def q_pipeline_summary(spark, sf):
    from hubflow.plans.q_graph import multigraph
    v, e = multigraph(spark, sf)
    es = C.edge_summary(e)
    return (v.agg(F.count(F.lit(1)).alias("n_nodes"))
            .crossJoin(es.select(F.col("edges").alias("n_edges"), F.lit(13).alias("n_node_features"),
                                 F.lit(len(e.columns)).alias("n_edge_attributes"), "weight_min", "weight_median",
                                 F.round("weight_mean", 10).alias("weight_mean"), "weight_max",
                                 F.round("low_support_pct", 10).alias("low_support_edges_pct"))))


@query("prediction_drop_counts", f"""with {S.MODEL}
select model, count(*) as rows_in,
  count(*) filter (where actual_eta is null or predicted_eta is null or isnan(actual_eta) or isnan(predicted_eta)
    or isinf(actual_eta) or isinf(predicted_eta)) as dropped_non_finite,
  count(*) filter (where isfinite(actual_eta) and isfinite(predicted_eta) and actual_eta = 0) as dropped_zero_actual,
  count(*) filter (where isfinite(actual_eta) and isfinite(predicted_eta) and actual_eta <> 0) as rows_out,
  count(*) filter (where isfinite(actual_eta) and isfinite(predicted_eta) and actual_eta <> 0) < 100 as too_few
from pred group by 1""")
def q_prediction_drop_counts(spark, sf):
    from hubflow.plans.q_models import closed_form_predictions
    return drop_counts(closed_form_predictions(spark, sf), by="model")


@query("percentile_trim", f"""with {S.NONULL},
c as (select quantile_cont(actual_time, 0.99) as cap from nonull)
select round(max(cap), 10) as cap, count(*) filter (where actual_time <= cap) as rows_kept,
  max(actual_time) filter (where actual_time <= cap) as max_kept from nonull, c""")
def q_percentile_trim(spark, sf):
    from hubflow.operators.selection import exact_quantile
    nn = B.drop_critical_nulls(trips(spark, sf))
    cap = F.lit(exact_quantile(nn, "actual_time", 0.99)).cast("double")
    return (nn.filter(F.col("actual_time") <= cap)
            .agg(F.round(cap, 10).alias("cap"), F.count(F.lit(1)).alias("rows_kept"), F.max("actual_time").alias("max_kept")))


@query("group_clip", f"""with {S.FEAT},
c as (select route_type, quantile_cont(actual_time, 0.98) as cap from feat group by 1)
select route_type, round(cap, 10) as cap, count(*) filter (where actual_time > cap) as rows_clipped,
  round(max(least(actual_time, cap)), 10) as max_after from feat join c using (route_type) group by 1, 2""")
def q_group_clip(spark, sf):
    from hubflow.operators.audit import winsorise
    w = winsorise(route_times(spark, sf), "actual_time", 0.98, by="route_type", out="clipped")
    return w.groupBy("route_type").agg(F.round(F.max("clipped"), 10).alias("cap"),
                                       F.count_if(F.col("__capped")).alias("rows_clipped"),
                                       F.round(F.max("clipped"), 10).alias("max_after"))


@query("stream_ingest", f"""with {S.FEAT}
select data, count(*) as rows, sum(actual_time) as total_actual_time, count(distinct time_of_day) as buckets
from feat group by 1""")
def q_stream_ingest(spark, sf):
    """Shards land as CSV; a Structured Streaming query cleans them into parquet (available-now trigger)."""
    from hubflow.streaming import clean_trip_stream, start_parquet_sink
    t = trips(spark, sf)
    full = t.select(*[F.col(f.name) if f.name in t.columns else F.lit(None).cast(f.dataType).alias(f.name)
                      for f in TRIP_SCHEMA.fields])
    base = sinks.artifact_dir(spark, "stream")
    for split in ("training", "test"):
        sinks.write_csv(full.filter(F.col("data") == split), f"{base}/landing/data_part_{split}.csv")
    q = start_parquet_sink(clean_trip_stream(spark, f"{base}/landing"), f"{base}/clean", f"{base}/_checkpoint")
    q.awaitTermination()
    out = spark.read.parquet(f"{base}/clean")
    return out.groupBy("data").agg(F.count(F.lit(1)).alias("rows"), F.sum("actual_time").alias("total_actual_time"),
                                   F.countDistinct("time_of_day").alias("buckets"))


@query("labelled_predictions", f"""with {S.MODEL}
select model, count(*) as rows, round(sum(actual_eta), 4) as actual_total, round(sum(predicted_eta), 4) as predicted_total
from pred where isfinite(actual_eta) and isfinite(predicted_eta) and actual_eta <> 0 group by 1""")
def q_labelled_predictions(spark, sf):
    """The prediction tables of three models, cleaned and put under each other with their labels."""
    from hubflow.plans.q_models import closed_form_predictions
    from hubflow.sources.predictions import labelled_predictions
    p = closed_form_predictions(spark, sf)
    frames = {m: p.filter(F.col("model") == m).drop("model") for m in ("router", "global_median", "corridor_median")}
    return labelled_predictions(frames).groupBy("model").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("actual_eta"), 4).alias("actual_total"), F.round(F.sum("predicted_eta"), 4).alias("predicted_total"))


@query("parquet_or_clean", f"""with {S.FEAT},
one as (select count(*) as rows, round(sum(actual_time), 4) as total_actual_time from clean)
select 'raw shards' as read_from, rows, total_actual_time from one union all select 'clean parquet', rows, total_actual_time from one""")
def q_parquet_or_clean(spark, sf):
    """Raw shards are cleaned inline while there is no clean table; once it is written it is read instead."""
    from hubflow.sources.trips import read_parquet_or_clean, require_columns
    t = trips(spark, sf)
    full = require_columns(t.select(*[F.col(f.name) if f.name in t.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in TRIP_SCHEMA.fields]),
                           ["trip_uuid", "source_center", "destination_center", "actual_time"])
    raw, clean = (sinks.artifact_dir(spark, n) for n in ("raw-shards", "clean"))
    sinks.write_csv(full, f"{raw}/data_part_all.csv", timestamp_format="yyyy-MM-dd HH:mm:ss.SSSSSS")
    first = read_parquet_or_clean(spark, clean, raw)
    sinks.write_parquet(first, clean)
    parts = [df.agg(F.lit(name).alias("read_from"), F.count(F.lit(1)).alias("rows"), F.round(F.sum("actual_time"), 4).alias("total_actual_time"))
             for name, df in (("raw shards", first), ("clean parquet", read_parquet_or_clean(spark, clean, raw)))]
    return parts[0].unionByName(parts[1])
