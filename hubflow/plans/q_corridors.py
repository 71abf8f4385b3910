"""Corridor and hub queries (edge weights, hub features, memo offenders)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hubflow.operators import corridors as C
from hubflow.operators import hubs as H
from hubflow.plans import sqltext as S
from hubflow.plans.common import features, r10, training
from hubflow.plans.registry import query


def edge_table(spark, sf):
    return C.edge_weights(training(spark, sf))


@query("edge_weights", f"""with {S.EDGES}
select source_center, destination_center, route_type, time_of_day, edge_weight, mean_delay_ratio,
  round(std_delay_ratio, 10) as std_delay_ratio, trip_count, median_actual_time, median_osrm_time,
  median_dist_km, cutoff_rate, round(p95_delay_ratio, 10) as p95_delay_ratio, low_support
from edges where edge_weight is not null""")
def q_edge_weights(spark, sf):
    return r10(edge_table(spark, sf), "std_delay_ratio", "p95_delay_ratio")


@query("most_delayed_corridors", f"""with {S.EDGES}
select source_center, destination_center, route_type, time_of_day, edge_weight, trip_count
from edges where trip_count >= 20
order by edge_weight desc, source_center, destination_center, route_type, time_of_day limit 10""")
def q_most_delayed(spark, sf):
    return C.most_delayed(edge_table(spark, sf), min_trips=20, top=10).select(
        "source_center", "destination_center", "route_type", "time_of_day", "edge_weight", "trip_count")


@query("corridor_preview", f"""with {S.FEAT}
select source_center, destination_center, route_type, count(distinct trip_uuid) as trips,
  median(factor) as median_factor, avg(factor) as mean_factor,
  round(stddev_samp(factor), 10) as std_factor, median(actual_distance_to_destination) as median_dist_km
from feat group by 1, 2, 3""")
def q_corridor_preview(spark, sf):
    return r10(C.corridor_preview(features(spark, sf)), "std_factor")


@query("edge_summary", f"""with {S.EDGES}
select count(*) as edges, count(*) filter (where route_type = 'FTL') as ftl_edges,
  count(*) filter (where route_type = 'Carting') as carting_edges,
  count(*) filter (where low_support) as low_support_edges,
  round(count(*) filter (where low_support) * 100.0 / count(*), 10) as low_support_pct,
  min(edge_weight) as weight_min, median(edge_weight) as weight_median,
  round(avg(edge_weight), 10) as weight_mean, max(edge_weight) as weight_max
from edges""")
def q_edge_summary(spark, sf):
    return r10(C.edge_summary(edge_table(spark, sf)), "low_support_pct", "weight_mean")


@query("offender_corridors", f"""with {S.FEAT},
f as (select *, factor > 1.2 as b from feat),
tot as (select count(*) filter (where b) as t from f)
select source_name, destination_name, count(trip_uuid) as total_trips,
  count(*) filter (where b) as breach_count, median(factor) as median_delay_ratio,
  round(count(*) filter (where b) * 100.0 / max(t), 10) as pct_of_network_breaches
from f, tot where source_name is not null and destination_name is not null
group by 1, 2 having count(trip_uuid) >= 50
order by breach_count desc, source_name, destination_name limit 5""")
def q_offenders(spark, sf):
    return r10(C.offender_corridors(features(spark, sf), min_trips=50, top=5), "pct_of_network_breaches")


@query("weighted_load", f"""with {S.EDGES}
select source_center, sum(edge_weight * trip_count) as weighted_load
from edges group by 1 order by weighted_load desc, source_center limit 15""")
def q_weighted_load(spark, sf):
    return C.weighted_load(edge_table(spark, sf), top=15)


@query("tod_route_pivot", f"""with {S.EDGES}
select time_of_day, median(edge_weight) filter (where route_type = 'FTL') as "FTL",
  median(edge_weight) filter (where route_type = 'Carting') as "Carting"
from edges group by 1""")
def q_tod_route_pivot(spark, sf):
    return C.tod_route_pivot(edge_table(spark, sf))


@query("tod_edge_median", f"""with {S.EDGES}
select time_of_day, median(edge_weight) as median_weight, count(*) as edges,
  (select median(edge_weight) from edges) as overall_median_weight
from edges group by 1""")
def q_tod_edge_median(spark, sf):
    return C.tod_edge_median(edge_table(spark, sf))


HUB_SQL = f"""with {S.FEAT},
tr as (select * from feat where data = 'training'),
ob as (select source_center as hub_id, count(trip_uuid) as outbound_trips,
  median(delay_ratio) as avg_congestion_factor, quantile_cont(delay_ratio, 0.75) as p75_delay_ratio,
  stddev_samp(delay_ratio) as std_delay_ratio, avg(cast(is_cutoff as double)) as cutoff_rate,
  median(start_scan_to_end_scan) as avg_dwell_time_min, median(log_dwell_time) as log_dwell_time,
  count(distinct destination_center) as unique_destinations,
  count(*) filter (where route_type = 'FTL') as ftl_count,
  median(delay_ratio) filter (where is_weekend) - median(delay_ratio) filter (where not is_weekend)
    as weekend_congestion_delta
  from tr group by 1),
ib as (select destination_center as hub_id, count(trip_uuid) as inbound_trips,
  count(distinct source_center) as unique_sources from tr group by 1)
select coalesce(ob.hub_id, ib.hub_id) as hub_id,
  coalesce(outbound_trips, 0) as outbound_trips,
  coalesce(avg_congestion_factor, 0) as avg_congestion_factor,
  round(coalesce(p75_delay_ratio, 0), 10) as p75_delay_ratio,
  round(coalesce(std_delay_ratio, 0), 10) as std_delay_ratio,
  coalesce(cutoff_rate, 0) as cutoff_rate,
  coalesce(avg_dwell_time_min, 0) as avg_dwell_time_min,
  round(coalesce(log_dwell_time, 0), 10) as log_dwell_time,
  coalesce(unique_destinations, 0) as unique_destinations,
  cast(ftl_count as double) as ftl_count,
  coalesce(ftl_count * 1.0 / outbound_trips, 0) as ftl_ratio,
  coalesce(weekend_congestion_delta, 0) as weekend_congestion_delta,
  coalesce(inbound_trips, 0) as inbound_trips,
  coalesce(unique_sources, 0) as unique_sources
from ob full outer join ib on ob.hub_id = ib.hub_id"""


@query("hub_features", HUB_SQL)
def q_hub_features(spark, sf):
    return r10(H.hub_features(training(spark, sf)), "p75_delay_ratio", "std_delay_ratio", "log_dwell_time")


@query("hub_congestion", f"""with {S.FEAT}
select source_center, count(*) as trips, median(factor) as median_factor, avg(factor) as mean_factor
from feat group by 1 having count(*) >= 20
order by median_factor desc, source_center limit 10""")
def q_hub_congestion(spark, sf):
    return H.hub_congestion(features(spark, sf), min_trips=20, top=10)


@query("hub_inventory", f"""with {S.FEAT}
select hub_id from (select source_center as hub_id from feat union select destination_center from feat)""")
def q_hub_inventory(spark, sf):
    return H.hub_inventory(features(spark, sf))


@query("hub_index", f"""with {S.FEAT}
select hub_id, cast(row_number() over (order by hub_id) - 1 as bigint) as hub_index from
(select source_center as hub_id from feat union select destination_center from feat)""")
def q_hub_index(spark, sf):
    return H.hub_index(H.hub_inventory(features(spark, sf)))


@query("degree_hist", f"""with {S.EDGES},
d as (select source_center, count(distinct destination_center) as k from feat group by 1),
m as (select source_center, count(*) as k from edges group by 1)
select 'distinct_destinations' as measure, k as degree, count(*) as hubs from d group by 1, 2
union all select 'multigraph_out_degree', k, count(*) from m group by 1, 2""")
def q_degree_hist(spark, sf):
    feat = features(spark, sf)
    return H.degree_hist(feat, C.edge_weights(feat.filter(F.col("data") == "training")))


@query("hub_weekend_pivot", f"""with {S.FEAT}
select source_center as hub_id, median(delay_ratio) filter (where not is_weekend) as weekday_factor,
  median(delay_ratio) filter (where is_weekend) as weekend_factor
from feat where data = 'training' group by 1""")
def q_hub_weekend_pivot(spark, sf):
    return C.hub_weekend_pivot(training(spark, sf))


@query("hub_member_trips", f"""with {S.FEAT}{S.HUBS_TAIL}
select count(*) as trips, count(*) filter (where source_center in (select hub_id from hubs)
  and destination_center in (select hub_id from hubs)) as member_trips from feat""")
def q_hub_member_trips(spark, sf):
    from hubflow.functions.cleaning import hub_members
    f = features(spark, sf)
    hubs = H.hub_features(training(spark, sf))
    return (f.agg(F.count(F.lit(1)).alias("trips"))
            .crossJoin(hub_members(f, hubs).agg(F.count(F.lit(1)).alias("member_trips"))))


@query("most_delayed_pairs", f"""with {S.FEAT}
select source_center, destination_center, median(delay_ratio) as edge_weight, count(trip_uuid) as trip_count,
  median(actual_distance_to_destination) as median_dist_km
from feat where data = 'training' group by 1, 2 having count(trip_uuid) >= 20
order by edge_weight desc, source_center, destination_center limit 10""")
def q_most_delayed_pairs(spark, sf):
    """Flagship: corridor (src, dst) edge weights on training trips, ten most delayed with ≥ 20 trips."""
    e = C.edge_weights(training(spark, sf), keys=C.CORRIDOR)
    return C.most_delayed(e, min_trips=20, top=10).select(
        "source_center", "destination_center", "edge_weight", "trip_count", "median_dist_km")
