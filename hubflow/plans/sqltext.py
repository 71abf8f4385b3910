"""Oracle SQL fragments (DuckDB dialect) for the trip view and its cleaned form.

The oracle re-derives everything from the raw tables in SQL; it shares no
code with the Spark operators.
"""

TRIPS = """b as (
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_linestatus, o_orderdate,
  s_nationkey, sn.n_name sname, c_nationkey, cn.n_name dname,
  10.0::double + 2.0::double*l_quantity as osrm_time,
  case when l_partkey % 211 = 0 then 12.0::double
       else (10 + cast(round(l_extendedprice*100) as bigint) % 100)
            * (3 + (s_nationkey*7 + c_nationkey*13) % 11) / 256.0::double end as ratio
from lineitem join orders on l_orderkey=o_orderkey join customer on o_custkey=c_custkey
  join supplier on l_suppkey=s_suppkey
  join nation sn on s_nationkey=sn.n_nationkey join nation cn on c_nationkey=cn.n_nationkey),
trips as (
select case when o_orderdate < timestamp '2000-01-01 00:00:00' then 'training' else 'test' end as data,
  o_orderdate + ((l_orderkey*7 + l_linenumber*5) % 24) * interval '1' hour as trip_creation_time,
  case when l_linenumber % 3 = 0 then 'Carting' else 'FTL' end as route_type,
  concat('trip-', cast(l_orderkey as varchar)) as trip_uuid,
  case when l_partkey % 401 = 0 then null
       else concat('HUB', lpad(cast(s_nationkey as varchar), 2, '0')) end as source_center,
  case when l_partkey % 97 = 0 then null else sname end as source_name,
  concat('HUB', lpad(cast(c_nationkey as varchar), 2, '0')) as destination_center, dname as destination_name,
  osrm_time*ratio + 32.0::double*l_linenumber as start_scan_to_end_scan,
  l_linestatus = 'O' as is_cutoff, l_linenumber as cutoff_factor,
  case when l_suppkey % 53 = 0 then 0.0625::double else 1.25::double*l_quantity end as actual_distance_to_destination,
  osrm_time*ratio as actual_time, osrm_time, 1.5::double*l_quantity as osrm_distance, ratio as factor,
  osrm_time*ratio/4.0::double as segment_actual_time,
  case when l_partkey % 307 = 0 then 0.0::double else osrm_time/4.0::double end as segment_osrm_time,
  0.375::double*l_quantity as segment_osrm_distance,
  case when l_partkey % 307 = 0 then -1.0::double else ratio end as segment_factor,
  ((l_orderkey*10 + l_linenumber)*100000 + l_partkey)*10000 + l_suppkey as row_ord
from b)"""

CLEAN_WHERE = """source_center is not null and destination_center is not null
  and actual_time is not null and osrm_time is not null
  and actual_time >= 1.0 and osrm_time >= 1.0 and factor >= 0.2 and factor <= 10.0
  and segment_factor >= 0 and actual_distance_to_destination >= 0.1"""

# cleaned trips + temporal/time-of-day/ratio features
FEAT = TRIPS + """,
clean as (select * from trips where """ + CLEAN_WHERE + """),
feat as (
select *, cast(hour(trip_creation_time) as integer) as hour_of_day,
  cast(isodow(trip_creation_time) - 1 as integer) as day_of_week,
  isodow(trip_creation_time) in (6, 7) as is_weekend,
  cast(month(trip_creation_time) as integer) as month,
  case when hour(trip_creation_time) < 6 then 'Night_0_6'
       when hour(trip_creation_time) < 10 then 'Morning_6_10'
       when hour(trip_creation_time) < 16 then 'Afternoon_10_16'
       when hour(trip_creation_time) < 20 then 'Evening_16_20'
       else 'Night_20_24' end as time_of_day,
  actual_time / osrm_time as delay_ratio,
  case when segment_osrm_time > 0 then segment_actual_time / segment_osrm_time end as segment_delay_ratio,
  osrm_distance / (osrm_time / 60.0) as speed_kmph,
  ln(1 + greatest(start_scan_to_end_scan, 0.0)) as log_dwell_time
from clean)"""

EDGES = FEAT + """,
edges as (
select source_center, destination_center, route_type, time_of_day,
  median(delay_ratio) as edge_weight, avg(delay_ratio) as mean_delay_ratio,
  stddev_samp(delay_ratio) as std_delay_ratio, count(trip_uuid) as trip_count,
  median(actual_time) as median_actual_time, median(osrm_time) as median_osrm_time,
  median(actual_distance_to_destination) as median_dist_km,
  avg(cast(is_cutoff as double)) as cutoff_rate,
  quantile_cont(delay_ratio, 0.95) as p95_delay_ratio,
  count(trip_uuid) < 5 as low_support
from feat where data = 'training'
group by 1, 2, 3, 4)"""

# network-audit cleaning: routing keys + names non-null, positive segment times,
# first row per (trip, src, dst) by row_ord, ratio capped at the global P99
AUDIT = TRIPS + """,
a0 as (select * from trips where source_center is not null and destination_center is not null
  and source_name is not null and destination_name is not null
  and segment_actual_time is not null and segment_osrm_time is not null
  and segment_actual_time > 0 and segment_osrm_time > 0),
a1 as (select * from (select *, row_number() over (partition by trip_uuid, source_center, destination_center
  order by row_ord) rn from a0) where rn = 1),
a2 as (select *, segment_actual_time / segment_osrm_time as raw_ratio from a1),
cap as (select quantile_cont(raw_ratio, 0.99) as cap from a2),
audit as (select a2.* exclude (rn), least(raw_ratio, cap) as computed_delay_ratio from a2, cap),
corr as (select source_center, destination_center, median(computed_delay_ratio) as weight,
  median(segment_actual_time) as median_actual_time, median(segment_osrm_time) as median_osrm_time,
  median(segment_osrm_distance) as median_distance_km, count(trip_uuid) as trip_count,
  median(computed_delay_ratio) > 1.2 as is_chronic_delay
  from audit group by 1, 2),
labels as (select hub, first(name order by side, row_ord) as label from (
  select source_center hub, source_name name, 0 side, row_ord from audit
  union all select destination_center, destination_name, 1, row_ord from audit) group by hub)"""

TRIP_VIEW_COLUMNS = ["data", "trip_creation_time", "route_type", "trip_uuid", "source_center", "source_name",
                     "destination_center", "destination_name", "start_scan_to_end_scan", "is_cutoff",
                     "cutoff_factor", "actual_distance_to_destination", "actual_time", "osrm_time",
                     "osrm_distance", "factor", "segment_actual_time", "segment_osrm_time",
                     "segment_osrm_distance", "segment_factor", "row_ord"]

NONULL = TRIPS + """,
nonull as (select * from trips where source_center is not null and destination_center is not null
  and actual_time is not null and osrm_time is not null)"""

FEAT_TAIL = FEAT[len(TRIPS):]
EDGES_TAIL = EDGES[len(TRIPS):]

MODEL = TRIPS + """,
mp as (select trip_uuid as trip_id, source_center as source_hub_id, destination_center as dest_hub_id,
  actual_time as actual_eta, osrm_time as osrm_predicted_eta, actual_distance_to_destination as distance_km,
  osrm_distance as osrm_distance_km, trip_creation_time, factor as delay_factor,
  cast(hour(trip_creation_time) as integer) as hour_of_day,
  cast(isodow(trip_creation_time) - 1 as integer) as day_of_week,
  cast(isodow(trip_creation_time) in (6, 7) as integer) as is_weekend,
  cast(is_cutoff as integer) as is_cutoff,
  cast(case route_type when 'FTL' then 0 when 'Carting' then 1 else -1 end as integer) as route_type,
  start_scan_to_end_scan, row_ord
  from trips where source_center is not null and destination_center is not null and actual_time is not null
  and osrm_time is not null and trip_creation_time is not null and factor >= 0.2 and factor <= 10.0
  and actual_time >= 1.0 and osrm_time >= 1.0 and actual_distance_to_destination >= 0.1),
sp as (select *, row_number() over (order by trip_creation_time, row_ord) - 1 as pos, count(*) over () as n from mp),
split as (select *, case when pos < floor(n * 0.8) then 'train' else 'test' end as split from sp),
tr as (select * from split where split = 'train'),
te as (select * from split where split = 'test'),
gm as (select median(actual_eta / osrm_predicted_eta) as g from tr),
cm as (select source_hub_id, dest_hub_id, median(actual_eta / osrm_predicted_eta) as r from tr group by 1, 2),
pred as (
  select 'router' as model, row_ord, actual_eta, osrm_predicted_eta as predicted_eta, osrm_predicted_eta from te
  union all select 'global_median', row_ord, actual_eta, g * osrm_predicted_eta, osrm_predicted_eta from te, gm
  union all select 'corridor_median', te.row_ord, actual_eta, coalesce(cm.r, gm.g) * osrm_predicted_eta,
    osrm_predicted_eta from te cross join gm left join cm using (source_hub_id, dest_hub_id)),
met as (select model, count(*) as n_samples, avg(abs(predicted_eta - actual_eta)) as mae,
  sqrt(avg((predicted_eta - actual_eta) * (predicted_eta - actual_eta))) as rmse,
  avg(abs(predicted_eta - actual_eta) / abs(actual_eta)) * 100 as mape,
  avg(case when abs(predicted_eta - actual_eta) <= 0.15 * abs(actual_eta) then 1.0 else 0.0 end) * 100 as sla_adherence,
  avg(abs(osrm_predicted_eta - actual_eta)) as router_mae,
  sqrt(avg((osrm_predicted_eta - actual_eta) * (osrm_predicted_eta - actual_eta))) as router_rmse,
  avg(case when abs(osrm_predicted_eta - actual_eta) <= 0.15 * abs(actual_eta) then 1.0 else 0.0 end) * 100
    as router_sla_adherence
  from pred group by 1)"""

# unrounded hub features of training rows, appended after FEAT
HUBS_TAIL = """,
tr0 as (select * from feat where data = 'training'),
ob as (select source_center as hub_id, count(trip_uuid) as outbound_trips,
  median(delay_ratio) as avg_congestion_factor, quantile_cont(delay_ratio, 0.75) as p75_delay_ratio,
  stddev_samp(delay_ratio) as std_delay_ratio, avg(cast(is_cutoff as double)) as cutoff_rate,
  median(start_scan_to_end_scan) as avg_dwell_time_min, median(log_dwell_time) as log_dwell_time,
  count(distinct destination_center) as unique_destinations,
  count(*) filter (where route_type = 'FTL') as ftl_count,
  median(delay_ratio) filter (where is_weekend) - median(delay_ratio) filter (where not is_weekend)
    as weekend_congestion_delta from tr0 group by 1),
ib as (select destination_center as hub_id, count(trip_uuid) as inbound_trips,
  count(distinct source_center) as unique_sources from tr0 group by 1),
hubs as (select coalesce(ob.hub_id, ib.hub_id) as hub_id, coalesce(outbound_trips, 0) as outbound_trips,
  coalesce(avg_congestion_factor, 0) as avg_congestion_factor, coalesce(p75_delay_ratio, 0) as p75_delay_ratio,
  coalesce(std_delay_ratio, 0) as std_delay_ratio, coalesce(cutoff_rate, 0) as cutoff_rate,
  coalesce(avg_dwell_time_min, 0) as avg_dwell_time_min, coalesce(log_dwell_time, 0) as log_dwell_time,
  coalesce(unique_destinations, 0) as unique_destinations, ftl_count,
  coalesce(ftl_count * 1.0 / outbound_trips, 0) as ftl_ratio,
  coalesce(weekend_congestion_delta, 0) as weekend_congestion_delta,
  coalesce(inbound_trips, 0) as inbound_trips, coalesce(unique_sources, 0) as unique_sources
  from ob full outer join ib on ob.hub_id = ib.hub_id)"""
