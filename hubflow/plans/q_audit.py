"""Network-audit queries: segment cleaning, corridor digraph, hub metrics,
betweenness, chronic corridors, facility ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from hubflow.operators import audit as A
from hubflow.operators import graph as G
from hubflow.plans import sqltext as S
from hubflow.plans.common import r10, trips
from hubflow.plans.registry import query


def audited(spark, sf):
    """Audit-cleaned segments, written once per session (they feed the hub
    labels, the corridor table and every audit summary): the columns that these read."""
    from hubflow.plans.common import keep
    return keep(spark, sf, "audited", lambda: A.audit_clean(trips(spark, sf).select(
        "trip_uuid", "row_ord", "source_center", "source_name", "destination_center", "destination_name",
        "segment_actual_time", "segment_osrm_time", "segment_osrm_distance")))


def graph_of(spark, sf):
    """Hub and corridor tables, materialised once (small next to the trips;
    every graph operator reads them several times)."""
    from hubflow.plans.common import memo
    v = memo(spark, sf, "audit_vertices", lambda: A.hub_table(audited(spark, sf)))
    e = memo(spark, sf, "audit_edges", lambda: A.corridor_table(audited(spark, sf)))
    return v, e


def metrics_of(spark, sf):
    """Hub metric table (betweenness included), materialised once per session."""
    from hubflow.plans.common import memo
    return memo(spark, sf, "node_metrics", lambda: A.node_metrics(*graph_of(spark, sf)))


# Brandes betweenness in SQL (min-plus squaring + recursive path counts), tie-aware.
BC_SQL = """,
e as (select source_center s, destination_center d, weight w from corr),
n as (select s v from e union select d from e), nn as (select count(*) k from n),
d1  as (select s,d,w from e where s<>d union all select v,v,0.0::double from n),
d2  as (select a.s,b.d,min(a.w+b.w) w from d1 a join d1 b on a.d=b.s group by 1,2),
d4  as (select a.s,b.d,min(a.w+b.w) w from d2 a join d2 b on a.d=b.s group by 1,2),
d8  as (select a.s,b.d,min(a.w+b.w) w from d4 a join d4 b on a.d=b.s group by 1,2),
d16 as (select a.s,b.d,min(a.w+b.w) w from d8 a join d8 b on a.d=b.s group by 1,2),
dd  as (select a.s,b.d,min(a.w+b.w) w from d16 a join d16 b on a.d=b.s group by 1,2),
p(s,v) as (select v,v from n union all
  select p.s,e.d from p join e on e.s=p.v and e.s<>e.d
  join dd x on x.s=p.s and x.d=p.v join dd y on y.s=p.s and y.d=e.d where x.w+e.w=y.w),
sg as (select s,v d,count(*) c from p group by 1,2),
bt as (select a.d v, sum(sa.c*sb.c*1.0::double/sc.c) b
  from dd a join dd b on a.d=b.s join dd c on c.s=a.s and c.d=b.d
  join sg sa on sa.s=a.s and sa.d=a.d join sg sb on sb.s=b.s and sb.d=b.d join sg sc on sc.s=a.s and sc.d=b.d
  where a.s<>a.d and b.s<>b.d and a.s<>b.d and a.w+b.w=c.w group by 1),
bc as (select n.v, coalesce(b,0)/((k-1)*(k-2)) bc from n cross join nn left join bt on bt.v=n.v),
deg as (select v, (select count(*) from corr where destination_center = v) as in_degree,
  (select count(*) from corr where source_center = v) as out_degree,
  coalesce((select sum(weight) from corr where destination_center = v), 0.0) as w_in,
  coalesce((select sum(weight) from corr where source_center = v), 0.0) as w_out from n),
metrics as (select bc.v as facility_id, labels.label, bc.bc as betweenness_centrality, in_degree, out_degree,
  in_degree / ((select k from nn) - 1.0) as in_degree_centrality,
  out_degree / ((select k from nn) - 1.0) as out_degree_centrality,
  (in_degree - out_degree) / greatest(in_degree + out_degree, 1) as degree_asymmetry,
  w_in as weighted_in_strength, w_out as weighted_out_strength
  from bc join deg using (v) left join labels on labels.hub = bc.v)"""

CHRONIC_SQL = """,
chronic as (select c.source_center as source_id, c.destination_center as destination_id,
  ls.label as source_label, ld.label as destination_label, weight as median_delay_ratio,
  (weight - 1.0) * 100 as excess_delay_pct, trip_count, median_actual_time as median_actual_min,
  median_osrm_time as median_osrm_min, median_distance_km, (weight - 1.0) * trip_count as breach_severity_score
  from corr c left join labels ls on ls.hub = c.source_center left join labels ld on ld.hub = c.destination_center
  where weight > 1.2),
roll as (select facility_id, facility_label, sum(breach_severity_score) as total_severity_score,
  count(breach_severity_score) as chronic_corridor_count, avg(median_delay_ratio) as mean_delay_ratio,
  max(median_delay_ratio) as max_delay_ratio from (
  select source_id facility_id, source_label facility_label, breach_severity_score, median_delay_ratio from chronic
  union all select destination_id, destination_label, breach_severity_score, median_delay_ratio from chronic)
  group by 1, 2)"""


@query("dedup_first", f"""with {S.AUDIT}
select trip_uuid, source_center, destination_center, row_ord from a1""")
def q_dedup(spark, sf):
    from hubflow.functions.cleaning import dedup_first, drop_critical_nulls, positive_times
    from hubflow.schema import ROUTING_COLUMNS
    t = positive_times(drop_critical_nulls(trips(spark, sf), ROUTING_COLUMNS)
                       .na.drop(subset=["segment_actual_time", "segment_osrm_time"]))
    return dedup_first(t, ["trip_uuid", "source_center", "destination_center"]).select(
        "trip_uuid", "source_center", "destination_center", "row_ord")


@query("winsorise", f"""with {S.AUDIT}
select round(max(c.cap), 10) as cap, count(*) filter (where raw_ratio > c.cap) as rows_capped,
  round(max(computed_delay_ratio), 10) as max_after from audit, cap c""")
def q_winsorise(spark, sf):
    a = audited(spark, sf)
    return r10(a.agg(F.max(F.col("computed_delay_ratio")).alias("cap"),
                     F.count_if(F.col("__capped")).alias("rows_capped"),
                     F.max("computed_delay_ratio").alias("max_after")), "cap", "max_after")


@query("corridor_edges", f"""with {S.AUDIT}
select source_center, destination_center, weight, median_actual_time, median_osrm_time, median_distance_km,
  trip_count, is_chronic_delay from corr""")
def q_corridor_edges(spark, sf):
    _, e = graph_of(spark, sf)
    return e.withColumnRenamed("src", "source_center").withColumnRenamed("dst", "destination_center")


@query("hub_labels", f"""with {S.AUDIT} select hub as hub_id, label from labels""")
def q_hub_labels(spark, sf):
    v, _ = graph_of(spark, sf)
    return v.withColumnRenamed("v", "hub_id")


@query("degrees", f"""with recursive {S.AUDIT}{BC_SQL}
select facility_id as v, in_degree, out_degree, round(in_degree_centrality, 10) as in_degree_centrality,
  round(out_degree_centrality, 10) as out_degree_centrality, round(degree_asymmetry, 10) as degree_asymmetry
from metrics""")
def q_degrees(spark, sf):
    v, e = graph_of(spark, sf)
    return r10(G.degrees(e, v.select("v")), "in_degree_centrality", "out_degree_centrality", "degree_asymmetry")


@query("strengths", f"""with recursive {S.AUDIT}{BC_SQL}
select facility_id as v, weighted_in_strength, weighted_out_strength from metrics""")
def q_strengths(spark, sf):
    v, e = graph_of(spark, sf)
    return G.strengths(e, v.select("v"))


@query("structural_checks", f"""with {S.AUDIT}
select (select count(*) from labels) as nodes, count(*) as edges,
  count(*) filter (where source_center = destination_center) as self_loops,
  count(distinct source_center) as nodes_with_out_edges, count(distinct destination_center) as nodes_with_in_edges,
  (select count(*) from labels where hub not in (select source_center from corr)
     and hub not in (select destination_center from corr)) as isolated_nodes
from corr""")
def q_structural(spark, sf):
    v, e = graph_of(spark, sf)
    return G.structural_checks(e, v.select("v"))


@query("graph_summary", f"""with {S.AUDIT}
select (select count(*) from labels) as nodes, count(*) as edges, count(*) filter (where weight > 1.2) as chronic_edges,
  min(weight) as weight_min, max(weight) as weight_max,
  round(count(*) * 1.0 / ((select count(*) from labels) * ((select count(*) from labels) - 1)), 10) as density
from corr""")
def q_graph_summary(spark, sf):
    v, e = graph_of(spark, sf)
    return r10(G.graph_summary(e, v.select("v")), "density")


@query("components", f"""with recursive {S.AUDIT.replace('with recursive ', '')},
und as (select source_center a, destination_center b from corr union select destination_center, source_center from corr),
reach(v, r) as (select hub, hub from labels union select und.b, reach.r from reach join und on und.a = reach.v)
select v, min(r) as component from reach group by v""")
def q_components(spark, sf):
    v, e = graph_of(spark, sf)
    return G.weak_components(e, v.select("v"))


@query("component_summary", f"""with recursive {S.AUDIT},
und as (select source_center a, destination_center b from corr union select destination_center, source_center from corr),
reach(v, r) as (select hub, hub from labels union select und.b, reach.r from reach join und on und.a = reach.v),
comp as (select v, min(r) as c from reach group by v),
sizes as (select c, count(*) as size from comp group by c)
select count(*) as components, count(*) = 1 as is_connected,
  (list(size order by size desc))[1:5] as largest_sizes from sizes""")
def q_component_summary(spark, sf):
    v, e = graph_of(spark, sf)
    return G.component_summary(G.weak_components(e, v.select("v")))


@query("betweenness", f"""with recursive {S.AUDIT}{BC_SQL}
select v, round(bc, 10) as betweenness_centrality, (select count(*) from bc) as pivots from bc""")
def q_betweenness(spark, sf):
    v, e = graph_of(spark, sf)
    return r10(G.betweenness(e, v.select("v")), "betweenness_centrality")


@query("betweenness_pivots", f"""with recursive {S.AUDIT}{BC_SQL},
piv as (select v from n order by md5(v || ':42'), v limit 10),
pt as (select a.d v, sum(sa.c*sb.c*1.0::double/sc.c) b
  from dd a join dd b on a.d=b.s join dd c on c.s=a.s and c.d=b.d
  join sg sa on sa.s=a.s and sa.d=a.d join sg sb on sb.s=b.s and sb.d=b.d join sg sc on sc.s=a.s and sc.d=b.d
  where a.s in (select v from piv) and a.s<>a.d and b.s<>b.d and a.s<>b.d and a.w+b.w=c.w group by 1)
select n.v, round(coalesce(b,0)/((k-1)*(k-2))*k/(select count(*) from piv), 10) as betweenness_centrality,
  (select count(*) from piv) as pivots from n cross join nn left join pt on pt.v=n.v""")
def q_betweenness_pivots(spark, sf):
    """Betweenness from ten seeded pivots, the published mode of large networks (there 300)."""
    v, e = graph_of(spark, sf)
    return r10(G.betweenness(e, v.select("v"), k=10), "betweenness_centrality")


_METRIC_COLS = ["betweenness_centrality", "in_degree_centrality", "out_degree_centrality", "degree_asymmetry"]


@query("node_metrics", f"""with recursive {S.AUDIT}{BC_SQL}
select facility_id, label, round(betweenness_centrality, 10) as betweenness_centrality, in_degree, out_degree,
  round(in_degree_centrality, 10) as in_degree_centrality, round(out_degree_centrality, 10) as out_degree_centrality,
  round(degree_asymmetry, 10) as degree_asymmetry, weighted_in_strength, weighted_out_strength from metrics""")
def q_node_metrics(spark, sf):
    return r10(metrics_of(spark, sf), *_METRIC_COLS)


@query("chronic_corridors", f"""with {S.AUDIT}{CHRONIC_SQL}
select * from chronic""")
def q_chronic(spark, sf):
    v, e = graph_of(spark, sf)
    return A.chronic_corridors(e, v)


@query("facility_rollup", f"""with {S.AUDIT}{CHRONIC_SQL}
select facility_id, facility_label, total_severity_score, chronic_corridor_count,
  round(mean_delay_ratio, 10) as mean_delay_ratio, max_delay_ratio from roll""")
def q_rollup(spark, sf):
    v, e = graph_of(spark, sf)
    return r10(A.facility_rollup(A.chronic_corridors(e, v)), "mean_delay_ratio")


@query("minmax", f"""with {S.AUDIT}{CHRONIC_SQL}
select facility_id, round(case when max(total_severity_score) over () > min(total_severity_score) over ()
  then (total_severity_score - min(total_severity_score) over ())
       / (max(total_severity_score) over () - min(total_severity_score) over ())
  else total_severity_score * 0.0 end, 10) as norm_severity from roll""")
def q_minmax(spark, sf):
    v, e = graph_of(spark, sf)
    r = A.minmax(A.facility_rollup(A.chronic_corridors(e, v)), "total_severity_score", "norm_severity")
    return r10(r.select("facility_id", "norm_severity"), "norm_severity")


def _ranked(spark, sf):
    v, e = graph_of(spark, sf)
    metrics = metrics_of(spark, sf)
    chronic = A.chronic_corridors(e, v)
    return v, e, metrics, chronic, A.rank_facilities(chronic, metrics, top_n=10)


RANK_SQL = f"""with recursive {S.AUDIT}{BC_SQL}{CHRONIC_SQL},
j as (select roll.*, m.betweenness_centrality, m.in_degree, m.out_degree, m.degree_asymmetry
  from roll left join metrics m using (facility_id)),
nm as (select j.*,
  case when max(total_severity_score) over () > min(total_severity_score) over ()
    then (total_severity_score - min(total_severity_score) over ())
       / (max(total_severity_score) over () - min(total_severity_score) over ()) else 0.0 end as norm_severity,
  case when max(betweenness_centrality) over () > min(betweenness_centrality) over ()
    then (betweenness_centrality - min(betweenness_centrality) over ())
       / (max(betweenness_centrality) over () - min(betweenness_centrality) over ()) else 0.0 end as norm_bc
  from j),
ranked as (select *, norm_severity * norm_bc as composite_risk from nm
  order by composite_risk desc, total_severity_score desc, facility_id limit 10)"""


@query("rank_facilities", RANK_SQL + """
select facility_id, facility_label, total_severity_score, chronic_corridor_count,
  round(mean_delay_ratio, 10) as mean_delay_ratio, max_delay_ratio,
  round(betweenness_centrality, 10) as betweenness_centrality, in_degree, out_degree,
  round(degree_asymmetry, 10) as degree_asymmetry, round(norm_severity, 8) as norm_severity,
  round(norm_bc, 8) as norm_bc, round(composite_risk, 8) as composite_risk,
  row_number() over (order by composite_risk desc, total_severity_score desc, facility_id) as rank
from ranked""")
def q_rank(spark, sf):
    *_, ranked = _ranked(spark, sf)
    out = r10(ranked, "mean_delay_ratio", "betweenness_centrality", "degree_asymmetry")
    return out.withColumns({c: F.round(c, 8) for c in ("norm_severity", "norm_bc", "composite_risk")}).withColumn(
        "rank", F.col("rank").cast("bigint"))


@query("exec_summary", RANK_SQL + """
select (select count(*) from audit) as segments, (select count(*) from metrics) as hubs,
  (select count(*) from corr) as corridors, (select count(*) from chronic) as chronic_corridors,
  round((select count(*) from chronic) * 100.0 / (select count(*) from corr), 10) as chronic_pct,
  (select facility_id from metrics order by betweenness_centrality desc, facility_id desc limit 1) as top_hub,
  round((select max(betweenness_centrality) from metrics), 10) as top_hub_bc,
  (select source_id from chronic order by breach_severity_score desc, source_id desc, destination_id desc limit 1) as worst_src,
  (select destination_id from chronic order by breach_severity_score desc, source_id desc, destination_id desc limit 1) as worst_dst,
  (select facility_id from ranked order by composite_risk desc, total_severity_score desc, facility_id limit 1) as top_offender""")
def q_exec_summary(spark, sf):
    v, e, metrics, chronic, ranked = _ranked(spark, sf)
    return r10(A.exec_summary(audited(spark, sf), e, metrics, chronic, ranked), "chronic_pct", "top_hub_bc")


@query("calibrate_thresholds", f"""with recursive {S.AUDIT}{BC_SQL}{CHRONIC_SQL}
select round(quantile_cont(betweenness_centrality, 0.90), 10) as bc_p90,
  round(quantile_cont(betweenness_centrality, 0.95), 10) as bc_p95,
  round(max(betweenness_centrality), 10) as bc_max, count(*) as hubs,
  (select quantile_cont(median_distance_km, 0.75) from chronic) as chronic_p75_km,
  400.0 / 15.0 as breakeven_km,
  400.0 / 15.0 - (select quantile_cont(median_distance_km, 0.75) from chronic) as breakeven_drift_km
from metrics""")
def q_calibrate(spark, sf):
    v, e = graph_of(spark, sf)
    metrics = metrics_of(spark, sf)
    return r10(A.calibrate_thresholds(metrics, A.chronic_corridors(e, v)), "bc_p90", "bc_p95", "bc_max")


@query("corridor_labels", f"""with {S.AUDIT}{CHRONIC_SQL}
select source_id, destination_id, concat(left(source_label, 12), ' → ', left(destination_label, 12)) as corridor,
  left(source_label, 20) as source_short, upper(source_label) like '%A%' as label_has_a
from chronic order by breach_severity_score desc, source_id, destination_id limit 15""")
def q_corridor_labels(spark, sf):
    """Chart labels of the 15 most severe chronic corridors (slice, concat, upper/contains)."""
    v, e = graph_of(spark, sf)
    c = A.chronic_corridors(e, v).orderBy(F.desc("breach_severity_score"), "source_id", "destination_id").limit(15)
    return c.select("source_id", "destination_id",
                    F.concat(F.substring("source_label", 1, 12), F.lit(" → "),
                             F.substring("destination_label", 1, 12)).alias("corridor"),
                    F.substring("source_label", 1, 20).alias("source_short"),
                    F.upper("source_label").contains("A").alias("label_has_a"))
