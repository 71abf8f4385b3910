"""Decision queries: corridor decision table, cost rule, CEI scoring, impact."""

from __future__ import annotations

from pyspark.sql import functions as F

from hubflow.operators import audit as A
from hubflow.operators import corridors as C
from hubflow.operators import decisions as D
from hubflow.plans import sqltext as S
from hubflow.plans.common import features, memo, r10, training_table
from hubflow.plans.q_audit import BC_SQL, CHRONIC_SQL, graph_of, metrics_of
from hubflow.plans.registry import query


def dec_table(spark, sf):
    def build():
        v, e = graph_of(spark, sf)
        return D.decision_dataset(C.edge_weights(training_table(spark, sf)), metrics_of(spark, sf),
                                  A.chronic_corridors(e, v))
    return memo(spark, sf, "decision_dataset", build)


def recs_table(spark, sf):
    return memo(spark, sf, "recommendations", lambda: D.recommend_transport_mode(dec_table(spark, sf)))


_TIER = """case when coalesce({bc}, 0.0) > -0.001 and coalesce({bc}, 0.0) <= 0.01 then 'Peripheral'
  when coalesce({bc}, 0.0) > 0.01 and coalesce({bc}, 0.0) <= 0.05 then 'Moderate'
  when coalesce({bc}, 0.0) > 0.05 and coalesce({bc}, 0.0) <= 0.15 then 'High'
  when coalesce({bc}, 0.0) > 0.15 and coalesce({bc}, 0.0) <= 1.0 then 'Critical' end"""

DEC_SQL = f"""with recursive {S.AUDIT}{BC_SQL}{CHRONIC_SQL}{S.EDGES_TAIL},
d0 as (select e.*, ms.betweenness_centrality as src_betweenness_centrality,
  md.betweenness_centrality as dst_betweenness_centrality,
  exists (select 1 from chronic c where c.source_id = e.source_center and c.destination_id = e.destination_center)
    as is_chronic,
  coalesce(e.time_of_day = 'Night_0_6', false) as is_peak_tod,
  greatest(mean_delay_ratio - 1.0, 0.0) * median_osrm_time as excess_delay_min
  from edges e left join metrics ms on ms.facility_id = e.source_center
  left join metrics md on md.facility_id = e.destination_center where edge_weight is not null),
dec as (select *, 2500.0 + 18.0 * median_dist_km + 6.0 * greatest(excess_delay_min, 0.0) as cost_ftl,
  300.0 + 35.0 * median_dist_km + 12.0 * greatest(excess_delay_min, 0.0) as cost_carting,
  {_TIER.format(bc='src_betweenness_centrality')} as src_centrality_tier from d0),
dec2 as (select *, cost_ftl - cost_carting as cost_diff_ftl_minus_carting,
  case when cost_ftl - cost_carting > 0 then 'Carting' else 'FTL' end as raw_recommendation from dec),
r0 as (select *, greatest(0.0, (mean_delay_ratio - 1.0) * ((median_dist_km / 60.0) * 60.0)) as rdelay from dec2
  where src_betweenness_centrality is not null),
r1 as (select *, 2500.0 + 18.0 * median_dist_km + 6.0 * greatest(rdelay, 0.0) as rftl,
  300.0 + 35.0 * median_dist_km + 12.0 * greatest(rdelay, 0.0) as rcart,
  src_betweenness_centrality >= 0.05 and is_peak_tod and median_dist_km < 300.0 as override_applied from r0),
recs as (select *, case when override_applied or rftl - rcart > 0 then 'Carting' else 'FTL' end as recommendation,
  case when abs(rftl - rcart) / greatest(rftl, rcart) * 100 > 20 then 'HIGH'
       when abs(rftl - rcart) / greatest(rftl, rcart) * 100 > 8 then 'MEDIUM' else 'LOW' end as confidence,
  round_even(rftl, 2) as rule_cost_ftl, round_even(rcart, 2) as rule_cost_carting,
  round_even(abs(rftl - rcart), 2) as cost_saving,
  round_even(case when override_applied or rftl - rcart > 0 then rftl - rcart else rcart - rftl end, 2) as net_saving
  from r1),
mis as (select *, upper(route_type) like '%FTL%' as current_mode_is_ftl, recommendation = 'FTL' as rec_is_ftl,
  (upper(route_type) like '%FTL%') <> (recommendation = 'FTL') as is_misrouted,
  case when (upper(route_type) like '%FTL%') <> (recommendation = 'FTL') then cost_saving * trip_count end
    as weighted_saving from recs)"""


@query("decision_dataset", DEC_SQL + """
select source_center, destination_center, route_type, time_of_day, round(src_betweenness_centrality, 10)
  as src_betweenness_centrality, round(dst_betweenness_centrality, 10) as dst_betweenness_centrality,
  is_chronic, is_peak_tod, excess_delay_min, cost_ftl, cost_carting, cost_diff_ftl_minus_carting,
  raw_recommendation, src_centrality_tier from dec2""")
def q_decision_dataset(spark, sf):
    return r10(dec_table(spark, sf).select(
        "source_center", "destination_center", "route_type", "time_of_day", "src_betweenness_centrality",
        "dst_betweenness_centrality", "is_chronic", "is_peak_tod", "excess_delay_min", "cost_ftl",
        "cost_carting", "cost_diff_ftl_minus_carting", "raw_recommendation", "src_centrality_tier"),
        "src_betweenness_centrality", "dst_betweenness_centrality")


@query("recommend_transport_mode", DEC_SQL + """
select source_center, destination_center, route_type, time_of_day, recommendation, confidence,
  rule_cost_ftl, rule_cost_carting, cost_saving, net_saving, override_applied from recs""")
def q_recommend_transport(spark, sf):
    return recs_table(spark, sf).select(
        "source_center", "destination_center", "route_type", "time_of_day", "recommendation", "confidence",
        "rule_cost_ftl", "rule_cost_carting", "cost_saving", "net_saving", "override_applied")


@query("recommendation_reasoning", DEC_SQL + """
select source_center, destination_center, route_type, time_of_day, case when override_applied then
    printf('OVERRIDE: Source hub centrality=%.4f (≥0.05), peak ToD, distance=%.0f km <300 km threshold. '
      || 'FTL through chokepoint during peak compounds cascade risk.', src_betweenness_centrality, median_dist_km)
  else 'Cost model: FTL=₹' || format('{:,}', round_even(rftl, 0)::bigint)
    || ', Carting=₹' || format('{:,}', round_even(rcart, 0)::bigint)
    || ', diff=₹' || case when rftl - rcart >= 0 then '+' else '-' end || format('{:,}', round_even(abs(rftl - rcart), 0)::bigint)
    || printf('. Delay ratio=%.2f×, dist=%.0f km, centrality=%.4f, peak=', mean_delay_ratio, median_dist_km, src_betweenness_centrality)
    || case when is_peak_tod then 'True' else 'False' end || '.' end as reasoning from recs""")
def q_reasoning(spark, sf):
    return recs_table(spark, sf).select("source_center", "destination_center", "route_type", "time_of_day", "reasoning")


@query("export_recommendations", DEC_SQL + """
select source_center, destination_center, route_type, time_of_day, median_dist_km, mean_delay_ratio,
  round(src_betweenness_centrality, 10) as src_betweenness_centrality, src_centrality_tier, is_chronic, is_peak_tod,
  excess_delay_min, cost_ftl, cost_carting, recommendation, confidence, cost_saving, override_applied, trip_count
from recs order by cost_saving desc, source_center, destination_center, route_type, time_of_day limit 10""")
def q_export(spark, sf):
    return r10(D.export_recommendations(recs_table(spark, sf), top=10), "src_betweenness_centrality")


@query("misroute_impact", DEC_SQL + """
select count(*) as evaluated, count(*) filter (where is_misrouted) as misrouted,
  round(count(*) filter (where is_misrouted) * 100.0 / count(*), 10) as pct_misrouted,
  sum(trip_count) filter (where is_misrouted) as trips_affected,
  round(avg(cost_saving) filter (where is_misrouted), 6) as avg_saving,
  round(sum(weighted_saving), 4) as total_weighted_saving,
  count(*) filter (where is_misrouted and current_mode_is_ftl) as ftl_to_carting,
  sum(trip_count) filter (where is_misrouted and current_mode_is_ftl) as ftl_to_carting_trips,
  count(*) filter (where is_misrouted and not current_mode_is_ftl) as carting_to_ftl,
  sum(trip_count) filter (where is_misrouted and not current_mode_is_ftl) as carting_to_ftl_trips from mis""")
def q_misroute_impact(spark, sf):
    out = r10(D.misroute_impact(recs_table(spark, sf)), "pct_misrouted")
    return out.withColumn("avg_saving", F.round("avg_saving", 6)).withColumn(
        "total_weighted_saving", F.round("total_weighted_saving", 4))


@query("misroute_by_tier", DEC_SQL + """
select src_centrality_tier, round(avg(cast(is_misrouted as double)) * 100, 10) as misroute_pct,
  round(sum(weighted_saving), 4) as weighted_saving from mis where src_centrality_tier is not null group by 1""")
def q_misroute_by_tier(spark, sf):
    return r10(D.misroute_by_tier(recs_table(spark, sf)), "misroute_pct").withColumn(
        "weighted_saving", F.round("weighted_saving", 4))


@query("rec_mix_by_tod", DEC_SQL + """
select time_of_day, round(count(*) filter (where recommendation = 'FTL') * 100.0 / count(*), 10) as "FTL",
  round(count(*) filter (where recommendation = 'Carting') * 100.0 / count(*), 10) as "Carting" from recs group by 1""")
def q_rec_mix(spark, sf):
    return r10(D.rec_mix_by_tod(recs_table(spark, sf)), "FTL", "Carting")


@query("recommendation_summary", DEC_SQL + """
select count(*) as rows, count(*) filter (where recommendation = 'FTL') as ftl,
  count(*) filter (where recommendation = 'Carting') as carting,
  round(count(*) filter (where recommendation = 'FTL') * 100.0 / count(*), 10) as ftl_pct,
  count(*) filter (where override_applied) as overrides, count(*) filter (where confidence = 'HIGH') as high_conf,
  count(*) filter (where confidence = 'MEDIUM') as medium_conf, count(*) filter (where confidence = 'LOW') as low_conf,
  count(*) filter (where is_chronic) as chronic from recs""")
def q_rec_summary(spark, sf):
    return r10(D.recommendation_summary(recs_table(spark, sf)), "ftl_pct")


@query("tier_route_delay", DEC_SQL + """
select src_centrality_tier, route_type, round(avg(mean_delay_ratio), 10) as mean_delay_ratio from dec2
where src_centrality_tier is not null group by 1, 2""")
def q_tier_route(spark, sf):
    return r10(D.tier_route_delay(dec_table(spark, sf)), "mean_delay_ratio")


@query("tier_peak_cost", DEC_SQL + """
select src_centrality_tier, is_peak_tod, round(avg(cost_diff_ftl_minus_carting), 6) as mean_cost_diff from dec2
where src_centrality_tier is not null group by 1, 2""")
def q_tier_peak(spark, sf):
    return D.tier_peak_cost(dec_table(spark, sf)).withColumn("mean_cost_diff", F.round("mean_cost_diff", 6))


@query("scenario_evidence", DEC_SQL + """,
sc as (select *, case
  when src_centrality_tier in ('High', 'Critical') and route_type = 'FTL' and is_peak_tod then 'FTL | High/Critical Hub | Peak ToD'
  when src_centrality_tier in ('High', 'Critical') and route_type = 'FTL' and not is_peak_tod then 'FTL | High/Critical Hub | Off-Peak ToD'
  when src_centrality_tier in ('High', 'Critical') and route_type = 'Carting' and is_peak_tod then 'Carting | High/Critical Hub | Peak ToD'
  end as scenario from dec2)
select scenario, count(*) as corridors, round(avg(excess_delay_min), 6) as avg_excess_delay_min,
  round(avg(mean_delay_ratio), 10) as avg_delay_ratio, round(avg(cost_ftl), 6) as avg_cost_ftl,
  round(avg(cost_carting), 6) as avg_cost_carting,
  round(avg(case when cost_diff_ftl_minus_carting > 0 then 1.0 else 0.0 end) * 100, 10) as pct_carting_cheaper
from sc where scenario is not null group by 1""")
def q_scenario_evidence(spark, sf):
    out = D.scenario_evidence(dec_table(spark, sf))
    return r10(out, "avg_delay_ratio", "pct_carting_cheaper").withColumns(
        {c: F.round(c, 6) for c in ("avg_excess_delay_min", "avg_cost_ftl", "avg_cost_carting")})


@query("switch_savings", DEC_SQL + """,
sw as (select * from dec2 where median_dist_km < 2200.0 / 17.0 and route_type = 'FTL' and raw_recommendation = 'Carting'),
per as (select src_centrality_tier, round(avg(cost_diff_ftl_minus_carting), 6) as mean_saving,
  round(sum(cost_diff_ftl_minus_carting), 4) as total_saving, count(*) as corridors from sw group by 1)
select t.src_centrality_tier, mean_saving, total_saving, coalesce(corridors, 0) as corridors
from (values ('Peripheral'), ('Moderate'), ('High'), ('Critical')) t(src_centrality_tier)
left join per using (src_centrality_tier)""")
def q_switch_savings(spark, sf):
    return D.switch_savings(dec_table(spark, sf)).withColumns(
        {"mean_saving": F.round("mean_saving", 6), "total_saving": F.round("total_saving", 4)})


@query("scenario_sweep", DEC_SQL + """
select source_center, destination_center, route_type, time_of_day, delay_min,
  2500.0 + 18.0 * median_dist_km + 6.0 * greatest(delay_min, 0.0) as cost_ftl,
  300.0 + 35.0 * median_dist_km + 12.0 * greatest(delay_min, 0.0) as cost_carting,
  case when 2500.0 + 18.0 * median_dist_km + 6.0 * greatest(delay_min, 0.0)
          > 300.0 + 35.0 * median_dist_km + 12.0 * greatest(delay_min, 0.0) then 'Carting' else 'FTL' end as cheaper,
  round((2200.0 + (-6.0) * delay_min) / 17.0, 10) as breakeven_km
from dec2, (values (0.0::double), (90.0::double)) s(delay_min)""")
def q_scenario_sweep(spark, sf):
    out = D.scenario_sweep(dec_table(spark, sf).select(
        "source_center", "destination_center", "route_type", "time_of_day", "median_dist_km"))
    return r10(out.drop("median_dist_km"), "breakeven_km")


@query("decision_profile", DEC_SQL + """
select 'route_type' as dimension, route_type as value, count(*) as rows from dec2 group by 1, 2
union all select 'time_of_day', time_of_day, count(*) from dec2 group by 1, 2
union all select 'raw_recommendation', raw_recommendation, count(*) from dec2 group by 1, 2
union all select 'is_chronic', case when is_chronic then 'true' else 'false' end, count(*) from dec2 group by 1, 2""")
def q_decision_profile(spark, sf):
    return D.decision_profile(dec_table(spark, sf))


# ---------------------------------------------------------------------------
# Per-record CEI scoring (batch of trip records)
# ---------------------------------------------------------------------------
def records(spark, sf):
    """Scoring records: every cleaned trip with its destination's betweenness and
    its corridor's historical (audit) median delay ratio."""
    v, e = graph_of(spark, sf)
    m = metrics_of(spark, sf).select(F.col("facility_id").alias("destination_center"),
                                     F.col("betweenness_centrality").alias("destination_bc"))
    w = e.select(F.col("src").alias("source_center"), F.col("dst").alias("destination_center"),
                 F.col("weight").alias("historical_delay_ratio"))
    return (features(spark, sf).join(m, "destination_center", "left")
            .join(w, ["source_center", "destination_center"], "left")
            .select("row_ord", F.col("actual_distance_to_destination").alias("distance_km"), "hour_of_day",
                    F.coalesce(F.col("destination_bc"), F.lit(0.0)).alias("destination_bc"),
                    "historical_delay_ratio", F.col("time_of_day").alias("time_of_day_label")))


REC_SQL = f"""with recursive {S.AUDIT}{BC_SQL}{S.FEAT_TAIL},
rin as (select f.row_ord, f.actual_distance_to_destination as distance_km, f.hour_of_day,
  coalesce(m.betweenness_centrality, 0.0) as destination_bc, c.weight as historical_delay_ratio,
  f.time_of_day as time_of_day_label
  from feat f left join metrics m on m.facility_id = f.destination_center
  left join corr c on c.source_center = f.source_center and c.destination_center = f.destination_center),
rv as (select *, case when distance_km is null or distance_km <= 0 then 'distance_km must be positive'
  when hour_of_day is null or hour_of_day < 0 or hour_of_day > 23 then 'hour_of_day must be in [0, 23]'
  when destination_bc is null or destination_bc < 0 then 'destination_bc must be non-negative'
  when historical_delay_ratio is null or historical_delay_ratio < 0 then 'historical_delay_ratio must be non-negative'
  end as error from rin),
s0 as (select *, hour_of_day in (8, 9, 10, 11, 18, 19, 20, 21) as is_peak,
  case when destination_bc >= 0.004828 then 'critical' when destination_bc >= 0.002616 then 'high' else 'low' end as bc_regime,
  historical_delay_ratio > 1.2 as sla_breaching, distance_km > 27.6 as is_long_distance,
  500.0 + 5.0 * distance_km as fb, 100.0 + 20.0 * distance_km as cb from rv where error is null),
s1 as (select *, case when is_peak then 1.0 * 1.1 else 1.0 end as m1 from s0),
s2 as (select *, case bc_regime when 'critical' then m1 * 1.5 when 'high' then m1 * 1.25 else m1 end as m2 from s1),
s3 as (select *, case when sla_breaching then m2 * 1.2 else m2 end as m3 from s2),
s4 as (select *, round_even(fb * m3, 4) as ftl_cei,
  round_even(cb * (case when is_peak then 1.35 else 1.0 end), 4) as carting_cei from s3),
s5 as (select *, case when ftl_cei <= carting_cei then 'FTL' else 'Carting' end as recommendation,
  case when greatest(ftl_cei, carting_cei) > 0 then round_even(least(100.0,
    (greatest(ftl_cei, carting_cei) - least(ftl_cei, carting_cei)) / greatest(ftl_cei, carting_cei) * 100.0), 2)
    else 0.0 end as confidence_score,
  concat_ws(' | ', case when is_peak then 'Peak hour (×1.10)' end,
    case bc_regime when 'critical' then printf('Critical bottleneck at destination (BC=%.5f, ×1.50)', destination_bc)
                   when 'high' then printf('High-centrality destination hub (BC=%.5f, ×1.25)', destination_bc) end,
    case when sla_breaching then printf('SLA-breaching corridor (delay_ratio=%.2f, ×1.20)', historical_delay_ratio) end)
    as ftl_penalties,
  case when is_peak then 'Peak hour (×1.35)' else '' end as carting_penalties from s4),
scored as (select *, case when recommendation = 'Carting' then (case
    when bc_regime = 'critical' then 'Critical bottleneck at destination hub'
    when sla_breaching and is_peak then 'Compound risk: SLA-breaching corridor during peak hours'
    when bc_regime = 'high' then 'High-centrality destination hub: FTL congestion risk'
    when sla_breaching then 'SLA-breaching corridor: FTL inflexibility penalty'
    when is_peak then 'Peak-hour Carting advantage: lower per-stop congestion'
    else printf('Short-haul corridor (%.0f vs %.0f base CEI): Carting base cost advantage',
                round_even(fb, 4), round_even(cb, 4)) end)
  else (case when is_long_distance and not is_peak then 'Distance efficiency: long-haul corridor favours FTL'
    when is_long_distance and is_peak then 'Distance efficiency dominates despite peak-hour costs: long-haul FTL'
    when not is_peak then 'Marginal FTL cost advantage: off-peak, no structural penalties active'
    else 'Distance efficiency overcomes peak-hour penalty' end) end as primary_driver from s5)"""


def scored(spark, sf):
    valid, _ = D.quarantine(records(spark, sf))
    return D.recommend_route_type(valid)


@query("score_modes", REC_SQL + """
select row_ord, ftl_cei, carting_cei, is_peak, is_long_distance, bc_regime, sla_breaching from scored""")
def q_score_modes(spark, sf):
    return scored(spark, sf).select("row_ord", "ftl_cei", "carting_cei", "is_peak", "is_long_distance",
                                    "bc_regime", "sla_breaching")


@query("score_mode_parts", REC_SQL + """
select row_ord, round_even(fb, 4) as ftl_base_cost, round_even(cb, 4) as carting_base_cost,
  round_even(m3, 6)::double as ftl_multiplier, case when is_peak then 1.35 else 1.0 end::double as carting_multiplier from scored""")
def q_score_parts(spark, sf):
    return scored(spark, sf).select("row_ord", "ftl_base_cost", "carting_base_cost", "ftl_multiplier", "carting_multiplier")


@query("recommend_inferred_label", REC_SQL + """
select row_ord, recommendation, confidence_score, case when hour_of_day < 6 then 'Night_0_6' when hour_of_day < 10 then 'Morning_6_10'
  when hour_of_day < 16 then 'Afternoon_10_16' when hour_of_day < 20 then 'Evening_16_20' else 'Night_20_24' end
  as resolved_time_of_day from scored""")
def q_recommend_inferred(spark, sf):
    """The label is inferred from the hour where the records bring none."""
    valid, _ = D.quarantine(records(spark, sf).drop("time_of_day_label"))
    return D.recommend_route_type(valid).select("row_ord", "recommendation", "confidence_score", "resolved_time_of_day")


@query("recommend_route_type", REC_SQL + """
select row_ord, recommendation, confidence_score, time_of_day_label as resolved_time_of_day from scored""")
def q_recommend_route_type(spark, sf):
    return scored(spark, sf).select("row_ord", "recommendation", "confidence_score", "resolved_time_of_day")


@query("penalties_drivers", REC_SQL + """
select row_ord, ftl_penalties, carting_penalties, primary_driver from scored""")
def q_penalties(spark, sf):
    return scored(spark, sf).select(
        "row_ord", F.array_join("active_ftl_penalties", " | ").alias("ftl_penalties"),
        F.array_join("active_carting_penalties", " | ").alias("carting_penalties"), "primary_driver")


@query("quarantine", REC_SQL + """
select coalesce(error, 'valid') as status, count(*) as rows from rv group by 1""")
def q_quarantine(spark, sf):
    return (D.validate_records(records(spark, sf)).groupBy(F.coalesce(F.col("error"), F.lit("valid")).alias("status"))
            .agg(F.count(F.lit(1)).alias("rows")))
