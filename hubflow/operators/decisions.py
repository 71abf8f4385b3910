"""Transport-mode decisions: cost-efficiency scoring per record, the corridor
decision table, the cost rule with its override, and impact aggregates.

All logic is column expressions (no Python UDF): the rule set is applied to
every row inside whole-stage codegen.  Text fields follow the fixed formats
of the studied analysis (two-decimal / four-decimal numbers, half-even).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubflow.functions.features import centrality_tier, is_peak_tod, tod_label
from hubflow.schema import CEI_DEFAULTS, COST_DEFAULTS, TIER_LABELS, TOD_LABELS


def _fmt(c: Column, digits: int) -> Column:
    """Python-style fixed-point text (half-even on the exact value, no grouping)."""
    return F.regexp_replace(F.format_number(c, digits), ",", "")


def _mult(label: float) -> str:
    return f"{label:.2f}"


# ---------------------------------------------------------------------------
# J1–J6: cost-efficiency index per record
# ---------------------------------------------------------------------------
def validate_records(df: DataFrame) -> DataFrame:
    """Add ``error`` (NULL when the record is valid)."""
    km, hour = F.col("distance_km"), F.col("hour_of_day")
    bc, ratio = F.col("destination_bc"), F.col("historical_delay_ratio")
    label = F.col("time_of_day_label") if "time_of_day_label" in df.columns else F.lit(None).cast("string")
    return df.withColumn("error", F.when(km.isNull() | (km <= 0), "distance_km must be positive")
                         .when(hour.isNull() | (hour < 0) | (hour > 23), "hour_of_day must be in [0, 23]")
                         .when(bc.isNull() | (bc < 0), "destination_bc must be non-negative")
                         .when(ratio.isNull() | (ratio < 0), "historical_delay_ratio must be non-negative")
                         .when(label.isNotNull() & ~label.isin(*TOD_LABELS), "time_of_day_label is not valid"))


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) split instead of a job-killing exception."""
    v = validate_records(df)
    return v.filter(F.col("error").isNull()).drop("error"), v.filter(F.col("error").isNotNull())


def validate_params(params: dict) -> dict:
    """The scorer's parameters, or a ValueError that lists every rule they break."""
    p = CEI_DEFAULTS | params
    unknown = sorted(set(params) - set(CEI_DEFAULTS))
    broken = [f"unknown parameter {k}" for k in unknown]
    broken += [f"{k} must be positive" for k in ("fixed_ftl", "var_ftl_per_km", "fixed_carting", "var_carting_per_km",
                                                  "long_distance_threshold_km") if not p[k] > 0]
    broken += [f"{k} must be at least 1" for k in CEI_DEFAULTS if k.endswith("_multiplier") and not p[k] >= 1]
    rules = {"0 < bc_high_threshold < bc_critical_threshold": 0 < p["bc_high_threshold"] < p["bc_critical_threshold"],
             "sla_delay_threshold must be in [1, 10]": 1 <= p["sla_delay_threshold"] <= 10,
             "var_carting_per_km must exceed var_ftl_per_km": p["var_carting_per_km"] > p["var_ftl_per_km"],
             "peak_hours must be hours from 0 to 23": all(h in range(24) for h in p["peak_hours"])}
    broken += [rule for rule, holds in rules.items() if not holds]
    if broken:
        raise ValueError("; ".join(broken))
    return p


def score_modes(df: DataFrame, params: dict = CEI_DEFAULTS) -> DataFrame:
    """CEI for FTL and Carting: base = fixed + var·km, multiplicative penalties."""
    p = validate_params(params)
    km, hour = F.col("distance_km"), F.col("hour_of_day")
    bc, ratio = F.col("destination_bc"), F.col("historical_delay_ratio")
    is_peak = hour.isin(*p["peak_hours"])
    regime = (F.when(bc >= p["bc_critical_threshold"], "critical")
              .when(bc >= p["bc_high_threshold"], "high").otherwise("low"))
    sla = ratio > p["sla_delay_threshold"]
    ftl_base = F.lit(p["fixed_ftl"]) + F.lit(p["var_ftl_per_km"]) * km
    cart_base = F.lit(p["fixed_carting"]) + F.lit(p["var_carting_per_km"]) * km
    cart_mult = F.when(is_peak, F.lit(p["carting_peak_multiplier"])).otherwise(F.lit(1.0))
    # multipliers are applied in the fixed order peak -> bottleneck -> SLA
    ftl_mult_seq = F.lit(1.0)
    ftl_mult_seq = F.when(is_peak, ftl_mult_seq * p["ftl_peak_multiplier"]).otherwise(ftl_mult_seq)
    ftl_mult_seq = (F.when(regime == "critical", ftl_mult_seq * p["ftl_critical_bc_multiplier"])
                    .when(regime == "high", ftl_mult_seq * p["ftl_high_bc_multiplier"]).otherwise(ftl_mult_seq))
    ftl_mult_seq = F.when(sla, ftl_mult_seq * p["ftl_sla_multiplier"]).otherwise(ftl_mult_seq)
    ftl_pen = F.array_compact(F.array(
        F.when(is_peak, F.lit(f"Peak hour (×{_mult(p['ftl_peak_multiplier'])})")),
        F.when(regime == "critical", F.concat(F.lit("Critical bottleneck at destination (BC="), _fmt(bc, 5),
                                              F.lit(f", ×{_mult(p['ftl_critical_bc_multiplier'])})")))
         .when(regime == "high", F.concat(F.lit("High-centrality destination hub (BC="), _fmt(bc, 5),
                                          F.lit(f", ×{_mult(p['ftl_high_bc_multiplier'])})"))),
        F.when(sla, F.concat(F.lit("SLA-breaching corridor (delay_ratio="), _fmt(ratio, 2),
                             F.lit(f", ×{_mult(p['ftl_sla_multiplier'])})")))))
    cart_pen = F.array_compact(F.array(
        F.when(is_peak, F.lit(f"Peak hour (×{_mult(p['carting_peak_multiplier'])})"))))
    return df.withColumns({
        "ftl_base_cost": F.bround(ftl_base, 4), "carting_base_cost": F.bround(cart_base, 4),
        "ftl_multiplier": F.bround(ftl_mult_seq, 6), "carting_multiplier": F.bround(cart_mult, 6),
        "ftl_cei": F.bround(ftl_base * ftl_mult_seq, 4), "carting_cei": F.bround(cart_base * cart_mult, 4),
        "is_peak": is_peak, "is_long_distance": km > p["long_distance_threshold_km"],
        "bc_regime": regime, "sla_breaching": sla,
        "active_ftl_penalties": ftl_pen, "active_carting_penalties": cart_pen,
    })


def primary_driver(rec: Column) -> Column:
    """Plain-language reason in fixed priority order."""
    regime, sla, peak, long_d = (F.col("bc_regime"), F.col("sla_breaching"), F.col("is_peak"),
                                 F.col("is_long_distance"))
    short = F.concat(F.lit("Short-haul corridor ("), _fmt(F.col("ftl_base_cost"), 0), F.lit(" vs "),
                     _fmt(F.col("carting_base_cost"), 0), F.lit(" base CEI): Carting base cost advantage"))
    carting = (F.when(regime == "critical", F.lit("Critical bottleneck at destination hub"))
               .when(sla & peak, F.lit("Compound risk: SLA-breaching corridor during peak hours"))
               .when(regime == "high", F.lit("High-centrality destination hub: FTL congestion risk"))
               .when(sla, F.lit("SLA-breaching corridor: FTL inflexibility penalty"))
               .when(peak, F.lit("Peak-hour Carting advantage: lower per-stop congestion"))
               .otherwise(short))
    ftl = (F.when(long_d & ~peak, F.lit("Distance efficiency: long-haul corridor favours FTL"))
           .when(long_d & peak, F.lit("Distance efficiency dominates despite peak-hour costs: long-haul FTL"))
           .when(~peak, F.lit("Marginal FTL cost advantage: off-peak, no structural penalties active"))
           .otherwise(F.lit("Distance efficiency overcomes peak-hour penalty")))
    return F.when(rec == "Carting", carting).otherwise(ftl)


def recommend_route_type(df: DataFrame, params: dict = CEI_DEFAULTS) -> DataFrame:
    """Lower CEI wins (tie -> FTL); confidence = min(100, margin / loser · 100), 2 dp."""
    s = score_modes(df, params)
    rec = F.when(F.col("ftl_cei") <= F.col("carting_cei"), "FTL").otherwise("Carting")
    winner = F.least("ftl_cei", "carting_cei")
    loser = F.greatest("ftl_cei", "carting_cei")
    conf = F.when(loser > 0, F.bround(F.least(F.lit(100.0), (loser - winner) / loser * 100.0), 2)).otherwise(0.0)
    label = (F.coalesce(F.col("time_of_day_label"), tod_label(F.col("hour_of_day")))
             if "time_of_day_label" in df.columns else tod_label(F.col("hour_of_day")))
    return (s.withColumn("recommendation", rec).withColumn("confidence_score", conf)
            .withColumn("primary_driver", primary_driver(F.col("recommendation")))
            .withColumn("resolved_time_of_day", label))


# ---------------------------------------------------------------------------
# J7–J11: rupee cost model over the corridor decision table
# ---------------------------------------------------------------------------
def mode_costs(km: Column, delay: Column, c: dict = COST_DEFAULTS) -> tuple[Column, Column]:
    d = F.greatest(delay, F.lit(0.0))
    ftl = F.lit(c["ftl_base"]) + F.lit(c["ftl_per_km"]) * km + F.lit(c["ftl_delay_penalty"]) * d
    cart = F.lit(c["carting_base"]) + F.lit(c["carting_per_km"]) * km + F.lit(c["carting_delay_penalty"]) * d
    return ftl, cart


def breakeven_km(delay: Column | float = 0.0, c: dict = COST_DEFAULTS) -> Column:
    d = F.lit(delay) if not isinstance(delay, Column) else delay
    return ((F.lit(c["ftl_base"] - c["carting_base"]) + F.lit(c["ftl_delay_penalty"] - c["carting_delay_penalty"]) * d)
            / F.lit(c["carting_per_km"] - c["ftl_per_km"]))


def decision_dataset(edges: DataFrame, metrics: DataFrame, chronic: DataFrame,
                     c: dict = COST_DEFAULTS) -> DataFrame:
    """Edge strata + source/destination hub metrics + chronic flag + costs + tier."""
    look = metrics.select(F.col("facility_id").alias("hub_id"), "betweenness_centrality", "in_degree",
                          "out_degree", "weighted_in_strength", "weighted_out_strength")
    src = look.select([F.col(x).alias("source_center" if x == "hub_id" else f"src_{x}") for x in look.columns])
    dst = look.select([F.col(x).alias("destination_center" if x == "hub_id" else f"dst_{x}") for x in look.columns])
    pairs = (chronic.select(F.col("source_id").alias("source_center"),
                            F.col("destination_id").alias("destination_center")).distinct()
             .withColumn("__chronic", F.lit(True)))
    d = (edges.join(src, "source_center", "left").join(dst, "destination_center", "left")
         .join(pairs, ["source_center", "destination_center"], "left")
         .withColumn("is_chronic", F.coalesce(F.col("__chronic"), F.lit(False))).drop("__chronic")
         .withColumn("is_peak_tod", is_peak_tod(F.col("time_of_day")))
         .withColumn("excess_delay_min",
                     F.greatest(F.col("mean_delay_ratio") - 1.0, F.lit(0.0)) * F.col("median_osrm_time")))
    ftl, cart = mode_costs(F.col("median_dist_km"), F.col("excess_delay_min"), c)
    return (d.withColumn("cost_ftl", ftl).withColumn("cost_carting", cart)
            .withColumn("cost_diff_ftl_minus_carting", F.col("cost_ftl") - F.col("cost_carting"))
            .withColumn("raw_recommendation",
                        F.when(F.col("cost_diff_ftl_minus_carting") > 0, "Carting").otherwise("FTL"))
            .withColumn("src_centrality_tier", centrality_tier(F.col("src_betweenness_centrality"))))


def _py_bool(c: Column) -> Column:
    return F.when(c, "True").otherwise("False")


def recommend_transport_mode(dec: DataFrame, c: dict = COST_DEFAULTS) -> DataFrame:
    """Cost rule with 60 km/h delay proxy, chokepoint override, confidence band, reasoning."""
    km, ratio = F.col("median_dist_km"), F.col("mean_delay_ratio")
    bc, peak = F.col("src_betweenness_centrality"), F.col("is_peak_tod")
    speed = c["assumed_speed_kmph"]
    approx_osrm = (km / speed) * 60.0
    delay = F.greatest(F.lit(0.0), (ratio - 1.0) * approx_osrm)
    ftl, cart = mode_costs(km, delay, c)
    diff = ftl - cart
    base = F.when(diff > 0, "Carting").otherwise("FTL")
    override = (bc >= c["centrality_high_threshold"]) & peak & (km < c["distance_ftl_threshold_km"])
    margin = F.abs(diff) / F.greatest(ftl, cart) * 100
    conf = F.when(margin > 20, "HIGH").when(margin > 8, "MEDIUM").otherwise("LOW")
    thr = c["centrality_high_threshold"]
    why_override = F.concat(
        F.lit("OVERRIDE: Source hub centrality="), _fmt(bc, 4), F.lit(f" (≥{thr}), peak ToD, distance="),
        _fmt(km, 0), F.lit(f" km <{c['distance_ftl_threshold_km']:.0f} km threshold. "
                           "FTL through chokepoint during peak compounds cascade risk."))
    signed = F.when(diff >= 0, F.concat(F.lit("+"), F.format_number(diff, 0))).otherwise(F.format_number(diff, 0))
    why_cost = F.concat(
        F.lit("Cost model: FTL=₹"), F.format_number(ftl, 0), F.lit(", Carting=₹"), F.format_number(cart, 0),
        F.lit(", diff=₹"), signed, F.lit(". Delay ratio="), _fmt(ratio, 2), F.lit("×, dist="), _fmt(km, 0),
        F.lit(" km, centrality="), _fmt(bc, 4), F.lit(", peak="), _py_bool(peak), F.lit("."))
    return (dec.filter(bc.isNotNull())
            .withColumn("recommendation", F.when(override, "Carting").otherwise(base))
            .withColumn("confidence", conf)
            .withColumn("rule_cost_ftl", F.bround(ftl, 2)).withColumn("rule_cost_carting", F.bround(cart, 2))
            .withColumn("cost_saving", F.bround(F.abs(diff), 2))
            .withColumn("net_saving", F.bround(F.when(override | (diff > 0), diff).otherwise(-diff), 2))
            .withColumn("override_applied", override)
            .withColumn("reasoning", F.when(override, why_override).otherwise(why_cost)))


EXPORT_COLUMNS = ["source_center", "destination_center", "route_type", "time_of_day", "median_dist_km",
                  "mean_delay_ratio", "src_betweenness_centrality", "src_centrality_tier", "is_chronic",
                  "is_peak_tod", "excess_delay_min", "cost_ftl", "cost_carting", "recommendation", "confidence",
                  "cost_saving", "override_applied", "trip_count"]


def export_recommendations(recs: DataFrame, top: int | None = None) -> DataFrame:
    out = recs.select(*EXPORT_COLUMNS)
    if top is not None:
        out = out.orderBy(F.desc("cost_saving"), "source_center", "destination_center", "route_type",
                          "time_of_day").limit(top)
    return out


def with_misroute(recs: DataFrame) -> DataFrame:
    return (recs.withColumn("current_mode_is_ftl", F.upper(F.col("route_type")).contains("FTL"))
            .withColumn("rec_is_ftl", F.col("recommendation") == "FTL")
            .withColumn("is_misrouted", F.col("current_mode_is_ftl") != F.col("rec_is_ftl"))
            .withColumn("weighted_saving", F.when(F.col("is_misrouted"), F.col("cost_saving") * F.col("trip_count"))))


def misroute_impact(recs: DataFrame) -> DataFrame:
    """Network-wide impact of correcting misrouted corridor strata (one aggregate)."""
    m = with_misroute(recs)
    mis = F.col("is_misrouted")
    return m.agg(
        F.count(F.lit(1)).alias("evaluated"), F.count_if(mis).alias("misrouted"),
        F.try_divide(F.count_if(mis) * 100.0, F.count(F.lit(1))).alias("pct_misrouted"),
        F.sum(F.when(mis, F.col("trip_count"))).alias("trips_affected"),
        F.avg(F.when(mis, F.col("cost_saving"))).alias("avg_saving"),
        F.sum("weighted_saving").alias("total_weighted_saving"),
        F.count_if(mis & F.col("current_mode_is_ftl")).alias("ftl_to_carting"),
        F.sum(F.when(mis & F.col("current_mode_is_ftl"), F.col("trip_count"))).alias("ftl_to_carting_trips"),
        F.count_if(mis & ~F.col("current_mode_is_ftl")).alias("carting_to_ftl"),
        F.sum(F.when(mis & ~F.col("current_mode_is_ftl"), F.col("trip_count"))).alias("carting_to_ftl_trips"))


def misroute_by_tier(recs: DataFrame) -> DataFrame:
    m = with_misroute(recs).filter(F.col("src_centrality_tier").isNotNull())
    return m.groupBy("src_centrality_tier").agg(
        (F.avg(F.col("is_misrouted").cast("double")) * 100).alias("misroute_pct"),
        F.sum("weighted_saving").alias("weighted_saving"))


def rec_mix_by_tod(recs: DataFrame) -> DataFrame:
    """Share (%) of each recommendation per time of day."""
    return (recs.groupBy("time_of_day").agg(
        (F.count_if(F.col("recommendation") == "FTL") * 100.0 / F.count(F.lit(1))).alias("FTL"),
        (F.count_if(F.col("recommendation") == "Carting") * 100.0 / F.count(F.lit(1))).alias("Carting")))


def recommendation_summary(recs: DataFrame) -> DataFrame:
    return recs.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("recommendation") == "FTL").alias("ftl"),
        F.count_if(F.col("recommendation") == "Carting").alias("carting"),
        F.try_divide(F.count_if(F.col("recommendation") == "FTL") * 100.0, F.count(F.lit(1))).alias("ftl_pct"),
        F.count_if(F.col("override_applied")).alias("overrides"),
        F.count_if(F.col("confidence") == "HIGH").alias("high_conf"),
        F.count_if(F.col("confidence") == "MEDIUM").alias("medium_conf"),
        F.count_if(F.col("confidence") == "LOW").alias("low_conf"),
        F.count_if(F.col("is_chronic")).alias("chronic"))


def tier_route_delay(dec: DataFrame) -> DataFrame:
    return (dec.filter(F.col("src_centrality_tier").isNotNull()).groupBy("src_centrality_tier", "route_type")
            .agg(F.avg("mean_delay_ratio").alias("mean_delay_ratio")))


def tier_peak_cost(dec: DataFrame) -> DataFrame:
    return (dec.filter(F.col("src_centrality_tier").isNotNull()).groupBy("src_centrality_tier", "is_peak_tod")
            .agg(F.avg("cost_diff_ftl_minus_carting").alias("mean_cost_diff")))


def scenario_evidence(dec: DataFrame) -> DataFrame:
    """Three tagged subsets at High/Critical hubs, one grouped aggregate."""
    hi = F.col("src_centrality_tier").isin("High", "Critical")
    rt, peak = F.col("route_type"), F.col("is_peak_tod")
    tag = (F.when(hi & (rt == "FTL") & peak, "FTL | High/Critical Hub | Peak ToD")
           .when(hi & (rt == "FTL") & ~peak, "FTL | High/Critical Hub | Off-Peak ToD")
           .when(hi & (rt == "Carting") & peak, "Carting | High/Critical Hub | Peak ToD"))
    return (dec.withColumn("scenario", tag).filter(F.col("scenario").isNotNull()).groupBy("scenario").agg(
        F.count(F.lit(1)).alias("corridors"), F.avg("excess_delay_min").alias("avg_excess_delay_min"),
        F.avg("mean_delay_ratio").alias("avg_delay_ratio"), F.avg("cost_ftl").alias("avg_cost_ftl"),
        F.avg("cost_carting").alias("avg_cost_carting"),
        (F.avg((F.col("cost_diff_ftl_minus_carting") > 0).cast("double")) * 100).alias("pct_carting_cheaper")))


def switch_savings(dec: DataFrame, c: dict = COST_DEFAULTS) -> DataFrame:
    """Short FTL strata where the cost model prefers Carting: savings per tier (every tier listed)."""
    be = (c["ftl_base"] - c["carting_base"]) / (c["carting_per_km"] - c["ftl_per_km"])
    sw = dec.filter((F.col("median_dist_km") < be) & (F.col("route_type") == "FTL")
                    & (F.col("raw_recommendation") == "Carting"))
    per = sw.groupBy("src_centrality_tier").agg(
        F.avg("cost_diff_ftl_minus_carting").alias("mean_saving"),
        F.sum("cost_diff_ftl_minus_carting").alias("total_saving"), F.count(F.lit(1)).alias("corridors"))
    tiers = dec.sparkSession.createDataFrame([(t,) for t in TIER_LABELS], "src_centrality_tier string")
    return tiers.join(per, "src_centrality_tier", "left").na.fill(0, ["corridors"])


def scenario_sweep(corridors: DataFrame, delays=(0.0, 90.0), c: dict = COST_DEFAULTS) -> DataFrame:
    """Both mode costs, the winner and the delay-dependent break-even for each corridor
    under each delay scenario (rows are generated per corridor, no cross join)."""
    ftl, cart = mode_costs(F.col("median_dist_km"), F.col("delay_min"), c)
    return (corridors.withColumn("delay_min", F.explode(F.array(*[F.lit(float(d)) for d in delays])))
            .withColumn("cost_ftl", ftl).withColumn("cost_carting", cart)
            .withColumn("cheaper", F.when(F.col("cost_ftl") > F.col("cost_carting"), "Carting").otherwise("FTL"))
            .withColumn("breakeven_km", breakeven_km(F.col("delay_min"), c)))


def decision_profile(dec: DataFrame) -> DataFrame:
    """Counts by route type, by time of day and by raw recommendation (long form)."""
    parts = [dec.groupBy(F.lit(dim).alias("dimension"), F.col(col).cast("string").alias("value"))
             .agg(F.count(F.lit(1)).alias("rows")) for dim, col in
             [("route_type", "route_type"), ("time_of_day", "time_of_day"),
              ("raw_recommendation", "raw_recommendation"), ("is_chronic", "is_chronic")]]
    return reduce(lambda a, b: a.unionByName(b), parts)
