"""Network audit: segment-level cleaning, corridor digraph, hub metrics,
chronic corridors and facility risk ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubflow.functions.cleaning import dedup_first, drop_critical_nulls, positive_times
from hubflow.operators import graph as G
from hubflow.operators.corridors import corridor_edges
from hubflow.operators.hubs import hub_labels
from hubflow.operators.selection import exact_quantile
from hubflow.session import write_table
from hubflow.schema import ROUTING_COLUMNS, SLA_THRESHOLD, WINSOR_Q
from hubflow.sources.trips import coerce_numeric


def winsorise(df: DataFrame, col: str, q: float = WINSOR_Q, by: str | None = None,
              out: str | None = None) -> DataFrame:
    """Cap ``col`` at its q-quantile (global by default, or per ``by`` group; NULL is a group of its own).

    The global cap is exact and found by refining counts: nothing is sorted or written.
    Rows without a value, and groups without one, keep NULL. Every row stays.
    """
    out = out or col
    if by is None:
        j = df.withColumn("__cap", F.lit(exact_quantile(df, col, q)).cast("double"))
    else:
        from hubflow.operators.corridors import skew_safe_quantiles
        # one row per group, written: its size is known before the trips are joined, which stay where they are if it is small
        cap, _ = write_table(skew_safe_quantiles(df, [by], [("__cap", col, q)]).withColumnRenamed(by, "__by"), "caps")
        j = df.join(cap, F.col(by).eqNullSafe(F.col("__by")), "left").drop("__by")
    return j.withColumn("__capped", F.col(col) > F.col("__cap")).withColumn(
        out, F.when(F.col(col).isNotNull(), F.least(F.col(col), F.col("__cap")))).drop("__cap")


def winsor_report(capped: DataFrame, col: str) -> DataFrame:
    return capped.agg(F.count_if(F.col("__capped")).alias("rows_capped"), F.max(col).alias("cap"))


def audit_clean(trips: DataFrame, order_col: str = "row_ord") -> DataFrame:
    """Routing keys and names present, numeric coercion, positive segment times,
    first row per (trip, src, dst), ratio capped at the global P99."""
    t = drop_critical_nulls(trips, ROUTING_COLUMNS)
    t = coerce_numeric(t, ["segment_actual_time", "segment_osrm_time", "segment_osrm_distance"])
    t = positive_times(t.na.drop(subset=["segment_actual_time", "segment_osrm_time"]))
    t, _ = write_table(dedup_first(t, ["trip_uuid", "source_center", "destination_center"], order_col), "segments")  # read for the cap and by the caller
    t = t.withColumn("computed_delay_ratio", F.col("segment_actual_time") / F.col("segment_osrm_time"))
    return winsorise(t, "computed_delay_ratio", WINSOR_Q)


def corridor_graph(audited: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices with label, simple-digraph edges) of the audit graph."""
    return hub_table(audited), corridor_table(audited)


def hub_table(audited: DataFrame) -> DataFrame:
    return hub_labels(audited).withColumnRenamed("hub_id", "v")


def corridor_table(audited: DataFrame) -> DataFrame:
    return corridor_edges(audited).withColumnRenamed("source_center", "src").withColumnRenamed("destination_center", "dst")


def node_metrics(vertices: DataFrame, edges: DataFrame, k: int | None = None, seed: int = 42) -> DataFrame:
    """Betweenness, degrees, degree centralities, asymmetry, weighted strengths, label."""
    v = vertices.select("v")
    bc = G.betweenness(edges, v, k=k, seed=seed)
    return (vertices.join(bc, "v").join(G.degrees(edges, v), "v").join(G.strengths(edges, v), "v")
            .select(F.col("v").alias("facility_id"), "label", "betweenness_centrality", "in_degree",
                    "out_degree", "in_degree_centrality", "out_degree_centrality", "degree_asymmetry",
                    "weighted_in_strength", "weighted_out_strength"))


def chronic_corridors(edges: DataFrame, labels: DataFrame, sla: float = SLA_THRESHOLD) -> DataFrame:
    """Corridors with median ratio > sla, excess %, severity = (w - 1) · trips."""
    lab_s = labels.select(F.col("v").alias("src"), F.col("label").alias("source_label"))
    lab_d = labels.select(F.col("v").alias("dst"), F.col("label").alias("destination_label"))
    return (edges.filter(F.col("weight") > sla).join(lab_s, "src", "left").join(lab_d, "dst", "left")
            .select(F.col("src").alias("source_id"), F.col("dst").alias("destination_id"),
                    "source_label", "destination_label", F.col("weight").alias("median_delay_ratio"),
                    ((F.col("weight") - 1.0) * 100).alias("excess_delay_pct"), "trip_count",
                    F.col("median_actual_time").alias("median_actual_min"),
                    F.col("median_osrm_time").alias("median_osrm_min"), "median_distance_km",
                    ((F.col("weight") - 1.0) * F.col("trip_count")).alias("breach_severity_score")))


def facility_rollup(chronic: DataFrame) -> DataFrame:
    """Both endpoints of every chronic corridor, summed per facility."""
    cols = ["breach_severity_score", "median_delay_ratio"]
    both = (chronic.select(F.col("source_id").alias("facility_id"), F.col("source_label").alias("facility_label"), *cols)
            .unionByName(chronic.select(F.col("destination_id").alias("facility_id"),
                                        F.col("destination_label").alias("facility_label"), *cols)))
    return both.groupBy("facility_id", "facility_label").agg(
        F.sum("breach_severity_score").alias("total_severity_score"),
        F.count("breach_severity_score").alias("chronic_corridor_count"),
        F.avg("median_delay_ratio").alias("mean_delay_ratio"),
        F.max("median_delay_ratio").alias("max_delay_ratio"))


def minmax(df: DataFrame, col: str, out: str) -> DataFrame:
    """(x - min) / (max - min), 0 when the range is 0; min/max are one broadcast row."""
    r = df.agg(F.min(col).alias("__mn"), F.max(col).alias("__mx"))
    rng = F.col("__mx") - F.col("__mn")
    return (df.crossJoin(F.broadcast(r))
            .withColumn(out, F.when(rng > 0, (F.col(col) - F.col("__mn")) / rng).otherwise(F.col(col) * 0.0))
            .drop("__mn", "__mx"))


def rank_facilities(chronic: DataFrame, metrics: DataFrame, top_n: int | None = 10) -> DataFrame:
    """Composite risk = norm(severity) · norm(betweenness), 1-based rank, top n."""
    agg = facility_rollup(chronic).join(
        metrics.select("facility_id", "betweenness_centrality", "in_degree", "out_degree", "degree_asymmetry"),
        "facility_id", "left")
    agg = minmax(minmax(agg, "total_severity_score", "norm_severity"), "betweenness_centrality", "norm_bc")
    agg = agg.withColumn("composite_risk", F.col("norm_severity") * F.col("norm_bc"))
    ordered = agg.orderBy(F.desc("composite_risk"), F.desc("total_severity_score"), "facility_id")
    if top_n is not None:
        ordered = ordered.limit(top_n)
        # rank over at most top_n rows: the window is bounded by the limit
        from pyspark.sql import Window
        w = Window.orderBy(F.desc("composite_risk"), F.desc("total_severity_score"), "facility_id")
        return ordered.withColumn("rank", F.row_number().over(w))
    return ordered


def calibrate_thresholds(metrics: DataFrame, chronic: DataFrame, fixed_ftl=500.0, var_ftl=5.0,
                         fixed_carting=100.0, var_carting=20.0) -> DataFrame:
    """P90/P95 betweenness, P75 chronic distance, CEI break-even km and its drift."""
    bc = metrics.agg(F.percentile("betweenness_centrality", 0.90).alias("bc_p90"),
                     F.percentile("betweenness_centrality", 0.95).alias("bc_p95"),
                     F.max("betweenness_centrality").alias("bc_max"),
                     F.count(F.lit(1)).alias("hubs"))
    dist = chronic.agg(F.percentile("median_distance_km", 0.75).alias("chronic_p75_km"))
    be = (fixed_ftl - fixed_carting) / (var_carting - var_ftl)
    return (bc.crossJoin(dist).withColumn("breakeven_km", F.lit(be))
            .withColumn("breakeven_drift_km", F.lit(be) - F.col("chronic_p75_km")))


def exec_summary(audited: DataFrame, edges: DataFrame, metrics: DataFrame, chronic: DataFrame,
                 ranked: DataFrame) -> DataFrame:
    """One row: scale, chronic share, top hub, worst corridor, top offender."""
    scale = audited.agg(F.count(F.lit(1)).alias("segments"))
    e = edges.agg(F.count(F.lit(1)).alias("corridors"))
    c = chronic.agg(F.count(F.lit(1)).alias("chronic_corridors"),
                    F.max_by(F.struct("source_id", "destination_id"), F.struct("breach_severity_score", "source_id", "destination_id"))
                    .alias("worst"))
    h = metrics.agg(F.count(F.lit(1)).alias("hubs"),
                    F.max_by("facility_id", F.struct("betweenness_centrality", "facility_id")).alias("top_hub"),
                    F.max("betweenness_centrality").alias("top_hub_bc"))
    r = ranked.agg(F.min_by("facility_id", "rank").alias("top_offender"))
    return (scale.crossJoin(e).crossJoin(c).crossJoin(h).crossJoin(r)
            .withColumn("chronic_pct", F.try_divide(F.col("chronic_corridors") * 100.0, F.col("corridors")))
            .select("segments", "hubs", "corridors", "chronic_corridors", "chronic_pct", "top_hub", "top_hub_bc",
                    F.col("worst.source_id").alias("worst_src"), F.col("worst.destination_id").alias("worst_dst"),
                    "top_offender"))
