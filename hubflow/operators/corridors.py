"""Corridor (edge) aggregates.

Each is a single ``groupBy().agg`` — one shuffle on the corridor keys with
map-side partial aggregation.  Exact medians/percentiles use Spark's exact
``percentile`` (linear interpolation, same as the studied analysis); pass
``approx=True`` for ``percentile_approx`` on exploratory runs.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubflow.operators.selection import group_quantiles
from hubflow.session import write_table
from hubflow.schema import LOW_SUPPORT_TRIPS, SLA_THRESHOLD

STRATA = ["source_center", "destination_center", "route_type", "time_of_day"]
CORRIDOR = ["source_center", "destination_center"]


def pct(col: str | Column, q: float, approx: bool = False) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    if approx:
        return F.percentile_approx(c, q, 10000).cast("double")
    return F.median(c) if q == 0.5 else F.percentile(c, q)


def not_null_keys(df: DataFrame, keys) -> DataFrame:
    """Group keys with NULL are dropped (NULL never forms a corridor or hub)."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))


#: Larger groups take the counting path: a task holds the values of whole smaller groups, some 100 bytes each.
HOT_GROUP_ROWS = 500_000
#: Rows of smaller groups to a task.
TASK_ROWS = 250_000


def skew_safe_quantiles(df: DataFrame, keys, specs, hot_rows: int = HOT_GROUP_ROWS,
                        approx: bool = False, sizes: DataFrame | None = None) -> DataFrame:
    """Per-group exact quantiles that never load a hot group into one task.

    ``specs`` = [(out_name, column, q)]; ``keys`` may be empty (one global
    group).  Group sizes come from a partial aggregate; groups above
    ``hot_rows`` (at most rows/hot_rows of them — the proven bound that allows
    broadcasting their keys) take the counting path
    (``selection.group_quantiles``), all other groups the hash aggregate
    ``percentile`` after their narrow rows moved once, ``TASK_ROWS`` to a task.
    """
    keys = list(keys)
    if approx:
        return df.groupBy(*keys).agg(*[pct(c, q, True).alias(o) for o, c, q in specs])

    columns = list(dict.fromkeys(c for _, c, _ in specs))
    wanted = {c: [(o, q) for o, c2, q in specs if c2 == c] for c in columns}
    narrow = df.select(*dict.fromkeys([*keys, *columns]))
    out = [*keys, *[o for o, _, _ in specs]]

    def hashed(frame, rows):
        if keys and rows > TASK_ROWS:
            tasks = max(frame.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / TASK_ROWS))
            frame = frame.repartition(tasks, *keys)
        # one value map per column, whatever the number of its quantiles
        g = frame.groupBy(*keys).agg(*[F.percentile(c, [float(q) for _, q in wanted[c]]).alias(f"__p{i}") for i, c in enumerate(columns)])
        return g.select(*keys, *[F.get(F.col(f"__p{columns.index(c)}"), j).alias(o) for c in columns for j, (o, _) in enumerate(wanted[c])])

    if sizes is None:
        sizes, _ = write_table(narrow.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")), "sizes")
    is_hot = F.col("__n") > hot_rows
    n_hot, n_cold, cold_rows = sizes.agg(F.count_if(is_hot), F.count_if(~is_hot), F.coalesce(F.sum(F.when(~is_hot, F.col("__n"))), F.lit(0))).first()
    if not n_hot:
        return hashed(narrow, cold_rows).select(*out)
    if not n_cold:
        return group_quantiles(narrow, keys, specs).select(*out)
    mark = F.broadcast(sizes.filter(is_hot).select(*[F.col(k).alias(f"__k_{k}") for k in keys]))
    cold = hashed(narrow.join(mark, null_safe(narrow, mark, keys), "left_anti"), cold_rows)
    warm = group_quantiles(narrow.join(mark, null_safe(narrow, mark, keys), "left_semi"), keys, specs)
    return cold.select(*out).unionByName(warm.select(*out))


def null_safe(left: DataFrame, right: DataFrame, keys) -> Column:
    """Join condition ``left.key <=> right.__k_key``; true without keys."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"__k_{k}"]) for k in keys], F.lit(True))


def with_quantiles(df: DataFrame, keys, aggs, specs, hot_rows: int = HOT_GROUP_ROWS,
                   approx: bool = False) -> DataFrame:
    """``groupBy(keys).agg(*aggs)`` plus exact quantile columns from
    ``skew_safe_quantiles``, joined null-safely on the keys (one row per group)."""
    keys = list(keys)
    if not aggs:
        return skew_safe_quantiles(df, keys, specs, hot_rows, approx)
    # the per-group aggregate (one row per group) is written once; its row
    # counts decide which groups are hot, so the input is not scanned again
    base, _ = write_table(df.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("__n")), "groups")
    q = skew_safe_quantiles(df, keys, specs, hot_rows, approx, sizes=base.select(*keys, "__n"))
    base = base.drop("__n")
    if not keys:
        return base.crossJoin(q)  # one row each
    qr = q.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[o for o, _, _ in specs])
    return base.join(qr, null_safe(base, qr, keys), "left").drop(*[f"__k_{k}" for k in keys])


def edge_weights(train: DataFrame, keys=STRATA, tail_q: float = 0.95,
                 min_support: int = LOW_SUPPORT_TRIPS, approx: bool = False,
                 hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """Stratified edge table: median delay ratio per (src, dst, route, time of day).

    Means, deviations, counts and rates are one partial aggregate over all
    rows; the exact medians / tail quantile come from ``skew_safe_quantiles``
    (one row per stratum), joined on the strata keys.
    """
    keys = list(keys)
    t = not_null_keys(train, keys)
    tail = f"p{int(round(tail_q * 100))}_delay_ratio"
    out = with_quantiles(t, keys, [
        F.avg("delay_ratio").alias("mean_delay_ratio"),
        F.stddev_samp("delay_ratio").alias("std_delay_ratio"),
        F.count("trip_uuid").alias("trip_count"),
        F.avg(F.col("is_cutoff").cast("double")).alias("cutoff_rate")],
        [("edge_weight", "delay_ratio", 0.5), ("median_actual_time", "actual_time", 0.5),
         ("median_osrm_time", "osrm_time", 0.5), ("median_dist_km", "actual_distance_to_destination", 0.5),
         (tail, "delay_ratio", tail_q)], hot_rows, approx).filter(F.col("edge_weight").isNotNull())
    return out.select(*keys, "edge_weight", "mean_delay_ratio", "std_delay_ratio", "trip_count",
                      "median_actual_time", "median_osrm_time", "median_dist_km", "cutoff_rate", tail) \
        .withColumn("low_support", F.col("trip_count") < min_support)


def corridor_preview(clean: DataFrame) -> DataFrame:
    """Per (src, dst, route): distinct trips, factor median/mean/std, median distance."""
    keys = ["source_center", "destination_center", "route_type"]
    return with_quantiles(
        not_null_keys(clean, keys), keys,
        [F.countDistinct("trip_uuid").alias("trips"), F.avg("factor").alias("mean_factor"),
         F.stddev_samp("factor").alias("std_factor")],
        [("median_factor", "factor", 0.5), ("median_dist_km", "actual_distance_to_destination", 0.5)])


def corridor_edges(df: DataFrame, ratio: str = "computed_delay_ratio", actual="segment_actual_time",
                   osrm="segment_osrm_time", distance="segment_osrm_distance",
                   sla: float = SLA_THRESHOLD, hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """Simple-digraph edge table (one row per src, dst) with the chronic flag."""
    t = not_null_keys(df, CORRIDOR)
    q = with_quantiles(t, CORRIDOR, [F.count("trip_uuid").alias("trip_count")],
                       [("weight", ratio, 0.5), ("median_actual_time", actual, 0.5),
                        ("median_osrm_time", osrm, 0.5), ("median_distance_km", distance, 0.5)], hot_rows)
    return (q.select(*CORRIDOR, "weight", "median_actual_time", "median_osrm_time",
                                       "median_distance_km", "trip_count")
            .withColumn("is_chronic_delay", F.col("weight") > sla))


def edge_summary(edges: DataFrame) -> DataFrame:
    """Edge-table profile: counts per route, low-support share, weight min/median/mean/max."""
    median = skew_safe_quantiles(edges, [], [("weight_median", "edge_weight", 0.5)])
    out = edges.agg(
        F.count(F.lit(1)).alias("edges"),
        F.count_if(F.col("route_type") == "FTL").alias("ftl_edges"),
        F.count_if(F.col("route_type") == "Carting").alias("carting_edges"),
        F.count_if(F.col("low_support")).alias("low_support_edges"),
        F.try_divide(F.count_if(F.col("low_support")) * 100.0, F.count(F.lit(1))).alias("low_support_pct"),
        F.min("edge_weight").alias("weight_min"),
        F.avg("edge_weight").alias("weight_mean"),
        F.max("edge_weight").alias("weight_max"),
    )
    return out.crossJoin(median).select(  # one row each
        "edges", "ftl_edges", "carting_edges", "low_support_edges", "low_support_pct", "weight_min", "weight_median",
        "weight_mean", "weight_max")


def offender_corridors(clean: DataFrame, min_trips: int = 50, breach: float = SLA_THRESHOLD,
                       top: int | None = 5) -> DataFrame:
    """Named corridors ranked by SLA-breach volume, share of all network breaches.

    The denominator counts breaches over *all* rows (unnamed ones too); it is a
    one-row aggregate joined by broadcast (size bound: exactly one row).
    """
    flagged = clean.withColumn("is_sla_breach", F.col("factor") > breach)
    total = flagged.agg(F.count_if(F.col("is_sla_breach")).alias("total_breaches"))
    per = (with_quantiles(not_null_keys(flagged, ["source_name", "destination_name"]),
                          ["source_name", "destination_name"],
                          [F.count("trip_uuid").alias("total_trips"),
                           F.count_if(F.col("is_sla_breach")).alias("breach_count")],
                          [("median_delay_ratio", "factor", 0.5)])
           .filter(F.col("total_trips") >= min_trips))
    out = (per.crossJoin(F.broadcast(total))
           .withColumn("pct_of_network_breaches",
                       F.try_divide(F.col("breach_count") * 100.0, F.col("total_breaches")))
           .drop("total_breaches"))
    if top is not None:
        out = out.orderBy(F.desc("breach_count"), "source_name", "destination_name").limit(top)
    return out


def weighted_load(edges: DataFrame, top: int | None = 15) -> DataFrame:
    """Per source hub Σ(edge_weight × trip_count), heaviest first."""
    out = (edges.groupBy("source_center")
           .agg(F.sum(F.col("edge_weight") * F.col("trip_count")).alias("weighted_load")))
    if top is not None:
        out = out.orderBy(F.desc("weighted_load"), "source_center").limit(top)
    return out


def tod_route_pivot(edges: DataFrame) -> DataFrame:
    """Median edge weight, time of day × route type (FTL, Carting columns)."""
    per = skew_safe_quantiles(edges, ["time_of_day", "route_type"], [("m", "edge_weight", 0.5)])
    return per.groupBy("time_of_day").agg(*[F.max(F.when(F.col("route_type") == r, F.col("m"))).alias(r) for r in ("FTL", "Carting")])


def tod_edge_median(edges: DataFrame) -> DataFrame:
    """Median edge weight by time of day plus the overall median on every row."""
    overall = skew_safe_quantiles(edges, [], [("overall_median_weight", "edge_weight", 0.5)])
    return (with_quantiles(edges, ["time_of_day"], [F.count(F.lit(1)).alias("edges")], [("median_weight", "edge_weight", 0.5)])
            .select("time_of_day", "median_weight", "edges").crossJoin(F.broadcast(overall)))


def hub_weekend_pivot(trips: DataFrame) -> DataFrame:
    """Median delay ratio of each source hub on weekdays and at weekends."""
    split = trips.select(F.col("source_center").alias("hub_id"),
                         F.when(~F.col("is_weekend"), F.col("delay_ratio")).alias("weekday"),
                         F.when(F.col("is_weekend"), F.col("delay_ratio")).alias("weekend"))
    return skew_safe_quantiles(split, ["hub_id"], [("weekday_factor", "weekday", 0.5), ("weekend_factor", "weekend", 0.5)])


def most_delayed(edges: DataFrame, min_trips: int = 20, top: int = 10,
                 weight: str = "edge_weight") -> DataFrame:
    """Top-k corridors by weight among those with enough support (ties by keys)."""
    keys = [c for c in STRATA if c in edges.columns]
    return (edges.filter(F.col("trip_count") >= min_trips)
            .orderBy(F.desc(weight), *keys).limit(top))
