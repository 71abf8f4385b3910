"""Hub (vertex) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubflow.operators.corridors import HOT_GROUP_ROWS, not_null_keys, with_quantiles
from hubflow.operators.ordering import global_position

HUB_FILL = ["outbound_trips", "inbound_trips", "avg_congestion_factor", "cutoff_rate",
            "unique_destinations", "unique_sources", "ftl_ratio", "p75_delay_ratio",
            "std_delay_ratio", "weekend_congestion_delta", "avg_dwell_time_min", "log_dwell_time"]


def hub_features(train: DataFrame, hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """13 hub features from training trips.

    Outbound counts, rates and the FTL share are one partial aggregate;
    exact medians / P75 and the weekend-vs-weekday median delta are one second
    pass through ``with_quantiles`` (a hub holding a third of all trips is sorted
    across many tasks, never hashed into one); all are one row per hub and
    join on the hub id.  Inbound is a second aggregate; a full outer join
    merges both
    (hubs seen only as source or only as destination survive).  ``ftl_count``
    stays NULL for destination-only hubs.
    """
    src = not_null_keys(train, ["source_center"]).withColumnRenamed("source_center", "hub_id").withColumns({
        "__weekend": F.when(F.col("is_weekend"), F.col("delay_ratio")),
        "__weekday": F.when(~F.col("is_weekend"), F.col("delay_ratio"))})
    # pass one: counts and sizes; pass two: every quantile, hot hubs on the sort-based path
    ob = with_quantiles(src, ["hub_id"], [
        F.count("trip_uuid").alias("outbound_trips"),
        F.stddev_samp("delay_ratio").alias("std_delay_ratio"),
        F.avg(F.col("is_cutoff").cast("double")).alias("cutoff_rate"),
        F.countDistinct("destination_center").alias("unique_destinations"),
        F.count_if(F.col("route_type") == "FTL").cast("double").alias("ftl_count")],
        [("avg_congestion_factor", "delay_ratio", 0.5), ("p75_delay_ratio", "delay_ratio", 0.75),
         ("avg_dwell_time_min", "start_scan_to_end_scan", 0.5), ("log_dwell_time", "log_dwell_time", 0.5),
         ("__we", "__weekend", 0.5), ("__wd", "__weekday", 0.5)], hot_rows)
    ob = (ob.withColumn("weekend_congestion_delta", F.col("__we") - F.col("__wd")).drop("__we", "__wd")
          .withColumn("ftl_ratio", F.try_divide(F.col("ftl_count"), F.col("outbound_trips"))))
    ib = not_null_keys(train, ["destination_center"]).groupBy(
        F.col("destination_center").alias("hub_id")).agg(
        F.count("trip_uuid").alias("inbound_trips"),
        F.countDistinct("source_center").alias("unique_sources"))
    out = ob.join(ib, "hub_id", "full")
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(out.schema[c].dataType))
                           for c in HUB_FILL})
    return out.select("hub_id", "outbound_trips", "avg_congestion_factor", "p75_delay_ratio",
                      "std_delay_ratio", "cutoff_rate", "avg_dwell_time_min", "log_dwell_time",
                      "unique_destinations", "ftl_count", "ftl_ratio", "weekend_congestion_delta",
                      "inbound_trips", "unique_sources")


def hub_congestion(clean: DataFrame, min_trips: int = 20, top: int = 10) -> DataFrame:
    """Source hubs ranked by median factor (support ≥ min_trips)."""
    return (with_quantiles(not_null_keys(clean, ["source_center"]), ["source_center"],
                           [F.count(F.lit(1)).alias("trips"), F.avg("factor").alias("mean_factor")],
                           [("median_factor", "factor", 0.5)])
        .filter(F.col("trips") >= min_trips)
        .orderBy(F.desc("median_factor"), "source_center").limit(top))


def hub_inventory(df: DataFrame, src="source_center", dst="destination_center") -> DataFrame:
    """Distinct hub ids over both ends (UNION DISTINCT)."""
    return (df.select(F.col(src).alias("hub_id")).union(df.select(F.col(dst).alias("hub_id")))
            .filter(F.col("hub_id").isNotNull()).distinct())


def hub_index(hubs: DataFrame) -> DataFrame:
    """Sorted hubs -> 0..N-1 via range-partitioned global position."""
    return global_position(hubs.select("hub_id"), ["hub_id"], "hub_index")


def hub_labels(df: DataFrame, order_col: str = "row_ord") -> DataFrame:
    """hub id -> first-seen name, source side before destination side."""
    sides = (df.select(F.col("source_center").alias("hub_id"), F.col("source_name").alias("name"),
                       F.lit(0).alias("side"), F.col(order_col).alias("o"))
             .unionByName(df.select(F.col("destination_center").alias("hub_id"),
                                    F.col("destination_name").alias("name"),
                                    F.lit(1).alias("side"), F.col(order_col).alias("o"))))
    # the least order of each name first (few rows a hub; no text in the buffer, so nothing is sorted), then the least of the names
    no_order = F.max(F.col("o").isNull()).alias("__none")
    names = not_null_keys(sides, ["hub_id"]).groupBy("hub_id", "side", "name").agg(F.min("o").alias("__o"), no_order)
    first = F.struct("side", F.when(~F.col("__none"), F.col("__o")), "name")  # a row without an order comes first
    return names.groupBy("hub_id").agg(F.min_by("name", first).alias("label"))


def degree_hist(clean: DataFrame, edges: DataFrame) -> DataFrame:
    """Histogram of hub degrees: distinct destinations, and multigraph out-degree."""
    d = (not_null_keys(clean, ["source_center"]).groupBy("source_center")
         .agg(F.countDistinct("destination_center").alias("k"))
         .groupBy(F.lit("distinct_destinations").alias("measure"), F.col("k").alias("degree"))
         .agg(F.count(F.lit(1)).alias("hubs")))
    m = (edges.groupBy("source_center").agg(F.count(F.lit(1)).alias("k"))
         .groupBy(F.lit("multigraph_out_degree").alias("measure"), F.col("k").alias("degree"))
         .agg(F.count(F.lit(1)).alias("hubs")))
    return d.unionByName(m)
