"""Neighbourhood features: k-hop in-neighbour means, trip-edge features,
embedding joins and edge representations.

Trip edges are first reduced to (src, dst, trips) so the k-hop averages join
a corridor-sized table, never the trip table, against hub features; the mean
stays trip-weighted because every trip row is one message.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubflow.functions.features import route_code_graph, tod_code

# FIXED VALUES — feature columns, in natural order
NODE_FEAT_COLS = ["avg_congestion_factor", "cutoff_rate", "avg_dwell_time_min", "log_dwell_time",
                  "unique_destinations", "unique_sources", "outbound_trips", "ftl_ratio", "p75_delay_ratio",
                  "weekend_congestion_delta"]
# FIXED VALUES — feature columns, in natural order
EDGE_FEAT_COLS = ["osrm_time", "log_osrm_time", "log_distance", "log_dwell", "hour_of_day", "day_of_week",
                  "time_of_day_code", "route_type_enc", "is_cutoff_int"]


def hub_matrix(hubs: DataFrame, features: DataFrame, cols=NODE_FEAT_COLS) -> DataFrame:
    """All hubs ⟕ features, missing -> 0, as long rows (hub_id, dim, value)."""
    j = hubs.select("hub_id").join(features.select("hub_id", *cols), "hub_id", "left")
    arr = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols])
    return j.select("hub_id", F.posexplode(arr).alias("dim", "value"))


def trip_edges(trips: DataFrame, weighting: str = "trips") -> DataFrame:
    """(src, dst, c): one message per trip row ("trips") or per corridor ("distinct")."""
    g = trips.groupBy(F.col("source_center").alias("src"), F.col("destination_center").alias("dst"))
    return g.agg((F.count(F.lit(1)) if weighting == "trips" else F.lit(1).cast("bigint")).alias("c"))


def neighbour_mean(x_long: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """h_{k+1}(v) = [h_k(v) ‖ mean_{u→v} h_k(u)] for ``hops`` rounds (0 if no in-neighbour)."""
    h = x_long
    for _ in range(hops):
        width = h.agg(F.max("dim").alias("__w"))
        msg = (edges.join(h.withColumnRenamed("hub_id", "src"), "src")
               .groupBy(F.col("dst").alias("hub_id"), "dim")
               .agg((F.sum(F.col("c") * F.col("value")) / F.sum("c")).alias("value")))
        # every hub gets every feature dimension (generated per hub from the
        # one-row width, not a join), 0 where it has no in-neighbour
        full = (h.select("hub_id").distinct().crossJoin(F.broadcast(width))
                .select("hub_id", "__w", F.explode(F.sequence(F.lit(0), F.col("__w"))).alias("dim"))
                .join(msg, ["hub_id", "dim"], "left").na.fill(0.0, ["value"]))
        shifted = full.select("hub_id", (F.col("dim") + F.col("__w") + 1).alias("dim"), "value")
        h = h.unionByName(shifted)
    return h


def to_vectors(h_long: DataFrame, key: str = "hub_id", out: str = "vector") -> DataFrame:
    """Long (key, dim, value) -> (key, array ordered by dim); arrays are as wide as the feature count."""
    return (h_long.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("dim", "value"))).alias("__s"))
            .select(key, F.transform("__s", lambda s: s["value"]).alias(out)))


def edge_features(trips: DataFrame) -> DataFrame:
    """Nine per-trip edge features plus target."""
    return trips.withColumns({
        "log_osrm_time": F.log1p(F.greatest(F.col("osrm_time"), F.lit(0.0))),
        "log_distance": F.log1p(F.greatest(F.col("actual_distance_to_destination"), F.lit(0.0))),
        "log_dwell": F.log1p(F.greatest(F.col("start_scan_to_end_scan"), F.lit(0.0))),
        "time_of_day_code": tod_code(F.col("time_of_day")),
        "route_type_enc": route_code_graph(F.col("route_type")),
        "is_cutoff_int": F.col("is_cutoff").cast("int"),
    })


#: Trips of one corridor that meet its vectors in one task; a busier corridor is dealt to several.
HOT_PAIR_ROWS = 5_000_000


def embedding_join(trips: DataFrame, vectors: DataFrame, dim: int, key: str = "hub_id",
                   vec: str = "embedding", hot_pair_rows: int = HOT_PAIR_ROWS) -> DataFrame:
    """Source and destination vectors per trip; unknown and missing hubs get the zero vector.

    Vectors meet the corridors first (one row per different hub pair, repeated once per
    ``hot_pair_rows`` trips), and trips join that table once, so no row that is shuffled trip by
    trip has an array.  The list of busy corridors is broadcast: at most trips / ``hot_pair_rows`` rows.
    """
    src, dst = "source_center", "destination_center"
    side = lambda end, out: vectors.select(F.col(key).alias(f"__{end}"), F.col(vec).alias(out))
    pairs = (trips.groupBy(F.col(src).alias("__src"), F.col(dst).alias("__dst")).agg(F.count(F.lit(1)).alias("__c"))
             .withColumn("__parts", (F.floor(F.col("__c") / hot_pair_rows) + 1).cast("int")))
    busy = F.broadcast(pairs.where("__parts > 1").select(F.col("__src").alias("__bs"), F.col("__dst").alias("__bd"), F.col("__parts").alias("__bp")))
    table = (pairs.join(side("src", "__s"), "__src", "left").join(side("dst", "__d"), "__dst", "left")
             .select("__src", "__dst", "__s", "__d", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__salt")))
    # equal rows of a busy corridor share a part; the part follows from the row, so a task run again gives the same
    part = F.coalesce(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in trips.columns]), F.col("__bp")).cast("int"), F.lit(0))
    dealt = trips.join(busy, F.col(src).eqNullSafe(F.col("__bs")) & F.col(dst).eqNullSafe(F.col("__bd")), "left").withColumn("__part", part)
    zero = F.array_repeat(F.lit(0.0), dim)
    return (dealt.join(table, F.col(src).eqNullSafe(F.col("__src")) & F.col(dst).eqNullSafe(F.col("__dst")) & (F.col("__part") == F.col("__salt")))
            .withColumns({"src_known": F.col("__s").isNotNull(), "dst_known": F.col("__d").isNotNull(),
                          "src_emb": F.coalesce("__s", zero), "dst_emb": F.coalesce("__d", zero)})
            .select(*trips.columns, "src_known", "dst_known", "src_emb", "dst_emb"))


def embedding_coverage(joined: DataFrame, warn_below_pct: float = 90.0) -> DataFrame:
    return (joined.agg(F.count(F.lit(1)).alias("rows"),
                       (F.avg(F.col("src_known").cast("double")) * 100).alias("src_coverage_pct"),
                       (F.avg(F.col("dst_known").cast("double")) * 100).alias("dst_coverage_pct"))
            .withColumn("warning", (F.col("src_coverage_pct") < warn_below_pct)
                        | (F.col("dst_coverage_pct") < warn_below_pct)))


def edge_representation(trips: DataFrame, hub_vectors: DataFrame, edge_cols=EDGE_FEAT_COLS,
                        vec: str = "vector") -> DataFrame:
    """[src vector ‖ dst vector ‖ edge features] per trip."""
    s = hub_vectors.select(F.col("hub_id").alias("source_center"), F.col(vec).alias("__s"))
    d = hub_vectors.select(F.col("hub_id").alias("destination_center"), F.col(vec).alias("__d"))
    feats = F.array(*[F.col(c).cast("double") for c in edge_cols])
    return (trips.join(s, "source_center").join(d, "destination_center")
            .withColumn("representation", F.concat(F.col("__s"), F.col("__d"), feats)).drop("__s", "__d"))
