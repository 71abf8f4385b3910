"""Column-expression features: time, buckets, ratios, encoders, tiers.

All are built-in expressions (whole-stage codegen, no Python workers).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubflow.schema import TIER_EDGES, TIER_LABELS, TOD_EDGES, TOD_IS_PEAK, TOD_LABELS

__all__ = ["add_temporal", "tod_label", "tod_code", "add_time_of_day", "add_ratios",
           "route_code_model", "route_code_graph", "centrality_tier", "is_peak_tod",
           "row_id", "signed_pct_error", "add_features", "clean_features", "model_preprocess"]


def add_temporal(df: DataFrame, ts: str = "trip_creation_time", month: bool = True) -> DataFrame:
    """hour_of_day, day_of_week (Monday=0), is_weekend (Sat/Sun), month."""
    cols = {
        "hour_of_day": F.hour(ts).cast("int"),
        "day_of_week": F.weekday(ts).cast("int"),
    }
    df = df.withColumns(cols).withColumn("is_weekend", F.col("day_of_week").isin(5, 6))
    if month:
        df = df.withColumn("month", F.month(ts).cast("int"))
    return df


def _bin_of_hour(h: int) -> int:
    return max(i for i, edge in enumerate(TOD_EDGES[:-1]) if h >= edge)


# per-hour lookup derived from the left-closed bin edges (hour h -> bin index)
_HOUR_TO_BIN = [_bin_of_hour(h) for h in range(24)]


def tod_label(hour: Column) -> Column:
    """Left-closed time-of-day bins [0,6) [6,10) [10,16) [16,20) [20,24).

    A 24-entry array lookup: the hour expression is evaluated once (a CASE
    chain would re-evaluate it in every branch).
    """
    labels = F.array(*[F.lit(TOD_LABELS[b]) for b in _HOUR_TO_BIN])
    return F.try_element_at(labels, (hour + 1).cast("int"))


def tod_code(label: Column) -> Column:
    """Label -> 0..4 (NULL for anything else)."""
    pos = F.array_position(F.array(*[F.lit(x) for x in TOD_LABELS]), label)
    return F.when(pos > 0, (pos - 1).cast("int"))


def add_time_of_day(df: DataFrame, hour: str = "hour_of_day", code: bool = False) -> DataFrame:
    df = df.withColumn("time_of_day", tod_label(F.col(hour)))
    if code:
        df = df.withColumn("time_of_day_code", tod_code(F.col("time_of_day")))
    return df


def add_ratios(df: DataFrame) -> DataFrame:
    """delay_ratio, segment_delay_ratio (NULL if osrm <= 0), speed_kmph, log_dwell_time."""
    return df.withColumns({
        "delay_ratio": F.try_divide(F.col("actual_time"), F.col("osrm_time")),
        "segment_delay_ratio": F.when(F.col("segment_osrm_time") > 0,
                                      F.col("segment_actual_time") / F.col("segment_osrm_time")),
        "speed_kmph": F.try_divide(F.col("osrm_distance"), F.col("osrm_time") / 60.0),
        "log_dwell_time": F.log1p(F.greatest(F.col("start_scan_to_end_scan"), F.lit(0.0))),
    })


def add_features(df: DataFrame) -> DataFrame:
    """Temporal + time-of-day + ratio features of the graph-construction stage."""
    return add_ratios(add_time_of_day(add_temporal(df)))


def clean_features(trips: DataFrame) -> DataFrame:
    """Cleaned trips with all derived features."""
    from hubflow.functions.cleaning import clean_trips
    return add_features(clean_trips(trips))


def route_code_model(route: Column) -> Column:
    """FTL=0, Carting=1, anything else -1 (boosted-tree encoder)."""
    return F.when(route == "FTL", 0).when(route == "Carting", 1).otherwise(-1).cast("int")


def route_code_graph(route: Column) -> Column:
    """FTL=1 else 0 (neighbour-model encoder)."""
    return F.when(route == "FTL", 1).otherwise(0).cast("int")


def centrality_tier(bc: Column) -> Column:
    """Right-closed tiers (-0.001,0.01] (0.01,0.05] (0.05,0.15] (0.15,1.0]; NULL BC counts as 0."""
    v = F.coalesce(bc, F.lit(0.0))
    expr = F.lit(None).cast("string")
    for lo, hi, label in reversed(list(zip(TIER_EDGES[:-1], TIER_EDGES[1:], TIER_LABELS))):
        expr = F.when((v > lo) & (v <= hi), F.lit(label)).otherwise(expr)
    return expr


def is_peak_tod(label: Column, mapping=TOD_IS_PEAK) -> Column:
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[label], F.lit(False))


def row_id(trip_id: Column, order: Column) -> Column:
    """Fallback id when the trip id is missing."""
    return F.coalesce(trip_id, order.cast("string"))


def signed_pct_error(actual: Column, estimate: Column, lo=-50.0, hi=200.0) -> Column:
    """(actual - estimate) / estimate * 100 clipped to [lo, hi]."""
    e = F.try_divide(actual - estimate, estimate) * 100.0
    return F.greatest(F.least(e, F.lit(hi)), F.lit(lo))


def model_preprocess(df: DataFrame, order: str = "row_ord") -> DataFrame:
    """Model-stage preprocess: null drop (ids, target, estimate, timestamp), five-rule mask,
    temporal ints, route code (FTL 0 / Carting 1 / other -1), int cutoff flag,
    fallback trip id, model vocabulary."""
    from hubflow.functions.cleaning import model_clean
    from hubflow.sources.trips import rename_to_model
    t = add_temporal(model_clean(df), month=False)
    t = t.withColumns({
        "is_weekend": F.col("is_weekend").cast("int"),
        "route_type": route_code_model(F.col("route_type")),
        "is_cutoff": F.col("is_cutoff").cast("int"),
        "trip_uuid": row_id(F.col("trip_uuid"), F.col(order)),
    })
    return rename_to_model(t)
