"""Schemas, vocabularies and fixed constants.

Values in the FIXED VALUES blocks must equal the studied analysis for results
to match; they are stated plainly and in their natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Trip-segment log: one row per segment of a multi-leg journey.
# ---------------------------------------------------------------------------
# FIXED VALUES — column names of the trip table, in natural order
TRIP_SCHEMA = T.StructType([
    T.StructField("data", T.StringType()),
    T.StructField("trip_creation_time", T.TimestampNTZType()),
    T.StructField("route_schedule_uuid", T.StringType()),
    T.StructField("route_type", T.StringType()),
    T.StructField("trip_uuid", T.StringType()),
    T.StructField("source_center", T.StringType()),
    T.StructField("source_name", T.StringType()),
    T.StructField("destination_center", T.StringType()),
    T.StructField("destination_name", T.StringType()),
    T.StructField("od_start_time", T.TimestampNTZType()),
    T.StructField("od_end_time", T.TimestampNTZType()),
    T.StructField("start_scan_to_end_scan", T.DoubleType()),
    T.StructField("is_cutoff", T.BooleanType()),
    T.StructField("cutoff_factor", T.IntegerType()),
    T.StructField("cutoff_timestamp", T.TimestampNTZType()),
    T.StructField("actual_distance_to_destination", T.DoubleType()),
    T.StructField("actual_time", T.DoubleType()),
    T.StructField("osrm_time", T.DoubleType()),
    T.StructField("osrm_distance", T.DoubleType()),
    T.StructField("factor", T.DoubleType()),
    T.StructField("segment_actual_time", T.DoubleType()),
    T.StructField("segment_osrm_time", T.DoubleType()),
    T.StructField("segment_osrm_distance", T.DoubleType()),
    T.StructField("segment_factor", T.DoubleType()),
])

# FIXED VALUES — column names of the trip table, in natural order
TIMESTAMP_COLUMNS = ["trip_creation_time", "od_start_time", "od_end_time", "cutoff_timestamp"]
NUMERIC_COLUMNS = [f.name for f in TRIP_SCHEMA.fields if isinstance(f.dataType, T.DoubleType)]

# ---------------------------------------------------------------------------
# FIXED VALUES — vocabularies
# ---------------------------------------------------------------------------
# Time-of-day bins, left-closed: [0,6) [6,10) [10,16) [16,20) [20,24)
TOD_EDGES = [0, 6, 10, 16, 20, 24]
TOD_LABELS = ["Night_0_6", "Morning_6_10", "Afternoon_10_16", "Evening_16_20", "Night_20_24"]

# Centrality tiers, right-closed: (-0.001,0.01] (0.01,0.05] (0.05,0.15] (0.15,1.0]
TIER_EDGES = [-0.001, 0.01, 0.05, 0.15, 1.0]
TIER_LABELS = ["Peripheral", "Moderate", "High", "Critical"]

ROUTE_TYPES = ["FTL", "Carting"]

# Rename map raw vocabulary -> model vocabulary (applied to columns present).
MODEL_RENAME = {
    "actual_time": "actual_eta",
    "osrm_time": "osrm_predicted_eta",
    "osrm_distance": "osrm_distance_km",
    "actual_distance_to_destination": "distance_km",
    "source_center": "source_hub_id",
    "destination_center": "dest_hub_id",
    "route_type": "route_type",
    "trip_creation_time": "trip_creation_time",
    "trip_uuid": "trip_id",
    "factor": "delay_factor",
    "is_cutoff": "is_cutoff",
    "start_scan_to_end_scan": "start_scan_to_end_scan",
}

# ---------------------------------------------------------------------------
# FIXED VALUES — cleaning thresholds
# ---------------------------------------------------------------------------
MIN_TIME_MIN = 1.0
MIN_DIST_KM = 0.1
LOWER_FACTOR = 0.2
UPPER_FACTOR = 10.0
CRITICAL_COLUMNS = ["source_center", "destination_center", "actual_time", "osrm_time"]
ROUTING_COLUMNS = ["source_center", "destination_center", "source_name", "destination_name"]

# ---------------------------------------------------------------------------
# FIXED VALUES — network audit
# ---------------------------------------------------------------------------
SLA_THRESHOLD = 1.20
WINSOR_Q = 0.99
BETWEENNESS_PIVOTS = 300
LOW_SUPPORT_TRIPS = 5

# ---------------------------------------------------------------------------
# FIXED VALUES — cost-efficiency index (mode scoring)
# ---------------------------------------------------------------------------
CEI_DEFAULTS = {
    "fixed_ftl": 500.0,
    "var_ftl_per_km": 5.0,
    "fixed_carting": 100.0,
    "var_carting_per_km": 20.0,
    "long_distance_threshold_km": 27.6,
    "bc_high_threshold": 0.002616,
    "bc_critical_threshold": 0.004828,
    "sla_delay_threshold": 1.20,
    "peak_hours": (8, 9, 10, 11, 18, 19, 20, 21),
    "carting_peak_multiplier": 1.35,
    "ftl_peak_multiplier": 1.10,
    "ftl_high_bc_multiplier": 1.25,
    "ftl_critical_bc_multiplier": 1.50,
    "ftl_sla_multiplier": 1.20,
}

# ---------------------------------------------------------------------------
# FIXED VALUES — rupee cost model of the corridor decision table
# ---------------------------------------------------------------------------
COST_DEFAULTS = {
    "ftl_per_km": 18.0,
    "ftl_base": 2500.0,
    "carting_base": 300.0,
    "carting_per_km": 35.0,
    "carting_delay_penalty": 12.0,
    "ftl_delay_penalty": 6.0,
    "distance_ftl_threshold_km": 300.0,
    "centrality_high_threshold": 0.05,
    "assumed_speed_kmph": 60.0,
}
# Peak flag per time-of-day label (intended behaviour: Night_0_6 is the peak).
TOD_IS_PEAK = {
    "Night_0_6": True,
    "Morning_6_10": False,
    "Afternoon_10_16": False,
    "Evening_16_20": False,
    "Night_20_24": False,
}
