"""Shared plan fragments for registered queries (all start from the given tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubflow.functions.features import add_features
from hubflow.functions.cleaning import clean_trips
from hubflow.session import write_table
from hubflow.sources.trips import trips_from_tables


def trips(spark: SparkSession, sf: str) -> DataFrame:
    return trips_from_tables(spark, sf)


def features(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned trips (six-rule mask) with derived features."""
    return add_features(clean_trips(trips(spark, sf)))


def training(spark: SparkSession, sf: str) -> DataFrame:
    return features(spark, sf).filter(F.col("data") == "training")


_TRAINING_COLUMNS = ["source_center", "destination_center", "route_type", "time_of_day", "trip_uuid", "is_cutoff", "is_weekend", "delay_ratio",
                     "actual_time", "osrm_time", "actual_distance_to_destination", "start_scan_to_end_scan", "log_dwell_time"]


def training_table(spark: SparkSession, sf: str) -> DataFrame:
    """The columns of the training trips that edge and hub tables aggregate, written once (each aggregate reads them twice or more)."""
    return memo(spark, sf, "training_trips", lambda: training(spark, sf).select(*_TRAINING_COLUMNS))


def route_times(spark: SparkSession, sf: str) -> DataFrame:
    """Route type and times of the cleaned trips, written once (caps by route type read them several times)."""
    return memo(spark, sf, "route_times", lambda: features(spark, sf).select("route_type", "actual_time", "osrm_time"))


def r10(df: DataFrame, *cols: str) -> DataFrame:
    """Round interpolated / non-dyadic statistics to 10 places for exact comparison."""
    return df.withColumns({c: F.round(F.col(c), 10) for c in cols})


_MEMO: dict = {}


def memo(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """Materialise a shared intermediate table once per session and scale factor.

    The table is written to the session's reliable checkpoint folder as parquet, so
    later queries (and recomputation after an executor loss) read the columns they
    need instead of re-running its plan.
    """
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _MEMO:
        _MEMO[key], _ = write_table(build(), name)
    return _MEMO[key]


def keep(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """A plan whose boundaries were worked out once per session and scale factor; nothing is written."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _MEMO:
        _MEMO[key] = build()
    return _MEMO[key]
