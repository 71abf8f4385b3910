"""Physical-plan checks: pushdown/pruning, no Python workers in hot paths,
skew-safe de-duplication."""

from hubflow.functions.cleaning import dedup_first
from hubflow.operators import decisions as D
from hubflow.plans.registry import QUERIES, load_all

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parquet_scan_prunes_columns(spark):
    load_all()
    plan = _plan(QUERIES["edge_weights"](spark, SF))
    assert "ReadSchema" in plan
    # lineitem has 11 columns; the view reads only those it needs
    scan = [l for l in plan.splitlines() if "lineitem" in l and "ReadSchema" in l]
    assert scan and "l_discount" not in scan[0] and "l_shipdate" not in scan[0]


def test_training_trips_read_three_columns_of_orders(spark):
    from hubflow.plans.common import training
    scan = [l for l in _plan(training(spark, SF).select("delay_ratio")).splitlines() if "orders.parquet" in l]
    assert scan and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz>" in scan[0]


def test_hub_features_read_the_trips_at_most_three_times(spark):
    from hubflow.operators.hubs import hub_features
    from hubflow.plans.common import training
    plan = _plan(hub_features(training(spark, SF)))
    assert plan.count("lineitem.parquet") <= 2  # the first pass is written before the plan starts
    assert plan.count(" percentile(delay_ratio") <= 2  # one value map, partial and final


def test_decision_rules_have_no_python_udf(spark):
    df = spark.createDataFrame([(30.5, 2.81, 0.249, True)], "median_dist_km double, mean_delay_ratio double, "
                               "src_betweenness_centrality double, is_peak_tod boolean")
    plan = _plan(D.recommend_transport_mode(df)) + _plan(D.recommend_route_type(
        spark.createDataFrame([(1.0, 1, 0.1, 1.0)], "distance_km double, hour_of_day int, destination_bc double, "
                              "historical_delay_ratio double")))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_dedup_is_partial_aggregate_not_window(spark):
    df = spark.createDataFrame([("t", "a", "b", 1)], "trip_uuid string, source_center string, "
                               "destination_center string, row_ord int")
    plan = _plan(dedup_first(df, ["trip_uuid", "source_center", "destination_center"]))
    assert "Window" not in plan and "partial_min_by" in plan.replace(" ", "")


def test_trip_view_moves_the_line_items_once(spark):
    """Customers join the orders, nations the customers and suppliers: the line items meet two tables, and methods stay small enough to be compiled."""
    from hubflow.sources.trips import trips_from_tables
    was = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    try:
        df = trips_from_tables(spark, SF)
        assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
    finally:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", was)
    above = 0
    for l in df._jdf.queryExecution().optimizedPlan().toString().splitlines():
        if "l_orderkey" in l and "Relation" in l:
            break
        above += "Join Inner" in l
    assert above == 2


def test_model_rows_are_written_once(spark):
    """Split, encoders and medians read the written model rows, not the tables again."""
    from hubflow.plans.q_models import split_table
    assert "lineitem" not in _plan(split_table(spark, SF))


def test_segments_are_deduplicated_without_unused_columns(spark):
    from hubflow.plans.q_audit import audited
    a = audited(spark, SF)
    assert "lineitem" not in _plan(a) and "trip_creation_time" not in a.columns
