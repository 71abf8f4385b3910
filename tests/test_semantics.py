"""Hand-made frames for the semantics that decide whether results match."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hubflow.functions import cleaning as B
from hubflow.functions import features as FE
from hubflow.operators import corridors as C
from hubflow.operators import hubs as H


def test_weekday_monday_zero_and_weekend(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 5),), (dt.datetime(2024, 1, 6, 23),)],
                               "trip_creation_time timestamp_ntz")
    rows = FE.add_temporal(df).orderBy("trip_creation_time").collect()
    assert (rows[0]["day_of_week"], rows[0]["is_weekend"], rows[0]["hour_of_day"]) == (0, False, 5)
    assert (rows[1]["day_of_week"], rows[1]["is_weekend"]) == (5, True)


@pytest.mark.parametrize("hour,label,code", [(0, "Night_0_6", 0), (5, "Night_0_6", 0), (6, "Morning_6_10", 1),
                                             (10, "Afternoon_10_16", 2), (16, "Evening_16_20", 3),
                                             (20, "Night_20_24", 4), (23, "Night_20_24", 4)])
def test_time_of_day_left_closed(spark, hour, label, code):
    r = spark.range(1).select(FE.tod_label(F.lit(hour)).alias("l")).select("l", FE.tod_code(F.col("l")).alias("c")).first()
    assert (r["l"], r["c"]) == (label, code)


@pytest.mark.parametrize("bc,tier", [(None, "Peripheral"), (0.0, "Peripheral"), (0.01, "Peripheral"),
                                     (0.0100001, "Moderate"), (0.05, "Moderate"), (0.15, "High"),
                                     (0.1500001, "Critical"), (1.0, "Critical")])
def test_centrality_tier_right_closed(spark, bc, tier):
    df = spark.createDataFrame([(bc,)], "bc double")
    assert df.select(FE.centrality_tier(F.col("bc"))).first()[0] == tier


def _trips(spark, rows):
    return spark.createDataFrame(rows, "source_center string, destination_center string, route_type string, "
                                 "time_of_day string, delay_ratio double, trip_uuid string, actual_time double, "
                                 "osrm_time double, actual_distance_to_destination double, is_cutoff boolean")


def test_null_keys_dropped_and_single_row_std_null(spark):
    t = _trips(spark, [("A", "B", "FTL", "Night_0_6", 1.5, "t1", 15.0, 10.0, 3.0, True),
                       (None, "B", "FTL", "Night_0_6", 2.0, "t2", 20.0, 10.0, 3.0, False),
                       ("A", "C", "FTL", "Night_0_6", 1.0, "t3", 10.0, 10.0, 3.0, False),
                       ("A", "C", "FTL", "Night_0_6", 3.0, "t4", 30.0, 10.0, 5.0, False)])
    e = {(r["source_center"], r["destination_center"]): r for r in C.edge_weights(t).collect()}
    assert set(e) == {("A", "B"), ("A", "C")}
    assert e[("A", "B")]["std_delay_ratio"] is None and e[("A", "B")]["low_support"]
    assert e[("A", "C")]["edge_weight"] == 2.0
    assert e[("A", "C")]["p95_delay_ratio"] == pytest.approx(1.0 + 0.95 * 2.0)


def test_exact_percentile_interpolation(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 4.0, 8.0)], "v double")
    assert df.agg(F.percentile("v", 0.95)).first()[0] == pytest.approx(7.4)
    from hubflow.operators.ordering import exact_quantile
    assert exact_quantile(df, "v", 0.95).first()[0] == pytest.approx(7.4)
    assert exact_quantile(df, "v", 0.5).first()[0] == pytest.approx(3.0)


def test_rules_null_is_dropped_and_breakdown_counts_only_true(spark):
    df = spark.createDataFrame([(0.5, 10.0, 1.0, 0.0, 1.0), (None, 10.0, 1.0, 0.0, 1.0), (5.0, 5.0, 1.0, 0.0, 1.0)],
                               "actual_time double, osrm_time double, factor double, segment_factor double, "
                               "actual_distance_to_destination double")
    assert B.apply_rules(df).count() == 1
    hits = {r["rule"]: r["rows_hit"] for r in B.rule_breakdown(df).collect()}
    assert hits["actual_time < 1 min"] == 1
    rep = B.drop_report(df).first()
    assert (rep["rows_before"], rep["rows_after"], rep["rows_dropped"]) == (3, 1, 2)


def test_dedup_first_keeps_lowest_order(spark):
    df = spark.createDataFrame([("t", "A", "B", 3, "late"), ("t", "A", "B", 1, "early"), ("u", "A", "B", 2, "x")],
                               "trip_uuid string, source_center string, destination_center string, row_ord int, v string")
    out = {r["trip_uuid"]: r["v"] for r in B.dedup_first(df, ["trip_uuid", "source_center", "destination_center"]).collect()}
    assert out == {"t": "early", "u": "x"}


def test_hub_features_full_outer_and_ftl_null(spark):
    t = spark.createDataFrame(
        [("A", "B", "FTL", 1.5, "t1", False, 10.0, 1.0, False), ("A", "B", "Carting", 2.5, "t2", True, 20.0, 1.2, True)],
        "source_center string, destination_center string, route_type string, delay_ratio double, trip_uuid string, "
        "is_cutoff boolean, start_scan_to_end_scan double, log_dwell_time double, is_weekend boolean")
    h = {r["hub_id"]: r for r in H.hub_features(t).collect()}
    assert set(h) == {"A", "B"}
    assert h["A"]["ftl_ratio"] == 0.5 and h["A"]["weekend_congestion_delta"] == 1.0
    assert h["B"]["outbound_trips"] == 0 and h["B"]["inbound_trips"] == 2 and h["B"]["ftl_count"] is None


def test_hub_labels_source_side_first(spark):
    df = spark.createDataFrame([("A", "a-src", "B", "b-dst", 2), ("B", "b-src", "A", "a-dst", 1)],
                               "source_center string, source_name string, destination_center string, "
                               "destination_name string, row_ord int")
    labels = {r["hub_id"]: r["label"] for r in H.hub_labels(df).collect()}
    assert labels == {"A": "a-src", "B": "b-src"}


def test_zero_denominators_do_not_raise(spark):
    df = spark.createDataFrame([(10.0, 0.0, 0.0, 1.0, 5.0, 0.0, 1.0)],
                               "actual_time double, osrm_time double, segment_osrm_time double, "
                               "segment_actual_time double, osrm_distance double, start_scan_to_end_scan double, x double")
    r = FE.add_ratios(df).first()
    assert r["delay_ratio"] is None and r["segment_delay_ratio"] is None and r["speed_kmph"] is None


def test_hot_group_sort_path_equals_hash_path(spark):
    """Groups above the hot threshold take the sort-based exact path; results are identical."""
    import random
    rng = random.Random(5)
    rows = [("A", "B", "FTL", "Night_0_6", rng.choice([0.5, 1.0, 1.25, 2.0, 3.5]), f"t{i}", 10.0 * (i % 7 + 1),
             10.0, float(i % 5), i % 2 == 0) for i in range(300)]
    rows += [("C", "D", "Carting", "Night_20_24", 1.0 + i / 8, f"u{i}", 20.0, 10.0, 2.0, False) for i in range(9)]
    t = _trips(spark, rows)
    a = {tuple(r[:4]): r.asDict() for r in C.edge_weights(t).collect()}
    b = {tuple(r[:4]): r.asDict() for r in C.edge_weights(t, hot_rows=50).collect()}
    assert a.keys() == b.keys()
    for k in a:
        for col, v in a[k].items():
            assert b[k][col] == (pytest.approx(v) if isinstance(v, float) else v), (k, col)


def test_sorted_quantile_path_global_and_grouped(spark):
    """Forcing every group onto the sort-based path gives the hash-path answers."""
    import random
    rng = random.Random(11)
    df = spark.createDataFrame([(rng.choice(["x", "y", "z"]), rng.random() * 10) for _ in range(400)],
                               "g string, v double")
    specs = [("med", "v", 0.5), ("p95", "v", 0.95), ("p10", "v", 0.1)]
    for keys in ([], ["g"]):
        a = {tuple(r[k] for k in keys): r for r in C.skew_safe_quantiles(df, keys, specs).collect()}
        b = {tuple(r[k] for k in keys): r for r in C.skew_safe_quantiles(df, keys, specs, hot_rows=10).collect()}
        assert a.keys() == b.keys()
        for k in a:
            for o, _, _ in specs:
                assert b[k][o] == pytest.approx(a[k][o])
