"""Golden decision cases (inputs from the studied analysis, numbers recomputed
from its formulas) and text formats."""

import pytest
from pyspark.sql import functions as F

from hubflow.operators import decisions as D

# km, hour, BC, ratio -> recommendation, FTL CEI, Carting CEI, confidence
MODE_CASES = [
    (60, 14, 0.0005, 1.10, "FTL", 800.0, 1300.0, 38.46),
    (15, 10, 0.006, 1.40, "Carting", 1138.5, 540.0, 52.57),
    (28, 3, 0.003, 1.25, "Carting", 960.0, 660.0, 31.25),
    (10, 13, 0.0001, 1.05, "Carting", 550.0, 300.0, 45.45),
    (80, 9, 0.0008, 1.30, "FTL", 1188.0, 2295.0, 48.24),
    (22, 10, 0.2495, 1.83, "Carting", 1207.8, 729.0, 39.64),
    (45, 10, 0.005, 1.35, "Carting", 1435.5, 1350.0, 5.96),
    (45, 9, 0.003, 1.25, "FTL", 1196.25, 1350.0, 11.39),
]


def test_mode_scoring_golden(spark):
    df = spark.createDataFrame([(i, float(k), h, float(b), float(r)) for i, (k, h, b, r, *_) in enumerate(MODE_CASES)],
                               "id int, distance_km double, hour_of_day int, destination_bc double, "
                               "historical_delay_ratio double")
    got = {r["id"]: r for r in D.recommend_route_type(df).collect()}
    for i, (_, _, _, _, rec, ftl, cart, conf) in enumerate(MODE_CASES):
        assert got[i]["recommendation"] == rec
        assert got[i]["ftl_cei"] == pytest.approx(ftl)
        assert got[i]["carting_cei"] == pytest.approx(cart)
        assert got[i]["confidence_score"] == pytest.approx(conf)


def test_penalty_text_and_driver(spark):
    df = spark.createDataFrame([(22.0, 10, 0.2495, 1.83), (10.0, 13, 0.0001, 1.05)],
                               "distance_km double, hour_of_day int, destination_bc double, historical_delay_ratio double")
    rows = D.recommend_route_type(df).orderBy("distance_km").collect()
    short, crit = rows[0], rows[1]
    assert crit["active_ftl_penalties"] == [
        "Peak hour (×1.10)", f"Critical bottleneck at destination (BC={0.2495:.5f}, ×1.50)",
        f"SLA-breaching corridor (delay_ratio={1.83:.2f}, ×1.20)"]
    assert crit["active_carting_penalties"] == ["Peak hour (×1.35)"]
    assert crit["primary_driver"] == "Critical bottleneck at destination hub"
    assert short["primary_driver"] == f"Short-haul corridor ({550.0:.0f} vs {300.0:.0f} base CEI): Carting base cost advantage"
    assert short["resolved_time_of_day"] == "Afternoon_10_16"


def test_quarantine_rows(spark):
    df = spark.createDataFrame([(-5.0, 10, 0.1, 1.0, None), (10.0, 25, 0.1, 1.0, None),
                                (10.0, 10, 0.1, 1.0, "InvalidBucket"), (10.0, 10, 0.1, 1.0, "Night_0_6")],
                               "distance_km double, hour_of_day int, destination_bc double, "
                               "historical_delay_ratio double, time_of_day_label string")
    valid, rejected = D.quarantine(df)
    assert valid.count() == 1
    assert sorted(r["error"] for r in rejected.collect()) == sorted([
        "distance_km must be positive", "hour_of_day must be in [0, 23]", "time_of_day_label is not valid"])


# km, ratio, source BC, peak -> recommendation, confidence, FTL cost, Carting cost, saving, override
RULE_CASES = [
    (30.5, 2.81, 0.249, True, "Carting", "HIGH", 3380.23, 2029.96, 1350.27, True),
    (650.0, 1.5, 0.137, False, "FTL", "HIGH", 16150.0, 26950.0, 10800.0, False),
    (150.0, 1.3, 0.01, False, "FTL", "MEDIUM", 5470.0, 6090.0, 620.0, False),
    (17.5, 9.83, 0.06, True, "Carting", "HIGH", 3742.15, 2766.8, 975.35, True),
    (900.0, 1.1, 0.003, False, "FTL", "HIGH", 19240.0, 32880.0, 13640.0, False),
    (200.0, 1.0, 0.06, True, "Carting", None, None, None, None, True),
]


def test_cost_rule_golden(spark):
    df = spark.createDataFrame([(i, k, r, b, p) for i, (k, r, b, p, *_) in enumerate(RULE_CASES)],
                               "id int, median_dist_km double, mean_delay_ratio double, "
                               "src_betweenness_centrality double, is_peak_tod boolean")
    got = {r["id"]: r for r in D.recommend_transport_mode(df).collect()}
    for i, (_, _, _, _, rec, conf, ftl, cart, saving, over) in enumerate(RULE_CASES):
        g = got[i]
        assert g["recommendation"] == rec and g["override_applied"] == over
        if conf is not None:
            assert g["confidence"] == conf
            assert g["rule_cost_ftl"] == pytest.approx(ftl)
            assert g["rule_cost_carting"] == pytest.approx(cart)
            assert g["cost_saving"] == pytest.approx(saving)
    # override picks the dearer mode: the signed saving is negative
    assert got[5]["net_saving"] < 0 < got[5]["cost_saving"]


def test_reasoning_text_matches_python_format(spark):
    km, ratio, bc, peak = 150.0, 1.3, 0.01, False
    df = spark.createDataFrame([(km, ratio, bc, peak)], "median_dist_km double, mean_delay_ratio double, "
                               "src_betweenness_centrality double, is_peak_tod boolean")
    r = D.recommend_transport_mode(df).first()
    delay = max(0.0, (ratio - 1.0) * ((km / 60.0) * 60.0))
    ftl, cart = 2500 + 18 * km + 6 * delay, 300 + 35 * km + 12 * delay
    expected = (f"Cost model: FTL=₹{ftl:,.0f}, Carting=₹{cart:,.0f}, diff=₹{ftl - cart:+,.0f}. "
                f"Delay ratio={ratio:.2f}×, dist={km:.0f} km, centrality={bc:.4f}, peak={peak}.")
    assert r["reasoning"] == expected


def test_breakeven(spark):
    row = spark.range(1).select(D.breakeven_km(0.0).alias("a"), D.breakeven_km(90.0).alias("b")).first()
    assert row["a"] == pytest.approx(129.41, abs=0.01)
    assert row["b"] == pytest.approx(97.65, abs=0.01)


def test_peak_map_hit_and_miss(spark):
    from hubflow.functions.features import is_peak_tod
    df = spark.createDataFrame([("Night_0_6",), ("Morning_6_10",), ("Night 0-6",)], "t string")
    assert [r[0] for r in df.select(is_peak_tod(F.col("t"))).collect()] == [True, False, False]
