"""Results stay whole: hot groups, NULL keys, ties, empty and constant inputs, unconverged loops, CSV order."""

import os

import pytest
from pyspark.sql import functions as F

from hubflow.operators import corridors as C
from hubflow.operators import decisions as D
from hubflow.operators import graph as G
from hubflow.operators import metrics as M
from hubflow.operators import profile as P
from hubflow.operators import splits as SP
from hubflow.operators.ordering import exact_quantile, global_position
from hubflow.schema import TRIP_SCHEMA
from hubflow.sources.trips import corrupt_rows, read_trips_csv


def _skewed(spark):
    rows = [("null values", None, 1.0)] * 40 + [(None, float(i % 11), 2.0) for i in range(60)] + [("ties", 3.0, float(i % 2)) for i in range(50)]
    rows += [("small", 1.0, None), ("small", 4.0, 2.0), ("empty", None, None)]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "g string, v double, w double, row_ord int").repartition(4)


@pytest.mark.parametrize("keys", [["g"], []])
def test_both_quantile_paths_keep_every_group(spark, keys):
    df = _skewed(spark)
    specs = [("med", "v", 0.5), ("p90", "v", 0.9), ("w_med", "w", 0.5)]
    row = lambda r: tuple(r)
    cold = sorted(map(row, C.skew_safe_quantiles(df, keys, specs).collect()), key=str)
    hot = sorted(map(row, C.skew_safe_quantiles(df, keys, specs, hot_rows=10).collect()), key=str)
    assert cold == hot and len(cold) == (5 if keys else 1)
    aggs = [F.count(F.lit(1)).alias("n")]
    a = sorted(map(row, C.with_quantiles(df, keys, aggs, specs).collect()), key=str)
    assert a == sorted(map(row, C.with_quantiles(df, keys, aggs, specs, hot_rows=10).collect()), key=str)
    assert len(a) == len(cold)


def test_equal_values_are_spread(spark):
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.col("id") / 7.0).alias("v"), "id")
    spread = global_position(df.select("v", F.xxhash64("v", "id").alias("t")), ["v", "t"], num_partitions=8)
    assert spread.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 2000
    assert exact_quantile(df, "v", 0.1).first()[0] == df.agg(F.percentile("v", 0.1)).first()[0]


def test_a_cache_of_the_caller_stays(spark):
    df = spark.range(50).withColumn("v", F.col("id") * 1.0).cache()
    global_position(df, ["v"]).count()
    assert df.storageLevel.useMemory
    df.unpersist()


def test_unconverged_loops_raise(spark):
    chain = spark.createDataFrame([(f"v{i:03d}", f"v{i + 1:03d}", 1.0) for i in range(40)], "src string, dst string, weight double")
    with pytest.raises(RuntimeError, match="converged"):
        G.weak_components(chain, max_iter=2)
    assert G.weak_components(chain).select("component").distinct().count() == 1
    with pytest.raises(RuntimeError, match="converged"):
        G.betweenness(chain, max_iter=3, packed_edges=0)
    with pytest.raises(ValueError, match="positive"):
        G.betweenness(chain.withColumn("weight", F.lit(0.0)))


def test_sampling_pivots_is_asked_for(spark):
    v = spark.range(700).select(F.col("id").cast("string").alias("v"))
    assert G.pick_pivots(v)[1:] == (700, 700)
    sources, n, k = G.pick_pivots(v, k=10)
    assert (n, k, sources.count()) == (700, 10, 10)


def test_kde_has_every_grid_point(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (1000.0,), (1000.1,)], "v double").union(spark.range(300).select(F.lit(0.05)))
    out = P.kde(df, "v", points=200)
    assert out.count() == 200 and out.agg(F.min("density")).first()[0] >= 0


def test_zero_and_empty_denominators(spark):
    flat = spark.createDataFrame([(2.0,)] * 4, "v double")
    h = P.histogram(flat, "v", 4).collect()
    assert sum(r["count"] for r in h) == 4 and h[0]["bin_lo"] <= 2.0 <= h[0]["bin_hi"]
    assert P.histogram(flat.limit(0), "v", 4).collect() == []
    pred = spark.createDataFrame([("m", 0.0, 1.0, 0.0), ("m", 2.0, 1.0, 2.0)], "model string, actual_eta double, predicted_eta double, osrm_predicted_eta double")
    m = M.regression_metrics(pred).first()
    assert m["mape"] == 50.0 and m["mae"] == 1.0 and m["mae_reduction_pct"] is None
    assert M.prediction_table(pred, guard=None).filter("pct_error is null").count() == 1
    edges = spark.createDataFrame([], "route_type string, low_support boolean, edge_weight double, time_of_day string")
    e = C.edge_summary(edges).first()
    assert e["edges"] == 0 and e["low_support_pct"] is None and e["weight_median"] is None
    recs = spark.createDataFrame([], "route_type string, recommendation string, cost_saving double, trip_count long, "
                                     "override_applied boolean, confidence string, is_chronic boolean")
    assert D.misroute_impact(recs).first()["pct_misrouted"] is None
    assert D.recommendation_summary(recs).first()["ftl_pct"] is None
    import datetime as dt
    few = spark.createDataFrame([(dt.datetime(2024, 1, 1), 1)], "trip_creation_time timestamp_ntz, row_ord int")
    assert SP.expanding_folds(few, k=5).first()["test_fold"] is None


def _csv(path, rows):
    names = [f.name for f in TRIP_SCHEMA.fields]
    with open(path, "w") as f:
        f.write(",".join(names) + "\n")
        for r in rows:
            f.write(",".join(str(r.get(n, "")) for n in names) + "\n")


def test_csv_rows_keep_file_order_and_bad_cells_are_reported(spark, tmp_path):
    row = lambda i, **k: {"trip_uuid": f"t{i}", "route_schedule_uuid": "r", "source_center": "A", "destination_center": "B", **k}
    _csv(tmp_path / "data_part_1.csv", [row(i, source_name="first") for i in range(5)])
    _csv(tmp_path / "data_part_2.csv", [row(i, source_name="second") for i in range(400)] + [row(900, segment_osrm_time="x!")])
    df = read_trips_csv(spark, str(tmp_path))
    from hubflow.functions.cleaning import dedup_first
    kept = dedup_first(df.select("trip_uuid", "source_name", "row_ord"), ["trip_uuid"])
    assert {r["source_name"] for r in kept.filter("trip_uuid in ('t0', 't1', 't2', 't3', 't4')").collect()} == {"first"}
    ordered = [r["trip_uuid"] for r in df.orderBy("row_ord").select("trip_uuid").collect()]
    assert ordered == [f"t{i}" for i in range(5)] + [f"t{i}" for i in range(400)] + ["t900"]
    assert tuple(corrupt_rows(df).first()) == (406, 1)
    missing = read_trips_csv(spark, os.path.join(tmp_path, "nowhere"), fallback=str(tmp_path))
    assert missing.count() == 406


@pytest.mark.parametrize("bad", [{"fixed_ftl": 0}, {"var_carting_per_km": -1}, {"long_distance_threshold_km": 0}, {"bc_high_threshold": 1.0},
                                 {"sla_delay_threshold": 11}, {"ftl_sla_multiplier": 0.9}, {"var_ftl_per_km": 20.0}, {"peak_hours": (25,)}, {"typo": 1}])
def test_scorer_parameters_are_checked(bad):
    with pytest.raises(ValueError):
        D.validate_params(bad)
    assert D.validate_params({"fixed_ftl": 400.0})["fixed_ftl"] == 400.0


def test_sample_has_the_exact_size(spark):
    df = spark.range(1000).select(F.col("id").alias("row_ord"))
    a = sorted(r[0] for r in P.sample_rows(df, 150).collect())
    assert len(set(a)) == 150 and a == sorted(r[0] for r in P.sample_rows(df.repartition(7), 150).collect())
    assert P.sample_rows(df, 5000).count() == 1000


def test_embedding_join_hot_pairs_null_and_unknown_hubs(spark):
    """A corridor over the limit is dealt to several parts; no trip is lost or doubled, and each gets its own vectors."""
    from hubflow.operators import neighbourhood as NB
    rows = [(i, "a", "b") for i in range(50)] + [(50, "a", None), (51, None, "b"), (52, None, None), (53, "x", "b"), (53, "x", "b")]
    trips = spark.createDataFrame(rows, "row_ord long, source_center string, destination_center string")
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "hub_id string, embedding array<double>")
    known = {"a": [1.0, 2.0], "b": [3.0, 4.0]}
    want = sorted((i, s in known, d in known, known.get(s, [0.0, 0.0]), known.get(d, [0.0, 0.0])) for i, s, d in rows)
    for limit in (7, 5_000_000):
        got = NB.embedding_join(trips, vectors, 2, hot_pair_rows=limit)
        assert sorted((r["row_ord"], r["src_known"], r["dst_known"], r["src_emb"], r["dst_emb"]) for r in got.collect()) == want
        assert got.columns == trips.columns + ["src_known", "dst_known", "src_emb", "dst_emb"]
    low = NB.embedding_coverage(NB.embedding_join(trips, vectors, 2)).first()
    assert low["rows"] == 55 and not low["warning"]
    assert NB.embedding_join(trips.limit(0), vectors, 2).collect() == []
