"""Order statistics by refining counts: against a sort, with heavy ties, nulls, outliers and tiny brackets; plans without sort or write."""

import random

import pytest
from pyspark.sql import functions as F

from hubflow.operators import selection as SEL
from hubflow.operators import splits as SP
from hubflow.operators.audit import exec_summary, winsorise


def column(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}").repartition(5)


@pytest.mark.parametrize("few", [3, 10_000])
@pytest.mark.parametrize("shape", ["spread", "ties", "outliers", "one", "negative"])
def test_ranks_equal_a_sort(spark, monkeypatch, few, shape):
    monkeypatch.setattr(SEL, "FEW", few)
    rng = random.Random(shape)
    values = {"spread": [rng.random() for _ in range(3000)], "ties": [rng.choice([1.0, 1.0, 1.0, 2.0, 5.0, rng.random()]) for _ in range(3000)],
              "outliers": [10.0 ** rng.randrange(-200, 200) for _ in range(2000)], "one": [4.0] * 500, "negative": [-float(rng.randrange(9)) for _ in range(1000)]}[shape]
    order, n = sorted(values), len(values)
    ranks = sorted({0, 1, n // 3, n // 2, n - 2, n - 1, -1, n})
    got = SEL.order_statistics(column(spark, [*values, None, None]), ranks)
    assert got == [order[r] if 0 <= r < n else None for r in ranks]


def test_quantiles_and_empty_columns(spark):
    values = [float(i * i % 97) for i in range(500)]
    df = column(spark, [*values, None])
    for q in (0.0, 0.25, 0.99, 1.0):
        assert SEL.exact_quantile(df, "v", q) == df.agg(F.percentile("v", q)).first()[0]
    assert SEL.exact_quantile(column(spark, [None, None]), "v", 0.5) is None


def test_winsorise_keeps_every_row(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 9.0), (None, 2.0), (None, 50.0), ("b", None)], "g string, x double")
    got = sorted(map(tuple, winsorise(df, "x", 0.5, by="g").collect()), key=str)
    assert got == sorted([("a", 1.0, False), ("a", 5.0, True), (None, 2.0, False), (None, 26.0, True), ("b", None, None)], key=str)
    assert winsorise(df, "x", 0.5).count() == 5 and winsorise(df.limit(0), "x").count() == 0


def timed(spark, rows):
    return spark.createDataFrame(rows, "trip_creation_time long, row_ord long, is_train boolean, wide string").repartition(4)


def test_splits_equal_positions(spark, monkeypatch):
    monkeypatch.setattr(SEL, "FEW", 4)
    rng = random.Random(1)
    rows = [(rng.choice([None, 3, 3, 3, 3, rng.randrange(50)]), i, True, "w" * 9) for i in rng.sample(range(9000), 400)]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    place = {r[1]: i for i, r in enumerate(order)}
    df, n = timed(spark, rows), len(rows)
    assert {r["row_ord"]: r["split"] for r in SP.chronological_split(df).collect()} == {i: "train" if p < int(n * 0.8) else "test" for i, p in place.items()}
    assert {r["row_ord"]: r["split"] for r in SP.val_tail(df).collect()} == {i: "train" if p < n - int(n * 0.1) else "val" for i, p in place.items()}
    size = n // 6
    folds = SP.expanding_folds(df, k=5)
    assert {r["row_ord"]: r["test_fold"] for r in folds.collect()} == {i: (p - n + 5 * size) // size if p >= n - 5 * size else None for i, p in place.items()}
    assert [(r["test_fold"], r["test_rows"], r["train_rows"]) for r in SP.fold_summary(folds).orderBy("test_fold").collect()] == [(i, size, n - size * (5 - i)) for i in range(5)]


def test_small_and_empty_tables_split(spark):
    one = timed(spark, [(5, 1, True, "w")])
    assert [r["split"] for r in SP.chronological_split(one).collect()] == ["test"] and [r["split"] for r in SP.val_tail(one).collect()] == ["val"]
    for fn in (SP.chronological_split, SP.val_tail, SP.expanding_folds):
        assert fn(one.limit(0)).collect() == []


def test_plans_of_splits_and_caps_have_no_exchange(spark):
    df = spark.range(3000).select(F.col("id").alias("trip_creation_time"), F.col("id").alias("row_ord"), F.lit(True).alias("is_train"), (F.col("id") % 7).cast("double").alias("x"))
    for out in (SP.chronological_split(df), SP.expanding_folds(df), winsorise(df, "x")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not any(step in plan for step in ("Exchange", "Sort", "Scan ExistingRDD", "InMemory"))


def test_exec_summary_of_empty_tables(spark):
    none = lambda s: spark.createDataFrame([], s)
    got = exec_summary(none("a int"), none("a int"), none("facility_id string, betweenness_centrality double"),
                       none("source_id string, destination_id string, breach_severity_score double"), none("facility_id string, rank int")).first()
    assert got["corridors"] == 0 and got["chronic_pct"] is None


@pytest.mark.parametrize("keys", [[], ["g"]])
@pytest.mark.parametrize("margin", [1 / 3000, 0.0])
def test_group_quantiles_equal_percentile(spark, monkeypatch, keys, margin):
    """All columns in one call, also where the brackets miss their ranks (margin 0): ties, NULL keys, empty groups, outliers."""
    monkeypatch.setattr(SEL, "MARGIN", margin)
    rng = random.Random(3)
    rows = [(rng.choice(["x", "y", None]), rng.choice([1.0, 1.0, 7.5, rng.random()]), 10.0 ** rng.randrange(-200, 200), rng.randrange(5)) for _ in range(900)]
    df = spark.createDataFrame([*rows, ("empty", None, None, None), ("one", 3.0, None, 1)], "g string, v double, w double, i int").repartition(5)
    specs = [(f"{c}{int(q * 100)}", c, q) for c in ("v", "w", "i") for q in (0.0, 0.25, 0.5, 0.98, 1.0)]
    want = df.groupBy(*keys).agg(*[F.percentile(c, q).alias(n) for n, c, q in specs])
    assert sorted(map(tuple, SEL.group_quantiles(df, keys, specs).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
