"""Model fits take every labelled row: binned rows against the table read whole, folds and refit against a fit on the driver, the loss on all validation rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hubflow.operators import boosting as B
from hubflow.operators import models as ML

SMALL = ML.SEARCH_SPACE | {"n_estimators": (4, 9), "max_depth": (3, 6)}
N = 7000


@pytest.fixture(scope="module")
def trips(spark):
    """More rows than any bound that fits had, of them some without a label, missing values, equal times and vectors of hubs."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(N):
        hub = int(rng.integers(0, 40))
        a, b = float(rng.normal()), None if i % 11 == 0 else float(rng.integers(0, 6))
        rows.append((i, None if i % 500 == 0 else i // 3, a, b, None if i % 13 == 0 else float("nan") if i % 17 == 0 else float(rng.normal()), [float(hub % 5), float(hub * hub), -0.0 if hub % 2 else 0.0],
                     None if i % 19 == 0 else 4 * a + (b or 0.0) + hub % 5 + float(rng.normal())))
    return spark.createDataFrame(rows, "row_ord long, trip_creation_time long, a double, b double, c double, v array<double>, actual_eta double").repartition(5).cache()


def unpacked(rows: ML.FitRows):
    """(bin numbers, labels, positions) of the binned rows."""
    got = rows.table.orderBy("pos").collect()
    out = np.zeros((len(got), len(rows.edges)), np.int16)
    for g, (members, bins) in enumerate(zip(rows.groups.members, rows.groups.bins)):
        out[:, members] = bins[[r[f"__g{g}"] for r in got]]
    return out, np.array([r["__y"] for r in got]), [r["pos"] for r in got]


@pytest.mark.parametrize("vectors", [ML.VECTORS, 7])
def test_all_rows_are_binned_in_time_order(trips, monkeypatch, vectors):
    monkeypatch.setattr(ML, "VECTORS", vectors)
    rows = ML.fit_rows(trips, ["a", "b", "c"], vector_cols=("v",))
    matrix, y = ML.labelled_rows(trips, ["a", "b", "c"], vector_cols=("v",))
    edges = B.bin_edges(matrix)
    codes, labels, pos = unpacked(rows)
    assert rows.n == rows.n_fit == len(y) == trips.where("actual_eta is not null").count() > 6000 and pos == list(range(len(y)))
    assert len(rows.edges) == 6 and all(len(x) == len(e) and np.allclose(x, e) for x, e in zip(rows.edges, edges))
    assert np.array_equal(labels, y) and np.array_equal(codes, B.bin_codes(matrix, edges))


def test_edges_of_counts_are_those_of_the_rows():
    rng = np.random.default_rng(2)
    for values in (rng.integers(0, 9, 300), rng.integers(0, 70, 4000), rng.normal(size=800), np.full(5, 3.0)):
        column = np.append(values.astype(float), np.nan)
        found, times = np.unique(column, return_counts=True)
        # a value that only rows outside the fit have counts for nothing
        assert np.allclose(B.count_edges(np.append(found, 1e9), np.append(times, 0)), B.bin_edges(column[:, None])[0])


def test_search_and_refit_use_every_row(spark, trips):
    model = ML.search_eta_model(trips, ["a", "b", "c"], draws=2, folds=2, space=SMALL, vector_cols=("v",))
    matrix, y = ML.labelled_rows(trips, ["a", "b", "c"], vector_cols=("v",))
    codes = B.bin_codes(matrix, B.bin_edges(matrix))
    settings, expected = ML.draw_params(2, 42, SMALL), []
    for draw, setting in enumerate(settings):
        for fold, (first, end) in enumerate(ML.fold_starts(len(y), 2)):
            _, pred = B.boost(codes[:end], y[:end], np.arange(end) < first, setting, 42 + draw)
            expected.append((draw, fold, np.abs(pred[first:] - y[first:end]).mean()))
    assert model.rows == len(y) > 6000 and [s[:2] for s in model.scores] == [e[:2] for e in expected]
    assert np.allclose([s[2] for s in model.scores], [e[2] for e in expected])
    trees, pred = B.boost(codes, y, np.ones(len(y), bool), model.params, 42)
    assert len(trees.feature) == len(model.trees.feature) and np.allclose(model.trees.predict(codes), pred)


def test_loss_is_followed_on_all_validation_rows(spark, trips):
    train, val = trips.where("row_ord % 2 = 0"), trips.where("row_ord % 2 = 1").unionByName(trips.where("row_ord % 4 = 1").withColumn("row_ord", F.col("row_ord") + N))
    model = ML.search_eta_model(train, ["a", "b"], draws=1, space=SMALL, vector_cols=("v",), val=val)
    got = {}
    for name, df in (("train_loss", train), ("val_loss", val)):
        p = ML.predict(model, df.where("actual_eta is not null"), keep=("row_ord",)).collect()
        assert len(p) > 3000
        got[name] = np.mean([(r["predicted_eta"] - r["actual_eta"]) ** 2 for r in p])
    last = ML.learning_curve(model, spark).orderBy(F.desc("round")).first()
    assert model.rows == train.where("actual_eta is not null").count()
    assert np.isclose(last["train_loss"], got["train_loss"]) and np.isclose(last["val_loss"], got["val_loss"])


def test_groups_of_features_grow_the_trees_of_single_ones(monkeypatch):
    rng = np.random.default_rng(4)
    hub = rng.integers(0, 30, 5000)
    table = np.column_stack([rng.integers(0, 4, 30), rng.integers(0, 9, 30), np.zeros(30)]).astype(np.int16)
    scalars = np.column_stack([rng.integers(0, 32, 5000), rng.integers(0, 7, 5000), rng.integers(0, 2, 5000)]).astype(np.int16)
    codes = np.concatenate([scalars, table[hub]], axis=1)
    y = scalars[:, 0] * 1.5 + table[hub, 1] + rng.normal(size=5000)
    groups = B.Groups.of(codes.max(axis=0) + 1, range(3), 10 ** 6)
    assert [len(m) for m in groups.members] == [3]
    groups.add(range(3, 6), table)
    data = B.Coded(np.array([groups.product_codes(0, scalars[:, groups.members[0]]), hub], np.int16), groups)
    params = dict(n_estimators=12, learning_rate=0.3, max_depth=5, subsample=0.8, colsample_bytree=0.7, min_child_weight=9, reg_lambda=1.0, reg_alpha=0.1)
    part = rng.random(5000) < 0.8
    one, p = B.boost(codes, y, part, params, 6, curve=True)
    monkeypatch.setattr(B, "BLOCK", 700)
    two, q = B.boost(data, y, part, params, 6, curve=True)
    assert all(np.array_equal(a, b) for x, z in ((one.feature, two.feature), (one.cut, two.cut)) for a, b in zip(x, z))
    assert np.allclose(p, q) and np.allclose(one.curve, two.curve) and np.allclose(two.predict(codes), q)


def test_run_summary_tells_the_rows_of_the_fit(spark, trips, monkeypatch):
    from hubflow.plans import q_charts, q_models
    rows = trips.withColumn("osrm_predicted_eta", F.lit(1.0))
    model = ML.search_eta_model(rows, ["a", "b"], draws=1, space=SMALL)
    monkeypatch.setattr(q_models, "gbt_model", lambda spark, sf: (model, rows, rows.where("actual_eta is not null")))
    assert q_charts.q_model_run_summary(spark, "unused").first()["fit_rows_at_most"] == rows.where("actual_eta is not null").count() > 6000
