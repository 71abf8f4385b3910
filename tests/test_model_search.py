"""Boosted trees: the fit against a plain search of all cuts, the loss by round against a re-evaluation, the published search, queries that train."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hubflow.operators import models as ML
from hubflow.operators.boosting import bin_codes, bin_edges, boost

PLAIN = dict(n_estimators=30, learning_rate=0.2, max_depth=3, subsample=1.0, colsample_bytree=1.0, min_child_weight=2, reg_lambda=1.5, reg_alpha=0.7)


def data(n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 4, n), np.full(n, 2.0), rng.normal(size=n)])
    x[rng.random(n) < 0.1, 3] = np.nan
    return x, 5 * x[:, 0] + 3 * (x[:, 1] == 2) + rng.normal(size=n) / 3


def plain_tree(codes, grad, rows, depth, p, out):
    """Best cut by trying every one."""
    def shrunk(g):
        return np.sign(g) * max(abs(g) - p["reg_alpha"], 0)

    def score(r):
        return shrunk(grad[r].sum()) ** 2 / (len(r) + p["reg_lambda"])
    best = (1e-9, None)
    for j in range(codes.shape[1]):
        for b in range(codes[:, j].max()):
            left, right = rows[codes[rows, j] <= b], rows[codes[rows, j] > b]
            if min(len(left), len(right)) >= p["min_child_weight"]:
                gain = score(left) + score(right) - score(rows)
                if gain > best[0] + 1e-9:
                    best = (gain, (left, right))
    if best[1] is None or not depth:
        out[rows] = -p["learning_rate"] * shrunk(grad[rows].sum()) / (len(rows) + p["reg_lambda"])
    else:
        for side in best[1]:
            plain_tree(codes, grad, side, depth - 1, p, out)


def test_trees_equal_a_plain_search_of_all_cuts():
    x, y = data()
    codes = bin_codes(x, bin_edges(x))
    pred = np.full(len(y), y.mean())
    for _ in range(PLAIN["n_estimators"]):
        step = np.zeros(len(y))
        plain_tree(codes, pred - y, np.arange(len(y)), PLAIN["max_depth"], PLAIN, step)
        pred += step
    trees, got = boost(codes, y, np.ones(len(y), bool), PLAIN, 1)
    assert np.allclose(got, pred) and np.allclose(trees.predict(codes), pred)


def test_loss_by_round_equals_a_re_evaluation():
    x, y = data()
    codes, is_train = bin_codes(x, bin_edges(x)), np.arange(len(y)) < 300
    trees, _ = boost(codes, y, is_train, PLAIN | {"subsample": 0.7, "colsample_bytree": 0.6}, 5, curve=True)
    for rounds in (1, 7, 30):
        cut = type(trees)(trees.base, trees.feature[:rounds], trees.cut[:rounds], trees.value[:rounds])
        loss = (cut.predict(codes) - y) ** 2
        assert np.allclose(trees.curve[rounds - 1], (loss[is_train].mean(), loss[~is_train].mean()))
    assert len(trees.curve) == 30 and trees.curve[-1][0] < trees.curve[0][0]


def test_penalties_shrink_leaves_and_constant_targets_stay():
    x, y = data()
    codes = bin_codes(x, bin_edges(x))
    wide = [np.ptp(boost(codes, y, np.ones(len(y), bool), PLAIN | {"reg_alpha": a, "reg_lambda": l}, 1)[1]) for a, l in ((0, 0.1), (0, 300), (1e9, 1))]
    assert wide[0] > wide[1] > wide[2] == 0
    assert np.allclose(boost(codes, np.full(len(y), 4.0), np.ones(len(y), bool), PLAIN, 1)[1], 4)


def test_published_space():
    draws = ML.draw_params(200, 1, ML.HYBRID_SPACE)
    assert all(300 <= d["n_estimators"] < 1000 and 3 <= d["max_depth"] <= 8 and 0.5 <= d["reg_lambda"] <= 3 and 0 <= d["reg_alpha"] <= 1 and 0.3 <= d["colsample_bytree"] <= 0.8 for d in draws)
    assert (ML.DRAWS, ML.FOLDS) == (20, 5) and ML.fold_starts(20, 5) == [(5, 8), (8, 11), (11, 14), (14, 17), (17, 20)] and ML.fold_starts(4, 5) == []


@pytest.fixture(scope="module")
def trips(spark):
    rows = [(i, i % 7, float(i % 50), None if i % 11 == 0 else float(i % 13), [float(i % 3), 1.0], 2.0 * (i % 50) + 5 * (i % 3)) for i in range(900)]
    return spark.createDataFrame(rows, "row_ord long, trip_creation_time long, a double, b double, v array<double>, actual_eta double")


SMALL = ML.SEARCH_SPACE | {"n_estimators": (20, 40)}


def test_search_fits_predicts_and_explains(spark, trips):
    model = ML.search_eta_model(trips, ["a", "b"], draws=3, folds=4, space=SMALL, vector_cols=("v",), val=trips.where("row_ord % 9 = 0"))
    assert {(d, f) for d, f, _ in model.scores} == {(d, f) for d in range(3) for f in range(4)}
    means = [np.mean([m for d, _, m in model.scores if d == i]) for i in range(3)]
    assert model.params == ML.draw_params(3, 42, SMALL)[int(np.argmin(means))]
    got = ML.predict(model, trips, keep=("row_ord",)).collect()
    assert len(got) == 900 and np.mean([abs(r["predicted_eta"] - r["actual_eta"]) for r in got]) < 8
    table = ML.importances(model, spark)
    rows = table.orderBy("rank").collect()
    assert abs(sum(r["importance"] for r in rows) - 1) < 1e-9 and rows[0]["feature"] == "a" and {r["feature"] for r in rows} == {"a", "b", "v_0", "v_1"}
    shares = {r["feature_group"]: r for r in ML.group_shares(table, top=2).collect()}
    assert abs(sum(r["share_pct"] for r in shares.values()) - 100) < 1e-9 and shares["v"]["features"] == 2 and sum(r["top"] for r in shares.values()) == 2
    assert ML.learning_curve(model, spark).count() == model.params["n_estimators"]


def test_bound_of_labelled_rows_and_empty_table(spark, trips):
    x, y = ML.labelled_rows(trips, ["a"], rows=100)
    again, _ = ML.labelled_rows(trips.repartition(7), ["a"], rows=100)
    assert x.shape == (100, 1) and (x == again).all()
    with pytest.raises(ValueError):
        ML.search_eta_model(trips.limit(0), ["a"])


def test_registered_search_beats_the_router(spark):
    """Really trains: 20 draws, 5 folds, 300-999 rounds."""
    from hubflow.plans.registry import QUERIES, load_all
    load_all()
    r = QUERIES["gbt_metrics"](spark, "/root/testdata/sf0.001").first()
    assert r["mae"] < r["router_mae"]
    search = QUERIES["gbt_search"](spark, "/root/testdata/sf0.001").collect()
    assert len(search) == 20 and all(s["folds"] == 5 and 300 <= s["n_estimators"] < 1000 for s in search) and sum(s["refit"] for s in search) == 1
    assert np.isclose(QUERIES["importances"](spark, "/root/testdata/sf0.001").agg(F.sum("importance")).first()[0], 1)
