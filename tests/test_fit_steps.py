"""Fit and prediction steps that grow with the table: encoders are fitted on the rows as they are, trees are walked level by level."""

import numpy as np
from pyspark.sql import functions as F

from hubflow.operators import models as ML
from hubflow.operators.boosting import bin_codes, bin_edges, boost


def test_encoders_and_medians_are_fitted_without_joins(spark, monkeypatch):
    seen = []
    for name in ("fit_target_encoding", "fit_medians"):
        plain = getattr(ML, name)

        def fit(train, *args, plain=plain, **kw):
            seen.append(train)
            return plain(train, *args, **kw)
        monkeypatch.setattr(ML, name, fit)
    rows = [(f"h{i % 3}" if i % 5 else None, f"d{i % 4}", float(i), None if i % 7 == 0 else float(i % 9)) for i in range(120)]
    df = spark.createDataFrame(rows, "source_hub_id string, dest_hub_id string, actual_eta double, x double")
    tr, te = ML.encode_features(df, df.where("actual_eta < 30"), numeric=["x"], min_leaf=2)
    assert len(seen) == 3 and all(f.columns == df.columns for f in seen)
    got = tr.orderBy("actual_eta").collect()
    median = df.agg(F.median("x")).first()[0]
    assert len(got) == 120 and te.count() == 30 and got[7]["x"] == median and got[8]["x"] == 8.0
    prior = df.agg(F.avg("actual_eta")).first()[0]
    assert got[0]["source_hub_id_te"] == prior and len({r["dest_hub_id_te"] for r in got}) == 4


def test_prediction_walks_the_levels_of_each_tree():
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=500), rng.integers(0, 5, 500), rng.normal(size=500)])
    x[rng.random(500) < 0.1, 2] = np.nan
    y = 4 * x[:, 0] + (x[:, 1] == 3) + rng.normal(size=500) / 4
    codes = bin_codes(x, bin_edges(x))
    params = dict(n_estimators=25, learning_rate=0.3, max_depth=6, subsample=0.8, colsample_bytree=0.7, min_child_weight=40, reg_lambda=1.0, reg_alpha=0.1)
    trees, _ = boost(codes, y, np.ones(500, bool), params, 2)
    plain = np.full(500, trees.base)
    for feature, cut, value in zip(trees.feature, trees.cut, trees.value):
        for i, row in enumerate(codes):
            at = 0
            while feature[at] >= 0:
                at = 2 * at + 1 + int(row[feature[at]] > cut[at])
            plain[i] += value[at]
    assert np.array_equal(trees.predict(codes), plain) and trees.predict(codes[:0]).shape == (0,)
    # no level below the last cut of a tree is walked
    assert all(len(levels) == (int(np.flatnonzero(f >= 0)[-1] + 1).bit_length() if (f >= 0).any() else 0) for (levels, _), f in zip(trees.levels(), trees.feature))
    flat, _ = boost(codes, np.full(500, 4.0), np.ones(500, bool), params, 2)
    assert np.array_equal(flat.predict(codes), np.full(500, 4.0)) and all(not levels for levels, _ in flat.levels())
