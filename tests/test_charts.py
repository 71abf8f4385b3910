"""Binned density curves against the direct sum, artefacts that were cut short or changed, drop counts."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hubflow.operators import profile as P
from hubflow.sources import artifacts as A
from hubflow.sources.predictions import clean_predictions, drop_counts


def test_binned_curve_is_near_the_direct_sum(spark):
    rng = random.Random(6)
    rows = [("a", rng.gauss(0, 1)) for _ in range(400)] + [("b", rng.choice([1.0, 1.0, 50.0])) for _ in range(300)] + [(None, rng.random()) for _ in range(50)]
    rows += [("flat", 3.0)] * 5 + [("a", None), ("lone", 1.0)]
    got = {}
    for r in P.binned_kde(spark.createDataFrame(rows, "g string, v double").repartition(4), "v", "g").collect():
        got.setdefault(r["g"], []).append((r["grid_index"], r["x"], r["density"]))
    assert set(got) == {"a", "b", None}
    for g, curve in got.items():
        v = [x for k, x in rows if k == g and x is not None]
        n, mean = len(v), sum(v) / len(v)
        h = math.sqrt(sum((x - mean) ** 2 for x in v) / (n - 1)) * n ** -0.2
        assert sorted(i for i, _, _ in curve) == list(range(200))
        for _, x, d in curve:
            assert abs(d - sum(math.exp(-0.5 * ((x - y) / h) ** 2) for y in v) / (n * h * math.sqrt(2 * math.pi))) < 0.001 / h
    assert P.binned_kde(spark.createDataFrame([], "g string, v double"), "v", "g").count() == 0


@pytest.fixture
def predictions(spark):
    return spark.createDataFrame([("m", float(i), float(i + 1)) for i in range(50)], "model string, actual_eta double, predicted_eta double")


def test_artifact_comes_back_whole(spark, predictions, tmp_path):
    path = A.write_artifact(predictions, str(tmp_path / "p"), "predictions")
    back = A.read_artifact(spark, path, "predictions")
    assert back.schema == predictions.schema and sorted(map(tuple, back.collect())) == sorted(map(tuple, predictions.collect()))
    with pytest.raises(A.ArtifactError, match="kind"):
        A.read_artifact(spark, path, "metrics")
    with pytest.raises(KeyError):
        A.write_artifact(predictions.drop("model"), str(tmp_path / "q"), "predictions")
    empty = A.write_artifact(predictions.limit(0), str(tmp_path / "e"), "predictions")
    assert A.read_artifact(spark, empty, "predictions").count() == 0


def test_a_write_cut_short_or_changed_is_refused(spark, predictions, tmp_path, monkeypatch):
    path = str(tmp_path / "cut")
    with monkeypatch.context() as m:
        m.setattr(A, "_facts", lambda df: 1 / 0)  # dies after the table, before the manifest
        with pytest.raises(ZeroDivisionError):
            A.write_artifact(predictions, path, "predictions")
    with pytest.raises(A.ArtifactError, match="no manifest"):
        A.read_artifact(spark, path, "predictions")
    A.write_artifact(predictions, path, "predictions")
    predictions.limit(3).write.mode("append").parquet(f"{path}/table")
    with pytest.raises(A.ArtifactError, match="agree"):
        A.read_artifact(spark, path, "predictions")


def test_drop_counts_by_model_and_too_few(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", 1.0, 1.0)] * 120 + [("a", 0.0, 1.0), ("a", nan, 1.0), ("a", 1.0, -inf), ("a", None, 1.0), ("b", 2.0, 2.0)]
    df = spark.createDataFrame(rows, "model string, actual_eta double, predicted_eta double")
    got = {r["model"]: tuple(r)[1:] for r in drop_counts(df, by="model").collect()}
    assert got == {"a": (124, 3, 1, 120, False), "b": (1, 0, 0, 1, True)}
    assert tuple(drop_counts(df).first()) == (125, 3, 1, 121, False)
    assert clean_predictions(df).count() == 121 and clean_predictions(df.where(F.col("model") == "b")).count() == 1
