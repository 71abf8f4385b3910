"""Arrival-time regressors: boosted trees with a published random search.

The search is spread over the cluster by its settings.  All labelled rows of a fit take part:
they are binned (exact quantiles), numbered in time order and written to the shared folder once, some
bytes a row; every (draw, fold) is one Spark task that reads them, trains on the rows
before its fold and reports the fold's mean absolute error.  No row reaches the driver.
Predictions run over all rows.
"""

from __future__ import annotations

import pickle
import random
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hubflow.operators.boosting import BINS, Coded, Groups, Trees, bin_codes, boost, count_edges
from hubflow.operators.corridors import skew_safe_quantiles
from hubflow.operators.encoding import apply_medians, apply_target_encoding, fit_medians, fit_target_encoding
from hubflow.operators.ordering import global_position
from hubflow.session import drop_table, ship_code, write_table

# FIXED VALUES — the numeric model features, in natural order
NUMERIC_FEATURES = ["osrm_predicted_eta", "distance_km", "osrm_distance_km", "hour_of_day", "day_of_week",
                    "is_weekend", "is_cutoff", "start_scan_to_end_scan"]
HIGH_CARD = ["source_hub_id", "dest_hub_id"]
LOW_CARD = ["route_type"]
TARGET = "actual_eta"

# FIXED VALUES — search space of the boosted-tree draws (low, high)
SEARCH_SPACE = {
    "n_estimators": (300, 1000),      # integer, high exclusive
    "learning_rate": (0.01, 0.20),
    "max_depth": (3, 9),              # integer, high exclusive
    "subsample": (0.6, 1.0),
    "colsample_bytree": (0.5, 1.0),
    "min_child_weight": (1, 10),      # integer, high exclusive
    "reg_lambda": (0.5, 3.0),
    "reg_alpha": (0.0, 1.0),
}

# the embedding-augmented model samples fewer of its many columns
HYBRID_SPACE = SEARCH_SPACE | {"colsample_bytree": (0.3, 0.8)}
DRAWS, FOLDS = 20, 5
#: A vector column with at most this many different vectors is kept as one number a row; one with more by its elements.
VECTORS = 1 << 16


def encode_features(train: DataFrame, test: DataFrame, numeric=NUMERIC_FEATURES, high_card=HIGH_CARD,
                    target: str = TARGET, smoothing: float = 1.0, min_leaf: int = 20):
    """Target-encode ids (fit on train), impute numeric NULLs with train medians."""
    # all parameters are fitted on the rows as they are: an encoding's join adds no row, so it needn't be done to fit the next
    fitted = [(c, write_table(fit_target_encoding(train, c, target, smoothing=smoothing, min_leaf=min_leaf), "encoding")[0]) for c in high_card]  # one row per category
    med = fit_medians(train, numeric)
    for c, params in fitted:
        train = apply_target_encoding(train, params, c)
        test = apply_target_encoding(test, params, c)
    return apply_medians(train, med, numeric), apply_medians(test, med, numeric)


def feature_columns(numeric=NUMERIC_FEATURES, high_card=HIGH_CARD, low_card=LOW_CARD, extra=()):
    return list(numeric) + [f"{c}_te" for c in high_card] + list(low_card) + list(extra)


def draw_params(n: int, seed: int = 42, space: dict = SEARCH_SPACE) -> list[dict]:
    """``n`` seeded settings; a range of two integers is drawn as an integer below the high end."""
    rng = random.Random(seed)
    return [{k: rng.randrange(*r) if isinstance(r[0], int) else rng.uniform(*r) for k, r in space.items()} for _ in range(n)]


def feature_array(features, vector_cols=()) -> Column:
    """One array of doubles: the scalar columns (NULL: missing), then the vector columns' elements."""
    scalars = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features])
    return F.concat(scalars, *[F.col(c).cast("array<double>") for c in vector_cols]) if vector_cols else scalars


@dataclass
class EtaModel:
    """A fitted model: bin edges and trees, its setting, the (draw, fold, mae) of the search, names and groups of its inputs, and the number of rows it was fitted on."""
    features: list[str]
    vector_cols: list[str]
    edges: list[np.ndarray]
    trees: Trees
    params: dict
    scores: list[tuple[int, int, float]]
    rows: int

    def names(self) -> list[tuple[str, str]]:
        """(input, group): scalars in group base, vector elements in the group of their column."""
        width = (len(self.edges) - len(self.features)) // max(1, len(self.vector_cols))
        return [(f, "base") for f in self.features] + [(f"{v}_{i}", v) for v in self.vector_cols for i in range(width)]


def labelled_rows(train: DataFrame, features, label: str = TARGET, vector_cols=(), rows: int | None = None,
                  order=("trip_creation_time", "row_ord")) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, y) of the labelled rows in time order, for tables that fit the driver: all, or the first ``rows`` by a hash of the order key, the same in every run."""
    labelled = train.where(F.col(label).isNotNull())
    keys = [F.col(c).alias(f"__o{i}") for i, c in enumerate(order)]
    if rows is not None:
        place = F.xxhash64(*[F.col(c) for c in order])
        # the last hash that is taken comes from the keys alone; its filter then goes below the joins of the features, which meet the taken rows only
        last = labelled.select(place.alias("__h")).orderBy("__h").limit(rows).agg(F.max("__h")).first()[0]
        labelled = labelled.where(place <= F.lit(last))
    chosen = labelled.select(feature_array(features, vector_cols).alias("__x"), F.col(label).cast("double").alias("__y"), *keys)
    if rows is not None:
        chosen = chosen.orderBy(F.xxhash64(*[F.col(f"__o{i}") for i in range(len(order))]), *[f"__o{i}" for i in range(len(order))]).limit(rows)
    got = sorted(chosen.collect(), key=lambda r: tuple((v is not None, v) if v is not None else (False, 0) for v in r[2:]))
    return np.array([r["__x"] for r in got], float), np.array([r["__y"] for r in got], float)


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    """Rows x elements of a column of doubles or of arrays of doubles (NULL: missing); zeros have no sign."""
    if not pa.types.is_floating(column.type):
        column = column.flatten()
    return np.ascontiguousarray(column.to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 1))) + 0.0


def _keys(matrix: np.ndarray) -> np.ndarray:
    """Each row's doubles as one bytes value."""
    return matrix.view(np.dtype((np.void, matrix.shape[1] * 8))).ravel()


def value_counts(table: DataFrame, scalars: list[str], vectors: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray] | None]:
    """(values x elements, rows of the fit with each) of every column: of scalars with at most ``BINS`` values in these rows (without the missing one),
    of vector columns with at most ``VECTORS`` vectors in all rows; None for the others."""
    columns = [(c, BINS) for c in scalars] + [(c, VECTORS) for c in vectors]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[Counter | None] = [Counter() for _ in columns]
        for batch in batches:
            fit = batch.column(0).to_numpy(zero_copy_only=False)
            for j, (_, most) in enumerate(columns):
                if seen[j] is None:
                    continue
                values = _matrix(batch.column(j + 1), batch.num_rows)
                if j < len(scalars):
                    found, times = np.unique(values[fit & ~np.isnan(values[:, 0])], return_counts=True)
                    seen[j].update(dict(zip(_keys(found[:, None]).tolist(), times.tolist())))
                else:
                    seen[j].update(_keys(values[fit]).tolist())
                    seen[j].update(dict.fromkeys(_keys(values[~fit]).tolist(), 0))
                if len(seen[j]) > most:
                    seen[j] = None
        rows = [(j, v, n) for j, found in enumerate(seen) for v, n in ([(None, 0)] if found is None else found.items())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.int64()))], ["j", "value", "n"])

    ship_code(table.sparkSession)
    counted, path = write_table(table.select("__fit", *scalars, *vectors).mapInArrow(count, "j int, value binary, n long").groupBy("j", "value").agg(F.sum("n").alias("n")), "values")
    sizes = counted.groupBy("j").agg(F.count("*").alias("size"), F.count_if(F.col("value").isNull()).alias("over")).collect()
    over = [r["j"] for r in sizes if r["over"] or r["size"] > columns[r["j"]][1]]
    found: dict[int, list] = {j: [] for j in range(len(columns)) if j not in over}
    for r in counted.where(~F.col("j").isin(over)).collect():  # at most BINS values or VECTORS vectors of a column
        found[r["j"]].append((bytes(r["value"]), r["n"]))
    drop_table(table.sparkSession, path)
    out: dict = dict.fromkeys(c for c, _ in columns)
    for j, rows in found.items():
        out[columns[j][0]] = (np.array([np.frombuffer(v) for v, _ in sorted(rows)]).reshape(len(rows), -1 if rows else 1), np.array([n for _, n in sorted(rows)], np.int64))
    return out


@dataclass
class FitRows:
    """The binned rows of a fit: their table (``pos``, a column a group, ``__y``) and its folder, the number of rows and of those that are fitted on (the first), bin edges and groups."""
    table: DataFrame
    path: str
    n: int
    n_fit: int
    edges: list[np.ndarray]
    groups: Groups


def fit_rows(train: DataFrame, features, label: str = TARGET, vector_cols=(), order=("trip_creation_time", "row_ord"), val: DataFrame | None = None) -> FitRows:
    """All labelled rows of ``train`` in time order, then those of ``val``, binned by the exact quantiles of ``train``; no labelled row in ``train`` raises."""
    spark = train.sparkSession
    keys, scalars, vectors = ([f"__{x}{i}" for i in range(len(of))] for x, of in (("o", order), ("s", features), ("v", vector_cols)))

    def known_number(c) -> Column:
        return F.when(~F.isnan(c), c)

    def narrow(df: DataFrame, fit: bool) -> DataFrame:
        return df.where(F.col(label).isNotNull()).select(
            F.lit(fit).alias("__fit"), *[F.col(c).alias(k) for c, k in zip(order, keys)], *[known_number(F.col(c).cast("double")).alias(s) for c, s in zip(features, scalars)],
            *[F.col(c).cast("array<double>").alias(v) for c, v in zip(vector_cols, vectors)], F.col(label).cast("double").alias("__y"))

    table, raw = write_table(narrow(train, True) if val is None else narrow(train, True).unionByName(narrow(val, False)), "labelled")
    n, n_fit = table.agg(F.count("*"), F.count_if("__fit")).first()
    if not n_fit:
        drop_table(spark, raw)
        raise ValueError("no labelled rows to fit on")
    known = value_counts(table, scalars, vectors)
    for v in [v for v in vectors if known[v] is None]:
        parts = [f"{v}_{i}" for i in range(table.select(F.size(v)).first()[0])]
        table = table.select("*", *[known_number(F.get(v, F.lit(i))).alias(p) for i, p in enumerate(parts)])
        known |= value_counts(table, parts, [])
        scalars, vectors[vectors.index(v):vectors.index(v) + 1] = scalars + parts, parts
    columns = [*scalars[:len(features)], *vectors]
    vectors = [c for c in vectors if c not in scalars]

    many = [c for c in scalars if known[c] is None]
    quantiles = skew_safe_quantiles(table.where("__fit"), [], [(f"{c}_q{q}", c, q / BINS) for c in many for q in range(1, BINS)]).first() if many else {}
    cuts = {c: [np.unique(np.array([quantiles[f"{c}_q{q}"] for q in range(1, BINS)]))] if known[c] is None else [count_edges(x, known[c][1]) for x in known[c][0].T] for c in columns}
    first = dict(zip(columns, np.cumsum([0] + [len(cuts[c]) for c in columns]).tolist()))
    edges = [e for c in columns for e in cuts[c]]

    # scalars are grouped by products of their bins; a vector column is a group whose combinations are its vectors
    groups = Groups.of(np.array([len(e) + 1 for e in edges]), [first[c] for c in scalars], n)
    column_at = {first[c]: i for i, c in enumerate(scalars)}
    products = [[column_at[j] for j in m] for m in groups.members]
    for v in vectors:
        groups.add(range(first[v], first[v] + len(cuts[v])), bin_codes(known[v][0], cuts[v]))
    ids = [{k: i for i, k in enumerate(_keys(known[v][0]).tolist())} for v in vectors]
    shared = spark.sparkContext.broadcast((groups, products, [cuts[c][0] for c in scalars], ids))
    n_keys, n_scalars, codes = 1 + len(keys), len(scalars), [f"__g{g}" for g in range(len(groups.members))]
    names = ["__fit", *keys, *codes, "__y"]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups_, products_, cuts_, ids_ = shared.value
        for batch in batches:
            values = [_matrix(c, batch.num_rows) for c in batch.columns[n_keys:-1]]
            bins = bin_codes(np.concatenate(values[:n_scalars], axis=1), cuts_) if n_scalars else None
            out = [groups_.product_codes(g, bins[:, at]) for g, at in enumerate(products_)] + [[of[k] for k in _keys(v).tolist()] for v, of in zip(values[n_scalars:], ids_)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keys], *[pa.array(x, pa.int32()) for x in out], batch.columns[-1]], names)

    schema = table.select("__fit", *keys, *[F.lit(0).alias(c) for c in codes], "__y").schema
    coded = table.select("__fit", *keys, *scalars, *vectors, "__y").mapInArrow(code, schema)
    placed = global_position(coded, [~F.col("__fit"), *keys, "__y", *codes])
    rows, path = write_table(placed.select("pos", *codes, "__y"), "fit-rows")
    drop_table(spark, raw)
    return FitRows(rows, path, n, n_fit, edges, groups)


def load_rows(batches: Iterator[pa.RecordBatch], end: int, groups: Groups) -> tuple[Coded, np.ndarray]:
    """The first ``end`` rows of a fit and their labels, from their batches in any order."""
    codes, y = np.zeros((len(groups.members), end), np.int16 if max(map(len, groups.bins)) < 1 << 15 else np.int32), np.zeros(end)
    for batch in batches:
        pos = batch.column(0).to_numpy()
        for g in range(len(codes)):
            codes[g, pos] = batch.column(g + 1).to_numpy()
        y[pos] = batch.columns[-1].to_numpy()
    return Coded(codes, groups), y


def fold_starts(n: int, folds: int) -> list[tuple[int, int]]:
    """(first test row, end) of every expanding fold of n rows in time order; empty folds are left out."""
    size = n // (folds + 1)
    return [(n - size * (folds - i), n - size * (folds - i - 1)) for i in range(folds)] if size else []


def fit_settings(rows: FitRows, cells: list[tuple[dict, int, int, int]], keep: bool = False) -> list[tuple[bytes | None, float | None]]:
    """For each (setting, seed, first, end): trees (if they are kept, with their loss by round) and the mean absolute error on the rows from first to end, fitted on those before.

    A cell is a job of one task that reads its rows from the shared folder; as many run at once as the cluster has cores.
    """
    spark = rows.table.sparkSession
    ship_code(spark)
    shared = spark.sparkContext.broadcast(rows.groups)

    def fit(cell):
        setting, seed, first, end = cell

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            data, y = load_rows(batches, end, shared.value)
            trees, pred = boost(data, y, np.arange(end) < first, setting, seed, curve=keep)
            error = float(np.abs(pred[first:] - y[first:]).mean()) if first < end else None
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(trees) if keep else None], pa.binary()), pa.array([error], pa.float64())], ["trees", "error"])

        return tuple(rows.table.where(F.col("pos") < end).coalesce(1).mapInArrow(run, "trees binary, error double").collect()[0])

    with ThreadPoolExecutor(max(1, spark.sparkContext.defaultParallelism)) as pool:
        return list(pool.map(inheritable_thread_target(spark)(fit), cells))


def search_scores(rows: FitRows, settings: list[dict], folds: int, seed: int) -> list[tuple[int, int, float]]:
    """(draw, fold, mean absolute error): every setting on every expanding fold, the largest first."""
    starts = fold_starts(rows.n_fit, folds)
    cells = sorted(((d, f) for d in range(len(settings)) for f in range(len(starts))),
                   key=lambda c: -settings[c[0]]["n_estimators"] * settings[c[0]]["max_depth"] * starts[c[1]][0])
    errors = fit_settings(rows, [(settings[d], seed + d, *starts[f]) for d, f in cells])
    return sorted((d, f, error) for (d, f), (_, error) in zip(cells, errors))


def search_eta_model(train: DataFrame, features, draws: int = DRAWS, folds: int = FOLDS, space: dict = SEARCH_SPACE, seed: int = 42, vector_cols=(),
                     label: str = TARGET, order=("trip_creation_time", "row_ord"), val: DataFrame | None = None) -> EtaModel:
    """The published random search on all labelled rows: ``draws`` settings of ``space`` on ``folds`` expanding folds, the least mean error refit on all rows of the fit.

    With ``val`` (same columns) the refit also follows its loss by round, on all its rows.
    An empty ``train`` can't be fitted and raises.
    """
    rows = fit_rows(train, features, label, vector_cols, order, val)
    settings = draw_params(draws, seed, space)
    scores = search_scores(rows, settings, folds, seed) if draws > 1 else []
    by_draw = [np.mean([m for d, _, m in scores if d == i]) if scores else 0.0 for i in range(draws)]
    best = settings[int(np.argmin(by_draw))]
    trees = pickle.loads(fit_settings(rows, [(best, seed, rows.n_fit, rows.n)], keep=True)[0][0])
    drop_table(train.sparkSession, rows.path)
    return EtaModel(list(features), list(vector_cols), rows.edges, trees, best, scores, rows.n_fit)


def predict(model: EtaModel, df: DataFrame, keep=("trip_id",), label: str = TARGET, positive: bool = False) -> DataFrame:
    """``keep``, actual_eta, predicted_eta (and osrm_predicted_eta where there is one) of every row."""
    spark = df.sparkSession
    ship_code(spark)
    shared = spark.sparkContext.broadcast(model)
    cols = [*keep, F.col(label).alias("actual_eta"), *[c for c in ("osrm_predicted_eta",) if c in df.columns]]
    src = df.select(*cols, feature_array(model.features, model.vector_cols).alias("__x"))
    schema = src.drop("__x").withColumn("predicted_eta", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(batch.num_columns - 1)
            matrix = x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, len(shared.value.edges)))
            out = shared.value.trees.predict(bin_codes(matrix, shared.value.edges))
            if positive:
                out = np.maximum(out, 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], [*batch.schema.names[:-1], "predicted_eta"])

    out = src.mapInArrow(run, schema)
    return out.select(*keep, "actual_eta", "predicted_eta", *[c for c in ("osrm_predicted_eta",) if c in df.columns])


def importances(model: EtaModel, spark: SparkSession) -> DataFrame:
    """(feature, importance, feature_group, rank): each input's share of the gain of all cuts, rank 1 the largest (ties by name)."""
    gain = model.trees.gain / max(model.trees.gain.sum(), 1e-300)
    rows = sorted(((n, float(v), g) for (n, g), v in zip(model.names(), gain)), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame([(*r, i + 1) for i, r in enumerate(rows)], "feature string, importance double, feature_group string, rank int")


def group_shares(table: DataFrame, top: int = 15) -> DataFrame:
    """(feature_group, share_pct, features, top): share of the importance and the ``top`` inputs that fall into each group."""
    total = table.agg(F.sum("importance").alias("all"))
    return (table.groupBy("feature_group").agg(F.sum("importance").alias("s"), F.count("*").alias("features"), F.count_if(F.col("rank") <= top).alias("top"))
            .crossJoin(F.broadcast(total)).select("feature_group", F.try_divide(F.col("s") * 100, F.col("all")).alias("share_pct"), "features", "top"))


def learning_curve(model: EtaModel, spark: SparkSession) -> DataFrame:
    """(round, train_loss, val_loss): mean squared error after each round on the rows of the fit and on the validation rows (NaN without any), kept while training."""
    return spark.createDataFrame([(i + 1, a, b) for i, (a, b) in enumerate(model.trees.curve)], "round int, train_loss double, val_loss double")
