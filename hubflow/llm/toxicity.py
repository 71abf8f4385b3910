"""Toxicity scores: a linear classifier on character n-grams scaled by naive Bayes log-count ratios (operator 5).

A text's features are the distinct hashed 5- and 8-byte grams of its lower-cased whole text.
Each is scaled by its log-count ratio r between toxic and other training texts; grams
that are rare in training or tell little (|r| < ``MIN_RATIO``) are left out. A logistic
regression on the scaled features gives the score.

The classifier is fitted on a bounded sample of labelled rows (``per_class`` of each
label, the first by a hash of the id, and at most ``SAMPLE_GRAMS`` distinct grams over
all of them, so that very long texts make it fewer rows). Counts by gram are summed by
Spark; the driver gets the log-count ratios of the grams that are kept and, of the
sample's rows, these grams only. Scoring runs over all rows and whole texts in Arrow
batches with a broadcast weight vector of fixed size.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubflow.llm.common import id_text, map_rows, ship_package, stage, unstage
from hubflow.llm.hashing import LOWER, gram_hashes

GRAMS, BITS = (5, 8), 20
#: Bound of the training sample: labelled rows of each class.
PER_CLASS = 1000
#: Bound of the training sample: distinct grams of its rows, added up (about ten for each byte of text).
SAMPLE_GRAMS = 1 << 25
MIN_DOCS, MIN_RATIO = 5, 1.0
STEPS, RATE, RIDGE = 200, 0.3, 1e-2
#: Bytes of a text that are hashed at once; neighbouring blocks overlap by a gram.
BLOCK = 1 << 20


def grams(text: bytes | None) -> list[np.ndarray]:
    """Hashed character grams of the whole text, a blank before and after, with repeats, in parts."""
    raw = LOWER[np.frombuffer(b" " + (text or b"") + b" ", np.uint8)]
    return [(gram_hashes(raw[at:at + BLOCK + n - 1], n) >> np.uint64(64 - BITS)).astype(np.int32) for n in GRAMS for at in range(0, raw.size, BLOCK)]


def features(text: bytes | None) -> np.ndarray:
    """Distinct hashed character grams of the whole text."""
    return np.unique(np.concatenate(grams(text)))


@dataclass
class Model:
    """weights: one per hashed gram, already scaled by the log-count ratios. decides: both labels were seen in training."""
    weights: np.ndarray
    bias: float
    decides: bool = True

    def score(self, text: bytes | None) -> float:
        known = np.concatenate([g[self.weights[g] != 0] for g in grams(text)])  # few: cheaper to tell apart than all
        z = self.bias + float(self.weights[np.unique(known)].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit(rows: list[tuple[np.ndarray, int]], ratio: np.ndarray) -> Model:
    """Naive-Bayes-scaled logistic regression on (grams with a ratio, label) rows; with one label or none, a constant near the label's share."""
    size = 1 << BITS
    y = np.array([label for _, label in rows], float)
    if not rows or y.min() == y.max():
        share = (y.sum() + 1) / (y.size + 2)
        return Model(np.zeros(size), float(np.log(share / (1 - share))), decides=False)
    length = np.array([x.size for x, _ in rows])
    flat, row = np.concatenate([x for x, _ in rows]), np.repeat(np.arange(len(rows), dtype=np.int32), length)
    scale = ratio[flat]
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (y.size - y.sum()))  # both classes weigh the same
    w, bias = np.zeros(size), 0.0
    squares, square = np.full(size, 1e-8), 1e-8
    for _ in range(STEPS):  # gradient steps with a rate for each weight
        z = np.bincount(row, scale * w[flat], y.size) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * weight
        grad = np.bincount(flat, scale * error[row], size) + RIDGE * w
        squares += grad * grad
        w -= RATE * grad / np.sqrt(squares)
        square += error.sum() ** 2
        bias -= RATE * error.sum() / np.sqrt(square)
    return Model((w * ratio).astype(np.float32), bias)


def log_count_ratios(sample: DataFrame) -> np.ndarray:
    """The log-count ratio of every gram of the sample (x, y) that is frequent and telling enough, else 0; the counts are summed by Spark."""
    size = 1 << BITS

    def counts(cols):
        pos, neg = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for x, y in zip(cols["x"], cols["y"]):
            (pos if y else neg)[np.frombuffer(x, np.int32)] += 1  # a row's grams are distinct
        at = np.flatnonzero(pos + neg)
        yield from zip(at.tolist(), pos[at].tolist(), neg[at].tolist())

    summed = stage(map_rows(sample.select("x", "y"), counts, "gram int, pos long, neg long", rows=50_000).groupBy("gram").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "grams")
    totals = summed.agg((F.coalesce(F.sum("pos"), F.lit(0)) + size).alias("p"), (F.coalesce(F.sum("neg"), F.lit(0)) + size).alias("n"))
    value = F.log((F.col("pos") + 1) / F.col("p")) - F.log((F.col("neg") + 1) / F.col("n"))
    kept = summed.crossJoin(F.broadcast(totals)).where(F.col("pos") + F.col("neg") >= MIN_DOCS).select("gram", value.alias("ratio")).where(F.abs("ratio") >= MIN_RATIO).toArrow()
    unstage(summed)
    ratio = np.zeros(size)
    ratio[kept["gram"].to_numpy()] = kept["ratio"].to_numpy()
    return ratio


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, usable: Column | None = None) -> Model:
    """Fit on at most ``per_class`` labelled rows of each class among those that ``usable`` admits.

    The rows are the first by a hash of doc_id, so the choice is the same in every run, as
    long as ``SAMPLE_GRAMS`` isn't reached (then the classes take turns; each has a row at
    least); null ids and labels other than 0 and 1 aren't used, repeated ids count once.
    """
    spark = docs.sparkSession
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    if usable is not None:
        known = known.where(usable)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [known.where(f"y = {y}").orderBy(*order).limit(per_class).collect() for y in (1, 0)]  # 2 * per_class ids
    label_of = {r["doc_id"]: r["y"] for r in chosen[0] + chosen[1]}
    ids = spark.sparkContext.broadcast(label_of)

    def rows(cols):
        for doc_id, text in zip(cols["doc_id"], cols["text"]):
            if doc_id in ids.value:
                yield doc_id, ids.value[doc_id], features(text).tobytes()

    found = stage(map_rows(id_text(docs), rows, "doc_id long, y int, x binary", rows=16).dropDuplicates(["doc_id"]), "labelled")
    size_of = {r["doc_id"]: r["n"] for r in found.select("doc_id", (F.octet_length("x") / 4).cast("long").alias("n")).collect()}
    taken, grams_so_far = set(), 0
    turns = [[r["doc_id"] for r in side if r["doc_id"] in size_of] for side in chosen]
    for i in range(max(map(len, turns))):
        for side in turns:
            if i < len(side) and (i == 0 or grams_so_far + size_of[side[i]] <= SAMPLE_GRAMS):
                taken.add(side[i])
                grams_so_far += size_of[side[i]]
    sample = found.where(F.col("doc_id").isin(sorted(taken))) if len(taken) < len(size_of) else found
    ratio = log_count_ratios(sample)
    telling = spark.sparkContext.broadcast(ratio != 0)

    def reduced(cols):
        for doc_id, x in zip(cols["doc_id"], cols["x"]):
            x = np.frombuffer(x, np.int32)
            yield doc_id, x[telling.value[x]].tobytes()

    got = map_rows(sample.select("doc_id", "x"), reduced, "doc_id long, x binary", rows=64).toArrow().sort_by("doc_id")
    unstage(found)
    return fit([(np.frombuffer(x.as_py(), np.int32), label_of[i.as_py()]) for i, x in zip(got["doc_id"], got["x"])], ratio)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of every row; null and empty texts get the classifier's bias. Other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(cols):
        for doc_id, text in zip(cols["doc_id"], cols["text"]):
            s = shared.value.score(text)
            yield doc_id, s, int(s >= 0.5)

    return map_rows(id_text(docs), rows, "doc_id long, score double, predicted int", rows=20_000)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the rows kept from training: crc32 of the id as text is divisible by 5 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted; labels of held-out rows are never read.

    Repeated rows get equal scores; an empty ``labels`` gives 0.5 everywhere.
    """
    model = train(docs, labels, per_class=per_class, usable=~held_out())
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier doesn't reject (score under 0.5).

    Without usable labels of both classes there is nothing to tell texts apart by: all rows stay.
    """
    fitted = train(docs, labels, per_class=per_class, usable=~held_out())
    if not fitted.decides:
        return docs
    ship_package(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fitted)

    @F.pandas_udf("boolean")
    def clean(text):
        import pandas as pd
        return pd.Series([model.value.score(t.encode("utf-8", "surrogatepass") if t is not None else None) < 0.5 for t in text], dtype=bool)

    return docs.where(clean("text"))
