"""Skip-gram embeddings with negative sampling, trained block by block.

The vocabulary is dealt into ``B`` blocks by a hash.  A pair (centre, context)
belongs to the bucket (block of the centre, block of the context).  An epoch has
``B`` rounds: in round ``r`` task ``i`` holds the centre vectors of block ``i`` and
the context vectors of block ``i + r``, and streams the pairs of that bucket past
them.  No two tasks of a round hold the same vector, so updates never conflict;
between rounds the blocks are written to the shared folder and exchanged.  A task's
memory is two blocks, and neither vectors nor vocabulary reach the driver.

Pairs are counted before training: one row per different pair with the weight a
shrinking window gives it on average (distance d of window w counts (w - d + 1) / w),
so a hub that makes a third of all steps costs as many rows as it has different
neighbours.  A heavy pair is swept several times with a share of its weight each.
Negatives are drawn from the context block at hand in proportion to frequency ** 0.75.
Steps are sized by Adagrad with one accumulator a vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hubflow.session import drop_table, ship_code, write_table

#: Vectors of a block and pairs of a bucket that a task is meant for.
BLOCK_ROWS, BUCKET_PAIRS = 100_000, 20_000_000
#: Pairs of one gradient step.
STEP = 512
#: A pair is swept once per ``UNIT`` occurrences, at most ``SWEEPS`` times an epoch.
UNIT, SWEEPS = 16, 64

_STATE = "block int, side int, idx int, n long, name string, vec array<float>, acc float"


def token_counts(walks: DataFrame, min_count: int = 1) -> DataFrame:
    """(hub_id, n): how often each hub stands in the walks."""
    return (walks.select(F.explode("walk").alias("hub_id")).where("hub_id is not null")
            .groupBy("hub_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count))


def window_pairs(walks: DataFrame, window: int = 10) -> DataFrame:
    """(center, context, weight): every ordered pair within ``window`` steps, weight = sum of window - distance + 1.

    Whole numbers, so the sums don't depend on the order of the rows.  A hub met again is its own context;
    missing hubs make no pairs but keep their place.
    """
    size = F.size("walk")
    near = (walks.where(size > 1)
            .select("walk", F.explode(F.sequence(F.lit(1), F.least(F.lit(window), size - 1))).alias("d"))
            .select("d", F.explode(F.arrays_zip(F.slice("walk", F.lit(1), size - F.col("d")).alias("a"),
                                                F.slice("walk", F.col("d") + 1, size - F.col("d")).alias("b"))).alias("x"))
            .select(F.col("x.a").alias("a"), F.col("x.b").alias("b"), (F.lit(window + 1) - F.col("d")).cast("long").alias("w"))
            .where("a is not null and b is not null"))
    ahead = near.groupBy("a", "b").agg(F.sum("w").alias("w"))
    both = F.explode(F.array(F.struct(F.col("a").alias("center"), F.col("b").alias("context")),
                             F.struct(F.col("b").alias("center"), F.col("a").alias("context"))))
    return ahead.select(both.alias("p"), "w").groupBy("p.center", "p.context").agg(F.sum("w").alias("weight"))


def _sum_rows(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different indexes and the sum of the value rows of each."""
    order = np.argsort(index, kind="stable")
    found = index[order]
    first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
    return found[first], np.add.reduceat(values[order], first, axis=0)


class _Side:
    """The vectors of one block, with their Adagrad accumulators, in the order of their index."""

    def __init__(self, parts: list[pa.RecordBatch], side: int, dim: int):
        table = pa.Table.from_batches(parts)
        table = table.filter(pc.equal(table.column("side"), side)).sort_by("idx")
        column = {name: table.column(name).combine_chunks() for name in ("block", "idx", "n", "name", "vec", "acc")}
        self.block, self.n, self.name = column["block"], column["n"], column["name"]
        self.idx = column["idx"].to_numpy()
        self.vec = np.array(column["vec"].flatten(), np.float32).reshape(-1, dim)
        self.acc = np.array(column["acc"], np.float32)
        self.side = side

    def step(self, index: np.ndarray, gradient: np.ndarray, rate: float) -> None:
        at, total = _sum_rows(index, gradient)
        self.acc[at] += (total * total).mean(axis=1)
        self.vec[at] += rate * total / np.sqrt(self.acc[at] + 1e-8)[:, None]

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        size, dim = self.vec.shape
        vec = pa.ListArray.from_arrays(np.arange(0, size * dim + 1, dim, dtype=np.int32), pa.array(self.vec.ravel()))
        columns = [self.block, pa.array(np.full(size, self.side, np.int32)), pa.array(self.idx, pa.int32()), self.n, self.name, vec, pa.array(self.acc)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _train(center: _Side, context: _Side, pairs: pa.RecordBatch, noise: np.ndarray, rng, negative: int, rate: float, unit: float) -> None:
    """One pass over the pairs of a batch."""
    c, o = (np.searchsorted(side.idx, pairs.column(name).to_numpy()) for side, name in ((center, "idx"), (context, "ctx")))
    seen = pairs.column("n").to_numpy() / unit
    sweeps = np.clip(np.ceil(seen / UNIT), 1, SWEEPS).astype(np.int64)
    weight = (seen / sweeps).astype(np.float32)
    for sweep in range(int(sweeps.max())):
        due = rng.permutation(np.flatnonzero(sweeps > sweep))
        for part in (due[at:at + STEP] for at in range(0, due.size, STEP)):
            i, j, w = c[part], o[part], weight[part]
            drawn = np.minimum(np.searchsorted(noise, rng.random((part.size, negative)) * noise[-1], "right"), noise.size - 1)
            others = np.concatenate((j[:, None], drawn), axis=1)
            u, v = center.vec[i], context.vec[others]
            pull = -_sigmoid(np.einsum("pd,pkd->pk", u, v))
            pull[:, 0] += 1
            pull[:, 1:][drawn == j[:, None]] = 0
            pull *= w[:, None]
            center.step(i, np.einsum("pk,pkd->pd", pull, v), rate)
            context.step(others.ravel(), (pull[:, :, None] * u[:, None, :]).reshape(-1, u.shape[1]), rate)


def _round(dim: int, window: int, negative: int, rate: float, seed: int, number: int):
    schema = pa.schema([("block", pa.int32()), ("side", pa.int32()), ("idx", pa.int32()), ("n", pa.int64()),
                        ("name", pa.string()), ("vec", pa.list_(pa.float32())), ("acc", pa.float32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts, sides = None, [], None

        def ready():
            center, context = (_Side(parts, side, dim) for side in (0, 1))
            noise = np.cumsum(np.array(context.n, np.float64) ** 0.75)
            return center, context, noise, np.random.default_rng([seed, number, bucket])

        # rows come by bucket, its vectors before its pairs
        for batch in batches:
            ids = batch.column("bucket").to_numpy() * 2 + batch.column("kind").to_numpy()
            cuts = np.flatnonzero(ids[1:] != ids[:-1]) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), ids.size]):
                if hi == lo:
                    continue
                if ids[lo] // 2 != bucket:
                    if parts:
                        sides = sides or ready()
                        yield from (s.batch(schema) for s in sides[:2] if s.idx.size)
                    bucket, parts, sides = int(ids[lo] // 2), [], None
                piece = batch.slice(lo, hi - lo)
                if ids[lo] % 2 == 0:
                    parts.append(piece)
                else:
                    sides = sides or ready()
                    _train(*sides[:2], piece, *sides[2:], negative, rate, window)
        if parts:
            sides = sides or ready()
            yield from (s.batch(schema) for s in sides[:2] if s.idx.size)

    return run


def skipgram(walks: DataFrame, dim: int = 64, window: int = 10, min_count: int = 1, epochs: int = 5, negative: int = 5,
             rate: float = 0.05, seed: int = 42, block_rows: int = BLOCK_ROWS, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """(hub_id, embedding array<double>) of every hub that stands at least ``min_count`` times in ``walks`` (walk array<string>).

    Rarer hubs make no pairs; walks of one hub give it its starting vector.  Empty walks give an empty result.
    The same walks, parameters and Arrow batch size give the same vectors.
    """
    spark = walks.sparkSession
    ship_code(spark)
    counts, counts_at = write_table(token_counts(walks, min_count), "skipgram-tokens")
    pairs, pairs_at = write_table(window_pairs(walks, window), "skipgram-pairs")
    blocks = max(1, math.ceil(counts.count() / block_rows), math.ceil(math.sqrt(pairs.count() / bucket_pairs)))
    vocabulary, vocabulary_at = write_table(
        counts.withColumn("block", F.pmod(F.xxhash64("hub_id"), F.lit(blocks)).cast("int"))
        .withColumn("idx", (F.row_number().over(Window.partitionBy("block").orderBy("hub_id")) - 1)), "skipgram-words")
    a, b = (vocabulary.select(F.col("hub_id").alias(name), F.col("block").alias(f"{side}_block"), F.col("idx").alias(out))
            for name, side, out in (("center", "a", "idx"), ("context", "b", "ctx")))
    numbered, numbered_at = write_table(
        pairs.join(a, "center").join(b, "context")
        .select(F.col("a_block").alias("bucket"), "idx", "ctx", F.col("weight").alias("n"), F.expr(f"pmod(b_block - a_block, {blocks})").alias("shift")),
        "skipgram-buckets", partition_by="shift")
    begin = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (
        (F.xxhash64(F.lit(seed), F.col("hub_id"), i).bitwiseAND(F.lit((1 << 24) - 1)).cast("double") / (1 << 24) - 0.5) / dim).cast("float"))
    word = (F.col("block"), F.col("idx"), F.col("n"), F.col("hub_id").alias("name"), F.lit(0.0).cast("float").alias("acc"))
    state, state_at = write_table(
        vocabulary.select(F.lit(0).alias("side"), *word, begin.alias("vec"))
        .unionByName(vocabulary.select(F.lit(1).alias("side"), *word, F.array_repeat(F.lit(0.0).cast("float"), dim).alias("vec"))), "skipgram-state")
    for number in range(epochs * blocks):
        shift = number % blocks
        held = state.select(F.expr(f"if(side = 0, block, pmod(block - {shift}, {blocks}))").alias("bucket"), F.lit(0).alias("kind"), "*",
                            F.lit(None).cast("int").alias("ctx"), F.lit(0).cast("long").alias("turn"))
        seen = numbered.where(F.col("shift") == shift).select(
            "bucket", F.lit(1).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in (("block", "int"), ("side", "int"))], "idx", "n",
            F.lit(None).cast("string").alias("name"), F.lit(None).cast("array<float>").alias("vec"), F.lit(None).cast("float").alias("acc"), "ctx",
            F.xxhash64(F.lit(seed + number), "idx", "ctx").alias("turn"))
        rows = held.unionByName(seen).repartitionById(blocks, "bucket").sortWithinPartitions("bucket", "kind", "turn", "side", "idx", "ctx")
        after = write_table(rows.mapInArrow(_round(dim, window, negative, rate, seed, number), _STATE), "skipgram-state")
        drop_table(spark, state_at)
        state, state_at = after
    drop_table(spark, counts_at, pairs_at, vocabulary_at, numbered_at)
    return state.where("side = 0").select(F.col("name").alias("hub_id"), F.col("vec").cast("array<double>").alias("embedding"))
