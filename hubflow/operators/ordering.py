"""Global order without a single-partition window.

``global_position`` range-partitions on the order key, sorts inside each
partition, counts rows per partition (one tiny row per partition), turns the
counts into offsets and adds the in-partition index.  Rows never leave their
partition; only the per-partition counts (bounded by the partition count)
are combined.  With a total order (tie key included) the result is
deterministic and survives recomputation after executor loss (the indexed
rows are checkpointed, so a lost task re-reads them instead of re-sampling).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hubflow.session import write_table

_LOW33 = (1 << 33) - 1


def global_position(df: DataFrame, order_cols, pos_col: str = "pos",
                    num_partitions: int | None = None) -> DataFrame:
    """Add a 0-based global position in ``order_cols`` order (ascending)."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    # Range bounds come from a sample of the input; the input's row order after
    # a shuffle is not deterministic, so the partitioned + indexed rows are
    # written once to the reliable checkpoint folder and both the per-partition
    # counts and the final rows read that same copy.
    # The input is read twice by the range shuffle (bound sampling, then the
    # exchange); it is cached for that one step so its plan runs once.
    level = df.storageLevel
    owned = not (level.useMemory or level.useDisk)  # a cache the caller holds stays his
    src = df.persist() if owned else df
    ranged, _ = write_table(src.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
                            .withColumn("__pid", F.spark_partition_id())
                            .withColumn("__idx", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW33))), "positions")
    if owned:
        src.unpersist()
    counts = ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__cnt"))
    offsets = counts.select(
        "__pid",
        (F.sum("__cnt").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("__off"))
    # offsets has one row per partition: a proven size bound for the broadcast
    return (ranged.join(F.broadcast(offsets), "__pid")
            .withColumn(pos_col, F.coalesce(F.col("__off"), F.lit(0)) + F.col("__idx"))
            .drop("__pid", "__idx", "__off"))


def exact_quantile(df: DataFrame, col: str, q: float, tie_cols=()) -> DataFrame:
    """Exact linear-interpolation quantile of one column as a one-row frame.

    Sort-based: no single task holds a map of all distinct values, so the
    global P99 of a 100 TB column stays distributed.  Equal values are told
    apart by ``tie_cols`` (default: a hash of the row), so a value that a third
    of the rows share is spread over several partitions.
    """
    tie = F.xxhash64(*(tie_cols or df.columns)).alias("__tie")
    vals = df.select(F.col(col).alias("__v"), tie).filter(F.col("__v").isNotNull())
    positioned = global_position(vals, ["__v", "__tie"], "__pos")
    n = positioned.agg(F.count(F.lit(1)).alias("__n"))  # reads the materialised positions
    target = n.select("__n", (F.lit(q) * (F.col("__n") - 1)).alias("__t"))
    picked = (positioned.crossJoin(F.broadcast(target))
              .filter((F.col("__pos") == F.floor("__t")) | (F.col("__pos") == F.ceil("__t"))))
    return picked.agg(
        (F.min("__v") + (F.max("__v") - F.min("__v")) * (F.first("__t") - F.floor(F.first("__t"))))
        .alias("q"))


def grouped_quantiles_sorted(df: DataFrame, keys, col: str, qs) -> DataFrame:
    """Exact per-group linear-interpolation quantiles by sorting, not by hashing.

    Rows are range-partitioned on (keys, value, hash of the row), so neither a
    group nor a value holding a third of all rows lands in one task; each
    group's start position and size come from partial aggregates, and only the
    (at most two) rows at each target rank are picked out.  Returns keys + one
    column ``q{i}`` per entry of ``qs``; groups without a value have no row and
    a NULL key is a group of its own.
    """
    keys = list(keys)
    vals = df.select(*keys, F.col(col).alias("__v"), F.xxhash64(*df.columns).alias("__tie")).filter(F.col("__v").isNotNull())
    pos = global_position(vals, [*keys, "__v", "__tie"], "__pos").drop("__tie")
    groups = pos.groupBy(*keys).agg(F.min("__pos").alias("__start"), F.count(F.lit(1)).alias("__n"))
    targets = groups.select(*keys, "__start", "__n", F.posexplode(F.array(*[
        (F.lit(float(q)) * (F.col("__n") - 1)) for q in qs])).alias("__qi", "__t"))
    want = targets.select(*keys, "__qi", "__t", (F.col("__start") + F.floor("__t")).alias("__lo"),
                          (F.col("__start") + F.ceil("__t")).alias("__hi"))
    # a position is unique over all groups, so it alone is the join key (keys may be NULL)
    lo = want.join(pos.select(F.col("__pos").alias("__lo"), F.col("__v").alias("__vlo")), "__lo")
    both = lo.join(pos.select(F.col("__pos").alias("__hi"), F.col("__v").alias("__vhi")), "__hi")
    interp = F.col("__vlo") + (F.col("__vhi") - F.col("__vlo")) * (F.col("__t") - F.floor("__t"))
    res = both.select(*keys, "__qi", interp.alias("__q"))
    return res.groupBy(*keys).pivot("__qi", list(range(len(qs)))).agg(F.first("__q")).select(
        *keys, *[F.col(str(i)).alias(f"q{i}") for i in range(len(qs))])
