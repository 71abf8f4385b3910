"""Exact order statistics by refining counts: no sort, no shuffle of the rows, nothing written.

A rank is bracketed by two approximate quantiles (a sketch of fixed size per task);
exact counts then tell how many rows lie before, on and between the two.  The rank is on
one of them or in the open interval between, which is bracketed again; each pass leaves
some thousandths of the rows, so a table of any size takes a few passes.  The last few
values of a bracket are counted one by one.  A value held by a third of all rows is
dropped from the bracket as soon as it is one of its ends.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hubflow.session import drop_table, write_table

#: A bracket of at most this many rows is counted value by value.
FEW = 10_000
#: Share of a bracket's rows that its ends are set apart from the rank, and the accuracy of the sketch (its error is below a third of that).
MARGIN, ACCURACY = 1 / 3000, 10_000
MAX_PASSES = 40


def order_statistics(values: DataFrame, ranks: list[int]) -> list:
    """The values at the 0-based ``ranks`` of the one column of ``values`` in ascending order; nulls aren't counted.

    A rank outside the column's rows gives None.  Raises if a bracket stops shrinking
    (only where more than ``FEW`` different integers round to one double).
    """
    col = values.columns[0]
    v = F.col(col)
    values = values.where(v.isNotNull())
    kept = values.storageLevel
    owned = not (kept.useMemory or kept.useDisk)
    if owned:
        values = values.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = values.count()
        found = {r: None for r in ranks if not 0 <= r < n}
        # rank -> (lo, hi, rows up to and with lo, rows between, margin): open interval, None is no bound
        brackets = {r: (None, None, 0, n, MARGIN) for r in ranks if 0 <= r < n}

        def inside(lo, hi):
            return (F.lit(True) if lo is None else v > F.lit(lo)) & (F.lit(True) if hi is None else v < F.lit(hi))

        for _ in range(MAX_PASSES):
            wide = {r: b for r, b in brackets.items() if b[3] > FEW}
            if not wide:
                break
            asked = {(b[0], b[1], b[2], b[3], b[4], r) for r, b in wide.items()}
            asked = sorted(asked, key=lambda x: x[-1])
            ends = values.agg(*[F.percentile_approx(F.when(inside(lo, hi), v), [max(0.0, (r - below) / size - m), min(1.0, (r - below + 1) / size + m)], ACCURACY)
                                for lo, hi, below, size, m, r in asked]).first()
            counts = values.agg(*[c for (lo, hi, *_), e in zip(asked, ends)
                                  for c in (F.count_if(v < F.lit(e[0])), F.count_if(v == F.lit(e[0])), F.count_if((v > F.lit(e[0])) & (v < F.lit(e[1]))), F.count_if(v == F.lit(e[1])))]).first()
            for i, ((lo, hi, below, size, m, r), (a, b)) in enumerate(zip(asked, ends)):
                less, on_a, between, on_b = counts[4 * i:4 * i + 4]
                if less <= r < less + on_a:
                    found[r] = a
                elif less + on_a <= r < less + on_a + between:
                    brackets[r] = (a, b, less + on_a, between, m)
                    continue
                elif a != b and less + on_a + between <= r < less + on_a + between + on_b:
                    found[r] = b
                else:
                    brackets[r] = (lo, hi, below, size, min(1.0, m * 4))  # the sketch was too coarse: wider
                    continue
                del brackets[r]
        for r, (lo, hi, below, size, _) in brackets.items():
            if size > FEW:
                raise RuntimeError(f"the bracket of rank {r} has not shrunk after {MAX_PASSES} passes")
            at = below
            for row in values.where(inside(lo, hi)).groupBy(col).count().orderBy(col).collect():  # at most FEW values
                at += row["count"]
                if r < at:
                    found[r] = row[0]
                    break
        return [found[r] for r in ranks]
    finally:
        if owned:
            values.unpersist()


def exact_quantile(df: DataFrame, col: str, q: float) -> float | None:
    """Exact linear-interpolation quantile of a column; None if it has no value."""
    values = df.select(F.col(col).cast("double").alias("__v")).where(F.col("__v").isNotNull()).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        t = q * (values.count() - 1)
        if t < 0:
            return None
        lo, hi = order_statistics(values, [math.floor(t), math.ceil(t)])
        return lo + (hi - lo) * (t - math.floor(t))
    finally:
        values.unpersist()


def boundaries(df: DataFrame, ts: str, tie: str, ranks: list[int]) -> list[tuple]:
    """(ts, tie) of the rows at the 0-based ``ranks`` in the order of ts, tie (nulls first); ties are told apart by ``tie`` only."""
    keys = df.select(F.col(ts).alias("__ts"), F.col(tie).alias("__tie")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        no_ts = keys.where("__ts is null").count()
        times = order_statistics(keys.select("__ts"), [r - no_ts for r in ranks])
        out = []
        for r, t in zip(ranks, times):
            same = keys.where(F.col("__ts").eqNullSafe(F.lit(t)))
            before = 0 if r < no_ts else no_ts + keys.where(F.col("__ts") < F.lit(t)).count()
            no_tie = same.where("__tie is null").count()
            out.append((t, order_statistics(same.select("__tie"), [r - before - no_tie])[0]))
        return out
    finally:
        keys.unpersist()


def group_quantiles(df: DataFrame, keys, specs) -> DataFrame:
    """Exact linear-interpolation quantiles of every group: keys and the names of ``specs`` ((name, column, q)).

    For large groups, all columns, groups and quantiles at once, in three passes over the
    cached keys and columns: sketches bracket every rank by two values, counts tell the rows
    before each bracket, and the rows inside are counted value by value.  No row is sorted
    or moved but those in a bracket (some thousandths, and a value that many rows share is
    one of them).  A sketch that misses its rank costs time only: the bracket then reaches to the
    least or largest value.  NULL keys are a group, a group without a value has NULL.
    """
    keys, columns = list(keys), list(dict.fromkeys(c for _, c, _ in specs))
    at = [columns.index(c) for _, c, _ in specs]
    narrow = df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[F.col(c).cast("double").alias(f"__v{i}") for i, c in enumerate(columns)])
    narrow = narrow.persist(StorageLevel.MEMORY_AND_DISK)
    ks, gs = [f"__k{i}" for i in range(len(keys))], [f"__g{i}" for i in range(len(keys))]
    v = [F.col(f"__v{i}") for i in at]

    def beside(table: DataFrame) -> DataFrame:
        # one row a group of at least the hot size: a bound of rows / HOT_GROUP_ROWS
        table = F.broadcast(table.withColumnsRenamed(dict(zip(ks, gs))))
        return narrow.join(table, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(g)) for k, g in zip(ks, gs)])) if ks else narrow.crossJoin(table)

    def ends(i: int) -> Column:
        return F.percentile_approx(f"__v{i}", [min(1.0, max(0.0, q + m)) for _, c, q in specs if c == columns[i] for m in (-MARGIN, MARGIN)], ACCURACY)

    try:
        sketch = narrow.groupBy(*ks).agg(*[x for i in range(len(columns)) for x in (
            F.count(f"__v{i}").alias(f"__n{i}"), F.min(f"__v{i}").alias(f"__min{i}"), F.max(f"__v{i}").alias(f"__max{i}"), ends(i).alias(f"__e{i}"))])
        nth = [sum(c == specs[j][1] for _, c, _ in specs[:j]) for j in range(len(specs))]
        sketch, first = write_table(sketch.select("*", *[x for j, i in enumerate(at) for x in (
            F.get(f"__e{i}", F.lit(2 * nth[j])).alias(f"__lo{j}"), F.get(f"__e{i}", F.lit(2 * nth[j] + 1)).alias(f"__hi{j}"),
            (F.lit(float(specs[j][2])) * (F.col(f"__n{i}") - 1)).alias(f"__t{j}"))]).drop(*[f"__e{i}" for i in range(len(columns))]), "sketch")
        counts = beside(sketch.select(*ks, *[f"__{x}{j}" for j in range(len(specs)) for x in ("lo", "hi")])).groupBy(*gs).agg(*[x for j in range(len(specs)) for x in (
            F.count_if(v[j] < F.col(f"__lo{j}")).alias(f"__less{j}"), F.count_if(v[j] <= F.col(f"__hi{j}")).alias(f"__upto{j}"))])
        met = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(g)) for k, g in zip(ks, gs)], F.lit(True))
        known = sketch.join(counts, met) if ks else sketch.crossJoin(counts)
        early, late = ([F.col(f"__{x}{j}") for j in range(len(specs))] for x in ("less", "upto"))
        bracket, second = write_table(known.select(*ks, *[x for j, i in enumerate(at) for x in (
            F.when(early[j] <= F.floor(f"__t{j}"), F.col(f"__lo{j}")).otherwise(F.col(f"__min{i}")).alias(f"__lo{j}"),
            F.when(early[j] <= F.floor(f"__t{j}"), early[j]).otherwise(F.lit(0)).alias(f"__less{j}"),
            F.when(late[j] > F.ceil(f"__t{j}"), F.col(f"__hi{j}")).otherwise(F.col(f"__max{i}")).alias(f"__hi{j}"), F.col(f"__t{j}"))]), "brackets")
        inside = [F.coalesce((v[j] >= F.col(f"__lo{j}")) & (v[j] <= F.col(f"__hi{j}")), F.lit(False)) for j in range(len(specs))]
        near = beside(bracket).filter(reduce(lambda a, b: a | b, inside)).select(*ks, F.explode(F.array(*[
            F.when(inside[j], F.struct(F.lit(j).alias("spec"), v[j].alias("v"), F.col(f"__less{j}").alias("less"), F.col(f"__t{j}").alias("t")))
            for j in range(len(specs))])).alias("__s")).filter("__s is not null").select(*ks, "__s.*")
        found = near.groupBy(*ks, "spec", "less", "t", "v").agg(F.count(F.lit(1)).alias("c"))
        upto = F.col("less") + F.sum("c").over(Window.partitionBy(*ks, "spec").orderBy("v"))
        low, high = F.floor("t"), F.ceil("t")
        ranked = found.withColumn("upto", upto).groupBy(*ks, "spec", "t").agg(F.min(F.when(F.col("upto") > low, F.col("v"))).alias("a"), F.min(F.when(F.col("upto") > high, F.col("v"))).alias("b"))
        value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((high - F.col("t")) * F.col("a") + (F.col("t") - low) * F.col("b"))
        wide = ranked.groupBy(*ks).agg(*[F.max(F.when(F.col("spec") == j, value)).alias(f"__q{j}") for j in range(len(specs))])
        wide = wide.withColumnsRenamed(dict(zip(ks, gs)))
        groups = bracket.select(*ks, F.lit(1).alias("__one"))
        out = groups.join(wide, met, "left") if ks else groups.join(wide, F.lit(True), "left")
        out, _ = write_table(out.select(*[F.col(k).alias(name) for k, name in zip(ks, keys)], *[F.col(f"__q{j}").alias(o) for j, (o, _, _) in enumerate(specs)]), "quantiles")
        drop_table(df.sparkSession, first, second)
        return out
    finally:
        narrow.unpersist()
