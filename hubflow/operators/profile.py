"""Profiles and the data behind charts: grouped statistics, describe,
histograms, kernel densities, box statistics, correlation.

Everything is one or two aggregate passes; charts themselves are not drawn.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubflow.functions.features import signed_pct_error
from hubflow.operators.corridors import skew_safe_quantiles, with_quantiles
from hubflow.operators.hubs import hub_inventory
from hubflow.operators.ordering import global_position
from hubflow.session import write_table


def _maybe_round(df: DataFrame, digits, cols) -> DataFrame:
    if digits is None:
        return df
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


def tod_summary(clean: DataFrame, value: str = "factor", digits: int | None = None) -> DataFrame:
    """count / mean / median / std of ``value`` per time-of-day bucket."""
    out = with_quantiles(clean.filter(F.col("time_of_day").isNotNull()), ["time_of_day"],
                         [F.count(value).alias("count"), F.avg(value).alias("mean"),
                          F.stddev_samp(value).alias("std")], [("median", value, 0.5)])
    return _maybe_round(out, digits, ["mean", "median", "std"])


def hourly_band(clean: DataFrame, value: str = "factor") -> DataFrame:
    """Per hour: mean, median, std and the mean ± std band."""
    return (with_quantiles(clean, ["hour_of_day"], [F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")],
                           [("median", value, 0.5)])
        .withColumn("band_lo", F.col("mean") - F.col("std"))
        .withColumn("band_hi", F.col("mean") + F.col("std")))


def dow_median(clean: DataFrame, value: str = "factor") -> DataFrame:
    return skew_safe_quantiles(clean, ["day_of_week"], [("median_factor", value, 0.5)])


def route_hour_median(clean: DataFrame, value: str = "factor") -> DataFrame:
    return skew_safe_quantiles(clean, ["route_type", "hour_of_day"], [("median_factor", value, 0.5)])


def cutoff_by_hour(clean: DataFrame) -> DataFrame:
    """Cutoff rate (%) per hour with the global rate on every row."""
    glob = clean.agg((F.avg(F.col("is_cutoff").cast("double")) * 100).alias("global_cutoff_pct"))
    return (clean.groupBy("hour_of_day").agg(
        (F.avg(F.col("is_cutoff").cast("double")) * 100).alias("cutoff_pct"),
        F.count(F.lit(1)).alias("segments"))
        .crossJoin(F.broadcast(glob)))


def describe(df: DataFrame, cols, qs=(0.05, 0.25, 0.5, 0.75, 0.95, 0.99), by: str | None = None,
             approx: bool = False) -> DataFrame:
    """count, mean, std, min, percentiles, max for each column (long format, one pass)."""
    aggs, specs = [], []
    for i, c in enumerate(cols):
        aggs += [F.count(c).alias(f"c{i}"), F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}"),
                 F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
        specs += [(f"p{i}_{j}", c, q) for j, q in enumerate(qs)]
    wide = with_quantiles(df, [by] if by else [], aggs, specs, approx=approx)
    wide = wide.select("*", *[F.array(*[F.col(f"p{i}_{j}") for j in range(len(qs))]).alias(f"p{i}")
                              for i in range(len(cols))])
    qnames = [f"p{int(round(q * 100)):02d}" for q in qs]
    structs = []
    for i, c in enumerate(cols):
        fields = [F.lit(c).alias("column_name"), F.col(f"c{i}").alias("count"), F.col(f"m{i}").alias("mean"),
                  F.col(f"s{i}").alias("std"), F.col(f"lo{i}").cast("double").alias("min")]
        fields += [F.col(f"p{i}")[j].cast("double").alias(n) for j, n in enumerate(qnames)]
        fields.append(F.col(f"hi{i}").cast("double").alias("max"))
        structs.append(F.struct(*fields))
    keep = [by] if by else []
    return wide.select(*keep, F.explode(F.array(*structs)).alias("s")).select(*keep, "s.*")


def baseline_deviation(clean: DataFrame, tol: float = 15.0) -> DataFrame:
    """Router MAE, mean/median factor and % of rows within ±tol % of the router estimate."""
    err = signed_pct_error(F.col("actual_time"), F.col("osrm_time"))
    out = with_quantiles(clean, [], [
        F.avg(F.abs(F.col("actual_time") - F.col("osrm_time"))).alias("osrm_mae_min"),
        F.avg("factor").alias("mean_factor"),
        (F.avg((F.abs(err) <= tol).cast("double")) * 100).alias("pct_within_15")],
        [("median_factor", "factor", 0.5)])
    return out.select("osrm_mae_min", "mean_factor", "median_factor", "pct_within_15")


def table_profile(trips: DataFrame, clean: DataFrame) -> DataFrame:
    """One row: raw/clean rows, split counts, distinct hubs, date range, route counts, cutoff %."""
    raw = trips.agg(F.count(F.lit(1)).alias("raw_rows"))
    c = clean.agg(
        F.count(F.lit(1)).alias("clean_rows"),
        F.count_if(F.col("data") == "training").alias("training_rows"),
        F.count_if(F.col("data") == "test").alias("test_rows"),
        F.min(F.to_date("trip_creation_time")).alias("first_date"),
        F.max(F.to_date("trip_creation_time")).alias("last_date"),
        F.count_if(F.col("route_type") == "FTL").alias("ftl_rows"),
        F.count_if(F.col("route_type") == "Carting").alias("carting_rows"),
        (F.avg(F.col("is_cutoff").cast("double")) * 100).alias("cutoff_rate_pct"))
    hubs = hub_inventory(clean).agg(F.count(F.lit(1)).alias("distinct_hubs"))
    edges = (clean.select("source_center", "destination_center", "route_type").distinct()
             .agg(F.count(F.lit(1)).alias("distinct_edges")))
    return raw.crossJoin(c).crossJoin(hubs).crossJoin(edges)


def tod_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("time_of_day").agg(F.count(F.lit(1)).alias("segments"))


def correlation(df: DataFrame, cols) -> DataFrame:
    """Pearson matrix in long form (col_a, col_b, corr), one aggregate pass.

    A constant column gives NULL (no division by zero under ANSI mode).
    """
    pairs = [(a, b) for a in cols for b in cols]
    wide = df.agg(*[F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b)).alias(f"k{i}")
                    for i, (a, b) in enumerate(pairs)])
    structs = [F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"k{i}").alias("corr"))
               for i, (a, b) in enumerate(pairs)]
    return wide.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def histogram(df: DataFrame, col: str, bins: int, lo: float | None = None, hi: float | None = None,
              clip_lo: float | None = None, clip_hi: float | None = None) -> DataFrame:
    """Fixed-width histogram (last bin closed).  Range from the data unless given."""
    v = F.col(col).cast("double")
    if clip_lo is not None or clip_hi is not None:
        v = F.greatest(F.least(v, F.lit(clip_hi if clip_hi is not None else float("inf"))),
                       F.lit(clip_lo if clip_lo is not None else float("-inf")))
    vals = df.select(v.alias("__v")).filter(F.col("__v").isNotNull())
    if lo is None or hi is None:
        rng = vals.agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    else:
        rng = df.sparkSession.range(1).select(F.lit(float(lo)).alias("__lo"), F.lit(float(hi)).alias("__hi"))
    flat = F.col("__lo") == F.col("__hi")  # a constant column: one unit around the value
    rng = rng.select(F.when(flat, F.col("__lo") - 0.5).otherwise(F.col("__lo")).alias("__lo"),
                     F.when(flat, F.col("__hi") + 0.5).otherwise(F.col("__hi")).alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    b = F.least(F.floor((F.col("__v") - F.col("__lo")) / width), F.lit(bins - 1)).cast("int")
    return (vals.crossJoin(F.broadcast(rng)).filter((F.col("__v") >= F.col("__lo")) & (F.col("__v") <= F.col("__hi")))
            .groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"),
                                          F.first(F.col("__lo")).alias("__lo"), F.first(width).alias("__w"))
            .select("bin", (F.col("__lo") + F.col("bin") * F.col("__w")).alias("bin_lo"),
                    (F.col("__lo") + (F.col("bin") + 1) * F.col("__w")).alias("bin_hi"), "count"))


def kde(df: DataFrame, col: str, points: int = 200, by: str | None = None) -> DataFrame:
    """Gaussian kernel density on a grid (Scott bandwidth n^-1/5 · std).

    Grid = ``points`` evenly spaced values over [min - range/2, max + range/2].
    Every grid point is in the result.  Data are first reduced to (value,
    count); each distinct value adds to all ``points`` grid points of its group
    (a fixed number), summed by a partial aggregate on every mapper.
    A group without spread has no curve.
    """
    keys = [by] if by else []
    vals = df.select(*keys, F.col(col).cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    stats = vals.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.stddev_samp("__v").alias("__sd"),
        F.min("__v").alias("__min"), F.max("__v").alias("__max"))
    stats = (stats.withColumn("__h", F.col("__sd") * F.pow(F.col("__n"), F.lit(-0.2)))
             .withColumn("__g0", F.col("__min") - (F.col("__max") - F.col("__min")) / 2)
             .withColumn("__step", (F.col("__max") - F.col("__min")) * 2 / (points - 1)))
    counts = vals.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c"))
    j = counts.join(stats, keys) if keys else counts.crossJoin(F.broadcast(stats))
    near = (j.filter(F.col("__h") > 0)
            .withColumn("grid_index", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))))
    x = F.col("__g0") + F.col("grid_index") * F.col("__step")
    z = (x - F.col("__v")) / F.col("__h")
    contrib = F.col("__c") * F.exp(-0.5 * z * z) / (F.col("__n") * F.col("__h") * math.sqrt(2 * math.pi))
    return (near.groupBy(*keys, "grid_index").agg(F.first(x).alias("x"), F.sum(contrib).alias("density")))


#: Bins per bandwidth of a binned curve, and the bandwidths beyond which a kernel is 0 for double precision.
BINS_PER_BANDWIDTH, REACH = 8, 9


def binned_kde(df: DataFrame, col: str, by: str, points: int = 200) -> DataFrame:
    """The density curves of ``kde`` from binned counts: (by, grid_index, x, density), a curve per value of ``by`` (NULL is one).

    Each value is shared between the two neighbouring nodes of a grid an eighth of the
    bandwidth wide, which is a sum on every mapper; the nodes' sums are then convolved
    with the kernel, each over the grid points within ``REACH`` bandwidths of it.  So the
    rows grow with range and bandwidth, not with the number of distinct values.  The error
    against the direct sum is below 0.001 / bandwidth at every point.  Groups without
    spread, and values that are NULL, have no part.
    """
    vals = df.select(F.col(by).alias("__k"), F.col(col).cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    stats = (vals.groupBy("__k").agg(F.count(F.lit(1)).alias("__n"), F.stddev_samp("__v").alias("__sd"), F.min("__v").alias("__min"), F.max("__v").alias("__max"))
             .filter(F.col("__sd") > 0).withColumn("__h", F.col("__sd") * F.pow(F.col("__n"), F.lit(-0.2)))
             .withColumn("__w", F.col("__h") / BINS_PER_BANDWIDTH).withColumn("__g0", F.col("__min") - (F.col("__max") - F.col("__min")) / 2)
             .withColumn("__step", (F.col("__max") - F.col("__min")) * 2 / (points - 1)).withColumnRenamed("__k", "__sk"))
    stats, _ = write_table(stats, "curves")  # a row a curve, of known size: the values aren't shuffled by curve
    at = (F.col("__v") - F.col("__min")) / F.col("__w")
    left = F.floor(at)
    shared = (vals.join(stats, F.col("__k").eqNullSafe(F.col("__sk")))
              .select("__k", F.inline(F.array(F.struct(left.alias("__bin"), (1 - (at - left)).alias("__c")), F.struct((left + 1).alias("__bin"), (at - left).alias("__c"))))))
    nodes = shared.groupBy("__k", "__bin").agg(F.sum("__c").alias("__c")).join(stats, F.col("__k").eqNullSafe(F.col("__sk"))).drop("__sk")
    v = F.col("__min") + F.col("__bin") * F.col("__w")
    first = F.greatest(F.lit(0), F.ceil((v - REACH * F.col("__h") - F.col("__g0")) / F.col("__step")))
    last = F.least(F.lit(points - 1), F.floor((v + REACH * F.col("__h") - F.col("__g0")) / F.col("__step")))
    near = nodes.filter(first <= last).withColumn("grid_index", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    z = (F.col("__g0") + F.col("grid_index") * F.col("__step") - v) / F.col("__h")
    sums = near.groupBy("__k", "grid_index").agg(F.sum(F.col("__c") * F.exp(-0.5 * z * z)).alias("__s"))
    grid = stats.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    out = grid.join(sums, F.col("__sk").eqNullSafe(F.col("__k")) & (F.col("__i") == F.col("grid_index")), "left")
    return out.select(F.col("__sk").alias(by), F.col("__i").alias("grid_index"), (F.col("__g0") + F.col("__i") * F.col("__step")).alias("x"),
                      (F.coalesce("__s", F.lit(0.0)) / (F.col("__n") * F.col("__h") * math.sqrt(2 * math.pi))).alias("density"))


def box_stats(df: DataFrame, value: str, by: str) -> DataFrame:
    """Quartiles, 1.5·IQR whiskers (most extreme data inside the fences) and outlier count."""
    q = (with_quantiles(df.filter(F.col(value).isNotNull()), [by], [F.count(F.lit(1)).alias("n")],
                        [("q1", value, 0.25), ("median", value, 0.5), ("q3", value, 0.75)])
         .withColumn("iqr", F.col("q3") - F.col("q1")))
    j = df.select(by, value).join(q, by)
    lo_f = F.col("q1") - 1.5 * F.col("iqr")
    hi_f = F.col("q3") + 1.5 * F.col("iqr")
    inside = (F.col(value) >= lo_f) & (F.col(value) <= hi_f)
    return j.groupBy(by, "q1", "median", "q3", "iqr", "n").agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_lo"),
        F.max(F.when(inside, F.col(value))).alias("whisker_hi"),
        F.count_if(~inside).alias("outliers"))


def error_curve(df: DataFrame, actual: str = "actual_time", estimate: str = "osrm_time",
                tie: str = "row_ord") -> DataFrame:
    """Sorted signed % error curve: (rank, pct_error) over every row, no single-task window."""
    e = df.select(signed_pct_error(F.col(actual), F.col(estimate)).alias("pct_error"), tie)
    return global_position(e, ["pct_error", tie], "rank").select("rank", "pct_error")


def sample_rows(df: DataFrame, n: int, seed: int = 42, key: str = "row_ord") -> DataFrame:
    """Seeded sample of exactly min(n, rows) rows: the first n by a hash of a stable key (each task keeps n at most)."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(n)
