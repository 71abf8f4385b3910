"""Cleaning operators (null audit, rule masks, de-duplication, caps).

Rules are data: a list of (name, keep-predicate) pairs shared by the filter,
the per-rule breakdown and the drop report, so all three read the same
definition and each is one pass over the input.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubflow.schema import (CRITICAL_COLUMNS, LOWER_FACTOR, MIN_DIST_KM, MIN_TIME_MIN,
                            UPPER_FACTOR)

__all__ = ["EDA_RULES", "MODEL_RULES", "rule_predicate", "null_audit", "drop_critical_nulls", "keep_mask",
           "apply_rules", "rule_breakdown", "drop_report", "positive_times", "dedup_first",
           "clip", "clean_trips", "model_clean", "finite_only", "hub_members"]

# FIXED VALUES — rule labels and bounds of the six-rule EDA mask
# (label, column, comparison that KEEPS the row, bound)
EDA_RULES: list[tuple[str, str, str, float]] = [
    ("actual_time < 1 min", "actual_time", ">=", MIN_TIME_MIN),
    ("osrm_time < 1 min", "osrm_time", ">=", MIN_TIME_MIN),
    ("factor < 0.2 (too fast)", "factor", ">=", LOWER_FACTOR),
    ("factor > 10 (implausible)", "factor", "<=", UPPER_FACTOR),
    ("segment_factor < 0 (error)", "segment_factor", ">=", 0.0),
    ("distance <= 0.1 km", "actual_distance_to_destination", ">=", MIN_DIST_KM),
]
# Five-rule variant of the model preprocess (no segment_factor rule).
MODEL_RULES = [r for r in EDA_RULES if r[1] != "segment_factor"]


def rule_predicate(rule) -> Column:
    """Keep-predicate of one rule (NULL compares as not kept)."""
    _, col, op, bound = rule
    c = F.col(col)
    return {">=": c >= bound, ">": c > bound, "<=": c <= bound, "<": c < bound}[op]


def null_audit(df: DataFrame) -> DataFrame:
    """(column, null_count, null_pct) for every column, one aggregate pass."""
    n = F.count(F.lit(1))
    aggs = [n.alias("__n")] + [F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}")
                               for i, c in enumerate(df.columns)]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{c}', n{i}" for i, c in enumerate(df.columns))
    return (wide.selectExpr("__n", f"stack({len(df.columns)}, {stack}) as (column_name, null_count)")
            .select("column_name", "null_count",
                    F.round(F.col("null_count") / F.col("__n") * 100, 3).alias("null_pct")))


def drop_critical_nulls(df: DataFrame, cols=CRITICAL_COLUMNS) -> DataFrame:
    return df.na.drop(subset=[c for c in cols if c in df.columns])


def keep_mask(rules=EDA_RULES) -> Column:
    """AND of all keep predicates; NULL compares as not kept."""
    return reduce(lambda a, b: a & b, [rule_predicate(r) for r in rules])


def apply_rules(df: DataFrame, rules=EDA_RULES) -> DataFrame:
    return df.filter(keep_mask(rules))


def rule_breakdown(df: DataFrame, rules=EDA_RULES) -> DataFrame:
    """Rows violating each rule (overlapping), single aggregate + unpivot."""
    wide = df.agg(*[F.count_if(~rule_predicate(r)).alias(f"r{i}") for i, r in enumerate(rules)])
    stack = ", ".join(f"'{r[0]}', r{i}" for i, r in enumerate(rules))
    return wide.selectExpr(f"stack({len(rules)}, {stack}) as (rule, rows_hit)")


def drop_report(df: DataFrame, rules=EDA_RULES) -> DataFrame:
    """rows_before, rows_after, rows_dropped, drop_pct in one pass."""
    keep = keep_mask(rules)
    return (df.agg(F.count(F.lit(1)).alias("rows_before"), F.count_if(keep).alias("rows_after"))
            .withColumn("rows_dropped", F.col("rows_before") - F.col("rows_after"))
            .withColumn("drop_pct", F.try_divide(F.col("rows_dropped") * 100.0, F.col("rows_before"))))


def positive_times(df: DataFrame, actual="segment_actual_time", osrm="segment_osrm_time") -> DataFrame:
    return df.filter((F.col(actual) > 0) & (F.col(osrm) > 0))


def dedup_first(df: DataFrame, keys, order_col: str = "row_ord") -> DataFrame:
    """Keep the first row per key in ``order_col`` order.

    Expressed as ``min_by`` over a struct of the row: a partial (map-side)
    aggregate, so a key holding a third of all rows is collapsed on every
    mapper before the shuffle instead of landing whole in one window task.
    """
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(f"`{c}`") for c in rest])
    return (df.groupBy(*keys).agg(F.min_by(packed, F.col(order_col)).alias("__r"))
            .select(*keys, *[F.col(f"__r.`{c}`").alias(c) for c in rest]))


def clip(c: Column, lo=None, hi=None) -> Column:
    out = c
    if hi is not None:
        out = F.least(out, F.lit(hi))
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    return out


def clean_trips(df: DataFrame, rules=EDA_RULES) -> DataFrame:
    """Critical-null drop + rule mask (the cleaned trip table)."""
    return apply_rules(drop_critical_nulls(df), rules)


def model_clean(df: DataFrame) -> DataFrame:
    """Model preprocess cleaning: null drop incl. timestamp, five-rule mask."""
    return apply_rules(drop_critical_nulls(df, CRITICAL_COLUMNS + ["trip_creation_time"]), MODEL_RULES)


def finite_only(df: DataFrame, cols) -> DataFrame:
    """±inf and NaN become missing and the row is dropped."""
    cond = reduce(lambda a, b: a & b,
                  [F.col(c).isNotNull() & ~F.isnan(F.col(c)) & (F.abs(F.col(c)) != F.lit(float("inf")))
                   for c in cols])
    return df.filter(cond)


def hub_members(df: DataFrame, hubs: DataFrame, hub_col: str = "hub_id",
                src="source_center", dst="destination_center") -> DataFrame:
    """Rows whose both endpoints are known hubs (two semi joins on the hub list).

    No broadcast hint: the hub list has no proven bound, so AQE picks a
    broadcast from the measured size at run time and keeps the shuffle
    join otherwise.
    """
    h = hubs.select(F.col(hub_col).alias("__h")).distinct()
    return (df.join(h, F.col(src) == F.col("__h"), "left_semi")
              .join(h, F.col(dst) == F.col("__h"), "left_semi"))
