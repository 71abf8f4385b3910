"""Trip-segment sources.

``read_trips_csv`` is the production scan (CSV shards, explicit schema, one
scan for all shards).  ``trips_from_tables`` derives the same 24-column
contract from the TPC-H-like test tables so every operator runs on real,
growing input; it is a plain Spark join plan (lineitem ⋈ orders on the order
key is the one large shuffle, the dimension tables are small per nation).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hubflow.schema import MODEL_RENAME, TIMESTAMP_COLUMNS, TRIP_SCHEMA
from hubflow.session import small_methods


def _hub(nation_key: Column) -> Column:
    return F.concat(F.lit("HUB"), F.lpad(nation_key.cast("string"), 2, "0"))


def trips_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trip view over the given tables (dense 25-hub network).

    Arithmetic is dyadic (k/256, x/4) so sums and medians are exact in any
    evaluation order; ``row_ord`` is a deterministic tie key.
    """
    small_methods(spark)
    # round half away from zero on the double itself (no per-row BigDecimal):
    # the price bucket feeds the ratio, which filters and projections reuse
    cents = F.abs(F.col("l_extendedprice") * 100)
    rounded = F.signum(F.col("l_extendedprice")) * F.when(cents - F.floor(cents) >= 0.5, F.ceil(cents)) \
        .otherwise(F.floor(cents))
    # what depends on the line item or the nation alone is worked out before the shuffle: fewer bytes move, filters don't repeat it
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        (rounded.cast("bigint") % 100).alias("_bucket"), (F.col("l_linestatus") == "O").alias("_cutoff"))
    od = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    cu = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    su = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey")
    na = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    sn = na.select(F.col("n_nationkey").alias("sn_key"), F.col("n_name").alias("sname"), _hub(F.col("n_nationkey")).alias("shub"))
    cn = na.select(F.col("n_nationkey").alias("cn_key"), F.col("n_name").alias("dname"), _hub(F.col("n_nationkey")).alias("dhub"))

    # orders meet their customer and suppliers their nation before the line items, which are then shuffled once
    ordered = od.join(cu, F.col("o_custkey") == cu.c_custkey).join(cn, F.col("c_nationkey") == cn.cn_key)
    b = (li.join(ordered, li.l_orderkey == F.col("o_orderkey"))
         .join(su.join(sn, F.col("s_nationkey") == sn.sn_key), F.col("l_suppkey") == F.col("s_suppkey")))

    q = F.col("l_quantity")
    osrm = F.lit(10.0) + F.lit(2.0) * q
    lane = (F.col("s_nationkey") * 7 + F.col("c_nationkey") * 13) % 11
    ratio = (F.when(F.col("l_partkey") % 211 == 0, F.lit(12.0))
             .otherwise((F.lit(10) + F.col("_bucket")) * (F.lit(3) + lane) / F.lit(256.0)))
    hours = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 5) % 24
    seg_zero = F.col("l_partkey") % 307 == 0

    b = b.select("*", osrm.alias("_osrm"), ratio.alias("_ratio"))
    o, r = F.col("_osrm"), F.col("_ratio")
    return b.select(
        F.when(F.col("o_orderdate") < F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"), "training")
         .otherwise("test").alias("data"),
        (F.col("o_orderdate") + F.make_dt_interval(hours=hours.cast("int"))).alias("trip_creation_time"),
        F.when(F.col("l_linenumber") % 3 == 0, "Carting").otherwise("FTL").alias("route_type"),
        F.concat(F.lit("trip-"), F.col("l_orderkey").cast("string")).alias("trip_uuid"),
        F.when(F.col("l_partkey") % 401 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("shub")).alias("source_center"),
        F.when(F.col("l_partkey") % 97 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("sname")).alias("source_name"),
        F.col("dhub").alias("destination_center"),
        F.col("dname").alias("destination_name"),
        (o * r + F.lit(32.0) * F.col("l_linenumber")).alias("start_scan_to_end_scan"),
        F.col("_cutoff").alias("is_cutoff"),
        F.col("l_linenumber").cast("int").alias("cutoff_factor"),
        F.when(F.col("l_suppkey") % 53 == 0, F.lit(0.0625))
         .otherwise(F.lit(1.25) * q).alias("actual_distance_to_destination"),
        (o * r).alias("actual_time"),
        o.alias("osrm_time"),
        (F.lit(1.5) * q).alias("osrm_distance"),
        r.alias("factor"),
        (o * r / F.lit(4.0)).alias("segment_actual_time"),
        F.when(seg_zero, F.lit(0.0)).otherwise(o / F.lit(4.0)).alias("segment_osrm_time"),
        (F.lit(0.375) * q).alias("segment_osrm_distance"),
        F.when(seg_zero, F.lit(-1.0)).otherwise(r).alias("segment_factor"),
        ((((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 10000)
         + F.col("l_suppkey")).alias("row_ord"),
    )


def read_trips_csv(spark: SparkSession, path: str, pattern: str = "data_part_*.csv",
                   timestamp_format: str | None = None, fallback: str | None = None) -> DataFrame:
    """Typed scan of all CSV shards under ``path`` (or, without any there, ``fallback``) in one job.

    Shards are found by glob inside Spark.  ``row_ord`` is the file order:
    (shard name, start of the block in the shard, number within the block), so
    it follows sorted shard names and lines however Spark packs files into
    tasks.  ``corrupt_record`` holds the raw line where a cell doesn't parse
    (its bad cells are NULL) and is NULL elsewhere, judged by the cells that
    a query reads; ``corrupt_rows`` reads and judges all of them.
    """
    reader = (spark.read.schema(T.StructType([*TRIP_SCHEMA.fields, T.StructField("corrupt_record", T.StringType())]))
              .option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt_record"))
    if timestamp_format:
        reader = reader.option("timestampFormat", timestamp_format).option("timestampNTZFormat", timestamp_format)
    target = path if path.endswith(".csv") else f"{path.rstrip('/')}/{pattern}"
    if fallback and not path_exists(spark, target):
        target = f"{fallback.rstrip('/')}/{pattern}"
    meta = F.col("_metadata")
    line = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    # a shard written by Spark is a folder: the path tells its parts apart
    shard = F.regexp_replace(meta["file_path"], "^.*/(?=data_part_)", "") if not path.endswith(".csv") else meta["file_path"]
    return (reader.csv(target).withColumn("shard", meta["file_name"])
            .withColumn("row_ord", F.struct(shard.alias("shard"), meta["file_block_start"].alias("block"), line.alias("line"))))


def corrupt_rows(df: DataFrame) -> DataFrame:
    """rows and corrupt_rows of a CSV scan (one row)."""
    bad = F.when(F.col("corrupt_record").isNotNull(), F.struct(*TRIP_SCHEMA.fieldNames()))  # cells are parsed where they are read
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count(bad).alias("corrupt_rows"))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path or glob matches anything."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)  # noqa: SLF001
    return found is not None and len(found) > 0


def read_trips(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Parquet or CSV trip source; ``fmt`` ("parquet" or "csv"), else by the path's suffix."""
    if (fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")) == "parquet":
        return spark.read.parquet(path)
    return read_trips_csv(spark, path)


def read_parquet_or_clean(spark: SparkSession, clean_path: str, raw_path: str,
                          rules=None) -> DataFrame:
    """Cleaned parquet if present, else the raw shards cleaned inline."""
    from hubflow.functions.cleaning import EDA_RULES, apply_rules, drop_critical_nulls
    if path_exists(spark, clean_path):
        return spark.read.parquet(clean_path)
    raw = read_trips(spark, raw_path)
    return apply_rules(drop_critical_nulls(raw), rules or EDA_RULES)


def require_columns(df: DataFrame, columns) -> DataFrame:
    """Contract check before planning: raise listing every missing column."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"required columns missing: {missing}; available: {df.columns}")
    return df


def coerce_numeric(df: DataFrame, columns) -> DataFrame:
    """Bad values become NULL (try_cast), NaN becomes NULL."""
    out = {}
    for c in columns:
        v = F.expr(f"try_cast(`{c}` as double)")
        out[c] = F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)
    return df.withColumns(out)


def rename_to_model(df: DataFrame) -> DataFrame:
    """Raw vocabulary -> model vocabulary, only for columns present."""
    return df.withColumnsRenamed({k: v for k, v in MODEL_RENAME.items() if k in df.columns and k != v})


def hub_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hub -> embedding vector from the embeddings table (hub HUBnn takes vec_id nn).

    Every vector row is mapped; ids without a matching hub simply never join.
    """
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return (emb.select(F.format_string("HUB%02d", F.col("vec_id")).alias("hub_id"),
                    F.transform("embedding", lambda x: x.cast("double")).alias("embedding")))


__all__ = ["trips_from_tables", "read_trips_csv", "TIMESTAMP_COLUMNS"]
