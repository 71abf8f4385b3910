"""Structured Streaming ingest equals the batch cleaning of the same shards."""

import tempfile

from pyspark.sql import functions as F

from hubflow.functions.features import clean_features
from hubflow.schema import TRIP_SCHEMA
from hubflow.sources import sinks
from hubflow.sources.trips import trips_from_tables
from hubflow.streaming import clean_trip_stream, start_parquet_sink

SF = "/root/testdata/sf0.001"


def test_stream_ingest_matches_batch(spark):
    base = tempfile.mkdtemp(prefix="hubflow-stream-")
    t = trips_from_tables(spark, SF)
    full = t.select(*[F.col(f.name) if f.name in t.columns else F.lit(None).cast(f.dataType).alias(f.name)
                      for f in TRIP_SCHEMA.fields])
    sinks.write_csv(full.filter(F.col("data") == "training"), f"{base}/landing/data_part_1.csv")
    q = start_parquet_sink(clean_trip_stream(spark, f"{base}/landing"), f"{base}/out", f"{base}/ckpt")
    q.awaitTermination()
    # a second shard arrives later: the restarted query only picks up the new file
    sinks.write_csv(full.filter(F.col("data") == "test"), f"{base}/landing/data_part_2.csv")
    q = start_parquet_sink(clean_trip_stream(spark, f"{base}/landing"), f"{base}/out", f"{base}/ckpt")
    q.awaitTermination()
    got = spark.read.parquet(f"{base}/out")
    want = clean_features(t)
    assert got.count() == want.count()
    assert got.groupBy("time_of_day").count().orderBy("time_of_day").collect() == \
        want.groupBy("time_of_day").count().orderBy("time_of_day").collect()
