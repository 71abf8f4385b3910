from hubflow.streaming.ingest import clean_trip_stream, start_parquet_sink, dedup_stream  # noqa: F401
