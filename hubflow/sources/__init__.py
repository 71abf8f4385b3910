from hubflow.sources.trips import (  # noqa: F401
    trips_from_tables, read_trips_csv, read_trips, read_parquet_or_clean, require_columns,
    coerce_numeric, rename_to_model, hub_vectors,
)
from hubflow.sources.predictions import read_predictions, labelled_predictions  # noqa: F401
