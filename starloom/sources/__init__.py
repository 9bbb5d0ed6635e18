"""Sources and sinks: Parquet, CSV, TSV and sparse instances; table statements, artifacts and predictions."""
