"""Sources and sinks: fixed schemas, the conformed operational tables, CSV/Parquet I/O."""
