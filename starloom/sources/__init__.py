"""Sources and sinks: driver parquet tables, raw-source adapters, CSV, warehouse IO."""
