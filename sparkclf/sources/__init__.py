"""Sources and sinks."""
from .readers import raw_and_processed, read_csv, read_path, read_table  # noqa: F401
from .sinks import write_csv, write_parquet, write_report  # noqa: F401
