"""Sources and sinks: typed CSV/parquet scans, overwrite and versioned sinks."""

from .files import (
    SourceError,
    read_csv_typed,
    read_parquet,
    write_csv,
    write_parquet,
    write_versioned,
    read_versioned,
)
from .tables import TABLES, table, tables

__all__ = [
    "SourceError",
    "read_csv_typed",
    "read_parquet",
    "write_csv",
    "write_parquet",
    "write_versioned",
    "read_versioned",
    "TABLES",
    "table",
    "tables",
]
