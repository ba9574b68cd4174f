"""Sources and sinks: Parquet, CSV and JSON records; validation; CSV output."""

from tablescope.sources.json_records import flatten_structs, parse_json_column, read_json_records
from tablescope.sources.tables import (NA_WORDS, normalize_nan, read_table, validate,
                                       write_csv, write_parquet)

__all__ = ["flatten_structs", "parse_json_column", "read_json_records", "NA_WORDS",
           "normalize_nan", "read_table", "validate", "write_csv", "write_parquet"]
