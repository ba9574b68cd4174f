"""Column-level building blocks: roles, binning, text, value maps, long-form reshaping."""

from tablescope.functions.binning import bin_domain, cut, cut_ordinal, interval_label
from tablescope.functions.frames import long_from_row, one_row
from tablescope.functions.roles import (categorical_columns, column_roles, is_numeric,
                                        numeric_columns)
from tablescope.functions.text import title_case, truncate_text
from tablescope.functions.values import map_values, round_cols

__all__ = [
    "bin_domain", "cut", "cut_ordinal", "interval_label", "long_from_row", "one_row",
    "categorical_columns", "column_roles", "is_numeric", "numeric_columns",
    "title_case", "truncate_text", "map_values", "round_cols",
]
