"""Text expressions built from JVM functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Runs of letters and runs of anything else; a letter run is one "word" in the sense of
# Python's str.title(), where a new word starts after any non-letter.
_WORD_OR_GAP = r"(\p{L}+|[^\p{L}]+)"


def title_case(col) -> Column:
    """Python-style title case: ``o'brien mc-donald x1y`` -> ``O'Brien Mc-Donald X1Y``.

    ``initcap`` alone only splits on spaces; here the text is cut into letter runs and
    other runs first, each run is capitalised, and the runs are joined back.
    """
    c = F.col(col) if isinstance(col, str) else col
    parts = F.regexp_extract_all(c, F.lit(_WORD_OR_GAP), 1)
    return F.array_join(F.transform(parts, lambda p: F.initcap(p)), "")


def truncate_text(col, width: int = 50, keep: int = 47, suffix: str = "...") -> Column:
    """Text longer than ``width`` characters keeps its first ``keep`` characters plus ``suffix``."""
    c = F.col(col) if isinstance(col, str) else col
    s = c.cast("string")
    return F.when(F.length(s) > width, F.concat(F.substring(s, 1, keep), F.lit(suffix))).otherwise(s)
