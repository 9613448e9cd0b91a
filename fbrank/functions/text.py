"""Text analysis expressions shared by engine and oracle.

Fixed values (must agree with the oracle SQL):
  token pattern  ([\\p{L}\\p{N}]+) over lower-cased text
  stop words     terms occurring in more than half of all documents
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_PATTERN = r"([\p{L}\p{N}]+)"
STOP_DF_FRACTION = 0.5


def tokens(text: Column | str) -> Column:
    """ARRAY<STRING> of lower-cased letter/digit runs."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(t), F.lit(TOKEN_PATTERN), 1)
