"""The term rule: a term name is the multiset of its words, letter case apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(name: Column | str) -> Column:
    """Maximal runs of letters and digits in lower case, in order of place; NULL for NULL."""
    c = F.col(name) if isinstance(name, str) else name
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), 1)


def term_key(name: Column | str) -> Column:
    """The sorted words joined by single spaces; equal keys are equal terms.  NULL for NULL."""
    return F.array_join(F.array_sort(words(name)), " ")
