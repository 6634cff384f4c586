"""Column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(c: Column) -> Column:
    """The column by way of exploding a one-element array: the optimizer then computes it once, where it would otherwise copy a costly
    expression into every later use, filters included. At most one in a select."""
    return F.explode(F.array(c))
