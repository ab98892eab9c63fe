"""Rounding that is the same in every engine: half up by plain arithmetic on doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column | str, digits: int) -> Column:
    """floor(value * 10 ** digits + 0.5) / 10 ** digits."""
    c = F.col(value) if isinstance(value, str) else value
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale

