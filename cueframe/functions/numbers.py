"""Rounding that every engine does alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round3(x: Column) -> Column:
    """Thousandths by floor(x * 1000 + 0.5)."""
    return F.floor(x * 1000 + 0.5) / 1000.0
