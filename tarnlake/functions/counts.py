"""Counting rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_count() -> Column:
    """COUNT(*): reads no column."""
    return F.count(F.lit(1))
