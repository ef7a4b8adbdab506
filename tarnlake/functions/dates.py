"""Dates and times kept as text: days for partitioning, and strict typed views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# One set of forms for all of the library: a day, or a day and a time after a blank or T, with any number of
# decimals of a second up to nine; months, days and hours may come without their zero.
_FORM = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}:\d{2}(\.\d{1,9})?)?$"
# Only zero-padded text sorts in time order, so ``typed`` counts only zero-padded text as well formed.
_SHAPES = {
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "timestamp": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d{1,9})?$",
}
_TARGETS = {"date": "date", "timestamp": "timestamp_ntz"}


def day_text(df: DataFrame, column: str) -> Column:
    """The day of a date, a timestamp or a timestamp text as 'YYYY-MM-DD'; NULL for malformed text."""
    return event_time(df, column).cast("date").cast("string")


def event_time(df: DataFrame, column: str) -> Column:
    """A time column as it is, or time text in one of the forms above as TIMESTAMP_NTZ; NULL for other text."""
    value = F.col(f"`{column}`")
    if isinstance(df.schema[column].dataType, T.StringType):
        return F.when(value.rlike(_FORM), value.try_cast("timestamp_ntz"))
    return value


def _parsed(column: str, kind: str) -> Column:
    text = F.col(f"`{column}`")
    return F.when(text.rlike(_SHAPES[kind]), text.try_cast(_TARGETS[kind]))


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """The table with the named text columns as DATE ('date') or TIMESTAMP_NTZ ('timestamp').

    Text that is malformed or names no real day becomes NULL, in ANSI mode too.
    """
    return df.withColumns({column: _parsed(column, kind) for column, kind in kinds.items()})


def typed_report(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Per text column: rows with text, and rows whose text ``typed`` turns into NULL. One pass."""
    bad = {c: F.col(f"`{c}`").isNotNull() & _parsed(c, kind).isNull() for c, kind in kinds.items()}
    counts = df.agg(
        *[F.count(F.col(f"`{c}`")).alias(f"filled_{i}") for i, c in enumerate(kinds)],
        *[F.count_if(bad[c]).alias(f"bad_{i}") for i, c in enumerate(kinds)],
    )
    lines = [
        F.struct(F.lit(c).alias("column"), F.col(f"filled_{i}").alias("filled"), F.col(f"bad_{i}").alias("bad"))
        for i, c in enumerate(kinds)
    ]
    return counts.select(F.inline(F.array(*lines)))
