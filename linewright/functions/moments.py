"""Timestamp text: parsing, zone rule and ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ZONE = r"(Z|[+-]\d{2}:?\d{2})$"
_SHAPE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?(Z|[+-]\d{2}:?\d{2})?$"


def instant(text: Column) -> Column:
    """ISO-8601 text to timestamp, NULL if unreadable. Zone-less text is UTC."""
    readable = text.rlike(_SHAPE)
    zoned = F.when(text.rlike(_ZONE), text).otherwise(F.concat(text, F.lit("Z")))
    # A bare date has no clock for a zone to attach to.
    full = F.when(F.length(text) == 10, F.concat(text, F.lit("T00:00:00Z"))).otherwise(zoned)
    return F.when(readable, F.try_to_timestamp(full))


def zoned_instant(text: Column) -> Column:
    """As ``instant`` but NULL when the text names no zone."""
    return F.when(text.rlike(_ZONE), instant(text))


def age_seconds(now: Column, then: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(then)) / 1e6
