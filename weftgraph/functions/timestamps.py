"""Epoch milliseconds as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Milliseconds of each unit, and the age at which the next one takes over.
UNITS = (("seconds", 1000, 60_000), ("minutes", 60_000, 3_600_000), ("hours", 3_600_000, 86_400_000), ("days", 86_400_000, 30 * 86_400_000), ("months", 30 * 86_400_000, 365 * 86_400_000))
YEAR = 365 * 86_400_000


#: Times without zone are read, and shown, as UTC whatever the session's zone.
EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def millis(column: str) -> Column:
    """Epoch milliseconds of a time without zone."""
    return F.expr(f"timestampdiff(MILLISECOND, {EPOCH}, CAST({column} AS TIMESTAMP_NTZ))")


def decoded(instant: Column, now: Column | None = None) -> Column:
    """timestamp, iso8601, formatted (as in a mail header, UTC), and, given a present time, how long ago or ahead it is."""
    at = F.timestamp_add('MILLISECOND', instant, F.expr(EPOCH))
    fields = [
        instant.alias("timestamp"),
        F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z")).alias("iso8601"),
        F.concat(F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")).alias("formatted"),
    ]
    if now is not None:
        age = F.abs(now - instant)
        text = F.concat(F.floor(age / YEAR).cast("string"), F.lit(" years"))
        for unit, size, until in reversed(UNITS):
            text = F.when(age < until, F.concat(F.floor(age / size).cast("string"), F.lit(f" {unit}"))).otherwise(text)
        fields.append(F.when(now >= instant, F.concat(text, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), text)).alias("relative"))
    return F.struct(*fields)
