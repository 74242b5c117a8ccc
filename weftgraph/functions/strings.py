"""String functions with the semantics that observations and documents need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the white space of ECMAScript, for a character class.
WHITE = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"


def utf16_length(text: Column) -> Column:
    """Units of UTF-16, which is what the length limit counts."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def normalised(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{WHITE}]+", " "))
