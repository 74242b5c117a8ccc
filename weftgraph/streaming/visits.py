"""Visit counts kept from a stream of accesses (an extension: the batch form is operators.rank.record_visits)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATE, WIDTH = "1 day", "1 hour"


def access_stream(spark, path: str, schema: str, files: int = 10) -> DataFrame:
    """A folder of Parquet files as a stream of events, `files` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def windowed_visits(events: DataFrame, width: str = WIDTH, late: str = LATE, time: str = "ts", name: str = "name") -> DataFrame:
    """start, name, visits by tumbling window of event time; works on a stream, where events later than `late` are left out, and on a table."""
    if events.isStreaming:
        events = events.withWatermark(time, late)
    found = events.groupBy(F.window(time, width).alias("w"), F.col(name).alias("name")).agg(F.count("*").alias("visits"))
    return found.select(F.col("w.start").alias("start"), "name", "visits")
