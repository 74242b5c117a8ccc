"""Running sums within keys, for keys of any number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.plans.lineage import written


def running(rows: DataFrame, key: list[str], order: list[str], **sums: str) -> DataFrame:
    """The rows with, for each name of sums, the sum of that column up to and including the row, within its key and in the order.

    Rows are dealt by ranges of key and order, so a large key lies in many parts; what comes before a part is summed from one row for
    each key and part, never from a key's rows together. The order must tell the rows of a key apart.
    """
    dealt = rows.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)
    dealt = written(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    parts = dealt.groupBy(*key, "_part").agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part of a key
    parts = parts.select(*key, "_part", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in sums))
    within = Window.partitionBy(*key, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.withColumns({n: F.sum(c).over(within) for n, c in sums.items()}).join(parts, [*key, "_part"])
    return found.select(*rows.columns, *((F.col(n) + F.col(f"_{n}")).alias(n) for n in sums))
