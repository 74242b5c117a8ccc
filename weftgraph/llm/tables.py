"""Reading inputs; tables written in the cluster's shared folder cut lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.plans.lineage import forget, shared_dir, written

__all__ = ["fold", "forget", "load", "shared_dir", "texts", "written"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *keep: Column | str, text_col: str = "text", as_bytes: bool = True) -> DataFrame:
    """The kept columns and `text`, null as empty, UTF-8 bytes unless asked otherwise; other columns go."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(*keep, (text.cast("binary") if as_bytes else text).alias("text"))


def fold(column: str) -> Column:
    """crc32(id as text) mod 3; rows where it is 1 are held out of all training."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3
