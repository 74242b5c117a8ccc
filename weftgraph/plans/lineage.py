"""Tables in the cluster's shared folder, which cut the lineage of iterative plans and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a temporary one is set in local mode, and a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weftgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder, computed once; it stays until it is forgotten.

    instead_of: a table written before, which nothing but df reads; it goes as soon as the new one is whole.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftgraph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weftgraph_path = path
    if instead_of is not None:
        forget(instead_of)
    return out


def forget(df: DataFrame) -> None:
    """Delete the table that `written` returned; frames that read it can't be evaluated any more."""
    path = getattr(df, "_weftgraph_path", None)
    if path is not None:
        context = df.sparkSession.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
        df._weftgraph_path = None
