"""Import of graphs kept as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.schema import MAX_LENGTH, MAX_OBSERVATIONS

LINE = "type string, name string, entityType string, observations array<string>, mtime bigint, obsMtime bigint, `from` string, `to` string, relationType string"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The parsed lines with `place`, and `bad` for those that are no entity or relation."""
    return parsed(spark.read.text(path).filter(F.trim("value") != "").withColumn("place", F.monotonically_increasing_id()))


def parsed(raw: DataFrame) -> DataFrame:
    """Lines (place, value) with their fields, and `bad` for those that are no entity or relation."""
    found = raw.withColumn("r", F.from_json("value", LINE)).select("place", "value", "r.*")
    entity = (F.col("type") == "entity") & F.col("name").isNotNull() & F.col("entityType").isNotNull()
    relation = (F.col("type") == "relation") & F.col("from").isNotNull() & F.col("to").isNotNull() & F.col("relationType").isNotNull()
    return found.withColumn("bad", ~F.coalesce(entity | relation, F.lit(False)))


def import_graph(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of parsed lines, numbered by place.

    Of equal names the first counts; observations are cut to the limits of number and length; times default to zero.
    Relations without both ends are passed over; equal ones all stay.
    """
    good = lines.filter("NOT bad")
    entities = good.filter("type = 'entity'")  # the first by name is a combined minimum, whatever the number of a name's lines
    entities = entities.groupBy("name").agg(F.min(F.struct("place", "entityType", "observations", "mtime", "obsMtime")).alias("f")).select("name", "f.*")
    short = F.transform(F.slice(F.coalesce("observations", F.array().cast("array<string>")), 1, MAX_OBSERVATIONS), lambda x: F.substring(x, 1, MAX_LENGTH))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    entities = entities.select(F.col("place").alias("seq"), "name", F.col("entityType").alias("entity_type"), short.alias("observations"), zero("mtime").alias("mtime"), zero("obsMtime").alias("obs_mtime"))
    relations = good.filter("type = 'relation'").select(F.col("place").alias("seq"), F.col("from").alias("src"), F.col("to").alias("dst"), F.col("relationType").alias("rel_type"), zero("mtime").alias("mtime"))
    names = entities.select("name")
    for end in ("src", "dst"):
        relations = relations.join(names, relations[end] == names["name"], "left_semi")
    return entities, relations


def differences(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """key, problem of the rows that two tables don't share: missing, added, or the names of the fields that differ; no row means equal."""
    fields = [c for c in old.columns if c not in key]
    a = old.select(*key, F.struct(*fields).alias("a"))
    b = new.select(*key, F.struct(*fields).alias("b"))
    changed = F.array_join(F.filter(F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in fields)), lambda x: x.isNotNull()), ",")
    problem = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "added").otherwise(changed)
    return a.join(b, key, "full_outer").select(*key, problem.alias("problem")).filter("problem <> ''")
