"""Counts and distinct values of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.schema import adjacency


def stats(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """One row: entity_count, relation_count, entity_types, relation_types."""
    kinds = lambda df, column, n, types: df.groupBy(column).count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias(n), F.count(column).alias(types))
    one = kinds(entities, "entity_type", "entity_count", "entity_types").withColumn("k", F.lit(1))
    two = kinds(relations, "rel_type", "relation_count", "relation_types").withColumn("k", F.lit(1))
    return one.join(two, "k").select("entity_count", "relation_count", "entity_types", "relation_types")


def entity_types(entities: DataFrame) -> DataFrame:
    return entities.select("entity_type").distinct().orderBy("entity_type")


def relation_types(relations: DataFrame) -> DataFrame:
    return relations.select("rel_type").distinct().orderBy("rel_type")


def degrees(relations: DataFrame) -> DataFrame:
    """name, degree: adjacency entries of each node; a relation counts at both ends."""
    return adjacency(relations).groupBy(F.col("node").alias("name")).agg(F.count("*").alias("degree"))


def string_counts(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """text, refs: how often each string is a name, type, observation, or a relation's type (at either end)."""
    words = entities.select(F.explode(F.concat(F.array("name", "entity_type"), "observations")).alias("text"), F.lit(1).alias("n"))
    kinds = relations.select(F.col("rel_type").alias("text"), F.lit(2).alias("n"))
    return words.unionByName(kinds).groupBy("text").agg(F.sum("n").alias("refs"))
