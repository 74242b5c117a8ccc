"""Connectivity and integrity of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.strings import utf16_length
from weftgraph.operators.traverse import reachable
from weftgraph.schema import MAX_LENGTH, MAX_OBSERVATIONS

ROOT = "Self"


def orphans(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities at no end of any relation; one with a relation to itself is connected."""
    ends = relations.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    return entities.join(ends, "name", "left_anti")


def strict_orphans(entities: DataFrame, relations: DataFrame, root: str = ROOT) -> DataFrame:
    """Entities that no path of relations, whatever their direction, joins to the root; all of them where it is missing."""
    known = entities.filter(F.col("name") == root).select("name")
    return entities.join(reachable(relations, known, "any").select("name"), "name", "left_anti")


def missing_endpoints(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """name: ends of relations that are no entity."""
    ends = relations.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    return ends.join(entities.select("name"), "name", "left_anti")


def violations(entities: DataFrame) -> DataFrame:
    """name, count, oversized (places of observations over the length limit) of entities that break a limit."""
    long = F.filter(F.sequence(F.lit(0), F.size("observations") - 1), lambda i: utf16_length(F.get("observations", i)) > MAX_LENGTH)
    oversized = F.when(F.size("observations") > 0, long).otherwise(F.array().cast("array<int>"))
    found = entities.select("name", F.size("observations").alias("count"), oversized.alias("oversized"))
    return found.filter((F.col("count") > MAX_OBSERVATIONS) | (F.size("oversized") > 0))
