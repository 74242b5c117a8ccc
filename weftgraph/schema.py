"""Schemas and limits of the property graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTITIES = "seq bigint, name string, entity_type string, observations array<string>, mtime bigint, obs_mtime bigint"
RELATIONS = "seq bigint, src string, dst string, rel_type string, mtime bigint"
RANKS = "name string, structural_visits bigint, walker_visits bigint, psi double"

#: Observations of an entity, UTF-16 units of one, and characters of a page.
MAX_OBSERVATIONS, MAX_LENGTH, PAGE_CHARS = 2, 140, 4096
DIRECTIONS = ("forward", "backward", "any")


class GraphError(ValueError):
    """A request that the graph refuses."""


def direction(value: str) -> str:
    if value not in DIRECTIONS:
        raise GraphError(f"direction must be one of {', '.join(DIRECTIONS)}")
    return value


@dataclass
class GraphState:
    """A graph as DataFrames: entities, relations and visit ranks; every operator returns new ones."""

    entities: DataFrame
    relations: DataFrame
    ranks: DataFrame

    @staticmethod
    def empty(spark) -> GraphState:
        return GraphState(*(spark.createDataFrame([], s) for s in (ENTITIES, RELATIONS, RANKS)))


def adjacency(relations: DataFrame, way: str = "any") -> DataFrame:
    """node, other, direction, rel_type, mtime, seq, and the relation's own src and dst: each relation seen from its ends, in one scan."""
    direction(way)
    seen = lambda node, other, name: F.struct(F.col(node).alias("node"), F.col(other).alias("other"), F.lit(name).alias("direction"))
    ends = {"forward": [seen("src", "dst", "forward")], "backward": [seen("dst", "src", "backward")]}
    if way != "any":
        return relations.select(ends[way][0].alias("e"), "*").select("e.*", "rel_type", "mtime", "seq", "src", "dst")
    return relations.select(F.explode(F.array(*ends["forward"], *ends["backward"])).alias("e"), "rel_type", "mtime", "seq", "src", "dst").select("e.*", "rel_type", "mtime", "seq", "src", "dst")
