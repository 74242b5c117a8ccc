"""Finding entities: by regular expression, by name and by type, with the relations that go with them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.ere import to_java
from weftgraph.schema import GraphError, adjacency, direction

#: Fixed value: what makes a query a pattern rather than words.
META = re.compile(r"[\\^$.*+?()\[\]{}|]")


def matches(pattern: str) -> Column:
    """True where the extended regular expression hits the name, the type or an observation; case counts."""
    java = to_java(pattern)
    return F.col("name").rlike(java) | F.col("entity_type").rlike(java) | F.exists("observations", lambda x: x.rlike(java))


def search_entities(entities: DataFrame, pattern: str) -> DataFrame:
    return entities.filter(matches(pattern))


def relations_among(relations: DataFrame, names: DataFrame, way: str = "forward") -> DataFrame:
    """Relations from (forward), to (backward) or within (any) a set of names."""
    direction(way)
    names = names.select("name").distinct()
    for end in {"forward": ["src"], "backward": ["dst"], "any": ["src", "dst"]}[way]:
        relations = relations.join(names, relations[end] == names["name"], "left_semi")
    return relations


def search(entities: DataFrame, relations: DataFrame, pattern: str, way: str = "forward") -> tuple[DataFrame, DataFrame]:
    found = search_entities(entities, pattern)
    return found, relations_among(relations, found, way)


def words_hint(query: str, entity_count: int, relation_count: int) -> str | None:
    """What to answer when plain words found nothing: null unless the query has no pattern characters and both counts are zero."""
    if META.search(query) or entity_count or relation_count:
        return None
    words = query.split()
    hint = f" Try '{'|'.join(words)}'." if len(words) > 1 else ""
    return f"No entity matches '{query}', which is read as a regular expression.{hint}"


def open_nodes(entities: DataFrame, relations: DataFrame, names: list[str], way: str = "forward") -> tuple[DataFrame, DataFrame]:
    """Entities in the order asked, repeats included, and their relations, each once per end that is among them.

    In the direction 'any' a forward relation is given whether or not its target is among the names, and a relation between
    two of them is given from both ends.
    """
    direction(way)
    spark = entities.sparkSession
    asked = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "place int, name string")
    found = entities.join(F.broadcast(asked), "name").orderBy("place")
    present = found.select("name").distinct()
    edges = adjacency(relations, way)
    edges = edges.join(present, edges["node"] == present["name"], "left_semi")
    return found.drop("place"), edges.select("src", "dst", "rel_type", "mtime", "direction", "seq")


def by_type(entities: DataFrame, entity_type: str) -> DataFrame:
    return entities.filter(F.col("entity_type") == entity_type)


def lookup(entities: DataFrame, name: str) -> DataFrame:
    return entities.filter(F.col("name") == name)


def require(entities: DataFrame, name: str) -> None:
    if lookup(entities, name).isEmpty():
        raise GraphError(f"Entity {name} not found")
