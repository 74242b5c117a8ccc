"""Reader of the binary stores of formats 1 and 2, and their migration to snapshots.

A store is a pair of files, `<base>.graph` and `<base>.strings`; one task decodes one store.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.schema import GraphError, GraphState
from weftgraph.sources.snapshots import Store

#: Fixed values, little-endian: places in the graph file's head, in an entity record, in an adjacency entry and in a string.
VERSION_AT, HEAD_AT = 4, 40
ENTITY, PSI_AT = struct.Struct("<IIQQQI2I4xQQ"), 64
ENTRY, ENTRY_SIZE, TEXT = struct.Struct("<QI4xQ"), 24, struct.Struct("<IIH")
ROW = "kind string, seq bigint, a string, b string, c string, observations array<string>, mtime bigint, obs_mtime bigint, structural_visits bigint, walker_visits bigint, psi double"


def decode(graph: bytes, strings: bytes) -> list[tuple]:
    """Rows of ROW: entities (name, type), and the forward relations of each (source, target, type)."""
    version = struct.unpack_from("<I", graph, VERSION_AT)[0]
    if version not in (1, 2):
        raise GraphError(f"format {version} is not an old one")

    def text(at: int) -> str:
        if not at:
            return ""
        size = TEXT.unpack_from(strings, at)[2]
        return strings[at + TEXT.size : at + TEXT.size + size].decode("utf-8", "replace")

    log = struct.unpack_from("<Q", graph, HEAD_AT)[0]
    count = struct.unpack_from("<I", graph, log)[0]
    rows = []
    for seq, at in enumerate(struct.unpack_from(f"<{count}Q", graph, log + 8)):
        name, kind, edges, mtime, obs_mtime, _, one, two, structural, walker = ENTITY.unpack_from(graph, at)
        psi = struct.unpack_from("<d", graph, at + PSI_AT)[0] if version == 2 else 0.0
        rows.append(("entity", seq, text(name), text(kind), None, [text(x) for x in (one, two) if x], mtime, obs_mtime, structural, walker, psi))
        for k in range(struct.unpack_from("<I", graph, edges)[0] if edges else 0):
            packed, rel_type, when = ENTRY.unpack_from(graph, edges + 8 + k * ENTRY_SIZE)
            if packed & 3 == 0:  # the two lowest bits are the direction, zero the forward one
                target = struct.unpack_from("<I", graph, packed >> 2)[0]
                rows.append(("relation", len(rows), text(name), text(target), text(rel_type), None, when, None, None, None, None))
    return rows


def read_old(spark: SparkSession, base: str) -> GraphState:
    """The graph of an old store; times of zero stay zero."""
    files = spark.read.format("binaryFile").load([f"{base}.graph", f"{base}.strings"]).select("content", F.regexp_extract("path", r"\.(graph|strings)$", 1).alias("part"))
    pair = files.groupBy().agg(*(F.max(F.when(F.col("part") == p, F.col("content"))).alias(p) for p in ("graph", "strings")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for graph, strings in zip(pdf["graph"], pdf["strings"], strict=True):
                yield pd.DataFrame(decode(graph, strings), columns=[f.split()[0] for f in ROW.split(", ")]).astype({c: "Int64" for c in ("seq", "mtime", "obs_mtime", "structural_visits", "walker_visits")})

    rows: DataFrame = pair.mapInPandas(run, ROW)
    entities = rows.filter("kind = 'entity'")
    relations = rows.filter("kind = 'relation'").select("seq", F.col("a").alias("src"), F.col("b").alias("dst"), F.col("c").alias("rel_type"), "mtime")
    ranks = entities.select(F.col("a").alias("name"), "structural_visits", "walker_visits", "psi")
    return GraphState(entities.select("seq", F.col("a").alias("name"), F.col("b").alias("entity_type"), "observations", "mtime", "obs_mtime"), relations, ranks)


def migrate(spark: SparkSession, base: str, store: Store) -> GraphState:
    """Write an old store as a snapshot and compare field by field; a snapshot that differs is taken back. The old files stay as they are."""
    from weftgraph.sources.jsonl import differences

    old = read_old(spark, base)
    fresh = store.state() == "fresh"
    store.write(old)
    new = store.read()
    bad = differences(old.entities, new.entities, ["name"]).count() + old.relations.exceptAll(new.relations).count() + new.relations.exceptAll(old.relations).count() + differences(old.ranks, new.ranks, ["name"]).count()
    if bad:
        if not fresh:
            store.rollback()
        raise GraphError(f"{bad} rows changed in the migration of {base}")
    return new
