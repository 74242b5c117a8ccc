"""The canonical graph of the trade tables: one entity per row of a dimension, one relation per foreign key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.timestamps import millis
from weftgraph.schema import GraphState

#: Kind, table, key, observations; the place in the list is the kind's share of seq.
KINDS = [
    ("region", "region", "r_regionkey", ("r_name",)),
    ("nation", "nation", "n_nationkey", ("n_name",)),
    ("customer", "customer", "c_custkey", ("c_name", "c_mktsegment")),
    ("supplier", "supplier", "s_suppkey", ("s_name",)),
    ("part", "part", "p_partkey", ("p_name", "p_brand")),
    ("order", "orders", "o_orderkey", ("o_orderpriority", "o_orderstatus")),
]
KIND_STEP, RELATION_STEP, PAIR_STEP = 10**12, 10**15, 10**7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = None
    for place, (kind, name, key, observations) in enumerate(KINDS):
        mtime = millis("o_orderdate") if kind == "order" else F.lit(None).cast("bigint")
        part = table(spark, sf_dir, name).select(
            (F.lit(place * KIND_STEP) + F.col(key)).cast("bigint").alias("seq"),
            F.concat(F.lit(f"{kind}:"), F.col(key)).alias("name"),
            F.lit(kind.capitalize()).alias("entity_type"),
            F.array(*observations).alias("observations"),
            mtime.alias("mtime"),
            mtime.alias("obs_mtime"),
        )
        found = part if found is None else found.unionByName(part)
    return found


def _named(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key))


def relations(spark: SparkSession, sf_dir: str, types: set[str] | None = None) -> DataFrame:
    """All relations, or those of some types, for which no other table is read."""
    none = F.lit(None).cast("bigint")

    def key(name, place, rel_type, kind, own, to, other, mtime=none):
        return table(spark, sf_dir, name).select((F.lit(place * RELATION_STEP) + F.col(own)).cast("bigint").alias("seq"), _named(kind, own).alias("src"), _named(to, other).alias("dst"), F.lit(rel_type).alias("rel_type"), mtime.alias("mtime"))

    # both pairs of keys of a line item are summed in one scan and one shuffle, by number; names are made of the sums
    asked = lambda rel_type: types is None or rel_type in types
    pairs = [p for p in [(4, "contains", "order", "l_orderkey", "part", "l_partkey"), (5, "supplied_by", "part", "l_partkey", "supplier", "l_suppkey")] if asked(p[1])]
    keys = [("nation", 0, "in_region", "nation", "n_nationkey", "region", "n_regionkey"), ("customer", 1, "in_nation", "customer", "c_custkey", "nation", "c_nationkey"), ("supplier", 2, "in_nation", "supplier", "s_suppkey", "nation", "s_nationkey")]
    keys += [("orders", 3, "placed_by", "order", "o_orderkey", "customer", "o_custkey", millis("o_orderdate"))]
    parts = [key(*k) for k in keys if asked(k[2])]
    if pairs:
        ends = F.array(*(F.struct(F.lit(p[0]).alias("place"), F.col(p[3]).cast("bigint").alias("own"), F.col(p[5]).cast("bigint").alias("other")) for p in pairs))
        items = table(spark, sf_dir, "lineitem").select(F.explode(ends).alias("k"), millis("l_shipdate").alias("mtime")).select("k.*", "mtime").groupBy("place", "own", "other").agg(F.max("mtime").alias("mtime"))
        chosen = lambda make: F.coalesce(*(F.when(F.col("place") == p[0], make(p)) for p in pairs))
        number = (F.col("place") * RELATION_STEP + F.col("own") * PAIR_STEP + F.col("other")).cast("bigint").alias("seq")
        parts.append(items.select(number, chosen(lambda p: _named(p[2], "own")).alias("src"), chosen(lambda p: _named(p[4], "other")).alias("dst"), chosen(lambda p: F.lit(p[1])).alias("rel_type"), "mtime"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per visit: the name of the entity that an event touches."""
    return table(spark, sf_dir, "events").select(_named("customer", "user_id").alias("name"))


def graph(spark: SparkSession, sf_dir: str) -> GraphState:
    from weftgraph.operators.rank import visit_ranks

    found = entities(spark, sf_dir)
    return GraphState(found, relations(spark, sf_dir), visit_ranks(found, access_log(spark, sf_dir)))
