"""Bounded neighbourhoods, components and shortest paths by joining a frontier with the adjacency."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.plans.lineage import written
from weftgraph.schema import adjacency, direction

#: Bytes that the budget of a path counts for each node besides its strings, and the share of the memory that is free.
NODE_BYTES, MEMORY_SHARE = 28, 0.8


def reachable(relations: DataFrame, start: DataFrame, way: str = "any", hops: int | None = None) -> DataFrame:
    """name, depth: nodes within `hops` of the start names, start at depth 0. Null hops: until nothing is new."""
    edges = adjacency(relations, way).select("node", "other")
    seen = frontier = written(start.select("name").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while hops is None or depth < hops:
        depth += 1
        found = frontier.join(edges, frontier["name"] == edges["node"]).select(F.col("other").alias("name")).distinct()
        frontier = written(found.join(seen, "name", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def neighbours(entities: DataFrame, relations: DataFrame, name: str, depth: int = 1, way: str = "forward") -> DataFrame:
    """Entities within depth + 1 hops of a node, itself left out; none for an unknown name."""
    start = entities.filter(F.col("name") == name).select("name")
    found = reachable(relations, start, direction(way), depth + 1).filter("depth > 0")
    return entities.join(found, "name").select("name", "depth", "mtime", "obs_mtime")


def memory_budget(spark: SparkSession) -> int:
    """The bytes that a path may take by default: what weftgraph.path.budget says, else four fifths of what is free on all executors."""
    asked = spark.conf.get("weftgraph.path.budget", None)
    if asked is not None:
        return int(asked)
    status = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().values().iterator()
    free = 0
    while status.hasNext():
        free += status.next()._2()
    return max(1, int(free * MEMORY_SHARE))


@dataclass
class PathResult:
    """path: src, dst, rel_type, mtime, hop of each relation on the way, as stored; farthest: the last node discovered, if the target wasn't."""

    path: DataFrame
    reached: bool
    exhausted: bool
    farthest: str | None


def _sums(rows: DataFrame, order: list[str], value: str) -> DataFrame:
    """The rows with `running`, the sum of value up to and including each in the order, and their place in it.

    Rows are dealt by ranges of the order, so that only sums by partition are gathered, never the rows.
    """
    dealt = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()))
    sums = dealt.groupBy("part").agg(F.sum(value).alias("all"))
    before = F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    within = F.sum(value).over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return dealt.join(F.broadcast(sums.select("part", before.alias("before"))), "part").withColumn("running", F.col("before") + within).drop("before", "part")


def find_path(entities: DataFrame, relations: DataFrame, source: str, target: str, max_depth: int = 5, way: str = "forward", budget: int | None = None) -> PathResult:
    """A shortest path, hop by hop, ties by discovery order; the path to the farthest node found where the target isn't reached.

    Nodes are discovered in the order of their parents, then of the relations' seq. The budget counts the bytes
    of names and relation types and NODE_BYTES for each node discovered; the search stops at the first node that
    reaches it, unless that is the target.
    """
    spark = entities.sparkSession
    empty = spark.createDataFrame([], "src string, dst string, rel_type string, mtime bigint, hop int")
    if source == target:
        return PathResult(empty, True, False, None)
    names = {r.name for r in entities.filter(F.col("name").isin(source, target)).select("name").collect()}
    if names != {source, target}:
        return PathResult(empty, False, False, None)
    edges = adjacency(relations, direction(way))
    start = spark.createDataFrame([(source, 0)], "name string, place long")
    levels = [written(start)]
    seen, spent = levels[0].select("name"), len(source.encode()) + NODE_BYTES
    end, reached, exhausted = None, False, False
    for depth in range(1, max_depth + 1):
        last = levels[-1].select(F.col("name").alias("parent"), F.col("place").alias("parent_place"))
        step = last.join(edges, last["parent"] == edges["node"]).join(seen, F.col("other") == seen["name"], "left_anti")
        first = step.groupBy("other").agg(F.min(F.struct("parent_place", "seq", "direction", "parent", "rel_type", "src", "dst", "mtime")).alias("f"))
        found = first.select(F.col("other").alias("name"), "f.*")
        size = F.octet_length("name") + F.octet_length("rel_type") + NODE_BYTES
        found = _sums(found.withColumn("bytes", size.cast("long")), ["parent_place", "seq", "name"], "bytes")
        is_target = F.col("name") == target
        beyond = (F.col("running") + spent >= (budget if budget is not None else 1 << 62)) & ~is_target
        place = F.struct("place", "name", "running")
        hit, over, tail = found.agg(F.min(F.when(is_target, place)), F.min(F.when(beyond, place)), F.max(place)).first()
        levels.append(found)
        if hit is not None and (over is None or hit["place"] < over["place"]):
            end, reached = target, True
            break
        if over is not None:
            end, exhausted = over["name"], True
            break
        if tail is None:
            levels.pop()
            break
        end, spent = tail["name"], spent + tail["running"]
        seen = seen.unionByName(found.select("name"))
    rows, at = [], end
    for hop in range(len(levels) - 1, 0, -1):  # one row a level
        if at is None:
            break
        row = levels[hop].filter(F.col("name") == at).first()
        if row is None:
            continue
        rows.append((row["src"], row["dst"], row["rel_type"], row["mtime"], hop))
        at = row["parent"]
    path = spark.createDataFrame(sorted(rows, key=lambda r: r[4]), empty.schema)
    return PathResult(path, reached, exhausted, None if reached else end)


def path_note(result: PathResult, target: str) -> str | None:
    """What to say of a path that stops short."""
    if result.reached:
        return None
    why = "the memory budget was spent" if result.exhausted else "no path within the depth was found"
    return f"{target} was not reached: {why}." + (f" The path leads to {result.farthest}, the farthest node discovered." if result.farthest else "")
