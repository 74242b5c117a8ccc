"""Centralities: visit ranks, the expected visits of absorbing random walks, and the maximum-entropy eigenvector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from weftgraph.operators.running import running
from weftgraph.plans.lineage import written

#: Relations from one node that one task takes.
HUB = 100_000
DAMPING, ALPHA, TOLERANCE, MOST = 0.85, 0.85, 1e-8, 200


def visit_ranks(entities: DataFrame, log: DataFrame) -> DataFrame:
    """Ranks that an access log (name) gives: one visit for each row, none to names that are no entity."""
    visits = log.groupBy("name").agg(F.count("*").alias("walker_visits"))
    found = entities.select("name").join(visits, "name", "left")
    return found.select("name", F.lit(0).cast("bigint").alias("structural_visits"), F.coalesce("walker_visits", F.lit(0)).alias("walker_visits"), F.lit(None).cast("double").alias("psi"))


def record_visits(ranks: DataFrame, names: DataFrame) -> DataFrame:
    """One more walker visit for each row of names; repeats count."""
    more = names.groupBy("name").agg(F.count("*").alias("more"))
    found = ranks.join(more, "name", "left")
    return found.select("name", "structural_visits", (F.col("walker_visits") + F.coalesce("more", F.lit(0))).alias("walker_visits"), "psi")


def walker_ranks(ranks: DataFrame) -> DataFrame:
    """name, walker_rank: a node's share of all visits; zero where there were none."""
    total = ranks.agg(F.coalesce(F.sum("walker_visits"), F.lit(0))).first()[0]
    share = F.col("walker_visits") / F.lit(total) if total else F.lit(0.0)
    return ranks.select("name", share.cast("double").alias("walker_rank"))


def numbered(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id, name, slots) and edges (src, dst, slot, c): names as numbers, and the relations between entities.

    c is how many relations go out of the source, those to no entity included. A source with many of them has several slots, over which its
    edges are dealt; what is sent along them is repeated once a slot. Edges are dealt by source and slot and kept, so that steps move
    values to them and never move them again; what a lost executor held is dealt anew.
    """
    out = relations.groupBy("src").agg(F.count("*").alias("c"))
    known = entities.select("name").join(out, entities["name"] == out["src"], "left")
    nodes = written(known.select(F.monotonically_increasing_id().alias("id"), "name", F.ceil(F.greatest(F.coalesce("c", F.lit(0)), F.lit(1)) / HUB).cast("int").alias("slots"), "c"))
    one, two = nodes.select(F.col("name").alias("src"), F.col("id").alias("a"), "slots", "c"), nodes.select(F.col("name").alias("dst"), F.col("id").alias("b"))
    edges = relations.select("src", "dst").join(one, "src").join(two, "dst")
    edges = written(edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.pmod(F.hash("b"), F.col("slots")).alias("slot"), "c"))
    count = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return nodes.select("id", "name", "slots"), edges.repartition(count, "src", "slot").persist()


def sent(edges: DataFrame, values: DataFrame, value: Column) -> DataFrame:
    """dst, m: the sum of `value` over the edges into each target; values: id, slots and what the value reads besides the edge."""
    spread = values.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    return edges.join(spread, (edges["src"] == spread["id"]) & (edges["slot"] == spread["slot"])).groupBy("dst").agg(F.sum(value).alias("m"))


def structural_rank(entities: DataFrame, relations: DataFrame, steps: int = 50, damping: float = DAMPING, cut: int = 5) -> DataFrame:
    """name, visits, rank: expected visits when one walk starts at every node, follows a relation with probability
    `damping`, and ends where there is none.

    v = 1 + damping * P'v, taken `steps` times from v = 1; relations count as often as they occur. Lineage is cut every
    `cut` steps. Each step is one equi join with edges that stay where they are, and one sum by target, combined before the shuffle.
    """
    nodes, edges = numbered(entities, relations)
    values = start = nodes.select("id", "slots").withColumn("v", F.lit(1.0))
    for step in range(steps):
        moved = sent(edges, values, F.col("v") * (damping / F.col("c")))
        fresh = start.select("id", "slots").join(moved, F.col("id") == F.col("dst"), "left").select("id", "slots", (1 + F.coalesce("m", F.lit(0.0))).alias("v"))
        values = written(fresh, values) if (step + 1) % cut == 0 and step + 1 < steps else fresh
    values = written(values)
    edges.unpersist()
    total = values.agg(F.sum("v")).first()[0]
    return nodes.join(values.select("id", "v"), "id").select("name", F.col("v").alias("visits"), (F.col("v") / F.lit(total)).alias("rank"))


def sampled_visits(entities: DataFrame, relations: DataFrame, seed: int = 0, steps: int = 100, damping: float = DAMPING) -> DataFrame:
    """name, visits: one seeded random walk from every node, the sampled form of structural_rank.

    At each node a walk counts a visit, then ends if there is no relation or by chance 1 - damping, else it takes one of
    the relations, each alike. Numbers come from a hash of the seed, the walk and the step, so a run can be repeated.
    """
    edges = relations.select("src", "dst", "seq").withColumn("one", F.lit(1))
    edges = running(edges, ["src"], ["seq", "dst"], place="one").select("src", "dst", (F.col("place") - 1).alias("k"))
    out = relations.groupBy("src").agg(F.count("*").alias("c"))
    edges = written(edges.join(out, "src"))
    chance = lambda step, salt: F.xxhash64("start", F.lit(seed), F.lit(step), F.lit(salt)).bitwiseAND((1 << 53) - 1) / F.lit(float(1 << 53))
    walks = entities.select(F.col("name").alias("start"), "name")
    counts = None
    for step in range(steps):
        walks = written(walks)
        if walks.isEmpty():
            break
        here = walks.groupBy("name").agg(F.count("*").alias("visits"))
        counts = here if counts is None else counts.unionByName(here)
        on = walks.filter(chance(step, "go") < damping).withColumn("pick", chance(step, "to"))
        degrees = on.join(out, on["name"] == out["src"]).select("start", "name", F.floor(F.col("pick") * F.col("c")).alias("k"))
        walks = degrees.join(edges, (degrees["name"] == edges["src"]) & (degrees["k"] == edges["k"])).select("start", F.col("dst").alias("name"))
    return (counts if counts is not None else walks.groupBy("name").agg(F.count("*").alias("visits"))).groupBy("name").agg(F.sum("visits").alias("visits"))


def entropy_psi(entities: DataFrame, relations: DataFrame, iterations: int = MOST, tolerance: float = TOLERANCE, alpha: float = ALPHA, warm: DataFrame | None = None) -> DataFrame:
    """name, psi: the maximum-entropy walk's eigenvector with teleport, of length one.

    x = alpha * A'psi + (1 - alpha) / n * sum(psi), divided by its length, until psi moves by less than the tolerance or
    `iterations` are done. warm (name, psi) is where to start: nodes that it lacks get the mean of the positive ones.
    Every step is one job: the sums that the next one needs are observed while its table is written.
    """
    nodes, edges = numbered(entities, relations)
    n = nodes.count()
    if not n:
        return nodes.select("name").withColumn("psi", F.lit(0.0))
    if warm is None:
        values, total, held = nodes.select("id", "slots").withColumn("psi", F.lit(1 / n**0.5)), n**0.5, None
    else:
        mean = warm.filter("psi > 0").agg(F.avg("psi")).first()[0] or 1 / n**0.5
        values = held = written(nodes.join(warm.select("name", "psi"), "name", "left").select("id", "slots", F.coalesce("psi", F.lit(mean)).alias("psi")))
        total, square = values.agg(F.sum("psi"), F.sum(F.col("psi") ** 2)).first()
        values, total = values.withColumn("psi", F.col("psi") / square**0.5), total / square**0.5
    for _ in range(iterations):
        moved = sent(edges, values, F.col("psi"))
        before = values.withColumnRenamed("psi", "old")
        fresh = before.join(moved, F.col("id") == F.col("dst"), "left").select("id", "slots", "old", (alpha * F.coalesce("m", F.lit(0.0)) + (1 - alpha) / n * total).alias("x"))
        seen = Observation()
        x, old = F.col("x"), F.col("old")
        held = written(fresh.observe(seen, F.sum(x).alias("total"), F.sum(x * x).alias("square"), F.sum(x * old).alias("mixed"), F.sum(old * old).alias("old")), held)
        sums = seen.get
        length = sums["square"] ** 0.5
        values, total = held.select("id", "slots", (F.col("x") / length).alias("psi")), sums["total"] / length
        if max(0.0, 1 + sums["old"] - 2 * sums["mixed"] / length) ** 0.5 < tolerance:
            break
    edges.unpersist()
    return nodes.join(values, "id").select("name", F.greatest("psi", F.lit(0.0)).alias("psi"))
