"""Changes of a graph as functions from one state and a batch to the next state and a result; a batch is applied whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.strings import utf16_length
from weftgraph.schema import MAX_LENGTH, MAX_OBSERVATIONS, GraphError, GraphState


def _refuse(found: DataFrame, text) -> None:
    row = found.first()
    if row is not None:
        raise GraphError(text(row))


def _check(batch: DataFrame) -> None:
    _refuse(batch.filter(F.size("observations") > MAX_OBSERVATIONS).select("name", F.size("observations").alias("n")), lambda r: f"Entity {r['name']} has {r['n']} observations. Maximum allowed is {MAX_OBSERVATIONS}.")
    long = F.filter("observations", lambda x: utf16_length(x) > MAX_LENGTH)
    _refuse(batch.filter(F.size(long) > 0).select("name", F.substring(long[0], 1, 50).alias("o")), lambda r: f"Observation of {r['name']} exceeds {MAX_LENGTH} characters: {r['o']}...")


def _numbered(df: DataFrame, seq: str, existing: DataFrame) -> DataFrame:
    """New rows get numbers above all existing ones, in the order of their place in the batch."""
    base = existing.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
    return df.withColumn("seq", (F.lit(base + 1) + F.col(seq)).cast("bigint")).drop(*({seq} - {"seq"}))


def conflicts(state: GraphState, batch: DataFrame) -> DataFrame:
    """name: those of a batch (name, entity_type, observations) that exist with other data, or come with several in the batch itself."""
    old = state.entities.select("name", "entity_type", "observations")
    asked = batch.select("name").distinct()
    both = batch.select("name", "entity_type", "observations").unionByName(old.join(asked, "name", "left_semi"))
    return both.groupBy("name").agg(F.count_distinct(F.struct("entity_type", "observations")).alias("kinds")).filter("kinds > 1").select("name")


def create_entities(state: GraphState, batch: DataFrame, now: int) -> tuple[GraphState, DataFrame]:
    """batch (place, name, entity_type, observations) -> the next state, and the rows that are new.

    A name that exists with the same type and observations is passed over; with others it is an error. Of equal names
    in a batch the first counts, and the rest must agree with it.
    """
    _check(batch)
    _refuse(conflicts(state, batch), lambda r: f"Entity {r['name']} already exists with other data")
    asked = batch.groupBy("name").agg(F.min(F.struct("place", "entity_type", "observations")).alias("f")).select("name", "f.*")
    new = _numbered(asked.join(state.entities.select("name"), "name", "left_anti"), "place", state.entities)
    obs_time = F.when(F.size("observations") > 0, F.lit(now).cast("bigint"))
    new = new.select("seq", "name", "entity_type", "observations", F.lit(now).cast("bigint").alias("mtime"), obs_time.alias("obs_mtime"))
    ranks = new.select("name", F.lit(0).cast("bigint").alias("structural_visits"), F.lit(0).cast("bigint").alias("walker_visits"), F.lit(None).cast("double").alias("psi"))
    return GraphState(state.entities.unionByName(new), state.relations, state.ranks.unionByName(ranks)), new


def create_relations(state: GraphState, batch: DataFrame, now: int) -> tuple[GraphState, DataFrame]:
    """batch (place, src, dst, rel_type) -> the next state, and the relations that are new; those without both ends are passed over.

    The sources of new relations change their mtime.
    """
    names = state.entities.select("name")
    asked = batch.groupBy("src", "rel_type", "dst").agg(F.min("place").alias("place"))
    for end in ("src", "dst"):
        asked = asked.join(names, asked[end] == names["name"], "left_semi")
    asked = asked.join(state.relations.select("src", "rel_type", "dst"), ["src", "rel_type", "dst"], "left_anti")
    new = _numbered(asked, "place", state.relations).select("seq", "src", "dst", "rel_type", F.lit(now).cast("bigint").alias("mtime"))
    touched = new.select(F.col("src").alias("name")).distinct().withColumn("touched", F.lit(True))
    entities = state.entities.join(touched, "name", "left").withColumn("mtime", F.when(F.col("touched"), F.lit(now).cast("bigint")).otherwise(F.col("mtime"))).select(state.entities.columns)
    return GraphState(entities, state.relations.unionByName(new), state.ranks), new


def add_observations(state: GraphState, batch: DataFrame, now: int) -> tuple[GraphState, DataFrame]:
    """batch (name, contents) -> the next state, and (name, added); what an entity has already is passed over, repeats within a batch are not."""
    old = state.entities.select("name", "observations")
    _refuse(batch.join(old, "name", "left_anti").select("name"), lambda r: f"Entity {r['name']} not found")
    added = batch.join(old, "name").select("name", "observations", F.filter("contents", lambda x: ~F.array_contains("observations", x)).alias("added"))
    _check(added.select("name", F.slice("added", 1, MAX_OBSERVATIONS).alias("observations")))
    total = F.size("observations") + F.size("added")
    _refuse(added.filter(total > MAX_OBSERVATIONS).select("name"), lambda r: f"Adding to {r['name']} would exceed limit of {MAX_OBSERVATIONS} observations")
    change = added.select("name", "added")
    hit = F.size(F.coalesce("added", F.array().cast("array<string>"))) > 0
    entities = state.entities.join(change, "name", "left")
    entities = entities.withColumns({
        "observations": F.when(hit, F.concat("observations", "added")).otherwise(F.col("observations")),
        **{c: F.when(hit, F.lit(now).cast("bigint")).otherwise(F.col(c)) for c in ("mtime", "obs_mtime")},
    })
    return GraphState(entities.select(state.entities.columns), state.relations, state.ranks), change


def delete_entities(state: GraphState, names: DataFrame) -> GraphState:
    """Without the named entities and every relation at either end of them; unknown names are passed over."""
    gone = names.select("name").distinct()
    relations = state.relations
    for end in ("src", "dst"):
        relations = relations.join(gone, relations[end] == gone["name"], "left_anti")
    return GraphState(state.entities.join(gone, "name", "left_anti"), relations, state.ranks.join(gone, "name", "left_anti"))


def _less(observations, removals):
    """The list without the first place of each removal in turn."""

    def drop(kept, x):
        at = F.array_position(kept, x)
        return F.when(at > 0, F.concat(F.slice(kept, F.lit(1), (at - 1).cast("int")), F.slice(kept, (at + 1).cast("int"), F.size(kept)))).otherwise(kept)

    return F.aggregate(removals, observations, drop)


def delete_observations(state: GraphState, batch: DataFrame, now: int) -> GraphState:
    """batch (name, removals): each takes out the first observation equal to it; what isn't there is passed over."""
    entities = state.entities.join(batch.select("name", "removals"), "name", "left").withColumn("kept", F.when(F.col("removals").isNotNull(), _less(F.col("observations"), F.col("removals"))))
    hit = F.size("kept") < F.size("observations")
    entities = entities.withColumns({"observations": F.when(hit, F.col("kept")).otherwise(F.col("observations")), **{c: F.when(hit, F.lit(now).cast("bigint")).otherwise(F.col(c)) for c in ("mtime", "obs_mtime")}})
    return GraphState(entities.select(state.entities.columns), state.relations, state.ranks)


def delete_relations(state: GraphState, batch: DataFrame) -> GraphState:
    key = ["src", "rel_type", "dst"]
    return GraphState(state.entities, state.relations.join(batch.select(key).distinct(), key, "left_anti").select(state.relations.columns), state.ranks)


def add_thought(state: GraphState, observations: list[str], now: int, previous: str | None = None) -> tuple[GraphState, str]:
    """A Thought named after its content, and, where the previous one exists, the two relations between them."""
    spark = state.entities.sparkSession
    text = "\x00".join([str(now), previous or "", *observations])
    name = spark.range(1).select(F.substring(F.sha2(F.lit(text), 256), 1, 24)).first()[0]
    batch = spark.createDataFrame([(0, name, "Thought", observations)], "place int, name string, entity_type string, observations array<string>")
    state, _ = create_entities(state, batch, now)
    if previous is not None:
        links = spark.createDataFrame([(0, previous, name, "follows"), (1, name, previous, "preceded_by")], "place int, src string, dst string, rel_type string")
        state, _ = create_relations(state, links, now)
    return state, name


def thought_chains(turns: DataFrame, chain: str = "conv_id", order: str = "turn") -> DataFrame:
    """src, dst, rel_type: the relations that a table of thoughts in chains makes, each thought linked with the next."""
    name = F.concat_ws(":", F.lit("conv"), F.col(chain), F.col(order))
    pairs = turns.select(name.alias("src"), F.lead(name).over(Window.partitionBy(chain).orderBy(order)).alias("dst")).filter("dst IS NOT NULL")
    back = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("preceded_by").alias("rel_type"))
    return pairs.withColumn("rel_type", F.lit("follows")).unionByName(back)
