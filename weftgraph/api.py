"""The graph's tools as one class over a state: each call returns a plain answer, changes replace the state."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import timestamps
from weftgraph.operators import audit, mutate, order, rank, search, summary, text, traverse, walk
from weftgraph.plans.lineage import forget, written
from weftgraph.schema import PAGE_CHARS, GraphError, GraphState
from weftgraph.sources import plaintext

ENTITY = ("name", "entity_type", "observations", "mtime", "obs_mtime")
RELATION = ("src", "dst", "rel_type", "mtime")
#: Logged visits, in tables, before they are folded into the ranks.
LOG = 32


class Graph:
    """Create, read, update, delete and analyse a property graph. Batches are applied whole or not at all.

    Searches and neighbourhoods count one visit for all that they found, not only for the page returned. Visits are logged, a small table
    a call; ranks read the log with the base, and it is folded into the base by the next change of the ranks or when it has LOG tables.
    A change writes the tables that it changes, no others, and drops those of its own that they replace, so frames of an earlier state
    can't be read after it.
    """

    def __init__(self, spark: SparkSession, state: GraphState | None = None, clock=lambda: int(time.time() * 1000)):
        self.spark, self.clock = spark, clock
        self.state = state or GraphState.empty(spark)

    @property
    def state(self) -> GraphState:
        """The graph as it is, logged visits included."""
        if self._seen is None:
            names = self._log[0] if self._log else None
            for more in self._log[1:]:
                names = names.unionByName(more)
            ranks = self._base.ranks if names is None else rank.record_visits(self._base.ranks, names)
            self._seen = GraphState(self._base.entities, self._base.relations, ranks)
        return self._seen

    @state.setter
    def state(self, state: GraphState) -> None:
        self._base, self._log, self._seen, self._own = state, [], None, []

    # changes

    def _rows(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"place int, {schema}")

    def create_entities(self, entities: list[dict]) -> list[dict]:
        batch = self._rows([(e["name"], e["entityType"], list(e.get("observations", []))) for e in entities], "name string, entity_type string, observations array<string>")
        state, new = mutate.create_entities(self.state, batch, self.clock())
        found = [r.asDict() for r in new.orderBy("seq").select("name", "entity_type", "observations").collect()]
        self._take(state)
        return found

    def create_relations(self, relations: list[dict]) -> list[dict]:
        batch = self._rows([(r["from"], r["to"], r["relationType"]) for r in relations], "src string, dst string, rel_type string")
        state, new = mutate.create_relations(self.state, batch, self.clock())
        found = [r.asDict() for r in new.orderBy("seq").select("src", "dst", "rel_type").collect()]
        self._take(state)
        return found

    def add_observations(self, additions: list[dict]) -> list[dict]:
        batch = self._rows([(a["entityName"], a["contents"]) for a in additions], "name string, contents array<string>")
        state, added = mutate.add_observations(self.state, batch.drop("place"), self.clock())
        found = [r.asDict() for r in added.collect()]
        self._take(state)
        return found

    def delete_entities(self, names: list[str]) -> None:
        self._take(mutate.delete_entities(self.state, self._rows([(n,) for n in names], "name string")))

    def delete_observations(self, deletions: list[dict]) -> None:
        batch = self._rows([(d["entityName"], d["observations"]) for d in deletions], "name string, removals array<string>")
        self._take(mutate.delete_observations(self.state, batch.drop("place"), self.clock()))

    def delete_relations(self, relations: list[dict]) -> None:
        batch = self._rows([(r["from"], r["to"], r["relationType"]) for r in relations], "src string, dst string, rel_type string")
        self._take(mutate.delete_relations(self.state, batch))

    def sequential_thinking(self, observations: list[str], previous: str | None = None) -> str:
        state, name = mutate.add_thought(self.state, observations, self.clock(), previous)
        self._take(state)
        return name

    def load_document(self, path: str, title: str | None = None, top: int = text.TOP) -> dict:
        """Read a plain-text file, chunk and rank it, and add it to the graph."""
        docs = plaintext.read_documents(self.spark, path, title)
        corpus = self.state.entities.select(F.explode(F.concat(F.array("name", "entity_type"), "observations")).alias("text"))
        entities, relations, stats = text.load_documents(docs, corpus, top)
        number = lambda df: df.withColumn("place", F.monotonically_increasing_id())
        state, made = mutate.create_entities(self.state, number(entities), self.clock())
        state, linked = mutate.create_relations(state, number(relations), self.clock())
        answer = {**stats.first().asDict(), "entities": made.count(), "relations": linked.count()}
        self._take(state)
        return answer

    def _take(self, state: GraphState) -> None:
        """Write what has changed, which cuts its lineage, and drop what it replaces of what this graph has written."""
        old, base = self.state, self._base
        parts, fresh, gone = {}, [], []
        for n in ("entities", "relations", "ranks"):
            parts[n] = getattr(base, n)
            if getattr(state, n) is not getattr(old, n):
                gone.append(parts[n])
                parts[n] = written(getattr(state, n))
                fresh.append(parts[n])
        held, self._log = ([], self._log) if parts["ranks"] is base.ranks else (self._log, [])
        stale = [df for df in self._own if any(df is x for x in gone)] + held
        self._own = [df for df in self._own if not any(df is x for x in gone)] + fresh
        self._base, self._seen = GraphState(**parts), None
        for df in stale:
            forget(df)

    def resample(self, steps: int = 50, iterations: int = rank.MOST) -> None:
        """Structural visits and psi anew, psi from where it was."""
        visits = rank.structural_rank(self.state.entities, self.state.relations, steps).select("name", F.round(F.col("visits") * 1000).cast("bigint").alias("structural_visits"))
        warm = self.state.ranks.filter("psi IS NOT NULL").select("name", "psi")
        psi = rank.entropy_psi(self.state.entities, self.state.relations, iterations, warm=None if warm.isEmpty() else warm)
        ranks = self.state.ranks.select("name", "walker_visits").join(visits, "name", "left").join(psi, "name", "left")
        ranks = ranks.select("name", F.coalesce("structural_visits", F.lit(0)).alias("structural_visits"), "walker_visits", "psi")
        self._take(GraphState(self.state.entities, self.state.relations, ranks))

    def _visit(self, names: DataFrame) -> None:
        """Log one visit for each row of names, a table of its own."""
        self._log.append(names)
        self._seen = None
        if len(self._log) >= LOG:
            old = self.state
            self._take(GraphState(old.entities, old.relations, old.ranks.select("*")))

    # reading

    def _page(self, items: DataFrame, keys, json, cursor: int, limit: int = PAGE_CHARS) -> dict:
        total = items.count()
        rows = order.page(items, keys, json, cursor, limit, total).orderBy("position").collect()
        end = cursor + len(rows)
        return {"items": [r["json"] for r in rows], "nextCursor": end if rows and end < total else None, "totalCount": total}

    def _timed(self, found: DataFrame) -> DataFrame:
        """Times of zero are as missing ones."""
        return found.withColumns({c: F.when(F.col(c) > 0, F.col(c)).alias(c) for c in ("mtime", "obs_mtime")})

    def _entities(self, found: DataFrame, sort_by, sort_dir, cursor) -> dict:
        ranked = order.ranked(self._timed(found), self.state.ranks)
        return self._page(ranked, order.sort_columns(sort_by, sort_dir), order.item_json(*(c for c in ENTITY if c in found.columns)), cursor)

    def search_nodes(self, query: str, direction="forward", sort_by="llmrank", sort_dir=None, entity_cursor=0, relation_cursor=0) -> dict:
        names = written(search.search_entities(self.state.entities, query).select("name"))  # matched once, for the answer and the visits
        found = self.state.entities.join(names, "name", "left_semi")
        among = search.relations_among(self.state.relations, names, direction)
        answer = {"entities": self._entities(found, sort_by, sort_dir, entity_cursor), "relations": self._page(among, [F.col("seq")], order.item_json(*RELATION), relation_cursor)}
        hint = search.words_hint(query, answer["entities"]["totalCount"], answer["relations"]["totalCount"])
        if hint:
            forget(names)
            raise GraphError(hint)
        self._visit(names)
        return answer

    def open_nodes(self, names: list[str], direction="forward", entity_cursor=0, relation_cursor=0) -> dict:
        found, edges = search.open_nodes(self.state.entities, self.state.relations, names, direction)
        place = F.array_position(F.lit(names), F.col("name"))
        answer = {
            "entities": self._page(self._timed(found), [place], order.item_json(*ENTITY), entity_cursor),
            "relations": self._page(edges, [F.col("seq"), F.desc("direction")], order.item_json(*RELATION), relation_cursor),
        }
        self._visit(written(found.select("name")))
        return answer

    def get_neighbors(self, name: str, depth=1, direction="forward", sort_by="llmrank", sort_dir=None, cursor=0) -> dict:
        found = written(traverse.neighbours(self.state.entities, self.state.relations, name, depth, direction))
        answer = self._entities(found.drop("depth"), sort_by, sort_dir, cursor)
        self._visit(written(found.select("name"), found))
        return answer

    def find_path(self, source: str, target: str, max_depth=5, direction="forward", budget: int | None = None, cursor=0) -> dict:
        budget = traverse.memory_budget(self.spark) if budget is None else budget
        found = traverse.find_path(self.state.entities, self.state.relations, source, target, max_depth, direction, budget)
        answer = self._page(found.path, [F.col("hop")], order.item_json(*RELATION), cursor) | {"targetReached": found.reached, "budgetExhausted": found.exhausted}
        return answer if found.reached else answer | {"farthestDiscovered": found.farthest, "note": traverse.path_note(found, target)}

    def get_entities_by_type(self, entity_type: str, sort_by="llmrank", sort_dir=None, cursor=0) -> dict:
        return self._entities(search.by_type(self.state.entities, entity_type), sort_by, sort_dir, cursor)

    def get_entity_types(self, cursor=0) -> dict:
        return self._page(summary.entity_types(self.state.entities), [F.col("entity_type")], order.string_json("entity_type"), cursor)

    def get_relation_types(self, cursor=0) -> dict:
        return self._page(summary.relation_types(self.state.relations), [F.col("rel_type")], order.string_json("rel_type"), cursor)

    def get_stats(self) -> dict:
        return summary.stats(self.state.entities, self.state.relations).first().asDict()

    def get_orphaned_entities(self, strict=False, sort_by="llmrank", sort_dir=None, cursor=0) -> dict:
        found = (audit.strict_orphans if strict else audit.orphans)(self.state.entities, self.state.relations)
        return self._entities(found, sort_by, sort_dir, cursor)

    def validate_graph(self, missing_cursor=0, violations_cursor=0) -> dict:
        missing = audit.missing_endpoints(self.state.entities, self.state.relations)
        broken = audit.violations(self.state.entities).select(F.col("name").alias("entity"), "count", F.col("oversized").alias("oversizedObservations"))
        return {
            "missingEntities": self._page(missing, [F.col("name")], order.string_json("name"), missing_cursor),
            "observationViolations": self._page(broken, [F.col("entity")], order.item_json("entity", "count", "oversizedObservations"), violations_cursor),
        }

    def decode_timestamp(self, timestamp: int | None = None, relative=False) -> dict:
        now = self.clock()
        at = F.lit(now if timestamp is None else timestamp).cast("bigint")
        return self.spark.range(1).select(timestamps.decoded(at, F.lit(now).cast("bigint") if relative else None).alias("t")).first()["t"].asDict()

    def random_walk(self, start: str, depth=3, seed: str | None = None, direction="forward", mode="merw") -> dict:
        search.require(self.state.entities, start)
        psi = self.state.ranks.filter("psi IS NOT NULL").select("name", "psi")
        first = self.spark.createDataFrame([(start, walk.seed_number(str(self.clock()) if seed is None else seed))], "name string, state long")
        row = walk.walks_from(first, self.state.relations, psi, direction, mode, depth).first()
        return {"entity": row["entity"], "path": row["path"]}
