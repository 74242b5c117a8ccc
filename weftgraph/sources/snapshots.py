"""Versioned Parquet snapshots of a graph: immutable folders and numbered pointers, of which the highest counts.

A write makes a new folder, then a pointer file with the next number, which appears whole by a rename; no pointer is ever changed. So
readers, who need no lock, see one whole state or the next, whenever a writer stops, and the folder before is a backup. Writers take
turns by a lock with an owner and a time after which it no longer holds; of two that still meet, the file system lets one have the next
number. All access goes through Spark's file system of the path, so that a store need not be local.
"""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.schema import ENTITIES, RANKS, RELATIONS, GraphError, GraphState

FORMAT, POINTER, LOCK = 3, "_CURRENT", "_LOCK"
#: Seconds after which a writer's lock no longer holds; pointers that are kept.
HELD, KEPT = 3600, 8
#: What a table of an earlier format lacks, with what to put there.
DEFAULTS = {"obs_mtime": "CAST(NULL AS bigint)", "mtime": "CAST(NULL AS bigint)", "structural_visits": "0L", "walker_visits": "0L", "psi": "CAST(NULL AS double)"}


class Store:
    def __init__(self, spark: SparkSession, path: str, held: float = HELD, clock=time.time):
        self.spark, self.path, self.held, self.clock = spark, path.rstrip("/"), held, clock
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils

    def _read(self, name: str) -> str | None:
        at = self._path(f"{self.path}/{name}")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return bytes(self._io.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _put(self, name: str, text: str, overwrite: bool) -> None:
        stream = self._fs.create(self._path(f"{self.path}/{name}"), overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def _pointers(self) -> list[tuple[int, str]]:
        """Numbers and names of the pointers, the highest last; one without a number is older than all others."""
        at = self._path(self.path)
        names = [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []
        found = [re.fullmatch(rf"{POINTER}(?:-([0-9]+))?", n) for n in names]
        return sorted((int(m[1] or 0), m[0]) for m in found if m)

    def _current(self) -> tuple[int, dict | None]:
        """The highest pointer's number and content; pointers that are cleared meanwhile are passed over."""
        for number, name in reversed(self._pointers()):
            held = self._read(name)
            if held is not None:
                return number, json.loads(held)
        return 0, None

    def _point(self, before: int, content: dict) -> None:
        """The next pointer, whole or not at all; refused if another writer has taken its number."""
        new, name = f"_NEW-{uuid.uuid4().hex}", f"{POINTER}-{before + 1:012d}"
        self._put(new, json.dumps(content), overwrite=False)
        taken = self._fs.exists(self._path(f"{self.path}/{name}")) or not self._fs.rename(self._path(f"{self.path}/{new}"), self._path(f"{self.path}/{name}"))
        if taken:
            self._fs.delete(self._path(f"{self.path}/{new}"), False)
            raise GraphError(f"{self.path} was written meanwhile")
        for _, old in self._pointers()[:-KEPT]:
            self._fs.delete(self._path(f"{self.path}/{old}"), False)

    def state(self) -> str:
        """fresh, old (an earlier format) or current."""
        held = self._current()[1]
        return "fresh" if held is None else "current" if held["format"] == FORMAT else "old"

    def read(self) -> GraphState:
        """The current snapshot; a format that is newer than this one is refused, earlier ones are brought up to date."""
        current = self._current()[1]
        if current is None:
            return GraphState.empty(self.spark)
        if not 1 <= current["format"] <= FORMAT:
            raise GraphError(f"{self.path} has format {current['format']}, which is unknown")
        table = lambda name, schema: upgraded(self.spark.read.parquet(f"{self.path}/{current['snapshot']}/{name}"), schema)
        return GraphState(table("entities", ENTITIES), table("relations", RELATIONS), table("ranks", RANKS))

    def _lock(self) -> str:
        """The owner's name of the lock taken; one that no longer holds is put aside, which only one of several writers can do."""
        owner = uuid.uuid4().hex
        for _ in range(2):
            try:
                self._put(LOCK, json.dumps({"owner": owner, "until": self.clock() + self.held}), overwrite=False)
                return owner
            except Exception as taken:
                text = self._read(LOCK)
                try:
                    until = json.loads(text or "{}").get("until")
                except (ValueError, AttributeError):  # not whole yet, or of an earlier form
                    until = None
                at = self._path(f"{self.path}/{LOCK}")
                if text is not None and until is None and self._fs.exists(at):
                    until = self._fs.getFileStatus(at).getModificationTime() / 1000 + self.held
                if until is not None and until >= self.clock():
                    raise GraphError(f"{self.path} is being written") from taken
                aside = self._path(f"{self.path}/_STALE-{owner}")
                if text is not None and self._fs.rename(at, aside):
                    self._fs.delete(aside, False)
        raise GraphError(f"{self.path} is being written")

    def _unlock(self, owner: str) -> None:
        if self._owner() == owner:
            self._fs.delete(self._path(f"{self.path}/{LOCK}"), False)

    def _owner(self) -> str | None:
        try:
            return json.loads(self._read(LOCK) or "{}").get("owner")
        except ValueError:
            return None

    def write(self, state: GraphState) -> str:
        """A new snapshot, by one writer at a time; the one before stays as backup. Returns its name.

        A writer that stops anywhere leaves the current snapshot as it is.
        """
        owner = self._lock()
        try:
            before, held = self._current()
            name = f"snapshot-{uuid.uuid4().hex}"
            for part, df in (("entities", state.entities), ("relations", state.relations), ("ranks", state.ranks)):
                df.write.parquet(f"{self.path}/{name}/{part}")
            if self._owner() != owner:
                raise GraphError(f"{self.path} was taken over by another writer, as this one took longer than {self.held} seconds")
            self._point(before, {"format": FORMAT, "snapshot": name, "previous": held["snapshot"] if held else None})
            return name
        finally:
            self._unlock(owner)

    def rollback(self) -> None:
        """Back to the snapshot before."""
        owner = self._lock()
        try:
            before, current = self._current()
            if not current or not current.get("previous"):
                raise GraphError(f"{self.path} has no earlier snapshot")
            self._point(before, {"format": FORMAT, "snapshot": current["previous"], "previous": None})
        finally:
            self._unlock(owner)


def upgraded(df: DataFrame, schema: str) -> DataFrame:
    """The columns of the schema, in its order and types; those that an earlier format lacks by their defaults."""
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    return df.select(*(F.col(n).cast(t).alias(n) if n in df.columns else F.expr(DEFAULTS[n]).cast(t).alias(n) for n, t in fields))


def report(state: GraphState, sample: int = 5) -> tuple[int, int, DataFrame]:
    """Entities, relations, and a few rows with the number of relations from each."""
    rows = state.entities.orderBy("seq").limit(sample)
    out = state.relations.groupBy(F.col("src").alias("name")).agg(F.count("*").alias("relations"))
    return state.entities.count(), state.relations.count(), rows.join(out, "name", "left").na.fill(0, ["relations"])


def document_nodes(state: GraphState, title: str) -> DataFrame:
    """name, entity_type of what a loaded document is made of: its node, its chain of chunks, its index and the index entries."""
    from weftgraph.operators.traverse import reachable

    chunks = state.relations.filter((F.col("src") == title) & (F.col("rel_type") == "starts_with")).select(F.col("dst").alias("name"))
    follows = state.relations.filter("rel_type = 'follows'")
    chain = reachable(follows, chunks, "forward").select("name")
    index = state.entities.filter((F.col("entity_type") == "DocumentIndex") & F.col("name").startswith(f"{title}__i")).select("name")
    own = state.entities.filter((F.col("name") == title) & (F.col("entity_type") == "Document")).select("name")
    names = chain.unionByName(index).unionByName(own).distinct()
    return state.entities.join(names, "name", "left_semi").select("name", "entity_type")


def delete_document(state: GraphState, title: str) -> GraphState:
    """Without a loaded document; document_nodes tells beforehand what goes."""
    from weftgraph.operators.mutate import delete_entities

    return delete_entities(state, document_nodes(state, title).select("name"))
