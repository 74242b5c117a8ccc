import struct

import pytest

from weftgraph.operators import rank, text
from weftgraph.schema import GraphError
from weftgraph.sources import legacy
from weftgraph.sources.snapshots import Store


def store_bytes(version, entities, relations):
    """A hand-made store of an old format."""
    strings, place = bytearray(b"\x00" * 64), {}

    def text_at(s):
        if s not in place:
            place[s] = len(strings)
            raw = s.encode()
            strings.extend(struct.pack("<IIH", 1, 0, len(raw)) + raw)
        return place[s]

    size = 72 if version == 2 else 64
    offsets = {e[0]: 128 + i * size for i, e in enumerate(entities)}
    body, tail = bytearray(b"\x00" * (128 + size * len(entities))), 128 + size * len(entities)
    struct.pack_into("<II", body, 0, 0x1234, version)
    edges = {}
    for a, b, r, when in relations:
        edges.setdefault(a, []).append((offsets[b] << 2, r, when))
        edges.setdefault(b, []).append((offsets[a] << 2 | 1, r, when))
    adjacency = {}
    for name, rows in edges.items():
        adjacency[name] = tail
        block = struct.pack("<II", len(rows), len(rows)) + b"".join(struct.pack("<QI4xQ", t, text_at(r), w) for t, r, w in rows)
        body += block
        tail += len(block)
    for name, kind, obs, mtime, obs_mtime, sv, wv, psi in entities:
        o = [text_at(x) for x in obs] + [0, 0]
        struct.pack_into("<IIQQQI2I4xQQ", body, offsets[name], text_at(name), text_at(kind), adjacency.get(name, 0), mtime, obs_mtime, len(obs), o[0], o[1], sv, wv)
        if version == 2:
            struct.pack_into("<d", body, offsets[name] + 64, psi)
    struct.pack_into("<QQQ", body, 40, tail, 0, 0)
    body += struct.pack("<II", len(entities), len(entities)) + b"".join(struct.pack("<Q", offsets[e[0]]) for e in entities)
    return bytes(body), bytes(strings)


ENTITIES = [("Alice", "Person", ["likes tea"], 10, 11, 0, 2, 0.42), ("Bob", "Person", [], 20, 0, 1, 0, 0.0), ("Acmé", "Org", ["a", "b"], 0, 0, 0, 0, 0.1)]
LINKS = [("Alice", "Bob", "KNOWS", 30), ("Alice", "Acmé", "WORKS_AT", 0)]


@pytest.mark.parametrize("version", [1, 2])
def test_migrate(spark, tmp_path, version):
    for part, raw in zip(("graph", "strings"), store_bytes(version, ENTITIES, LINKS), strict=True):
        (tmp_path / f"old.{part}").write_bytes(raw)
    new = legacy.migrate(spark, str(tmp_path / "old"), Store(spark, str(tmp_path / "new")))
    rows = [(r.name, r.entity_type, r.observations, r.mtime, r.obs_mtime) for r in new.entities.orderBy("seq").collect()]
    assert rows == [e[:5] for e in ENTITIES]
    assert {(r.src, r.dst, r.rel_type, r.mtime) for r in new.relations.collect()} == set(LINKS)
    assert {(r.name, r.structural_visits, r.walker_visits, r.psi) for r in new.ranks.collect()} == {(e[0], e[5], e[6], e[7] if version == 2 else 0.0) for e in ENTITIES}


def test_other_formats():
    with pytest.raises(GraphError):
        legacy.decode(struct.pack("<II", 0, 3) + b"\x00" * 60, b"")


def test_sampled_visits_near_expectation(spark):
    names = [f"n{i}" for i in range(300)]
    entities = spark.createDataFrame([(n,) for n in names], "name string")
    relations = spark.createDataFrame([(i, n, "hub", "r", 0) for i, n in enumerate(names[1:])] + [(999, "hub", "n0", "r", 0)], "seq long, src string, dst string, rel_type string, mtime long")
    entities = entities.unionByName(spark.createDataFrame([("hub",)], "name string"))
    one, two = ({r.name: r.visits for r in rank.sampled_visits(entities, relations, seed=3).collect()} for _ in range(2))
    want = {r.name: r.visits for r in rank.structural_rank(entities, relations, 30).collect()}
    assert one == two and abs(one["hub"] - want["hub"]) < 30 and abs(one["n0"] - want["n0"]) < 35 and one["n5"] == 1


def test_packed(spark):
    from pyspark.sql import functions as F

    rows = [(["x" * 70, "short", "y" * 60, "z" * 60, "w"],), ([],), (["a"],)]
    got = [r[0] for r in spark.createDataFrame(rows, "p array<string>").select(text.packed(F.col("p"))).collect()]
    assert got == [["x" * 57 + "... | short | " + "y" * 60, "z" * 60 + " | w"], [], ["a"]]
