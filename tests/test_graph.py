import pytest
from pyspark.sql import functions as F

from weftgraph.api import Graph
from weftgraph.operators import audit, mutate, order, rank, search, traverse, walk
from weftgraph.schema import ENTITIES, GraphError, GraphState
from weftgraph.sources.snapshots import Store, delete_document, document_nodes, report


class Clock:
    now = 1000

    def __call__(self):
        Clock.now += 1
        return Clock.now


def build(spark, entities, relations=()):
    g = Graph(spark, clock=Clock())
    g.create_entities([{"name": n, "entityType": t, "observations": list(o)} for n, t, o in entities])
    if relations:
        g.create_relations([{"from": a, "relationType": r, "to": b} for a, r, b in relations])
    return g


@pytest.fixture(scope="module")
def tree(spark):
    names = [(n, "Node", ()) for n in ("Root", "Child1", "Child2", "Grandchild", "Isolated")]
    return build(spark, names, [("Root", "parent_of", "Child1"), ("Root", "parent_of", "Child2"), ("Child1", "parent_of", "Grandchild")])


def names(df):
    return sorted(r.name for r in df.select("name").collect())


def test_upsert_rules(spark):
    g = build(spark, [("Alice", "Person", ["Likes coding"])])
    new = g.create_entities([{"name": "Alice", "entityType": "Person", "observations": ["Likes coding"]}, {"name": "Bob", "entityType": "Person", "observations": []}])
    assert [n["name"] for n in new] == ["Bob"]
    with pytest.raises(GraphError, match="already exists"):
        g.create_entities([{"name": "Alice", "entityType": "Person", "observations": ["other"]}])
    with pytest.raises(GraphError, match="Maximum allowed is 2"):
        g.create_entities([{"name": "C", "entityType": "P", "observations": ["1", "2", "3"]}])
    with pytest.raises(GraphError, match="exceeds 140 characters"):
        g.create_entities([{"name": "C", "entityType": "P", "observations": ["x" * 141]}])
    assert g.get_stats()["entity_count"] == 2
    rows = {r.name: r for r in g.state.entities.collect()}
    assert rows["Alice"].obs_mtime == rows["Alice"].mtime and rows["Bob"].obs_mtime is None


def test_observations(spark):
    g = build(spark, [("E", "T", ["Existing"]), ("F", "T", ["Keep", "Delete"])])
    assert g.add_observations([{"entityName": "E", "contents": ["Existing", "New"]}]) == [{"name": "E", "added": ["New"]}]
    with pytest.raises(GraphError, match="would exceed limit of 2"):
        g.add_observations([{"entityName": "E", "contents": ["Three"]}])
    with pytest.raises(GraphError, match="not found"):
        g.add_observations([{"entityName": "Nobody", "contents": ["x"]}])
    g.delete_observations([{"entityName": "F", "observations": ["Delete", "absent"]}])
    rows = {r.name: r for r in g.state.entities.collect()}
    assert rows["F"].observations == ["Keep"] and rows["E"].observations == ["Existing", "New"]


def test_relations_and_cascade(spark):
    g = build(spark, [(n, "T", ()) for n in "ABC"], [("A", "r", "B")])
    made = g.create_relations([{"from": a, "relationType": "r", "to": b} for a, b in (("A", "B"), ("A", "C"), ("A", "C"), ("A", "missing"))])
    assert made == [{"src": "A", "dst": "C", "rel_type": "r"}]
    before = {r.name: r.mtime for r in g.state.entities.collect()}
    assert before["A"] > before["B"]
    g.delete_relations([{"from": "A", "relationType": "r", "to": "C"}, {"from": "x", "relationType": "r", "to": "y"}])
    g.delete_entities(["A", "nobody"])
    assert g.get_stats() == {"entity_count": 2, "relation_count": 0, "entity_types": 1, "relation_types": 0}


def test_search(spark):
    g = build(spark, [("JavaScript", "Language", ["Dynamic typing"]), ("TypeScript", "Language", ["Static typing"]), ("Python", "Language", ["Dynamic typing"])], [("TypeScript", "extends", "JavaScript")])
    found = lambda q, **k: g.search_nodes(q, **k)
    assert found("Script")["entities"]["totalCount"] == 2
    assert found("JavaScript|Python")["entities"]["totalCount"] == 2
    assert found("Static")["relations"]["totalCount"] == 1
    assert found("JavaScript")["relations"]["totalCount"] == 0
    assert found("JavaScript", direction="backward")["relations"]["totalCount"] == 1
    assert found("Script", direction="any")["relations"]["totalCount"] == 1
    assert found("^script$")["entities"]["totalCount"] == 0  # case counts
    with pytest.raises(GraphError, match="knowledge|graph"):
        found("knowledge graph")
    with pytest.raises(GraphError, match="Invalid regex"):
        found("[x")
    assert search.words_hint("Slef", 0, 0).count("Try") == 0 and search.words_hint("a|b", 0, 0) is None
    with pytest.raises(GraphError):
        g.search_nodes("Script", direction="sideways")


def test_open_nodes(spark):
    g = build(spark, [(n, "T", ()) for n in "ABC"], [("A", "p", "B"), ("A", "p", "C")])
    got = g.open_nodes(["B", "A", "A", "none"])
    assert got["entities"]["totalCount"] == 3 and got["relations"]["totalCount"] == 2
    assert g.open_nodes(["A", "B"], direction="any")["relations"]["totalCount"] == 3
    assert g.open_nodes(["B"], direction="backward")["relations"]["totalCount"] == 1
    visits = {r.name: r.walker_visits for r in g.state.ranks.collect()}
    assert visits == {"A": 3, "B": 3, "C": 0}


def test_neighbours(tree):
    e, r = tree.state.entities, tree.state.relations
    got = lambda *a: names(traverse.neighbours(e, r, *a))
    assert got("Root", 0) == ["Child1", "Child2"]
    assert got("Root", 1) == ["Child1", "Child2", "Grandchild"]
    assert got("Grandchild", 0, "backward") == ["Child1"]
    assert got("Child1", 0, "any") == ["Grandchild", "Root"]
    assert got("Nobody", 3) == [] and got("Isolated", 3) == []


def path(g, *a, **k):
    found = traverse.find_path(g.state.entities, g.state.relations, *a, **k)
    return [(r.src, r.dst) for r in found.path.orderBy("hop").collect()], found


def test_paths(spark, tree):
    assert path(tree, "Root", "Grandchild")[0] == [("Root", "Child1"), ("Child1", "Grandchild")]
    hops, found = path(tree, "Root", "Isolated")
    assert not found.reached and found.farthest == "Grandchild" and len(hops) == 2 and "Isolated" in traverse.path_note(found, "Isolated")
    assert path(tree, "Root", "Root")[1].reached and not path(tree, "Root", "Nobody")[1].reached
    hops, found = path(tree, "Solo", "Solo")
    assert hops == [] and found.reached
    chain = build(spark, [(f"n{i}", "T", ()) for i in range(8)], [(f"n{i}", "r", f"n{i + 1}") for i in range(7)])
    assert len(path(chain, "n0", "n7", max_depth=10)[0]) == 7
    hops, found = path(chain, "n0", "n7", max_depth=3)
    assert not found.reached and not found.exhausted and found.farthest == "n3" and len(hops) == 3
    assert path(chain, "n0", "n7", max_depth=10, budget=100)[1].exhausted
    hops, found = path(chain, "n0", "n2", budget=0)
    assert found.exhausted and found.farthest == "n1" and hops == [("n0", "n1")]
    assert path(chain, "n0", "n1", budget=0)[1].reached
    assert path(chain, "n2", "n0", way="backward")[0] == [("n1", "n2"), ("n0", "n1")]
    cycle = build(spark, [(n, "T", ()) for n in ("P", "Q", "R", "Target")], [("P", "r", "Q"), ("Q", "r", "R"), ("R", "r", "P"), ("R", "r", "Target")])
    assert len(path(cycle, "P", "Target")[0]) == 3


def test_orphans_and_audit(spark):
    g = build(spark, [(n, "T", ()) for n in ("Self", "Near", "Far", "I1", "I2", "Alone", "Loop")], [("Self", "r", "Near"), ("Far", "r", "Near"), ("I1", "r", "I2"), ("Loop", "r", "Loop")])
    e, r = g.state.entities, g.state.relations
    assert names(audit.orphans(e, r)) == ["Alone"]
    assert names(audit.strict_orphans(e, r)) == ["Alone", "I1", "I2", "Loop"]
    assert len(names(audit.strict_orphans(e.filter("name <> 'Self'"), r))) == 6
    assert names(audit.missing_endpoints(e.filter("name <> 'I2'"), r)) == ["I2"]
    odd = spark.createDataFrame([("a", ["x" * 141, "y", "z" * 200]), ("b", ["😀" * 70]), ("c", ["😀" * 71]), ("d", [])], "name string, observations array<string>")
    assert [(v.name, v["count"], v.oversized) for v in audit.violations(odd).orderBy("name").collect()] == [("a", 3, [0, 2]), ("c", 1, [0])]


def test_order_and_pages(spark):
    g = build(spark, [(n, "T", ()) for n in ("b", "A", "a", "B", "é", "z")])
    rows = g.get_entities_by_type("T", sort_by="name")
    import json

    assert [json.loads(i)["name"] for i in rows["items"]] == ["a", "A", "b", "B", "é", "z"]
    g.open_nodes(["z", "z", "B"])
    assert [json.loads(i)["name"] for i in g.get_entities_by_type("T")["items"]][:2] == ["z", "B"]
    big = build(spark, [(f"L_{i}_" + "x" * (4500 if i == 3 else 900), "T", ()) for i in range(8)])
    seen, cursor, pages = [], 0, 0
    while cursor is not None:
        got = big.get_entities_by_type("T", sort_by="name", cursor=cursor)
        assert got["items"]
        seen += [json.loads(i)["name"] for i in got["items"]]
        cursor, pages = got["nextCursor"], pages + 1
        assert pages < 20
    assert len(seen) == 8 and seen == sorted(seen, key=lambda n: int(n.split("_")[1]))
    with pytest.raises(GraphError):
        order.sort_columns("colour")


def test_ranks(spark):
    star = build(spark, [(n, "T", ()) for n in ("Hub", "L1", "L2", "L3")], [("Hub", "r", f"L{i}") for i in (1, 2, 3)])
    got = {r.name: r for r in rank.structural_rank(star.state.entities, star.state.relations, 10).collect()}
    assert got["Hub"].visits == 1 and abs(got["L1"].visits - (1 + 0.85 / 3)) < 1e-12 and abs(sum(r.rank for r in got.values()) - 1) < 1e-12
    ring = build(spark, [(n, "T", ()) for n in "ABC"], [("A", "r", "B"), ("B", "r", "C"), ("C", "r", "A"), ("A", "r", "C")])
    import numpy as np

    a = np.zeros((3, 3))
    for i, j in ((0, 1), (1, 2), (2, 0), (0, 2)):
        a[i, j] += 1
    v = np.ones(3) / 3**0.5
    for _ in range(200):
        v = 0.85 * a.T @ v + 0.15 / 3 * v.sum()
        v /= np.linalg.norm(v)
    got = {r.name: r.psi for r in rank.entropy_psi(ring.state.entities, ring.state.relations, 60).collect()}
    assert np.allclose([got[n] for n in "ABC"], v, atol=1e-6)
    warm = rank.entropy_psi(ring.state.entities, ring.state.relations, 1, warm=spark.createDataFrame(list(got.items()), "name string, psi double"))
    assert np.allclose([{r.name: r.psi for r in warm.collect()}[n] for n in "ABC"], v, atol=1e-6)
    assert rank.entropy_psi(star.state.entities.limit(0), star.state.relations.limit(0)).count() == 0


def test_walks(spark):
    g = build(spark, [(n, "T", ()) for n in ("Center", "North", "South", "East", "Isolated")], [("Center", "r", n) for n in ("North", "South", "East")] + [("North", "r", "South"), ("Center", "s", "North"), ("East", "r", "East")])
    one, two = (g.random_walk("Center", seed="same") for _ in range(2))
    assert one == two and one["path"][0] == "Center" and one["entity"] == one["path"][-1]
    assert g.random_walk("Isolated", seed="x")["path"] == ["Isolated"]
    with pytest.raises(GraphError):
        g.random_walk("Nobody")
    table = walk.transitions(g.state.relations, None, "forward", "uniform")
    assert {(r.node, r.other): round(r.p, 6) for r in table.collect()} == {("Center", "North"): 0.333333, ("Center", "South"): 0.333333, ("Center", "East"): 0.333333, ("North", "South"): 1.0}
    starts = spark.createDataFrame([(n, k) for k, n in enumerate(("Center", "North", "East", "Center", "nobody"), 3)], "name string, state long")
    assert sorted(map(tuple, walk.walks_from(starts, g.state.relations, None, "any", "uniform", 4).collect())) == sorted(map(tuple, walk.random_walks(starts, walk.transitions(g.state.relations, None, "any", "uniform"), 4).collect()))
    state = 12345
    for _ in range(3):
        state ^= (state << 13) & (2**64 - 1)
        state ^= state >> 7
        state ^= (state << 17) & (2**64 - 1)
    col = F.lit(12345).cast("bigint")
    for _ in range(3):
        col = walk.advanced(col)
    assert spark.range(1).select(col).first()[0] % 2**64 == state
    assert walk.seed_number("a") == 97 and walk.seed_number("") == 1


def test_thoughts_and_time(spark):
    g = Graph(spark, clock=lambda: 1735200060000)
    first = g.sequential_thinking(["one"])
    second = g.sequential_thinking(["two"], first)
    assert {(r.src, r.dst, r.rel_type) for r in g.state.relations.collect()} == {(first, second, "follows"), (second, first, "preceded_by")}
    g.sequential_thinking(["three"], "no such")
    assert g.get_stats()["relation_count"] == 2
    with pytest.raises(GraphError):
        g.sequential_thinking(["1", "2", "3"])
    got = g.decode_timestamp(1735200000000, relative=True)
    assert got == {"timestamp": 1735200000000, "iso8601": "2024-12-26T08:00:00.000Z", "formatted": "Thu, 26 Dec 2024 08:00:00 GMT", "relative": "1 minutes ago"}
    assert g.decode_timestamp(1735200060000 + 363 * 86_400_000, relative=True)["relative"] == "in 12 months"


def test_model(spark):
    """Seeded changes against a plain model."""
    import random

    rng = random.Random(4)
    g, entities, relations = Graph(spark, clock=Clock()), {}, set()
    for _ in range(12):
        new = [f"e{rng.randrange(12)}" for _ in range(3)]
        g.create_entities([{"name": n, "entityType": "T", "observations": []} for n in new])
        entities.update(dict.fromkeys(new))
        links = [(f"e{rng.randrange(12)}", f"e{rng.randrange(12)}") for _ in range(4)]
        g.create_relations([{"from": a, "to": b, "relationType": "r"} for a, b in links])
        relations |= {x for x in links if x[0] in entities and x[1] in entities}
        if rng.random() < 0.5:
            gone = f"e{rng.randrange(12)}"
            g.delete_entities([gone])
            entities.pop(gone, None)
            relations = {x for x in relations if gone not in x}
    assert names(g.state.entities) == sorted(entities) and {(r.src, r.dst) for r in g.state.relations.collect()} == relations
    seqs = [r.seq for r in g.state.entities.collect()]
    assert len(set(seqs)) == len(seqs)


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "graph"))
    assert store.state() == "fresh" and store.read().entities.count() == 0
    g = build(spark, [("A", "T", ["x"]), ("B", "T", [])], [("A", "r", "B")])
    store.write(g.state)
    g.delete_entities(["B"])
    store.write(g.state)
    assert store.state() == "current" and names(store.read().entities) == ["A"]
    store.rollback()
    assert names(store.read().entities) == ["A", "B"] and report(store.read())[:2] == (2, 1)
    with pytest.raises(GraphError):
        store.rollback()
    (tmp_path / "graph" / "_LOCK").write_text("x")
    with pytest.raises(GraphError, match="being written"):
        store.write(g.state)


def test_upgrade(spark):
    from weftgraph.sources.snapshots import upgraded

    old = spark.createDataFrame([(0, "a", "T", ["x"])], "seq bigint, name string, entity_type string, observations array<string>")
    assert upgraded(old, ENTITIES).first().asDict() == {"seq": 0, "name": "a", "entity_type": "T", "observations": ["x"], "mtime": None, "obs_mtime": None}


def test_empty(spark):
    g = Graph(spark)
    assert g.get_stats() == {"entity_count": 0, "relation_count": 0, "entity_types": 0, "relation_types": 0}
    assert g.get_entity_types()["items"] == [] and g.validate_graph()["missingEntities"]["totalCount"] == 0
    assert mutate.delete_entities(GraphState.empty(spark), spark.createDataFrame([("x",)], "name string")).entities.count() == 0


def test_document(spark, tmp_path):
    text = "Abstract interpretation approximates programs. It computes fixpoints over lattices of abstract values. Widening makes the iteration end in finitely many steps. " * 6
    (tmp_path / "absint.txt").write_text(text)
    g = build(spark, [("seed", "Note", ["abstract values of programs"])])
    got = g.load_document(str(tmp_path / "absint.txt"), top=3)
    assert got["chunks"] > 1 and got["sentences"] == 18 and 1 <= got["highlights"] <= 3
    assert got["entities"] == 2 + got["chunks"] + got["highlights"]
    assert got["relations"] == 4 + 2 * (got["chunks"] - 1) + 2 + 4 * got["highlights"]
    parts = document_nodes(g.state, "absint")  # what would go
    assert parts.count() == got["entities"] and set(names(g.state.entities)) == {"seed", *names(parts)}
    g.state = delete_document(g.state, "absint")
    assert names(g.state.entities) == ["seed"] and document_nodes(g.state, "absint").count() == 0
    from weftgraph.sources.plaintext import check_extension

    for bad in ("a.pdf", "noext"):
        with pytest.raises(GraphError):
            check_extension(bad)


class Stops(Exception):
    pass


@pytest.mark.parametrize("at", ["_put", "_point", "rename"])
def test_writer_that_stops(spark, tmp_path, monkeypatch, at):
    """A writer that stops before, between or after the steps of moving the pointer leaves the snapshot before, and its lock ends."""
    now = [1000.0]
    store = Store(spark, str(tmp_path / "graph"), held=60, clock=lambda: now[0])
    g = build(spark, [("A", "T", ["x"])])
    store.write(g.state)
    g.create_entities([{"name": "B", "entityType": "T", "observations": []}])
    with monkeypatch.context() as patch:
        patch.setattr(store, "_unlock", lambda owner: None)  # as if its process had ended
        if at == "rename":
            put = store._put

            def stops(name, text, overwrite):
                put(name, text, overwrite)
                if name.startswith("_NEW"):
                    raise Stops

            patch.setattr(store, "_put", stops)
        else:

            def stops(*a, **k):
                if at == "_point" or a[0] != "_LOCK":
                    raise Stops
                return Store._put(store, *a, **k)

            patch.setattr(store, at, stops)
        with pytest.raises(Stops):
            store.write(g.state)
    again = Store(spark, str(tmp_path / "graph"), held=60, clock=lambda: now[0])
    assert names(again.read().entities) == ["A"] and again.state() == "current"
    with pytest.raises(GraphError, match="being written"):
        again.write(g.state)
    now[0] += 61
    again.write(g.state)
    assert names(again.read().entities) == ["A", "B"] and not (tmp_path / "graph" / "_LOCK").exists()


def test_slow_writer_and_numbers(spark, tmp_path):
    """A writer whose lock was taken over changes nothing, and of two one gets the next number."""
    now = [0.0]
    g = build(spark, [("A", "T", [])])
    slow, fast = (Store(spark, str(tmp_path / "graph"), held=10, clock=lambda: now[0]) for _ in range(2))
    owner = slow._lock()
    now[0] = 11.0
    fast.write(g.state)
    assert slow._owner() != owner
    slow._unlock(owner)
    with pytest.raises(GraphError, match="meanwhile"):
        slow._point(0, {"format": 3, "snapshot": "x", "previous": None})
    for _ in range(12):
        number, held = fast._current()
        fast._point(number, held)
    assert len(fast._pointers()) <= 9 and names(fast.read().entities) == ["A"]


def test_pointer_of_before(spark, tmp_path):
    store = Store(spark, str(tmp_path / "graph"))
    name = store.write(build(spark, [("A", "T", [])]).state)
    (number, pointer), at = store._pointers()[-1], tmp_path / "graph"
    (at / pointer).rename(at / "_CURRENT")
    assert number == 1 and names(store.read().entities) == ["A"]
    store.write(build(spark, [("B", "T", [])]).state)
    assert names(store.read().entities) == ["B"] and store._current()[1]["previous"] == name


def test_pages_of_strings(spark):
    g = build(spark, [("A", "T1", []), ("B", 'T"2', ["x" * 140])], [("A", "rel", "B")])
    assert g.get_entity_types()["items"] == ['"T\\"2"', '"T1"'] and g.get_relation_types()["items"] == ['"rel"']
    g.state = GraphState(g.state.entities.filter("name = 'A'").withColumn("observations", F.array(F.lit("y" * 150), F.lit("z"))), g.state.relations, g.state.ranks)
    got = g.validate_graph()
    assert got["missingEntities"]["items"] == ['"B"'] and got["observationViolations"]["items"] == ['{"entity":"A","count":2,"oversizedObservations":[0]}']
    import json

    zero = GraphState(g.state.entities.withColumns({"mtime": F.lit(0).cast("bigint"), "obs_mtime": F.lit(5).cast("bigint")}), g.state.relations, g.state.ranks)
    g.state = zero
    item = json.loads(g.open_nodes(["A"])["entities"]["items"][0])
    assert "mtime" not in item and item["obsMtime"] == 5


def test_visits_are_logged_and_folded(spark, monkeypatch):
    from weftgraph import api

    monkeypatch.setattr(api, "LOG", 3)
    g = build(spark, [("A", "T", []), ("B", "T", [])], [("A", "r", "B")])
    base = g._base.ranks
    for k in range(1, 6):
        g.search_nodes("^A$")
        assert {r.name: r.walker_visits for r in g.state.ranks.collect()} == {"A": k, "B": 0} and len(g._log) == k % 3
    assert g._base.ranks is not base
    entities = g._base.entities
    g.create_relations([{"from": "B", "relationType": "r", "to": "A"}])
    assert {r.name: r.walker_visits for r in g.state.ranks.collect()} == {"A": 5, "B": 0} and g._base.entities is not entities
    relations = g._base.relations
    g.add_observations([{"entityName": "A", "contents": ["o"]}])
    assert g._base.relations is relations and g.get_stats()["relation_count"] == 2
    other = Graph(spark, g.state)  # what it replaces is another graph's, and stays
    other.create_entities([{"name": "C", "entityType": "T", "observations": []}])
    assert names(other.state.entities) == ["A", "B", "C"] and names(g.state.entities) == ["A", "B"]


def test_hub_in_slots(spark, monkeypatch):
    """Ranks are the same if a hub's relations are dealt over many slots."""
    links = [("Hub", "r", f"L{i}") for i in range(40)] + [(f"L{i}", "r", "Hub") for i in range(0, 40, 3)] + [("L1", "r", "L2"), ("Hub", "s", "L1"), ("L5", "r", "gone")]
    entities = spark.createDataFrame([(i, n, "T", [], None, None) for i, n in enumerate(["Hub", *(f"L{i}" for i in range(40))])], ENTITIES)
    relations = spark.createDataFrame([(i, a, b, t, None) for i, (a, t, b) in enumerate(links)], "seq bigint, src string, dst string, rel_type string, mtime bigint")
    both = []
    for hub in (100_000, 3):
        monkeypatch.setattr(rank, "HUB", hub)
        nodes, edges = rank.numbered(entities, relations)
        assert nodes.filter("name = 'Hub'").first().slots == (1 if hub > 3 else 14) and edges.count() == len(links) - 1
        assert edges.select("src", "slot").distinct().count() > (60 if hub == 3 else 0) - 60
        one = {r.name: (round(r.visits, 9), round(r.rank, 9)) for r in rank.structural_rank(entities, relations, 8).collect()}
        both.append((one, {r.name: round(r.psi, 9) for r in rank.entropy_psi(entities, relations, 30).collect()}))
    assert both[0] == both[1] and len(both[0][0]) == 41


def test_running_sums(spark):
    import random

    from weftgraph.operators.running import running

    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.8 else f"k{rng.randrange(5)}", i * 7919 % 4001, rng.randrange(9)) for i in range(3000)]
    got = running(spark.createDataFrame(rows, "k string, o int, v int").repartition(7), ["k"], ["o"], total="v").collect()
    want, sums = {}, {}
    for k, o, v in sorted(rows):
        sums[k] = want[k, o] = sums.get(k, 0) + v
    assert {(r.k, r.o): r.total for r in got} == want


def test_medians_and_drift(spark, monkeypatch):
    import random
    import statistics

    from weftgraph.operators import measure

    rng = random.Random(8)
    rows = [(f"op{rng.randrange(3)}", i, float(rng.randrange(60) + (100 if i > 700 else 0))) for i in range(900)] + [("op0", 900, None), ("one", 1, 5.0)]
    df = spark.createDataFrame(rows, "op string, seq int, value double")
    by: dict = {}
    for k, i, v in rows:
        by.setdefault(k, []).append((i, v))
    got = {r.op: r["median"] for r in measure.medians(df).collect()}
    assert got == {k: statistics.median(v for _, v in x if v is not None) for k, x in by.items()}
    want = {}
    for k, x in by.items():
        for j, (i, v) in enumerate(x):
            before = [y for _, y in x[max(0, j - 20) : j] if y is not None]
            want[k, i] = statistics.median(before) if before else None
    for block in (10_000, 50):
        monkeypatch.setattr(measure, "DRIFT_BLOCK", block)
        assert {(r.op, r.seq): r.rolling for r in measure.drift(df).collect()} == want


def test_path_budget_by_default(spark):
    assert traverse.memory_budget(spark) > 1 << 20
    spark.conf.set("weftgraph.path.budget", "100")
    try:
        chain = build(spark, [(f"n{i}", "T", ()) for i in range(8)], [(f"n{i}", "r", f"n{i + 1}") for i in range(7)])
        assert chain.find_path("n0", "n7", max_depth=10)["budgetExhausted"] and not chain.find_path("n0", "n7", max_depth=10, budget=1 << 30)["budgetExhausted"]
    finally:
        spark.conf.unset("weftgraph.path.budget")
