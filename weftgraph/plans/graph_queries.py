"""Queries over the canonical graph of the trade tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftgraph.functions import timestamps
from weftgraph.operators import audit, measure, mutate, order, rank, search, summary, traverse, walk
from weftgraph.plans.lineage import written
from weftgraph.schema import PAGE_CHARS, GraphState, adjacency
from weftgraph.sources import jsonl, tables
from weftgraph.streaming.visits import windowed_visits

ENTITIES = """ents AS (
    SELECT CAST(r_regionkey AS BIGINT) AS seq, 'region:' || r_regionkey AS name, 'Region' AS entity_type, [r_name] AS observations, CAST(NULL AS BIGINT) AS mtime FROM region
    UNION ALL SELECT 1000000000000 + n_nationkey, 'nation:' || n_nationkey, 'Nation', [n_name], NULL FROM nation
    UNION ALL SELECT 2000000000000 + c_custkey, 'customer:' || c_custkey, 'Customer', [c_name, c_mktsegment], NULL FROM customer
    UNION ALL SELECT 3000000000000 + s_suppkey, 'supplier:' || s_suppkey, 'Supplier', [s_name], NULL FROM supplier
    UNION ALL SELECT 4000000000000 + p_partkey, 'part:' || p_partkey, 'Part', [p_name, p_brand], NULL FROM part
    UNION ALL SELECT 5000000000000 + o_orderkey, 'order:' || o_orderkey, 'Order', [o_orderpriority, o_orderstatus], epoch_ms(o_orderdate) FROM orders)"""
RELATIONS = """rels AS (
    SELECT CAST(n_nationkey AS BIGINT) AS seq, 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'in_region' AS rel_type, CAST(NULL AS BIGINT) AS mtime FROM nation
    UNION ALL SELECT 1000000000000000 + c_custkey, 'customer:' || c_custkey, 'nation:' || c_nationkey, 'in_nation', NULL FROM customer
    UNION ALL SELECT 2000000000000000 + s_suppkey, 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'in_nation', NULL FROM supplier
    UNION ALL SELECT 3000000000000000 + o_orderkey, 'order:' || o_orderkey, 'customer:' || o_custkey, 'placed_by', epoch_ms(o_orderdate) FROM orders
    UNION ALL SELECT 4000000000000000 + l_orderkey * 10000000 + l_partkey, 'order:' || l_orderkey, 'part:' || l_partkey, 'contains', max(epoch_ms(l_shipdate)) FROM lineitem GROUP BY l_orderkey, l_partkey
    UNION ALL SELECT 5000000000000000 + l_partkey * 10000000 + l_suppkey, 'part:' || l_partkey, 'supplier:' || l_suppkey, 'supplied_by', max(epoch_ms(l_shipdate)) FROM lineitem GROUP BY l_partkey, l_suppkey)"""
ADJACENCY = """adj AS (
    SELECT src AS node, dst AS other, 'forward' AS direction, rel_type, seq, src, dst FROM rels
    UNION ALL SELECT dst, src, 'backward', rel_type, seq, src, dst FROM rels)"""
VISITS = """visits AS (SELECT 'customer:' || user_id AS name, count(*) AS v FROM events GROUP BY 1),
walk AS (SELECT e.name, coalesce(v.v, 0) AS walker_visits FROM ents e LEFT JOIN visits v ON e.name = v.name)"""
GRAPH = f"WITH {ENTITIES}, {RELATIONS}"

#: What the search queries look for.
PATTERN, POSIX = "(BUILDING|MACHINERY)|^nation:1[0-9]$", "^Customer#0*[[:digit:]]{1,2}$"
HITS = "regexp_matches(name, '{p}') OR regexp_matches(entity_type, '{p}') OR len(list_filter(observations, lambda x: regexp_matches(x, '{p}'))) > 0"
OPENED = ["order:7", "nation:3", "customer:1", "order:7", "no such", "region:1", "part:2"]
NOW = 1_735_689_600_000


def _links(spark, d):
    """The relations as a table, for queries that read them once a step; deriving them sums the line items."""
    return written(tables.relations(spark, d))


def _flat(df):
    return df.withColumn("observations", F.array_join("observations", " | "))


def _search(pattern):
    return lambda spark, d: _flat(search.search_entities(tables.entities(spark, d), pattern)).select("name", "entity_type", "observations")


def _search_sql(pattern):
    return f"WITH {ENTITIES} SELECT name, entity_type, array_to_string(observations, ' | ') AS observations FROM ents WHERE {HITS.format(p=pattern)}"


def _among(way):
    def run(spark, d):
        found = search.search(tables.entities(spark, d), tables.relations(spark, d), PATTERN, way)[1]
        return found.select("src", "dst", "rel_type", F.coalesce("mtime", F.lit(0)).alias("mtime"))

    ends = {"forward": ["src"], "backward": ["dst"], "any": ["src", "dst"]}[way]
    where = " AND ".join(f"{e} IN (SELECT name FROM hit)" for e in ends)
    return run, f"{GRAPH}, hit AS (SELECT name FROM ents WHERE {HITS.format(p=PATTERN)}) SELECT src, dst, rel_type, coalesce(mtime, 0) AS mtime FROM rels WHERE {where}"


def _opened(way):
    def run(spark, d):
        found, edges = search.open_nodes(tables.entities(spark, d), tables.relations(spark, d), OPENED, way)
        one = found.select(F.lit("entity").alias("kind"), F.col("name").alias("a"), F.col("entity_type").alias("b"), F.array_join("observations", " | ").alias("c"))
        return one.unionByName(edges.select(F.lit("relation").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("rel_type").alias("c")))

    asked = ", ".join(f"('{n}')" for n in OPENED)
    where = "" if way == "any" else f" AND direction = '{way}'"
    sql = f"""{GRAPH}, {ADJACENCY}, asked(name) AS (VALUES {asked})
        SELECT 'entity' AS kind, e.name AS a, entity_type AS b, array_to_string(observations, ' | ') AS c FROM asked JOIN ents e ON e.name = asked.name
        UNION ALL SELECT 'relation', src, dst, rel_type FROM adj WHERE node IN (SELECT a.name FROM asked a JOIN ents e ON e.name = a.name){where}"""
    return run, sql


def _neighbours(start, depth, way):
    def run(spark, d):
        found = traverse.neighbours(tables.entities(spark, d), _links(spark, d) if depth else tables.relations(spark, d), start, depth, way)
        return found.select("name", F.col("depth").cast("int").alias("depth"))

    where = "" if way == "any" else f" AND direction = '{way}'"
    sql = f"""WITH RECURSIVE {ENTITIES}, {RELATIONS}, {ADJACENCY}, reach(name, depth) AS (
            SELECT '{start}', 0 UNION SELECT a.other, r.depth + 1 FROM reach r JOIN adj a ON a.node = r.name WHERE r.depth <= {depth}{where})
        SELECT name, CAST(min(depth) AS INTEGER) AS depth FROM reach WHERE name <> '{start}' GROUP BY name"""
    return run, sql


def _layer(spark, d):
    """The layer of orders and their customers, which leaves most entities apart; and the entities without customers, who then are missing ends."""
    return tables.relations(spark, d, {"placed_by"}), tables.entities(spark, d).filter("entity_type <> 'Customer'")


LAYER = f"""{GRAPH}, layer AS (SELECT * FROM rels WHERE rel_type = 'placed_by'), few AS (SELECT * FROM ents WHERE entity_type <> 'Customer')"""


def _violations(spark, d):
    """Entities that a careless import would make of conversations: three observations, texts uncut."""
    turns = tables.table(spark, d, "conversations")
    made = turns.select(F.concat_ws(":", F.lit("conv"), "conv_id", "turn").alias("name"), F.when(F.col("turn") % 2 == 0, F.array("role", "text", F.lit("x"))).otherwise(F.array("text")).alias("observations"))
    found = audit.violations(made)
    return found.select("name", F.col("count").cast("int").alias("count"), F.array_join(found["oversized"].cast("array<string>"), ",").alias("oversized"))


def _path(source, target, depth, way, budget=None):
    def run(spark, d):
        found = traverse.find_path(tables.entities(spark, d), _links(spark, d), source, target, depth, way, budget)
        rows = found.path.select("src", "dst", "rel_type", F.col("hop").cast("int").alias("hop"))
        return rows.withColumns({"reached": F.lit(found.reached), "exhausted": F.lit(found.exhausted), "farthest": F.lit(found.farthest).cast("string")})

    return run


def _depths(spark, d):
    start = spark.createDataFrame([("supplier:1",)], "name string")
    found = traverse.reachable(_links(spark, d), start, "any", 3)
    return found.groupBy("depth").agg(F.count("*").alias("nodes")).select(F.col("depth").cast("int").alias("depth"), "nodes")


DEPTHS = f"""WITH RECURSIVE {RELATIONS}, {ADJACENCY}, pairs AS (SELECT DISTINCT node, other FROM adj),
    d0 AS (SELECT 'supplier:1' AS name), d1 AS (SELECT DISTINCT other AS name FROM pairs JOIN d0 ON node = name WHERE other NOT IN (SELECT name FROM d0)),
    d2 AS (SELECT DISTINCT other AS name FROM pairs JOIN d1 ON node = name WHERE other NOT IN (SELECT name FROM d0 UNION SELECT name FROM d1)),
    d3 AS (SELECT DISTINCT other AS name FROM pairs JOIN d2 ON node = name WHERE other NOT IN (SELECT name FROM d0 UNION SELECT name FROM d1 UNION SELECT name FROM d2))
    SELECT CAST(depth AS INTEGER) AS depth, count(*) AS nodes FROM (SELECT 0 AS depth FROM d0 UNION ALL SELECT 1 FROM d1 UNION ALL SELECT 2 FROM d2 UNION ALL SELECT 3 FROM d3) GROUP BY depth"""
#: Up to three hops in discovery order by window functions; the path is read back from its end.
PATH = f"""WITH {ENTITIES}, {RELATIONS}, {ADJACENCY}, fwd AS (SELECT * FROM adj WHERE direction = 'forward'),
    l0 AS (SELECT 'order:1' AS name, 0 AS place),
    c1 AS (SELECT f.other AS name, p.place AS pp, f.seq, p.name AS parent, f.rel_type, f.src, f.dst FROM l0 p JOIN fwd f ON f.node = p.name WHERE f.other NOT IN (SELECT name FROM l0)),
    l1 AS (SELECT *, row_number() OVER (ORDER BY pp, seq, name) AS place FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pp, seq) AS k FROM c1) WHERE k = 1),
    c2 AS (SELECT f.other AS name, p.place AS pp, f.seq, p.name AS parent, f.rel_type, f.src, f.dst FROM l1 p JOIN fwd f ON f.node = p.name WHERE f.other NOT IN (SELECT name FROM l0 UNION ALL SELECT name FROM l1)),
    l2 AS (SELECT *, row_number() OVER (ORDER BY pp, seq, name) AS place FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pp, seq) AS k FROM c2) WHERE k = 1),
    c3 AS (SELECT f.other AS name, p.place AS pp, f.seq, p.name AS parent, f.rel_type, f.src, f.dst FROM l2 p JOIN fwd f ON f.node = p.name WHERE f.other NOT IN (SELECT name FROM l0 UNION ALL SELECT name FROM l1 UNION ALL SELECT name FROM l2)),
    l3 AS (SELECT *, row_number() OVER (ORDER BY pp, seq, name) AS place FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pp, seq) AS k FROM c3) WHERE k = 1),"""
REACHED = f"""{PATH} h3 AS (SELECT * FROM l3 WHERE name = (SELECT 'region:' || n_regionkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderkey = 1)),
    h2 AS (SELECT * FROM l2 WHERE name = (SELECT parent FROM h3)), h1 AS (SELECT * FROM l1 WHERE name = (SELECT parent FROM h2))
    SELECT src, dst, rel_type, CAST(hop AS INTEGER) AS hop, TRUE AS reached, FALSE AS exhausted, CAST(NULL AS VARCHAR) AS farthest
    FROM (SELECT src, dst, rel_type, 1 AS hop FROM h1 UNION ALL SELECT src, dst, rel_type, 2 FROM h2 UNION ALL SELECT src, dst, rel_type, 3 FROM h3)"""
SPENT = f"""{PATH} cost AS (SELECT *, sum(strlen(name) + strlen(rel_type) + 28) OVER (ORDER BY level, place) + strlen('order:1') + 28 AS spent
        FROM (SELECT 1 AS level, name, rel_type, place, src, dst, parent FROM l1 UNION ALL SELECT 2, name, rel_type, place, src, dst, parent FROM l2 UNION ALL SELECT 3, name, rel_type, place, src, dst, parent FROM l3)),
    last AS (SELECT * FROM cost WHERE spent >= 300 ORDER BY level, place LIMIT 1),
    up AS (SELECT * FROM last UNION ALL SELECT c.* FROM cost c, last WHERE c.level = last.level - 1 AND c.name = last.parent)
    SELECT src, dst, rel_type, CAST(level AS INTEGER) AS hop, FALSE AS reached, TRUE AS exhausted, (SELECT name FROM last) AS farthest FROM up"""


def _regional(spark, d):
    """The region at the end of the first order's chain of keys."""
    o, c, n = (tables.table(spark, d, t) for t in ("orders", "customer", "nation"))
    return o.filter("o_orderkey = 1").join(c, F.col("c_custkey") == F.col("o_custkey")).join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(F.concat(F.lit("region:"), "n_regionkey")).first()[0]


def _rank(spark, d):
    found = rank.structural_rank(tables.entities(spark, d), tables.relations(spark, d), steps=5)
    return found.select("name", F.round("visits", 6).alias("visits"), F.round("rank", 10).alias("rank"))


def _unrolled(steps, first, step):
    return ", ".join([f"v0 AS ({first})", *(f"v{i + 1} AS ({step.format(v=f'v{i}')})" for i in range(steps))])


RANK = f"""{GRAPH}, outs AS (SELECT src, count(*) AS c FROM rels GROUP BY src), steps AS (SELECT r.src, r.dst, 0.85::DOUBLE / o.c AS w FROM rels r JOIN outs o ON o.src = r.src),
    {_unrolled(5, "SELECT name, 1.0::DOUBLE AS v FROM ents", "SELECT e.name, 1.0::DOUBLE + coalesce(m.s, 0) AS v FROM ents e LEFT JOIN (SELECT s.dst, sum(s.w * p.v) AS s FROM steps s JOIN {v} p ON p.name = s.src GROUP BY s.dst) m ON m.dst = e.name")}
    SELECT name, round(v, 6) AS visits, round(v / (SELECT sum(v) FROM v5), 10) AS rank FROM v5"""


def _psi(spark, d):
    found = rank.entropy_psi(tables.entities(spark, d), tables.relations(spark, d), iterations=5, tolerance=0.0)
    return found.select("name", F.round("psi", 9).alias("psi"))


#: The step is linear, so one division at the end does for all five.
PSI = f"""{GRAPH}, size AS (SELECT count(*)::DOUBLE AS n FROM ents),
    {_unrolled(5, "SELECT name, 1.0::DOUBLE AS v FROM ents", "SELECT e.name, 0.85::DOUBLE * coalesce(m.s, 0) + 0.15::DOUBLE / (SELECT n FROM size) * (SELECT sum(v) FROM {v}) AS v FROM ents e LEFT JOIN (SELECT r.dst, sum(p.v) AS s FROM rels r JOIN {v} p ON p.name = r.src GROUP BY r.dst) m ON m.dst = e.name")}
    SELECT name, round(v / (SELECT sqrt(sum(v * v)) FROM v5), 9) AS psi FROM v5"""


def _transitions(spark, d):
    relations = tables.relations(spark, d)
    psi = tables.table(spark, d, "supplier").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("name"), F.greatest("s_acctbal", F.lit(0.0)).alias("psi"))
    found = walk.transitions(relations, psi, "forward", "merw")
    return found.select("node", "other", F.round("p", 9).alias("p"))


TRANSITIONS = f"""WITH {RELATIONS}, edges AS (SELECT DISTINCT src AS node, dst AS other FROM rels WHERE src <> dst),
    weights AS (SELECT e.*, coalesce(greatest(s_acctbal, 0), 0) AS w FROM edges e LEFT JOIN supplier ON 'supplier:' || s_suppkey = other),
    sums AS (SELECT node, sum(w) AS total, count(*) AS n FROM weights GROUP BY node)
    SELECT node, other, round(CASE WHEN total > 0 THEN w / total ELSE 1.0::DOUBLE / n END, 9) AS p FROM weights JOIN sums USING (node)"""


def _walks(spark, d):
    relations = tables.relations(spark, d)
    starts = tables.table(spark, d, "orders").select(F.concat(F.lit("order:"), "o_orderkey").alias("name"), (F.col("o_orderkey") * 7919 + walk.seed_number("seed")).alias("state"))
    found = walk.random_walks(starts, walk.transitions(relations, None, "forward", "uniform"), 3)
    return found.select("name", "entity", F.array_join("path", ">").alias("path"))


def _xorshift(s: str) -> str:
    """The generator's next state as a number of 64 bits without sign."""
    one = f"xor({s}, ({s} * 8192) % {1 << 64}::HUGEINT)"
    two = f"xor({one}, ({one}) // 128)"
    return f"xor({two}, (({two}) * 131072) % {1 << 64}::HUGEINT)"


def _step(k: int) -> str:
    """Walks after their k-th draw: the target at the drawn place of those that a node has."""
    return f"""s{k} AS (SELECT name, entity, path, {_xorshift("state")} AS state FROM w{k - 1}),
    r{k} AS (SELECT s.*, ((state // 2048)::DOUBLE / {float(1 << 53)}) AS r FROM s{k} s),
    j{k} AS (SELECT r.name, r.entity, r.path, r.state, t.other FROM r{k} r LEFT JOIN outs o ON o.node = r.entity LEFT JOIN targets t ON t.node = r.entity AND t.place = greatest(ceil(r.r * o.n), 1)),
    w{k} AS (SELECT name, other AS entity, path || '>' || other AS path, state FROM j{k} WHERE other IS NOT NULL)"""


WALKS = f"""WITH {RELATIONS}, targets AS (SELECT node, other, row_number() OVER (PARTITION BY node ORDER BY seq, other) AS place FROM (SELECT src AS node, dst AS other, min(seq) AS seq FROM rels WHERE src <> dst GROUP BY 1, 2)),
    outs AS (SELECT node, count(*) AS n FROM targets GROUP BY node),
    w0 AS (SELECT 'order:' || o_orderkey AS name, 'order:' || o_orderkey AS entity, 'order:' || o_orderkey AS path, ((o_orderkey * 7919 + {walk.seed_number("seed")})::HUGEINT + {1 << 64}::HUGEINT) % {1 << 64}::HUGEINT AS state FROM orders),
    {_step(1)}, {_step(2)}, {_step(3)}
    SELECT name, entity, path FROM j1 WHERE other IS NULL UNION ALL SELECT name, entity, path FROM j2 WHERE other IS NULL UNION ALL SELECT name, entity, path FROM j3 WHERE other IS NULL UNION ALL SELECT name, entity, path FROM w3"""


def _ranked(spark, d):
    entities = tables.entities(spark, d).filter("entity_type = 'Customer'")
    return order.ranked(entities, tables.graph(spark, d).ranks)


def _llmrank(spark, d):
    return _ranked(spark, d).orderBy(*order.sort_columns()).limit(50).select("name", F.round("walker_rank", 10).alias("walker_rank"))


def _numbered_rows(found, keys):
    """The first two hundred in order, with their places."""
    rows = found.orderBy(*keys).limit(200).select("name")
    return rows.withColumn("position", (F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) - 1).cast("int"))


def _sorted_neighbours(spark, d):
    found = traverse.neighbours(tables.entities(spark, d), tables.relations(spark, d), "nation:3", 0, "any")
    return _numbered_rows(order.ranked(found, tables.graph(spark, d).ranks), order.sort_columns())


def _newest(spark, d):
    found = tables.entities(spark, d).filter("entity_type = 'Order'")
    return found.orderBy(*order.sort_columns("mtime")).limit(100).select("name", "mtime")


def _page(cursor):
    def run(spark, d):
        items = tables.entities(spark, d).filter("entity_type = 'Customer'")
        found = order.page(items, order.sort_columns("name", collate=False), order.item_json("name", "entity_type", "observations"), cursor)
        return found.select(F.col("position").cast("int").alias("position"), "json")

    item = "'{\"name\":\"' || name || '\",\"entityType\":\"' || entity_type || '\",\"observations\":[\"' || observations[1] || '\",\"' || observations[2] || '\"]}'"
    sql = f"""WITH {ENTITIES}, items AS (SELECT CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS position, {item} AS json, count(*) OVER () AS total FROM ents WHERE entity_type = 'Customer'),
        sized AS (SELECT *, sum(length(json) + 1) OVER (ORDER BY position) - 1 + 44 + length(total::VARCHAR) AS size FROM items WHERE position >= {cursor})
        SELECT position, json FROM sized WHERE size <= 4096 OR position = {cursor}"""
    return run, sql


def _pages(spark, d):
    """Where the pages of each brand's parts begin."""
    part = tables.table(spark, d, "part")
    json = F.to_json(F.struct(F.concat(F.lit("part:"), "p_partkey").alias("name"), F.col("p_name").alias("note")))
    lists = part.groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("p_partkey", F.length(json).alias("n")))).alias("items"))
    starts = lists.select("p_brand", F.posexplode(order.page_starts(F.transform("items", lambda x: x["n"]), limit=PAGE_CHARS)).alias("page", "start"))
    return starts.select("p_brand", F.col("page").cast("int").alias("page"), F.col("start").cast("int").alias("start"))


PAGES = """WITH RECURSIVE items AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos, count(*) OVER (PARTITION BY p_brand) AS total,
        length('{"name":"part:' || p_partkey || '","note":"' || p_name || '"}') AS n FROM part),
    fold AS (SELECT p_brand, pos, total, 0 AS page, 0::BIGINT AS start, (44 + length(total::VARCHAR) + n)::BIGINT AS size FROM items WHERE pos = 0
        UNION ALL SELECT i.p_brand, i.pos, i.total, CASE WHEN f.size + 1 + i.n <= 4096 THEN f.page ELSE f.page + 1 END, CASE WHEN f.size + 1 + i.n <= 4096 THEN f.start ELSE i.pos END,
            CASE WHEN f.size + 1 + i.n <= 4096 THEN f.size + 1 + i.n ELSE 44 + length(i.total::VARCHAR) + i.n END FROM fold f JOIN items i ON i.p_brand = f.p_brand AND i.pos = f.pos + 1)
    SELECT DISTINCT p_brand, CAST(page AS INTEGER) AS page, CAST(start AS INTEGER) AS start FROM fold"""


def _state(spark, d):
    return tables.graph(spark, d)


def _upsert(spark, d):
    """Offer all customers to a graph that has those of one segment already."""
    entities = tables.entities(spark, d).filter("entity_type = 'Customer'")
    state = GraphState(entities.filter("observations[1] = 'BUILDING'"), tables.relations(spark, d).limit(0), rank.visit_ranks(entities, tables.access_log(spark, d)))
    _, new = mutate.create_entities(state, entities.select(F.col("seq").alias("place"), "name", "entity_type", "observations"), NOW)
    return _flat(new).select("name", "entity_type", "observations", "mtime")


def _conflicts(spark, d):
    """Offer all entities to the graph again, each with its first observation alone: those that had two are refused."""
    state = _state(spark, d)
    batch = state.entities.select(F.col("seq").alias("place"), "name", "entity_type", F.slice("observations", 1, 1).alias("observations"))
    return mutate.conflicts(state, batch)


def _relate(spark, d):
    """Offer every relation again, twice, and one from each supplier to the nation after its own."""
    state = _state(spark, d)
    again = state.relations.select(F.col("seq").alias("place"), "src", "dst", "rel_type")
    next_one = F.concat(F.lit("nation:"), F.col("s_nationkey") + 1)
    more = tables.table(spark, d, "supplier").select(F.lit(0).cast("bigint").alias("place"), F.concat(F.lit("supplier:"), "s_suppkey").alias("src"), next_one.alias("dst"), F.lit("in_nation").alias("rel_type"))
    after, new = mutate.create_relations(state, again.unionByName(again).unionByName(more).unionByName(more), NOW)
    return after, new


def _related(spark, d):
    return _relate(spark, d)[1].select("src", "dst", "rel_type", "mtime")


def _touched(spark, d):
    """The entities whose time of change the new relations move: their sources."""
    return _relate(spark, d)[0].entities.filter(F.col("mtime") == NOW).select("name", "mtime")


NEW_LINKS = f"""WITH {RELATIONS}, links AS (SELECT DISTINCT 'supplier:' || s_suppkey AS src, 'nation:' || (s_nationkey + 1) AS dst FROM supplier WHERE s_nationkey + 1 IN (SELECT n_nationkey FROM nation))"""


def _cascade(spark, d):
    state = GraphState(tables.entities(spark, d), tables.relations(spark, d), tables.graph(spark, d).ranks)
    gone = tables.table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("customer:"), "c_custkey").alias("name"))
    left = mutate.delete_entities(state, gone)
    return left.relations.groupBy("rel_type").agg(F.count("*").alias("relations"))


def _observe(spark, d):
    state = _state(spark, d)
    batch = state.entities.filter(F.size("observations") == 1).select("name", F.array(F.col("observations")[0], F.concat(F.lit("also "), F.col("observations")[0])).alias("contents"))
    after, _ = mutate.add_observations(state, batch, NOW)
    return _flat(after.entities).select("name", "observations", F.coalesce("obs_mtime", F.lit(0)).alias("obs_mtime"))


def _forget(spark, d):
    entities = tables.entities(spark, d).filter("entity_type = 'Customer'")
    state = GraphState(entities, tables.relations(spark, d).limit(0), tables.graph(spark, d).ranks)
    after = mutate.delete_observations(state, entities.select("name", F.array(F.lit("BUILDING"), F.lit("none such")).alias("removals")), NOW)
    return _flat(after.entities).select("name", "observations", F.coalesce("mtime", F.lit(0)).alias("mtime"))


def _unrelate(spark, d):
    state = _state(spark, d)
    after = mutate.delete_relations(state, state.relations.filter("rel_type IN ('in_nation', 'in_region')").select("src", "dst", "rel_type"))
    return after.relations.select("src", "dst", "rel_type")


def _visited(spark, d):
    """Two more visits of every customer of one segment."""
    ranks = tables.graph(spark, d).ranks
    more = tables.table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("customer:"), "c_custkey").alias("name"))
    more = more.unionByName(more)
    return rank.record_visits(ranks, more).filter("walker_visits > 0").select("name", "walker_visits")


def _imported(spark, d):
    """The import rules over lines made of conversations: repeated names, long texts, loose ends."""
    turns = tables.table(spark, d, "conversations").withColumn("place", F.col("conv_id") * 1000 + F.col("turn"))
    name = F.concat(F.lit("c"), F.floor(F.col("conv_id") / 2))
    none = F.lit(None).cast("string")
    base = {"bad": F.lit(False), "type": F.lit("entity"), "name": name, "entityType": F.col("role"), "observations": F.array("text", "role", "text"), "mtime": F.lit(None).cast("bigint"), "obsMtime": F.col("turn")}
    one = turns.select("place", *(v.alias(k) for k, v in base.items()), none.alias("from"), none.alias("to"), none.alias("relationType"))
    ends = {"from": name, "to": F.concat(F.lit("c"), F.col("conv_id")), "relationType": F.lit("near"), "type": F.lit("relation")}
    two = one.join(turns.select("place", "conv_id"), "place").withColumns(ends).withColumn("name", none).drop("conv_id")
    return jsonl.import_graph(one.unionByName(two.select(one.columns)))


def _lines(spark, d):
    """Lines made of conversations: what users say as entities, answers as relations, all else as it is, which is no line of a graph."""
    turns = tables.table(spark, d, "conversations").withColumn("place", F.col("conv_id") * 1000 + F.col("turn"))
    name = F.concat(F.lit("c"), "conv_id")
    one = F.to_json(F.struct(F.lit("entity").alias("type"), name.alias("name"), F.col("role").alias("entityType"), F.array("text", "role").alias("observations"), F.col("turn").alias("mtime")))
    two = F.to_json(F.struct(F.lit("relation").alias("type"), name.alias("from"), F.lit("x").alias("to"), F.col("role").alias("relationType")))
    lines = turns.select("place", F.when(F.col("role") == "user", one).when(F.col("role") == "assistant", two).otherwise(F.concat(F.lit("- "), F.coalesce("text", F.lit("")))).alias("value"))
    found = jsonl.parsed(lines)
    return found.select("place", "bad", *(F.coalesce(c, F.lit("")).alias(a) for c, a in (("name", "name"), ("entityType", "entity_type"), ("from", "src"), ("relationType", "rel_type"))), F.coalesce(F.array_join("observations", "|"), F.lit("")).alias("observations"))


LINES = """SELECT conv_id * 1000 + turn AS place, role NOT IN ('user', 'assistant') AS bad, CASE role WHEN 'user' THEN 'c' || conv_id ELSE '' END AS name, CASE role WHEN 'user' THEN role ELSE '' END AS entity_type,
    CASE role WHEN 'assistant' THEN 'c' || conv_id ELSE '' END AS src, CASE role WHEN 'assistant' THEN role ELSE '' END AS rel_type, CASE role WHEN 'user' THEN array_to_string([text, role], '|') ELSE '' END AS observations FROM conversations"""


def _imported_entities(spark, d):
    return _flat(_imported(spark, d)[0]).select("name", "entity_type", "observations", "mtime", "obs_mtime")


def _imported_relations(spark, d):
    return _imported(spark, d)[1].groupBy("src", "dst", "rel_type").agg(F.count("*").alias("n"))


def _differences(spark, d):
    old = tables.entities(spark, d).filter("entity_type = 'Customer'")
    new = old.filter("observations[1] <> 'BUILDING'").withColumn("observations", F.when(F.col("observations")[1] == "MACHINERY", F.array(F.lit("changed"))).otherwise(F.col("observations")))
    new = new.unionByName(tables.entities(spark, d).filter("entity_type = 'Region'"))
    keep = ["name", "entity_type", "observations", "mtime"]
    return jsonl.differences(old.select(keep), new.select(keep), ["name"])


def _decoded(spark, d):
    at = timestamps.millis("ts") - F.col("event_id") * 3_600_000
    found = tables.table(spark, d, "events").select("event_id", timestamps.decoded(at, F.lit(NOW - 26_000_000_000).cast("bigint")).alias("t"))
    return found.select("event_id", "t.timestamp", "t.iso8601", "t.formatted", "t.relative")


DECODED = f"""WITH t AS (SELECT event_id, epoch_us(ts) // 1000 - event_id * 3600000 AS ms, {NOW - 26_000_000_000} AS now FROM events), a AS (SELECT *, abs(now - ms) AS age, make_timestamp(ms * 1000) AS moment FROM t)
    SELECT event_id, ms AS timestamp, strftime(moment, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso8601, strftime(moment, '%a, %d %b %Y %H:%M:%S') || ' GMT' AS formatted,
    CASE WHEN now >= ms THEN '' ELSE 'in ' END || CASE WHEN age < 60000 THEN (age // 1000) || ' seconds' WHEN age < 3600000 THEN (age // 60000) || ' minutes' WHEN age < 86400000 THEN (age // 3600000) || ' hours'
        WHEN age < 2592000000 THEN (age // 86400000) || ' days' WHEN age < 31536000000 THEN (age // 2592000000) || ' months' ELSE (age // 31536000000) || ' years' END || CASE WHEN now >= ms THEN ' ago' ELSE '' END AS relative FROM a"""


def _samples(spark, d):
    return tables.table(spark, d, "events").select(F.col("event_type").alias("op"), F.col("event_id").alias("seq"), F.col("value") )


def _distributions(spark, d):
    found = measure.distributions(_samples(spark, d))
    return found.select("op", "n", *(F.round(c, 6).alias(c) for c in ("least", "p50", "p90", "p99", "mean", "cv", "re")))


PLACES = ", ".join(f"round(list_sort(list(value))[least(CAST(floor(count(value) * {p}) AS BIGINT), count(value) - 1) + 1], 6) AS {n}" for p, n in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99")))
DISTRIBUTIONS = f"""SELECT event_type AS op, count(value) AS n, round(min(value), 6) AS least, {PLACES}, round(avg(value), 6) AS mean,
    round(stddev_samp(value) / avg(value), 6) AS cv, round(stddev_samp(value) / avg(value) / sqrt(count(value)), 6) AS re FROM events GROUP BY 1"""


def _drift(spark, d):
    found = measure.drift(_samples(spark, d))
    return found.select("op", "seq", F.round("rolling", 6).alias("rolling"), "drifted")


DRIFT = """WITH r AS (SELECT event_type AS op, event_id AS seq, value, median(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS rolling FROM events)
    SELECT op, seq, round(rolling, 6) AS rolling, coalesce(value - rolling > rolling * 0.1::DOUBLE AND value - rolling > 40.0, FALSE) AS drifted FROM r"""


def _compared(spark, d):
    runs = _samples(spark, d)
    found = measure.compared(runs.filter("seq % 2 = 0"), runs.filter("seq % 2 = 1"), "click")
    return found.select("op", *(F.round(c, 6).alias(c) for c in ("base", "head", "delta")), "regressed")


COMPARED = """WITH b AS (SELECT event_type AS op, median(value) AS base FROM events WHERE event_id % 2 = 0 GROUP BY 1), h AS (SELECT event_type AS op, median(value) AS raw FROM events WHERE event_id % 2 = 1 GROUP BY 1),
    s AS (SELECT coalesce((SELECT base / raw FROM b JOIN h USING (op) WHERE op = 'click'), 1.0::DOUBLE) AS k), x AS (SELECT op, base, raw * (SELECT k FROM s) AS head FROM b LEFT JOIN h USING (op))
    SELECT op, round(base, 6) AS base, round(head, 6) AS head, round(head - base, 6) AS delta, head - base > greatest(40.0::DOUBLE, base * 0.05::DOUBLE) AS regressed FROM x"""


def _calls(spark, d):
    """Events as tool calls: some late, some wrong."""
    events = tables.table(spark, d, "events")
    calls = events.select(F.col("event_type").alias("tool"), F.col("value").alias("ms"), (F.col("event_id") % 5 != 0).alias("ok"), (F.col("event_id") % 7 == 0).alias("is_error"), (F.col("event_id") % 11 == 0).alias("timed_out"))
    found = measure.call_summary(calls)
    return found.select("tool", "n", "protocol_errors", "tool_errors", "timeouts", F.round("max_ms", 6).alias("max_ms"), F.round("avg_ms", 6).alias("avg_ms"))


CALLS = """SELECT event_type AS tool, count(*) AS n, CAST(sum((event_id % 11 <> 0 AND event_id % 5 = 0)::INT) AS BIGINT) AS protocol_errors, CAST(sum((event_id % 11 <> 0 AND event_id % 5 <> 0 AND event_id % 7 = 0)::INT) AS BIGINT) AS tool_errors,
    CAST(sum((event_id % 11 = 0)::INT) AS BIGINT) AS timeouts, round(max(value), 6) AS max_ms, round(avg(value), 6) AS avg_ms FROM events GROUP BY 1"""


def _buckets(spark, d):
    found = measure.duration_histogram(_samples(spark, d).withColumn("value", F.col("value") / 50))
    return found.select("op", F.coalesce("upto", F.lit(-1.0)).alias("upto"), "n", F.round("total", 5).alias("total"))


BUCKETS = f"""SELECT event_type AS op, CAST(CASE {' '.join(f'WHEN value / 50 <= {b} THEN {b}' for b in measure.BOUNDS)} ELSE -1 END AS DOUBLE) AS upto, count(*) AS n, round(sum(value / 50), 5) AS total FROM events GROUP BY 1, 2"""


def _hourly(spark, d):
    events = tables.table(spark, d, "events").select(F.col("ts"), F.concat(F.lit("customer:"), "user_id").alias("name"))
    found = windowed_visits(events)
    return found.select(timestamps.millis("start").alias("start_ms"), "name", "visits")


def _cosine(spark, d):
    """Embeddings by cosine to the mean of their label, in dense vectors."""
    rows = tables.table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    size = rows.agg(F.max(F.size("x"))).first()[0] or 0
    means = rows.groupBy("label").agg(F.array(*(F.avg(F.get("x", F.lit(k))) for k in range(size))).alias("m"))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    both = rows.join(means, "label").select(
        "vec_id",
        total(F.zip_with("x", "m", lambda x, m: x * m)).alias("dot"),
        F.sqrt(total(F.transform("x", lambda x: x * x))).alias("a"),
        F.sqrt(total(F.transform("m", lambda m: m * m))).alias("b"),
    )
    return both.select("vec_id", F.round(F.when(F.col("a") * F.col("b") > 0, F.col("dot") / (F.col("a") * F.col("b"))).otherwise(0.0), 6).alias("cosine"))


COSINE = """WITH r AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings), m AS (SELECT label, k, avg(x) AS m FROM r GROUP BY label, k),
    s AS (SELECT vec_id, sum(x * m) AS dot, sqrt(sum(x * x)) AS a, sqrt(sum(m * m)) AS b FROM r JOIN m USING (label, k) GROUP BY vec_id)
    SELECT vec_id, round(CASE WHEN a * b > 0 THEN dot / (a * b) ELSE 0 END, 6) AS cosine FROM s"""


def _stats(spark, d):
    found = summary.stats(tables.entities(spark, d), tables.relations(spark, d))
    return found.select(*(F.col(c).cast("bigint").alias(c) for c in found.columns))


def _thoughts(spark, d):
    return mutate.thought_chains(tables.table(spark, d, "conversations").select("conv_id", "turn").distinct())


THOUGHTS = """WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations), p AS (SELECT 'conv:' || conv_id || ':' || turn AS src, lead('conv:' || conv_id || ':' || turn) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM t)
    SELECT src, dst, 'follows' AS rel_type FROM p WHERE dst IS NOT NULL UNION ALL SELECT dst, src, 'preceded_by' FROM p WHERE dst IS NOT NULL"""

FLAT = "array_to_string(observations, ' | ') AS observations"
IMPORTED = """WITH t AS (SELECT conv_id * 1000 + turn AS place, 'c' || (conv_id // 2) AS name, * FROM conversations),
    f AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY place) AS rn FROM t)"""


def _all() -> dict:
    found = {
        "search_regex": (_search(PATTERN), _search_sql(PATTERN)),
        "search_posix_class": (_search(POSIX), _search_sql(POSIX)),
        "entities_by_type": (lambda s, d: _flat(search.by_type(tables.entities(s, d), "Supplier")).select("name", "observations"), f"WITH {ENTITIES} SELECT name, {FLAT} FROM ents WHERE entity_type = 'Supplier'"),
        "lookup": (lambda s, d: search.lookup(tables.entities(s, d), "order:7").select("name", "mtime"), f"WITH {ENTITIES} SELECT name, mtime FROM ents WHERE name = 'order:7'"),
        "entity_types": (lambda s, d: summary.entity_types(tables.entities(s, d)), f"WITH {ENTITIES} SELECT DISTINCT entity_type FROM ents"),
        "relation_types": (lambda s, d: summary.relation_types(tables.relations(s, d)), f"WITH {RELATIONS} SELECT DISTINCT rel_type FROM rels"),
        "graph_stats": (_stats, f"{GRAPH} SELECT (SELECT count(*) FROM ents) AS entity_count, (SELECT count(*) FROM rels) AS relation_count, (SELECT count(DISTINCT entity_type) FROM ents) AS entity_types, (SELECT count(DISTINCT rel_type) FROM rels) AS relation_types"),
        "degree": (lambda s, d: summary.degrees(tables.relations(s, d)), f"WITH {RELATIONS}, {ADJACENCY} SELECT node AS name, count(*) AS degree FROM adj GROUP BY node"),
        "adjacency_view": (lambda s, d: adjacency(tables.relations(s, d)).select("node", "other", "direction", "rel_type"), f"WITH {RELATIONS}, {ADJACENCY} SELECT node, other, direction, rel_type FROM adj"),
        "string_refcounts": (lambda s, d: summary.string_counts(tables.entities(s, d), tables.relations(s, d)), f"{GRAPH} SELECT text, CAST(sum(n) AS BIGINT) AS refs FROM (SELECT unnest(list_concat([name, entity_type], observations)) AS text, 1 AS n FROM ents UNION ALL SELECT rel_type, 2 FROM rels) GROUP BY text"),
        "orphans": (lambda s, d: audit.orphans(tables.entities(s, d), _layer(s, d)[0]).select("name"), f"{LAYER} SELECT name FROM ents WHERE name NOT IN (SELECT src FROM layer UNION SELECT dst FROM layer)"),
        "orphans_strict": (
            lambda s, d: audit.strict_orphans(tables.entities(s, d), written(_layer(s, d)[0]), root="order:1").select("name"),
            LAYER.replace("WITH", "WITH RECURSIVE", 1) + ", sides AS (SELECT src AS a, dst AS b FROM layer UNION SELECT dst, src FROM layer), reach(name) AS (SELECT name FROM ents WHERE name = 'order:1' UNION SELECT b FROM reach JOIN sides ON a = name) SELECT name FROM ents WHERE name NOT IN (SELECT name FROM reach)",
        ),
        "missing_endpoints": (lambda s, d: audit.missing_endpoints(_layer(s, d)[1], tables.relations(s, d)), f"{LAYER} SELECT DISTINCT name FROM (SELECT src AS name FROM rels UNION SELECT dst FROM rels) WHERE name NOT IN (SELECT name FROM few)"),
        "observation_violations": (
            _violations,
            "WITH t AS (SELECT 'conv:' || conv_id || ':' || turn AS name, CASE WHEN turn % 2 = 0 THEN [role, text, 'x'] ELSE [text] END AS o FROM conversations), "
            "v AS (SELECT name, len(o) AS count, list_filter(range(len(o)), lambda i: length(o[i + 1]) > 140) AS big FROM t) "
            "SELECT name, CAST(count AS INTEGER) AS count, array_to_string(big, ',') AS oversized FROM v WHERE count > 2 OR len(big) > 0",
        ),
        "shortest_path_depths": (_depths, DEPTHS),
        "find_path_hops": (lambda s, d: _path("order:1", _regional(s, d), 5, "forward")(s, d), REACHED),
        "find_path_budget": (lambda s, d: _path("order:1", _far(s, d), 3, "forward", 300)(s, d), SPENT),
        "pagerank_k": (_rank, RANK),
        "merw_psi_k": (_psi, PSI),
        "walk_transition_probs": (_transitions, TRANSITIONS),
        "seeded_walk": (_walks, WALKS),
        "llmrank": (
            lambda s, d: rank.walker_ranks(tables.graph(s, d).ranks).filter("walker_rank > 0").select("name", F.round("walker_rank", 10).alias("walker_rank")),
            f"WITH {ENTITIES}, {VISITS} SELECT name, round(walker_visits::DOUBLE / (SELECT sum(walker_visits) FROM walk), 10) AS walker_rank FROM walk WHERE walker_visits > 0",
        ),
        "top_by_llmrank": (
            _llmrank,
            f"WITH {ENTITIES}, {VISITS} SELECT w.name, round(walker_visits::DOUBLE / (SELECT sum(walker_visits) FROM walk), 10) AS walker_rank FROM walk w JOIN ents e ON e.name = w.name WHERE entity_type = 'Customer' ORDER BY walker_visits DESC, w.name LIMIT 50",
        ),
        "sort_by_name_collated": (
            lambda s, d: _numbered_rows(tables.entities(s, d).filter("entity_type = 'Customer'"), order.sort_columns("name", "desc")),
            f"WITH {ENTITIES} SELECT name, CAST(row_number() OVER (ORDER BY name DESC) - 1 AS INTEGER) AS position FROM ents WHERE entity_type = 'Customer' QUALIFY position < 200",
        ),
        "sort_neighbors": (
            _sorted_neighbours,
            f"WITH {ENTITIES}, {RELATIONS}, {ADJACENCY}, {VISITS} SELECT w.name, CAST(row_number() OVER (ORDER BY walker_visits DESC, w.name) - 1 AS INTEGER) AS position FROM walk w WHERE w.name IN (SELECT other FROM adj WHERE node = 'nation:3' AND other <> 'nation:3') QUALIFY position < 200",
        ),
        "sort_by_mtime_topk": (_newest, f"WITH {ENTITIES} SELECT name, mtime FROM ents WHERE entity_type = 'Order' ORDER BY mtime DESC, name LIMIT 100"),
        "paginate_first_page": _page(0),
        "paginate_next_page": _page(30),
        "page_boundaries": (_pages, PAGES),
        "upsert_new": (_upsert, f"WITH {ENTITIES} SELECT name, entity_type, {FLAT}, {NOW}::BIGINT AS mtime FROM ents WHERE entity_type = 'Customer' AND observations[2] <> 'BUILDING'"),
        "upsert_conflicts": (_conflicts, f"WITH {ENTITIES} SELECT name FROM ents WHERE len(observations) > 1"),
        "relation_dedupe": (_related, f"{NEW_LINKS} SELECT src, dst, 'in_nation' AS rel_type, {NOW}::BIGINT AS mtime FROM links"),
        "relation_touches": (_touched, f"{NEW_LINKS} SELECT DISTINCT src AS name, {NOW}::BIGINT AS mtime FROM links"),
        "cascade_delete": (
            _cascade,
            f"WITH {RELATIONS}, gone AS (SELECT 'customer:' || c_custkey AS name FROM customer WHERE c_mktsegment = 'BUILDING') SELECT rel_type, count(*) AS relations FROM rels WHERE src NOT IN (SELECT name FROM gone) AND dst NOT IN (SELECT name FROM gone) GROUP BY rel_type",
        ),
        "add_observations": (_observe, f"WITH {ENTITIES} SELECT name, CASE WHEN len(observations) = 1 THEN observations[1] || ' | also ' || observations[1] ELSE array_to_string(observations, ' | ') END AS observations, CASE WHEN len(observations) = 1 THEN {NOW}::BIGINT ELSE coalesce(mtime, 0) END AS obs_mtime FROM ents"),
        "remove_observations": (
            _forget,
            f"WITH {ENTITIES} SELECT name, CASE WHEN observations[2] = 'BUILDING' THEN observations[1] ELSE array_to_string(observations, ' | ') END AS observations, CASE WHEN observations[2] = 'BUILDING' THEN {NOW}::BIGINT ELSE 0 END AS mtime FROM ents WHERE entity_type = 'Customer'",
        ),
        "delete_relations": (_unrelate, f"WITH {RELATIONS} SELECT src, dst, rel_type FROM rels WHERE rel_type NOT IN ('in_nation', 'in_region')"),
        "record_visits": (_visited, f"WITH {ENTITIES}, {VISITS}, m AS (SELECT name, walker_visits + CASE WHEN name IN (SELECT 'customer:' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN 2 ELSE 0 END AS walker_visits FROM walk) SELECT name, walker_visits FROM m WHERE walker_visits > 0"),
        "thought_chain": (_thoughts, THOUGHTS),
        "jsonl_lines": (_lines, LINES),
        "jsonl_import_entities": (
            _imported_entities,
            IMPORTED + " SELECT name, role AS entity_type, left(text, 140) || ' | ' || role AS observations, 0::BIGINT AS mtime, turn AS obs_mtime FROM f WHERE rn = 1",
        ),
        "jsonl_import_relations": (_imported_relations, IMPORTED + " SELECT name AS src, 'c' || conv_id AS dst, 'near' AS rel_type, count(*) AS n FROM t WHERE 'c' || conv_id IN (SELECT name FROM t) GROUP BY 1, 2"),
        "store_diff": (
            _differences,
            f"WITH {ENTITIES} SELECT name, CASE WHEN entity_type = 'Region' THEN 'added' WHEN observations[2] = 'BUILDING' THEN 'missing' ELSE 'observations' END AS problem FROM ents WHERE entity_type = 'Region' OR (entity_type = 'Customer' AND observations[2] IN ('BUILDING', 'MACHINERY'))",
        ),
        "decode_timestamp": (_decoded, DECODED),
        "bench_percentiles": (_distributions, DISTRIBUTIONS),
        "rolling_median_creep": (_drift, DRIFT),
        "call_summary": (_calls, CALLS),
        "duration_histogram": (_buckets, BUCKETS),
        "pagerank_sampled": (lambda s, d: rank.sampled_visits(tables.entities(s, d), tables.relations(s, d), seed=7), None),
        "bench_compare": (_compared, COMPARED),
        "visits_tumbling": (_hourly, "SELECT epoch_ms(date_trunc('hour', ts)) AS start_ms, 'customer:' || user_id AS name, count(*) AS visits FROM events GROUP BY 1, 2"),
        "embedding_cosine": (_cosine, COSINE),
    }
    for way in ("forward", "backward", "any"):
        found[f"search_relations_{way}"] = _among(way)
        found[f"open_nodes_{way}"] = _opened(way)
    for depth, way, start in ((0, "forward", "order:1"), (1, "forward", "order:1"), (2, "forward", "order:1"), (0, "backward", "nation:3"), (1, "backward", "supplier:1"), (0, "any", "customer:1"), (1, "any", "part:1")):
        found[f"neighbors_d{depth}_{way}"] = _neighbours(start, depth, way)
    return found


def _far(spark, d):
    """An entity that no forward path leads to."""
    return "order:2"


def queries() -> dict:
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict:
    return {k: s for k, (_, s) in _all().items() if s}
