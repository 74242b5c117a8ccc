import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.operators import measure, text, trigram
from weftgraph.sources import jsonl
from weftgraph.streaming import visits


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab 😀é", max_size=60), st.integers(4, 12))
def test_wrap(raw, width):
    t = " ".join(raw.split())
    pieces = text.wrap(t, width)
    units = lambda s: len(s.encode("utf-16-le")) // 2
    assert all(units(p) <= width and p and t[at : at + len(p)] == p for p, at in pieces)
    assert "".join(p for p, _ in pieces).replace(" ", "") == t.replace(" ", "")
    for (p, at), (_, after) in zip(pieces, pieces[1:], strict=False):
        cut = t[at + len(p) : after]
        assert cut == " " or (cut == "" and units(p) >= width - 1 and " " not in p)


def test_wrap_words():
    assert [p for p, _ in text.wrap("a" * 200 + " tail")] == ["a" * 140, "a" * 60 + " tail"]
    assert text.wrap("") == [] and len(text.wrap("x" * 140)) == 1
    assert [len(p) for p, _ in text.wrap("x" * 139 + " " + "y" * 10)] == [139, 10]


@pytest.fixture(scope="module")
def loaded(spark):
    docs = spark.createDataFrame(
        [
            (1, "one", "Graphs hold nodes. Edges join the nodes  of graphs! Walks follow edges between nodes.\nShort. Ranks count walks over the edges?"),
            (2, "two", " ".join(f"Sentence number {i} has words of its own." for i in range(20))),
            (3, "empty", ""),
            (4, "null", None),
        ],
        "doc_id long, title string, text string",
    )
    return docs


def test_sentences(loaded):
    rows = [(r.doc_id, r.sentence, r.start, r.text) for r in text.sentences(loaded).filter("doc_id = 1").orderBy("sentence").collect()]
    assert [r[3] for r in rows] == ["Graphs hold nodes.", "Edges join the nodes of graphs!", "Walks follow edges between nodes.", "Ranks count walks over the edges?"]
    whole = "Graphs hold nodes. Edges join the nodes of graphs! Walks follow edges between nodes. Short. Ranks count walks over the edges?"
    assert all(whole[at : at + len(s)] == s for _, _, at, s in rows)


def brute(sentences, weight, steps):
    n = len(sentences)
    sets = [set(s.lower().split()) for s in sentences]
    m = np.zeros((n, n))
    for i in range(n):
        for j in range(n):
            if i != j:
                norm = math.sqrt(sum(weight[w] ** 2 for w in sets[i])) * math.sqrt(sum(weight[w] ** 2 for w in sets[j]))
                m[i, j] = sum(weight[w] ** 2 for w in sets[i] & sets[j]) / norm if norm else 0
    s = np.ones(n) / n
    for _ in range(steps):
        new = np.full(n, 0.15 / n)
        for j in range(n):
            if m[j].sum() > 0:
                new += 0.85 * m[j] / m[j].sum() * s[j]
        s = new
    return m, s


def test_ranks_against_matrix(spark, loaded):
    corpus = spark.createDataFrame([("graphs and nodes",), ("edges edges",), ("nothing here",), ("walks over graphs",), ("x",)], "text string")
    found = text.sentences(loaded)
    weights = text.term_weights(loaded, text.document_frequencies(corpus), corpus.count())
    cosines = text.sentence_cosines(found, weights)
    ranks = {(r.doc_id, r.sentence): r.score for r in text.sentence_ranks(found, cosines, 12).collect()}
    assert {(r.doc_id, r.sentence): round(r.score, 12) for r in text.ranks_by_words(found, weights, 12).collect()} == {k: round(v, 12) for k, v in ranks.items()}
    for doc in (1, 2):
        sent = [r.text for r in found.filter(f"doc_id = {doc}").orderBy("sentence").collect()]
        weight = {r.word: r.weight for r in weights.filter(f"doc_id = {doc}").collect()}
        m, s = brute(sent, weight, 12)
        got = {(r.i, r.j): r.cosine for r in cosines.filter(f"doc_id = {doc}").collect()}
        assert all(abs(m[i, j] - c) < 1e-9 for (i, j), c in got.items())
        assert all(abs(ranks[doc, i] - s[i]) < 1e-9 for i in range(len(s)))
    idf = {r.word: r.idf for r in weights.filter("doc_id = 1").collect()}
    assert abs(idf["graphs"] - (math.log(5 / 3) + 1)) < 1e-12 and abs(idf["short."] - (math.log(5) + 1)) < 1e-12


def test_ranks_converge(spark, loaded, tmp_path):
    """By default a document's rounds go on to the tolerance, and the queries over documents take all highlights."""
    corpus = spark.createDataFrame([("graphs and nodes",), ("edges edges",), ("nothing here",), ("walks over graphs",), ("x",)], "text string")
    found = text.sentences(loaded)
    weights = text.term_weights(loaded, text.document_frequencies(corpus), corpus.count())
    ranks = {(r.doc_id, r.sentence): r.score for r in text.sentence_ranks(found, text.sentence_cosines(found, weights)).collect()}
    assert len(ranks) == found.count()
    by_words = {(r.doc_id, r.sentence): r.score for r in text.ranks_by_words(found, weights).collect()}
    assert by_words.keys() == ranks.keys() and all(abs(by_words[k] - v) < 1e-12 for k, v in ranks.items())
    none = {(r.doc_id, r.sentence): r.score for r in text.ranks_by_words(found, weights.limit(0), 3).collect()}
    assert none == {(r.doc_id, r.sentence): r.score for r in text.sentence_ranks(found, text.sentence_cosines(found, weights).limit(0), 3).collect()}
    for doc in (1, 2):
        sent = [r.text for r in found.filter(f"doc_id = {doc}").orderBy("sentence").collect()]
        weight = {r.word: r.weight for r in weights.filter(f"doc_id = {doc}").collect()}
        before, steps = np.ones(len(sent)) / len(sent), 1
        while np.abs((s := brute(sent, weight, steps)[1]) - before).sum() >= 1e-6:
            before, steps = s, steps + 1
        assert all(abs(ranks[doc, i] - s[i]) < 1e-12 for i in range(len(s)))
    pairs = spark.createDataFrame([(1, 0, k, 1.0) for k in range(1, 5)], "doc_id long, i int, j int, cosine double")  # a star swings, and converges slowly
    star = spark.createDataFrame([(1, k) for k in range(5)], "doc_id long, sentence int")
    score = {r.sentence: r.score for r in text.sentence_ranks(star, pairs, tolerance=1e-2).collect()}
    assert abs(score[0] - (0.03 + 0.85 * 4 * 0.03) / (1 - 0.85**2)) < 1e-2
    long = spark.createDataFrame([(2, " ".join(f"Sentence number {i} has {'many more words ' * 7}of its own." for i in range(30)))], "doc_id long, text string")
    long.write.parquet(str(tmp_path / "documents.parquet"))
    from weftgraph.plans import text_queries

    marks = text_queries.WHOLE["document_index_entries"](spark, str(tmp_path)).filter("doc_id = 2").count()
    chunks = text.chunks(text.observations(long)).count()
    assert 3 < marks == text_queries.WHOLE["document_load_stats"](spark, str(tmp_path)).filter("doc_id = 2").first().highlights <= chunks


def test_load_counts(spark, loaded):
    for corpus in ([], ["graphs and nodes", "edges"]):
        strings = spark.createDataFrame([(c,) for c in corpus], "text string")
        entities, relations, stats = text.load_documents(loaded, strings, top=3, steps=5)
        rows = {r.doc_id: r for r in stats.collect()}
        assert entities.count() == sum(2 + r.chunks + r.highlights for r in rows.values())
        assert relations.count() == sum(2 * (r.chunks >= 1) + 2 * (r.chunks >= 2) + 2 * max(r.chunks - 1, 0) + 2 + 4 * r.highlights for r in rows.values())
        assert rows[3].chunks == rows[4].chunks == 0 and rows[2].sentences == 20 and rows[2].highlights >= 1
        assert all(len(o) <= 140 for r in entities.collect() for o in r.observations)
        assert entities.select("name").distinct().count() == entities.count()


def test_word_pairs(spark):
    docs = spark.createDataFrame([(1, "a b c d e f a")], "doc_id long, text string")
    got = {(r.a, r.b): r.n for r in text.word_pairs(docs).collect()}
    words, want = "a b c d e f a".split(), {}
    for i, x in enumerate(words):
        for y in words[i + 1 : i + 5]:
            if x != y:
                want[min(x, y), max(x, y)] = want.get((min(x, y), max(x, y)), 0) + 1
    assert got == want


def test_trigrams(spark):
    strings = spark.createDataFrame([(1, "memory artefact"), (2, "Memory"), (3, "ab"), (4, "αβγδ"), (5, "xαβγx"), (6, None), (7, "")], "id long, text string")
    index = trigram.rebuild(strings)
    found = lambda p: sorted(r.id for r in trigram.candidates(strings, index, p).collect())
    # the index is in lower case, so candidates are those of any case; the match itself tells case apart
    assert found("memory") == found("MEMORY") == [1, 2] and found("αβγ") == [4, 5] and found("emory") == [1, 2] and found(".") == [1, 2, 3, 4, 5, 6, 7]
    assert sorted(r.id for r in trigram.search_text(strings, "m.m|αβ", index).collect()) == [1, 4, 5]
    less = trigram.remove(index, strings.filter("id = 1"))
    assert [r.id for r in trigram.candidates(strings, less, "memory").collect()] == [2]
    assert sorted(r.id for r in trigram.search_text(strings, r"\bmem\w+|ΑΒ", index, "script", any_case=True).collect()) == [1, 2, 4, 5]
    more = trigram.add(less, spark.createDataFrame([(9, "memory"), (2, "other")], "id long, text string"))
    assert [r.id for r in trigram.candidates(strings, more, "memory").collect()] == [9] and trigram.candidates(strings, more, "Memoir").count() == 0
    assert trigram.index_size(index).first()["ids"] == 4


def test_import(spark, tmp_path):
    lines = [
        '{"type":"entity","name":"a","entityType":"T","observations":["1","2","3"],"mtime":5}',
        '{"type":"entity","name":"a","entityType":"U","observations":[]}',
        "not json", '{"type":"other"}', '{"type":"entity","name":"b","entityType":"T","observations":["' + "x" * 200 + '"]}', "",
        '{"type":"relation","from":"a","to":"b","relationType":"r"}', '{"type":"relation","from":"a","to":"b","relationType":"r"}', '{"type":"relation","from":"a","to":"gone","relationType":"r"}',
    ]
    (tmp_path / "g.jsonl").write_text("\n".join(lines))
    parsed = jsonl.read_lines(spark, str(tmp_path / "g.jsonl"))
    assert parsed.filter("bad").count() == 2
    entities, relations = jsonl.import_graph(parsed)
    rows = {r.name: r for r in entities.collect()}
    assert rows["a"].entity_type == "T" and rows["a"].observations == ["1", "2"] and rows["a"].mtime == 5 and rows["a"].obs_mtime == 0
    assert len(rows["b"].observations[0]) == 140 and relations.count() == 2
    assert jsonl.differences(entities, entities, ["name"]).count() == 0
    assert {(r.name, r.problem) for r in jsonl.differences(entities, entities.filter("name = 'a'").selectExpr("seq", "name", "'V' AS entity_type", "observations", "mtime", "obs_mtime"), ["name"]).collect()} == {("a", "entity_type"), ("b", "missing")}


def test_measures(spark):
    rows = [("x", i, float(v)) for i, v in enumerate([10, 20, 30, 40, 1000])] + [("one", 0, 5.0)]
    df = spark.createDataFrame(rows, "op string, seq int, value double")
    got = {r.op: r for r in measure.distributions(df).collect()}
    assert (got["x"].p50, got["x"].p90, got["x"].p99, got["x"].least) == (30, 1000, 1000, 10) and got["one"].cv == 0
    assert [r.drifted for r in measure.drift(df.filter("op = 'x'")).orderBy("seq").collect()] == [False, False, False, False, True]
    base = spark.createDataFrame([("reference", 100.0), ("slow", 100.0), ("same", 100.0)], "op string, value double")
    head = spark.createDataFrame([("reference", 200.0), ("slow", 400.0), ("same", 220.0)], "op string, value double")
    assert {r.op: r.regressed for r in measure.compared(base, head).collect()} == {"reference": False, "slow": True, "same": False}


def test_stream_equals_batch(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("name"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = visits.access_stream(spark, str(tmp_path / "in"), "ts timestamp, name string")
    query = visits.windowed_visits(stream, late="400 days").writeStream.format("memory").queryName("seen").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("seen").exceptAll(visits.windowed_visits(events)).count() == 0 and spark.table("seen").count() == visits.windowed_visits(events).count()


def test_sentences_in_chunks(spark):
    """The chunk a sentence starts in, against all pairs: in gaps, at borders, before the first."""
    parts = [(1, 0, "a", 3, 10), (1, 1, "b", 10, 14), (1, 2, "c", 20, 30), (2, 0, "d", 0, 5)]
    found = [(1, k, at) for k, at in enumerate([0, 3, 9, 10, 13, 14, 19, 20, 29, 30, 44])] + [(2, 0, 4), (2, 1, 5), (3, 0, 0)]
    got = text.sentence_chunks(spark.createDataFrame(found, "doc_id long, sentence int, start int"), spark.createDataFrame(parts, "doc_id long, chunk int, chunk_id string, start int, end int"))
    assert {tuple(r) for r in got.collect()} == {(d, k, c, i) for d, k, at in found for e, c, i, a, b in parts if d == e and a <= at < b}
