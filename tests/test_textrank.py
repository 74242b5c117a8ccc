"""Ranks worked out where a text is, against the relational operators of `text`, on odd texts, and without a job for each round."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import text, textrank
from weftgraph.plans import text_queries


def odd_texts(n: int) -> list[str | None]:
    rng = random.Random(7)
    words = ["graph", "Graph", "nodes", "EDGE", "walk.", "Rank!", "who?", "éclair", "Ünder", "ΣΟΦΟΣ", "İs", "😀😀", "the", "of", "a\x1cb", "x\x85y", "...", "long" * 50, *(f"w{i}" for i in range(30))]
    blanks = [" ", " ", " ", "\n", "\t ", " ", "　", " ﻿", " ", "\x0b\x0c"]
    found = ["".join(rng.choice(words) + rng.choice(blanks) for _ in range(rng.randrange(1, 150))) for _ in range(n)]
    return [*found, None, "", "  ", "one", "one two", "same same same", "Same words here. Same words here. Same words here. Same words here.", " ".join(f"Sentence number {i} stands apart{i}." for i in range(256))]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(k, f"t{k}", t) for k, t in enumerate(odd_texts(40))], "doc_id long, title string, text string").repartition(3)


@pytest.fixture(scope="module")
def related(odd):
    """The corpus, and sentences, weights and ranks by joins."""
    corpus = odd.filter("doc_id % 3 <> 1").select("text")
    found = text.sentences(odd).cache()
    weights = text.term_weights(odd, text.document_frequencies(corpus), corpus.count()).cache()
    return corpus, found, weights, text.ranks_by_words(found, weights).cache()


def jobs(spark, name: str, made) -> int:
    spark.sparkContext.setJobGroup(name, name)
    try:
        made().collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def near(got: dict, want: dict) -> bool:
    return got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items())


def test_frequencies(odd, related):
    words = F.explode(F.array_distinct(F.split(text.normalised(F.lower("text")), " "))).alias("word")
    want = related[0].select(words).filter("word <> ''").groupBy("word").count()
    assert sorted(map(tuple, text.document_frequencies(related[0]).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("common", [textrank.COMMON, 12, 0])
def test_sentence_ranks(odd, related, monkeypatch, common):
    """However many words' frequencies each process holds."""
    monkeypatch.setattr(textrank, "COMMON", common)
    corpus, _, _, ranks = related
    got = textrank.rank_sentences(odd, text.document_frequencies(corpus), corpus.count())
    assert near({(r.doc_id, r.sentence): r.score for r in got.collect()}, {(r.doc_id, r.sentence): r.score for r in ranks.collect()})


def test_sentence_ranks_without_corpus(odd, related):
    found, weights = related[1], related[2]
    got = textrank.rank_sentences(odd, text.document_frequencies(related[0].limit(0)), 0)
    want = text.ranks_by_words(found, weights.limit(0))
    assert near({tuple(r)[:2]: r.score for r in got.collect()}, {tuple(r)[:2]: r.score for r in want.collect()})


def test_sentence_jobs(spark, tmp_path):
    """Rounds cost no jobs: over thirty for this text before."""
    spark.createDataFrame([(1, " ".join(f"Word{i} links word{i + 1} on." for i in range(60)))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert jobs(spark, "sentence rounds", lambda: text_queries.WHOLE["document_sentence_textrank"](spark, str(tmp_path))) <= 15


def test_word_ranks(odd):
    pairs = text.word_pairs(odd)
    words = pairs.select("doc_id", F.explode(F.array("a", "b")).alias("sentence")).distinct()
    want = text.sentence_ranks(words, pairs.select("doc_id", F.col("a").alias("i"), F.col("b").alias("j"), F.col("n").cast("double").alias("cosine")))
    got = textrank.rank_words(odd)
    assert near({(r.doc_id, r.word): r.score for r in got.collect()}, {(r.doc_id, r.sentence): r.score for r in want.collect()})


def test_word_jobs(spark, tmp_path):
    spark.createDataFrame([(1, " ".join(f"w{i} w{i + 1}" for i in range(300)))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert jobs(spark, "word rounds", lambda: text_queries.WHOLE["document_word_textrank"](spark, str(tmp_path))) <= 3


def test_highlights(odd, related):
    corpus, found, _, ranks = related
    parts = text.chunks(text.observations(odd))
    want = text.highlights(found, ranks, text.sentence_chunks(found, parts))
    rows = textrank.loaded(odd, text.document_frequencies(corpus), corpus.count(), text.TOP).cache()
    got = rows.select("doc_id", F.posexplode("highlights").alias("place", "m")).select("doc_id", "place", "m.*")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    got = rows.select("doc_id", F.posexplode("chunks").alias("chunk", "c")).select("doc_id", "chunk", "c.*")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, parts.select("doc_id", "chunk", "chunk_id", "observations").collect()))
    bare = textrank.loaded(odd, text.document_frequencies(corpus), corpus.count(), text.TOP, parts=False)
    assert sorted((r.doc_id, r.highlights) for r in bare.collect()) == sorted((r.doc_id, r.highlights) for r in rows.collect())


def test_entry_jobs(spark, tmp_path):
    spark.createDataFrame([(1, " ".join(f"Word{i} links word{i + 1} on." for i in range(60)))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert jobs(spark, "entry rounds", lambda: text_queries.WHOLE["document_index_entries"](spark, str(tmp_path))) <= 15


def test_rounding(spark):
    """As Spark rounds, at halves too: 0.15 / 256 has ten decimals, and the last is a five."""
    import numpy as np

    rng = random.Random(3)
    scores = [0.15 / n for n in range(1, 3000)] + [rng.random() for _ in range(2000)] + [k * 1e-9 + 5e-10 for k in range(2000)] + [0.1234567885, 0.1234567895, 1.0]
    want = spark.createDataFrame(list(enumerate(scores)), "k int, s double").orderBy("k").select(F.round("s", 9)).collect()
    assert [round(r[0] * 1e9) for r in want] == textrank.rounded(np.array(scores)).astype(int).tolist()


def test_packing(odd, related):
    corpus, found, _, ranks = related
    marks = text.highlights(found, ranks, text.sentence_chunks(found, text.chunks(text.observations(odd))))
    want = marks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("place", "phrase"))).alias("m")).select("doc_id", text.packed(F.transform("m", lambda x: x["phrase"])))
    got = text.packed_index(textrank.loaded(odd, text.document_frequencies(corpus), corpus.count(), text.TOP, parts=False))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_packing_jobs(spark, tmp_path):
    spark.createDataFrame([(1, " ".join(f"Word{i} links word{i + 1} on." for i in range(60)))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert jobs(spark, "packing rounds", lambda: text_queries.WHOLE["document_index_packing"](spark, str(tmp_path))) <= 15


def test_graph(odd, related):
    """Every link of the loaded documents, by hand from chunks and highlights."""
    corpus, found, _, ranks = related
    parts = text.chunks(text.observations(odd))
    entities, relations, _ = text.load_documents(odd, corpus)
    chunks, marks, links, names = {}, {}, [], []
    for r in parts.orderBy("doc_id", "chunk").collect():
        chunks.setdefault(r.doc_id, []).append(r)
    for r in text.highlights(found, ranks, text.sentence_chunks(found, parts)).orderBy("doc_id", "place").collect():
        marks.setdefault(r.doc_id, []).append(r)
    for (d, title) in odd.select("doc_id", "title").collect():
        c, m, hub = [x.chunk_id for x in chunks.get(d, [])], marks.get(d, []), f"{title}__index"
        names += [(title, "Document", ()), (hub, "DocumentIndex", ())] + [(x.chunk_id, "TextChunk", tuple(x.observations)) for x in chunks.get(d, [])] + [(f"{title}__idx_{x.place}", "DocumentIndex", (x.phrase,)) for x in m]
        pairs = [(title, x, "starts_with", "belongs_to") for x in c[:1]] + [(title, x, "ends_with", "belongs_to") for x in c[1:][-1:]] + [(a, b, "follows", "preceded_by") for a, b in zip(c, c[1:])] + [(title, hub, "has_index", "indexes")]  # noqa: B905
        for x in m:
            pairs += [(hub, f"{title}__idx_{x.place}", "contains", "contained_in"), (f"{title}__idx_{x.place}", x.chunk_id, "highlights", "highlighted_by")]
        links += [y for a, b, there, back in pairs for y in ((a, b, there), (b, a, back))]
    assert sorted((r.name, r.entity_type, tuple(r.observations)) for r in entities.collect()) == sorted(names)
    assert sorted(map(tuple, relations.select("src", "dst", "rel_type").collect())) == sorted(links)


def test_graph_jobs(spark, tmp_path):
    spark.createDataFrame([(1, " ".join(f"Word{i} links word{i + 1} on." for i in range(60)))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert jobs(spark, "graph rounds", lambda: text_queries.WHOLE["document_load_graph"](spark, str(tmp_path))) <= 20


def test_stats(odd, related):
    corpus, found, weights, ranks = related
    parts = text.chunks(text.observations(odd))
    count = lambda df: {r.doc_id: r.n for r in df.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    tf = {r.doc_id: (r.words, r.unique) for r in weights.groupBy("doc_id").agg(F.sum("tf").alias("words"), F.count("*").alias("unique")).collect()}
    c, s, h = count(parts), count(found), count(text.highlights(found, ranks, text.sentence_chunks(found, parts)))
    want = [(r.doc_id, len(r.text or ""), *tf.get(r.doc_id, (0, 0)), c.get(r.doc_id, 0), s.get(r.doc_id, 0), h.get(r.doc_id, 0)) for r in odd.collect()]
    assert sorted(map(tuple, text.load_documents(odd, corpus)[2].collect())) == sorted(want)


def test_stat_jobs(spark, tmp_path):
    spark.createDataFrame([(1, " ".join(f"Word{i} links word{i + 1} on." for i in range(60)))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert jobs(spark, "stat rounds", lambda: text_queries.WHOLE["document_load_stats"](spark, str(tmp_path))) <= 20
