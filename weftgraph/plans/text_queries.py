"""Queries over texts: whole documents, and conversations loaded as documents into a graph that holds the benchmark's texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions.strings import normalised
from weftgraph.operators import text, textrank, trigram
from weftgraph.sources.tables import table

WHITE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def _norm(t: str) -> str:
    return f"trim(regexp_replace({t}, '{WHITE}', ' ', 'g'), ' ')"


DOCS = f"docs AS (SELECT doc_id, {_norm("coalesce(text, chr(32))")} AS t FROM documents)"
TURNS = f"docs AS (SELECT conv_id * 1000 + turn AS doc_id, {_norm("coalesce(text, chr(32))")} AS t FROM conversations)"
SENTENCES = """cuts AS (SELECT doc_id, string_split(regexp_replace(t, '([.?!]) ', '\\1' || chr(10), 'g'), chr(10)) AS parts FROM docs),
    pieces AS (SELECT doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS k FROM cuts),
    placed AS (SELECT doc_id, s, k, CAST(sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(s) - 1 AS INTEGER) AS start FROM pieces),
    sent AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS sentence, start, s AS text FROM placed WHERE len(string_split(s, ' ')) >= 3)"""
WRAP = """fold AS (SELECT doc_id, -1 AS piece, '' AS obs, t AS rest FROM docs WHERE t <> ''
    UNION ALL SELECT doc_id, piece + 1, CASE WHEN length(rest) <= 140 THEN rest ELSE rtrim(left(rest, cut)) END, CASE WHEN length(rest) <= 140 THEN '' ELSE ltrim(substr(rest, cut + 1)) END
    FROM (SELECT *, CASE WHEN contains(left(rest, 141), ' ') THEN 141 - strpos(reverse(left(rest, 141)), ' ') ELSE 140 END AS cut FROM fold) WHERE rest <> ''),
    wrapped AS (SELECT doc_id, CAST(piece AS INTEGER) AS piece, obs FROM fold WHERE piece >= 0)"""


def _corpus(source: str) -> str:
    return f"corpus AS (SELECT {_norm('lower(text)')} AS t FROM {source}), size AS (SELECT count(*)::DOUBLE AS n FROM corpus), freq AS (SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct(string_split(t, ' '))) AS word FROM corpus) WHERE word <> '' GROUP BY word)"


WEIGHTS = """tf AS (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(string_split(lower(t), ' ')) AS word FROM docs) WHERE word <> '' GROUP BY 1, 2),
    weights AS (SELECT doc_id, word, tf, ln((SELECT n FROM size) / (1 + coalesce(df, 0))) + 1 AS idf, tf * (ln((SELECT n FROM size) / (1 + coalesce(df, 0))) + 1) AS weight FROM tf LEFT JOIN freq USING (word))"""
COSINES = """sw AS (SELECT doc_id, sentence, unnest(list_distinct(string_split(lower(text), ' '))) AS word FROM sent), sw2 AS (SELECT s.*, w.weight * w.weight AS w2 FROM sw s JOIN weights w USING (doc_id, word)),
    norms AS (SELECT doc_id, sentence, sqrt(sum(w2)) AS norm FROM sw2 GROUP BY 1, 2),
    dots AS (SELECT a.doc_id, a.sentence AS i, b.sentence AS j, sum(a.w2) AS dot FROM sw2 a JOIN sw2 b ON a.doc_id = b.doc_id AND a.word = b.word AND a.sentence < b.sentence GROUP BY 1, 2, 3),
    cosines AS (SELECT d.doc_id, i, j, CASE WHEN n1.norm * n2.norm > 0 THEN dot / (n1.norm * n2.norm) ELSE 0 END AS cosine FROM dots d
        JOIN norms n1 ON n1.doc_id = d.doc_id AND n1.sentence = i JOIN norms n2 ON n2.doc_id = d.doc_id AND n2.sentence = j)"""
STEPS = 4
_STEP = """SELECT b.doc_id, b.sentence, b.n, 0.15::DOUBLE / b.n + 0.85::DOUBLE * coalesce(m.s, 0) AS score FROM r0 b LEFT JOIN
    (SELECT p.doc_id, p.b, sum(p.p * v.score) AS s FROM moves p JOIN {v} v ON v.doc_id = p.doc_id AND v.sentence = p.a GROUP BY 1, 2) m ON m.doc_id = b.doc_id AND m.b = b.sentence"""
RANKS = f"""sides AS (SELECT doc_id, i AS a, j AS b, cosine FROM cosines UNION ALL SELECT doc_id, j, i, cosine FROM cosines), sums AS (SELECT doc_id, a, sum(cosine) AS r FROM sides GROUP BY 1, 2),
    moves AS (SELECT doc_id, a, b, cosine / r AS p FROM sides JOIN sums USING (doc_id, a) WHERE r > 0), r0 AS (SELECT doc_id, sentence, count(*) OVER (PARTITION BY doc_id) AS n, 1.0::DOUBLE / count(*) OVER (PARTITION BY doc_id) AS score FROM sent),
    {", ".join(f"r{k + 1} AS ({_STEP.format(v=f'r{k}')})" for k in range(STEPS))}"""
TURN_CHAIN = f"{TURNS}, {SENTENCES}, {_corpus('benchmark')}, {WEIGHTS}, {COSINES}, {RANKS}"
#: Pieces with their starts in the normalised text, and the pairs of them that are chunks.
CHUNKS = """starts AS (SELECT w.doc_id, w.piece, w.obs, CAST(sum(length(w.obs)) OVER (PARTITION BY w.doc_id ORDER BY w.piece) - length(w.obs) + piece AS INTEGER) AS start FROM wrapped w),
    chunks AS (SELECT doc_id, CAST(piece // 2 AS INTEGER) AS chunk, min(start) AS c0, max(start + length(obs)) AS c1, string_agg(obs, ' | ' ORDER BY piece) AS observations FROM starts GROUP BY 1, 2)"""
MARKS = """marks AS (SELECT s.doc_id, s.sentence, s.text, c.chunk, row_number() OVER (PARTITION BY s.doc_id ORDER BY round(score, 9) DESC, s.sentence) AS rn FROM sent s JOIN r4 USING (doc_id, sentence) JOIN chunks c ON c.doc_id = s.doc_id AND s.start >= c0 AND s.start < c1),
    again AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk ORDER BY rn) AS again FROM marks WHERE rn <= 3)"""

SPECIFIC, SCRIPT = "(small|blue).*(bolt|r[ao]d)", r"\b(large|blue)\s+(?:wid\w{3}|rod)\b"


def _turns(spark, d):
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.concat(F.lit("conv:"), "conv_id", F.lit(":"), "turn").alias("title"), "text")


def _normal(spark, d):
    rows = table(spark, d, "documents").select("doc_id", normalised(F.coalesce("text", F.lit(""))).alias("t"))
    return rows.select("doc_id", F.length("t").alias("chars"), F.when(F.col("t") == "", 0).otherwise(F.size(F.split("t", " "))).alias("words"), F.md5("t").alias("digest"))


def _sentences(spark, d):
    found = text.sentences(table(spark, d, "documents"))
    return found.select("doc_id", "sentence", "start", "text")


def _wrapped(spark, d):
    return text.observations(table(spark, d, "documents")).select("doc_id", "piece", "obs")


def _edges(spark, d):
    parts = text.chunks(text.observations(table(spark, d, "documents")))
    return parts.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.size("observations")).alias("pieces")).withColumn("links", 2 * (F.col("chunks") - 1))


def _frequencies(spark, d):
    docs = table(spark, d, "documents").select(F.coalesce("text", F.lit("")).alias("text"))
    n = docs.count()
    found = text.document_frequencies(docs)
    return found.select("word", "df", F.round(F.log(F.lit(float(n)) / (1 + F.col("df"))) + 1, 6).alias("idf"))


def _weights(spark, d):
    corpus = table(spark, d, "benchmark").select("text")
    found = text.term_weights(table(spark, d, "documents"), text.document_frequencies(corpus), corpus.count())
    return found.select("doc_id", "word", "tf", F.round("weight", 6).alias("weight"))


def _turn_parts(spark, d):
    return _parts(_turns(spark, d), table(spark, d, "benchmark").select("text"))


def _parts(docs, corpus):
    from weftgraph.plans.lineage import written

    found = written(text.sentences(docs))
    weights = text.term_weights(docs, text.document_frequencies(corpus), corpus.count())
    return docs, found, written(weights)


def _cosines(spark, d):
    _, found, weights = _turn_parts(spark, d)
    return text.sentence_cosines(found, weights).select("doc_id", "i", "j", F.round("cosine", 6).alias("cosine"))


def _sentence_ranks(docs, corpus, steps=None):
    return textrank.rank_sentences(docs, text.document_frequencies(corpus), corpus.count(), steps)


def _ranks(spark, d):
    found = _sentence_ranks(_turns(spark, d), table(spark, d, "benchmark").select("text"), STEPS)
    return found.select("doc_id", "sentence", F.round("score", 11).alias("score"))


def _highlighted(docs, corpus, top=text.TOP, steps=None):
    return textrank.loaded(docs.select("doc_id", "text"), text.document_frequencies(corpus), corpus.count(), top, steps, parts=False)


def _places_of(loaded):
    rows = loaded.select("doc_id", F.posexplode("highlights").alias("place", "m"))
    return rows.select("doc_id", "place", "m.sentence", "m.phrase")


def _marks(spark, d):
    return _places_of(_highlighted(_turns(spark, d), table(spark, d, "benchmark").select("text"), 3, STEPS))


def _packed(spark, d):
    marks = _highlighted(_turns(spark, d), table(spark, d, "benchmark").select("text"), 8, STEPS)
    return text.packed_index(marks).select("doc_id", F.array_join("observations", "~").alias("observations"))


#: Previews of at most 60 characters, so a line takes two at least, by a fold over places.
PACKED = """line(doc_id, place, filled, line) AS (SELECT doc_id, 1, '', p FROM previews WHERE place = 1 UNION ALL
        SELECT l.doc_id, l.place + 1, CASE WHEN length(l.line || ' | ' || p) <= 140 THEN filled ELSE filled || l.line || '~' END, CASE WHEN length(l.line || ' | ' || p) <= 140 THEN l.line || ' | ' || p ELSE p END
        FROM line l JOIN previews v ON v.doc_id = l.doc_id AND v.place = l.place + 1),
    whole AS (SELECT doc_id, string_split(arg_max(filled || line, place), '~') AS o FROM line GROUP BY doc_id)"""


def _places(spark, d):
    docs = table(spark, d, "documents")
    return text.sentence_chunks(text.sentences(docs), text.chunks(text.observations(docs))).select("doc_id", "sentence", "chunk")


def _pairs(spark, d):
    return text.word_pairs(_turns(spark, d))


PAIRS = f"""WITH {TURNS}, w AS (SELECT doc_id, unnest(string_split(lower(t), ' ')) AS word, generate_subscripts(string_split(lower(t), ' '), 1) AS pos FROM docs)
    SELECT a.doc_id, least(a.word, b.word) AS a, greatest(a.word, b.word) AS b, count(*) AS n FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.pos - a.pos BETWEEN 1 AND 4 AND a.word <> b.word WHERE a.word <> '' AND b.word <> '' GROUP BY 1, 2, 3"""


def _word_ranks(spark, d):
    """Word ranks by the sentence ranks' rounds, with co-occurrence counts for similarities."""
    return textrank.rank_words(_turns(spark, d), STEPS).select("doc_id", "word", F.round("score", 11).alias("score"))


def _load(spark, d):
    corpus = table(spark, d, "benchmark").select("text")
    _, _, stats = text.load_documents(_turns(spark, d), corpus, top=3, steps=STEPS)
    return stats.select("doc_id", *(F.col(c).cast("bigint").alias(c) for c in ("chars", "words", "unique_words", "chunks", "sentences", "highlights")))


def _loaded(spark, d):
    corpus = table(spark, d, "benchmark").select("text")
    entities, relations, _ = text.load_documents(_turns(spark, d), corpus, top=3, steps=STEPS)
    kinds = entities.groupBy(F.col("entity_type").alias("kind")).agg(F.count("*").alias("n"))
    return kinds.unionByName(relations.groupBy(F.col("rel_type").alias("kind")).agg(F.count("*").alias("n")))


LOADED = f"""WITH RECURSIVE {TURN_CHAIN}, {WRAP}, {CHUNKS}, {MARKS}, h AS (SELECT doc_id, count(*) AS h FROM again WHERE again = 1 GROUP BY 1), c AS (SELECT doc_id, count(*) AS c FROM chunks GROUP BY 1),
    x AS (SELECT coalesce(h, 0) AS h, coalesce(c, 0) AS c FROM docs LEFT JOIN h USING (doc_id) LEFT JOIN c USING (doc_id)),
    k(kind, n) AS (SELECT 'Document', count(*) FROM x UNION ALL SELECT 'TextChunk', sum(c) FROM x UNION ALL SELECT 'DocumentIndex', sum(h + 1) FROM x UNION ALL SELECT 'starts_with', sum((c > 0)::INT) FROM x
        UNION ALL SELECT 'ends_with', sum((c > 1)::INT) FROM x UNION ALL SELECT 'belongs_to', sum((c > 0)::INT + (c > 1)::INT) FROM x UNION ALL SELECT 'follows', sum(greatest(c - 1, 0)) FROM x UNION ALL SELECT 'preceded_by', sum(greatest(c - 1, 0)) FROM x
        UNION ALL SELECT 'has_index', count(*) FROM x UNION ALL SELECT 'indexes', count(*) FROM x UNION ALL SELECT 'contains', sum(h) FROM x UNION ALL SELECT 'contained_in', sum(h) FROM x UNION ALL SELECT 'highlights', sum(h) FROM x UNION ALL SELECT 'highlighted_by', sum(h) FROM x)
    SELECT kind, CAST(n AS BIGINT) AS n FROM k WHERE n > 0"""
LOAD = f"""WITH RECURSIVE {TURN_CHAIN}, {WRAP}, {CHUNKS}, {MARKS}, h AS (SELECT doc_id, count(*) AS h FROM again WHERE again = 1 GROUP BY 1), c AS (SELECT doc_id, count(*) AS c FROM chunks GROUP BY 1),
    w AS (SELECT doc_id, sum(tf) AS words, count(*) AS uniq FROM tf GROUP BY 1), s AS (SELECT doc_id, count(*) AS s FROM sent GROUP BY 1)
    SELECT r.conv_id * 1000 + r.turn AS doc_id, CAST(coalesce(length(r.text), 0) AS BIGINT) AS chars, CAST(coalesce(words, 0) AS BIGINT) AS words, CAST(coalesce(uniq, 0) AS BIGINT) AS unique_words, CAST(coalesce(c, 0) AS BIGINT) AS chunks,
    CAST(coalesce(s, 0) AS BIGINT) AS sentences, CAST(coalesce(h, 0) AS BIGINT) AS highlights
    FROM conversations r LEFT JOIN w ON w.doc_id = r.conv_id * 1000 + r.turn LEFT JOIN c ON c.doc_id = r.conv_id * 1000 + r.turn LEFT JOIN s ON s.doc_id = r.conv_id * 1000 + r.turn LEFT JOIN h ON h.doc_id = r.conv_id * 1000 + r.turn"""


def _titled(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc:"), "doc_id").alias("title"), F.coalesce("text", F.lit("")).alias("text"))


def _whole_ranks(spark, d):
    docs = _titled(spark, d)
    return _sentence_ranks(docs, docs.select("text"))


def _whole_word_ranks(spark, d):
    return textrank.rank_words(_titled(spark, d))


def _whole_entries(spark, d):
    docs = _titled(spark, d)
    return _places_of(_highlighted(docs, docs.select("text")))


def _whole_packed(spark, d):
    docs = _titled(spark, d)
    return text.packed_index(_highlighted(docs, docs.select("text")))


def _whole_load(spark, d):
    docs = _titled(spark, d)
    return text.load_documents(docs, docs.select("text"))[2]


def _whole_graph(spark, d):
    docs = _titled(spark, d)
    entities, relations, _ = text.load_documents(docs, docs.select("text"))
    kinds = entities.groupBy(F.col("entity_type").alias("kind")).agg(F.count("*").alias("n"))
    return kinds.unionByName(relations.groupBy(F.col("rel_type").alias("kind")).agg(F.count("*").alias("n")))


#: The whole job, over whole documents, ranked to the tolerance and with the usual number of highlights; rounds without a fixed number have no SQL.
WHOLE = {
    "document_sentence_textrank": _whole_ranks,
    "document_word_textrank": _whole_word_ranks,
    "document_index_entries": _whole_entries,
    "document_index_packing": _whole_packed,
    "document_load_stats": _whole_load,
    "document_load_graph": _whole_graph,
}


def _names(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))


GRAM = "unicode(text[i + 1]) * 65536 + unicode(text[i + 2]) * 256 + unicode(text[i + 3])"
POSTINGS = f"post AS (SELECT DISTINCT CAST({GRAM} AS INTEGER) AS trigram, id FROM (SELECT p_partkey AS id, lower(p_name) AS text, unnest(range(greatest(length(p_name) - 2, 0))) AS i FROM part))"


def _candidates(pattern):
    def run(spark, d):
        names = _names(spark, d)
        return trigram.candidates(names, trigram.rebuild(names), pattern)

    return run


def _indexed(spark, d):
    names = _names(spark, d)
    return trigram.search_text(names, SPECIFIC, trigram.rebuild(names))


def _scripted(spark, d):
    """The same names in capitals, by a pattern of the other dialect in any case."""
    names = _names(spark, d).withColumn("text", F.upper("text"))
    return trigram.search_text(names, SCRIPT, trigram.rebuild(names), "script", any_case=True).withColumn("text", F.lower("text"))


def _soundness(spark, d):
    """Matches, and those of them that the candidates lack: none."""
    names = _names(spark, d)
    found = trigram.search_text(names, SPECIFIC)
    kept = found.join(trigram.candidates(names, trigram.postings(names), SPECIFIC).withColumn("hit", F.lit(True)), "id", "left")
    return kept.agg(F.count("*").alias("matched"), F.count_if(F.col("hit").isNull()).alias("missed"))


def _updated(spark, d):
    names = _names(spark, d)
    index = trigram.remove(trigram.rebuild(names), names.filter("id % 2 = 0"))
    index = trigram.add(index, names.filter("id % 4 = 0").withColumn("text", F.lit("abcd")))
    return trigram.index_size(index)


def _all() -> dict:
    return {
        "doc_normalize_stats": (_normal, f"WITH {DOCS} SELECT doc_id, CAST(length(t) AS INTEGER) AS chars, CAST(CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS INTEGER) AS words, md5(t) AS digest FROM docs"),
        "sentences": (_sentences, f"WITH {DOCS}, {SENTENCES} SELECT doc_id, sentence, start, text FROM sent"),
        "observation_wrap": (_wrapped, f"WITH RECURSIVE {DOCS}, {WRAP} SELECT doc_id, piece, obs FROM wrapped"),
        "chunk_edges": (_edges, f"WITH RECURSIVE {DOCS}, {WRAP}, n AS (SELECT doc_id, count(*) AS pieces FROM wrapped GROUP BY 1) SELECT doc_id, (pieces + 1) // 2 AS chunks, pieces, 2 * ((pieces + 1) // 2 - 1) AS links FROM n"),
        "df_idf": (_frequencies, f"WITH {_corpus('documents')} SELECT word, df, round(ln((SELECT n FROM size) / (1 + df)) + 1, 6) AS idf FROM freq"),
        "tfidf": (_weights, f"WITH {DOCS}, {_corpus('benchmark')}, {WEIGHTS} SELECT doc_id, word, tf, round(weight, 6) AS weight FROM weights"),
        "sentence_cosine": (_cosines, f"WITH {TURN_CHAIN} SELECT doc_id, i, j, round(cosine, 6) AS cosine FROM cosines"),
        "sentence_textrank_k": (_ranks, f"WITH {TURN_CHAIN} SELECT doc_id, sentence, round(score, 11) AS score FROM r{STEPS}"),
        "index_entries": (
            _marks,
            f"WITH RECURSIVE {TURN_CHAIN}, {WRAP}, {CHUNKS}, {MARKS} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY rn) - 1 AS INTEGER) AS place, sentence, CASE WHEN length(text) <= 140 THEN text ELSE left(text, 137) || '...' END AS phrase FROM again WHERE again = 1",
        ),
        "index_packing": (
            _packed,
            f"WITH RECURSIVE {TURN_CHAIN}, {WRAP}, {CHUNKS}, {MARKS.replace('rn <= 3', 'rn <= 8')}, phrases AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rn) AS place, CASE WHEN length(text) <= 140 THEN text ELSE left(text, 137) || '...' END AS t FROM again WHERE again = 1), "
            f"previews AS (SELECT doc_id, place, CASE WHEN length(t) > 60 THEN left(t, 57) || '...' ELSE t END AS p FROM phrases), {PACKED} SELECT doc_id, array_to_string(o[1:2], '~') AS observations FROM whole",
        ),
        "sentence_to_chunk": (_places, f"WITH RECURSIVE {DOCS}, {SENTENCES}, {WRAP}, {CHUNKS} SELECT s.doc_id, sentence, chunk FROM sent s JOIN chunks c ON c.doc_id = s.doc_id AND s.start >= c0 AND s.start < c1"),
        "word_cooccurrence": (_pairs, PAIRS),
        "word_textrank_k": (
            _word_ranks,
            f"WITH {PAIRS.removeprefix('WITH ').replace('    SELECT a.doc_id', '    pairs AS (SELECT a.doc_id', 1)}), sent AS (SELECT DISTINCT doc_id, unnest([a, b]) AS sentence FROM pairs), cosines AS (SELECT doc_id, a AS i, b AS j, n::DOUBLE AS cosine FROM pairs), {RANKS} SELECT doc_id, sentence AS word, round(score, 11) AS score FROM r{STEPS}".replace("AS pos FROM docs)\n", "AS pos FROM docs),\n"),
        ),
        "load_stats": (_load, LOAD),
        "load_graph": (_loaded, LOADED),
        "trigram_postings": (lambda s, d: trigram.postings(_names(s, d)), f"WITH {POSTINGS} SELECT trigram, id FROM post"),
        "trigram_candidates": (_candidates("green|blue"), f"WITH {POSTINGS}, n AS (SELECT id FROM post WHERE trigram IN ({_grams('green')}) GROUP BY id HAVING count(*) = 3 UNION SELECT id FROM post WHERE trigram IN ({_grams('blue')}) GROUP BY id HAVING count(*) = 2) SELECT id FROM n"),
        "trigram_search": (_indexed, f"SELECT p_partkey AS id, p_name AS text FROM part WHERE regexp_matches(p_name, '{SPECIFIC}')"),
        "trigram_none": (_candidates("no such [a-z]+"), "SELECT p_partkey AS id FROM part WHERE contains(p_name, 'no such ')"),
        "trigram_search_script": (_scripted, f"SELECT p_partkey AS id, p_name AS text FROM part WHERE regexp_matches(upper(p_name), '{SCRIPT}', 'i')"),
        "trigram_soundness": (_soundness, f"SELECT count(*) AS matched, 0::BIGINT AS missed FROM part WHERE regexp_matches(p_name, '{SPECIFIC}')"),
        "trigram_update": (
            _updated,
            f"WITH {POSTINGS}, p AS (SELECT trigram, id FROM post WHERE id % 2 <> 0 UNION ALL SELECT CAST(unnest([{_grams('abcd')}]) AS INTEGER), p_partkey FROM part WHERE p_partkey % 4 = 0) SELECT count(DISTINCT id) AS ids, count(DISTINCT trigram) AS trigrams, count(*) AS postings FROM p",
        ),
    }


def _grams(word: str) -> str:
    raw = word.encode()
    return ", ".join(str(raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) for i in range(len(raw) - 2))


def queries() -> dict:
    return {k: f for k, (f, _) in _all().items()} | WHOLE


def oracle_sql() -> dict:
    return {k: s for k, (_, s) in _all().items() if s}
