"""Documents as graphs: normalising, wrapping, chunking, sentences, term weights and ranked highlights, for many documents at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from weftgraph.functions.strings import normalised
from weftgraph.operators import textrank
from weftgraph.operators.textrank import ROUNDS, TOLERANCE, document_frequencies
from weftgraph.schema import MAX_LENGTH, MAX_OBSERVATIONS

TOP = 15


def wrap(text: str, width: int = MAX_LENGTH) -> list[tuple[str, int]]:
    """Pieces of at most `width` UTF-16 units and their starts: cut at the last blank that fits, inside a word only where none does."""
    wide = not text.isascii() and any(ord(c) > 0xFFFF for c in text)
    out, at = [], 0
    while at < len(text):
        last = min(at + width, len(text))
        while wide and last > at and len(text[at:last].encode("utf-16-le")) > 2 * width:
            last -= 1
        if last == len(text):
            out.append((text[at:], at))
            break
        blank = text.rfind(" ", at, last + 1)
        end = blank if blank > at else last
        out.append((text[at:end].rstrip(), at))
        at = end
        while at < len(text) and text[at] == " ":
            at += 1
    return out


def observations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, obs: the pieces of each document's normalised text, numbered from zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [wrap(t) for t in b.column(1).to_pylist()]
            count = np.array([len(x) for x in found], np.int64)
            first = np.cumsum(count) - count
            piece = np.arange(int(count.sum())) - np.repeat(first, count)
            start = np.fromiter((at for x in found for _, at in x), np.int32, len(piece))
            owner = b.column(0).take(pa.array(np.repeat(np.arange(len(count)), count)))
            yield pa.RecordBatch.from_arrays([owner, pa.array(piece.astype(np.int32)), pa.array(start), pa.array([o for x in found for o, _ in x], pa.string())], ["doc_id", "piece", "start", "obs"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start int, obs string")


def chunks(pieces: DataFrame) -> DataFrame:
    """doc_id, chunk, chunk_id, observations, start, end: neighbouring pieces in pairs; the id is made of the content."""
    grouped = pieces.withColumn("chunk", F.floor(F.col("piece") / MAX_OBSERVATIONS).cast("int")).groupBy("doc_id", "chunk")
    grouped = grouped.agg(F.sort_array(F.collect_list(F.struct("piece", "start", "obs"))).alias("p"))
    text = F.transform("p", lambda x: x["obs"])
    last = F.element_at("p", -1)
    name = F.substring(F.sha2(F.concat_ws("\x00", F.col("doc_id"), F.col("chunk"), F.array_join(text, "\x00")), 256), 1, 24)
    return grouped.select("doc_id", "chunk", name.alias("chunk_id"), text.alias("observations"), F.col("p")[0]["start"].alias("start"), (last["start"] + F.length(last["obs"])).alias("end"))


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sentence (number), start, text, words of each sentence of at least three words, in the normalised text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    # the blank after an end mark parts two sentences, and is one character after normalising
    start = F.struct(F.array().cast("array<struct<text: string, start: int>>").alias("found"), F.lit(0).alias("at"))

    def step(state: Column, s: Column) -> Column:
        return F.struct(F.concat(state["found"], F.array(F.struct(s.alias("text"), state["at"].alias("start")))).alias("found"), (state["at"] + F.length(s) + 1).alias("at"))

    rows = rows.select("doc_id", F.aggregate(F.split("t", r"(?<=[.?!]) "), start, step, lambda s: s["found"]).alias("found"))
    long = F.filter("found", lambda x: F.size(F.split(x["text"], " ")) >= 3)
    rows = rows.select("doc_id", F.posexplode(long).alias("sentence", "s"))
    return rows.select("doc_id", "sentence", F.col("s.start").alias("start"), F.col("s.text").alias("text"), F.split(F.lower("s.text"), " ").alias("words"))


def term_weights(docs: DataFrame, frequencies: DataFrame, corpus: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, word, tf, idf, weight of every word of each document; idf = ln(N / (1 + df)) + 1 over the corpus before the load.

    An empty corpus gives no weights (null): its sentences all rank alike.
    """
    words = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.explode(F.split(normalised(F.lower(F.coalesce(F.col(text_col), F.lit("")))), " ")).alias("word")).filter("word <> ''")
    tf = words.groupBy("doc_id", "word").agg(F.count("*").alias("tf"))
    idf = F.log(F.lit(float(corpus)) / (1 + F.coalesce("df", F.lit(0)))) + 1 if corpus else F.lit(None).cast("double")
    rows = tf.join(frequencies, "word", "left").withColumn("idf", idf)
    return rows.select("doc_id", "word", "tf", "idf", (F.col("tf") * F.col("idf")).alias("weight"))


def sentence_cosines(found: DataFrame, weights: DataFrame) -> DataFrame:
    """doc_id, i, j, cosine of the pairs i < j of a document's sentences that share a word: as many rows as there are such pairs, so ranks come from ranks_by_words.

    Word vectors hold the document's weights, masked by the words that a sentence has: pairs come from an equi join on document and word.
    """
    words = found.select("doc_id", "sentence", F.explode(F.array_distinct("words")).alias("word")).join(weights.select("doc_id", "word", (F.col("weight") ** 2).alias("w2")), ["doc_id", "word"])
    norms = words.groupBy("doc_id", "sentence").agg(F.sqrt(F.sum("w2")).alias("norm"))
    left = words.select("doc_id", "word", "w2", F.col("sentence").alias("i"))
    right = words.select("doc_id", "word", F.col("sentence").alias("j"))
    dots = left.join(right, ["doc_id", "word"]).filter("i < j").groupBy("doc_id", "i", "j").agg(F.sum("w2").alias("dot"))
    dots = dots.join(norms.select("doc_id", F.col("sentence").alias("i"), F.col("norm").alias("n1")), ["doc_id", "i"]).join(norms.select("doc_id", F.col("sentence").alias("j"), F.col("norm").alias("n2")), ["doc_id", "j"])
    size = F.col("n1") * F.col("n2")
    return dots.select("doc_id", "i", "j", F.when(size > 0, F.col("dot") / size).otherwise(0.0).alias("cosine"))


def word_shares(found: DataFrame, weights: DataFrame) -> DataFrame:
    """doc_id, sentence, word, b: a sentence's word vector divided by its length, so that two sentences' cosine is the sum of b * b over their words."""
    words = found.select("doc_id", "sentence", F.explode(F.array_distinct("words")).alias("word")).join(weights.select("doc_id", "word", "weight"), ["doc_id", "word"])
    norms = words.groupBy("doc_id", "sentence").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("norm"))
    return words.join(norms.filter("norm > 0"), ["doc_id", "sentence"]).select("doc_id", "sentence", "word", (F.col("weight") / F.col("norm")).alias("b"))


def ranks_by_words(found: DataFrame, weights: DataFrame, steps: int | None = None, damping: float = 0.85, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, sentence, score: what sentence_ranks gives from sentence_cosines, without a row for each pair of sentences.

    A round sends each sentence's score to its words and each word's sum back, less what came from the sentence itself: it takes as many rows as
    sentences have words, where pairs would be the square of the sentences that share a common word.
    """
    from weftgraph.plans.lineage import written

    shares = written(word_shares(found, weights))

    def received(sums: DataFrame, own: Column) -> DataFrame:
        """For each sentence the sum over its words of b times what the word's other sentences sent; a word of one sentence gives zero exactly."""
        return shares.join(sums, ["doc_id", "word"]).groupBy("doc_id", "sentence").agg(F.sum(F.col("b") * (F.col("u") - own)).alias("m"))

    rows = received(shares.groupBy("doc_id", "word").agg(F.sum("b").alias("u")), F.col("b")).filter("m > 0").select("doc_id", "sentence", F.col("m").alias("r"))
    shares = written(shares.join(rows, ["doc_id", "sentence"]), shares)

    def moved(ranks: DataFrame) -> DataFrame:
        sent = shares.join(ranks.select("doc_id", "sentence", "score"), ["doc_id", "sentence"]).withColumn("q", F.col("b") * F.col("score") / F.col("r"))
        sums = sent.groupBy("doc_id", "word").agg(F.sum("q").alias("u"))
        return sent.join(sums, ["doc_id", "word"]).groupBy("doc_id", "sentence").agg(F.sum(F.col("b") * (F.col("u") - F.col("q"))).alias("m"))

    return _rounds(found, moved, steps, damping, tolerance)


def sentence_ranks(found: DataFrame, cosines: DataFrame, steps: int | None = None, damping: float = 0.85, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, sentence, score: each document's ranks by rounds of s = (1 - d) / n + d * sum(M / R * s), from the pairs (i, j, cosine) of M.

    Rounds go on until a document's own scores change by less than `tolerance`, or for `steps` rounds if given. Rows of the similarity
    matrix that are zero give nothing. The rounds are joins over all documents together that aren't final yet.
    """
    from weftgraph.plans.lineage import written

    both = cosines.select("doc_id", F.col("i").alias("a"), F.col("j").alias("b"), "cosine").unionByName(cosines.select("doc_id", F.col("j").alias("a"), F.col("i").alias("b"), "cosine"))
    sums = both.groupBy("doc_id", "a").agg(F.sum("cosine").alias("r")).filter("r > 0")
    steps_of = written(both.join(sums, ["doc_id", "a"]).select("doc_id", "a", "b", (F.col("cosine") / F.col("r")).alias("p")))

    def moved(ranks: DataFrame) -> DataFrame:
        given = steps_of.join(ranks.select("doc_id", F.col("sentence").alias("a"), "score"), ["doc_id", "a"])
        return given.groupBy("doc_id", F.col("b").alias("sentence")).agg(F.sum(F.col("p") * F.col("score")).alias("m"))

    return _rounds(found, moved, steps, damping, tolerance)


def _rounds(found: DataFrame, moved, steps: int | None, damping: float, tolerance: float) -> DataFrame:
    """Scores of each document's sentences after `steps` rounds, or when a document's own change by less than the tolerance; moved: scores -> doc_id, sentence, m."""
    from weftgraph.plans.lineage import written

    counts = found.groupBy("doc_id").agg(F.count("*").alias("n"))
    ranks = base = written(found.select("doc_id", "sentence").join(counts, "doc_id").withColumn("score", 1 / F.col("n")))
    new = (1 - damping) / F.col("n") + damping * F.coalesce("m", F.lit(0.0))
    if steps is not None:
        for k in range(steps):
            ranks = base.select("doc_id", "sentence", "n").join(moved(ranks), ["doc_id", "sentence"], "left").select("doc_id", "sentence", "n", new.alias("score"))
            if (k + 1) % 5 == 0 and k + 1 < steps:
                ranks = written(ranks)
        return ranks.select("doc_id", "sentence", "score")
    found, keep = None, False
    for _ in range(ROUNDS):  # one job a round: what is final, and how much of it there is, is seen while the round is written
        after = ranks.join(moved(ranks), ["doc_id", "sentence"], "left").select("doc_id", "sentence", "n", new.alias("score"), F.abs(new - F.col("score")).alias("change"))
        done = F.sum("change").over(Window.partitionBy("doc_id")) < tolerance
        seen = Observation()
        after = after.select("doc_id", "sentence", "n", "score", done.alias("done")).observe(seen, F.count_if("done").alias("final"), F.count("*").alias("rows"))
        base = written(after, None if keep else base)
        counts = seen.get if not base.isEmpty() else {"final": 0, "rows": 0}
        keep = counts["final"] > 0
        if keep:
            part = base.filter("done").select("doc_id", "sentence", "score")
            found = part if found is None else found.unionByName(part)
        ranks = base.filter("NOT done").drop("done")
        if counts["final"] == counts["rows"]:
            break
    rest = ranks.select("doc_id", "sentence", "score")
    return rest if found is None else found.unionByName(rest)


def word_pairs(docs: DataFrame, window: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a, b, n: how often two different words of a document, a < b, stand within a window of `window` words."""
    words = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(F.split(normalised(F.lower(F.coalesce(F.col(text_col), F.lit("")))), " ")).alias("pos", "word")).filter("word <> ''")
    order = Window.partitionBy("doc_id").orderBy("pos")
    ahead = F.array(*(F.lead("word", k).over(order) for k in range(1, window)))
    pairs = words.withColumn("ahead", ahead).select("doc_id", "word", F.explode("ahead").alias("other")).filter("other IS NOT NULL AND other <> word")
    return pairs.groupBy("doc_id", F.least("word", "other").alias("a"), F.greatest("word", "other").alias("b")).agg(F.count("*").alias("n"))


def sentence_chunks(found: DataFrame, parts: DataFrame) -> DataFrame:
    """doc_id, sentence, chunk, chunk_id: the chunk in which a sentence starts, the last that starts at or before it, if it goes on to there.

    Starts of both kinds are put in one order by document, and each sentence looks back to the last chunk.
    """
    chunk = F.struct("chunk", "chunk_id", F.col("end").alias("c1"))
    starts = parts.select("doc_id", "start", F.lit(0).alias("kind"), F.lit(None).cast("int").alias("sentence"), chunk.alias("part"))
    starts = starts.unionByName(found.select("doc_id", "start", F.lit(1).alias("kind"), "sentence"), allowMissingColumns=True)
    back = Window.partitionBy("doc_id").orderBy("start", "kind", "sentence").rowsBetween(Window.unboundedPreceding, 0)
    rows = starts.withColumn("part", F.last("part", ignorenulls=True).over(back)).filter("kind = 1 AND start < part.c1")
    return rows.select("doc_id", "sentence", "part.chunk", "part.chunk_id")


def highlights(found: DataFrame, ranks: DataFrame, places: DataFrame, top: int = TOP) -> DataFrame:
    """doc_id, place, sentence, chunk_id, phrase: a document's best sentences, the best one of each chunk."""
    rows = found.join(ranks, ["doc_id", "sentence"]).join(places, ["doc_id", "sentence"], "left")
    best = Window.partitionBy("doc_id").orderBy(F.desc(F.round("score", 9)), "sentence")  # nearer scores are ties
    rows = rows.withColumn("rn", F.row_number().over(best)).filter((F.col("rn") <= top) & F.col("chunk_id").isNotNull())
    rows = rows.withColumn("again", F.row_number().over(Window.partitionBy("doc_id", "chunk_id").orderBy("rn"))).filter("again = 1")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("rn")) - 1
    phrase = F.when(F.length("text") <= MAX_LENGTH, F.col("text")).otherwise(F.concat(F.substring("text", 1, MAX_LENGTH - 3), F.lit("...")))
    return rows.select("doc_id", place.alias("place"), "sentence", "chunk_id", phrase.alias("phrase"))


def packed(previews: Column, most: int = MAX_OBSERVATIONS, width: int = MAX_LENGTH, preview: int = 60) -> Column:
    """Phrases cut to `preview` characters and joined by bars into at most `most` observations of at most `width`."""
    short = F.transform(previews, lambda p: F.when(F.length(p) > preview, F.concat(F.substring(p, 1, preview - 3), F.lit("..."))).otherwise(p))
    start = F.struct(F.array().cast("array<string>").alias("full"), F.lit("").alias("line"))

    def add(state: Column, p: Column) -> Column:
        longer = F.when(state["line"] == "", p).otherwise(F.concat(state["line"], F.lit(" | "), p))
        fits = F.length(longer) <= width
        return F.struct(F.when(fits, state["full"]).otherwise(F.concat(state["full"], F.array(state["line"]))).alias("full"), F.when(fits, longer).otherwise(p).alias("line"))

    return F.aggregate(short, start, add, lambda s: F.slice(F.when(s["line"] == "", s["full"]).otherwise(F.concat(s["full"], F.array(s["line"]))), 1, most))


def packed_index(loaded: DataFrame) -> DataFrame:
    """doc_id, observations: one index entry for the highlights of each document that has some, in their order."""
    return loaded.filter(F.size("highlights") > 0).select("doc_id", packed(F.transform("highlights", lambda m: m["phrase"])).alias("observations"))


def document_graph(loaded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of `textrank.loaded` with a title -> entities (name, entity_type, observations) and relations (src, dst, rel_type) of the loaded documents."""
    title, chunks, marks = F.col("title"), F.col("chunks"), F.col("highlights")
    hub, none = F.concat(title, F.lit("__index")), F.array().cast("array<string>")

    def entry(place: Column) -> Column:
        return F.concat(title, F.lit("__idx_"), place.cast("string"))

    def entity(name: Column, kind: str, found: Column) -> Column:
        return F.struct(name.alias("name"), F.lit(kind).alias("entity_type"), found.alias("observations"))

    def both(a: Column, there: str, b: Column, back: str) -> Column:
        return F.array(F.struct(a.alias("src"), b.alias("dst"), F.lit(there).alias("rel_type")), F.struct(b.alias("src"), a.alias("dst"), F.lit(back).alias("rel_type")))

    entities = F.concat(
        F.array(entity(title, "Document", none)),
        F.transform(chunks, lambda c: entity(c["chunk_id"], "TextChunk", c["observations"])),
        F.transform(marks, lambda m, i: entity(entry(i), "DocumentIndex", F.array(m["phrase"]))),
        F.array(entity(hub, "DocumentIndex", none)),
    )
    last = F.size(chunks) - 1
    relations = F.flatten(
        F.concat(
            F.transform(F.slice(chunks, 1, 1), lambda c: both(title, "starts_with", c["chunk_id"], "belongs_to")),
            F.transform(F.filter(chunks, lambda c, i: (i > 0) & (i == last)), lambda c: both(title, "ends_with", c["chunk_id"], "belongs_to")),
            F.transform(F.filter(chunks, lambda c, i: i < last), lambda c, i: both(c["chunk_id"], "follows", F.get(chunks, i + 1)["chunk_id"], "preceded_by")),
            F.array(both(title, "has_index", hub, "indexes")),
            F.transform(marks, lambda m, i: both(hub, "contains", entry(i), "contained_in")),
            F.transform(marks, lambda m, i: both(entry(i), "highlights", m["chunk_id"], "highlighted_by")),
        )
    )
    return loaded.select(F.explode(entities).alias("e")).select("e.*"), loaded.select(F.explode(relations).alias("r")).select("r.*")


def load_documents(docs: DataFrame, corpus: DataFrame, top: int = TOP, steps: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs (doc_id, title, text) and the strings (text) of the graph before the load -> entities, relations, and stats by document.

    One run loads any number of documents; frequencies come from the same corpus for all of them.
    """
    from weftgraph.plans.lineage import written

    rows = docs.select("doc_id", "title", "text", F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    rows = written(textrank.loaded(rows, document_frequencies(corpus), corpus.count(), top, steps))
    entities, relations = document_graph(rows)
    number = lambda c: F.size(c).cast("long").alias(c)
    return entities, relations, rows.select("doc_id", "chars", "words", "unique_words", number("chunks"), "sentences", number("highlights"))
