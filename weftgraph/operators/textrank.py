"""TextRank of whole documents: a document's rounds are worked out where its text is, so that the number of rounds costs no jobs and no shuffles.

Words come from lower-cased, normalised text, as in `text`; only the corpus frequencies of words travel between documents.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.schema import MAX_LENGTH, MAX_OBSERVATIONS

#: Ranks are final when a round changes a document's scores by less than this in sum, or after so many rounds.
TOLERANCE, ROUNDS = 1e-6, 30000
#: Bytes of text whose ranks are worked out together; a longer text is by itself.
BLOCK = 1 << 20
#: Words counted together before their counts are handed on.
COUNTED = 500_000
#: Words, of so many bytes at most, whose frequencies each process holds: the most frequent ones. Those of all others come by joins.
COMMON, COMMON_BYTES = 500_000, 64
#: The white space of `normalised` beyond ASCII, in UTF-8; bytes.split() knows the rest.
WIDE = re.compile(rb"\xc2\xa0|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|\xef\xbb\xbf")


def words_of(raw: bytes) -> list[bytes]:
    return (raw if raw.isascii() else WIDE.sub(b" ", raw)).split()


def both_cases(text: Column) -> list[Column]:
    """The text's bytes, and those of its lower case where that isn't plain ASCII, for `lowered`."""
    return [text.cast("binary").alias("text"), F.when(F.octet_length(text) != F.length(text), F.lower(text).cast("binary")).alias("low")]


def lowered(raw: bytes, low: bytes | None) -> list[bytes]:
    return words_of(raw.lower() if low is None else low)


def document_frequencies(strings: DataFrame) -> DataFrame:
    """word, df: in how many rows of `text` a lower-cased word occurs."""

    def out(count: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()).cast(pa.string()), pa.array(list(count.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for b in batches:
            for raw, low in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                count.update(set(lowered(raw, low)))
                if len(count) >= COUNTED:
                    yield out(count)
                    count = Counter()
        yield out(count)

    counted = strings.filter("text IS NOT NULL").select(*both_cases(F.col("text"))).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("df"))


def _with_frequencies(docs: DataFrame, frequencies: DataFrame, *more: str) -> tuple[DataFrame, object]:
    """(doc_id, text, low, rare, more; the common words' frequencies as a broadcast dict): rare has the word and df of a document's other words that the corpus has."""
    from weftgraph.plans.lineage import written

    known = written(frequencies)
    total, least = 0, None
    levels = sorted((tuple(r) for r in known.filter(F.octet_length("word") <= COMMON_BYTES).groupBy("df").agg(F.count("*")).collect()), reverse=True)
    for df, n in levels:
        if total + n > COMMON:
            break
        total, least = total + n, df
    common = (F.col("df") >= (least if least is not None else math.inf)) & (F.octet_length("word") <= COMMON_BYTES)
    held = known.filter(common).toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(dict(zip(held.column("word").cast(pa.binary()).to_pylist(), held.column("df").to_pylist(), strict=True)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *both_cases(F.coalesce(F.col("text"), F.lit(""))), *more)
    others = known.filter(~common)
    if others.isEmpty():
        return rows.withColumn("rare", F.lit(None).cast("array<struct<word: string, df: long>>")), shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[w for w in set(lowered(raw, low)) if w not in shared.value] for raw, low in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            owner = b.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found])))
            yield pa.RecordBatch.from_arrays([owner, pa.array([w for x in found for w in x], pa.binary()).cast(pa.string())], ["doc_id", "word"])

    pairs = rows.select("doc_id", "text", "low").mapInArrow(run, "doc_id long, word string").join(others, "word")
    rare = pairs.groupBy("doc_id").agg(F.collect_list(F.struct("word", "df")).alias("rare"))  # at most a document's words
    return rows.join(rare, "doc_id", "left"), shared


class Block:
    """The words of several texts, those of each text numbered apart: `distinct` words of all texts in a row, and by place `code`, the word's number, and `owner`, its text."""

    def __init__(self, texts: list[list[bytes]]):
        self.n, self.distinct, codes = len(texts), [], []
        self.size = np.zeros(len(texts), np.int64)  # distinct words of each text
        for k, words in enumerate(texts):
            own = dict.fromkeys(words)
            number = dict(zip(own, range(len(self.distinct), len(self.distinct) + len(own)), strict=True))
            codes.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
            self.distinct += own
            self.size[k] = len(own)
        self.length = np.array([len(x) for x in codes], np.int64)
        self.code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(self.n), self.length)

    def sentences(self) -> None:
        """By place `sentence`, or -1 in sentences of under three words; by sentence `text_of`, `number` in its text, and its `first` and `last` place."""
        ends = np.fromiter((w[-1:] in (b".", b"?", b"!") for w in self.distinct), bool, len(self.distinct))
        opens = np.ones(len(self.code), bool)
        opens[1:] = ends[self.code[:-1]] | (self.owner[1:] != self.owner[:-1])
        piece = np.cumsum(opens) - 1
        first = np.flatnonzero(opens)
        size = np.diff(np.r_[first, len(self.code)])
        long = size >= 3
        self.sentence = np.where(long, np.cumsum(long) - 1, -1)[piece] if len(piece) else piece
        self.first, self.last = first[long], (first + size - 1)[long]
        self.text_of = self.owner[self.first]
        self.count = np.bincount(self.text_of, minlength=self.n)
        self.number = np.arange(len(self.first)) - (np.cumsum(self.count) - self.count)[self.text_of]

    def weights(self, common: dict[bytes, int], rare: list[list[dict] | None], corpus: int) -> np.ndarray:
        """tf * idf of each distinct word; idf = ln(N / (1 + df)) + 1 over the corpus."""
        df = np.fromiter((common.get(w, 0) for w in self.distinct), np.float64, len(self.distinct))
        at = 0
        for n, found in zip(self.size.tolist(), rare, strict=True):
            if found:
                other = {x["word"].encode(): x["df"] for x in found}
                df[at : at + n] = [other.get(w, have) for w, have in zip(self.distinct[at : at + n], df[at : at + n].tolist(), strict=True)]
            at += n
        return np.bincount(self.code, minlength=len(self.distinct)) * (np.log(corpus / (1 + df)) + 1)


def settled(owner: np.ndarray, texts: int, entries: tuple, entry_owner: np.ndarray, moved: Callable, steps: int | None, damping: float, tolerance: float) -> np.ndarray:
    """Scores of items, by rounds of s = (1 - d) / n + d * moved(s, *entries) within each text: `steps` rounds, or till the text's own scores change by less than the tolerance."""
    n = np.bincount(owner, minlength=texts)[owner]
    score, live, active = 1 / n, np.ones(texts, bool), len(entry_owner)
    for _ in range(ROUNDS if steps is None else steps):
        new = (1 - damping) / n + damping * moved(score, *entries)
        change = np.bincount(owner, np.abs(new - score), texts)
        score = np.where(live[owner], new, score)
        if steps is None:
            live &= change >= tolerance
            if not live.any():
                break
            use = live[entry_owner]
            if (left := np.count_nonzero(use)) < active / 2:  # settled texts are left out of the rounds to come
                entries, entry_owner, active = tuple(x[use] for x in entries), entry_owner[use], left
    return score


def sentence_scores(block: Block, weight: np.ndarray | None, steps: int | None = None, damping: float = 0.85, tolerance: float = TOLERANCE) -> np.ndarray:
    """The score of each sentence of the block; similarity is the cosine of weights of the words, without a row for each pair of sentences. No weights: all alike."""
    sentences, w = len(block.first), len(block.distinct)
    s = word = np.zeros(0, np.int64)
    b, r = np.zeros(0), np.ones(sentences)
    if weight is not None and sentences:
        key = np.unique((block.sentence * w + block.code)[block.sentence >= 0])
        s, word = key // w, key % w
        norm = np.sqrt(np.bincount(s, weight[word] ** 2, sentences))
        use = norm[s] > 0
        s, word = s[use], word[use]
        b = weight[word] / norm[s]
        m = np.bincount(s, b * (np.bincount(word, b, w)[word] - b), sentences)  # a word of one sentence gives zero exactly
        use = m[s] > 0
        s, word, b, r = s[use], word[use], b[use], np.where(m > 0, m, 1.0)

    def moved(score: np.ndarray, s: np.ndarray, word: np.ndarray, b: np.ndarray) -> np.ndarray:
        q = b * (score / r)[s]
        return np.bincount(s, b * (np.bincount(word, q, w)[word] - q), sentences)

    return settled(block.text_of, block.n, (s, word, b), block.text_of[s], moved, steps, damping, tolerance)


def word_scores(block: Block, window: int = 5, steps: int | None = None, damping: float = 0.85, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the words that stand near another one, their scores); similarity is how often two words stand within a window."""
    w, keys = len(block.distinct), []
    for k in range(1, window):
        a, b = block.code[:-k], block.code[k:]
        use = (block.owner[:-k] == block.owner[k:]) & (a != b)
        keys.append(np.minimum(a, b)[use] * w + np.maximum(a, b)[use])
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    here, there, count = np.r_[key // max(w, 1), key % max(w, 1)], np.r_[key % max(w, 1), key // max(w, 1)], np.r_[count, count].astype(np.float64)
    sums = np.bincount(here, count, w)
    found = np.flatnonzero(sums > 0)
    item = np.cumsum(sums > 0) - 1
    here, there, r = item[here], item[there], sums[found]
    owner = np.repeat(np.arange(block.n), block.size)[found]

    def moved(score: np.ndarray, here: np.ndarray, there: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.bincount(there, count * (score / r)[here], len(found))

    return found, settled(owner, block.n, (here, there, count), owner[here], moved, steps, damping, tolerance)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the batches of about BLOCK bytes of their column `text`."""
    for b in batches:
        sizes, start, held = pc.binary_length(b.column("text")).to_pylist(), 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > BLOCK:
                yield b.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < b.num_rows:
            yield b.slice(start)


def _lists(b: pa.RecordBatch, *names: str) -> list[list]:
    return [b.column(n).to_pylist() for n in names]


def rank_sentences(docs: DataFrame, frequencies: DataFrame, corpus: int, steps: int | None = None) -> DataFrame:
    """doc_id, sentence, score of the sentences of docs (doc_id, text), given in how many of the corpus's texts a word occurs."""
    rows, shared = _with_frequencies(docs, frequencies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            text, low, rare = _lists(b, "text", "low", "rare")
            block = Block([lowered(*x) for x in zip(text, low, strict=True)])
            block.sentences()
            score = sentence_scores(block, block.weights(shared.value, rare, corpus) if corpus else None, steps)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(block.text_of)), pa.array(block.number.astype(np.int32)), pa.array(score)], ["doc_id", "sentence", "score"])

    return rows.mapInArrow(run, "doc_id long, sentence int, score double")


def rank_words(docs: DataFrame, steps: int | None = None) -> DataFrame:
    """doc_id, word, score of the words of docs (doc_id, text) that stand near another one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            block = Block([lowered(*x) for x in zip(*_lists(b, "text", "low"), strict=True)])
            found, score = word_scores(block, steps=steps)
            owner = np.repeat(np.arange(block.n), block.size)[found]
            word = pa.array(block.distinct, pa.binary()).cast(pa.string()).take(pa.array(found))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(owner)), word, pa.array(score)], ["doc_id", "word", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *both_cases(F.coalesce(F.col("text"), F.lit(""))))
    return rows.mapInArrow(run, "doc_id long, word string, score double")


def rounded(score: np.ndarray) -> np.ndarray:
    """Scores in units of 1e-9, halves up as Spark rounds what a double prints: nearer scores are ties."""
    at = score * 1e9
    out = np.floor(at + 0.5)
    for i in np.flatnonzero(np.abs(at - np.floor(at) - 0.5) < 1e-4).tolist():
        out[i] = float(Decimal(repr(float(score[i]))).scaleb(9).quantize(Decimal(1), ROUND_HALF_UP))
    return out


LOADED = """doc_id long, words long, unique_words long, sentences long, chunks array<struct<chunk_id: string, observations: array<string>>>,
    highlights array<struct<sentence: int, chunk_id: string, phrase: string>>"""


def _nested(lists: list[list], kinds: list[pa.DataType], names: list[str]) -> pa.Array:
    """Lists of tuples as an array of lists of structs."""
    flat = [x for found in lists for x in found]
    columns = [pa.array([x[i] for x in flat], kind) for i, kind in enumerate(kinds)]
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in lists], dtype=np.int64)].astype(np.int32)), pa.StructArray.from_arrays(columns, names))


def loaded(docs: DataFrame, frequencies: DataFrame, corpus: int, top: int, steps: int | None = None, parts: bool = True) -> DataFrame:
    """A row for each row of docs (doc_id, text, any others): its counts, its chunks in order (none if not `parts`), and the best sentences, the best one of each chunk, best first.

    Chunks are neighbouring pieces in pairs, as `text.chunks` makes them; their ids are made of the content.
    """
    from weftgraph.operators.text import wrap

    more = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows, shared = _with_frequencies(docs, frequencies, *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            ids, raw, low, rare = _lists(b, "doc_id", "text", "low", "rare")
            block = Block([lowered(*x) for x in zip(raw, low, strict=True)])
            block.sentences()
            score = sentence_scores(block, block.weights(shared.value, rare, corpus) if corpus else None, steps)
            order = np.lexsort((block.number, -rounded(score), block.text_of))
            at = 0
            place = np.cumsum(block.count) - block.count
            begins = (np.cumsum(block.length) - block.length).tolist()
            all_chunks, all_marks = [], []
            for k, (doc, text) in enumerate(zip(ids, raw, strict=True)):
                t = b" ".join(words_of(text)).decode()
                pieces = wrap(t)
                pairs = [pieces[i : i + MAX_OBSERVATIONS] for i in range(0, len(pieces), MAX_OBSERVATIONS)]
                named = lambda i, doc=doc, pairs=pairs: hashlib.sha256("\x00".join([str(doc), str(i), *(o for o, _ in pairs[i])]).encode()).hexdigest()[:24]
                all_chunks.append([(named(i), [o for o, _ in p]) for i, p in enumerate(pairs)] if parts else [])
                marks, seen = [], set()
                if block.count[k]:
                    starts = [p[0][1] for p in pairs]
                    length = np.fromiter(map(len, t.split(" ")), np.int64, int(block.length[k]))
                    end = np.cumsum(length + 1) - 1
                    for s in order[place[k] : place[k] + min(top, block.count[k])].tolist():
                        first, last = int(block.first[s]) - begins[k], int(block.last[s]) - begins[k]
                        begin = int(end[first] - length[first])
                        i = bisect_right(starts, begin) - 1  # a sentence starts at a letter, and all of them are in pieces
                        if i in seen:
                            continue
                        seen.add(i)
                        phrase = t[begin : int(end[last])]
                        marks.append((int(block.number[s]), all_chunks[-1][i][0] if parts else named(i), phrase if len(phrase) <= MAX_LENGTH else phrase[: MAX_LENGTH - 3] + "..."))
                all_marks.append(marks)
            chunks = _nested(all_chunks, [pa.string(), pa.list_(pa.string())], ["chunk_id", "observations"])
            marks = _nested(all_marks, [pa.int32(), pa.string(), pa.string()], ["sentence", "chunk_id", "phrase"])
            counts = [pa.array(x.astype(np.int64)) for x in (block.length, block.size, block.count)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, chunks, marks, *(b.column(c) for c in more)], ["doc_id", "words", "unique_words", "sentences", "chunks", "highlights", *more])

    kinds = dict(docs.dtypes)
    return rows.mapInArrow(run, ", ".join([LOADED, *(f"`{c}` {kinds[c]}" for c in more)]))
