"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A passage is a run of about WINDOW words, a whole text if it is no longer; it is the bag of the character n-grams of
all its words, '<' and '>' marking word borders. The n-grams are hashed to rows of an embedding table; their average
over the passage goes through a linear softmax, and both are trained jointly in numpy (Adagrad on shuffled minibatches).
Labels are those of whole texts: in training a text's probability is one less the product of its passages' clean
probabilities, so the gradient finds the passages that matter. A text scores as its most toxic passage, so that one in a long
text isn't averaged away. A misspelt or inflected word that training never saw shares most of its n-grams, and so
its vectors, with those it did see.

N-grams whose share of texts doesn't differ between the labels beyond chance, twofold at least, stay at the zero vector; they count in the average.
The model is fitted on a bounded sample of labelled rows; every text is scored whole. As the
head is linear, embedding times head is one number per n-gram, which is all that scoring needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import blocks, flat, slices, word_starts
from .tables import fold, forget, texts, written
from .words import IN_WORD, Shingled, folded

#: Bounds of the training sample: rows of each label, and bytes of a text, counted from its start.
SAMPLE, SAMPLE_BYTES = 1500, 6000
WINDOW, GRAMS, BUCKETS, DIM, EPOCHS, RATE, BATCH = 256, (3, 4, 5), 1 << 18, 8, 30, 0.5, 16
#: The chi-square of an n-gram by label, and the ratio of its shares, from which it gets a vector; the factor of the average; the weight of a toxic text.
CHANCE, RATIO, SCALE, WEIGHT = 20.0, 2.0, 100.0, 3.0
THRESHOLD = 0.7
#: Bytes that are worked on at once.
BLOCK = 1 << 20


def grams(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, the word of each, and the row of each word."""
    none = np.zeros(0, np.int32)
    word = IN_WORD[data]
    if not word.any():
        return none, none, none
    first = word_starts(word, borders)
    last = word & np.r_[first[1:] | ~word[1:], True]
    rows = np.repeat(np.arange(len(borders) - 1, dtype=np.int32), np.diff(borders))[first]
    # one '<' before and one '>' after each word, separators out
    width = word.astype(np.int8) + first + last
    at = np.cumsum(width, dtype=np.int64) - width
    marked = np.empty(int(at[-1]) + int(width[-1]), np.uint8)
    marked[(at + first)[word]] = folded(data)[word]
    marked[at[first]] = ord("<")
    marked[(at + 1 + first)[last]] = ord(">")
    number = np.cumsum(marked == ord("<"), dtype=np.int32) - 1
    rolled, found, whose = marked.astype(np.uint64), [none], [none]
    for n in range(2, max(GRAMS) + 1):
        if len(marked) < n:
            break
        rolled = rolled[:-1] * np.uint64(0x100000001B3) + marked[n - 1 :]
        if n in GRAMS:
            inside = np.flatnonzero(number[n - 1 :] == number[: len(number) - n + 1])
            h = (rolled[inside] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS.bit_length() + 1)
            found.append(h.astype(np.int32))
            whose.append(number[inside])
    return np.concatenate(found), np.concatenate(whose), rows


def passages(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The passage of each word, and the row of each passage, from the row of each word: WINDOW words each, the last one up to half more or less."""
    if not len(rows):
        return rows, rows
    opening = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    n = np.diff(np.r_[opening, len(rows)])
    index = np.arange(len(rows)) - np.repeat(opening, n)
    part = np.minimum(index // WINDOW, np.repeat(np.maximum((n + WINDOW // 2) // WINDOW, 1) - 1, n))
    new = np.r_[True, (rows[1:] != rows[:-1]) | (part[1:] != part[:-1])]
    return np.cumsum(new) - 1, rows[new]


@dataclass
class ToxicModel:
    weights: np.ndarray  # one number per bucket: embedding times (toxic - clean) head
    bias: float

    def scores(self, data: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """The probability of each row's most toxic passage; a row without words is a passage of nothing."""
        worst = np.full(len(borders) - 1, self.bias)
        if len(borders) == 2 and len(data) > BLOCK:
            worst[0] = self._long(data)
            return 1 / (1 + np.exp(-worst))
        ids, whose, rows = grams(data, borders)
        if len(rows):
            of, rows = passages(rows)
            n = np.bincount(of[whose], minlength=len(rows))
            z = np.bincount(of[whose], self.weights[ids], len(rows)) / np.maximum(n, 1) + self.bias
            worst[np.unique(rows)] = np.maximum.reduceat(z, np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]))
        return 1 / (1 + np.exp(-worst))

    def _long(self, data: np.ndarray) -> float:
        """The log odds of the most toxic passage of one text, in pieces of a block: sums and counts per passage add up."""
        total, count, before = np.zeros(1), np.zeros(1, np.int64), 0
        for a, b in slices(data, IN_WORD, BLOCK):
            ids, whose, rows = grams(data[a:b], np.array([0, b - a]))
            part = (before + np.arange(len(rows))) // WINDOW
            before += len(rows)
            size = max(1, -(-before // WINDOW))
            more = np.zeros(size), np.zeros(size, np.int64)
            more[0][: len(total)], more[1][: len(count)] = total, count
            if len(ids):
                total, count = more[0] + np.bincount(part[whose], self.weights[ids], size), more[1] + np.bincount(part[whose], minlength=size)
        parts = max(1, (before + WINDOW // 2) // WINDOW)
        if len(total) > parts:  # a short end belongs to the passage before it
            total[parts - 1], count[parts - 1] = total[parts - 1] + total[parts], count[parts - 1] + count[parts]
        return float((total[:parts] / np.maximum(count[:parts], 1)).max() + self.bias)


def _stretches(borders: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of about a block of bytes: (first, end)."""
    first = 0
    while first < len(borders) - 1:
        end = max(first + 1, int(np.searchsorted(borders, borders[first] + BLOCK, "right")) - 1)
        yield first, end
        first = end


def _telling(data: np.ndarray, borders: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The buckets whose share of texts differs by label: chi-square with continuity correction, and a ratio of the shares."""
    with_it = np.zeros((2, BUCKETS))
    for first, end in _stretches(borders):
        ids, whose, rows = grams(data[borders[first] : borders[end]], borders[first : end + 1] - borders[first])
        pairs = np.unique(rows[whose].astype(np.int64) * BUCKETS + ids)
        own = labels[first:end][pairs // BUCKETS]
        for k in (0, 1):
            with_it[k] += np.bincount(pairs[own == k] % BUCKETS, minlength=BUCKETS)
    n = np.bincount(labels, minlength=2).astype(float)
    without = n[:, None] - with_it
    gap = np.maximum(np.abs(with_it[1] * without[0] - with_it[0] * without[1]) - n.sum() / 2, 0)
    sure = n.sum() * gap**2 >= CHANCE * np.maximum(with_it.sum(axis=0) * without.sum(axis=0), 1) * n.prod()
    share = (with_it + 0.5) / (n[:, None] + 1)
    return np.flatnonzero(sure & (share.max(axis=0) >= RATIO * share.min(axis=0)))


def _cells(data: np.ndarray, borders: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Passage, n-gram (place in used) and share of the passage of each n-gram that has a vector, and the row of each passage."""
    place = np.full(BUCKETS, -1)
    place[used] = np.arange(len(used))
    whose, gram, share, of_rows, count = [], [], [], [], 0
    for first, end in _stretches(borders):
        ids, word, rows = grams(data[borders[first] : borders[end]], borders[first : end + 1] - borders[first])
        of, rows = passages(rows)
        passage = of[word]
        size = np.maximum(np.bincount(passage, minlength=len(rows)), 1)
        known = place[ids] >= 0
        cell, times = np.unique(passage[known].astype(np.int64) * max(len(used), 1) + place[ids[known]], return_counts=True)
        whose.append(cell // max(len(used), 1) + count)
        gram.append(cell % max(len(used), 1))
        share.append((SCALE * times / size[whose[-1] - count]).astype(np.float32))
        of_rows.append(rows + first)
        count += len(rows)
    return np.concatenate(whose), np.concatenate(gram), np.concatenate(share), np.concatenate(of_rows)


def distinct(data: np.ndarray, borders: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The rows without copies and most near copies of earlier ones of their label: those that share two of four MinHash values of five-word shingles."""
    words = Shingled.of(data, borders)
    rng, seen, kept = np.random.default_rng(3), set(), []
    functions = rng.integers(1, 1 << 62, 4, np.uint64) * np.uint64(2) + np.uint64(1)
    for i, label in enumerate(labels.tolist()):
        shingle = words.shingle[words.borders[i] : words.borders[i + 1]]
        shingle = shingle[shingle > 0]
        if len(shingle):
            least = [int(((shingle * f) >> np.uint64(16)).min()) for f in functions]
            keys = {(label, *least[:2]), (label, *least[2:], None)}
        else:
            keys = {(label, data[borders[i] : borders[i + 1]].tobytes())}
        if not keys & seen:
            kept.append(i)
        seen |= keys
    return np.array(kept, np.int64)


def train(data: np.ndarray, borders: np.ndarray, labels: np.ndarray, seed: int = 7) -> ToxicModel:
    """Embedding table and softmax head, learned together from whole texts and their labels."""
    rng = np.random.default_rng(seed)
    if len(set(labels.tolist())) < 2:
        share = float(np.clip(labels.mean() if len(labels) else 0.0, 0.01, 0.5))
        return ToxicModel(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    used = _telling(data, borders, labels)
    whose, gram, share, rows = _cells(data, borders, used)
    ends = np.searchsorted(whose, np.arange(len(rows) + 1))
    first = np.searchsorted(rows, np.arange(len(labels) + 1))  # passage of each text
    table, head = rng.normal(0, 0.05, (len(used), DIM)).astype(np.float32), rng.normal(0, 1, (DIM, 2)).astype(np.float32)
    bias = np.array([1.0, -1.0], np.float32)
    seen_t, seen_h, seen_b = np.full(len(used), 1e-3, np.float32), np.full((DIM, 2), 1e-2, np.float32), np.full(2, 1.0, np.float32)
    full = np.flatnonzero(np.diff(first))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS) + 0.01
        turn = rng.permutation(full)
        for k in range(0, len(turn), BATCH):
            chosen = turn[k : k + BATCH]
            parts = np.concatenate([np.arange(first[i], first[i + 1]) for i in chosen])
            text = np.repeat(np.arange(len(chosen)), first[chosen + 1] - first[chosen])
            at = np.concatenate([np.arange(ends[p], ends[p + 1]) for p in parts])
            where, weight, vectors = np.repeat(np.arange(len(parts)), ends[parts + 1] - ends[parts]), share[at], table[gram[at]]
            mean = np.stack([np.bincount(where, vectors[:, j] * weight, len(parts)) for j in range(DIM)], axis=1)
            z = mean @ head + bias
            p = 1 / (1 + np.exp(z[:, 0] - z[:, 1]))  # softmax of two classes
            clean = np.exp(-np.bincount(text, np.logaddexp(0, z[:, 1] - z[:, 0])))
            pull = np.where(labels[chosen] == 1, -WEIGHT * clean / np.maximum(1 - clean, 1e-6), 1.0)
            side = p * pull[text] / len(chosen)
            back = np.stack([-side, side], axis=1)
            moved = np.bincount(gram[at], side[where] * weight, len(used))
            some = np.flatnonzero(moved)
            grad = (moved[some, None] * (head[:, 1] - head[:, 0])[None]).astype(np.float32)
            seen_t[some] += (grad**2).mean(axis=1)
            table[some] -= rate * grad / np.sqrt(seen_t[some])[:, None]
            g = mean.T @ back
            seen_h += g**2
            head -= 0.3 * rate * g / np.sqrt(seen_h)
            g = back.sum(axis=0)
            seen_b += g**2
            bias -= 0.3 * rate * g / np.sqrt(seen_b)
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = SCALE * (table @ (head[:, 1] - head[:, 0]))
    return ToxicModel(weights, float(bias[1] - bias[0]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> ToxicModel:
    """Learn from at most `sample` labelled rows of each label that aren't held out, the first sample_bytes bytes of each.

    The rows are those with the smallest hash of doc_id, so both the rows sent to the driver and their size are bounded; copies and near copies teach once.
    Null labels, ids and texts, and empty texts, teach nothing. With fewer than two labels every text gets one score.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(fold("doc_id") != 1)
    # chosen among the labels alone, so that no text is shuffled; some may have no text
    ordered = lambda df, toxic, n: df.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = ordered(known, 1, 2 * sample).unionByName(ordered(known, 0, 2 * sample)).distinct()
    able = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.substring(F.col("text").cast("binary"), 1, sample_bytes).alias("text")).filter(F.octet_length("text") > 0)
    # at most 4 * sample rows of two numbers travel; the documents are read once
    rows = written(able.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(8 * sample))
    found = ordered(rows, 1, sample).unionByName(ordered(rows, 0, sample)).select("toxic", "text").toArrow()
    forget(rows)
    found = found.take(pa.array(distinct(*flat(found.column("text")), found.column("toxic").to_numpy())))
    return train(*flat(found.column("text")), found.column("toxic").to_numpy().astype(np.int64))


def score_toxicity(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 where score >= threshold): one row per input row.

    Null and empty texts, and texts without a word, get the score of the bias alone. Repeated rows return repeated rows; equal texts
    score alike. A very long text is scored whole, in pieces. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in blocks(whole, 2, BLOCK):
                score = model.scores(*flat(b.column(2)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(fold(id_col) == 1, F.lit(False)).alias("held_out")
    return texts(docs, F.col(id_col).cast("long").alias("doc_id"), held, text_col=text_col).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns as they are, whose score is under the threshold; no shuffle.

    Rows with a null or empty text stay where the bias alone is under the threshold; repeated rows stay or go together.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in blocks(whole, at, BLOCK):
                yield b.filter(pa.array(model.scores(*flat(b.column(at))) < threshold))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's score by a model that learns from the labelled ones outside the held-out third."""
    return score_toxicity(docs, fit_toxicity(docs, labels))
