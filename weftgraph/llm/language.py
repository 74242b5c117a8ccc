"""Language identification with a linear-chain conditional random field over words.

Each word has hashed features: character n-grams of the word between border marks (those with a mark are its
affixes) and the log odds of a small lexicon of frequent words. Feature weights and the transitions
between languages are learned together by forward-backward on sequences that switch between documents
of different languages, as code-switched text does. A document's languages are the mean posterior of its words.

The model is fitted on a bounded sample of documents of every language; every text is labelled whole. Long texts are cut into
segments whose transfer matrices are chained, which gives the same posteriors as one pass over the text. Texts over a block are
worked on block by block in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import blocks, flat, slices, word_starts
from .tables import fold, texts
from .words import folded

#: Bounds of the training sample: documents of each language and of all together, bytes of a text, counted from its start; words of a language's lexicon.
SAMPLE, ROWS, SAMPLE_BYTES, LEXICON = 300, 12_000, 4000, 3000
#: Buckets of n-grams at most and at least, and numbers in the table of buckets by language.
BUCKETS, LEAST_BUCKETS, TABLE = 1 << 17, 1 << 12, 1 << 23
GRAMS, EPOCHS, RATE, BATCH, STEPS = (2, 3, 4), 3, 0.4, 32, 32
#: Words of a stretch of one language in training sequences, shortest and longest; words of a segment.
STRETCH, SEGMENT = (3, 24), 256
UNKNOWN = "und"
#: Bytes that are worked on at once.
BLOCK = 1 << 20

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_POWERS = np.random.default_rng(11).integers(1, 1 << 62, 1024, np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass
class Words:
    """The words of a block of rows: hash of each, row borders among them, first byte and end; and the bytes of the distinct ones between marks."""

    borders: np.ndarray
    which: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    marked: np.ndarray
    number: np.ndarray

    @staticmethod
    def of(data: np.ndarray, borders: np.ndarray) -> Words:
        none = np.zeros(0, np.int64)
        letter = LETTER[data]
        if not letter.any():
            return Words(np.zeros(len(borders), np.int64), none, none, none, none.astype(np.uint64), none.astype(np.uint8), none)
        first = word_starts(letter, borders)
        flat_letters = folded(data)[letter]
        starts = np.flatnonzero(first[letter])
        sizes = np.diff(np.r_[starts, len(flat_letters)])
        position = np.arange(len(flat_letters)) - np.repeat(starts, sizes)
        h = np.add.reduceat((flat_letters.astype(np.uint64) + np.uint64(1)) * _POWERS[position & 1023], starts)
        per_row = np.r_[0, np.cumsum(first)][borders]
        hashes, at, which = np.unique(h, return_index=True, return_inverse=True)
        n = sizes[at]
        ends = np.cumsum(n + 2)
        marked = np.full(int(ends[-1]), ord("<"), np.uint8)
        marked[ends - 1] = ord(">")
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        marked[inside + np.repeat(ends - n - 1, n)] = flat_letters[inside + np.repeat(starts[at], n)]
        start = np.flatnonzero(first)
        return Words(per_row, which, start, start + sizes, hashes, marked, np.repeat(np.arange(len(n), dtype=np.int32), n + 2))

    def features(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets (a power of two) of the n-grams of the distinct words, and the word of each."""
        rolled, ids, whose = self.marked.astype(np.uint64), [], []
        for n in range(2, max(GRAMS) + 1):
            rolled = rolled[:-1] * np.uint64(0x100000001B3) + self.marked[n - 1 :]
            if n in GRAMS:
                inside = np.flatnonzero(self.number[n - 1 :] == self.number[: len(self.number) - n + 1])
                ids.append(((rolled[inside] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int32))
                whose.append(self.number[inside])
        return np.concatenate(ids), np.concatenate(whose)


@dataclass
class LanguageModel:
    labels: list[str]
    weights: np.ndarray  # bucket x label
    moves: np.ndarray  # label x label: log transition weights
    lexicon: np.ndarray  # word hashes in order
    odds: np.ndarray  # word x label
    trust: float  # weight of the lexicon

    def emissions(self, words: Words) -> np.ndarray:
        """Log weights of the labels for each distinct word."""
        ids, whose = words.features(len(self.weights))
        n = len(words.hashes)
        out = np.stack([np.bincount(whose, self.weights[ids, k], n) for k in range(len(self.labels))], axis=1)
        return out + self.trust * self.known(words.hashes)

    def known(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros((len(hashes), len(self.labels)))
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return np.where((self.lexicon[at] == hashes)[:, None], self.odds[at], 0.0)

    def weight(self, words: Words) -> np.ndarray:
        """Weights of the labels for each word in turn."""
        e = self.emissions(words)
        return np.exp(np.maximum(e - e.max(axis=1, keepdims=True), -60))[words.which]

    def marked(self, data: np.ndarray, borders: np.ndarray) -> Iterator[tuple[int, Words, np.ndarray]]:
        """(first byte, words, posterior of each word's labels) of each piece: all rows at once, or a long row block by block."""
        moves = np.exp(self.moves)
        if len(borders) != 2 or len(data) <= BLOCK:
            words = Words.of(data, borders)
            if len(words.which) and self.labels:
                yield 0, words, marginals(self.weight(words), words.borders, moves)
            return
        parts = [(a, b) for a, b in slices(data, LETTER, BLOCK) if LETTER[data[a:b]].any()]
        if not self.labels or not parts:
            return
        cut = lambda a, b: Words.of(data[a:b], np.array([0, b - a]))
        through = [chained(self.weight(cut(a, b)), moves) for a, b in parts]
        enter: list = [None]
        for t in through[:-1]:
            enter.append(_scaled((np.ones(len(moves)) if enter[-1] is None else enter[-1] @ moves) @ t))
        leave = [np.ones(len(moves))]
        for t in through[:0:-1]:
            leave.append(_scaled(moves @ (t @ leave[-1])))
        for (a, b), into, out in zip(parts, enter, leave[::-1], strict=True):
            words = cut(a, b)
            yield a, words, marginals(self.weight(words), words.borders, moves, enter_first=into, leave_last=out)

    def posteriors(self, data: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """Mean posterior of the labels over each row's words; zeros for a row without words."""
        out, count = np.zeros((len(borders) - 1, len(self.labels))), np.zeros(len(borders) - 1, np.int64)
        for _, words, mean in self.marked(data, borders):
            total = np.concatenate([np.zeros((1, mean.shape[1])), np.cumsum(mean, axis=0)])
            out += total[words.borders[1:]] - total[words.borders[:-1]]
            count += np.diff(words.borders)
        return out / np.maximum(count, 1)[:, None]

    def spans(self, data: np.ndarray, borders: np.ndarray) -> list[list]:
        """[row, first byte, end, label, mean posterior] of the runs of words of one label, bytes within the row."""
        out: list[list] = []
        for at, words, mean in self.marked(data, borders):
            row = np.repeat(np.arange(len(borders) - 1), np.diff(words.borders))
            label = mean.argmax(axis=1)
            first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (label[1:] != label[:-1])])
            sure = np.add.reduceat(mean[np.arange(len(mean)), label], first)
            size = np.diff(np.r_[first, len(row)])
            for k, n, s in zip(first.tolist(), size.tolist(), sure.tolist(), strict=True):
                r, start, end = int(row[k]), at + int(words.start[k]) - int(borders[row[k]]), at + int(words.end[k + n - 1]) - int(borders[row[k]])
                if out and out[-1][0] == r and out[-1][3] == label[k]:  # goes on over the end of a block
                    out[-1][2], out[-1][4], out[-1][5] = end, out[-1][4] + s, out[-1][5] + n
                else:
                    out.append([r, start, end, int(label[k]), s, n])
        return [[r, a, b, k, s / n] for r, a, b, k, s, n in out]


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def _transfers(weight: np.ndarray, start: np.ndarray, end: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """What each segment makes of what enters it, as a matrix up to a factor."""
    transfer = np.broadcast_to(np.eye(len(moves)), (len(start), len(moves), len(moves))).copy()
    for t in range(int((end - start).max())):
        on = np.flatnonzero(start + t < end)
        step = transfer[on] if t == 0 else transfer[on] @ moves
        step = step * weight[start[on] + t][:, None, :]
        transfer[on] = step / step.sum(axis=(1, 2), keepdims=True)
    return transfer


def chained(weight: np.ndarray, moves: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """The transfer matrix of a whole run of words."""
    start = np.arange(0, len(weight), segment)
    found = _transfers(weight, start, np.minimum(start + segment, len(weight)), moves)
    out = found[0]
    for t in found[1:]:
        out = out @ moves @ t
        out /= out.sum()
    return out


def marginals(weight: np.ndarray, borders: np.ndarray, moves: np.ndarray, segment: int = SEGMENT, enter_first: np.ndarray | None = None, leave_last: np.ndarray | None = None) -> np.ndarray:
    """Posterior of each word's labels by forward-backward within its row; weight: word x label, moves: label x label.

    enter_first, leave_last: what comes into the first word, before the move, and what lies beyond the last, if a single row is the middle of a longer one.
    """
    n = np.diff(borders)
    parts = -(-n // segment)
    start = np.repeat(borders[:-1] - segment * (np.cumsum(parts) - parts), parts) + segment * np.arange(int(parts.sum()))
    end = np.minimum(start + segment, np.repeat(borders[1:], parts))
    row_first = np.zeros(len(start), bool)
    row_first[(np.cumsum(parts) - parts)[parts > 0]] = True
    labels = weight.shape[1]
    # what enters each segment from the left (before the move into it) and from the right
    enter, leave = np.ones((len(start), labels)), np.ones((len(start), labels))
    if enter_first is not None:
        enter[0], row_first[0] = enter_first, False
    if leave_last is not None:
        leave[-1] = leave_last
    many = np.flatnonzero(np.repeat(parts, parts) > 1)
    if len(many):
        transfer = _transfers(weight, start[many], end[many], moves)
        opening = np.cumsum(parts) - parts  # the first segment of each row
        place = np.full(len(start), -1)
        place[many] = np.arange(len(many))
        for k in range(1, int(parts.max())):  # from left: k-th segment of all rows that have one
            g = (opening + k)[parts > k]
            into = np.where(row_first[g - 1][:, None], enter[g - 1], enter[g - 1] @ moves)
            enter[g] = _scaled(np.einsum("gi,gij->gj", into, transfer[place[g - 1]]))
        for k in range(1, int(parts.max())):  # from right
            g = (opening + parts - 1 - k)[parts > k]
            leave[g] = _scaled(np.einsum("ij,gj->gi", moves, np.einsum("gij,gj->gi", transfer[place[g + 1]], leave[g + 1])))
    order = np.argsort(start - end, kind="stable")  # longest first, so that those still going on are a prefix
    start, end, enter, leave, row_first = start[order], end[order], enter[order], leave[order], row_first[order]
    size = end - start
    forward, back = np.empty_like(weight), None
    state = np.where(row_first[:, None], 1.0, enter @ moves)
    longest = int(size[0]) if len(size) else 0
    going = np.searchsorted(-size, -np.arange(longest), "left")  # segments longer than t
    for t in range(longest):
        m = going[t]
        at = start[:m] + t
        state = (state[:m] if t == 0 else state[:m] @ moves) * weight[at]
        state /= state.sum(axis=1, keepdims=True)
        forward[at] = state
    back = leave
    for t in range(1, longest + 1):  # t-th word from the end of each segment
        m = going[t - 1]
        at = end[:m] - t
        if t > 1:
            back = _scaled((back[:m] * weight[at + 1]) @ moves.T)
        forward[at] *= back[:m]
    return _scaled(forward)


def train(words: Words, row_label: np.ndarray, labels: list[str], seed: int = 5) -> LanguageModel:
    """Weights, transitions and trust in the lexicon by stochastic gradient of the sequences' log likelihood."""
    rng = np.random.default_rng(seed)
    count = len(labels)
    word_label = np.repeat(row_label, np.diff(words.borders))
    seen = np.zeros((len(words.hashes), count))
    np.add.at(seen, (words.which, word_label), 1)
    buckets = max(LEAST_BUCKETS, min(BUCKETS, 1 << (TABLE // count).bit_length() - 1))
    often = np.unique(np.concatenate([np.argsort(-seen[:, k], kind="stable")[:LEXICON] for k in range(count)]))
    often = often[seen[often].sum(axis=1) >= 3]
    share = (seen[often] + 0.5) / (seen.sum(axis=0) + 0.5 * len(seen))
    odds = np.log(share) - np.log(share).mean(axis=1, keepdims=True)
    model = LanguageModel(labels, np.zeros((buckets, count), np.float32), np.zeros((count, count)), words.hashes[often], odds, 0.2)
    lex = model.known(words.hashes)
    ids, whose = words.features(buckets)
    order = np.argsort(whose, kind="stable")
    ids, first = ids[order], np.r_[0, np.cumsum(np.bincount(whose, minlength=len(words.hashes)))]
    seen_w, seen_m, seen_t = np.full((buckets, count), 1e-2, np.float32), np.full((count, count), 1.0), 1.0
    by = [np.flatnonzero((row_label == k) & (np.diff(words.borders) >= STRETCH[0])) for k in range(count)]
    usable = [k for k in range(count) if len(by[k])]
    steps = EPOCHS * len(words.which) // (BATCH * STEPS) if usable else 0
    for _ in range(steps):
        at, gold = np.zeros((BATCH, STEPS), np.int64), np.zeros((BATCH, STEPS), np.int64)
        for s in range(BATCH):
            filled = 0
            while filled < STEPS:
                k = usable[rng.integers(len(usable))]
                row = by[k][rng.integers(len(by[k]))]
                a, b = words.borders[row], words.borders[row + 1]
                n = min(int(rng.integers(STRETCH[0], STRETCH[1] + 1)), STEPS - filled, int(b - a))
                begin = int(rng.integers(a, b - n + 1))
                at[s, filled : filled + n] = words.which[begin : begin + n]
                gold[s, filled : filled + n] = k
                filled += n
        used, inverse = np.unique(at, return_inverse=True)
        sizes = first[used + 1] - first[used]
        grams = ids[np.repeat(first[used] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
        e = np.add.reduceat(model.weights[grams], np.cumsum(sizes) - sizes, axis=0) + model.trust * lex[used]
        weight = np.exp(np.maximum(e - e.max(axis=1, keepdims=True), -60))[inverse.reshape(BATCH, STEPS)]
        moves = np.exp(model.moves)
        ahead = np.empty((STEPS, BATCH, count))
        state = _scaled(weight[:, 0])
        for t in range(STEPS):
            if t:
                state = _scaled((state @ moves) * weight[:, t])
            ahead[t] = state
        back, post, pairs = np.ones((BATCH, count)), np.empty((BATCH, STEPS, count)), np.zeros((count, count))
        for t in range(STEPS - 1, -1, -1):
            post[:, t] = _scaled(ahead[t] * back)
            if t:
                right = weight[:, t] * back
                joint = ahead[t - 1][:, :, None] * moves[None] * right[:, None, :]
                pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                back = _scaled(right @ moves.T)
        np.subtract.at(pairs, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
        post[np.arange(BATCH)[:, None], np.arange(STEPS)[None], gold] -= 1
        by_word = np.zeros((len(used), count))
        np.add.at(by_word, inverse.ravel(), post.reshape(-1, count))
        some, where = np.unique(grams, return_inverse=True)
        owner = np.repeat(np.arange(len(used)), sizes)
        grad = np.stack([np.bincount(where, by_word[owner, k], len(some)) for k in range(count)], axis=1) / BATCH
        seen_w[some] += grad**2
        model.weights[some] -= RATE * grad / np.sqrt(seen_w[some])
        pairs /= BATCH
        seen_m += pairs**2
        model.moves -= RATE * pairs / np.sqrt(seen_m)
        slope = float((by_word * lex[used]).sum()) / BATCH
        seen_t += slope**2
        model.trust -= 0.1 * RATE * slope / np.sqrt(seen_t)
    model.moves -= model.moves.max()
    return model


def fit_language(docs: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, rows: int = ROWS) -> LanguageModel:
    """Learn from at most `sample` documents of each language that aren't held out, the first sample_bytes bytes of each.

    Every language that occurs is learned; with more than rows / sample of them each gives fewer documents, one at least, so that about 2 * rows
    come to the driver at most. The documents are those with the smallest hash. Rows with a null lang, or a null or empty text, teach nothing; without any the
    model has no language.
    """
    text = F.substring(F.col("text").cast("binary"), 1, sample_bytes).alias("text")
    able = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text)
    able = able.filter(F.col("lang").isNotNull() & (F.octet_length("text") > 0) & (fold("doc_id") != 1))
    # counts give the share of each language to take, by a hash, so that no language's rows meet in one task; a number a language
    counts = able.groupBy("lang").count().collect()
    each = max(1, min(sample, rows // max(1, len(counts))))
    span = 1 << 53
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(span, span * 2 * each // r["count"])) for r in counts], "lang string, share long")
    some = able.withColumn("place", F.xxhash64("doc_id", "text").bitwiseAND(span - 1)).join(F.broadcast(shares), "lang").filter("place < share")
    found = some.orderBy(F.col("place") / F.col("share"), "doc_id", "text").limit(2 * each * len(counts)).select("lang", "text").toArrow()
    kept, turn = [], {}
    for i, lang in enumerate(found.column("lang").to_pylist()):
        turn[lang] = turn.get(lang, 0) + 1
        if turn[lang] <= each:
            kept.append(i)
    found = found.take(pa.array(kept, pa.int64()))
    langs = np.array(found.column("lang").to_pylist(), object)
    if not len(langs):
        none = np.zeros(0)
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)), none.astype(np.uint64), np.zeros((0, 0)), 0.0)
    labels = sorted(set(langs.tolist()))
    return train(Words.of(*flat(found.column("text"))), np.searchsorted(labels, langs.tolist()), labels)


def label_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score (its mean posterior): one row per input row.

    `und` with score 0 where the text is null, empty or without a letter, or nothing was learned; of equal posteriors the first language by name.
    Repeated rows return repeated rows. A very long text is labelled whole, block by block. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in blocks(whole, 3, BLOCK):
                p = model.posteriors(*flat(b.column(3)))
                letters = b.column(2).to_numpy(zero_copy_only=False)
                best = p.argmax(axis=1) if len(model.labels) else np.zeros(len(p), int)
                sure = p.max(axis=1, initial=0.0)
                named = [model.labels[k] if ok and s > 0 else UNKNOWN for k, s, ok in zip(best, sure, letters, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(named, pa.string()), pa.array(np.where(letters, np.minimum(sure, 1.0), 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(fold(id_col) == 1, F.lit(False)).alias("held_out")
    letters = F.coalesce(F.col(text_col), F.lit("")).rlike(r"\p{L}").alias("letters")
    return texts(docs, F.col(id_col).cast("long").alias("doc_id"), held, letters, text_col=text_col).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def language_spans(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, end (code points of the text), lang, score (mean posterior): a row for each run of words labelled alike.

    Null and empty texts, and texts without a word, have no rows; repeated rows repeat theirs. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in blocks(whole, 1, BLOCK):
                data, borders = flat(b.column(1))
                found = model.spans(data, borders)
                if found:
                    points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]  # code points before each byte
                    row, first, end, label, score = (list(x) for x in zip(*found, strict=True))
                    at = [points[borders[row] + x] - points[borders[row]] for x in (first, end)]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(at[0], pa.int64()), pa.array(at[1], pa.int64()), pa.array([model.labels[k] for k in label]), pa.array(score)], ["doc_id", "start", "end", "lang", "score"])

    return texts(docs, F.col(id_col).cast("long").alias("doc_id"), text_col=text_col).mapInArrow(run, "doc_id long, start long, end long, lang string, score double")


def languages(docs: DataFrame) -> DataFrame:
    """Every document's language by a model that learns from those outside the held-out third."""
    return label_languages(docs, fit_language(docs))
