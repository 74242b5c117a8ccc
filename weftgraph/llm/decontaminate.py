"""Benchmark passages in documents, by q-gram lemma filtering and banded alignment.

A passage of m characters that occurs in a text with at most k edits shares at least
m + 1 - (k + 1) q of its character q-grams with the region where it occurs, and they lie within k
diagonals of each other. The filter finds a text's q-grams among those of the items,
counts them per item in diagonal bands of width 2 (k + 1) that overlap by half, and keeps the
bands that reach the bound; each kept region is verified by alignment within the band. Characters are code
points; case doesn't matter, and each run of characters that are neither letters nor digits is one space.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import blocks, flat
from .tables import texts
from .words import PLAIN

Q, EDITS = 8, 0.1
#: Characters of items that one pass over the documents takes; more items make more passes. Bytes and characters that are scanned at once.
ITEM_CHARS, BLOCK = 4 << 20, 1 << 20
#: Multipliers of q-grams and of their slots, and bits of the membership table.
STEP, MULTIPLIER, TABLE_BITS = 0xD1342543DE82EF95, 0x9E3779B97F4A7C15, 22
#: Ranges of code points over ASCII that are neither letters nor digits: Latin-1 signs, general and CJK punctuation, full-width signs.
SIGNS = [(0x80, 0xAA), (0xAB, 0xB5), (0xB6, 0xBA), (0xBB, 0xC0), (0xD7, 0xD8), (0xF7, 0xF8), (0x2000, 0x2070), (0x3000, 0x3040), (0xFF00, 0xFF10)]


def _letters() -> np.ndarray:
    """The lower case of each code point, as far as it is one code point; 32 for what is no letter or digit."""
    lower = ((i, chr(i).lower()) for i in range(1 << 17))
    out = np.array([ord(c) if len(c) == 1 else i for i, c in lower], np.uint32)
    out[:128][~PLAIN[:128]] = 32
    for a, b in SIGNS:
        out[a:b] = 32
    return out


LETTERS = _letters()


def points(data: np.ndarray) -> np.ndarray:
    """Code points of UTF-8 bytes; what is malformed is U+FFFD."""
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def _spaced(found: np.ndarray, after_word: bool) -> tuple[np.ndarray, np.ndarray]:
    """(letters, which to keep): letters and digits, and the first of each run of others after one of them."""
    out = np.where(found < len(LETTERS), LETTERS[np.minimum(found, len(LETTERS) - 1)], found).astype(np.uint32)
    word = out != 32
    return out, word | np.r_[after_word, word[:-1]]


def normalised(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of UTF-8 rows with one space for each run of others, none at the ends of a row; and the new row borders."""
    rows = len(borders) - 1
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
    if rows == 1:
        return _long(data)
    found = points(data)
    ends = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][borders]
    if ends[-1] != len(found):  # malformed: row by row
        each = [points(data[a:b]) for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)]
        found, ends = np.concatenate(each), np.r_[0, np.cumsum([len(x) for x in each])]
    out, keep = _spaced(found, False)
    opening = ends[:-1][ends[:-1] < len(found)]
    keep[opening] = out[opening] != 32
    total = np.r_[0, np.cumsum(keep)]
    out, ends = out[keep], total[ends]
    full = np.diff(ends) > 0
    last = ends[1:][full] - 1
    trail = np.zeros(len(out), bool)  # a gap at the end of a row goes
    trail[last[out[last] == 32]] = True
    gone = np.r_[0, np.cumsum(trail)]
    return out[~trail], ends - gone[ends]


def _long(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row, piece by piece."""
    parts, start, after = [], 0, False
    while start < len(data):
        end = min(start + BLOCK, len(data))
        while end < len(data) and end > start + 1 and data[end] & 0xC0 == 0x80:
            end -= 1
        out, keep = _spaced(points(data[start:end]), after)
        parts.append(out[keep])
        start, after = end, bool(out[-1] != 32)
    out = np.concatenate(parts)
    out = out[:-1] if len(out) and out[-1] == 32 else out
    return out, np.array([0, len(out)])


def keys(data: np.ndarray, q: int = Q) -> np.ndarray:
    """The q code points from each position as one hashed number."""
    if len(data) < q:
        return np.zeros(0, np.uint64)
    one, out, have = data.astype(np.uint64), data.astype(np.uint64), 1
    while have < q:
        step = have if 2 * have <= q else 1
        out = out[: len(out) - step] * np.uint64(pow(STEP, step, 1 << 64)) + (out[step:] if step == have else one[have:][: len(out) - step])
        have += step
    return out


def slot(key: np.ndarray) -> np.ndarray:
    return ((key * np.uint64(MULTIPLIER)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


@dataclass
class Items:
    """The benchmark texts of one pass: their q-grams sorted by key, and the bounds of each."""

    ids: list
    texts: list[np.ndarray]
    edits: np.ndarray
    bound: np.ndarray
    key: np.ndarray
    item: np.ndarray
    at: np.ndarray
    table: np.ndarray
    grams: list[np.ndarray]

    @staticmethod
    def of(ids: list, found: list[np.ndarray], edits: float, q: int = Q) -> Items:
        kept = [(i, t) for i, t in zip(ids, found, strict=True) if len(t)]
        sizes = np.array([len(t) for _, t in kept], np.int64)
        budget = np.floor(sizes * edits).astype(np.int64)
        most = np.maximum((sizes + 1 - 2) // q - 1, 0)  # the bound stays at two q-grams or more where there are that many
        budget = np.minimum(budget, most)
        found = [keys(t, q) for _, t in kept]
        key = np.concatenate([*found, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(kept)), [len(f) for f in found])
        at = np.concatenate([*(np.arange(len(f)) for f in found), np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(key, kind="stable")
        table = np.zeros(1 << TABLE_BITS, bool)
        table[slot(key)] = True
        return Items([i for i, _ in kept], [t for _, t in kept], budget, sizes + 1 - (budget + 1) * q, key[order], item[order], at[order], table, found)


def aligned(item: np.ndarray, text: np.ndarray, edits: int) -> tuple[int, int] | None:
    """(fewest edits, end) of the item in the text within the edit budget, starting and ending anywhere; None if over it.

    Rows are characters of the item; only cells within the band of the text's
    extra length are computed, and each row is one numpy step.
    """
    m, n = len(item), len(text)
    width = n - m + 2 * edits + 1
    if width <= 0:
        return None
    t = np.full(m + width + 2 * edits + 2, -1, np.int64)
    t[edits : edits + n] = text
    letters = item.astype(np.int64)
    big = np.int32(1 << 20)
    # cell j of row i is text position i + j - edits
    column = np.arange(width)
    row = np.where((column - edits >= 0) & (column - edits <= n), 0, big).astype(np.int32)
    for i in range(1, m + 1):
        position = column + i - edits
        best = row + (t[i - 1 : i - 1 + width] != letters[i - 1])
        best[:-1] = np.minimum(best[:-1], row[1:] + 1)
        best[(position < 0) | (position > n)] = big
        row = np.minimum.accumulate(best - column) + column
        row[(position < 0) | (position > n)] = big
        if row.min() > edits:
            return None
    j = int(row.argmin())
    return (int(row[j]), j + m - edits) if row[j] <= edits else None


def regions(items: Items, key: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """(item, lowest diagonal) of each diagonal band that shares as many q-grams with the item as the bound asks.

    Diagonals are cut into strips of k + 1; a band is two neighbouring strips, so bands overlap by half
    and every run of k + 2 diagonals lies within one.
    """
    low = np.searchsorted(items.key, key[hit], "left")
    n = np.searchsorted(items.key, key[hit], "right") - low
    total = int(n.sum())
    if not total:
        return np.zeros((0, 2), np.int64)
    where = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(total)
    item, lift = items.item[where], int(items.at.max())
    strip = (np.repeat(hit, n) - items.at[where] + lift) // (items.edits[item] + 1)
    span = int(strip.max()) + 3
    code = np.sort(item * span + strip + 1)
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    count, code = np.diff(np.r_[first, total]), code[first]
    after = np.zeros(len(code), np.int64)
    if len(code) > 1:
        after[:-1] = np.where(code[1:] == code[:-1] + 1, count[1:], 0)
    bound = items.bound[code // span]
    found = code[count + after >= bound]  # a strip and the next one
    item, strip = found // span, found % span - 1
    return np.stack([item, strip * (items.edits[item] + 1) - lift], axis=1)


def scan(items: Items, data: np.ndarray, borders: np.ndarray, q: int = Q) -> list[tuple[int, int, int, int]]:
    """(row, item, edits, end) of every item that a row has; a long row is scanned in stretches that overlap by the longest item."""
    data, borders = normalised(data, borders)
    if not items.ids or not len(data):
        return []
    if len(borders) > 2 or len(data) <= BLOCK:
        best = _found(items, data, borders, q)
    else:
        best, over = {}, max(len(t) + 4 * (int(k) + 1) for t, k in zip(items.texts, items.edits, strict=True))
        for start in range(0, len(data), BLOCK):
            part = data[start : start + BLOCK + over]
            for place, (e, end) in _found(items, part, np.array([0, len(part)]), q).items():
                if place not in best or e < best[place][0]:
                    best[place] = (e, start + end)
    return [(row, i, e, end) for (row, i), (e, end) in sorted(best.items())]


def _found(items: Items, data: np.ndarray, borders: np.ndarray, q: int) -> dict[tuple[int, int], tuple[int, int]]:
    """(row, item) -> fewest edits, end."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    text = data.tobytes().decode("utf-32-le", "replace")
    words = [t.tobytes().decode("utf-32-le", "replace") for t in items.texts]
    for i, want in enumerate(words):  # items shorter than a q-gram
        if len(want) < q:
            at = text.find(want)
            while at >= 0:
                row = int(np.searchsorted(borders, at, "right")) - 1
                if at + len(want) <= borders[row + 1]:
                    best.setdefault((row, i), (0, at + len(want) - int(borders[row])))
                at = text.find(want, at + 1)
    key = keys(data, q)
    member = items.table[slot(key)] if len(key) else np.zeros(0, bool)
    if len(items.key) and member.any():
        for back in range(1, q):  # q-grams across a row border are no row's
            cut = borders[1:-1] - back
            member[cut[(cut >= 0) & (cut < len(member))]] = False
        # the region of an item holds as many member q-grams as the smallest bound, so others can go
        full = np.flatnonzero([len(t) >= q for t in items.texts])
        reach = max(len(items.texts[i]) + int(items.edits[i]) for i in full)
        total = np.r_[0, np.cumsum(member)]
        place = np.arange(len(member))
        dense = np.r_[0, np.cumsum(total[np.minimum(place + reach, len(member))] - total[:-1] >= items.bound[full].min())]
        near = dense[1:] > dense[np.maximum(place + 1 - reach, 0)]
        for i, diagonal in regions(items, key, np.flatnonzero(member & near)).tolist():
            k, want = int(items.edits[i]), items.texts[i]
            low, high = max(0, diagonal - k), min(len(data), diagonal + 2 * (k + 1) + len(want) + k)
            rows = range(int(np.searchsorted(borders, low, "right")) - 1, int(np.searchsorted(borders, high, "left")))
            for row in rows:
                start = int(borders[row])
                a, b = max(low, start), min(high, int(borders[row + 1]))
                if b - a < len(want) - k or best.get((row, i), (1,))[0] == 0:
                    continue
                exact = text.find(words[i], a, b)
                if exact < 0 and np.isin(items.grams[i], key[a : max(a, b - q + 1)]).sum() < items.bound[i]:
                    continue  # the band counted a q-gram of the text more than once
                found = (0, exact - a + len(want)) if exact >= 0 else aligned(want, data[a:b], k)
                if found and ((row, i) not in best or found[0] < best[row, i][0]):
                    best[row, i] = (found[0], a + found[1] - start)
    return best


def item_passes(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", item_chars: int = ITEM_CHARS) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(ids, normalised texts) of the items in sets of at most item_chars each, in order of id; a set is read when its turn comes."""
    ids: list = []
    held: list[np.ndarray] = []
    size = 0
    rows = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("binary").alias("text")).filter("text IS NOT NULL").orderBy("item_id")
    for row in rows.toLocalIterator():
        data, _ = normalised(*flat(pa.array([bytes(row.text)], pa.binary())))
        if size and size + len(data) > item_chars:
            yield ids, held
            ids, held, size = [], [], 0
        ids.append(row.item_id)
        held.append(data)
        size += len(data)
    if ids:
        yield ids, held


_sets: dict[str, Items] = {}


def _readers(benchmark: DataFrame, edits: float, q: int) -> Iterator:
    """A function for each pass that gives its Items in a worker.

    A set travels as a broadcast value of at most ITEM_CHARS characters, which the driver's Python lets go once it is sent; a worker
    indexes it once.
    """
    for ids, held in item_passes(benchmark):
        name, sent = uuid.uuid4().hex, benchmark.sparkSession.sparkContext.broadcast((ids, held))

        def read(name=name, sent=sent) -> Items:
            if name not in _sets:
                if len(_sets) > 1:
                    _sets.clear()
                _sets[name] = Items.of(*sent.value, edits, q)
            return _sets[name]

        yield read


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: float = EDITS, q: int = Q) -> DataFrame:
    """doc_id, item_id, edits, match_end: a row for each document and each benchmark item that occurs in it.

    An item of m normalised characters may differ by floor(edits * m) of them, fewer where
    the bound would fall under two q-grams; items shorter than a q-gram must occur exactly. Null or empty texts
    and items match nothing. match_end is the end of the best occurrence in the normalised text, the first of equal ones.
    Repeated rows of either table repeat their rows. A very long text is scanned in overlapping stretches. Other columns are not read.
    The items travel with the tasks in sets of bounded size, one pass over the documents for each set.
    """
    rows = texts(docs, F.col(id_col).cast("long").alias("doc_id"), text_col=text_col)
    schema = "doc_id long, item_id long, edits int, match_end long"

    def one(read) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = read()
            for whole in batches:
                for b in blocks(whole, 1, BLOCK):
                    found = scan(items, *flat(b.column(1)), q)
                    if found:
                        r, i, e, end = (list(x) for x in zip(*found, strict=True))
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r)), pa.array([items.ids[x] for x in i], pa.int64()), pa.array(e, pa.int32()), pa.array(end, pa.int64())], ["doc_id", "item_id", "edits", "match_end"])

        return rows.mapInArrow(run, schema)

    out = None
    for read in _readers(benchmark, edits, q):
        out = one(read) if out is None else out.unionByName(one(read))
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", edits: float = EDITS, q: int = Q) -> DataFrame:
    """The rows of docs, all columns as they are, in which no benchmark item occurs; no shuffle.

    Rows with a null or empty text stay; repeated rows stay or go together.
    """
    at = docs.columns.index(text_col)

    def without(rows: DataFrame, read) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = read()
            for whole in batches:
                for b in blocks(whole, at, BLOCK):
                    clean = np.ones(b.num_rows, bool)
                    clean[[r for r, *_ in scan(items, *flat(b.column(at)), q)]] = False
                    yield b.filter(pa.array(clean))

        return rows.mapInArrow(run, docs.schema)

    for read in _readers(benchmark, edits, q):
        docs = without(docs, read)
    return docs
