"""Token counts by prefix dynamic programming.

A byte-pair encoding is right exactly when each two neighbouring tokens are what the merges make of their
joined bytes. So every prefix of a word has one last token: the one that ends there, is
what the merges make of its own bytes, and fits the last token of the prefix before it. The table of these gives
the exact token count at every prefix of a word, and summed over the words before it at every prefix of a
text; truncation to a budget and counts of any prefix need no second encoding.

Words repeat, so each task keeps a bounded table of the words it has met.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import blocks
from .tables import texts

LIMIT = 1024
#: Bytes of words that a task remembers, ENTRY for each besides, and token pairs; beyond, a table starts anew. Longer words are not remembered.
WORDS, ENTRY, LONG, PAIRS = 60 << 20, 150, 64, 1_000_000
#: Characters of a text that are worked on at once.
PIECE = 1 << 19
#: Fixed value: the pattern by which byte-level models split text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Letters from here on may be unassigned in one Unicode table and not in another.
RARE, BLANKS, BORDER = regex.compile("[^\x00-\u052f\u2010-\u2027\u20a0-\u20b0\u3041-\u3096\u4e00-\u9fa5]"), regex.compile(r"\s*"), regex.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the model's file: itself if it prints, else one from 256 up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """A byte-level model and the prefix tables of the words met so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters = byte_letters()
        spelt = lambda s: bytes(letters[c] for c in s)
        #: Strings that the library takes as one token wherever they stand.
        self.special = [x["content"] for x in file["added_tokens"]]
        special = set(self.special)
        self.id_of = {spelt(s): i for s, i in file["model"]["vocab"].items() if s not in special}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"])
        #: The rank at which two neighbours merge and the token they make; the rank and halves that make a token.
        self.merge, self.made = {}, {}
        for rank, (a, b) in enumerate(pairs):
            a, b = spelt(a), spelt(b)
            ids = self.id_of[a], self.id_of[b], self.id_of[a + b]
            self.merge[ids[:2]] = (rank, ids[2])
            self.made.setdefault(ids[2], (rank, *ids[:2]))
        self.bytes_of = {i: t for t, i in self.id_of.items()}
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.longest = max(map(len, self.id_of))
        self.words, self.fits, self.whole, self.held = {}, {}, {}, 0
        self.split = regex.compile(PATTERN)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def merged(self, data: bytes) -> list[int]:
        """What the merges make of the bytes, lowest rank first; for single tokens and pairs of them only."""
        ids = [self.id_of[data[i : i + 1]] for i in range(len(data))]
        while len(ids) > 1:
            rank, i = min(((self.merge.get((a, b), (1 << 30,))[0], i) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False))))
            if rank == 1 << 30:
                break
            ids[i : i + 2] = [self.merge[ids[i], ids[i + 1]][1]]
        return ids

    def fit(self, before: int, token: int) -> bool:
        """True if the merges leave the two tokens as they are, side by side.

        They don't if, at some time in the merging, the pieces that then faced each other would have merged.
        The latest merge of either side is undone until only bytes face each other; a pair of pieces
        is in the way if its rank is below that of the merges undone so far.
        """
        known = self.fits.get((before, token))
        if known is None:
            if len(self.fits) > PAIRS:
                self.fits.clear()
            known = self.fits[before, token] = self._apart(before, token)
        return known

    def _apart(self, left: int, right: int) -> bool:
        merge, made, until = self.merge, self.made, 1 << 30
        while True:
            met = merge.get((left, right))
            if met is not None and met[0] < until:
                return False
            one, two = made.get(left), made.get(right)
            if one is None and two is None:
                return True
            if two is None or (one is not None and one[0] > two[0]):
                # of equal ranks the left one merges first, so undoing the left side's admits its own rank no more
                until, left = one[0], one[2]
            else:
                # the right piece arises after a pair of the same rank to its left
                until, right = two[0] + 1, two[1]

    def own(self, token: int) -> bool:
        """True if the merges make the token of its own bytes."""
        known = self.whole.get(token)
        if known is None:
            known = self.whole[token] = self.merged(self.bytes_of[token]) == [token]
        return known

    def prefixes(self, word: bytes, like: tuple | None = None) -> list[int]:
        """The token count of each prefix of one word, from the empty one to the whole."""
        return self._table(word, like)[1]

    def _table(self, word: bytes, like: tuple | None = None) -> tuple[bytes, list[int], list[int]]:
        """(word, counts, last tokens) by prefix; like: such a table of a word whose first bytes may be the same."""
        n, done = len(word), 0
        count, last = [0] * (n + 1), [-1] * (n + 1)
        if like is not None:
            for a, b in zip(word, like[0], strict=False):
                if a != b:
                    break
                done += 1
            count[: done + 1], last[: done + 1] = like[1][: done + 1], like[2][: done + 1]
        get, fits, longest = self.id_of.get, self.fits, self.longest
        for end in range(done + 1, n + 1):
            # one last token fits, whatever the order; it is short more often than not
            for start in range(end - 1, end - longest - 1 if end > longest else -1, -1):
                token = get(word[start:end])
                if token is None:
                    continue
                if start:
                    pair = (last[start], token)
                    known = fits.get(pair)
                    if not (self.fit(*pair) if known is None else known):
                        continue
                elif not self.own(token):
                    continue
                last[end], count[end] = token, count[start] + 1
                break
        return word, count, last

    def learn(self, words: Iterable[str]) -> dict[str, int]:
        """Counts of words at their last prefixes, in byte order so that each table goes on from the prefix it shares with the one before; short ones are remembered."""
        table, out = None, {}
        for data, word in sorted((w.encode(), w) for w in words):
            table = self._table(data, table)
            out[word] = table[1][-1]
        if self.held > WORDS:
            self.words, self.held = {}, 0
        kept = {w: n for w, n in out.items() if len(w) <= LONG}
        self.words.update(kept)
        self.held += sum(ENTRY + len(w) for w in kept)
        return out

    def total(self, word: str) -> int:
        """The count at a word's last prefix, remembered."""
        known = self.words.get(word)
        return self.learn([word])[word] if known is None else known

    def cut_up(self, text: str) -> list[str]:
        """The words to be merged one by one; the library itself splits texts with letters that are newer in one of two Unicode tables."""
        if RARE.search(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        return self.split.findall(text)

    def parts(self, text: str) -> list[tuple[str, bool]]:
        """The text between special strings, and these (True), in order."""
        if self.cut is None or not any(s in text for s in self.special):
            return [(text, False)]
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [(text[at : m.start()], False), (m.group(), True)]
            at = m.end()
        return [*out, (text[at:], False)]

    def counts(self, found: list[str]) -> list[int]:
        """The tokens of each text: the sum of its words' last prefixes, and one for each special string."""
        return [n for n, _ in self.measured(found)]

    def measured(self, found: list[str], budget: int | None = None) -> list[tuple[int, int]]:
        """The tokens of each text, and the most characters of it that have at most `budget` tokens."""
        if len(found) == 1 and len(found[0]) > PIECE:
            return [self._long(found[0], budget)]
        split = [[(self.cut_up(part), False) if not special else ([part], True) for part, special in self.parts(t)] for t in found]
        new = self.learn(set().union(*(w for x in split for w, special in x if not special)).difference(self.words))
        known, out = self.words, []
        for t, x in zip(found, split, strict=True):
            try:
                n = sum(1 if special else sum(map(known.__getitem__, w)) for w, special in x)
            except KeyError:  # long words, or the table started anew
                n = sum(1 if special else sum(new[k] if k in new else self.total(k) for k in w) for w, special in x)
            out.append((n, len(t) if budget is None or n <= budget else self._cut(x, budget)))
        return out

    def _long(self, text: str, budget: int | None) -> tuple[int, int]:
        """The same for one text piece by piece: words begin where a piece does."""
        total, cut, at = 0, len(text), 0
        for piece in self.pieces(text):
            left = budget - total if budget is not None and total <= budget else None
            n, end = self.measured([piece, ""], left)[0]  # two texts, so that a piece that can't be cut is taken as it is
            if left is not None and n > left:
                cut = at + end
            total, at = total + n, at + len(piece)
        return total, cut

    def _cut(self, split: list[tuple[list[str], bool]], budget: int) -> int:
        """The end of the longest prefix within the budget, which lies in the first word that goes over it.

        Only the prefix tables of that word and of the two before it are made, with the blanks before those, as a cut text may be split otherwise at
        its end; all words before them count as they stand.
        """
        starts, bases, held = [0], [0], []
        for words, special in split:
            for w in words:
                n = 1 if special else self.total(w)
                held.append(w)
                if bases[-1] + n > budget:
                    low = max(0, len(held) - 3)
                    while low > 0 and (not held[low].strip() or held[low - 1][-1].isspace() or held[low][0].isspace() and not held[low - 1].strip()):
                        low -= 1
                    prefix = self.every_prefix("".join(held[low:])) + bases[low]
                    return starts[low] + int(np.flatnonzero(prefix <= budget)[-1])
                starts.append(starts[-1] + len(w))
                bases.append(bases[-1] + n)
        return starts[-1]

    def pieces(self, text: str) -> Iterator[str]:
        """The text in pieces of about PIECE characters, cut before single blanks between other characters, where words always begin."""
        start = 0
        while len(text) - start > PIECE and not any(" " in s for s in self.special):
            cut = BORDER.search(text, start + PIECE)
            if not cut:
                break
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:]

    def count(self, text: str) -> int:
        return self.counts([text])[0]

    def every_prefix(self, text: str) -> np.ndarray:
        """The exact token count of text[:i] for i from 0 to its length.

        Cutting a text can change how its end is split: blanks at the end are one word, an
        apostrophe's ending may be cut, and the start of a special string is ordinary text. Such prefixes
        take their counts from the last border that the cut leaves in place.
        """
        out, base = [0], 0
        for k, (part, special) in enumerate(parts := self.parts(text)):
            if special:
                before = parts[k - 1][0]
                start = base - sum(map(self.total, self.cut_up(before)))
                out += [start + sum(map(self.total, self.cut_up(before + part[:i]))) for i in range(1, len(part))]
                base += 1
                out.append(base)
                continue
            blanks, before_blanks = "", base
            for w in self.cut_up(part):
                if blanks or BLANKS.match(w).end():
                    lead = BLANKS.match(w).end()
                    run, rest = blanks + w[:lead], w[lead:]
                    if not blanks:
                        before_blanks = base
                    table = self.prefixes(run.encode())
                    ends = np.cumsum([len(c.encode()) for c in run])
                    out += [before_blanks + table[e] for e in ends[len(blanks) :]]
                    blanks = run if not rest else ""
                else:
                    lead, rest = 0, w
                if rest:
                    table, at = self.prefixes(w.encode()), len(w[:lead].encode())
                    short = w.startswith("'") and len(w) > 2 and w[1:].isalpha()
                    for i, c in enumerate(rest):
                        at += len(c.encode())
                        cut = short and 0 < i < len(rest) - 1
                        out.append(base + (sum(map(self.total, self.cut_up(w[: lead + i + 1]))) if cut else table[at]))
                base += self.total(w)
        return np.array(out, np.int64)

    def truncate(self, text: str, budget: int) -> int:
        """The most characters of the text that have at most `budget` tokens."""
        return self.measured([text], budget)[0][1]


_counters: dict[str, PrefixCounter] = {}


def counter_of(path: str) -> PrefixCounter:
    """One counter per worker process and model."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), cut_at_limit (characters of the longest prefix within the limit): one row per input row.

    Null counts as empty, which has no token. Special strings in a text are one token each. Repeated rows return
    repeated rows; other columns are not read. A very long text is worked on piece by piece. The model file must be at the same path on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for whole in batches:
            for b in blocks(whole, 2, 8 << 20):
                n, cut = zip(*counter.measured(b.column(2).to_pylist(), limit), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()), pa.array(cut, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_at_limit"]
                )

    size = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes")
    rows = texts(docs, F.col(id_col).cast("long").alias("doc_id"), size, text_col=text_col, as_bytes=False)
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_at_limit long")


def token_prefixes(docs: DataFrame, path: str, budgets: tuple[int, ...] = (LIMIT,), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, prefix_tokens (the count at every prefix, by characters), cuts (the longest prefix within each budget, in characters).

    Null counts as empty, whose only prefix has no token. Repeated rows return repeated rows; equal texts have equal tables. A table has a
    number for each character, so it is several times its text. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for whole in batches:
            for b in blocks(whole, 1, 1 << 20):
                tables = [counter.every_prefix(t) for t in b.column(1).to_pylist()]
                cuts = [[int(np.flatnonzero(t <= k)[-1]) for k in budgets] for t in tables]
                borders = np.r_[0, np.cumsum([len(t) for t in tables])]
                lists = pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(np.concatenate(tables).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(cuts, pa.list_(pa.int64()))], ["doc_id", "prefix_tokens", "cuts"])

    rows = texts(docs, F.col(id_col).cast("long").alias("doc_id"), text_col=text_col, as_bytes=False)
    return rows.mapInArrow(run, "doc_id long, prefix_tokens array<int>, cuts array<long>")
