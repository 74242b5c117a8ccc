"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece of the model has a white-space marker after another character, no merge crosses the
border before a run of markers, so a text's ids are those of its marked words in turn. Each task
keeps a bounded table of the distinct marked words it has met; a word is segmented once, by
the library, and the ids are joined back by position. A table for the whole corpus would send every
occurrence of every word through a shuffle; the README has the figures.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import blocks
from .tables import texts

MARKER = "▁"
#: Bytes of marked words and ids that a task keeps, ENTRY for each word besides; beyond, the table starts anew. Longer words are not kept.
TABLE, ENTRY, LONG = 40 << 20, 200, 64
#: Characters or ids of a text that are worked on at once.
PIECE = 1 << 19
WORD, CUT = re.compile(" +[^ ]*"), re.compile("(?<! ) ")


class ChunkTable:
    """A loaded model, its begin and end ids, and the ids of the marked words met so far."""

    def __init__(self, path: str, limit: int = TABLE):
        from sentencepiece import SentencePieceProcessor

        self.model, self.limit, self.known, self.held = SentencePieceProcessor(model_file=path), limit, {}, 0
        self.ids = lambda found: array("I", found).tobytes()
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        #: Pieces that cross a marker, or a normaliser that does more than mark blanks, call for whole texts.
        self.whole = any(re.search(f"[^{MARKER}]{MARKER}", p) for p in pieces) or self.model.encode("  a  ") != self.model.encode(f"{MARKER}{MARKER}a{MARKER}{MARKER}") or self.model.decode(self.model.encode("  a  ")) != "  a  "
        self.begin, self.end = self.ids([self.model.bos_id()]), self.ids([self.model.eos_id()])
        self.opens = np.array([p.startswith(MARKER) for p in pieces])

    def encode(self, found: list[str]) -> list[bytes]:
        """Each text's ids with begin and end, as little-endian unsigned 32-bit integers."""
        if self.whole:
            return [self.begin + self.ids(x) + self.end for x in self.model.encode(found, num_threads=1)]
        # the library marks the start of a text as it marks a blank
        marked = [" " + t.replace(MARKER, " ") if t else "" for t in found]
        if len(marked) == 1:
            return [self.begin + b"".join(x for part in _parts(marked[0]) for x in self._words([WORD.findall(part)])) + self.end]
        return [self.begin + x + self.end for x in self._words([WORD.findall(t) for t in marked])]

    def _words(self, words: list[list[str]]) -> list[bytes]:
        """The ids of each list of marked words; words that are new are segmented at once."""
        wanted = set().union(*words)
        new = list(wanted.difference(self.known))
        if self.held > self.limit:
            self.known, self.held, new = {}, 0, list(wanted)
        made = dict(zip(new, map(self.ids, self.model.encode([w[1:] for w in new], num_threads=1)), strict=True))
        # a lone blank is the marker piece, which the library does not give for an empty text
        if " " in made and not made[" "]:
            made[" "] = self.ids([self.model.piece_to_id(MARKER)])
        kept = {w: x for w, x in made.items() if len(w) <= LONG}
        self.known.update(kept)
        self.held += sum(ENTRY + len(w) + len(x) for w, x in kept.items())
        known, long = self.known, len(kept) < len(made)
        return [b"".join([made[x] if x in made else known[x] for x in w] if long else map(known.__getitem__, w)) for w in words]

    def decode(self, ids: bytes) -> str:
        if self.whole or len(ids) <= 4 * PIECE:
            return self.model.decode(memoryview(ids).cast("I").tolist())
        # a part that begins with a marker loses it, as a text does
        found, start, out = np.frombuffer(ids, np.uint32), 0, []
        while start < len(found):
            after = self.opens[found[start + PIECE : start + 2 * PIECE]]
            end = start + PIECE + (int(after.argmax()) if after.any() else len(after)) if len(after) else len(found)
            while end < len(found) and not self.opens[found[end]]:
                end += 1
            out.append(self.model.decode(found[start:end].tolist()))
            start = end
        return " ".join(out)


def _parts(marked: str) -> Iterator[str]:
    """A marked text in parts of about PIECE characters, each from a run of markers on."""
    start = 0
    while len(marked) - start > PIECE:
        cut = CUT.search(marked, start + PIECE)
        if not cut:
            break
        yield marked[start : cut.start()]
        start = cut.start()
    yield marked[start:]


_tables: dict[str, ChunkTable] = {}


def table_of(path: str) -> ChunkTable:
    """One table per worker process and model."""
    if path not in _tables:
        _tables[path] = ChunkTable(path)
    return _tables[path]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array, begin and end included), decoded (text): one row per input row.

    Null counts as empty, which has the two ids and decodes to the empty text. Repeated rows return repeated rows. A very long text is
    worked on part by part; a single word of any length is the library's in one go. The model file must be at the same path on
    every executor. Other columns are not read.
    """
    return _each(docs, path, id_col, text_col, "ids array<int>, decoded string", lambda ids, t: (ids, t.decode(ids)))


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what encode_decode returns, made where the ids are; nulls and the rest as there."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return _each(docs, path, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda ids, t: (len(ids) // 4, sha(ids), sha(t.decode(ids).encode())))


def _lists(found: list[bytes]) -> pa.ListArray:
    borders = [0, *accumulate(len(x) // 4 for x in found)]
    return pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.Array.from_buffers(pa.int32(), borders[-1], [None, pa.py_buffer(b"".join(found))]))


def _each(docs, path, id_col, text_col, schema, made) -> DataFrame:
    names = ["doc_id", *(x.split()[0] for x in schema.split(", "))]
    types = {"long": pa.int64(), "string": pa.string(), "array<int>": None}
    kinds = [types[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(path)
        for whole in batches:
            for b in blocks(whole, 1, 2 << 20):
                rows = [made(ids, table) for ids in table.encode(b.column(1).to_pylist())]
                made_of = [[r[i] for r in rows] for i in range(len(kinds))]
                yield pa.RecordBatch.from_arrays([b.column(0), *(_lists(x) if k is None else pa.array(x, k) for x, k in zip(made_of, kinds, strict=True))], names)

    return texts(docs, F.col(id_col).cast("long").alias("doc_id"), text_col=text_col, as_bytes=False).mapInArrow(run, f"doc_id long, {schema}")
