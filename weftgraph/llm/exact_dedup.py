"""Exact duplicates by Patricia-trie owners.

Rows are dealt to partitions by text length and content hash. Each partition inserts whole
byte strings into a compressed radix trie whose terminal nodes hold the owner (the largest, or
smallest, identifier) and the number of copies. Before the shuffle every task folds its own rows
in such a trie, so a text with any number of copies crosses the network once per task. A trie
over its memory budget spills its heaviest subtree: those texts go to the next round, which
deals them to twice as many partitions under another hash. A trie always keeps one text at least, however long, so every
round settles some and the rounds end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import texts, written

#: Bytes that a trie holds before it spills; nodes count NODE bytes besides their labels.
MEMORY = 128 << 20
NODE = 300
#: Partitions of a later round at most.
MOST = 20_000


class Node:
    __slots__ = ("label", "children", "owner", "copies", "spilled")

    def __init__(self, label: bytes):
        self.label, self.children, self.owner, self.copies, self.spilled = label, {}, None, 0, False


def shared_prefix(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class PatriciaTrie:
    """A compressed radix trie of whole byte strings; prefer picks the owner of two identifiers."""

    def __init__(self, memory: int = MEMORY, prefer=max):
        self.root, self.memory, self.prefer, self.held, self.texts = Node(b""), memory, prefer, 0, 0

    def insert(self, text: bytes, owner: int | None, copies: int = 1) -> bool:
        """False if the text belongs to a subtree that was spilled."""
        node, at = self.root, 0
        while True:
            if node.spilled:
                return False
            if at == len(text):
                break
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                self.held += NODE + len(child.label)
                node = child
                break
            if not text.startswith(child.label, at):
                n = shared_prefix(child.label, text[at : at + len(child.label)])
                upper = Node(child.label[:n])
                child.label = child.label[n:]
                upper.children[child.label[0]] = child
                node.children[text[at]] = child = upper
                self.held += NODE
            at += len(child.label)
            node = child
        if not node.copies:
            node.owner = owner
            self.texts += 1
        elif owner is not None:
            node.owner = owner if node.owner is None else self.prefer(node.owner, owner)
        node.copies += copies
        return True

    def over(self) -> bool:
        return self.held > self.memory

    def terminals(self, top: Node | None = None, before: bytes = b"") -> Iterator[tuple[bytes, int | None, int]]:
        stack = [(top or self.root, before)]
        while stack:
            node, path = stack.pop()
            path += node.label
            if node.copies:
                yield path, node.owner, node.copies
            stack.extend((child, path) for child in node.children.values())

    def spill(self, close: bool) -> list[tuple[bytes, int | None, int]]:
        """Take out the largest subtree of at most half the weight, or the heaviest text.

        close: texts that come later under the subtree's first byte are refused, and one text stays, so nothing is taken of a trie of one.
        """
        order, stack = [], [self.root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack.extend(node.children.values())
        weight: dict[int, int] = {}
        texts: dict[int, int] = {}
        for node in reversed(order):
            weight[id(node)] = NODE + len(node.label) + sum(weight[id(c)] for c in node.children.values())
            texts[id(node)] = (node.copies > 0) + sum(texts[id(c)] for c in node.children.values())
        large = lambda n: weight[id(n)] * 2 > weight[id(self.root)] or (close and texts[id(n)] == self.texts)
        parent, node, path = None, self.root, b""
        while any(texts[id(c)] for c in node.children.values()) and (parent is None or large(node)):
            parent, path, node = node, path + node.label, max((c for c in node.children.values() if texts[id(c)]), key=lambda c: weight[id(c)])
        if parent is None or (close and texts[id(node)] == self.texts):
            return []
        taken = list(self.terminals(node, path))
        self.held -= weight[id(node)]
        self.texts -= len(taken)
        if close:
            stub = parent.children[node.label[0]] = Node(node.label[:1])
            stub.spilled = True
            self.held += NODE + 1
        else:
            del parent.children[node.label[0]]
        return taken


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)


def _folded(prefer, memory: int):
    """Before the shuffle: one row per distinct text of a task, or of a stretch of it that fits in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(found):
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in ((0, pa.binary()), (1, pa.int64()), (2, pa.int64()))], ["text", "owner", "copies"])

        trie = PatriciaTrie(memory, prefer)
        for b in batches:
            for owner, text in _rows(b):
                trie.insert(text, owner)
                while trie.over() and (out := trie.spill(close=False)):
                    yield batch(out)
        held, size = [], 0
        for x in trie.terminals():
            held.append(x)
            size += len(x[0])
            if size > 8 << 20:
                yield batch(held)
                held, size = [], 0
        yield batch(held)

    return run


def _owners(prefer, memory: int):
    """After the shuffle: owners of the texts that the trie kept, and the rows of spilled subtrees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["text_sha256", "text", "owner", "copies"]

        def batch(found, done):
            sha = pa.array([hashlib.sha256(x[0]).hexdigest() if done else None for x in found], pa.string())
            rest = pa.array([None if done else x[0] for x in found], pa.binary())
            return pa.RecordBatch.from_arrays([sha, rest, pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64())], names)

        trie = PatriciaTrie(memory, prefer)
        for b in batches:
            refused = []
            for text, owner, copies in _rows(b):
                if not trie.insert(text, owner, copies):
                    refused.append((text, owner, copies))
                while trie.over() and (out := trie.spill(close=True)):
                    refused += out
                if sum(len(x[0]) for x in refused) > 8 << 20:
                    yield batch(refused, False)
                    refused = []
            if refused:
                yield batch(refused, False)
        held = []
        for x in trie.terminals():
            held.append(x)
            if len(held) >= 5000:
                yield batch(held, True)
                held = []
        yield batch(held, True)

    return run


def text_owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", memory: int = MEMORY) -> DataFrame:
    """One row per distinct text: text_sha256, keep_id, group_size. keep: 'largest' or 'smallest' identifier."""
    prefer = {"largest": max, "smallest": min}[keep]
    rows = texts(docs, F.col(id_col).cast("long").alias("owner"), text_col=text_col)
    rows = rows.mapInArrow(_folded(prefer, memory), "text binary, owner long, copies long")
    done, turn = None, 0
    first = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        keys = F.octet_length("text"), F.xxhash64("text", F.lit(turn))
        dealt = rows.repartition(min(first << turn, MOST), *keys) if turn else rows.repartition(*keys)
        out = written(dealt.mapInArrow(_owners(prefer, memory), "text_sha256 string, text binary, owner long, copies long"))
        found = out.filter("text_sha256 IS NOT NULL").select("text_sha256", F.col("owner").alias("keep_id"), F.col("copies").alias("group_size"))
        done = found if done is None else done.unionByName(found)
        rows, turn = out.filter("text_sha256 IS NULL").select("text", "owner", "copies"), turn + 1
        if rows.isEmpty():
            return done


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", memory: int = MEMORY) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row.

    Null text counts as empty and empty texts are equal; texts are compared byte by byte, unchanged.
    A null id never owns a text that has another id. Rows that repeat both id and text each
    return a row, and kept is alike for all of them. No input rows: no output rows. A text of any length is held whole, by one trie at
    a time. Other input columns are not read, so their names cannot clash.
    """
    owners = text_owners(docs, id_col, text_col, keep, memory)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("text_sha256"))
    return rows.join(owners, "text_sha256").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
