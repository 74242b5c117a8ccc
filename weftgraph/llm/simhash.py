"""Near duplicates by SimHash and meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most r bits differ in at most r // 2 bits in one of their
32-bit halves. Every distinct fingerprint emits, for each half, all variants of it within half of
that radius (r // 4 flipped bits); two halves within r // 2 bits share a variant. Rows are
shuffled on the variants, deduplicated and verified on all 64 bits. With r = 4 a fingerprint emits
66 rows. What collides in too large a bucket is hashed again by halves of the bits that the variant left out. The same hashing over the undivided word would emit all 2081 variants
within two bits; the README gives the figures that led to the halves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import texts, written

WORDS, RADIUS, SEED = 4, 4, 42
#: Distinct fingerprints under one variant that a task compares at once; larger buckets are split by further bits, as long as there are any.
BUCKET = 20_000
#: Tasks that the fingerprints of one component are dealt to when they get its name.
SALT = 16


#: Bytes that are hashed at once.
BLOCK = 1 << 22
SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _counts(found: list[bytes], words: int) -> np.ndarray:
    """How many shingles of the words have each bit."""
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    last = ends[words - 1 :]
    first = np.r_[0, ends[: len(last) - 1] + 1]
    out = np.zeros(64, np.int64)
    for k in range(0, len(last), 1 << 16):
        h = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first[k : k + (1 << 16)].tolist(), last[k : k + (1 << 16)].tolist(), strict=True)], "<u8")
        out += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return out


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Bits set in over half of the XXH64 values of the text's word shingles; A-Z lower-cased, words split at ASCII white space.

    A long text is hashed block by block, each with the last words of the one before.
    """
    counts, n, held, at = np.zeros(64, np.int64), 0, [], 0
    while at < len(text):
        cut = SPACE.search(text, at + BLOCK)
        end = cut.start() if cut else len(text)
        held += text[at:end].lower().split()
        if len(held) >= words:
            counts += _counts(held, words)
            n += len(held) - words + 1
            held = held[len(held) - words + 1 :]
        at = end
    if not n and held:
        counts, n = _counts(held, len(held)), 1
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return run


def forest(found: np.ndarray, radius: int) -> tuple[list, list]:
    """Edges of a spanning forest of the fingerprints (distinct, unsigned) that are linked; every edge is a true link."""
    left, right, rest = [], [], found
    while len(rest) > 1:
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            one = stack.pop()
            near = np.bitwise_count(rest ^ one) <= radius
            if near.any():
                linked = rest[near]
                left += [one] * len(linked)
                right += linked.tolist()
                stack.extend(linked)
                rest = rest[~near]
    return left, right


def text_prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, text_sha256, fingerprint (as of simhash_groups): one row per input row."""
    key = F.struct(F.col(id_col).cast("long").alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256")).alias("doc_id")
    rows = texts(docs, key, text_col=text_col).mapInArrow(_fingerprints(words), "doc_id struct<doc_id: long, text_sha256: string>, fp long")
    return rows.select("doc_id.*", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"))


def _links(radius: int, bucket: int | None):
    """Rows sorted by key -> edges (kind 0), and the rows of buckets over the limit (kind 1: key, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind, a, b):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(np.asarray(a, np.uint64).view(np.int64)), pa.array(np.asarray(b, np.uint64).view(np.int64))], ["kind", "a", "b"])

        held_key, held, size, over = None, [], 0, False

        def closed():
            if over or size < 2:
                return
            a, b = forest(np.unique(np.concatenate(held)), radius)
            if a:
                yield out(0, a, b)

        for batch in batches:
            keys, fps = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
            if not len(keys):
                continue
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            ends = np.r_[starts[1:], len(keys)]
            if len(starts) > 1:  # pairs that lie within the batch, all at once
                two = (ends - starts == 2)[1:-1].nonzero()[0] + 1
                a, b = fps[starts[two]], fps[starts[two] + 1]
                near = (np.bitwise_count(a ^ b) <= radius) & (a != b)
                if near.any():
                    yield out(0, a[near], b[near])
                inner = (ends - starts > 2)
                inner[0] = inner[-1] = False
                for i in inner.nonzero()[0]:
                    if bucket and ends[i] - starts[i] > bucket:
                        yield out(1, keys[starts[i] : ends[i]], fps[starts[i] : ends[i]])
                        continue
                    a, b = forest(np.unique(fps[starts[i] : ends[i]]), radius)
                    if a:
                        yield out(0, a, b)
            for i in dict.fromkeys((0, len(starts) - 1)):  # those that may go on in other batches
                key, part = keys[starts[i]], fps[starts[i] : ends[i]]
                if held_key is None or key != held_key:
                    yield from closed()
                    held_key, held, size, over = key, [], 0, False
                held.append(part)
                size += len(part)
                if bucket and (over or size > bucket):
                    over = True
                    rest = np.concatenate(held)
                    yield out(1, np.full(len(rest), held_key, np.uint64), rest)
                    held = []
        yield from closed()

    return run


def _flips(bits: int, most: int) -> list[int]:
    return [sum(1 << i for i in x) for k in range(most + 1) for x in combinations(range(bits), k)]


def _variants(rows: DataFrame, width: int, most: int) -> DataFrame:
    """(key, fp, low) -> the same by variants of both halves of the `width` bits from `low`, with the other half as what is left.

    A key's last six bits are the place of the bits left; the others are the key before, the half and the variant: as they are in the first
    round, hashed in later ones, where a chance collision only makes a bucket larger.
    """
    half = width // 2
    flips = F.array(*(F.lit(x).cast("long") for x in _flips(half, most)))
    side = lambda at, left: F.struct((F.col("low") + at).cast("int").alias("at"), (F.col("low") + left).cast("long").alias("left"))
    rows = rows.select("key", "fp", F.explode(F.array(side(half, 0), side(0, half))).alias("h"))
    value = F.expr(f"shiftrightunsigned(fp, h.at) & {(1 << half) - 1}L")
    rows = rows.select("key", "fp", "h.left", value.alias("value")).select("key", "fp", "left", F.explode(F.transform(flips, lambda x: F.col("value").bitwiseXOR(x))).alias("variant"))
    found = F.shiftleft(F.col("variant"), 6) if width == 64 else F.xxhash64("key", "left", "variant").bitwiseAND(F.lit(-64).cast("long"))
    return rows.select(found.bitwiseOR(F.col("left")).alias("key"), "fp")


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (a, b), each within the radius, that connect what all such pairs connect.

    Of two fingerprints within the radius that share a variant, the bits left differ in at most the radius, so one of their
    halves in at most half of it: a bucket over its limit can be dealt again by those halves. Rounds end at eight bits left,
    where a bucket holds few distinct fingerprints by itself.
    """
    rows, width, edges = fps.select(F.lit(0).cast("long").alias("key"), "fp", F.lit(0).cast("long").alias("low")), 64, None
    while True:
        last = width == 8
        rows = _variants(rows, width, radius // 4)
        found = written(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_links(radius, None if last else bucket), "kind int, a long, b long"))
        more = found.filter("kind = 0").select("a", "b")
        edges = more if edges is None else edges.unionByName(more)
        rows = found.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"), F.col("a").bitwiseAND(63).alias("low"))
        if last or rows.isEmpty():
            return edges
        width //= 2


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), group_fingerprint (one of the component's): one row per input row.

    Where ids repeat, components may share an id; group_fingerprint tells them apart.

    Null and blank texts have the fingerprint zero, which links like any other. Texts of fewer words
    than a shingle count as one shingle. Repeated rows return repeated rows; equal fingerprints are one
    node, so copies are never paired. A null id never names a component that has another id. A very long text is
    hashed block by block.
    """
    rows = written(texts(docs, F.col(id_col).cast("long").alias("doc_id"), text_col=text_col).mapInArrow(_fingerprints(words), "doc_id long, fp long"))
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(nodes.select("fp"), radius, bucket)).withColumnRenamed("node", "fp")
    # only linked fingerprints take a name from others; those of one component are dealt by a salt, as it may hold very many
    linked = nodes.join(roots, "fp").withColumn("salt", F.pmod(F.hash("fp"), F.lit(SALT)))
    names = linked.groupBy("root").agg(F.min("first").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    named = written(linked.join(names, ["root", "salt"]).select("fp", "component_id", "root"))
    own = F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id")
    found = nodes.join(named, "fp", "left").select("fp", own, F.coalesce("root", "fp").alias("root"))
    spelt = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return rows.join(found, "fp").select("doc_id", spelt("fp").alias("fingerprint"), "component_id", spelt("root").alias("group_fingerprint"))
