import hashlib
import random

import numpy as np
import pytest
import xxhash

from weftgraph.llm import simhash
from weftgraph.llm.components import components
from weftgraph.llm.exact_dedup import PatriciaTrie, exact_dedup


def brute_owner(rows, pick=max):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        members = groups[t or ""]
        known = [m for m in members if m is not None]
        keep = pick(known) if known else None
        out.append((i, keep, len(members), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep,pick", [("largest", max), ("smallest", min)])
def test_exact(odd, keep, pick):
    got = exact_dedup(odd, keep=keep)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_owner([(r.doc_id, r.text) for r in odd.collect()], pick)


def test_exact_empty(none):
    assert exact_dedup(none).count() == 0


def test_spill_changes_nothing(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(0, 9))) * rng.choice([1, 40])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    small = exact_dedup(df, memory=4000)
    assert sorted((tuple(r) for r in small.collect()), key=str) == brute_owner(rows)


def test_texts_longer_than_the_memory(spark):
    """Each round settles a text per partition, so texts over the memory end too, alone or among others."""
    rows = [(i, "xyz"[i % 3] * 9000 + str(i % 4)) for i in range(24)] + [(100 + i, "short " + str(i % 7)) for i in range(300)] + [(500, "x" * 9000), (501, None)]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), memory=2000)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_owner(rows)


def test_spill_keeps_one_text():
    trie = PatriciaTrie(100)
    trie.insert(b"a" * 5000, 1)
    assert trie.over() and trie.spill(close=True) == [] and list(trie.terminals()) == [(b"a" * 5000, 1, 1)]
    trie.insert(b"a" * 4000 + b"b", 2)
    trie.insert(b"", 3)
    taken = trie.spill(close=True) + trie.spill(close=True)
    assert {t for t, *_ in taken} | {t for t, *_ in trie.terminals()} == {b"a" * 5000, b"a" * 4000 + b"b", b""} and trie.spill(close=True) == [] and trie.held < 1000 + 5000


def test_trie():
    rng = random.Random(2)
    for close in (False, True):
        trie, want, out, refused = PatriciaTrie(20_000), {}, {}, 0

        def take(text, owner, n, out=out):
            o, c = out.get(text, (owner, 0))
            out[text] = (max(o, owner), c + n)

        for i in range(4000):
            t = bytes(rng.choice(b"xyz") for _ in range(rng.randrange(0, 12)))
            o, c = want.get(t, (i, 0))
            want[t] = (i, c + 1)
            if not trie.insert(t, i):
                refused += 1
                take(t, i, 1)
            while trie.over() and (spilled := trie.spill(close)):
                for x in spilled:
                    take(*x)
        for x in trie.terminals():
            take(*x)
        assert out == want and (refused > 0) == close


def brute_print(text, words=4):
    import re

    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    s = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def brute_groups(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = [brute_print(r.text) for r in rows]
    groups = brute_groups(fps)
    least = {}
    for r, g in zip(rows, groups, strict=True):
        least[g] = min(least.get(g, r.doc_id), r.doc_id)
    want = {(r.doc_id, f"{f:016x}", least[g]) for r, f, g in zip(rows, fps, groups, strict=True)}
    got = simhash.simhash_groups(docs).collect()
    assert {tuple(r)[:3] for r in got} == want
    assert len({r.component_id for r in got}) == len({r.group_fingerprint for r in got}) == len({(r.component_id, r.group_fingerprint) for r in got})


def test_simhash_odd(odd, none):
    rows = sorted((tuple(r)[:3] for r in simhash.simhash_groups(odd).collect()), key=str)
    assert len(rows) == 11
    by_id = {i: (f, c) for i, f, c in rows}
    assert by_id[1] == by_id[2] == by_id[9] and by_id[1][1] == 1
    assert {by_id[i][0] for i in (3, 4, 5)} == {"0" * 16} and {by_id[i][1] for i in (3, 4, 5)} == {3}
    assert all(f == f"{brute_print(r.text):016x}" for r in odd.collect() for f in [by_id[r.doc_id][0]])
    assert simhash.simhash_groups(none).count() == 0


@pytest.mark.parametrize("bucket", [20_000, 5])
def test_links_of_close_and_crowded_fingerprints(spark, bucket):
    """Chains, clusters and a crowd that shares half its bits: connected as all pairs would connect them."""
    rng = random.Random(3)
    fps = []
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(8):
            fps.append(x)
            for _ in range(rng.randrange(0, 7)):
                x ^= 1 << rng.randrange(64)
    fps += [0xDEADBEEF << 32 | rng.getrandbits(14) << rng.randrange(0, 18) for _ in range(150)]
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = simhash.links(df, bucket=bucket)
    pairs = [(np.int64(r.a).view(np.uint64), np.int64(r.b).view(np.uint64)) for r in edges.collect()]
    assert all(int(a ^ b).bit_count() <= 4 for a, b in pairs)
    roots = {r.node: r.root for r in components(edges).collect()}
    got, want = {}, {}
    for f, s, g in zip(fps, signed, brute_groups(fps), strict=True):
        got.setdefault(roots.get(s, s), set()).add(f)
        want.setdefault(g, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_crowds_are_split_as_long_as_there_are_bits(spark):
    """Fingerprints that share half their bits and more fill the buckets of several rounds."""
    rng = random.Random(5)
    fps = {0xDEADBEEF << 32 | 0xCAFE << 16 | rng.getrandbits(16) for _ in range(300)} | {0xDEADBEEF << 32 | rng.getrandbits(32) for _ in range(200)}
    fps |= {0xDEADBEEF << 32 | 0xCAFE << 16 | 0xAB << 8 | x for x in range(256)}
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    roots = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), bucket=4)).collect()}
    got, want = {}, {}
    for f, s, g in zip(fps, signed, brute_groups(fps), strict=True):
        got.setdefault(roots.get(s, s), set()).add(f)
        want.setdefault(g, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_fingerprint_by_blocks(monkeypatch):
    rng = random.Random(7)
    texts = [" ".join("x" * rng.randrange(1, 9) + str(rng.randrange(50)) for _ in range(n)) for n in (0, 1, 3, 4, 5, 40, 400)] + [" \t\n", "y" * 300, "  a  B\x0bc "]
    want = [brute_print(t) for t in texts]
    for block in (1, 7, 64, 1 << 22):
        monkeypatch.setattr(simhash, "BLOCK", block)
        assert [simhash.fingerprint(t.encode()) for t in texts] == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 200), (7, 7), (100, 200)] + [(500, 500 + i) for i in range(1, 60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100, **{500 + i: 500 for i in range(60)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
