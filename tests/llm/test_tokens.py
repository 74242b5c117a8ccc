import hashlib
import os
import random
import struct

import pytest

os.environ["TOKENIZERS_PARALLELISM"] = "false"
public_tokenizers = pytest.importorskip("public_tokenizers")
from sentencepiece import SentencePieceProcessor  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from weftgraph.llm import sentencepieces, token_counts as counting  # noqa: E402
from weftgraph.llm.sentencepieces import ChunkTable, encode_decode, encode_digests  # noqa: E402
from weftgraph.llm.token_counts import PrefixCounter, token_counts, token_prefixes  # noqa: E402

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
BITS = [" ", "  ", "\n", "\t", "a", "the", "é", "▁", "▁▁", "\x00", "<s>", "</s>", "<unk>", "<0x0A>", "😀", "ﬁ", "Ａ", " ", "　", "​", "...", "1", "\r\n", "'re", "'", "'s", "r", "<|endoftext|>", "<|end", "日本", "\x1c", "\x85", "ing", "---------", "՘", "࢏"]


def noise(n, seed):
    rng = random.Random(seed)
    return ["", " ", "  ", "a ", " a", "'r", *("".join(rng.choice(BITS) for _ in range(rng.randrange(1, 25))) for _ in range(n))]


@pytest.fixture(scope="module")
def pieces():
    return SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES)


def test_chunks_equal_library(pieces):
    table = ChunkTable(PIECES, limit=300_000)
    found = noise(3000, 1)
    for k in range(0, len(found), 100):
        part = found[k : k + 100]
        got = [list(struct.unpack(f"<{len(b) // 4}I", b)) for b in table.encode(part)]
        assert got == [[1, *pieces.encode(t), 2] for t in part]
    assert table.held <= 300_000 + 100 * 24 * 500 and not table.whole and max(map(len, table.known)) <= sentencepieces.LONG
    assert table.encode(["y" * 500 + " a"]) == [struct.pack(f"<{len(x)}I", *x) for x in [[1, *pieces.encode("y" * 500 + " a"), 2]]]


def test_long_texts_by_parts(pieces, monkeypatch):
    for part in (2, 7, 60):
        monkeypatch.setattr(sentencepieces, "PIECE", part)
        table = ChunkTable(PIECES)
        for t in noise(300, 5) + [" ".join(noise(60, 6))]:
            ids = table.encode([t])[0]
            want = [1, *pieces.encode(t), 2]
            assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want and table.decode(ids) == pieces.decode(want), repr(t)


def test_encode_documents(spark, sf, pieces):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = encode_digests(docs, PIECES).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = [1, *pieces.encode(texts[r.doc_id]), 2]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(pieces.decode(ids).encode()).hexdigest() == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_encode_odd(odd, none, pieces):
    rows = encode_decode(odd, PIECES).collect()
    texts = sorted((str(r.doc_id), r.text or "") for r in odd.collect())
    assert sorted((str(r.doc_id), pieces.decode(r.ids)) for r in rows) == [(i, pieces.decode([1, *pieces.encode(t), 2])) for i, t in texts]
    assert {tuple(r.ids) for r in rows if r.doc_id in (3, 4)} == {(1, 2)}
    assert encode_decode(none, PIECES).count() == 0 == encode_digests(none, PIECES).count()


def test_counts_equal_library(library):
    counter = PrefixCounter(BYTES)
    found = noise(3000, 2)
    assert counter.counts(found) == [len(library.encode(t, add_special_tokens=False).ids) for t in found]


def test_every_prefix(library):
    counter = PrefixCounter(BYTES)
    for t in noise(250, 3):
        assert counter.every_prefix(t).tolist() == [len(library.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)], repr(t)
    assert counter.truncate("hello world again", 2) == 11


@pytest.mark.parametrize("piece", [1 << 19, 5])
def test_truncate(library, monkeypatch, piece):
    monkeypatch.setattr(counting, "PIECE", piece)
    counter = PrefixCounter(BYTES)
    for t in noise(150, 8) + [" ".join(noise(20, 9)), "a b" + " " * 40 + "c d", "word " * 30]:
        every = [len(library.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
        assert counter.count(t) == every[-1]
        for budget in (0, 1, 2, 3, 5, 8, 13, 40):
            assert counter.truncate(t, budget) == max(i for i, n in enumerate(every) if n <= budget), (t, budget)


def test_pairs_fit(library):
    counter, rng = PrefixCounter(BYTES), random.Random(4)
    tokens = [t for t in rng.sample(sorted(counter.bytes_of), 600) if counter.own(t)]
    for _ in range(4000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        assert counter.fit(a, b) == (counter.merged(counter.bytes_of[a] + counter.bytes_of[b]) == [a, b])


def test_count_documents(spark, sf, odd, none, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (docs, odd):
        want = sorted((str(r.doc_id), len((r.text or "").encode()), n := len(library.encode(r.text or "", add_special_tokens=False).ids), n > 1024) for r in df.collect())
        rows = token_counts(df, BYTES, limit=1024).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == want
        texts = {r.doc_id: r.text or "" for r in df.collect()}
        for r in rows:
            count = lambda i, t=texts[r.doc_id]: len(library.encode(t[:i], add_special_tokens=False).ids)
            assert (r.cut_at_limit == len(texts[r.doc_id])) if not r.over_limit else count(r.cut_at_limit) <= 1024 < min(count(r.cut_at_limit + k) for k in range(1, 9))
    assert token_counts(none, BYTES).count() == 0


def test_prefix_table(odd):
    rows = {r.doc_id: r for r in token_prefixes(odd.filter("doc_id < 7"), BYTES, (0, 3)).collect()}
    assert rows[1].prefix_tokens[-1] == 6 and rows[1].cuts == [0, 11] and rows[3].prefix_tokens == [0] and rows[3].cuts == [0, 0]
