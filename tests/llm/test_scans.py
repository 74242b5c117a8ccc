import random

import numpy as np
import pyarrow as pa
import pytest

from weftgraph.llm import decontaminate as dec
from weftgraph.llm import licenses as lic
from weftgraph.llm.arrays import flat


def arrow(texts):
    return flat(pa.array([t if isinstance(t, bytes) else (t or "").encode() for t in texts], pa.binary()))


def plain(text):
    """Normalised by a plain loop over characters."""
    out = []
    for c in text or "":
        word = c.isascii() and c.isalnum() or ord(c) > 127 and not any(a <= ord(c) < b for a, b in dec.SIGNS)
        out.append((c.lower() if len(c.lower()) == 1 else c) if word else " ")
    return " ".join(x for x in "".join(out).split(" ") if x)


def edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j in range(1, len(text) + 1):
            new.append(min(row[j - 1] + (text[j - 1] != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def mutated(rng, text, n):
    raw = list(text)
    for _ in range(n):
        j = rng.randrange(len(raw))
        kind = rng.random()
        if kind < 0.4:
            raw[j] = rng.choice("abcdefgh ")
        elif kind < 0.7:
            del raw[j]
        else:
            raw[j:j] = rng.choice(["x", "y", "qq"])
    return "".join(raw)


def spelt(found):
    return found.tobytes().decode("utf-32-le")


def array(text):
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def test_normalised(monkeypatch):
    texts = ["", "  A  b!c ", "É é\nÈ", "...", "x", None, "don't", "ß×÷", "Ж—Щ “ДОМ” İx", "😀 Ǆ𐐀", "a" * 9 + "é" * 20 + " . " * 9]
    data, borders = dec.normalised(*arrow(texts))
    assert [spelt(data[a:b]) for a, b in zip(borders[:-1], borders[1:], strict=True)] == [plain(t) for t in texts]
    for block in (4, 7, 100):
        monkeypatch.setattr(dec, "BLOCK", block)
        assert [spelt(dec.normalised(*arrow([t]))[0]) for t in texts] == [plain(t) for t in texts]
    data, borders = dec.normalised(*arrow([b"a\xff b", b"\xc3", b"c"]))
    assert [spelt(data[a:b]) for a, b in zip(borders[:-1], borders[1:], strict=True)] == ["a\ufffd b", "\ufffd", "c"]


@pytest.mark.parametrize("q", [1, 3, 5, 8])
def test_keys(q):
    data = array("abcabcXabcé😀abcabcX")
    got = dec.keys(data, q).tolist()
    want = [sum(int(c) * pow(dec.STEP, q - 1 - k, 1 << 64) for k, c in enumerate(data[i : i + q])) % (1 << 64) for i in range(len(data) - q + 1)]
    assert got == want


def test_alignment():
    rng = random.Random(1)
    for _ in range(150):
        item = "".join(rng.choice("abжc ") for _ in range(rng.randrange(12, 40)))
        k = rng.randrange(0, 5)
        text = "zz" * rng.randrange(0, 4) + mutated(rng, item, rng.randrange(0, k + 3)) + "yy" * rng.randrange(0, 4)
        want, got = edits(item, text), dec.aligned(array(item), array(text), k)
        assert (got[0] if got else None) == (want if want <= k else None)


@pytest.mark.parametrize("letters", ["the of and tion ing er re an heat thou onder blest erth", "не дом ищу тот ё лес мир где да и раз она снег"])
def test_scan_against_alignment_of_all_pairs(letters, monkeypatch):
    rng = random.Random(2)
    words = letters.split()
    sentence = lambda n: " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))
    texts = [sentence(rng.randrange(8, 25)) for _ in range(12)] + ["tiny", "four word item here"]
    data, borders = dec.normalised(*arrow(texts))
    items = dec.Items.of(list(range(len(texts))), [data[a:b] for a, b in zip(borders[:-1], borders[1:], strict=True)], dec.EDITS)
    docs = []
    for n in range(40):
        i = rng.randrange(len(texts))
        docs.append(sentence(rng.randrange(0, 30)) + " " + mutated(rng, texts[i], rng.randrange(0, int(items.edits[i]) + 4)) + " " + sentence(rng.randrange(0, 30)))
    docs += ["", "tin", "x tiny x"]
    got = {(r, i): e for r, i, e, _ in dec.scan(items, *arrow(docs))}
    want = {}
    for r, d in enumerate(docs):
        text = plain(d)
        for i, x in enumerate(texts):
            if len(plain(x)) <= len(text) + items.edits[i] and (e := edits(plain(x), text)) <= items.edits[i]:
                want[r, i] = e
    assert got == want and len(want) > 25
    monkeypatch.setattr(dec, "BLOCK", 90)
    assert {(r, i): e for r, d in enumerate(docs) for _, i, e, _ in dec.scan(items, *arrow([d]))} == want


def test_contaminated(spark, odd, none, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = {(r.doc_id, r.item_id) for r in dec.contaminated(docs, bench).collect()}
    texts, items = {r.doc_id: plain(r.text) for r in docs.collect()}, {r.item_id: plain(r.text) for r in bench.collect()}
    inside = {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    assert inside <= rows and inside
    for d, i in rows - inside:
        assert edits(items[i], texts[d]) <= 0.1 * len(items[i])
    left = {r.doc_id for r in dec.drop_contaminated(docs, bench).collect()}
    assert left == set(texts) - {d for d, _ in rows}
    own = spark.createDataFrame([(1, "the cat SAT on the mat!"), (2, None), (3, ""), (None, "no id")], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.item_id or 0) for r in dec.contaminated(odd, own).collect()) == [(0, 0), (1, 1), (2, 1), (2, 1), (9, 1)]
    assert dec.drop_contaminated(odd, own).columns == odd.columns and dec.drop_contaminated(odd, own).count() == 6
    assert dec.contaminated(none, own).count() == 0 and dec.contaminated(odd, own.limit(0)).count() == 0 and dec.drop_contaminated(odd, own.limit(0)).count() == 11


def test_items_in_passes(spark, sf, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    passes = [dec.Items.of(*p, dec.EDITS) for p in dec.item_passes(bench, item_chars=2000)]
    assert len(passes) > 2 and sum(len(p.ids) for p in passes) == bench.count()
    data, borders = arrow([r.text for r in docs.orderBy("doc_id").collect()])
    split = sorted((r, p.ids[i], e) for p in passes for r, i, e, _ in dec.scan(p, data, borders))
    whole = dec.Items.of(*next(dec.item_passes(bench)), dec.EDITS)
    assert split == sorted((r, whole.ids[i], e) for r, i, e, _ in dec.scan(whole, data, borders))
    rows = sorted(tuple(r) for r in dec.contaminated(docs, bench).collect())
    small = dec.item_passes
    monkeypatch.setattr(dec, "item_passes", lambda b: small(b, item_chars=4000))
    assert sorted(tuple(r) for r in dec.contaminated(docs, bench).collect()) == rows and rows


def shingles(text):
    words = plain(text).split(" ")
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def brute_share(template, text):
    """The best containment over all windows of the template's class."""
    want, have = set(shingles(template)), shingles(text)
    size = 8
    while size < len(plain(template).split(" ")):
        size *= 2
    wide = size * 3 // 2
    return max((len(set(have[a : a + wide]) & want) / len(want) for a in range(max(1, len(have)))), default=0)


def test_licenses_found_with_changes():
    rng = random.Random(3)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    library, docs, gold = lic.Library.of(lic.TEMPLATES), [], []
    for _ in range(8):
        for i, text in enumerate(lic.TEMPLATES.values()):
            w = text.split()
            if len(w) > 30 and rng.random() < 0.7:
                w[rng.randrange(len(w))] = "changed"
            docs.append(" ".join(rng.choice(words) for _ in range(rng.randrange(0, 90))) + " " + " ".join(w) + " " + " ".join(rng.choice(words) for _ in range(rng.randrange(0, 90))))
            gold.append(i)
    got = {(r, t): share for r, t, share, _, _ in lic.scan(library, *arrow(docs))}
    for r, i in enumerate(gold):
        assert got[r, i] == pytest.approx(brute_share(list(lic.TEMPLATES.values())[i], docs[r]))
    for (r, t), share in got.items():
        assert share >= 0.8 and share == pytest.approx(brute_share(list(lic.TEMPLATES.values())[t], docs[r]))


def test_license_spans(spark, odd, none, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = lic.license_spans(docs).collect()
    lines = {k: v for k, v in lic.TEMPLATES.items() if k in ("mit-line", "apache-2.0-line", "gpl-3.0-line", "cc-by-nc-4.0-line")}
    want = {(d, k) for d, t in texts.items() for k, v in lines.items() if v in t}
    assert want == {(r.doc_id, r.license_id) for r in rows} and want
    assert all(texts[r.doc_id][r.start : r.end] in {v.rstrip(".") for v in lines.values()} for r in rows)
    assert lic.license_spans(odd).count() == 0 and lic.license_spans(none).count() == 0
    own = {"cat": "the cat sat on the mat"}
    assert sorted(r.doc_id for r in lic.license_spans(odd, own).collect()) == [1, 2, 2, 9]
    with pytest.raises(ValueError):
        lic.Library.of({"short": "too few words"})


def test_notices_in_a_row():
    """Back to back, each notice is a find; so is one that follows a cut one; a long text in blocks has the same finds."""
    line, other, long = lic.TEMPLATES["cc-by-4.0-line"], lic.TEMPLATES["mit-line"], lic.TEMPLATES["isc"]
    library = lic.Library.of(lic.TEMPLATES)
    names = list(lic.TEMPLATES)
    docs = [f"{line} " * 7, f"{line} {other} {line}", f"{long} {long}", " ".join(long.split()[:9]) + " " + long, f"{long} some words between {long} {other}"]
    found = [(r, names[t]) for r, t, *_ in lic.scan(library, *arrow(docs))]
    assert [sum(r == k and n == x for r, n in found) for k, x in ((0, "cc-by-4.0-line"), (1, "cc-by-4.0-line"), (1, "mit-line"), (2, "isc"), (3, "isc"), (4, "isc"), (4, "mit-line"))] == [7, 2, 1, 2, 1, 2, 1]
    assert len(found) == 16


def test_long_texts_by_blocks(monkeypatch):
    rng = random.Random(9)
    library, parts = lic.Library.of(lic.TEMPLATES), []
    for _ in range(60):
        parts += [" ".join(rng.choice("alpha beta gamma d'accord été x".split()) for _ in range(rng.randrange(0, 60))), rng.choice(list(lic.TEMPLATES.values()))]
    data, borders = arrow([" ".join(parts)])
    want = lic.scan(library, data, borders)
    assert len(want) >= 60
    monkeypatch.setattr(lic, "BLOCK", 6000)
    assert [(t, a, b) for _, t, _, a, b in lic.scan(library, data, borders)] == [(t, a, b) for _, t, _, a, b in want]


def test_band_probability():
    """Windows, as wide as the scan's, that hold four fifths of a template meet it in a band as often as stated, in every class."""
    rng = np.random.default_rng(5)
    for size in (1, 4, 8, 16, 64):
        step, wide = lic.Library.window(size)
        assert (step - 1) * lic.CELL + lic.CELL - 1 + size <= wide * lic.CELL or size == 1
        met, n = 0, 1 if size == 1 else size // 2 + (size > 4)
        for _ in range(1000):
            own = rng.integers(1, 1 << 62, n, np.uint64) | np.uint64(1)
            kept = own[: -(-4 * n // 5)]
            window = np.r_[kept, rng.integers(1, 1 << 62, wide * lic.CELL - len(kept), np.uint64) | np.uint64(1)]
            met += bool((lic._minima(own, np.array([0]))[:, 0] == lic._minima(window, np.array([0]))[:, 0]).any())
        assert met >= 998, size
