import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import language, toxicity
from weftgraph.llm.arrays import flat


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")}


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_toxicity_held_out(tables):
    got = toxicity.toxicity(tables["documents"], tables["labels"]).join(tables["labels"], "doc_id").toPandas()
    assert (got.held_out == got.doc_id.map(held)).all() and ((got.score >= 0.7) == (got.predicted == 1)).all() and got.score.between(0, 1).all()
    test = got[got.held_out]
    hit = ((test.predicted == 1) & (test.toxic == 1)).sum()
    assert hit / (test.toxic == 1).sum() > 0.9 and hit / (test.predicted == 1).sum() > 0.93


def test_toxicity_subwords():
    """A misspelling that training never saw scores high; the words around it don't."""
    rng = random.Random(1)
    clean = [" ".join(rng.choice("lorem ipsum dolor sit amet consectetur adipiscing elit sed".split()) for _ in range(30)) for _ in range(200)]
    bad = [c.replace("dolor", "shrubbery", 1) + " shrubbery" for c in clean[:100]]
    data, borders = flat(pa.array([t.encode() for t in [*bad, *clean[100:]]]))
    model = toxicity.train(data, borders, np.r_[np.ones(100, int), np.zeros(100, int)])
    score = lambda t: model.scores(*flat(pa.array([t.encode()])))[0]
    assert score("sit amet shrubberies elit") > 0.7 > 0.3 > score("sit amet dolor elit")
    # a passage of a long text isn't averaged away
    assert score("sit amet " * 3000 + "shrubbery elit sed " * 60 + "sit amet " * 3000) > 0.7 > score("sit amet " * 3000)


def test_toxicity_odd(spark, odd, none, tables):
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(odd, labels).collect()
    assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows if r.doc_id in (3, 4, 5)}) == 1
    assert toxicity.toxicity(none, labels).count() == 0 and toxicity.toxicity(odd, labels.limit(0)).count() == 11


def test_grams_by_hand():
    texts = ["The cat's ÉTÉ", "", "a", "..", "the  CAT'S été"]
    ids, whose, rows = toxicity.grams(*flat(pa.array([t.encode() for t in texts])))
    assert rows.tolist() == [0, 0, 0, 2, 4, 4, 4]
    by_row = [sorted(ids[np.isin(whose, np.flatnonzero(rows == r))].tolist()) for r in range(5)]
    assert by_row[0] == by_row[4] and by_row[1] == by_row[3] == [] and len(by_row[2]) == 1
    marked = ["<the>", "<cat's>", "<été>"]
    assert len(by_row[0]) == sum(max(0, len(w.encode()) - n + 1) for w in marked for n in toxicity.GRAMS)


def brute_score(model, text):
    """The score by a plain loop over words: passages of WINDOW words, the average of all their n-grams' weights."""
    words = [w[i : i + 256] for w in re.findall(rb"[0-9A-Za-z'\x80-\xff]+", text.lower().encode()) for i in range(0, len(w), 256)]
    parts = max(1, (len(words) + toxicity.WINDOW // 2) // toxicity.WINDOW)
    best = []
    for p in range(parts):
        mine = words[p * toxicity.WINDOW : (p + 1) * toxicity.WINDOW if p < parts - 1 else None]
        found = []
        for w in mine:
            marked = b"<" + w + b">"
            for n in toxicity.GRAMS:
                for i in range(len(marked) - n + 1):
                    h = 0
                    for c in marked[i : i + n]:
                        h = (h * 0x100000001B3 + c) % (1 << 64)
                    found.append(model.weights[(h * 0x9E3779B97F4A7C15) % (1 << 64) >> 46])
        best.append(sum(map(float, found)) / max(len(found), 1) + model.bias)
    return 1 / (1 + np.exp(-max(best)))


def test_toxicity_scores_brute_force(tables, monkeypatch):
    docs = [r.text or "" for r in tables["documents"].orderBy("doc_id").limit(60).collect()] + ["", "word", "..", "x" * 1000 + " idiot", "idiot " * 383, "trash " * 384]
    rng = np.random.default_rng(2)
    model = toxicity.ToxicModel(rng.normal(0, 3, toxicity.BUCKETS).astype(np.float32), -0.5)
    want = [brute_score(model, t) for t in docs]
    assert np.allclose(model.scores(*flat(pa.array([t.encode() for t in docs]))), want)
    monkeypatch.setattr(toxicity, "BLOCK", 700)
    assert np.allclose([model.scores(*flat(pa.array([t.encode()])))[0] for t in docs], want)


def test_toxicity_near_copies_teach_once():
    rng = random.Random(4)
    one = [rng.choice("abcdefgh") * rng.randrange(1, 6) for _ in range(60)]
    texts = [" ".join(one), " ".join(one), " ".join([*one[:-1], "zz"]), " ".join(one[::-1]), "few", "few", ""]
    data, borders = flat(pa.array([t.encode() for t in texts]))
    assert toxicity.distinct(data, borders, np.zeros(7, int)).tolist() == [0, 3, 4, 6]
    assert toxicity.distinct(data, borders, np.array([0, 1, 0, 0, 0, 1, 0])).tolist() == [0, 1, 3, 4, 5, 6]


def brute_marginals(weight, moves):
    f, b = np.empty_like(weight), np.empty_like(weight)
    s = np.ones(weight.shape[1])
    for t in range(len(weight)):
        s = (s if t == 0 else s @ moves) * weight[t]
        s = f[t] = s / s.sum()
    s = np.ones(weight.shape[1])
    for t in range(len(weight) - 1, -1, -1):
        b[t] = s
        s = moves @ (weight[t] * s)
        s /= s.sum()
    p = f * b
    return p / p.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("segment", [1, 7, 256, 1000])
def test_forward_backward(segment):
    rng = np.random.default_rng(1)
    weight, moves, borders = rng.random((900, 4)) + 0.01, rng.random((4, 4)) + 0.05, np.array([0, 0, 1, 3, 600, 600, 900])
    want = np.concatenate([brute_marginals(weight[a:b], moves) for a, b in zip(borders[:-1], borders[1:], strict=True) if b > a])
    assert np.allclose(language.marginals(weight, borders, moves, segment), want)


def test_language_held_out(tables):
    got = language.languages(tables["documents"]).join(tables["documents"].select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.held_out == got.doc_id.map(held)).all() and got.score.between(0, 1).all()
    test = got[got.held_out]
    assert (test.lang_pred == test.lang).mean() > 0.98


def brute_posterior(model, text):
    words = [w[i : i + 256] for w in re.findall(rb"[A-Za-z\x80-\xff]+", text.lower().encode()) for i in range(0, len(w), 256)]
    rows = []
    for w in words:
        e, marked = np.zeros(len(model.labels)), b"<" + w + b">"
        for n in language.GRAMS:
            for i in range(len(marked) - n + 1):
                h = 0
                for c in marked[i : i + n]:
                    h = (h * 0x100000001B3 + c) % (1 << 64)
                e += model.weights[(h * 0x9E3779B97F4A7C15) % (1 << 64) >> (65 - len(model.weights).bit_length())]
        h = sum((c + 1) * int(language._POWERS[i]) for i, c in enumerate(w)) % (1 << 64)
        at = np.searchsorted(model.lexicon, np.uint64(h))
        if at < len(model.lexicon) and int(model.lexicon[at]) == h:
            e += model.trust * model.odds[at]
        rows.append(np.exp(np.maximum(e - e.max(), -60)))
    return brute_marginals(np.array(rows), np.exp(model.moves)).mean(axis=0) if rows else np.zeros(len(model.labels))


def test_language_brute_force_and_long_texts(tables, monkeypatch):
    model = language.fit_language(tables["documents"])
    docs = [r.text or "" for r in tables["documents"].orderBy("doc_id").limit(40).collect()] + ["", "12 !", "é" * 700 + " the"]
    want = np.array([brute_posterior(model, t) for t in docs])
    assert np.allclose(model.posteriors(*flat(pa.array([t.encode() for t in docs]))), want)
    spans = [model.spans(*flat(pa.array([t.encode()]))) for t in docs]
    monkeypatch.setattr(language, "BLOCK", 900)
    assert np.allclose([model.posteriors(*flat(pa.array([t.encode()])))[0] for t in docs], want)
    for t, whole in zip(docs, spans, strict=True):
        cut = model.spans(*flat(pa.array([t.encode()])))
        assert [x[:4] for x in cut] == [x[:4] for x in whole] and np.allclose([x[4] for x in cut], [x[4] for x in whole])


def test_language_of_long_documents_and_of_many_labels(spark):
    """A language whose documents are all long is learned, and so are more languages than a model once took."""
    rng = random.Random(6)
    words = {k: ["".join(rng.choice(a) for _ in range(rng.randrange(2, 8))) for _ in range(80)] for k, a in (("xx", "bcdaz"), ("yy", "klmou"), ("zz", "stvei"))}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(1500 if k == "zz" else 60)), k) for i, k in enumerate(["xx", "yy", "zz"] * 40)]
    got = language.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).toPandas().set_index("doc_id").lang_pred
    assert all(got[i] == k for i, _, k in rows)
    many = spark.createDataFrame([(i, f"word{i} other{i % 260}", f"l{i % 260:03}") for i in range(1300)], "doc_id long, text string, lang string")
    held = sum(1 for k in range(260) if all(zlib.crc32(str(i).encode()) % 3 == 1 for i in range(k, 1300, 260)))
    assert len(language.fit_language(many, rows=520).labels) == 260 - held


def test_language_spans(spark, odd, tables):
    model = language.fit_language(tables["documents"])
    half = {r.lang: r.text for r in tables["documents"].filter("n_chars between 600 and 1500").groupBy("lang").agg(F.min("text").alias("text")).collect()}
    text = half["en"] + " — " + half["fr"]
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "12 :")], "doc_id long, text string")
    rows = language.language_spans(df, model).orderBy("start").collect()
    assert {r.doc_id for r in rows} == {1} and all(a.end <= b.start for a, b in zip(rows, rows[1:], strict=False)) and 0 <= rows[0].start and rows[-1].end <= len(text)
    share = lambda lang, a, b: sum(min(r.end, b) - max(r.start, a) for r in rows if r.lang == lang and r.end > a and r.start < b) / (b - a)
    assert share("en", 0, len(half["en"])) > 0.8 and share("fr", len(half["en"]) + 3, len(text)) > 0.8
    assert language.language_spans(odd.limit(0), model).count() == 0


def test_language_odd(spark, odd, none, tables):
    model = language.fit_language(tables["documents"])
    extra = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(20, "12 34 !?"), (21, "😀😀"), (22, "la ciónado de en")], "doc_id long, text string"))
    rows = {r.doc_id: r for r in language.label_languages(extra, model).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (3, 4, 5, 20, 21)) and rows[1].lang_pred in model.labels
    assert language.languages(odd.limit(0)).count() == 0
    assert {r.lang_pred for r in language.languages(odd).collect()} == {"und"}


def test_code_switching(tables):
    model = language.fit_language(tables["documents"])
    half = {r.lang: r.text for r in tables["documents"].filter("n_chars between 600 and 1500").groupBy("lang").agg(F.min("text").alias("text")).collect()}
    p = model.posteriors(*flat(pa.array([(half["en"] + " " + half["fr"]).encode()])))[0]
    share = dict(zip(model.labels, p, strict=True))
    assert share["en"] > 0.2 and share["fr"] > 0.2 and share["de"] + share["es"] < 0.1
