import hashlib

import corpus_pipeline
from tests.llm.test_dedup import brute_groups, brute_print
from tests.llm.test_scans import edits, plain
from weftgraph.llm.toxicity import fit_toxicity, score_toxicity


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "simhash_near_dedup", "decontamination", "sentencepiece"]
    after = {}
    for name, stage in stages.items():
        after[name] = (docs, docs := stage(spark, docs, sf).cache())
    assert all(b.columns == columns for n, (_, b) in after.items() if n != "sentencepiece")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    texts = lambda df: {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}

    before, kept = after["toxicity"]
    model = fit_toxicity(before, spark.read.parquet(f"{sf}/labels.parquet"))
    assert ids(kept) == ids(score_toxicity(before, model).filter("predicted = 0"))

    before, kept = after["exact_dedup"]
    owner = {}
    for i, t in texts(before).items():
        owner[t] = max(i, owner.get(t, i))
    assert ids(kept) == set(owner.values())

    before, kept = after["simhash_near_dedup"]
    rows = sorted(texts(before).items())
    first = {}
    for (i, _), g in zip(rows, brute_groups([brute_print(t) for _, t in rows]), strict=True):
        first.setdefault(g, i)
    assert ids(kept) == set(first.values())

    before, kept = after["decontamination"]
    items = [plain(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    own = {i: plain(t) for i, t in texts(before).items()}
    exact = {i for i, t in own.items() if any(x in t for x in items)}
    gone = set(own) - ids(kept)
    assert exact <= gone and all(any(edits(x, own[i]) <= len(x) // 10 for x in items) for i in gone - exact)

    before, kept = after["sentencepiece"]
    assert {r.doc_id: r.decoded for r in kept.collect()} == texts(before)


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "ids", "decoded"] and 0 < out.count() < spark.read.parquet(f"{sf}/documents.parquet").count()


def test_odd_rows(spark, odd, none):
    for stage in (corpus_pipeline.exact_copies, corpus_pipeline.near_copies):
        out = stage(spark, odd, None)
        assert out.columns == odd.columns and out.filter("doc_id IS NULL").count() == 1
        assert stage(spark, none, None).count() == 0
    rows = corpus_pipeline.exact_copies(spark, odd, None).collect()
    assert sorted((r.doc_id or 0) for r in rows) == [0, 2, 4, 5, 6, 7, 8, 9]
    assert hashlib.sha256(b"").hexdigest()


def test_repeated_ids(spark):
    """Of an id with several texts only the copies go, and rows without an id stay."""
    copy, other, near = (" ".join(f"{w}{i}" for i in range(400)) for w in "abc")
    rows = [(1, copy), (2, copy), (1, other), (1, other), (3, near), (4, near.replace("c0 ", "c0, ")), (4, "unique text of four"), (None, "x"), (None, "x"), (5, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = lambda df: sorted(((r.doc_id or 0), r.text or "") for r in df.collect())
    assert kept(corpus_pipeline.exact_copies(spark, docs, None)) == sorted([(2, copy), (1, other), (3, near), (4, near.replace("c0 ", "c0, ")), (4, "unique text of four"), (0, "x"), (0, "x"), (5, "")])
    docs = spark.createDataFrame([(1, copy), (2, copy), (2, other), (None, copy)], "doc_id long, text string")
    assert kept(corpus_pipeline.near_copies(spark, docs, None)) == sorted([(1, copy), (2, other), (0, copy)])
    close = copy.replace("a0 ", "a0, ")
    assert (brute_print(copy) ^ brute_print(close)).bit_count() <= 4
    docs = spark.createDataFrame([(1, copy), (1, close), (2, copy), (1, other), (3, close)], "doc_id long, text string")
    first = min(copy, close, key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    assert kept(corpus_pipeline.near_copies(spark, docs, None)) == sorted([(1, first), (1, other)])
