"""A training-corpus pipeline: documents that toxicity rejects go, then exact copies, near copies and contaminated ones; the rest is encoded.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the
last return the columns of documents. Rows with a null doc_id are never taken for copies. Null and empty texts are texts like any other:
equal to each other, fingerprint zero, neither toxic nor contaminated unless the model or an item says so.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.decontaminate import drop_contaminated
from weftgraph.llm.exact_dedup import exact_dedup
from weftgraph.llm.sentencepieces import encode_decode
from weftgraph.llm.simhash import simhash_groups, text_prints
from weftgraph.llm.tables import load, written
from weftgraph.llm.toxicity import drop_toxic, fit_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold, by a model that learns from the labelled ones of these docs.

    Null and empty texts score alike, by the bias alone; repeated rows stay or go together; no docs, or no labels: none go.
    """
    return drop_toxic(docs, fit_toxicity(docs, load(spark, sf_dir, "labels")))


def _repeated(docs: DataFrame) -> bool:
    return not docs.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").isEmpty()


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the largest doc_id, of each set of equal texts; of rows that repeat id and text one stays."""
    gone = exact_dedup(docs).filter("NOT kept AND doc_id IS NOT NULL").select("doc_id", F.col("text_sha256").alias("_text"))
    rows = docs.withColumn("_text", F.sha2(F.coalesce("text", F.lit("")), 256))
    if _repeated(docs):
        rows = rows.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id", "_text"]).unionByName(rows.filter("doc_id IS NULL"))
    return rows.join(gone, ["doc_id", "_text"], "left_anti").select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document that each group of linked fingerprints is named after.

    Null and blank texts are one group. Rows without an id stay. Of an id with several texts each is in its own group; if more of
    them are in the group of that name, the one with the least SHA-256 stays.
    """
    groups = simhash_groups(docs)
    if not _repeated(docs):
        gone = groups.filter("doc_id <> component_id").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    # an id with several texts: of those in a group that has its name one stays, the first by its hash
    named = groups.filter("doc_id = component_id").select("doc_id", "fingerprint", "group_fingerprint").distinct()
    first = text_prints(docs).join(named, ["doc_id", "fingerprint"]).groupBy("doc_id", "group_fingerprint").agg(F.min("text_sha256").alias("_text"))
    rows = docs.withColumn("_text", F.sha2(F.coalesce("text", F.lit("")), 256))
    kept = rows.filter("doc_id IS NOT NULL").join(first.select("doc_id", "_text").distinct(), ["doc_id", "_text"], "left_semi")
    return kept.unionByName(rows.filter("doc_id IS NULL")).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs; null and empty texts stay, repeated rows stay or go together."""
    return drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids with begin and end, and the text they decode to; null and empty texts have those two ids, repeated rows a row each."""
    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("decontamination", decontamination),
    ("sentencepiece", encoding),
]

#: SQL can express neither the classifier nor the fingerprints; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's table goes when its successor's is whole."""
    docs, before = load(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = before = written(docs, before)
    return docs
