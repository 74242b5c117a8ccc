"""The registered queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .decontaminate import contaminated
from .exact_dedup import exact_dedup
from .html_text import main_texts
from .language import languages
from .licenses import license_spans
from .pii import pseudonymised
from .sentencepieces import encode_digests
from .simhash import simhash_groups
from .tables import load
from .token_counts import token_counts
from .toxicity import toxicity

#: The key of the registered query; a real run passes its own secret.
PII_KEY = "weftgraph"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(load(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(load(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_spans(load(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(load(spark, sf_dir, "pages"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(load(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(load(spark, sf_dir, "documents"), PII_KEY)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(load(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_simhash": op2_simhash,
        "op3_license_scan": op3_license_scan,
        "op4_html_text": op4_html_text,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_toxicity": op6_toxicity,
        "op7_pii": op7_pii,
        "op8_decontaminate": op8_decontaminate,
        "op9_token_counts": op9_token_counts,
        "op10_language": op10_language,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
                   count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
                   doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
                   sha256(coalesce(text, '')) AS text_sha256
            FROM documents""",
    }
