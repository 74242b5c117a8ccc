"""Plain-text files as documents."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.schema import GraphError

#: Fixed value: what counts as plain text.
EXTENSIONS = frozenset(
    (
        ".txt .tex .md .markdown .rst .org .adoc .asciidoc .html .htm .xml .json .yaml .yml .toml .csv .tsv .log .cfg .ini .conf "
        ".py .js .ts .c .h .cpp .hpp .java .go .rs .rb .pl .sh .bash .zsh .fish .el .lisp .clj .hs .ml .scala .kt .r .m .swift .lua .vim .sql "
        ".bib .sty .cls"
    ).split()
)


def check_extension(path: str) -> str:
    ext = os.path.splitext(path)[1].lower()
    if ext not in EXTENSIONS:
        raise GraphError(f"{path} is no plain text: extension {ext or '(none)'} is not supported")
    return ext


def read_documents(spark: SparkSession, path: str, title: str | None = None) -> DataFrame:
    """doc_id, title, text: whole files as UTF-8; the title is the file's name without its extension unless given; several files: a path with a pattern.

    The doc_id is a hash of the path.
    """
    check_extension(path)
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    base = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return rows.select(F.xxhash64("path").alias("doc_id"), (F.lit(title) if title else base).alias("title"), "text")
