"""An inverted index of trigrams, and candidates for a regular expression from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import ere, script_regex
from weftgraph.functions.regex_plan import Query, plan


def postings(strings: DataFrame) -> DataFrame:
    """strings (id, text) -> trigram, id: the distinct three-byte runs of the UTF-8 of each text in lower case, as numbers of 24 bits."""
    raw = strings.select("id", F.encode(F.lower("text"), "UTF-8").alias("raw")).filter(F.octet_length("raw") >= 3)
    grams = raw.select("id", "raw", F.explode(F.sequence(F.lit(1), F.octet_length("raw") - 2)).alias("at"))
    gram = F.conv(F.hex(F.substr("raw", F.col("at"), F.lit(3))), 16, 10).cast("int")
    return grams.select(gram.alias("trigram"), "id").distinct()


def rebuild(strings: DataFrame) -> DataFrame:
    """The postings in ranges of trigrams, each sorted: what a written index is made of."""
    return postings(strings).repartitionByRange("trigram").sortWithinPartitions("trigram", "id")


def add(index: DataFrame, strings: DataFrame) -> DataFrame:
    """The index with the strings' ids replaced or added."""
    return remove(index, strings.select("id")).unionByName(postings(strings))


def remove(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select("id").distinct(), "id", "left_anti").select("trigram", "id")


def index_size(index: DataFrame) -> DataFrame:
    """One row: ids, trigrams, postings."""
    return index.agg(F.count_distinct("id").alias("ids"), F.count_distinct("trigram").alias("trigrams"), F.count("*").alias("postings"))


def _leaves(query: Query) -> set[int]:
    return {query.value} if query.kind == "tri" else set().union(*map(_leaves, query.parts))


def _met(query: Query, has):
    if query.kind == "tri":
        return has(query.value)
    out = _met(query.parts[0], has)
    for q in query.parts[1:]:
        out = out & _met(q, has) if query.kind == "and" else out | _met(q, has)
    return out


def evaluate(index: DataFrame, query: Query) -> DataFrame:
    """id: those whose trigrams meet the condition (neither all nor none).

    One scan takes the postings of the condition's trigrams, one sum per id collects which of them it has.
    """
    wanted = sorted(_leaves(query))
    found = index.filter(F.col("trigram").isin(wanted)).groupBy("id").agg(F.collect_set("trigram").alias("has"))
    return found.filter(_met(query, lambda t: F.array_contains("has", t))).select("id")


def candidates(strings: DataFrame, index: DataFrame, pattern: str, dialect: str = "posix") -> DataFrame:
    """id: a superset of those whose text matches, in any case of letters; all of them where the pattern can't be narrowed."""
    query = plan(pattern, dialect)
    if query is None:
        return strings.select("id")
    return strings.select("id").limit(0) if query.kind == "none" else evaluate(index, query)


def search_text(strings: DataFrame, pattern: str, index: DataFrame | None = None, dialect: str = "posix", any_case: bool = False) -> DataFrame:
    """id, text of the strings that match; with an index only its candidates are looked at. dialect: posix or script."""
    if index is not None and plan(pattern, dialect) is not None:
        strings = strings.join(candidates(strings, index, pattern, dialect), "id", "left_semi")
    java = (ere.to_java if dialect == "posix" else script_regex.to_java)(pattern)
    return strings.filter(F.col("text").rlike(f"(?iu){java}" if any_case else java))
