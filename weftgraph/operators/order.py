"""Ranked order of entities and neighbours, and pages of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.strings import utf16_length
from weftgraph.schema import PAGE_CHARS, GraphError

SORTS = ("name", "mtime", "obs_mtime", "pagerank", "llmrank")


def sort_columns(sort_by: str = "llmrank", sort_dir: str | None = None, collate: bool = True) -> list[Column]:
    """Sort order with the name as last tie-break. Ranks and times that are missing count as zero.

    Names go by Unicode collation, then by code unit; the direction is ascending for names, else descending.
    """
    if sort_by not in SORTS or sort_dir not in (None, "asc", "desc"):
        raise GraphError(f"cannot sort by {sort_by} {sort_dir}")
    up = (sort_dir or ("asc" if sort_by == "name" else "desc")) == "asc"
    way = lambda c: c.asc() if up else c.desc()
    number = lambda name: way(F.coalesce(F.col(name), F.lit(0)))
    name = F.col("name")
    if sort_by == "name":
        return [way(F.collate(name, "UNICODE")), way(name)] if collate else [way(name)]
    keys = {"llmrank": ["walker_rank", "structural_rank"], "pagerank": ["structural_rank"]}.get(sort_by, [sort_by])
    return [*map(number, keys), name.asc()]


def ranked(entities: DataFrame, ranks: DataFrame) -> DataFrame:
    """Entities with walker_rank and structural_rank: visits over all visits, zero where there were none."""
    known = ranks.select("name", "structural_visits", "walker_visits")
    totals = known.agg(F.sum("structural_visits").alias("s"), F.sum("walker_visits").alias("w")).withColumn("k", F.lit(1))
    shares = known.withColumn("k", F.lit(1)).join(F.broadcast(totals), "k")  # one row of totals
    share = lambda visits, total: F.when(F.col(total) > 0, F.col(visits) / F.col(total)).otherwise(0.0)
    shares = shares.select("name", share("walker_visits", "w").alias("walker_rank"), share("structural_visits", "s").alias("structural_rank"))
    found = entities.join(shares, "name", "left")
    return found.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("walker_rank", "structural_rank")})


#: The names of fields in answers.
FIELDS = {"entity_type": "entityType", "obs_mtime": "obsMtime", "src": "from", "dst": "to", "rel_type": "relationType"}


def item_json(*columns: str) -> Column:
    """An item as the page holds it: JSON without missing fields."""
    return F.to_json(F.struct(*(F.col(c).alias(FIELDS.get(c, c)) for c in columns)))


def string_json(column: str) -> Column:
    """An item that is a bare string, as the page holds it."""
    whole = F.to_json(F.array(F.col(column)))
    return F.substr(whole, F.lit(2), F.length(whole) - 2)


def overhead(total: Column | int) -> Column:
    """Characters of a page without its items."""
    total = F.lit(total) if isinstance(total, int) else total
    return F.lit(len('{"items":[],"nextCursor":null,"totalCount":}')) + F.length(total.cast("string"))


def page(items: DataFrame, order: list[Column], json: Column, cursor: int = 0, limit: int = PAGE_CHARS, total: int | None = None) -> DataFrame:
    """position, json of one page, in order: as many items from the cursor as fit, one at least. total: their number, if it is known.

    An item takes two characters and a comma at least, so only that many of the ordered rows are looked at.
    """
    total = items.count() if total is None else total
    most = cursor + limit // 3 + 1
    rows = items.orderBy(*order).limit(most).select(json.alias("json"))
    first = Window.orderBy("position")  # at most `most` rows
    rows = rows.withColumn("position", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) - 1).filter(F.col("position") >= cursor)
    size = F.sum(utf16_length(F.col("json")) + 1).over(first) - 1
    return rows.withColumn("size", size).filter((F.col("size") + overhead(total) <= limit) | (F.col("position") == cursor)).select("position", "json")


def page_starts(lengths: Column, total: Column | None = None, limit: int = PAGE_CHARS) -> Column:
    """Positions at which the pages of a list begin, from the array of its items' lengths."""
    total = F.size(lengths) if total is None else total
    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("size"))

    def add(state: Column, n: Column) -> Column:
        fits = (state["at"] > 0) & (state["size"] + 1 + n <= limit)
        return F.struct(
            F.when(fits, state["starts"]).otherwise(F.concat(state["starts"], F.array(state["at"]))).alias("starts"),
            (state["at"] + 1).alias("at"),
            F.when(fits, state["size"] + 1 + n).otherwise(overhead(total) + n).cast("long").alias("size"),
        )

    return F.aggregate(lengths, start, add, lambda s: s["starts"])
