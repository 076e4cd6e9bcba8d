"""Pages of sorted listings: by key, never by counting past rows."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def page_by_created(documents: DataFrame, size: int, before: tuple | None = None) -> DataFrame:
    """The `size` newest rows older than the cursor (created_at, id)."""
    if before:
        at, key = (F.lit(x) for x in before)
        documents = documents.filter((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") < key)))
    return documents.orderBy(F.desc("created_at"), F.desc("id")).limit(size)


def page_by_updated(documents: DataFrame, size: int, before: tuple | None = None, in_flight: tuple[str, ...] = ("ProcessingOcr", "ProcessingIndexing")) -> DataFrame:
    """Rows in flight first, then the last updated; the cursor holds (updated_at, id) only."""
    if before:
        at, key = (F.lit(x) for x in before)
        documents = documents.filter((F.col("updated_at") < at) | ((F.col("updated_at") == at) & (F.col("id") < key)))
    return documents.orderBy(F.col("status").isin(*in_flight).desc(), F.desc("updated_at"), F.desc("id")).limit(size)


def page_offset(rows: DataFrame, page: int, size: int) -> tuple[DataFrame, int, int]:
    """A numbered page, the total and the number of pages. Sizes outside 1..100 become 20, pages below 1 become 1."""
    size = size if 1 <= size <= 100 else 20
    total = rows.count()
    return rows.orderBy(F.desc("updated_at"), F.desc("id")).offset((max(page, 1) - 1) * size).limit(size), total, ceil(total / size)


def folder_listing(items: DataFrame) -> DataFrame:
    """items with place: that of each among the children of its folder, or of its dataset's top, by type, sort order, name."""
    folder = Window.partitionBy("dataset_id", "parent_id").orderBy("item_type", "sort_order", "name", "id")
    return items.withColumn("place", F.row_number().over(folder))


def newest_per(rows: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The first n rows of each key in this order, with their rank: recent threads of every user, datasets of every owner."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= n)
