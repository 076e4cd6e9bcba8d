"""Folder trees by materialised path: listings, trash, restore, purge, order of new items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .access import active


def ancestors(path: Column) -> Column:
    """The paths of all proper ancestors of a path such as /a/b/c/: /a/ and /a/b/."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    deep = F.size(parts)
    return F.when(deep > 1, F.transform(F.sequence(F.lit(1), deep - 1), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))


def under_deleted_folder(items: DataFrame, deleted_folders: DataFrame | None = None) -> DataFrame:
    """(id) of items that lie below a deleted folder of their own dataset: an equality join on exploded ancestors."""
    deleted = (items if deleted_folders is None else deleted_folders).filter("is_deleted and item_type = 'Folder'").select("dataset_id", F.col("path").alias("above")).distinct()
    return items.select("id", "dataset_id", F.explode(ancestors(F.col("path"))).alias("above")).join(deleted, ["dataset_id", "above"], "left_semi").select("id").distinct()


def hide_deleted_descendants(items: DataFrame) -> DataFrame:
    """Items that aren't deleted and have no deleted folder above them."""
    return active(items).join(under_deleted_folder(items), "id", "left_anti")


def item_listing(items: DataFrame, documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """Visible items with their document's name, status and size and their job's states, null where there is none."""
    d = documents.select(F.col("id").alias("document_id"), "file_name", F.col("status").alias("document_status"), "file_size")
    return hide_deleted_descendants(items).join(d, "document_id", "left").join(jobs, "document_id", "left")


def child_counts(items: DataFrame) -> DataFrame:
    """(parent_id, n_children) over items that aren't deleted."""
    return active(items).filter("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("n_children"))


def item_path(parent: Column, name: Column) -> Column:
    """/ for a root's place, else the parent's path, the name and a slash."""
    return F.concat(F.coalesce(parent, F.lit("/")), name, F.lit("/"))


def last_path_element(path: Column) -> Column:
    return F.substring_index(path, " --> ", -1)


def append_sort_order(items: DataFrame, batch: DataFrame) -> DataFrame:
    """batch (dataset_id, parent_id, name, row_no) with the next sort orders of its folders: one more than the largest, from 0."""
    largest = items.groupBy("dataset_id", "parent_id").agg(F.max("sort_order").alias("largest"))
    joined = batch.alias("b").join(largest.alias("l"), F.col("b.dataset_id").eqNullSafe(F.col("l.dataset_id")) & F.col("b.parent_id").eqNullSafe(F.col("l.parent_id")), "left")
    w = Window.partitionBy("b.dataset_id", "b.parent_id").orderBy("b.row_no")
    return joined.select("b.*", (F.coalesce("largest", F.lit(-1)) + F.row_number().over(w)).alias("sort_order"))


def trash(datasets: DataFrame, items: DataFrame) -> DataFrame:
    """(kind, id): deleted datasets, and deleted items that lie neither in a deleted dataset nor below a deleted folder."""
    gone = datasets.filter("is_deleted")
    own = items.filter("is_deleted").join(gone.select(F.col("id").alias("dataset_id")), "dataset_id", "left_anti").join(under_deleted_folder(items), "id", "left_anti")
    return gone.select(F.lit("Dataset").alias("kind"), "id").unionByName(own.select(F.col("item_type").alias("kind"), "id"))


def set_deleted(items: DataFrame, documents: DataFrame, targets: DataFrame, deleted: bool) -> tuple[DataFrame, DataFrame]:
    """Items and documents after the target items (id) were deleted or restored: an item's document goes with it."""
    hit = targets.select("id").distinct().withColumn("_hit", F.lit(True))
    flip = F.when(F.col("_hit"), F.lit(deleted)).otherwise(F.col("is_deleted"))
    new_items = items.join(hit, "id", "left").withColumn("is_deleted", flip)
    docs = new_items.filter("_hit and document_id is not null").select(F.col("document_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
    return new_items.drop("_hit"), documents.join(docs, "id", "left").withColumn("is_deleted", flip).drop("_hit")


def purge(datasets: DataFrame, items: DataFrame, documents: DataFrame, shares: DataFrame, dataset_ids: DataFrame) -> dict[str, DataFrame]:
    """What is left after the given datasets, if they are in the trash, were deleted for good with all that belongs to them."""
    gone = datasets.filter("is_deleted").join(dataset_ids.select("id"), "id", "left_semi").select(F.col("id").alias("dataset_id"))
    lost = items.join(gone, "dataset_id", "left_semi").filter("document_id is not null").select(F.col("document_id").alias("id")).distinct()
    return {
        "datasets": datasets.join(gone.withColumnRenamed("dataset_id", "id"), "id", "left_anti"),
        "items": items.join(gone, "dataset_id", "left_anti"),
        "shares": shares.join(gone, "dataset_id", "left_anti"),
        "documents": documents.join(lost, "id", "left_anti"),
    }


def purge_folders(items: DataFrame, folders: DataFrame) -> DataFrame:
    """Items left after deleted folders (id) were deleted for good with all that lies below them."""
    roots = items.filter("is_deleted and item_type = 'Folder'").join(folders.select("id"), "id", "left_semi").select("dataset_id", F.col("path").alias("above"))
    below = items.select("id", "dataset_id", F.explode(F.array_append(ancestors(F.col("path")), F.col("path"))).alias("above")).join(roots, ["dataset_id", "above"], "left_semi").select("id").distinct()
    return items.join(below, "id", "left_anti")
