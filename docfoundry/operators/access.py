"""Who may see and change which dataset and item.

Masks are bits: 1 read, 2 update, 4 delete, 8 share. An owner has all of them.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfoundry.sources.files import kept

READ, UPDATE, DELETE, SHARE, FULL = 1, 2, 4, 8, 15


def active(df: DataFrame, include_deleted: bool = False) -> DataFrame:
    """Rows that aren't soft-deleted; all of them if asked for."""
    return df if include_deleted else df.filter(~F.col("is_deleted"))


def resolve_content(content_type: Column, summary: Column, qa_summary: Column, ocr: Column) -> Column:
    """The text that a content type asks for; null for an unknown type."""
    kind = F.lower(content_type)
    return F.when(kind == "summary", F.coalesce(summary, qa_summary)).when(kind == "fullcontent", ocr)


def can(mask: Column, permission: int) -> Column:
    return mask.bitwiseAND(F.lit(permission)) == permission


def _dataset_shares(shares: DataFrame) -> DataFrame:
    return shares.filter("dataset_item_id is null")


#: Pairs of a user and a dataset that are grouped in one task. They compress so well that AQE, which goes by bytes, would put far more together.
PAIRS = 1_000_000


def _grouped_shares(shares: DataFrame) -> DataFrame:
    """(dataset_id, user_id, department_id, mask): what each user and each department is given of a dataset; computed once."""
    named = _dataset_shares(shares).filter("dataset_id is not null and (user_id is not null or department_id is not null)")
    return kept(named.groupBy("dataset_id", "user_id", "department_id").agg(F.bit_or("mask").alias("mask")), "shares")


def _members(memberships: DataFrame) -> DataFrame:
    """Memberships in storage, so that Spark knows how few they are before it deals datasets by department."""
    return kept(memberships.select("user_id", "department_id", "role").distinct(), "members")


def _joined(of: DataFrame, members: DataFrame) -> int:
    """How many rows a join by department has."""
    n = members.groupBy("department_id").agg(F.count("*").alias("m"))
    return of.groupBy("department_id").count().join(n, "department_id").agg(F.sum(F.col("count") * F.col("m"))).first()[0] or 0


def _sources(found: DataFrame, shares: DataFrame, memberships: DataFrame) -> tuple[DataFrame, int]:
    """(user_id, dataset_id, mask) by every way there is, with repeats: owners, managers of a dataset's department, shares to users and to
    departments; and into how many partitions they are dealt by dataset, with about PAIRS each."""
    given, members = _grouped_shares(shares), _members(memberships)
    managers = members.filter("role = 'Manager'").select("user_id", "department_id").distinct()
    members = members.select("user_id", "department_id").distinct()
    of = found.select(F.col("id").alias("dataset_id"), "department_id", "owner_user_id")
    to_users, to_departments = given.filter("user_id is not null"), given.filter("department_id is not null").select("dataset_id", "department_id", "mask")
    parts = [
        of.select(F.col("owner_user_id").alias("user_id"), "dataset_id", F.lit(FULL).alias("mask")),
        managers.join(of, "department_id").select("user_id", "dataset_id", F.lit(READ).alias("mask")),
        to_users.join(of.select("dataset_id"), "dataset_id", "left_semi").select("user_id", "dataset_id", "mask"),
        to_departments.join(of.select("dataset_id"), "dataset_id", "left_semi").join(members, "department_id").select("user_id", "dataset_id", "mask"),
    ]
    rows = of.count() + _joined(of, managers) + to_users.count() + _joined(to_departments, members)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    usual = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(usual, ceil(rows / PAIRS))
    return out, n


def accessible_datasets(datasets: DataFrame, shares: DataFrame, memberships: DataFrame, users: DataFrame | None = None, admins: list[int] | None = None, include_deleted: bool = False) -> DataFrame:
    """(user_id, dataset_id), distinct: owned, shared to the user, of a department that the user manages, shared to a department of
    the user's; all of them for an admin. Department shares meet memberships once for each (dataset, department)."""
    found = active(datasets, include_deleted)
    out, n = _sources(found, shares, memberships)
    out = out.select("user_id", "dataset_id")
    if admins:
        out = out.unionByName(found.select(F.explode(F.lit(admins).cast("array<bigint>")).alias("user_id"), F.col("id").alias("dataset_id")))
    out = out.filter("user_id is not null").repartition(n, "dataset_id", "user_id").distinct()
    return out if users is None else out.join(users.select("user_id").distinct(), "user_id", "left_semi")


def effective_permissions(datasets: DataFrame, shares: DataFrame, memberships: DataFrame) -> DataFrame:
    """(user_id, dataset_id, mask) of every pair with any permission: 15 for the owner, else what all sources add up to."""
    out, n = _sources(datasets, shares, memberships)
    return out.repartition(n, "dataset_id", "user_id").groupBy("user_id", "dataset_id").agg(F.bit_or("mask").alias("mask"))


def effective_item_permissions(permissions: DataFrame, items: DataFrame, shares: DataFrame) -> DataFrame:
    """(user_id, item_id, mask) of items with a share of their own for a user: the dataset's mask, and unless that is full the item's
    user shares too. Shares of an item to a department don't count."""
    own = shares.filter("dataset_item_id is not null and user_id is not null").groupBy("user_id", F.col("dataset_item_id").alias("item_id")).agg(F.bit_or("mask").alias("own"))
    placed = own.join(items.select(F.col("id").alias("item_id"), "dataset_id"), "item_id")
    joined = placed.join(permissions, ["user_id", "dataset_id"], "left").withColumn("mask", F.coalesce("mask", F.lit(0)))
    return joined.select("user_id", "item_id", F.when(F.col("mask") == FULL, FULL).otherwise(F.col("mask").bitwiseOR(F.col("own"))).alias("mask"))


def accessible_documents(items: DataFrame, accessible: DataFrame) -> DataFrame:
    """(user_id, document_id) of items in datasets that the user may see.

    accessible: distinct, as accessible_datasets() gives it. So only documents of several datasets can come twice, and only their rows are
    compared."""
    placed = items.filter("document_id is not null").groupBy("document_id").agg(F.collect_set("dataset_id").alias("_in"))
    each = placed.select("document_id", F.explode("_in").alias("dataset_id"), (F.size("_in") > 1).alias("_several"))
    found = each.join(accessible, "dataset_id").select("user_id", "document_id", "_several")
    again = found.filter("_several").select("user_id", "document_id").distinct()
    return found.filter("not _several").select("user_id", "document_id").unionByName(again)


def denied(requested: DataFrame, accessible: DataFrame) -> DataFrame:
    """Requested (request_id, user_id, dataset_id) that the user may not see."""
    return requested.join(accessible, ["user_id", "dataset_id"], "left_anti")


def share_lookup(shares: DataFrame, dataset_id=None, dataset_item_id=None, user_id=None, department_id=None) -> DataFrame:
    """Shares by any of these; an argument that is None isn't applied."""
    for name, value in (("dataset_id", dataset_id), ("dataset_item_id", dataset_item_id), ("user_id", user_id), ("department_id", department_id)):
        if value is not None:
            shares = shares.filter(F.col(name) == value)
    return shares


def dataset_documents(items: DataFrame, documents: DataFrame, accessible: DataFrame) -> DataFrame:
    """(user_id, dataset_id, document_id, file_name) of the documents in datasets that a user (user_id, dataset_id) may see."""
    names = documents.select(F.col("id").alias("document_id"), "file_name")
    return items.filter("document_id is not null").select("dataset_id", "document_id").join(accessible, "dataset_id").join(names, "document_id").select("user_id", "dataset_id", "document_id", "file_name")


def read_documents(requests: DataFrame, documents: DataFrame, accessible: DataFrame) -> DataFrame:
    """(request_id, id, outcome, content) of requests (request_id, user_id, id, content_type): not found, denied, or ok with the content
    that the type asks for."""
    docs = active(documents).withColumn("_there", F.lit(True)).drop("user_id", "request_id", "content_type")
    may = accessible.select("user_id", "dataset_id").distinct().withColumn("_may", F.lit(True))
    j = requests.join(docs, "id", "left").join(may, ["user_id", "dataset_id"], "left")
    outcome = F.when(F.col("_there").isNull(), "not found").when(F.col("_may").isNull(), "denied").otherwise("ok")
    content = resolve_content(F.col("content_type"), F.col("summary"), F.col("qa_summary"), F.col("ocr_content"))
    return j.select("request_id", "id", outcome.alias("outcome"), F.when(outcome == "ok", content).alias("content"))
