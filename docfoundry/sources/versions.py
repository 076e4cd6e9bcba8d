"""Rows replaced in storage, partition by partition.

A merge writes the partitions that it touches as new folders, version=<v> below the partition's own, and last a marker that names them in a
folder beside the data. A partition's rows are those of the highest version that a marker names for it. So a merge that fails before its
marker changes nothing and can be run again; one that is repeated after it does nothing; and the files of other partitions stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import held, kept

VERSION = "version"


def _marks(spark: SparkSession, path: str) -> DataFrame | None:
    """(partition columns, version) of all markers; None before the first."""
    try:
        return spark.read.parquet(f"{path}-commits")
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _latest(marks: DataFrame) -> DataFrame:
    return marks.groupBy(*(c for c in marks.columns if c != VERSION)).agg(F.max(VERSION).cast("long").alias(VERSION))


def read_current(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of the current version of each partition; None where nothing was merged yet.

    Partitions are picked by a join on their columns, so Spark prunes the files of superseded versions, and with a filter or a join on a
    partition column those of other partitions.
    """
    marks = _marks(spark, path)
    if marks is None:
        return None
    latest = _latest(marks)
    rows = spark.read.parquet(path)
    by = [c for c in latest.columns if c != VERSION]
    rows = rows.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in latest.schema if rows.schema[f.name].dataType != f.dataType})
    return rows.join(latest, [*by, VERSION]).drop(VERSION)


def merge(new: DataFrame, path: str, by: list[str], key: str, version: int, combine: Callable[[DataFrame, DataFrame], DataFrame] | None = None, elsewhere: bool = False) -> bool:
    """Put the rows of `new` in the place of those with their keys, as `version`; False if that version is committed already.

    by: partition columns, of few values; `combine` makes a touched partition's rows from the old and the new ones, instead. With
    `elsewhere` keys may have rows in other partitions than the new ones: those go too. `new` is computed once: as a micro-batch it may
    come from a stateful operator, which would run again for each time that it is read.
    """
    spark = new.sparkSession
    marks = _marks(spark, path)
    if marks is not None and marks.filter(F.col(VERSION) == version).limit(1).count():
        return False
    with held(new, "new") as once:
        _replace(once, path, by, key, version, combine, elsewhere)
    return True


def _replace(new: DataFrame, path: str, by: list[str], key: str, version: int, combine: Callable[[DataFrame, DataFrame], DataFrame] | None, elsewhere: bool) -> None:
    spark = new.sparkSession
    touched = new.select(*by)
    old = read_current(spark, path)
    rows = new
    if old is not None:
        keys = new.select(key).distinct()
        if elsewhere:
            touched = touched.unionByName(old.select(key, *by).join(keys, key, "left_semi").select(*by))
        # written before the folders of a killed writer are replaced, which the listing of the old rows may still hold
        touched = kept(touched.distinct(), "touched")
        theirs = old.join(touched, by, "left_semi").select(new.columns)
        rows = combine(theirs, new) if combine else theirs.join(keys, key, "left_anti").unionByName(new)
    elif combine:
        rows = combine(new.limit(0), new)
    spread = rows.withColumn(VERSION, F.lit(version).cast("long")).repartition(*by)
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by, VERSION).parquet(path)
    _commit(touched.distinct(), path, version)


def _commit(touched: DataFrame, path: str, version: int) -> None:
    touched.coalesce(1).write.mode("overwrite").parquet(f"{path}-commits/{VERSION}={version}")


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the folders of superseded versions, but for the last before the current one, which may still be read; how many there were.
    What leaves is one row a folder, not rows of data."""
    marks = _marks(spark, path)
    if marks is None:
        return 0
    by = [c for c in marks.columns if c != VERSION]
    kept = marks.groupBy(*by).agg(F.slice(F.sort_array(F.collect_set(F.col(VERSION).cast("long")), False), 1, 2).alias("kept"))
    there = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), *by, VERSION)
    folder = F.regexp_extract("file", r"^(.*)/[^/]*$", 1)
    gone = there.select(folder.alias("folder"), *by, VERSION).distinct().join(kept, by, "left").filter(~F.coalesce(F.array_contains("kept", F.col(VERSION).cast("long")), F.lit(False)))
    gone = gone.join(_latest(marks).withColumnRenamed(VERSION, "latest"), by, "left").filter(F.coalesce(F.col(VERSION) < F.col("latest"), F.lit(True)))
    jvm, n = spark._jvm, 0
    for r in gone.select("folder").toLocalIterator():
        p = jvm.org.apache.hadoop.fs.Path(r["folder"])
        n += p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return n
