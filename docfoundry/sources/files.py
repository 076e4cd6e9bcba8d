"""Files in and out: OCR pages, templates, object listings, checks by first bytes, artefacts."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What files begin with, in hexadecimal, by extension. WEBP has a second mark at byte 8.
MAGIC = {".docx": ["504B0304"], ".jpg": ["FFD8FF"], ".jpeg": ["FFD8FF"], ".png": ["89504E47"], ".gif": ["47494638"], ".bmp": ["424D"], ".tif": ["49492A00", "4D4D002A"], ".tiff": ["49492A00", "4D4D002A"], ".webp": ["52494646"]}
PAGE = "array<struct<page_index:int,markdown:string,images:map<string,string>>>"


def read_ocr_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, page_index, markdown, images) of JSON files that hold a list of pages each."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.select("path", F.inline(F.from_json("value", PAGE)))


def pack_ocr_pages(pages: DataFrame, path: str) -> None:
    """Write pages (doc_id, page_index, markdown, images) below path, a document a line with its list of pages, many to a file: with a file
    for each document, stores spend their time on names and opens."""
    page = F.struct("page_index", "markdown", "images")
    packed = pages.groupBy("doc_id").agg(F.collect_list(page).alias("pages"))
    packed.select(F.to_json(F.struct("doc_id", "pages")).alias("value")).write.text(path)


def read_packed_pages(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, page_index, markdown, images) of what pack_ocr_pages() wrote."""
    lines = spark.read.text(path).select(F.from_json("value", f"struct<doc_id:bigint,pages:{PAGE}>").alias("d"))
    return lines.select("d.doc_id", F.inline("d.pages"))


def assemble_document(pages: DataFrame) -> DataFrame:
    """(doc_id, text): pages in order, each with its footer."""
    body = F.concat("markdown", F.lit("\nPage "), (F.col("page_index") + 1).cast("string"), F.lit("\n\n---\n"))
    ordered = F.array_sort(F.collect_list(F.struct("page_index", body.alias("b"))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["b"]), "").alias("text"))


def load_templates(files: DataFrame, existing: DataFrame) -> DataFrame:
    """(path, name, json_schema, index_keys, outcome) of template files (path, value): failed without JSON, name or schema, skipped where the
    name is taken, even by a deleted template, or came in an earlier file, else created."""
    kind = "struct<name:string,description:string,indexKeys:array<string>,jsonSchema:string>"
    read = files.select("path", F.from_json("value", kind).alias("t")).select("path", F.col("t.name").alias("name"), F.col("t.jsonSchema").alias("json_schema"), F.col("t.indexKeys").alias("index_keys"))
    bad = (F.coalesce(F.trim("name"), F.lit("")) == "") | (F.coalesce("json_schema", F.lit("")) == "")
    first = read.filter(~bad).groupBy("name").agg(F.min("path").alias("_first"))
    taken = existing.select("name").distinct().withColumn("_taken", F.lit(True))
    joined = read.join(first, "name", "left").join(taken, "name", "left")
    outcome = F.when(bad, "failed").when(F.col("_taken") | (F.col("path") != F.col("_first")), "skipped").otherwise("created")
    return joined.select("path", "name", "json_schema", F.coalesce("index_keys", F.array().cast("array<string>")).alias("index_keys"), outcome.alias("outcome"))


def load_tables(spark: SparkSession, source: str, names: list[str], jdbc: dict | None = None) -> dict[str, DataFrame]:
    """Tables by name: Parquet folders, or a JDBC source read in ranges of a key (partitionColumn and bounds in `jdbc`)."""
    if jdbc:
        return {n: spark.read.format("jdbc").options(url=source, dbtable=n, **jdbc).load() for n in names}
    return {n: spark.read.parquet(f"{source}/{n}.parquet") for n in names}


def list_objects(spark: SparkSession, path: str) -> DataFrame:
    """(key, size, modified) of all files below a path that hold a byte at least: Spark lists no empty ones. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def read_heads(objects: DataFrame, n: int = 16) -> DataFrame:
    """objects (key, ..) with head: the first n bytes of each file, of which no more is read, however large it is.

    Each task opens the files of its own rows, in any store that pyarrow knows (local, HDFS, S3, GCS); for another one binaryFile's content
    serves, which reads files whole. A null key, or a file that isn't there any more, has a null head.
    """
    kept = [f for f in objects.schema.fields if f.name != "head"]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def read(batches):
        from pyarrow import fs

        for b in batches:
            heads = []
            for key in b.column("key").to_pylist():
                head = None
                if key is not None:
                    store, path = fs.FileSystem.from_uri(quote(key, safe=":/") if ":" in key else f"file://{quote(key)}")
                    try:
                        with store.open_input_stream(path, buffer_size=0) as f:
                            head = f.read(n)
                    except FileNotFoundError:
                        pass
                heads.append(head)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(heads, pa.binary())], [*b.schema.names, "head"])

    return objects.select(*(f"`{f.name}`" for f in kept)).mapInArrow(read, f"{types}, head binary")


def file_error(name: Column, content: Column) -> Column:
    """Null for a file whose first bytes fit its extension, else what is wrong."""
    ext = F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))
    head = F.hex(F.substring(content, 1, 16))
    marks = [ext.isin(k) & F.coalesce(*(F.when(head.startswith(m), True) for m in v), F.lit(False)) & (F.lit(k != ".webp") | (F.substring(head, 17, 8) == "57454250")) for k, v in MAGIC.items()]
    pdf = F.regexp_replace(head, "^(20|09|0A|0B|0C|0D)+", "").startswith("25504446")
    fits = F.lit(False)
    for m in marks:
        fits = fits | m
    known = ext.isin(".pdf", *MAGIC)
    return F.when(content.isNull() | (F.length(content) == 0), "empty").when(~known, "unsupported extension").when(~F.when(ext == ".pdf", pdf).otherwise(fits), "content does not fit extension")


def validate_files(files: DataFrame) -> DataFrame:
    """(name, is_valid, error) of files (name, content)."""
    e = file_error(F.col("name"), F.col("content"))
    return files.select("name", e.isNull().alias("is_valid"), F.coalesce(e, F.lit("")).alias("error"))


def export_artifacts(documents: DataFrame, scope: str = "all") -> DataFrame:
    """(doc_id, kind, name, body) of what a document has: its Markdown, chunks, summary; only what isn't empty. Of `original`, the body is
    the object key where its bytes lie, and the name the file's own."""
    base = F.regexp_replace("file_name", r"\.[^.]*$", "")
    every = {"ocr-markdown": (".md", "ocr_content"), "chunks-markdown": ("_Chunks.json", "chunks"), "summary": ("_Summary.md", "summary")}
    if scope == "original":
        return documents.filter("coalesce(object_key, '') <> ''").select(F.col("id").alias("doc_id"), F.lit(scope).alias("kind"), F.col("file_name").alias("name"), F.col("object_key").alias("body"))
    if scope not in ("all", *every):
        raise ValueError(f"no such scope: {scope}")
    wanted = every if scope == "all" else {k: v for k, v in every.items() if k == scope}
    parts = F.array(*(F.struct(F.lit(k).alias("kind"), F.concat(base, F.lit(end)).alias("name"), F.col(c).alias("body")) for k, (end, c) in wanted.items()))
    return documents.select(F.col("id").alias("doc_id"), F.inline(parts)).filter("body is not null and body <> ''")


def write_artifacts(artifacts: DataFrame, path: str, files_per_kind: int = 16) -> None:
    """Write export_artifacts() below path, a folder for each kind, in whose files artefacts stand whole, by name; kinds that come replace
    what was there, others stay. A kind's rows are dealt to several tasks."""
    dealt = artifacts.repartition(F.col("kind"), F.pmod(F.xxhash64("doc_id"), F.lit(files_per_kind)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind").parquet(path)


def page_image_totals(pages: DataFrame) -> DataFrame:
    """(doc_id, n_pages, n_images) of the pages of each document."""
    return pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.sum(F.size("images")).alias("n_images"))


def read_ocr_events(spark: SparkSession, source: str, kafka: dict | None = None) -> DataFrame:
    """A stream of (data, ts): JSON lines of a folder as files come, or with Kafka options the values of a topic, `source`."""
    if kafka:
        return spark.readStream.format("kafka").options(subscribe=source, **kafka).load().select(F.col("value").cast("string").alias("data"), F.col("timestamp").alias("ts"))
    return spark.readStream.schema("data string, ts timestamp").json(source)


def scratch_folder(spark: SparkSession, tag: str) -> str:
    """A new folder in spark.checkpoint.dir, or where that is unset in the warehouse; on a local master a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        local = spark.sparkContext.master.startswith("local[")
        base = f"file://{tempfile.mkdtemp(prefix='docfoundry-')}" if local else spark.conf.get("spark.sql.warehouse.dir")
    return f"{base}/{tag}-{uuid.uuid4().hex}"


@contextmanager
def held(df: DataFrame, tag: str) -> Iterator[DataFrame]:
    """kept(), deleted afterwards: for sinks of streams, which would leave a copy of every micro-batch."""
    spark, folder = df.sparkSession, scratch_folder(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(folder)
    try:
        yield spark.read.schema(df.schema).parquet(folder)
    finally:
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def kept(df: DataFrame, tag: str, clean: bool = False) -> DataFrame:
    """df as a table in a scratch_folder(), so that what reads it several times computes it once, executors lost or not.

    clean: the shuffles that it was computed by, which are needed no more, go before the next ones stand beside them. Spark's cleaner removes
    their files once the driver's plans are collected; that is asked for here, twice, as the first time only lets go of what holds them.
    """
    folder = scratch_folder(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(folder)
    for _ in range(2 * clean):
        df.sparkSession._jvm.System.gc()
        time.sleep(0.3)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
