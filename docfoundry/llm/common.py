"""What several operators share: the shared folder, sampling of labelled rows, hashing of texts in numpy."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session; where that is unset, a folder in the warehouse, or on a
    local master, which has no other machine, a temporary one."""
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
    path = spark.conf.get("spark.checkpoint.dir", None) or (f"file://{tempfile.mkdtemp(prefix='docfoundry-')}" if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/docfoundry-scratch")
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def bounded_batches(df: DataFrame, rows: int = 500, size: str = "4m") -> DataFrame:
    """df, after its session was told to hand texts to Python in small batches: by default 10,000 whole texts wait on either side.

    Settings other than the defaults are left alone.
    """
    conf = df.sparkSession.conf
    for key, default, small in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", str(rows)), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", size)):
        if conf.get(key, default) == default:
            conf.set(key, small)
    return df


def materialise(df: DataFrame, tag: str, rows: int | None = None, per_file: int = 50_000, folder: str | None = None, narrow: bool = False) -> DataFrame:
    """df as a table in the shared folder: computed once, compressed, and still there when executors are lost.

    rows: about how many rows to expect at most. A table that needs fewer files of `per_file` rows than there are shuffle partitions must
    not become a file for each of them. Where `narrow` says that only a scan comes before, its tasks are made larger; else adaptive
    execution brings partitions together, or where that is off, a shuffle of the rows.
    """
    path = f"{folder or shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    adaptive = all(conf.get(f"spark.sql.adaptive.{k}", "true") == "true" for k in ("enabled", "coalescePartitions.enabled"))
    files = None if rows is None else max(1, -(-rows // per_file))
    if files is None or files >= int(conf.get("spark.sql.shuffle.partitions")):
        few = df
    elif narrow:
        few = df.coalesce(files)
    else:
        few = df if adaptive else df.repartition(files)
    few.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one run, in one folder, which drop() deletes once its results stand elsewhere."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, tag: str, rows: int | None = None, per_file: int = 50_000, narrow: bool = False) -> DataFrame:
        return materialise(df, tag, rows, per_file, self.folder, narrow)

    def drop(self, collect: bool = True) -> None:
        """Delete the tables. What was computed from them and written needs neither them nor the shuffles before; of those, Spark's cleaner
        removes the files once the driver's plans are collected, which is asked for here: by itself it would not be soon."""
        if collect:
            self.spark._jvm.System.gc()
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


HOT_KEYS = 100_000


def join_weighted(left: DataFrame, right: DataFrame, key: str, weight: str, n: int) -> DataFrame:
    """left, of n rows, with the columns of right's row for its key, null without one.

    right has one row a key, and in `weight` how many rows of left have that key. Keys of more than n / HOT_KEYS rows, fewer than HOT_KEYS
    by count, are broadcast, so their rows stay where they are; the others are joined by a shuffle. Null keys meet no one.
    """
    hot = F.col(weight) > max(1, n // HOT_KEYS)
    few, rest = F.broadcast(right.filter(hot).drop(weight)), right.filter(~hot).drop(weight)
    some = left.filter(F.col(key).isNotNull())
    parts = [some.join(few, key), some.join(few.select(key), key, "left_anti").join(rest, key, "left")]
    return parts[0].unionByName(parts[1]).unionByName(left.filter(F.col(key).isNull()), allowMissingColumns=True)


_BITS = 1 << 27  #: of a bitmap of ids: 16 MB


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as it takes to be none of df's columns, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def select_ids(docs: DataFrame, ids: DataFrame, column: str = "doc_id", keep: bool = True, broadcast_rows: int = 200_000) -> DataFrame:
    """docs whose `column` is among the one column of ids, distinct and written; or, with keep=False, the others, nulls among them.

    Few ids are broadcast. Of more, a bitmap of hashes of bounded size is, so that only documents whose bit is set are shuffled to be
    compared with the ids themselves. Columns of docs may have any names, and come back as they are.
    """
    wanted, spot, bucket, bits, may = fresh(docs, "wanted", "spot", "bucket", "bits", "may")
    ids, columns = ids.toDF(wanted), [F.col(f"`{c}`") for c in docs.columns]
    how, own = "left_semi" if keep else "left_anti", F.col(f"`{column}`")
    if ids.count() <= broadcast_rows:
        return docs.join(F.broadcast(ids), own == F.col(wanted), how)
    place = lambda c: F.pmod(F.xxhash64(c, F.lit(29)), F.lit(_BITS))
    maps = ids.select(place(F.col(wanted)).alias("p")).groupBy(F.bitmap_bucket_number("p").alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias(bits))
    bit = f"(cast(conv(hex(substring({bits}, cast(bitmap_bit_position({spot}) div 8 as int) + 1, 1)), 16, 10) as int) >> cast(bitmap_bit_position({spot}) % 8 as int)) & 1"
    marked = docs.withColumn(spot, place(own)).join(F.broadcast(maps), F.bitmap_bucket_number(spot) == F.col(bucket), "left")
    marked = marked.withColumn(may, own.isNotNull() & F.coalesce(F.expr(bit) == 1, F.lit(False)))
    found = marked.filter(F.col(may)).select(columns).join(ids, own == F.col(wanted), how)
    return found if keep else found.unionByName(marked.filter(~F.col(may)).select(columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, fold: int = 5) -> DataFrame:
    """(doc_id, text, y) of at most `rows` labelled documents, those with the smallest hash of their id.

    Rows with crc32(doc_id as text) mod `fold` = 0 are held out. The sample is broadcast: `rows` bounds it.
    """
    picked = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y"))
        .filter(F.col("_id").isNotNull() & F.col("y").isin(0, 1) & (F.crc32(F.col("_id").cast("string")) % fold != 0))
        .groupBy("_id")
        .agg(F.min("y").alias("y"))
        .orderBy(F.xxhash64(F.col("_id"), F.lit(17)), "_id")
        .limit(rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "y")


# --- texts as bytes -------------------------------------------------------------------------------------------------

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_R = 0x9E3779B97F4A7C15
_POW = [np.ones(1, np.uint64)]
_INV = [np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        m = max(n, 1 << 18)
        for kept, base in ((_POW, _R), (_INV, pow(_R, -1, 1 << 64))):
            out = np.full(m, base, np.uint64)
            out[0] = 1
            kept[0] = np.cumprod(out, dtype=np.uint64)
    return _POW[0][:n], _INV[0][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array and the n + 1 offsets of its texts; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def blocks(texts: pa.Array, size: int = 1 << 17, rows: int = 256):
    """(first row, bytes, offsets) of runs of texts of about `size` bytes, `rows` at most; a longer text is a block of its own, whole."""
    data, off = as_bytes(texts)
    i, n = 0, len(off) - 1
    while i < n:
        j = min(max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1), i + rows)
        yield i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def lower_ascii(b: np.ndarray) -> np.ndarray:
    return np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint8)


def spans(split: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each run of bytes that aren't in `split`; runs end where a text does."""
    n = len(split)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = split[:-1], split[1:]
    before[off[:-1][off[:-1] < n]] = True
    after[off[1:][off[1:] > 0] - 1] = True
    starts = np.flatnonzero(~split & before)
    return starts, np.flatnonzero(~split & after) + 1, np.searchsorted(off, starts, "right") - 1


def prefix_hash(b: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over the bytes, modulo 2^64; span_hash() takes the hash of any span from them."""
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _powers(len(b) + 1)[0][: len(b)], out=out[1:])
    return out


def span_hash(p: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal spans have equal hashes wherever they stand."""
    return mix((p[ends] - p[starts]) * _powers(len(p))[1][starts])


def windows(words: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of n words of one text."""
    if len(words) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(text[: len(text) - n + 1] == text[n - 1 :])
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        h = mix(h + words[at + k] * np.uint64(2 * k + 3))
    return at, h


def per_text(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of a number per byte over each text."""
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


def auc(y: np.ndarray, s: np.ndarray) -> float:
    """Area under the ROC curve, ties counted half."""
    _, inv, n = np.unique(s, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[inv]
    pos = int((y == 1).sum())
    return float((rank[y == 1].sum() - pos * (pos + 1) / 2) / max(pos * (len(y) - pos), 1))
