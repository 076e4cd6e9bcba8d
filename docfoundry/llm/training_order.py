"""Token-ID output in training order: packed sequences, a keyed permutation of them, fixed-stride shards.

Documents' ids, each closed by an end mark, form one stream, cut into sequences of equal length. A Feistel permutation of
0 .. n - 1 (keyed, walked until inside) gives each sequence its slot. A shard is a range of slots and one partition; all its
records have the same number of bytes, so slot s lies in shard s div k at byte (s mod k) * stride, and reading can resume anywhere.
"""

from __future__ import annotations

import base64
from hashlib import blake2b
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

VOCABULARY = "byte_bpe_50k.tiktoken"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """One worker's byte-pair encoder."""

    _open: dict[str, Encoder] = {}

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = len(ranks)
        self.kind = np.dtype("<u2" if self.end < 1 << 16 else "<u4")

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def encode(self, text: str) -> bytes:
        return np.array(self.model.encode_ordinary(text), self.kind).tobytes()


class Permutation:
    """A keyed permutation of range(size): eight Feistel rounds over a square power of two, walked until inside."""

    def __init__(self, size: int, key: str, rounds: int = 8):
        self.size = size
        self.half = np.uint64(max(1, (max(size - 1, 1).bit_length() + 1) // 2))
        self.mask = (np.uint64(1) << self.half) - np.uint64(1)
        self.keys = [np.uint64(int.from_bytes(blake2b(f"{key}|{size}|{i}".encode(), digest_size=8).digest(), "big")) for i in range(rounds)]

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in reversed(self.keys) if back else self.keys:
            if back:
                left, right = right ^ (C.mix(left + k) & self.mask), left
            else:
                left, right = right, left ^ (C.mix(right + k) & self.mask)
        return (left << self.half) | right

    def __call__(self, x: np.ndarray, back: bool = False) -> np.ndarray:
        out = self._once(np.asarray(x).astype(np.uint64), back)
        while (outside := out >= np.uint64(self.size)).any():
            out[outside] = self._once(out[outside], back)
        return out.astype(np.int64)


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """(unit, file, block, at, doc_id, n, ids): each document's ids and the end mark, and where they begin in the stream of their unit.

    A unit is what one task reads of one block of a file, so files and blocks in order are the table in order, however it was split;
    rows that come from no file are in the order of their partitions. Written to the shared folder, so that places stay, whatever is
    lost later.
    """
    from_file = docs.select("doc_id", "text", F.input_file_name().alias("file"), F.expr("input_file_block_start()").alias("block"))

    def rows(batches):
        part, count, last, at, e = TaskContext.get().partitionId(), -1, None, 0, Encoder.at(path)
        end = np.array([e.end], e.kind).tobytes()
        for batch in batches:
            ids = [e.encode(t or "") + end for t in batch.column("text").to_pylist()]
            n = np.array([len(x) // e.kind.itemsize for x in ids], np.int64)
            unit, start = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for i, here in enumerate(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist())):
                if here != last:
                    last, count, at = here, count + 1, 0
                unit[i], start[i] = (part << 32) + count, at
                at += int(n[i])
            block = pa.array([b if f else part for f, b in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist())], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(unit), batch.column("file"), block, pa.array(start), batch.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(ids, pa.binary())], ["unit", "file", "block", "at", "doc_id", "n", "ids"])

    return C.materialise(from_file.mapInArrow(rows, "unit long, file string, block long, at long, doc_id long, n long, ids binary"), "tokens")


def training_order(docs: DataFrame, key: str = "epoch 0", length: int = 1024, per_shard: int = 8192, path: str | None = None) -> DataFrame:
    """One row for each sequence: slot, shard, byte_offset, sequence, n_tokens, doc_ids (in order) and record (ids, little-endian).

    The stream is the table in the order of its files, however tasks split them: the same key gives the same shards on any cluster.
    Partition i holds shard i in order of slots. The last sequence is filled up with end marks, which n_tokens doesn't count. A null
    or empty text is its end mark alone; a null id is a null in doc_ids. Repeated rows are encoded as often as they come. Without
    rows there are no sequences.
    """
    path = path or vocabulary_path()
    e = Encoder.at(path)
    end, kind = e.end, e.kind
    table = tokenised(C.bounded_batches(docs), path)
    sums = table.groupBy("unit").agg(F.sum("n").alias("k"), F.first("file").alias("file"), F.first("block").alias("block"))  # one row for each block read
    before = F.sum("k").over(Window.orderBy("file", "block", "unit").rowsBetween(Window.unboundedPreceding, -1))
    base = sums.select("unit", F.coalesce(before, F.lit(0)).alias("base"))
    total = table.agg(F.sum("n")).first()[0] or 0
    size = -(-total // length)
    stride = length * kind.itemsize + 1
    order = Permutation(max(size, 1), key)

    def pieces(batches):
        for batch in batches:
            starts = (np.array(batch.column("base")) + np.array(batch.column("at"))).tolist()
            out = {k: [] for k in ("sequence", "place", "doc_id", "ids")}
            for start, doc_id, ids in zip(starts, batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                at, stop = start, start + len(ids) // kind.itemsize
                while at < stop:
                    cut = min(stop, (at // length + 1) * length)
                    out["sequence"].append(at // length)
                    out["place"].append(at % length)
                    out["doc_id"].append(doc_id)
                    out["ids"].append(ids[(at - start) * kind.itemsize : (cut - start) * kind.itemsize])
                    at = cut
            slot = order(np.array(out["sequence"], np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot // per_shard, pa.int32()), pa.array(slot), pa.array(out["place"], pa.int32()), pa.array(out["sequence"], pa.int64()), pa.array(out["doc_id"], pa.int64()), pa.array(out["ids"], pa.binary())],
                ["shard", "slot", "place", "sequence", "doc_id", "ids"],
            )

    def records(batches):
        held: tuple | None = None  # the slot whose pieces are being gathered, its sequence, documents and ids
        for batch in batches:
            done = []
            for slot, sequence, doc_id, ids in zip(*(batch.column(c).to_pylist() for c in ("slot", "sequence", "doc_id", "ids"))):
                if held is None or held[0] != slot:
                    if held:
                        done.append(held)
                    held = (slot, sequence, [], [])
                held[2].append(doc_id)
                held[3].append(ids)
            yield from _emit(done)
        yield from _emit([held] if held else [])

    def _emit(done):
        if not done:
            return
        full = [b"".join(x[3]) for x in done]
        n = [len(x) // kind.itemsize for x in full]
        fill = np.array([end], kind).tobytes()
        slot = np.array([x[0] for x in done], np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(slot), pa.array(slot // per_shard, pa.int32()), pa.array(slot % per_shard * stride), pa.array([x[1] for x in done], pa.int64()), pa.array(n, pa.int32()), pa.array([x[2] for x in done], pa.list_(pa.int64())), pa.array([x + fill * (length - k) for x, k in zip(full, n)], pa.binary())],
            ["slot", "shard", "byte_offset", "sequence", "n_tokens", "doc_ids", "record"],
        )

    cut = table.join(F.broadcast(base), "unit").select("base", "at", "doc_id", "ids").mapInArrow(pieces, "shard int, slot long, place int, sequence long, doc_id long, ids binary")
    dealt = cut.repartitionById(max(1, -(-size // per_shard)), F.col("shard")).sortWithinPartitions("slot", "place")
    return dealt.mapInArrow(records, "slot long, shard int, byte_offset long, sequence long, n_tokens int, doc_ids array<long>, record binary")


def write_shards(ordered: DataFrame, folder: str) -> None:
    """Write what training_order() gave: folder/shard=i holds one file of records, each closed by a newline byte.

    Spark's own text writer and its commit protocol write the bytes: to any store that Spark reaches, once, though tasks be retried. A
    folder that exists already is an error, as in all of Spark's writers.
    """
    lines = ordered.sortWithinPartitions("shard", "slot").select("shard", F.col("record").cast("string").alias("value"))
    lines.write.partitionBy("shard").option("lineSep", "\n").option("compression", "none").text(folder)


def read_slots(spark: SparkSession, folder: str, first: int, count: int, length: int = 1024, per_shard: int = 8192, width: int = 2) -> DataFrame:
    """(slot, record) of the slots from `first` on, `count` of them or as many as there are.

    Only their shards are opened, and of those only the bytes of these slots are read: the stride gives their place. Files are opened by
    the tasks, in any store that pyarrow knows (local, HDFS, S3, GCS).
    """
    stride = length * width + 1
    shards = [f"{folder}/shard={i}" for i in range(first // per_shard, (first + max(count, 1) - 1) // per_shard + 1)]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    there = [s for s in shards if path(s).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path(s))]
    if not there or count < 1:
        return spark.createDataFrame([], "slot long, record binary")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(there)
    start = F.regexp_extract("path", r"shard=(\d+)", 1).cast("long") * per_shard
    begin, end = F.greatest(start, F.lit(first)), F.least(start + (F.col("length") / stride).cast("long"), F.lit(first + count))
    wanted = files.select("path", start.alias("start"), begin.alias("begin"), end.alias("end")).filter("begin < end")

    def read(batches):
        from pyarrow import fs

        for b in batches:
            for name, start, begin, end in zip(*(c.to_pylist() for c in b.columns)):
                store, at = fs.FileSystem.from_uri(quote(name, safe=":/"))
                with store.open_input_file(at) as f:
                    f.seek((begin - start) * stride)
                    for slot in range(begin, end, 1000):
                        n = min(1000, end - slot)
                        got = f.read(n * stride)
                        yield pa.RecordBatch.from_arrays([pa.array(range(slot, slot + n), pa.int64()), pa.array([got[i * stride : (i + 1) * stride - 1] for i in range(n)], pa.binary())], ["slot", "record"])

    return wanted.mapInArrow(read, "slot long, record binary")


def ids_of(record: Column, width: int = 2) -> Column:
    """The ids of a record."""

    @F.arrow_udf("array<int>")
    def unpack(records: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(r, f"<u{width}").astype(np.int32) for r in records.to_pylist()], pa.list_(pa.int32()))

    return unpack(record)
