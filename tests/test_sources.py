"""Files read by their heads, artefacts written, and the options that go to other sources."""

import os

from pyspark.sql import functions as F

from docfoundry.sources import files

HEADS = {"a.pdf": b" \r\n%PDF-1.7", "b.PNG": b"\x89PNG\r\n", "c.docx": b"PK\x03\x04", "d.jpg": b"\xff\xd8\xff\xe0", "e.gif": b"GIF89a", "f.bmp": b"BM", "g.tif": b"II*\x00", "h.tiff": b"MM\x00*", "i.webp": b"RIFF\x00\x00\x00\x00WEBP", "with space %20.pdf": b"%PDF"}
BAD = {"bom.pdf": b"\xef\xbb\xbf%PDF", "no.webp": b"RIFF\x00\x00\x00\x00WAVE", "text.png": b"hello", "x.exe": b"MZ", "empty.jpg": b"", "late.pdf": b" " * 20 + b"%PDF"}


def test_files_are_checked_by_their_heads(spark, tmp_path):
    for name, head in {**HEADS, **BAD}.items():
        (tmp_path / name).write_bytes(head + (b"x" * 5000 if name in HEADS else b""))
    with open(tmp_path / "huge.pdf", "wb") as f:  # a gigabyte with nothing in it
        f.write(b"%PDF-1.4")
        f.truncate(1 << 30)
    objects = files.list_objects(spark, str(tmp_path))
    read = files.read_heads(objects)
    rows = {os.path.basename(r["key"]): r for r in read.collect()}
    assert all(len(r["head"]) <= 16 for r in rows.values()) and read.count() == len(HEADS) + len(BAD)  # the empty one is not listed, the huge one is
    checked = files.validate_files(read.select(F.regexp_extract("key", "[^/]+$", 0).alias("name"), F.col("head").alias("content"))).collect()
    valid = {r["name"] for r in checked if r["is_valid"]}
    assert {*HEADS, "huge.pdf"} <= valid and not valid & set(BAD)
    gone = objects.limit(1).withColumn("key", F.concat("key", F.lit(".gone"))).unionByName(objects.limit(1).withColumn("key", F.lit(None).cast("string")))
    assert [r["head"] for r in files.read_heads(gone).collect()] == [None, None]


class Reader:
    """Stands for spark.read and spark.readStream; notes what is asked of it."""

    def __init__(self):
        self.asked = {}

    def format(self, kind):
        self.asked["format"] = kind
        return self

    def options(self, **options):
        self.asked |= options
        return self

    def load(self):
        return self.frame


def test_options_of_other_sources(spark):
    class Session:
        read, readStream = Reader(), Reader()

    Session.read.frame = spark.range(1)
    bounds = {"partitionColumn": "id", "lowerBound": "0", "upperBound": "100", "numPartitions": "4"}
    assert set(files.load_tables(Session, "jdbc:x://host/db", ["document"], bounds)) == {"document"}
    assert Session.read.asked == {"format": "jdbc", "url": "jdbc:x://host/db", "dbtable": "document", **bounds}
    Session.readStream.frame = spark.createDataFrame([(bytearray(b'{"a":1}'), None, 3)], "value binary, timestamp timestamp, offset long")
    got = files.read_ocr_events(Session, "events", {"kafka.bootstrap.servers": "h:9", "startingOffsets": "earliest"})
    assert got.columns == ["data", "ts"] and got.first()["data"] == '{"a":1}'
    assert Session.readStream.asked == {"format": "kafka", "subscribe": "events", "kafka.bootstrap.servers": "h:9", "startingOffsets": "earliest"}


def test_packed_pages_are_read_as_files_of_lists_are(spark, tmp_path):
    rows = [(d, i, f"line\n\"{d}\" é {i}", {"k.jpg": "x"}) for d in range(7) for i in reversed(range(3))] + [(8, 0, None, None)]
    pages = spark.createDataFrame(rows, "doc_id long, page_index int, markdown string, images map<string,string>").repartition(3)
    files.pack_ocr_pages(pages, str(tmp_path / "packed"))
    got = files.read_packed_pages(spark, str(tmp_path / "packed"))
    key = lambda r: (r[0], r[1])
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(rows, key=key)
    # few files, however many documents
    files.pack_ocr_pages(spark.range(500).selectExpr("id as doc_id", "0 as page_index", "'x' as markdown", "map('k', 'v') as images"), str(tmp_path / "many"))
    assert files.read_packed_pages(spark, str(tmp_path / "many")).count() == 500
    assert len(list((tmp_path / "many").glob("part-*"))) <= 8
