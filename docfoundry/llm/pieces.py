"""SentencePiece encoding and decoding by tables of distinct chunks, one in each worker, bounded and refilled.

No piece of the model holds a whitespace marker after another character, nor a newline. So the segmentation of a text is the
concatenation of those of its chunks, each a run of markers with what follows, or a newline with what follows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

MODEL = "piece_bpe_32k.model"
_MARK = "▁"
_CHUNK = re.compile(f"{_MARK}+[^{_MARK}\n]*|\n[^{_MARK}\n]*")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """One worker's model, with the chunks that it has segmented so far: at most `most` of them are held."""

    _open: dict[str, Pieces] = {}

    def __init__(self, path: str, most: int = 100_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(_MARK in p.lstrip(_MARK) or "\n" in p for p in pieces):
            raise ValueError(f"pieces of {path} cross whitespace markers")
        self.alone = np.array([self.model.piece_to_id(_MARK)], np.int32).tobytes()  # a marker with nothing after it
        self.known: dict[str, bytes] = {}
        self.most = most

    @classmethod
    def at(cls, path: str) -> Pieces:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def learn(self, chunks: set[str]) -> None:
        """Segment chunks that the table doesn't hold yet, each once."""
        new = [c for c in chunks if c not in self.known]
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = list(chunks)
        # encode() puts a marker before what it gets: it stands for the first one of a chunk, and is cut off before a newline
        for c, ids in zip(new, self.model.encode([c if c[0] == "\n" else c[1:] for c in new], num_threads=1)):
            self.known[c] = np.array(ids[1:] if c[0] == "\n" else ids, np.int32).tobytes() or self.alone

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        chunks = _CHUNK.findall(_MARK + text.replace(" ", _MARK))
        get = self.known.get
        got = [get(c) for c in chunks]
        if None in got:
            self.learn(set(chunks))
            got = [self.known[c] for c in chunks]
        return np.frombuffer(b"".join(got), np.int32)


def encode(text: Column, path: str | None = None) -> Column:
    """The ids of each text (array<int>), without begin or end ids; a null or empty text has none."""
    path = path or model_path()

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        p = Pieces.at(path)
        got = [p.encode(t or "") for t in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, got)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*got, np.zeros(0, np.int32)])))

    return ids(text)


def decode(ids: Column, path: str | None = None) -> Column:
    """The text of each array of ids; that of null or an empty array is empty."""
    path = path or model_path()

    @F.arrow_udf("string")
    def text(lists: pa.Array) -> pa.Array:
        return pa.array([Pieces.at(path).model.decode(x) if x else "" for x in lists.to_pylist()], pa.string())

    return text(ids)


def round_trip(text: Column, path: str | None = None) -> Column:
    """A struct of ids and the text decoded from them, in one pass."""
    path = path or model_path()

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def both(texts: pa.Array) -> pa.Array:
        p = Pieces.at(path)
        got = [p.encode(t or "") for t in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, got)])
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*got, np.zeros(0, np.int32)])))
        return pa.StructArray.from_arrays([ids, pa.array([p.model.decode(x.tolist()) if len(x) else "" for x in got], pa.string())], ["ids", "decoded"])

    return both.asNondeterministic()(text)


def tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and decoded of every document, one row for each row.

    Texts are taken whole. A null or empty text has no ids and decodes to an empty one; a null id stays null; repeated rows are encoded
    alike. Extra columns, whatever their names, are not read; an empty table gives none back.
    """
    p = bounded_batches(docs).select("doc_id", round_trip(F.col("text"), path).alias("p"))
    return p.select("doc_id", "p.ids", "p.decoded")


def digests(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas) and decoded_sha256 of every document, and ids if asked for; rows and
    odd texts as in tokens()."""
    t = tokens(docs, path)
    return t.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        *(["ids"] if with_ids else []),
    )
