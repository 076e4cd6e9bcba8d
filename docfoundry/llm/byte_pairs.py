"""Byte-level BPE encoding and decoding, with a segment tree over the bytes of each word.

A word is a match of the splitting pattern. Its tree has a leaf for each byte: the rank of the pair that the token starting there makes
with the next one. Each node holds the least rank below it and the leftmost leaf that has it, so the root tells the next merge. A merge
changes the pairs of the token left of it, of the merged token, and of the one that is gone: three leaves and what is above them. Short
words of like size are merged side by side, a tree in each row of an array; a long one has a tree of its own.

Each worker remembers a bounded number of words, so frequent ones are merged once.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

RANKS = "byte_bpe_multi_50k.tiktoken"
_NONE = np.int64(1) << 62  # the rank of what is no pair
_CELLS = 1 << 21  # of trees that are merged side by side: 16 MB, whatever the number of words
_SHORT = 64  # bytes of words that are merged side by side


def ranks_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Merges:
    """A table of ranks: the rank of a token is its id, that of a pair the id of what the two make."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ids = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ids.items()}
        if any(bytes([b]) not in self.ids for b in range(256)):
            raise ValueError(f"{path} lacks single bytes")
        self.byte = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        found = {}
        for token, rank in self.ids.items():
            for cut in range(1, len(token)):
                left, right = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if left is not None and right is not None:
                    found[left << 32 | right] = rank
        self.pairs = found
        self.keys = np.array(sorted(found), np.int64)
        self.made = np.array([found[k] for k in self.keys.tolist()], np.int64)
        self.two = self.pair(np.repeat(self.byte, 256), np.tile(self.byte, 256)).reshape(256, 256)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens; _NONE where the two make no token, or one of them is -1."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.made[at], _NONE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, little-endian, four bytes each; no word is empty."""
        out: list[bytes] = [b""] * len(words)
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            whole = self.ids.get(w)
            if whole is not None:  # as the library does, before any merge
                out[i] = whole.to_bytes(4, "little")
            elif len(w) > _SHORT:
                out[i] = self._alone(w)
            else:
                by.setdefault((len(w) - 1).bit_length(), []).append(i)
        for bits, those in by.items():
            step = max(1, _CELLS >> bits)
            for at in range(0, len(those), step):
                some = those[at : at + step]
                for i, ids in zip(some, self._side_by_side([words[i] for i in some], 1 << bits)):
                    out[i] = ids
        return out

    def _alone(self, word: bytes) -> bytes:
        """The ids of one word, in time of its length times the logarithm of it."""
        n, none, pairs = len(word), int(_NONE), self.pairs
        size = 1 << (n - 1).bit_length()
        token = self.byte[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * size)
        for i in range(n - 1):
            rank = pairs.get(token[i] << 32 | token[i + 1])
            if rank is not None:
                tree[size + i] = rank << 32 | i
        for cell in range(size - 1, 0, -1):
            tree[cell] = min(tree[2 * cell], tree[2 * cell + 1])

        def put(at: int, rank: int | None) -> None:
            cell = size + at
            tree[cell] = none if rank is None else rank << 32 | at
            while cell > 1:
                cell >>= 1
                least = min(tree[2 * cell], tree[2 * cell + 1])
                if tree[cell] == least:
                    return
                tree[cell] = least

        while tree[1] < none:
            rank, at = tree[1] >> 32, tree[1] & 0xFFFFFFFF
            gone = after[at]
            far = after[at] = after[gone]
            token[at], token[gone] = rank, -1
            put(gone, None)
            if far < n:
                before[far] = at
            put(at, pairs.get(rank << 32 | token[far]) if far < n else None)
            left = before[at]
            if left >= 0:
                put(left, pairs.get(token[left] << 32 | rank))
        return np.array([t for t in token if t >= 0], "<u4").tobytes()

    def _side_by_side(self, words: list[bytes], size: int) -> list[bytes]:
        n = len(words)
        sizes = np.array([len(w) for w in words])
        grid = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), np.uint8).reshape(n, size)
        place = np.arange(size)
        token = np.where(place < sizes[:, None], self.byte[grid], -1)  # of a live position; -1 where none starts
        after = np.minimum(place + 1, sizes[:, None])  # the next live position, the word's length after the last
        before = np.broadcast_to(place - 1, (n, size)).copy()
        # leaves hold rank << 32 | position, so the least value is the leftmost least rank; the tree's root is cell 1
        rank = np.full((n, size), _NONE)
        rank[:, :-1] = np.where(place[1:] < sizes[:, None], self.two[grid[:, :-1], grid[:, 1:]], _NONE)
        tree = np.empty((n, 2 * size), np.int64)
        tree[:, size:] = np.where(rank == _NONE, _NONE, rank << 32 | place)
        level = size
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        rows = np.flatnonzero(tree[:, 1] < _NONE)
        while len(rows):
            root = tree[rows, 1]
            at = root & 0xFFFFFFFF
            gone = after[rows, at]
            token[rows, at] = root >> 32
            token[rows, gone] = -1
            far = after[rows, gone]
            after[rows, at] = far
            more = far < sizes[rows]
            before[rows[more], far[more]] = at[more]
            left = before[rows, at]
            self._set(tree, size, rows, gone, np.full(len(rows), _NONE))
            right = np.where(more, token[rows, np.minimum(far, size - 1)], -1)
            self._set(tree, size, rows, at, self.pair(token[rows, at], right))
            has = left >= 0
            self._set(tree, size, rows[has], left[has], self.pair(token[rows[has], left[has]], token[rows[has], at[has]]))
            rows = rows[tree[rows, 1] < _NONE]
        live = token >= 0
        flat, ends = token[live].astype("<u4").tobytes(), [0, *(4 * np.cumsum(live.sum(axis=1))).tolist()]
        return [flat[a:b] for a, b in zip(ends, ends[1:])]

    @staticmethod
    def _set(tree: np.ndarray, size: int, rows: np.ndarray, at: np.ndarray, rank: np.ndarray) -> None:
        """Give one leaf of each row a rank, and the nodes above it what is least below them now."""
        cell = size + at
        tree[rows, cell] = np.where(rank == _NONE, _NONE, rank << 32 | at)
        while size > 1:
            cell >>= 1
            size >>= 1
            tree[rows, cell] = np.minimum(tree[rows, 2 * cell], tree[rows, 2 * cell + 1])


class Words:
    """One worker's ranks and pattern, with the words that it has merged lately: at most twice `most` of them are held."""

    _open: dict[tuple[str, str], Words] = {}

    def __init__(self, path: str, pattern: str, most: int = 100_000):
        import regex

        self.merges, self.split, self.most = Merges(path), regex.compile(pattern), most
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    def at(cls, path: str, pattern: str) -> Words:
        if (path, pattern) not in cls._open:
            cls._open[path, pattern] = cls(path, pattern)
        return cls._open[path, pattern]

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids (little-endian, four bytes each) of words that `known` lacks; they are remembered in place of the oldest."""
        got = {w: self.older[w] for w in words if w in self.older}
        new = [w for w in words if w not in got]
        got |= zip(new, self.merges.merge([w.encode() for w in new]))
        if len(self.known) + len(got) > self.most:
            self.older, self.known = self.known, {}
        if len(got) <= self.most:
            self.known |= got
        return got

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, little-endian, four bytes each. The words of all texts that aren't known are merged together."""
        find, get = self.split.findall, self.known.get
        words = [find(t) if t else [] for t in texts]
        got = [[get(w) for w in ws] for ws in words]
        missing = {w for ws, ids in zip(words, got) if None in ids for w, i in zip(ws, ids) if i is None}
        if missing:
            learnt = self._learn(missing)
            got = [[learnt[w] if i is None else i for w, i in zip(ws, ids)] if None in ids else ids for ws, ids in zip(words, got)]
        return [b"".join(ids) for ids in got]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.merges.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(text: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """The ids of each text (array<int>), without special tokens; a null or empty text has none."""
    path, pattern = path or ranks_path(), pattern or public_pattern()

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        got = Words.at(path, pattern).encode(texts.to_pylist())
        ends = np.cumsum([0, *(len(x) // 4 for x in got)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(got), "<i4")))

    return ids(text)


def decode(ids: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """The bytes that each array of ids stands for; null or an empty array stands for none. An id outside the ranks is an error."""
    path, pattern = path or ranks_path(), pattern or public_pattern()

    @F.arrow_udf("binary")
    def text(lists: pa.Array) -> pa.Array:
        w = Words.at(path, pattern)
        return pa.array([w.decode(np.array(x or [], "<u4").tobytes()) for x in lists.to_pylist()], pa.binary())

    return text(ids)


def round_trip(text: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """A struct of ids (packed: little-endian, four bytes each) and the bytes decoded from them, in one pass."""
    path, pattern = path or ranks_path(), pattern or public_pattern()

    @F.arrow_udf("struct<packed:binary,decoded:binary>")
    def both(texts: pa.Array) -> pa.Array:
        w = Words.at(path, pattern)
        got = w.encode(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(got, pa.binary()), pa.array([w.decode(x) for x in got], pa.binary())], ["packed", "decoded"])

    return both.asNondeterministic()(text)


def tokens(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, packed ids and decoded bytes of every document, one row for each row.

    Texts are taken whole, and each match of the pattern is encoded by itself, however long. A null or empty text has no ids and decodes
    to nothing; a null id stays null; repeated rows are encoded alike. Extra columns, whatever their names, are not read; an empty table
    gives none back.
    """
    p = bounded_batches(docs).select("doc_id", round_trip(F.col("text"), path, pattern).alias("p"))
    return p.select("doc_id", "p.packed", "p.decoded")


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the packed ids) and decoded_sha256 of every document; rows and odd texts as in tokens()."""
    t = tokens(docs, path, pattern)
    return t.select("doc_id", (F.length("packed") / 4).cast("long").alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
