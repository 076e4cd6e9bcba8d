"""Parity-sketch join: near-duplicate texts by the Jaccard similarity of their word shingles, exactly and without all pairs.

Each set XORs the 64-bit hashes of its shingles into the words of a sketch; a shingle touches one word. So the Hamming distance
of two sketches, counted in words, is at most the sets' symmetric difference, which the similarity bounds:
J >= t means |A ^ B| <= (1 - t) / (1 + t) * (|A| + |B|). Sketches have a length for each band of sizes (powers of two); a set
takes part in its own band and, where it can be the larger of a pair, in the one below. By the pigeonhole principle two similar
sets agree in all non-empty words of either but so many; hence any `bound + 1` non-empty words of either, taken in an order
that all sets share, have one in common. The order is rarest first by the number of sets that hold a word, so words of
passages that many texts share are hardly ever needed, and a set whose words are unique enough drops out at once.

Words that sets share give pairs to verify: first, in a few rounds, sets with one set of a word's largest component, which joins
up the large groups; then, for words that still touch several components, all pairs across them, in blocks where a word has many.
Pairs are verified on the 64-bit hashes of all their shingles; sets whose 63-bit ids are equal count as equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .graph import components

_LOW48 = np.uint64((1 << 48) - 1)
HOT = 2**31 - 1


def shingles(b: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct word n-grams of each text, sorted; a text of fewer words has one of them all."""
    low = C.lower_ascii(b)
    s, e, t = C.spans(C.SPACE[low], off)
    w = C.span_hash(C.prefix_hash(low), s, e)
    at, h = C.windows(w, t, n)
    text = t[at]
    count = np.bincount(t, minlength=len(off) - 1)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        first = np.searchsorted(t, short)
        extra = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            on = count[short] > k
            extra[on] = C.mix(extra[on] + w[first[on] + k] * np.uint64(2 * k + 3))
        text, h = np.concatenate([text, short]), np.concatenate([h, C.mix(extra + np.uint64(77))])
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
    return text[fresh], h[fresh]


def _set_ids(text: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A 63-bit id of each text's whole set, and its size."""
    size = np.bincount(text, minlength=k)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(C.mix(h ^ np.uint64(0xA5A5)), dtype=np.uint64)])
    ends = np.cumsum(size)
    return (C.mix((sums[ends] - sums[ends - size]) + size.astype(np.uint64)) >> np.uint64(1)).astype(np.int64), size


def _signature(x: np.ndarray, band: int) -> np.ndarray:
    return (C.mix(x + np.uint64(band)) & (_LOW48 ^ np.uint64(31))) | np.uint64(band)


class Bands:
    """Sketch lengths and bounds for a similarity of num / den at least."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    @staticmethod
    def words(band: int) -> int:
        top = (2 << band) - 1
        return 4 * top if top < 64 else top if top < 512 else top // 2 + 1

    def bound(self, size: int, partner: int) -> int:
        """The greatest symmetric difference of similar sets of these sizes."""
        return (self.den - self.num) * (size + partner) // (self.den + self.num)

    def of(self, size: int) -> list[tuple[int, int]]:
        """(band, bound) of each band that a set of this size takes part in."""
        own = size.bit_length() - 1
        out = [(own, self.bound(size, self.den * size // self.num))]
        below = (1 << own) - 1
        if below and self.den * below >= self.num * size:
            out.append((own - 1, self.bound(size, below)))
        return out

    def free(self, h: np.ndarray) -> list[int]:
        """For each band of a set: how many non-empty words it has beyond bound + 1; negative where it has fewer."""
        return [len(np.unique(self.places(h, band))) + self.lost(h, band, bound) - bound - 1 for band, bound in self.of(len(h))]

    def lost(self, h: np.ndarray, band: int, bound: int) -> int:
        """1 for a set with too few non-empty words for the pigeonhole principle: it gets one more, which all such sets of a band share."""
        return int(len(h) <= 0 or len(np.unique(self.places(h, band))) <= bound)

    def places(self, h: np.ndarray, band: int) -> np.ndarray:
        return ((h >> np.uint64(32)) * np.uint64(self.words(band))) >> np.uint64(32)

    def sketch(self, h: np.ndarray, band: int) -> np.ndarray:
        """A 48-bit signature of each non-empty word of a set's sketch: of its place and the XOR of its shingles, and in 5 bits its band."""
        place = self.places(h, band)
        order = np.argsort(place, kind="stable")
        place = place[order]
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        parity = np.bitwise_xor.reduceat(C.mix(h[order] + np.uint64(band)), first)
        return _signature(parity + place[first] * np.uint64(0x9E3779B97F4A7C15), band)


def set_of(text: Column, n: int, bands: Bands) -> Column:
    """A struct of set_id (null without words; equal for equal sets), the number of distinct shingles, and free() of the set."""

    @F.arrow_udf("struct<set_id:bigint,n:bigint,free:array<int>>")
    def ids(texts: pa.Array) -> pa.Array:
        one, size, free = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for _, b, off in C.blocks(texts):
            text, h = shingles(b, off, n)
            ids, k = _set_ids(text, h, len(off) - 1)
            ends = np.cumsum(k)
            free += [bands.free(h[e - m : e]) if m else [] for e, m in zip(ends, k)]
            one.append(ids)
            size.append(k)
        one, size = np.concatenate(one), np.concatenate(size)
        return pa.StructArray.from_arrays([pa.array(one, mask=size == 0), pa.array(size.astype(np.int64)), pa.array(free, pa.list_(pa.int32()))], ["set_id", "n", "free"])

    return ids.asNondeterministic()(text)


def _pack(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


_PACKED = "part int, node binary, run binary, sig binary, marker boolean, hot boolean"
_WORDS = "node long, sig long, df int"


def _flush(found: list, parts: int, often: int):
    """Rows of _PACKED, one for each part, of the sketches (node, signatures) of a run of texts."""
    if not found:
        return
    owner = np.repeat(np.arange(len(found)), [len(x[1]) for x in found])
    sig = np.concatenate([x[1] for x in found])
    node = np.array([x[0] for x in found], np.int64)
    values, inv, count = np.unique(sig, return_inverse=True, return_counts=True)
    hot = count > often
    rows = {k: [] for k in ("part", "node", "run", "sig", "marker", "hot")}

    def put(part: np.ndarray, on: np.ndarray, is_hot: bool) -> None:
        order = on[np.lexsort((owner[on], part))]
        part = np.sort(part)
        for group in np.split(np.arange(len(order)), np.flatnonzero(np.diff(part)) + 1) if len(order) else ():
            who, n = np.unique(owner[order[group]], return_counts=True)
            add(int(part[group[0]]), node[who].tobytes(), n.astype(np.uint16).tobytes(), _pack(sig[order[group]]), False, is_hot)

    def add(*row) -> None:
        for k, v in zip(rows, row):
            rows[k].append(v)

    cold = np.flatnonzero(~hot[inv])
    put(((sig[cold] * np.uint64(parts)) >> np.uint64(48)).astype(np.int64), cold, False)
    if hot.any():  # a word of very many of these sets: its count goes on once, its sets go by their own ids
        on = np.flatnonzero(hot[inv])
        put(parts + node[owner[on]] % parts, on, True)
        at = (values[hot] * np.uint64(parts)) >> np.uint64(48)
        for p in np.unique(at):
            add(int(p), b"", b"", _pack(values[hot][at == p]), True, False)
    kinds = [("part", pa.int32()), *((k, pa.binary()) for k in ("node", "run", "sig")), ("marker", pa.bool_()), ("hot", pa.bool_())]
    yield pa.RecordBatch.from_pydict(rows, schema=pa.schema(kinds))


def sketch_words(docs: DataFrame, n: int, bands: Bands, parts: int, often: int = 64, held: int = 400_000) -> DataFrame:
    """The signatures of all sets, packed by `parts` ranges of signatures; within a task equal sets count once."""

    def pack(batches):
        found, waiting, seen = [], 0, set()
        for batch in batches:
            for _, b, off in C.blocks(batch.column("text")):
                text, h = shingles(b, off, n)
                ids, size = _set_ids(text, h, len(off) - 1)
                ends = np.cumsum(size)
                for i in np.flatnonzero(size):
                    if int(ids[i]) in seen:
                        continue
                    if len(seen) < 200_000:
                        seen.add(int(ids[i]))
                    for band, bound in bands.of(int(size[i])):
                        words = bands.sketch(h[ends[i] - size[i] : ends[i]], band)
                        if len(words) <= bound:  # see Bands.lost
                            words = np.append(words, _signature(np.zeros(1, np.uint64), band))
                        for k in range(0, len(words), 60_000):
                            found.append((ids[i], words[k : k + 60_000]))
                        waiting += len(words)
                if waiting > held:
                    yield from _flush(found, parts, often)
                    found, waiting = [], 0
        yield from _flush(found, parts, often)

    return docs.select("text").mapInArrow(pack, _PACKED)


def shared_words(packed: DataFrame) -> DataFrame:
    """(node, sig, df) of the words that at least two sets hold; df: how many do, or HOT where a task saw very many."""

    def count(group: pa.Table) -> pa.Table:
        marked, nodes, sigs, out = np.zeros(0, np.uint64), [], [], []
        hot = False
        for r in group.to_pylist():
            sig = _unpack(r["sig"])
            if r["marker"]:
                marked = np.union1d(marked, sig)
                continue
            hot |= r["hot"]
            nodes.append(np.repeat(np.frombuffer(r["node"], np.int64), np.frombuffer(r["run"], np.uint16)))
            sigs.append(sig)
        if sigs:
            node, s = np.concatenate(nodes), np.concatenate(sigs)
            order = np.lexsort((node, s))
            node, s = node[order], s[order]
            fresh = np.ones(len(s), bool)
            fresh[1:] = (s[1:] != s[:-1]) | (node[1:] != node[:-1])  # equal sets of several tasks
            node, s = node[fresh], s[fresh]
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            times = np.diff(np.append(first, len(s)))
            df = np.where(np.isin(s[first], marked) | hot, HOT, times).astype(np.int32)
            keep = np.repeat(df > 1, times)
            out = [node[keep], s[keep].astype(np.int64), np.repeat(df, times)[keep]]
        return pa.table(dict(zip(("node", "sig", "df"), out or (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)))))

    return packed.groupBy("part").applyInArrow(count, _WORDS)


def prefixes(shared: DataFrame, frees: DataFrame) -> DataFrame:
    """(sig, node, rank): of each set's words the first `bound + 1` in order of df, as far as other sets hold them.

    A word of one set alone comes before all others. frees: (node, n, free), free being how many words a set has beyond bound + 1
    in its own band and the one below; with k shared words, k - free of them are needed. A word that came both as a hot and as
    another one may stand twice here: that adds words, and takes none away.
    """
    own = F.floor(F.log2(F.col("n").cast("double")) + 1e-9).cast("int")
    joined = shared.join(frees, "node").withColumn("band", F.col("sig").bitwiseAND(31).cast("int"))
    joined = joined.withColumn("spare", F.when(F.col("band") == own, F.col("free")[0]).otherwise(F.col("free")[1]))
    of_set = Window.partitionBy("node", "band")
    ranked = joined.withColumns({"k": F.count("*").over(of_set), "rank": F.row_number().over(of_set.orderBy("df", "sig"))})
    return ranked.filter("rank <= k - spare").select("sig", "node", "rank")


def _bodies(nodes: DataFrame, docs: DataFrame, known: DataFrame, n: int, rows: int, scratch: C.Scratch, broadcast_rows: int = 200_000) -> DataFrame:
    """(node, body) of these sets (node), written: the sorted shingle hashes, made again from the text of each set's first document."""

    @F.arrow_udf("struct<node:bigint,body:binary>")
    def bodies(texts: pa.Array) -> pa.Array:
        node, body = [], []
        for _, b, off in C.blocks(texts):
            text, h = shingles(b, off, n)
            ids, size = _set_ids(text, h, len(off) - 1)
            ends = np.cumsum(size)
            node += ids.tolist()
            body += [h[e - s : e].tobytes() for e, s in zip(ends, size)]
        return pa.StructArray.from_arrays([pa.array(node, pa.int64()), pa.array(body, pa.binary())], ["node", "body"])

    first = scratch.keep(known.join(nodes, "node", "left_semi").select("first_id").distinct(), "texts", rows)
    body = C.select_ids(docs, first, broadcast_rows=broadcast_rows).select(bodies.asNondeterministic()("text").alias("s")).select("s.node", "s.body")
    # documents that share an id with a first one are no reason to keep their sets
    return scratch.keep(body.join(nodes, "node", "left_semi").dropDuplicates(["node"]), "bodies", rows, 8_000)


def verified(pairs: DataFrame, body: DataFrame, bands: Bands) -> DataFrame:
    """Those of the pairs (a, b) of sets whose similarity is num / den at least."""

    @F.arrow_udf("boolean")
    def similar(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left, right):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(bands.den * both >= bands.num * (len(x) + len(y) - both))
        return pa.array(out, pa.bool_())

    left, right = (body.select(F.col("node").alias(k), F.col("body").alias(f"{k}_body")) for k in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").filter(similar("a_body", "b_body")).select("a", "b")


def block_links(outside: DataFrame, members: DataFrame, body: DataFrame, bands: Bands, block: int = 128) -> DataFrame:
    """(a, b): the similar pairs of a set of `outside` and one of `members` (main, node, root) of the same main and different roots.

    Both sides are cut into blocks; a task's group holds one block of either, and only links leave it.
    """

    def dealt(rows: DataFrame, other: DataFrame, side: int) -> DataFrame:
        blocks = lambda x, k: x.groupBy("main").agg(F.ceil(F.count("*") / block).cast("int").alias(k))
        x = rows.join(blocks(rows, "own"), "main").join(blocks(other, "other"), "main").join(body, "node")
        at, to = F.pmod(F.xxhash64("node"), "own").cast("int"), F.explode(F.sequence(F.lit(0), F.col("other") - 1))
        x = x.withColumn("at", at).withColumn("to", to)
        i, j = ("at", "to") if side == 0 else ("to", "at")
        return x.select("main", F.col(i).alias("i"), F.col(j).alias("j"), F.lit(side).alias("side"), "node", "root", "body")

    def compare(group: pa.Table) -> pa.Table:
        side, node, root = (np.array(group[k]) for k in ("side", "node", "root"))
        bodies = [np.frombuffer(b.as_buffer(), np.uint64) for chunk in group["body"].chunks for b in chunk]
        size = np.array([len(b) for b in bodies])
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        found = []
        if len(left) and len(right):
            every = np.concatenate([bodies[k] for k in right])
            owner = np.repeat(np.arange(len(right)), size[right])
            for k in left:
                x = bodies[k]
                at = np.minimum(np.searchsorted(x, every), len(x) - 1)
                both = np.bincount(owner[x[at] == every], minlength=len(right))
                ok = (bands.den * both >= bands.num * (size[k] + size[right] - both)) & (root[right] != root[k])
                found += [(max(node[k], y), min(node[k], y)) for y in node[right[ok]]]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    both = dealt(outside, members, 0).unionByName(dealt(members, outside, 1))
    return both.groupBy("main", "i", "j").applyInArrow(compare, "a long, b long")


def linked_sets(docs: DataFrame, known: DataFrame, n: int, bands: Bands, rows: int, scratch: C.Scratch, part_words: int = 1_000_000, rounds: int = 3, picks: int = 8, few_pairs: int = 64) -> DataFrame:
    """(node, root) of every set that is similar to another one, directly or over others.

    known: (node, n, free, first_id, copies), one row for each set; rows: the number of documents.
    """
    words = known.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-words // part_words))
    packed = sketch_words(docs, n, bands, parts).repartition(max(parts, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "part")
    prefix = scratch.keep(prefixes(shared_words(packed), known.select("node", "n", "free")), "prefixes", 8 * rows)
    a, b = (known.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}")) for k in ("a", "b"))

    def fitting(pairs: DataFrame) -> DataFrame:
        with_sizes = pairs.distinct().join(a, "a").join(b, "b")
        return with_sizes.filter(f"{bands.den} * least(n_a, n_b) >= {bands.num} * greatest(n_a, n_b)").select("a", "b")

    def check(pairs: DataFrame) -> DataFrame:
        own = C.Scratch(docs.sparkSession)
        body = _bodies(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), docs, known, n, rows, own)
        found = scratch.keep(verified(pairs, body, bands), "links", rows)
        own.drop()
        return found

    tried = links = None
    placed = prefix.withColumn("root", F.col("node"))
    for seed in range(rounds):
        turn = scratch.keep(fitting(star_pairs(placed, seed, picks)), "pairs", rows)
        tried = turn if tried is None else tried.union(turn)
        new = check(turn)
        if not new.head(1):
            break
        links = new if links is None else links.union(new)
        placed = scratch.keep(open_words(prefix, components(links, scratch, rows)), "open", rows)
    few, outside, members = across(placed, few_pairs)
    new = check(scratch.keep(fitting(few.join(tried, ["a", "b"], "left_anti")), "pairs", rows))
    members = scratch.keep(members, "members", rows)
    if members.head(1):
        body = _bodies(members.select("node").distinct(), docs, known, n, rows, scratch)
        new = new.union(scratch.keep(block_links(scratch.keep(outside, "outside", rows), members, body, bands), "links", rows))
    return components(new if links is None else links.union(new), scratch, rows)


def open_words(prefix: DataFrame, roots: DataFrame) -> DataFrame:
    """prefix rows with their set's component, of words that touch several components."""
    placed = prefix.join(roots, "node", "left").select("sig", "node", F.coalesce("root", "node").alias("root"))
    several = placed.groupBy("sig").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select("sig")
    return placed.join(several, "sig", "left_semi")


def _pair(x: str, y: str) -> list[Column]:
    return [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]


def star_pairs(placed: DataFrame, seed: int, picks: int) -> DataFrame:
    """(a, b): each set looks at `picks` of its words, those with the smallest hashes, which similar sets choose alike; of those that
    chose a word, sets outside the word's largest component meet one set in it."""
    w = Window.partitionBy("node").orderBy(F.xxhash64("sig", F.lit(seed)), "sig")
    chosen = placed.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= picks)
    by_root = chosen.groupBy("sig", "root").agg(F.count("*").alias("k"), F.min_by("node", F.xxhash64("node", "sig", F.lit(seed))).alias("centre"))
    main = by_root.groupBy("sig").agg(F.max_by(F.struct("root", "centre"), F.struct("k", F.xxhash64("root", F.lit(seed)))).alias("m"), F.count("*").alias("roots")).filter("roots > 1")
    return chosen.join(main, "sig").filter("root <> m.root").select(*_pair("node", "m.centre")).distinct()


def across(placed: DataFrame, few_pairs: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is left to compare: sets that share a word and belong to different components.

    Pairs (a, b) for words with at most `few_pairs` of them; for the other words, (main, node, root) of the sets outside the largest
    component, and of all sets, gathered by that component: two rows for a set, in however many of its words they meet.
    """
    sizes = placed.groupBy("sig", "root").count().groupBy("sig").agg(F.max_by(F.struct("root", "count"), F.struct("count", "root")).alias("m"), F.sum("count").alias("k"))
    many = (F.col("k") - F.col("m.count")) * F.col("k") > few_pairs
    known = placed.join(sizes.select("sig", F.col("m.root").alias("main"), many.alias("many")), "sig")
    light = known.filter("not many")
    x = light.filter("root <> main").select("sig", F.col("node").alias("x"), F.col("root").alias("x_root"))
    pairs = x.join(light, (x["sig"] == light["sig"]) & (x["x_root"] != light["root"])).select(*_pair("x", "node")).distinct()
    heavy = known.filter("many").select("main", "node", "root").distinct()
    return pairs, heavy.filter("root <> main"), heavy


def jaccard_join(docs: DataFrame, n: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of every document, one row for each row.

    Words are runs other than space and 0x09-0x0D, A-Z lower-cased; a text of fewer than n words has one shingle of them all; one
    without words, empty or null, has none and links with nothing. Rows with a null id keep it, with a null component, and link with
    nothing. Repeated rows have one set and so one component; rows that share an id are one document here only if their sets are
    linked. Texts are taken whole, however long. Extra columns, whatever their names, are not read; an empty table gives none back.
    """
    docs = C.bounded_batches(docs).select("doc_id", "text")
    scratch, bands, rows = C.Scratch(docs.sparkSession), Bands(num, den), docs.count()
    s = set_of(F.col("text"), n, bands)
    sets = scratch.keep(docs.select("doc_id", s.alias("s")).select("doc_id", F.col("s.set_id").alias("node"), "s.n", "s.free"), "sets", rows, 8_000, narrow=True)
    one = sets.filter("doc_id is not null and node is not null").groupBy("node")
    known = scratch.keep(one.agg(F.max("n").alias("n"), F.first("free").alias("free"), F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "known", rows)
    roots = linked_sets(docs.filter("doc_id is not null"), known, n, bands, rows, scratch)
    linked = scratch.keep(known.join(roots, "node", "left").select("node", "first_id", "copies", "root"), "linked", rows)
    least = linked.filter("root is not null").groupBy("root").agg(F.min("first_id").alias("least"), F.count("*").alias("weight"))
    of_set = C.join_weighted(linked, least, "root", "weight", rows).select("node", F.coalesce("least", "first_id").alias("component_id"), "copies", "root")
    # a set of one document that is like no other is its own component, and needs no row here
    of_set = scratch.keep(of_set.filter("copies > 1 or root is not null").drop("root"), "components", rows)
    keyed = sets.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"))
    placed = C.join_weighted(keyed, of_set, "node", "copies", rows).select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    placed = C.materialise(placed, "placed", rows)
    scratch.drop()
    return placed


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The document with the smallest id of each group of near copies, with all its columns; rows without an id stay.

    Of rows that share an id, all stay if the id does and their texts differ; repeated rows are near copies of one another: one stays.
    Empty and null texts are like nothing and stay; an empty table stays empty.
    """
    found = jaccard_join(docs, **options)
    rows = found.count()
    many = found.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("k"), F.min("component_id").alias("c"))
    gone = C.materialise(many.filter("c <> doc_id").select("doc_id"), "gone", rows)
    twice = C.materialise(many.filter("k > 1 and c = doc_id").select("doc_id"), "twice", rows)
    kept = C.select_ids(docs, gone, keep=False)
    if not twice.head(1):
        return kept
    once = C.select_ids(kept, twice).dropDuplicates(["doc_id", "text"])
    return C.select_ids(kept, twice, keep=False).unionByName(once)
