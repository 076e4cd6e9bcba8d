"""Name search by trigrams and exact vector search, for batches of requests."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfoundry.sources.files import kept

from .access import denied

SIMILAR = 0.3


def trigrams(s: Column) -> Column:
    """The distinct trigrams of a text's words in lower case, each word with two blanks before and one after."""
    words = F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    of_word = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.concat(F.lit("  "), w, F.lit(" ")).substr(i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, of_word)))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of both; 0 without any."""
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0)), F.lit(0.0))


BUCKETS = 4096  #: of trigrams by hash, whose counts order them; what a plan carries of the corpus is as large
CROWD = 20_000  #: names under one trigram from which on they are dealt to several groups
_BAND = 1.25  # sizes within a band differ by this factor at most


class _Frequency:
    """How many names have the trigrams of each bucket: a bound on the names of a trigram, and an order of trigrams, rare ones first."""

    def __init__(self, grams: DataFrame, crowd: int):
        """grams: one column of arrays, one row a name."""
        bucket = F.explode(F.transform(grams.columns[0], self._bucket)).alias("b")
        counts = dict(grams.select(bucket).groupBy("b").count().collect())
        # one text, which is folded to an array when the plan is made
        self.counts = F.split(F.lit(",".join(str(min(counts.get(i, 0), (1 << 31) - 1)) for i in range(BUCKETS))), ",").cast("array<int>")
        self.crowd = crowd

    @staticmethod
    def _bucket(gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")

    def of(self, gram: Column) -> Column:
        return F.get(self.counts, self._bucket(gram))

    def ordered(self, grams: Column) -> Column:
        """An array of trigrams, the rarest first; every side of a join has the same order."""
        return F.transform(F.array_sort(F.transform(grams, lambda x: F.struct(self.of(x).alias("n"), x.alias("x")))), lambda y: y["x"])

    def groups(self, gram: Column) -> Column:
        """Into how many groups the names with a trigram are dealt, so that none has more than about `crowd`."""
        return F.floor(self.of(gram) / self.crowd).cast("int") + 1

    def dealt(self, rows: DataFrame, gram: str, key: str) -> DataFrame:
        """Rows of names, each with the group of its trigram that it falls in, by a hash of the key."""
        return rows.withColumn("_group", F.pmod(F.xxhash64(key), self.groups(F.col(gram))).cast("int"))

    def every(self, rows: DataFrame, gram: str) -> DataFrame:
        """Rows of queries, one for each group of their trigram."""
        return rows.withColumn("_group", F.explode(F.sequence(F.lit(0), self.groups(F.col(gram)) - 1)))


def _codes(grams: Column) -> Column:
    """Trigrams as numbers, 21 bits for each character: as distinct as they are, and quicker to compare."""
    code = lambda x, i: F.ascii(F.substring(x, i, 1)).cast("long")
    return F.transform(grams, lambda x: F.shiftleft(code(x, 1), 42) + F.shiftleft(code(x, 2), 21) + code(x, 3))


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores, if it has fewer partitions than there are: so for a small table of one file, never for a large one."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _band(size: Column) -> Column:
    return F.floor(F.log(size) / F.log(F.lit(_BAND))).cast("int")


def distinct_texts(rows: DataFrame, column: str) -> DataFrame:
    """(text, tid): each text of a column once, in lower case, with a number of its own; computed once. Null texts are none."""
    return kept(rows.filter(F.col(column).isNotNull()).select(F.lower(column).alias("text")).distinct().withColumn("tid", F.monotonically_increasing_id()), "texts")


def _who(rows: DataFrame, key: str, column: str, texts: DataFrame, *more: str) -> DataFrame:
    """(key, tid, ..) of the rows that have a text of distinct_texts(), each row on its own."""
    return rows.filter(F.col(key).isNotNull()).select(key, F.lower(column).alias("text"), *more).join(texts, "text").drop("text")


def trigram_join(queries: DataFrame, names: DataFrame, least: float = SIMILAR, crowd: int = CROWD, digits: int | None = None) -> DataFrame:
    """(query_id, id, similarity) of the pairs with a similarity of `least` or more, above 0, rounded to `digits` if given.

    Texts that many rows share are compared once, and found pairs of texts dealt out to the rows that have them: by a plain join on the
    text's number, or where `least` is so small that most pairs are found, within the task that finds them, so that no pair is shuffled.
    Null texts are like none; rows that share an id are pairs of their own.
    """
    asked, named = distinct_texts(queries, "text"), distinct_texts(names, "name")
    if least < PREFIXES:
        return _all_pairs(_owners(queries, "query_id", "text", asked), _owners(names, "id", "name", named), least, digits).toDF("query_id", "id", "similarity")
    pairs = similar_texts(asked, named, least, crowd)
    if digits is not None:
        pairs = pairs.withColumn("similarity", F.round("similarity", digits))
    found = pairs.join(_who(queries, "query_id", "text", asked).withColumnRenamed("tid", "asked"), "asked")
    # rows come out of the last join, which AQE doesn't see when it puts partitions together
    dealt = found.repartition(4 * names.sparkSession.sparkContext.defaultParallelism, "tid")
    return dealt.join(_who(names, "id", "name", named), "tid").select("query_id", "id", "similarity")


PREFIXES = 0.05  #: similarity from which on few of a text's trigrams need to be joined; below, blocks of texts are compared whole
OWNERS = 1024  #: ids that one row of a text has at most
TEXTS = 16_384, 2_048  #: rows of texts in a block of names, and of queries
MOST_OWNERS = 1 << 20  #: ids in a block
_ROWS, _ASKERS = 1 << 16, 64  # pairs in a row of lists that a task hands on, and queries in it


def _grams(texts: DataFrame) -> DataFrame:
    """(tid, g) of distinct_texts() that have trigrams."""
    return spread(texts).select("tid", _codes(trigrams(F.col("text"))).alias("g")).filter("size(g) > 0")


def _owners(rows: DataFrame, key: str, column: str, texts: DataFrame) -> DataFrame:
    """(tid, part, ids, g): for each text of distinct_texts() its trigrams and the keys of the rows that have it, OWNERS to a row at most."""
    number = F.row_number().over(Window.partitionBy("tid").orderBy(key))
    each = _who(rows, key, column, texts).withColumn("part", F.floor((number - 1) / OWNERS))
    return each.groupBy("tid", "part").agg(F.collect_list(key).alias("ids")).join(_grams(texts), "tid")


def _packed(texts: DataFrame, size: int, least: int, name: str) -> DataFrame:
    """_owners() in blocks of about `size` rows and MOST_OWNERS ids at most, a row each; in `least` blocks at the fewest."""
    rows, ids = texts.agg(F.count("*"), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
    n = max(least, ceil(rows / size), ceil(ids / MOST_OWNERS))
    dealt = texts.withColumn("_block", F.pmod(F.xxhash64("tid", "part"), F.lit(n)).cast("int")).repartitionById(n, "_block")
    # a block is what a task of the exchange has, which adaptive execution leaves alone
    return dealt.groupBy("_block").agg(F.collect_list(F.struct("ids", "g")).alias(name)).select(name)


def _all_pairs(asked: DataFrame, named: DataFrame, least: float, digits: int | None) -> DataFrame:
    """(id of asked, id of named, similarity) of all pairs of _owners() with a similarity of `least` or more, above 0.

    Most pairs are found, so their number is the work: each block of queries meets each block of names in one row. A task counts shared
    trigrams through an index of its block of names, a query at a time, and hands on lists: some rows that ask, names, similarities. They
    are opened as they are written: no pair is shuffled, and no task holds more than two blocks, a query's names in one, and some lists.
    """
    few = 4 * named.sparkSession.sparkContext.defaultParallelism
    have, ask = _packed(kept(named, "names"), TEXTS[0], few, "n"), _packed(kept(asked, "queries"), TEXTS[1], 1, "q")
    met = have.hint("shuffle_replicate_nl").crossJoin(ask.hint("shuffle_replicate_nl"))

    def lists(rows: pa.Array, field: str) -> tuple[pa.Array, np.ndarray]:
        """The values of a list field of structs, and n + 1 offsets."""
        found = pc.struct_field(rows, field)
        return found.flatten(), np.r_[0, np.cumsum(pc.list_value_length(found).to_numpy(zero_copy_only=False))].astype(np.int64)

    def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """first[0], .. first[0] + size[0] - 1, first[1], .."""
        return np.arange(size.sum()) + np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size)

    def compare(n: pa.Array, q: pa.Array):
        """(query's number, places among the names' ids, similarities) of each query."""
        (_, n_at), (n_codes, code_at), (q_codes, q_at) = lists(n, "ids"), lists(n, "g"), lists(q, "g")
        n_sizes = np.diff(code_at)
        n_codes, q_codes = (x.to_numpy(zero_copy_only=False) for x in (n_codes, q_codes))
        order = np.argsort(n_codes, kind="stable")
        codes, first, size = np.unique(n_codes[order], return_index=True, return_counts=True)
        holder = np.repeat(np.arange(len(n)), n_sizes)[order]  # names by code
        owned = np.diff(n_at)
        for j in range(len(q)):
            own = q_codes[q_at[j] : q_at[j + 1]]
            at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            at = at[codes[at] == own]
            if not len(at):
                continue
            shared = np.bincount(np.concatenate([holder[first[i] : first[i] + size[i]] for i in at]), minlength=len(n))
            hits = np.flatnonzero(shared)
            k = shared[hits]
            union = len(own) + n_sizes[hits] - k
            similarity = k / union
            enough = similarity >= least
            if not enough.all():
                hits, k, union, similarity = hits[enough], k[enough], union[enough], similarity[enough]
            if digits is not None:  # halves up, in whole numbers as the division of them is exact where it matters
                similarity = np.floor((2 * 10**digits * k + union) / (2 * union)) / 10**digits
            yield j, ranges(n_at[hits], owned[hits]), np.repeat(similarity, owned[hits])

    def batch_of(some: list[tuple[pa.Array, pa.Array, pa.Array]]) -> pa.RecordBatch:
        listed = lambda xs: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in xs])].astype(np.int32)), pa.concat_arrays(xs))
        return pa.RecordBatch.from_arrays([listed(xs) for xs in zip(*some)], ["askers", "ids", "similarity"])

    def search(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                n, q = (batch.column(c).slice(r, 1).flatten() for c in ("n", "q"))
                (ids, _), (askers, at), some, held = lists(n, "ids"), lists(q, "ids"), [], 0
                for j, places, similarity in compare(n, q):
                    wide = min(at[j + 1] - at[j], _ASKERS)
                    step = _ROWS // wide
                    for i in range(0, len(places), step):
                        part = ids.take(pa.array(places[i : i + step])), pa.array(similarity[i : i + step])
                        for k in range(at[j], at[j + 1], wide):
                            some.append((askers.slice(k, min(wide, at[j + 1] - k)), *part))
                            held += len(part[0])
                            if held >= _ROWS:
                                yield batch_of(some)
                                some, held = [], 0
                if some:
                    yield batch_of(some)

    kinds = (df.schema["ids"].dataType.simpleString() for df in (asked, named))
    found = met.mapInArrow(search, "askers {}, ids {}, similarity array<double>".format(*kinds))
    # Spark holds what it makes of one row: _ROWS pairs at most
    each = found.select(F.explode("askers").alias("asked"), "ids", "similarity").select("asked", F.posexplode("ids").alias("place", "id"), "similarity")
    return each.select("asked", "id", F.get("similarity", "place").alias("similarity"))


def similar_texts(asked: DataFrame, named: DataFrame, least: float = SIMILAR, crowd: int = CROWD) -> DataFrame:
    """(asked, tid, similarity) of pairs of distinct_texts() with a similarity of `least` or more, above 0.

    Two sets of sizes m and n that are as similar share s = least / (1 + least) * (m + n) trigrams, so the first m - s + 1 of the one and of
    the other, rarest first, have one in common. Only these are joined, names under frequent trigrams in groups; sizes too far apart never
    meet, and queries know the sizes of names by band, which makes s larger. What met is compared once, exactly. Where `least` is so small
    that nearly all trigrams would be joined, blocks of texts are compared whole.
    """
    if least < PREFIXES:
        alone = lambda df: _grams(df).select("tid", F.lit(0).alias("part"), F.array("tid").alias("ids"), "g")
        return _all_pairs(alone(asked), alone(named), least, None).toDF("asked", "tid", "similarity")
    q = _grams(asked).withColumnRenamed("tid", "query_id").withColumn("nq", F.size("g"))
    n = _grams(named).withColumnRenamed("tid", "id").withColumn("nn", F.size("g"))
    often = _Frequency(n.select("g"), crowd)
    enough = (F.col("similarity") >= least) & (F.col("similarity") > 0)
    slack = 1e-9
    shared = lambda x, y: F.greatest(F.ceil((x + y) * (least / (1 + least)) - slack), F.lit(1)).cast("int")
    first = lambda size, s: F.slice(often.ordered(F.col("g")), F.lit(1), F.greatest(size - s + 1, F.lit(0)))
    # a name's partner has least * nn trigrams at the fewest
    have = n.select("id", "nn", _band(F.col("nn")).alias("band"), F.explode(first(F.col("nn"), shared(F.col("nn"), F.col("nn") * least))).alias("t"))
    lowest, highest = F.col("nq") * least, F.col("nq") / least
    bands = F.sequence(F.greatest(_band(F.greatest(lowest, F.lit(1.0))) - 1, F.lit(0)), F.least(_band(highest) + 1, _band(F.lit(1e6))))
    ask = q.withColumn("band", F.explode(bands))
    smallest = F.greatest(F.pow(F.lit(_BAND), F.col("band")) - slack, lowest)
    ask = ask.select("query_id", "nq", "band", F.explode(first(F.col("nq"), shared(F.col("nq"), smallest))).alias("t"))
    have, ask = often.dealt(have, "t", "id"), often.every(ask, "t")
    fits = (F.col("nn") + slack >= F.col("nq") * least) & (F.col("nq") + slack >= F.col("nn") * least)
    met = ask.join(have, ["t", "band", "_group"]).filter(fits).select("query_id", "id").distinct()
    both = met.join(n.select("id", F.col("g").alias("gn"), "nn"), "id").join(q, "query_id")
    k = F.size(F.array_intersect("g", "gn"))
    return both.withColumn("similarity", k / (F.col("nq") + F.col("nn") - k)).filter(enough).select(F.col("query_id").alias("asked"), F.col("id").alias("tid"), "similarity")


def holding(queries: DataFrame, names: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(query_id, id) of names that contain the query's text, whatever the case; % and _ in it are wildcards.

    A text with three characters or more in a row is looked up by the rarest of its trigrams, names under a frequent one in groups; others
    go against all names.
    """
    q = queries.withColumn("t", F.lower("text"))
    n = spread(names.select("id", "name")).select("id", F.lower("name").alias("n"))
    in_row = lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - 2), lambda i: x.substr(i, F.lit(3)))
    runs = F.filter(F.split("t", "[%_]"), lambda x: F.length(x) >= 3)
    q = q.withColumn("_grams", F.when(F.col("t").contains("\\"), F.array().cast("array<string>")).otherwise(F.flatten(F.transform(runs, in_row))))
    indexed = n.filter(F.length("n") >= 3).withColumn("_grams", F.array_distinct(in_row(F.col("n"))))
    often = _Frequency(indexed.select("_grams"), crowd)
    ask = often.every(q.filter("size(_grams) > 0").withColumn("g", F.get(often.ordered(F.col("_grams")), F.lit(0))).select("query_id", "t", "g"), "g")
    have = often.dealt(indexed.select("id", "n", F.explode("_grams").alias("g")), "g", "id")
    like = F.when(F.col("t").rlike("[%_]"), F.like("n", F.concat(F.lit("%"), F.col("t"), F.lit("%")))).otherwise(F.col("n").contains(F.col("t")))
    quick = ask.join(have, ["g", "_group"]).filter(like).select("query_id", "id")
    odd = q.filter("size(_grams) = 0").select("query_id", "t")
    slow = n.join(odd, F.like("n", F.concat(F.lit("%"), F.col("t"), F.lit("%")))).select("query_id", "id")
    return quick.unionByName(slow).distinct()


def name_search(queries: DataFrame, names: DataFrame, top: int = 20, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, id, similarity, rank): names that contain the text or are similar, the nearest first, `top` for each query.

    allowed: (request_id, dataset_id) from granted(), request_id being a query's; names (with dataset_id) elsewhere aren't found.

    Texts that many rows share are compared once. Rows with one text (in one dataset) stand together in a query's order but for ties, so the
    `top` best of these groups, by their smallest ids, hold all rows that it can list, and only their `top` smallest ids are dealt out.
    """
    asked, named = distinct_texts(queries, "text"), distinct_texts(names, "name")
    held = holding(asked.select(F.col("tid").alias("query_id"), "text"), named.select(F.col("tid").alias("id"), F.col("text").alias("name")))
    held = held.select(F.col("query_id").alias("asked"), F.col("id").alias("tid"), F.lit(None).cast("double").alias("similarity"))
    pairs = similar_texts(asked, named).unionByName(held).groupBy("asked", "tid").agg(F.max("similarity").alias("similarity"))
    # what only contains the text hasn't been compared yet
    bare = pairs.filter("similarity is null").drop("similarity").join(named, "tid").join(asked.select(F.col("tid").alias("asked"), F.col("text").alias("_asked")), "asked")
    pairs = pairs.filter("similarity is not null").unionByName(bare.select("asked", "tid", trigram_similarity(F.col("text"), F.col("_asked")).alias("similarity")))

    by = ["tid", *(["dataset_id"] if allowed is not None else [])]
    own = _who(names, "id", "name", named, *by[1:])
    groups = own.groupBy(*by).agg(F.min("id").alias("_first"))
    least = own.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).filter(F.col("_n") <= top).drop("_n")
    who = _who(queries, "query_id", "text", asked).withColumnRenamed("tid", "asked")
    ranked = lambda df, key, of: df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.round("similarity", 9)), of))).filter(F.col("rank") <= top)
    found = pairs.join(groups, "tid")
    if allowed is None:
        found = ranked(ranked(found, "asked", "_first").drop("rank").join(least, by), "asked", "id").drop("rank").join(who, "asked")
    else:
        found = found.join(who, "asked").join(_grants(allowed, names).withColumnRenamed("request_id", "query_id"), ["query_id", "dataset_id"], "left_semi")
        found = ranked(found, "query_id", "_first").drop("rank").join(least, by)
    return ranked(found.select("query_id", "id", "similarity"), "query_id", "id")


def metadata_filter(conditions: dict, lists: tuple[str, ...] = ()) -> Column:
    """All of the conditions on payload columns: equality of a text, integer, boolean or floating number, or (low, high) bounds of a
    number, either None. A column of `lists` fits if any of its elements does."""

    def one(value: Column, key: str, want) -> Column:
        if isinstance(want, (bool, str, int)):
            return value == F.lit(want)
        if isinstance(want, float):
            return (value >= want) & (value <= want)
        if isinstance(want, tuple) and len(want) == 2:
            return (F.lit(True) if want[0] is None else value >= want[0]) & (F.lit(True) if want[1] is None else value <= want[1])
        raise ValueError(f"no condition of this kind: {key}={want!r}")

    out = F.lit(True)
    for key, want in conditions.items():
        out = out & (F.exists(key, lambda v: one(v, key, want)) if key in lists else one(F.col(key), key, want))  # noqa: B023
    return F.coalesce(out, F.lit(False))


def _cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None]
    return np.divide(x @ q.T, norm, out=np.full((len(x), len(q)), -2.0), where=norm > 0)


DISTANCES: dict[str, Callable] = {
    "cosine": _cosine,
    "dot": lambda x, q: x @ q.T,
    "euclid": lambda x, q: -np.sqrt(np.maximum((x**2).sum(1)[:, None] + (q**2).sum(1)[None] - 2 * x @ q.T, 0)),
}


def distance(kind: str, a: Column, b: Column) -> Column:
    """DISTANCES of two vector columns of a row, without numpy: cosine, dot, or euclid (here a distance, not its negative)."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda acc, v: acc + v)
    if kind == "cosine":
        return dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0))
    if kind == "dot":
        return dot(a, b)
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p.cast("double") - q) * (p.cast("double") - q)), F.lit(0.0), lambda acc, v: acc + v))


def sound(vector: Column) -> Column:
    """Whether a vector can be compared: not null, not empty, and all of its components finite numbers."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def _by_blocks(requests: DataFrame, points: DataFrame, k: int, threshold: float, distance: str, allowed: DataFrame | None, block: int) -> DataFrame:
    """The k best points of each request, and more: requests are dealt by a hash of their ids into blocks of about `block`, points into blocks
    of four times that. Each pair of blocks meets in one group by an equality join on both block numbers."""
    n_asked, n_points = (max(1, ceil(df.count() / size)) for df, size in ((requests, block), (points, 4 * block)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    length = F.size("vector").alias("_size")
    q = requests.select("request_id", "vector", length, dealt("request_id", n_asked).alias("_asked"))
    if allowed is None:
        p = points.select("point_id", "document_id", "vector", length, F.lit(None).cast("array<bigint>").alias("_who"), every(n_asked).alias("_asked"))
    else:
        near = allowed.join(q.select("request_id", F.col("_asked").alias("_by")), "request_id").groupBy("dataset_id", "_by").agg(F.collect_set(F.col("request_id").cast("bigint")).alias("_who"))
        p = points.join(near, "dataset_id").select("point_id", "document_id", "vector", length, "_who", F.col("_by").alias("_asked"))
    q = q.withColumn("_block", every(n_points))
    p = p.withColumn("_block", dealt("point_id", n_points))
    score, limited = DISTANCES[distance], allowed is not None
    matrix = lambda t: t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(t.num_rows, -1)
    schema = pa.schema([("request_id", pa.int64()), ("point_id", pa.int64()), ("document_id", pa.int64()), ("score", pa.float64())])

    def best(have: pa.Table, ask: pa.Table) -> pa.Table:
        if not have.num_rows or not ask.num_rows:
            return schema.empty_table()
        s = score(matrix(have), matrix(ask))
        ids = np.array(ask.column("request_id"))
        if limited:
            who = have.column("_who").combine_chunks()
            row = np.repeat(np.arange(len(who)), who.value_lengths().to_numpy(zero_copy_only=False))
            own, column = np.unique(ids, return_inverse=True)
            may = np.zeros((len(s), len(own)), bool)
            seer = who.flatten().to_numpy(zero_copy_only=False)
            here = np.isin(seer, own)  # others of the block have vectors of another length
            may[row[here], np.searchsorted(own, seer[here])] = True
            may = may[:, column]
            s = np.where(may, s, -np.inf)
        point = np.array(have.column("point_id"))
        out = []
        for j in range(len(ids)):
            top = np.lexsort((point, -s[:, j]))[:k]
            top = top[s[top, j] >= threshold]
            out.append((np.full(len(top), ids[j]), top, s[top, j]))
        of, at, scores = (np.concatenate(x) for x in zip(*out))
        rows = have.select(["point_id", "document_id"]).take(pa.array(at))
        return pa.Table.from_arrays([pa.array(of), *rows.columns, pa.array(scores)], ["request_id", "point_id", "document_id", "score"]).cast(schema)

    return p.groupBy("_asked", "_block", "_size").cogroup(q.groupBy("_asked", "_block", "_size")).applyInArrow(best, _FOUND)


_FOUND = "request_id long, point_id long, document_id long, score double"
MOST_BYTES = 16 << 20  #: of request vectors, and of granted pairs, that each task over points may be handed
MOST_DATASETS = 10_000  #: of granted datasets that partitions of points are picked by one by one, and of granted pairs that are taken as they come


_NO_DOCUMENT = -(1 << 63)


class _Best:
    """The k best points so far of each of some requests, whose vectors have one length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.score = np.full((len(ids), 0), -np.inf)
        self.point = self.document = np.zeros((len(ids), 0), np.int64)

    def add(self, rows: np.ndarray, score: np.ndarray, point: np.ndarray, document: np.ndarray) -> None:
        """score: (requests `rows`, points)."""
        if score.shape[1] > self.k:  # only points among the k best of their batch, and those level with the last of them, can matter
            least = np.partition(score, -self.k, axis=1)[:, -self.k]
            near = (score >= least[:, None]).any(axis=0)
            score, point, document = score[:, near], point[near], document[near]
        wide = lambda x: np.broadcast_to(x, score.shape)
        all_score = np.concatenate([self.score[rows], score], axis=1)
        all_point = np.concatenate([self.point[rows], wide(point)], axis=1)
        all_document = np.concatenate([self.document[rows], wide(document)], axis=1)
        order = np.lexsort((all_point, -all_score), axis=1)[:, : self.k]
        width = max(self.score.shape[1], order.shape[1])
        for name, kept, fill in (("score", all_score, -np.inf), ("point", all_point, 0), ("document", all_document, 0)):
            have = getattr(self, name)
            if have.shape[1] < width:
                have = np.concatenate([have, np.full((len(self.ids), width - have.shape[1]), fill, have.dtype)], axis=1)
            have[rows, : order.shape[1]] = np.take_along_axis(kept, order, axis=1)
            have[rows, order.shape[1] :] = fill
            setattr(self, name, have)


def _in_place(points: DataFrame, asked: dict[int, tuple[np.ndarray, np.ndarray]], k: int, threshold: float, distance: str, may: dict[int, np.ndarray] | None) -> DataFrame:
    """The k best points of each request in each task over points, which stay where they are.

    asked: by length of vectors, (ids, matrix) of the requests. may: for each dataset the ids of requests that may look into it, sorted.
    """
    score = DISTANCES[distance]
    columns = ["point_id", "document_id", "vector", *(["dataset_id"] if may is not None else [])]

    def search(batches):
        best = {size: _Best(ids, vectors, k) for size, (ids, vectors) in asked.items()}
        seers = {} if may is None else {(d, size): np.flatnonzero(np.isin(b.ids, who)) for d, who in may.items() for size, b in best.items()}
        for batch in batches:
            sizes = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
            groups = [(None, np.arange(batch.num_rows))]
            if may is not None:
                datasets = batch.column("dataset_id").to_numpy(zero_copy_only=False)
                groups = [(d, np.flatnonzero(datasets == d)) for d in np.unique(datasets[~np.isnan(datasets)] if datasets.dtype.kind == "f" else datasets)]
            for d, own in groups:
                for size, b in best.items():
                    at = own[sizes[own] == size]
                    rows = np.arange(len(b.ids)) if may is None else seers.get((int(d), size), np.zeros(0, np.int64))
                    for first in range(0, len(at), 2000) if len(rows) else ():
                        some = batch.take(pa.array(at[first : first + 2000]))
                        x = some.column("vector").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(some.num_rows, -1)
                        ids = [some.column(c).to_numpy(zero_copy_only=False) for c in ("point_id", "document_id")]
                        for r in range(0, len(rows), 1000):
                            part = rows[r : r + 1000]
                            b.add(part, score(x, b.vectors[part]).T, *ids)
        for b in best.values():
            row, column = np.nonzero(b.score >= threshold)
            document = b.document[row, column]
            yield pa.RecordBatch.from_arrays([pa.array(b.ids[row]), pa.array(b.point[row, column]), pa.array(document, mask=document == _NO_DOCUMENT), pa.array(b.score[row, column])], ["request_id", "point_id", "document_id", "score"])

    own = points.filter("point_id is not null")
    return own.select(F.col("point_id").cast("long").alias("point_id"), F.coalesce(F.col("document_id").cast("long"), F.lit(_NO_DOCUMENT)).alias("document_id"), *columns[2:]).mapInArrow(search, _FOUND)


def _bounded_requests(requests: DataFrame, most: int) -> dict[int, tuple[np.ndarray, np.ndarray]] | None:
    """By length of vectors, (ids, matrix) of all requests; None if they take more than `most` bytes."""
    if (requests.agg(F.sum(8 * F.size("vector") + 16)).first()[0] or 0) > most:
        return None
    rows = requests.filter("request_id is not null").select(F.col("request_id").cast("long").alias("request_id"), F.col("vector").cast("array<double>").alias("vector")).toArrow().combine_chunks()
    sizes = pc.list_value_length(rows.column("vector")).to_numpy()
    by = {}
    for size in np.unique(sizes).tolist():
        own = rows.filter(pa.array(sizes == size)).combine_chunks()
        by[size] = own.column("request_id").to_numpy(), np.concatenate([x.flatten().to_numpy() for x in own.column("vector").chunks]).reshape(-1, size)
    return by


def _grants(allowed: DataFrame, points: DataFrame) -> DataFrame:
    """Distinct (request_id, dataset_id), computed once; of many pairs, those whose datasets have points, which may be few among all that
    users see."""
    pairs = allowed.select("request_id", "dataset_id").filter("request_id is not null and dataset_id is not null")
    if pairs.limit(MOST_DATASETS + 1).count() > MOST_DATASETS:
        pairs = pairs.join(points.select("dataset_id").distinct(), "dataset_id", "left_semi")
    return kept(pairs.distinct(), "grants")


def _bounded_grants(grants: DataFrame, most: int) -> dict[int, np.ndarray] | None:
    """For each dataset the requests that may look into it, from _grants(); None if the pairs take more than `most` bytes."""
    if grants.count() > most // 16:
        return None
    pairs = grants.select(F.col("request_id").cast("long").alias("r"), F.col("dataset_id").cast("long").alias("d")).toArrow()
    r, d = (pairs.column(c).to_numpy() for c in ("r", "d"))
    order = np.lexsort((r, d))
    datasets, first = np.unique(d[order], return_index=True)
    return dict(zip(datasets.tolist(), np.split(r[order], first[1:]))) if len(datasets) else {}


def vector_top_k(requests: DataFrame, points: DataFrame, k: int = 10, threshold: float = 0.3, distance: str = "cosine", allowed: DataFrame | None = None, block: int = 1000, most: int = MOST_BYTES) -> DataFrame:
    """(request_id, point_id, document_id, score, rank): the k best points of each request, exactly, for any number of requests.

    Requests whose vectors and grants take `most` bytes at most are handed to each task over points: points aren't moved, and each task
    sends the k best that it has for a request. With grants only the datasets that anyone may see are read, so that points that lie by
    dataset are pruned. More requests meet points in blocks, see _by_blocks(). allowed: (request_id, dataset_id) pairs outside of which a
    request sees nothing. Vectors that are not sound() find nothing and are not found; vectors of different lengths never meet; repeated
    points are all found.
    """
    allowed = None if allowed is None else _grants(allowed, points)
    requests, points = requests.filter(sound(F.col("vector"))), points.filter(sound(F.col("vector")))
    asked = _bounded_requests(requests, most)
    counted = allowed is not None and points.schema["dataset_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    may = _bounded_grants(allowed, most) if counted and asked is not None else None
    if asked is None or allowed is not None and may is None:
        found = _by_blocks(requests, points, k, threshold, distance, allowed, block)
    else:
        if may is not None and len(may) <= MOST_DATASETS:
            points = points.filter(F.col("dataset_id").isin(sorted(may)))
        found = _in_place(points, asked, k, threshold, distance, may)
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("score"), "point_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def first_point_per_document(top: DataFrame) -> DataFrame:
    """The best point of each document among a request's top k: fewer than k may be left."""
    w = Window.partitionBy("request_id", "document_id").orderBy("rank")
    return top.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def granted(requests: DataFrame, wanted: DataFrame, accessible: DataFrame, holding: DataFrame | None = None) -> DataFrame:
    """(request_id, dataset_id) that requests (request_id, user_id) may look into: the datasets that they want (request_id, dataset_id), or
    without any all that are accessible (user_id, dataset_id). A request for a dataset that its user may not see gets nothing at all.

    holding: (dataset_id) with anything to be found; others, which may be most of what users see, are left out unless a request names them.
    """
    needed = accessible.join(requests.select("user_id").distinct(), "user_id", "left_semi")
    if holding is not None:
        holding = kept(holding.select("dataset_id").distinct(), "holding")
        needed = needed.join(holding.unionByName(wanted.select(F.col("dataset_id").cast(holding.schema["dataset_id"].dataType))).distinct(), "dataset_id", "left_semi")
    accessible = kept(needed.select("user_id", "dataset_id"), "accessible")
    asked = wanted.join(requests.select("request_id", "user_id"), "request_id")
    rejected = denied(asked, accessible).select("request_id").distinct()
    named = asked.join(rejected, "request_id", "left_anti").select("request_id", "dataset_id").distinct()
    free = requests.select("request_id", "user_id").join(wanted.select("request_id").distinct(), "request_id", "left_anti")
    seen = accessible if holding is None else accessible.join(holding, "dataset_id", "left_semi")
    return named.unionByName(free.join(seen, "user_id").select("request_id", "dataset_id"))


def vector_search(requests: DataFrame, points: DataFrame, documents: DataFrame, allowed: DataFrame, conditions: dict | None = None, **options) -> DataFrame:
    """(request_id, document_id, point_id, score, content, file_name) of the best point of each document; a summary point shows its full
    text. allowed: what granted() gives."""
    lists = tuple(f.name for f in points.schema if f.dataType.typeName() == "array")
    seen = points.filter(metadata_filter(conditions, lists)) if conditions else points
    top = first_point_per_document(vector_top_k(requests, seen, allowed=allowed, **options))
    text = points.select("point_id", F.when(F.col("chunk_type") == "summary", F.col("content_full")).otherwise(F.col("content")).alias("content"))
    names = documents.select(F.col("id").alias("document_id"), "file_name")
    return top.join(text, "point_id").join(names, "document_id", "left").select("request_id", "document_id", "point_id", "score", "content", F.coalesce("file_name", F.lit("")).alias("file_name"))
