"""Documents whose sets of word n-grams overlap: exact Jaccard join by rare-first prefixes.

Two sets with intersection over union of at least num/den must share a token
among the first few of each in one common order. The order is by frequency, so
these prefixes hold the rarest n-grams. Frequencies come from a table of fixed
size: n-grams are hashed into ``BUCKETS`` counters, summed over all documents;
equal counters are ordered by hash. Any order gives the same result, a good one
fewer candidates.

Equal sets are one node with members. Candidates share a prefix n-gram and pass
the length filter, the positional filter and a suffix filter: the sets' members
are dealt into fixed bins, and bins with an odd number of members in one set and
an even number in the other each hold a member that the sets do not share. Each
candidate is verified once. To answer with classes, not all pairs of a group are
needed:

1. every set is held against one leader of each of its prefix n-grams, a few
   times with other leaders, and components of the links are formed each time;
2. sets that share a prefix n-gram but still lie in different components are
   held against each other, whatever the group's size.

A pair within one component cannot change the components, so the result is that
of all pairs.

Defined results: a null or empty text has no n-grams and links with nothing; a
text with fewer words than n has its whole word sequence as its one n-gram; null
ids are members of classes but never name one (a class of null ids has a null
id); repeated rows are members like others; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bloomtide.llm.common import Scratch, batches_in_slices, delete_path, free_name, hash_words, mix, split_words, text_of
from bloomtide.llm.components import components
from bloomtide.session import scratch_path

#: Counters of the frequency table; its size is fixed, so it may go to every task.
BUCKETS = 1 << 18
BUCKET_SHIFT = np.uint64(64 - 18)
POINT = np.uint64(0xD6E8FEB86659FD93)
#: Bins of the suffix filter: one bit each, in 64-bit numbers.
BINS = 512
BIN_SHIFT = np.uint64(64 - 9)
SIGNATURE = tuple(f"s{i}" for i in range(BINS // 64))
#: Leaders that a set is held against before all that is left is compared.
ROUNDS = 4
#: Sets that one copy of another set's text is held against.
SHARE = 1000


def ngram_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of each text, ascending, and where each text's begin."""
    words, starts = split_words(texts, lower=True)
    hashes, counts = hash_words(words), np.diff(starts)
    size = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    owner = np.repeat(np.arange(len(counts)), size)
    first = np.repeat(starts[:-1], size) + np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    length = np.minimum(counts, n)[owner]
    values = np.zeros(len(first), np.uint64)
    for j in range(n):
        there = j < length
        at = np.where(there, first + j, 0)
        values = np.where(there, values * POINT + hashes[at], values) if len(hashes) else values
    values = mix(values ^ (length.astype(np.uint64) << np.uint64(56)))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.searchsorted(owner[new], np.arange(len(counts) + 1))


def set_keys(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set (0 for the empty one)."""
    sizes = np.diff(starts).astype(np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ POINT), dtype=np.uint64)])
    names = mix((sums[starts[1:]] - sums[starts[:-1]]) ^ (sizes << np.uint64(32)))
    return np.where(sizes > 0, names, 0).view(np.int64)


def signatures(values: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """For each set and bin whether it has an odd number of members there."""
    out, n = [], len(starts) - 1
    for first in range(0, n, 1000):
        last = min(first + 1000, n)
        own = values[starts[first]:starts[last]]
        owner = np.repeat(np.arange(last - first), np.diff(starts[first:last + 1]))
        odd = np.bincount(owner * BINS + (own >> BIN_SHIFT).astype(np.int64), minlength=(last - first) * BINS) & 1
        out.append(np.packbits(odd.astype(np.uint8)).reshape(last - first, BINS // 8).view(np.int64))
    table = np.concatenate(out) if out else np.empty((0, BINS // 64), np.int64)
    return [np.ascontiguousarray(table[:, i]) for i in range(BINS // 64)]


def members_and_counts(documents: DataFrame, n: int) -> DataFrame:
    """(doc_id, row, key, n_shingles, signature, counts) of rows (doc_id, row, text).

    ``counts`` is null but in one more row of each task, which has nothing else: how often
    the task's n-grams fall on each counter.
    """
    names = ["doc_id", "row", "key", "n_shingles", *SIGNATURE, "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches_in_slices(batches):
            values, starts = ngram_sets(batch.column("text"), n)
            total += np.bincount((values >> BUCKET_SHIFT).astype(np.int64), minlength=BUCKETS)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(set_keys(values, starts)),
                 pa.array(np.diff(starts).astype(np.int64)), *map(pa.array, signatures(values, starts)),
                 pa.nulls(batch.num_rows, pa.binary())], names=names)
        nothing = [pa.nulls(1, pa.int64())] * (len(names) - 1)
        yield pa.RecordBatch.from_arrays([*nothing, pa.array([total.tobytes()], pa.binary())], names=names)

    return documents.mapInArrow(
        run, "doc_id long, row long, key long, n_shingles long, " + ", ".join(f"{s} long" for s in SIGNATURE) + ", counts binary")


def frequency_table(counted: DataFrame) -> np.ndarray:
    """The counters of all tasks, summed in Spark; ``BUCKETS`` numbers come to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for counts in batch.column("counts"):
                total += np.frombuffer(counts.as_buffer(), np.int64)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], names=["bucket", "n"])

    vectors = counted.filter("counts IS NOT NULL").select("counts")
    sums = vectors.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return out


def prefixes(documents: DataFrame, n: int, num: int, den: int, frequency) -> DataFrame:
    """(token, key, size, place): the rarest n-grams of each set, enough for every link.

    Sets too small to link with a different set have none.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = frequency.value
        for batch in batches_in_slices(batches):
            values, starts = ngram_sets(batch.column("text"), n)
            keys, sizes = set_keys(values, starts), np.diff(starts)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((values, table[(values >> BUCKET_SHIFT).astype(np.int64)], owner))
            place = np.arange(len(values)) - np.repeat(starts[:-1], sizes)
            least = -(-num * sizes // den)
            take = np.where(sizes * (den - num) >= num, sizes - least + 1, 0)  # its best other partner has one n-gram more
            first = np.zeros(len(keys), bool)
            first[np.unique(keys, return_index=True)[1]] = True
            use = (place < take[owner]) & first[owner]
            yield pa.RecordBatch.from_arrays(
                [pa.array(values[order][use].view(np.int64)), pa.array(keys[owner[use]]),
                 pa.array(sizes[owner[use]].astype(np.int32)), pa.array(place[use].astype(np.int32))],
                names=["token", "key", "size", "place"])

    return documents.select("text").mapInArrow(run, "token long, key long, size int, place int")


def possible(num: int, den: int, a: str = "", b: str = "") -> str:
    """Length and positional filter of two prefix rows, the token being their first in common."""
    sizes = f"least({a}size, {b}size) * {den}L >= greatest({a}size, {b}size) * {num}L"
    overlap = f"least({a}size - {a}place, {b}size - {b}place)"
    return f"{sizes} AND {overlap} * {num + den} >= {num}L * ({a}size + {b}size)"


def not_too_far(num: int, den: int, a: str, b: str) -> str:
    """Suffix filter: bins of different parity each hold a member of only one set."""
    apart = " + ".join(f"bit_count({a}{s} ^ {b}{s})" for s in SIGNATURE)
    return f"{den - num}L * ({a}size + {b}size) >= {den + num}L * ({apart})"


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether two ascending sets link."""
    both = len(a) + len(b)
    at = np.searchsorted(a, b)
    shared = int(np.count_nonzero(a[np.minimum(at, len(a) - 1)] == b))
    return den * shared >= num * (both - shared)


def verified(pairs: DataFrame, sets: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (u, v) whose sets, made again from one text each, link.

    ``pairs`` has (x, l): the text of x goes to that of l. A set that many are held
    against is copied for each ``SHARE`` of them, so neither its text nor its partners
    are one task's.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_in_slices(batches, "text_x"):
            (x, xs), (y, ys) = (ngram_sets(batch.column(c), n) for c in ("text_x", "text_l"))
            keep = [linked(x[xs[i]:xs[i + 1]], y[ys[i]:ys[i + 1]], num, den) for i in range(batch.num_rows)]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    texts = sets.select("key", "text")
    degree = pairs.groupBy("l").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    dealt = pairs.join(degree, "l").select("x", "l", F.pmod(F.xxhash64("x"), "shares").cast("int").alias("share"))
    first = dealt.join(texts.select(F.col("key").alias("x"), F.col("text").alias("text_x")), "x")
    second = degree.join(texts.select(F.col("key").alias("l"), F.col("text").alias("text_l")), "l").select(
        "l", "text_l", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    ends = [F.greatest("x", "l").alias("u"), F.least("x", "l").alias("v")]
    return first.join(second, ["l", "share"]).select(*ends, "text_x", "text_l").mapInArrow(run, "u long, v long")


class StoredSets:
    """One row a set (key, signature, text), kept in the order of its key so that joins move the pairs, not the texts."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path, self.name = scratch_path(self.spark, "ngram-sets"), f"ngram_sets_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.repartition(buckets, "key").write.bucketBy(buckets, "key").sortBy("key").option("path", self.path).saveAsTable(self.name)
        self.table = self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete_path(self.spark, self.path)


def with_classes(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    """Add the class of each key: the key itself where it has no link yet."""
    if found is None:
        return rows.withColumn("class", F.col("key"))
    named = found.select(F.col("u").alias("key"), F.col("v").alias("class"))
    return rows.join(named, "key", "left").withColumn("class", F.coalesce("class", "key"))


def classes(documents: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, num: int = 90,
            den: int = 100) -> DataFrame:
    """(doc_id, row, n_shingles, component_id) for each row; ``row`` hashes id and text.

    Two rows link when ``den * intersection >= num * union`` of their n-gram sets;
    component_id is the smallest id reachable by links.
    """
    spark = documents.sparkSession
    rows = documents.select(
        F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(key), text_of(text)).alias("row"), text_of(text).alias("text"))
    scratch = Scratch(spark, "ngram-join")
    counted = scratch.store(members_and_counts(rows, n))
    members = counted.filter("counts IS NULL").drop("counts")
    table = spark.sparkContext.broadcast(frequency_table(counted))
    tokens = Scratch(spark, "ngram-tokens")
    prefix = tokens.store(prefixes(rows, n, num, den, table).dropDuplicates(["token", "key"]))  # two readers, one reading of the texts
    often = prefix.groupBy("token").agg(F.count("*").alias("others")).filter("others > 1").select("token")
    shared = tokens.store(prefix.join(often, "token"))
    tokens.drop_but_last()
    named = members.filter("n_shingles > 0").groupBy("key").agg(
        F.min("row").alias("row"), *[F.first(s).alias(s) for s in SIGNATURE])
    stored = StoredSets(
        rows.select("row", "text").join(named.join(shared.select("key").distinct(), "key"), "row")
        .dropDuplicates(["key"]).select("key", *SIGNATURE, "text"))
    table.unpersist()
    try:
        links = all_links(scratch, tokens, shared, stored.table, n, num, den)
        final = components(links, "ngram-components").select(F.col("u").alias("key"), F.col("v").alias("class"))
    finally:
        stored.drop()
        tokens.drop_but_last(0)
    by_key = members.filter("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("least")).join(
        final, "key", "left").withColumn("class", F.coalesce("class", "key"))
    named_classes = by_key.groupBy("class").agg(F.min("least").alias("component_id"))
    of_key = by_key.join(named_classes, "class").select("key", "component_id")
    out = members.join(of_key, "key", "left").select(
        "doc_id", "row", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out


def all_links(scratch: Scratch, tokens: Scratch, shared: DataFrame, sets: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links (u, v) that connect the sets as all links do; ``shared`` has the prefix n-grams that several sets have.

    A prefix n-gram whose sets have come into one class is done and leaves ``shared``.
    """
    signed = sets.select("key", *SIGNATURE)
    close = not_too_far(num, den, "a.", "b.")

    def near(pairs: DataFrame, known: DataFrame | None) -> DataFrame:
        """The pairs (x, l) that pass the suffix filter and were not compared before, each once."""
        first, second = (
            signed.select(F.col("key").alias(side), F.struct(*SIGNATURE).alias(name)) for side, name in (("x", "a"), ("l", "b")))
        once = pairs.groupBy("u", "v").agg(F.min(F.struct("x", "l", "size_x", "size_l")).alias("p")).select("u", "v", "p.*")
        sized = once.join(first, "x").join(second, "l").withColumns({
            "a": F.col("a").withField("size", F.col("size_x")), "b": F.col("b").withField("size", F.col("size_l"))})
        kept = sized.filter(close).select("u", "v", "x", "l")
        return kept if known is None else kept.join(known, ["u", "v"], "left_anti")

    def directed(x: str, other: str) -> list:
        keys = F.col(f"{x}.key"), F.col(f"{other}.key")
        return [F.greatest(*keys).alias("u"), F.least(*keys).alias("v"), keys[0].alias("x"), keys[1].alias("l"),
                F.col(f"{x}.size").alias("size_x"), F.col(f"{other}.size").alias("size_l")]

    compared, found = None, None
    mixed = F.col("least") < F.col("most")
    for turn in range(ROUNDS):
        placed = with_classes(shared, found).select("token", F.struct("key", "size", "place", "class").alias("x"))
        leaders = placed.groupBy("token").agg(
            F.min_by("x", F.struct(F.xxhash64(F.lit(turn), "x.key"), F.col("x.key"))).alias("l"),
            F.min("x.class").alias("least"), F.max("x.class").alias("most")).filter(mixed).select("token", "l")
        led = tokens.store(placed.join(leaders, "token"))
        tokens.drop_but_last()
        shared = led.select("token", "x.key", "x.size", "x.place")
        held = led.filter("x.class <> l.class").filter(possible(num, den, "x.", "l.")).select(*directed("x", "l"))
        pairs = scratch.store(near(held, compared))
        if turn and pairs.isEmpty():
            break
        links = verified(pairs, sets, n, num, den)
        found = components(links if found is None else links.unionByName(found), "ngram-components")
        done = pairs.select("u", "v")
        compared = done if compared is None else compared.unionByName(done)
    placed = with_classes(shared, found)
    several = placed.groupBy("token").agg(F.min("class").alias("least"), F.max("class").alias("most")).filter(mixed).select("token")
    left = placed.join(several, "token").select("token", "key", "size", "place", "class").join(signed, "key")
    across = left.alias("a").join(left.alias("b"), "token").filter(
        "a.key > b.key AND a.class <> b.class").filter(possible(num, den, "a.", "b.")).filter(close)
    rest = scratch.store(across.select(F.col("a.key").alias("u"), F.col("b.key").alias("v")).distinct()
                         .join(compared, ["u", "v"], "left_anti").select("u", "v", F.col("u").alias("x"), F.col("v").alias("l")))
    return found.unionByName(verified(rest, sets, n, num, den))


def one_of_each(documents: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, num: int = 80,
                den: int = 100) -> DataFrame:
    """The documents without near copies: of each class the row with the smallest id, columns unchanged.

    Of rows with that id, one text (the smallest hash) stays, once. Empty texts
    link with nothing and all stay; so do classes in which every id is null.
    """
    found = Scratch(documents.sparkSession, "ngram-classes").store(classes(documents, key, text, n, num, den))  # four readers
    of_class = found.filter("n_shingles > 0 AND component_id IS NOT NULL")
    winners = of_class.filter("doc_id = component_id").groupBy("component_id").agg(F.min("row").alias("row"))
    losers = of_class.join(winners, ["component_id", "row"], "left_anti").select("row").distinct()
    again = of_class.groupBy("row").agg(F.count("*").alias("n")).filter("n > 1").select("row")
    row = free_name(documents, "_row")
    named = documents.withColumn(row, F.xxhash64(F.col(key), text_of(text)))
    left = named.join(losers.select(F.col("row").alias(row)), row, "left_anti")
    if again.isEmpty():
        return left.select(*documents.columns)
    repeated = again.select(F.col("row").alias(row))
    return left.join(repeated, row, "left_anti").unionByName(
        left.join(repeated, row, "left_semi").dropDuplicates([row])).select(*documents.columns)
