"""Repeated passages of words, by prefix-partitioned suffix trees.

Every window of ``length`` words whose words also stand earlier (in a row with a
smaller id, or earlier in the same row) is a repeat, and the words it covers are
removed. The windows are the suffixes of the word sequences, cut at that depth.

1. Suffixes that cannot repeat are dropped (``repeats``).
2. A suffix is written as its path from the root: a hash of its first words, and of
   what each further step of words adds, as the leading bits of one number
   (``BITS``); hashes of all its words follow. The leading bits are a prefix.
3. Spark counts the suffixes of the prefixes of every step, in ``COUNTERS`` counters
   a step. A prefix whose counter holds more than ``SHARE`` of a fair share is
   lengthened by a step, and so on, so a frequent start of a passage spreads over
   many tasks. Suffixes are dealt out by these prefixes of varying length.
4. Each task sorts its suffixes and takes groups with a common prefix, as many as
   fit its memory; a prefix with too many is lengthened by the next step, and so on,
   so a group never outgrows the memory. A group's subtree follows from the sorted
   paths: the runs that share so many steps are its internal nodes of that depth.
   The steps between the first and the last have 8 bits, so a node there may hold a
   few prefixes together; a node of full depth has 88.
5. Under a node of full depth the earliest suffix stays; all others are repeats.
   Repeats that touch are one passage (a maximal repeat).

Equal suffixes within a slice are combined before the shuffle, so a passage that
stands in very many rows brings one suffix a slice to its node.

Defined results: a null or empty text has no words; texts with fewer words than a
window lose nothing; null ids come last in the order; rows of one id are ordered
by a hash of the text; repeated rows (same id and text) are one row, and each
gets its result; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from bloomtide.llm import repeats
from bloomtide.llm.common import batches_in_slices, hash_words, mix, split_words, text_of

LENGTH = 20
GRAM = 5
#: Steps from the root to the full depth, and the leading bits of a path at the end of each but the last.
STEPS = 5
BITS = (24, 32, 40, 48)
#: Counters of prefixes for each step, and how many times the mean of them a prefix may hold.
COUNTERS = 4096
SHARE = 4
#: Suffixes of the groups that a task holds at once.
GROUP = 200_000
SLICE_BYTES = 2_000_000
#: 64 and 24 bits: the steps, then 40 bits of all words.
PATH = ("path", "rest")
SUFFIX_SCHEMA = "path long, rest int, doc_id long, row long, start int, n int"


def word_symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words, starts = split_words(texts)
    return hash_words(words), starts


def depths(length: int) -> list[int]:
    """The depths of the nodes, in words."""
    return [max(1, length * i // STEPS) for i in range(1, STEPS + 1)]


def paths(values: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The paths of suffixes at places; equal up to a depth in words means equal up to its bits."""
    path, bits, before, whole = np.zeros(len(at), np.uint64), 0, 0, np.zeros(len(at), np.uint64)
    for depth, end in zip(depths(length), (*BITS, 64), strict=True):
        for j in range(before, depth):
            whole = mix(whole ^ values[at + j])
        path = path << np.uint64(end - bits) | whole >> np.uint64(64 - end + bits)
        bits, before = end, depth
    return path.view(np.int64), (whole & np.uint64(0xFFFFFF)).astype(np.int32)


def common_steps(path: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """How many steps each sorted path shares with the one before; -1 for the first."""
    shared = np.zeros(len(path), np.int8)
    differ = (path[1:] ^ path[:-1]).view(np.uint64)
    for bits in BITS:
        shared[1:] += differ < np.uint64(1 << (64 - bits))
    shared[1:] += (differ == 0) & (rest[1:] == rest[:-1])
    shared[:1] = -1
    return shared


def internal_nodes(shared: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes at a step of the subtree of sorted paths: where each begins, and which one each path is under."""
    head = shared < step
    return np.flatnonzero(head), np.cumsum(head) - 1


def suffixes_of(batch: pa.RecordBatch, length: int):
    """The suffixes of a slice that may repeat: the earliest of equal ones, and the places of the others."""
    values, starts = word_symbols(batch.column("text"))
    text, _, start, n, _ = repeats.spots_of(batch)
    rows = batch.column("row").to_numpy()
    ids = batch.column("doc_id")
    first_row = np.zeros(len(rows), bool)
    first_row[np.unique(rows, return_index=True)[1]] = True
    use = first_row[text]
    text, start, n = text[use], start[use], n[use]
    owner = np.repeat(text, n)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
    path, rest = paths(values, starts[owner] + place, length)
    absent = ids.is_null().to_numpy(zero_copy_only=False)
    number = pc.fill_null(ids, 0).to_numpy()
    order_of = np.empty(len(rows), np.int64)
    order_of[np.lexsort((rows, number, absent))] = np.arange(len(rows))
    order = np.lexsort((place, order_of[owner], rest, path))
    same = common_steps(path[order], rest[order]) == STEPS
    kept, later = np.sort(order[~same]), order[same]  # a row's suffixes together: they compress better
    return (path, rest, owner, place), kept, later


def marks(owner: np.ndarray, place: np.ndarray, length: int):
    """(owner, start, end) of what windows cover, neighbouring ones together."""
    order = np.lexsort((place, owner))
    owner, place = owner[order], place[order]
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (place[1:] - place[:-1] > 1)
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(owner)) - 1
    return owner[at], place[at], place[last] + length if len(at) else place


def suffix_rows(located: DataFrame, length: int) -> DataFrame:
    """Suffixes (n = 0) and, already known, passages (n = their words) of rows (doc_id, row, text, spots)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_in_slices(batches, limit=SLICE_BYTES):
            (path, rest, owner, place), kept, later = suffixes_of(batch, length)
            text, start, end = marks(owner[later], place[later], length)
            take = pa.array(np.concatenate([owner[kept], text]))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(np.concatenate([s[kept], np.zeros(len(text), s.dtype)])) for s in (path, rest)),
                 batch.column("doc_id").take(take), batch.column("row").take(take),
                 pa.array(np.concatenate([place[kept], start]).astype(np.int32)),
                 pa.array(np.concatenate([np.zeros(len(kept), np.int64), end - start]).astype(np.int32))],
                names=[*PATH, "doc_id", "row", "start", "n"])

    return located.mapInArrow(run, SUFFIX_SCHEMA)


def prefix_counts(located: DataFrame, length: int) -> DataFrame:
    """(counter, n): for each step the suffixes of its prefixes, each prefix in one of ``COUNTERS`` counters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(BITS) * COUNTERS, np.int64)
        for batch in batches_in_slices(batches, limit=SLICE_BYTES):
            (path, *_), kept, _ = suffixes_of(batch, length)
            for i, bits in enumerate(BITS):
                prefix = path[kept] >> np.int64(64 - bits)
                counts += np.bincount(prefix % COUNTERS + i * COUNTERS, minlength=len(counts))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts), dtype=np.int32)), pa.array(counts)], names=["counter", "n"])

    return located.mapInArrow(run, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n"))


def prefix_of(path: Column, counts: DataFrame) -> Column:
    """The shortest prefix of a path that few enough suffixes have, the whole path if none.

    The counts are one array of fixed size, whatever the data.
    """
    n = F.transform(F.array_sort(F.collect_list(F.struct("counter", "n"))), lambda c: c["n"])
    bound = F.greatest(F.lit(GROUP), F.sum("n") * SHARE / (len(BITS) * COUNTERS))
    frequent = counts.agg(n.alias("n"), bound.alias("bound")).select(
        F.transform("n", lambda x: x > F.col("bound")).alias("frequent")).scalar()
    prefix = path
    for i, bits in reversed(list(enumerate(BITS))):
        shorter = F.shiftright(path, 64 - bits)
        many = F.get(frequent, (F.pmod(shorter, F.lit(COUNTERS)) + i * COUNTERS).cast("int"))
        prefix = F.when(many, prefix).otherwise(shorter)
    return prefix


class Subtrees:
    """Builds the subtrees of one task from paths in sorted order."""

    def __init__(self, length: int):
        self.length = length
        self.rest: pa.Table | None = None
        #: path and earliest suffix of the node at which the last group ended
        self.open: tuple | None = None

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches([batch])
        self.rest = table if self.rest is None else pa.concat_tables([self.rest, table])
        if self.rest.num_rows >= GROUP:
            shared = common_steps(*(self.rest.column(c).to_numpy() for c in PATH))
            # the shortest prefix that splits what is held; the deepest node itself if none does
            for steps in range(STEPS + 1):
                borders = np.flatnonzero(shared <= steps)
                if borders[-1] > 0:
                    break
            yield from self.build(self.rest.slice(0, borders[-1]))
            self.rest = self.rest.slice(borders[-1])

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.rest is not None and self.rest.num_rows:
            yield from self.build(self.rest)

    def build(self, group: pa.Table) -> Iterator[pa.RecordBatch]:
        """Repeats under the deep nodes of a group of sorted suffixes."""
        columns = [group.column(c).to_numpy() for c in PATH]
        row, start = group.column("row").to_numpy(), group.column("start").to_numpy().astype(np.int64)
        shared = common_steps(*columns)
        path = tuple(int(c[0]) for c in columns)
        carried = self.open is not None and self.open[0] == path
        if carried:
            shared[0] = STEPS
        at, node = internal_nodes(shared, STEPS)
        first_row, first_start = row[at], start[at]
        if carried:
            first_row, first_start = np.append(first_row, self.open[1]), np.append(first_start, self.open[2])
            node = np.where(node < 0, len(first_row) - 1, node)
        self.open = (tuple(int(c[-1]) for c in columns), first_row[node[-1]], first_start[node[-1]])
        repeat = (row != first_row[node]) | (start != first_start[node])
        owner, begin, finish = marks(row[repeat], start[repeat], self.length)
        if len(owner):
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(begin.astype(np.int32)), pa.array(finish.astype(np.int32))],
                                             names=["row", "start", "end"])


def passages(located: DataFrame, length: int) -> DataFrame:
    """(row, start, end) of repeats in rows (doc_id, row, text, spots)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Subtrees(length)
        for batch in batches:
            known = batch.filter(pc.greater(batch.column("n"), 0))
            if known.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [known.column("row"), known.column("start"), pc.add(known.column("start"), known.column("n"))],
                    names=["row", "start", "end"])
            yield from trees.add(batch.filter(pc.equal(batch.column("n"), 0)))
        yield from trees.end()

    prefix = prefix_of(F.col("path"), prefix_counts(located, length))
    dealt = F.when(F.col("n") > 0, F.xxhash64("row", "start")).otherwise(prefix)
    sorted_ = suffix_rows(located, length).repartition(dealt).sortWithinPartitions(
        *PATH, F.col("doc_id").asc_nulls_last(), "row", "start")
    return sorted_.mapInArrow(run, "row long, start int, end int")


def repeated_passages(documents: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, row, text, spans) of every row: spans are (start, end) in words, to be removed."""
    rows = documents.select(
        F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(key), text_of(text)).alias("row"), text_of(text).alias("text"))
    gram = min(GRAM, length)
    spots = repeats.repeating_runs(rows, word_symbols, length, gram, SLICE_BYTES, named=False)
    found = passages(rows.join(spots, "row"), length)
    packed = F.shiftleft(F.col("start").cast("long"), 32) + F.col("end")
    spans = found.groupBy("row").agg(F.collect_list(packed).alias("packed")).select("row", F.transform("packed", lambda x: F.struct(
        F.shiftright(x, 32).cast("int").alias("start"), x.bitwiseAND(0x7FFFFFFF).cast("int").alias("end"))).alias("spans"))
    return rows.join(spans, "row", "left")


def without_passages(found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): the words that stay, joined by one space."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_in_slices(batches, limit=SLICE_BYTES):
            words, starts = split_words(batch.column("text"))
            keep = np.ones(len(words), bool)
            for i, spans in enumerate(batch.column("spans")):
                if spans.is_valid:
                    keep[starts[i]:starts[i + 1]] = ~repeats.covered(starts[i + 1] - starts[i], spans.as_py())
            left = np.concatenate([[0], np.cumsum(keep)])[starts]
            lists = pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), words.filter(pa.array(keep)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(starts).astype(np.int64)),
                 pa.array((np.diff(starts) - np.diff(left)).astype(np.int64)), pc.binary_join(lists, " ")],
                names=["doc_id", "n_words", "n_removed", "kept_text"])

    return found.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")
