"""Finding which windows of texts can repeat, before any window is moved.

A window is ``length`` consecutive symbols (bytes, or hashed words). The smallest
hash among its grams of ``gram`` symbols names it: equal windows have equal names,
and neighbouring windows mostly share one, so a text falls into runs of windows
of one name, a few for each window length. A window can only repeat when its name
occurs in another run, or when the gram that names it occurs twice in the run (a
text that repeats itself). All other runs are dropped here.

Within a slice of texts a name that occurs several times is known to repeat; only
one of its runs is compared with other slices, so a passage that stands in a
third of all texts costs one row a slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from bloomtide.llm.common import batches_in_slices, mix

NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
POINT = np.uint64(0xC2B2AE3D27D4EB4F)
RUN_SCHEMA = "name long, row long, start int, n int, known int"


def rolling(values: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all grams of a row of 64-bit values, by doubling: O(log gram) passes."""
    n = len(values) - gram + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, size, done, out = values.copy(), 1, 0, None
    factor = np.array([POINT])  # an array wraps around silently
    while True:
        if gram & size:
            # ``out`` covers ``done`` symbols from each place; the next ``size`` follow
            out = power if out is None else out[:len(power) - done] * factor + power[done:][:len(out)]
            done += size
        if done == gram:
            return mix(out[:n])
        power = power[:len(power) - size] * factor + power[size:]
        factor = factor * factor
        size *= 2


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of each ``width`` neighbours, by running minima from block borders."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, values.dtype)
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, NONE)
    padded[:len(values)] = values
    table = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(table, axis=1).ravel()
    backward = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1:width - 1 + n])


def runs(values: np.ndarray, starts: np.ndarray, length: int, gram: int):
    """(name, text, start, n, again) of the runs of windows of one name in texts that begin at ``starts``.

    ``again`` tells of runs that hold their gram more than once.
    """
    grams = rolling(values, gram)
    width = length - gram + 1
    names = sliding_least(grams, width)
    sizes = np.diff(starts)
    windows = np.maximum(sizes - length + 1, 0)
    text = np.repeat(np.arange(len(sizes)), windows)
    place = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    names = names[starts[:-1][text] + place] if len(text) else np.empty(0, np.uint64)
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    sizes_of = np.diff(np.append(first, len(names)))
    begin = starts[:-1][text[first]] + place[first] if len(first) else first
    return names[first], text[first], place[first], sizes_of, repeating(grams, names[first], begin, sizes_of, width)


def repeating(grams: np.ndarray, names: np.ndarray, begin: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """Whether a run's gram stands in it more than once.

    Places are held against the few runs that cover them. Only small hashes can
    name a run of ordinary text; runs with a large one count as repeating.
    """
    if not len(names):
        return np.zeros(0, bool)
    bound = np.uint64(int(min(0.5, 16 / width) * 2**64))
    at = np.flatnonzero(grams < bound)
    run = np.searchsorted(begin, at, side="right") - 1
    keep = run >= 0
    at, run = at[keep], run[keep]
    count = np.zeros(len(names), np.int64)
    while len(at):
        inside = at < begin[run] + n[run] + width - 1
        hit = inside & (grams[at] == names[run])
        count += np.bincount(run[hit], minlength=len(names))
        # an earlier run may cover the place too, if it ends late enough
        go = (run > 0) & (begin[np.maximum(run - 1, 0)] + n[np.maximum(run - 1, 0)] + width - 1 > at)
        at, run = at[go], run[go] - 1
    return (count > 1) | (names >= bound)


def known_repeats(names: np.ndarray) -> np.ndarray:
    """0: occurs once here; 1: repeats here; 2: repeats here and speaks for its name elsewhere."""
    _, first, inverse, counts = np.unique(names, return_index=True, return_inverse=True, return_counts=True)
    known = (counts > 1).astype(np.int32)[inverse]
    known[first[counts > 1]] = 2
    return known


def repeating_runs(rows: DataFrame, symbols, length: int, gram: int, slice_bytes: int, named: bool = True) -> DataFrame:
    """(row, spots): for each row its runs (name, start, n, again) whose windows can repeat.

    ``rows`` has columns row and text; ``symbols(texts)`` gives 64-bit values and
    where each text's begin. Without ``named`` the names are 0.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_in_slices(batches, limit=slice_bytes):
            names, text, start, n, again = runs(*symbols(batch.column("text")), length, gram)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names.view(np.int64)), batch.column("row").take(pa.array(text)), pa.array(start.astype(np.int32)),
                 pa.array(n.astype(np.int32)), pa.array(known_repeats(names) + 4 * again.astype(np.int32))],
                names=["name", "row", "start", "n", "known"])

    packed = rows.select("row", "text").mapInArrow(run, RUN_SCHEMA).select(
        "name", "row", (F.shiftleft(F.col("start").cast("long"), 32) + F.shiftleft(F.col("n").cast("long"), 3) + F.col("known")).alias("spot"))
    known = F.col("spot").bitwiseAND(3)
    # what is known to repeat needs no comparison and is dealt out by its row as well
    salted = F.when(known == 1, F.col("name").bitwiseXOR(F.col("row"))).otherwise(F.col("name"))
    counted = packed.select("row", "spot", salted.alias("name")).withColumn(
        "runs", F.count("*").over(W.partitionBy("name")))
    name = salted if named else F.lit(0).cast("long")  # salting twice gives the name back
    n, again = F.shiftright("spot", 3).bitwiseAND((1 << 29) - 1), F.col("spot").bitwiseAND(4) > 0
    return (
        counted.filter((F.col("runs") > 1) | (known > 0) | again)
        .select("row", name.alias("name"), F.shiftright("spot", 32).cast("int").alias("start"), n.cast("int").alias("n"), again.alias("again"))
        .groupBy("row").agg(F.collect_list(F.struct("name", "start", "n", "again")).alias("spots"))
    )


def spots_of(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(text, name, start, n, again) of all spots of a batch, by text and start."""
    lists = batch.column("spots")
    flat = lists.flatten()
    text = pc.list_parent_indices(lists).to_numpy()
    name, start, n, again = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
    order = np.lexsort((start, text))
    # a repeated row brings its runs again
    new = np.ones(len(order), bool)
    new[1:] = (text[order][1:] != text[order][:-1]) | (start[order][1:] != start[order][:-1])
    order = order[new]
    return text[order], name[order], start[order].astype(np.int64), n[order].astype(np.int64), again[order]


def intervals(marked: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """What windows at ascending, distinct places cover: starts and ends of neighbouring runs."""
    if not len(marked):
        return marked, marked
    first = np.flatnonzero(np.concatenate([[True], np.diff(marked) > 1]))
    last = np.append(first[1:], len(marked)) - 1
    return marked[first], marked[last] + length


def covered(size: int, spans: list[dict] | None) -> np.ndarray:
    """A mask of the symbols that spans cover."""
    edges = np.zeros(size + 1, np.int32)
    for span in spans or ():
        edges[span["start"]] += 1
        edges[span["end"]] -= 1
    return np.cumsum(edges[:-1]) > 0
