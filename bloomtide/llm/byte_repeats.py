"""Repeated strings of bytes, by suffix arrays of two-stage sorting.

Every string of ``length`` bytes that also starts earlier (in a row with a smaller
id, or earlier in the same row) is a repeat, and the bytes it covers are removed.

1. Runs of windows that cannot repeat are dropped (``repeats``). The others, cut
   out with the bytes their windows need, are dealt out by the run's name, which
   equal windows share. Names with more bytes than a task sorts at once are split:
   their segments are cut anew and renamed by longer grams, whole windows at most.
2. A task joins the distinct segments of as many names as fit its memory into one
   text and sorts its suffixes in two stages: only those smaller than their
   successors are sorted directly; all others follow by scanning the buckets of
   first bytes in order, each suffix placing the one before it.
3. Adjacent suffixes with a common prefix of ``length`` bytes are one string. Its
   earliest start stays; all others are repeats.

Equal segments of a slice are combined before the shuffle, and equal segments of
a task are sorted once: a copy of a segment is a repeat as a whole.

Defined results: a null or empty text has no bytes; texts shorter than a window
lose nothing; null ids come last in the order; rows of one id are ordered by a
hash of the text; repeated rows (same id and text) are one row, and each gets its
result; an empty table gives an empty one. Cutting may split a character of
several bytes, so what is kept is binary.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from bloomtide.llm import repeats
from bloomtide.llm.common import batches_in_slices, mix, text_of

LENGTH = 100
GRAM = 22
#: Bytes of distinct segments whose suffixes a task sorts at once.
GROUP_BYTES = 1_000_000
#: How many times GROUP_BYTES a split name may have for grams of each share of a window; above, grams are whole windows.
SPLITS = ((4, 0.8), (64, 0.95))
SLICE_BYTES = 1_000_000
SEGMENT_SCHEMA = "name long, doc_id long, row long, start int, n int, bytes binary"
BYTE_VALUES = mix(np.arange(256, dtype=np.uint64))
#: Stands between segments; no text in UTF-8 has it.
BORDER = 0xFF


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and where each text's begin."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def byte_symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, starts = raw_bytes(texts)
    return BYTE_VALUES[raw], starts


def ascending(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it; the last is not."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[-1:] = -1
    change = np.where(step != 0, np.arange(n), n)
    following = np.minimum.accumulate(change[::-1])[::-1]
    return step[following] > 0


def words_at(text: np.ndarray, depth: int) -> np.ndarray:
    """At each place the next eight bytes as one big-endian number (unaligned view)."""
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    return np.ndarray(len(padded) - 8, ">u8", padded, 0, (1,))


def sort_directly(places: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` bytes: eight bytes a round, ties only after the first."""
    key = words[places].astype(np.uint64)
    by = np.argsort(key, kind="stable")
    order, key = places[by], key[by]
    new = np.ones(len(order), bool)
    new[1:] = key[1:] != key[:-1]
    for at in range(8, depth, 8):
        tied = ~new
        tied[:-1] |= ~new[1:]
        where = np.flatnonzero(tied)
        if not len(where):
            break
        group = np.cumsum(new[where])
        some = order[where]
        key = words[some + at].astype(np.uint64)
        by = np.lexsort((key, group))
        order[where], key = some[by], key[by]
        differs = np.ones(len(where), bool)
        differs[1:] = key[1:] != key[:-1]
        new[where] |= differs
    return order


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes in order of their first ``depth`` bytes.

    A suffix that is larger than its successor comes right after all smaller
    buckets are complete: in the order of their suffixes, each places the one
    before it if that is larger. Within a bucket these come first.
    """
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    rising = ascending(text)
    direct = np.flatnonzero(rising)
    direct = sort_directly(direct, words_at(text, depth), depth)
    direct_cuts = np.searchsorted(text[direct], np.arange(257)) if len(direct) else np.zeros(257, np.int64)
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[n - 1]].append(np.array([n - 1]))  # the empty suffix places the last one
    out = []
    for byte in range(256):
        here = []
        while waiting[byte]:
            found = np.concatenate(waiting[byte])
            waiting[byte] = []
            here.append(found)
            before = found[found > 0] - 1
            again = before[(text[before] == byte) & ~rising[before]]
            if len(again):
                waiting[byte].append(again)
        bucket = np.concatenate([*here, direct[direct_cuts[byte]:direct_cuts[byte + 1]]]) if here else direct[direct_cuts[byte]:direct_cuts[byte + 1]]
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[~rising[before] & (text[before] > byte)]
        if len(before):
            first = text[before]
            order = np.argsort(first, kind="stable")
            values, cuts = np.unique(first[order], return_index=True)
            for value, part in zip(values.tolist(), np.split(before[order], cuts[1:]), strict=True):
                waiting[value].append(part)
    return np.concatenate(out)


def same_prefix(places: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """Whether each of the sorted suffixes shares ``length`` bytes with the one before."""
    alike = np.arange(1, len(places))
    for at in [*range(0, length - 7, 8), length - 8]:
        if not len(alike):
            break
        alike = alike[words[places[alike] + at] == words[places[alike - 1] + at]]
    out = np.zeros(len(places), bool)
    out[alike] = True
    return out


def common_prefix_groups(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The wanted starts in suffix order, and the number of the string at each."""
    wanted = np.zeros(len(text), bool)
    wanted[starts] = True
    order = suffix_array(text, -(-length // 8) * 8 + 8)
    order = order[wanted[order]]
    return order, np.cumsum(~same_prefix(order, words_at(text, length), length))


def repeats_in(contents: list[bytes], ranks: np.ndarray, places: np.ndarray, length: int) -> list[np.ndarray]:
    """Of each distinct segment the offsets of windows that start earlier in another place.

    ``ranks`` and ``places`` are the row and start of each segment's first copy.
    """
    sizes = np.array([len(c) for c in contents], np.int64)
    text = np.frombuffer(bytes([BORDER]).join(contents), np.uint8)
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    counts = sizes - length + 1
    segment = np.repeat(np.arange(len(sizes)), counts)
    offset = np.arange(len(segment)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = begins[segment] + offset
    order, group = common_prefix_groups(text, at, length)
    index = np.searchsorted(at, order)
    rank, place = ranks[segment[index]], places[segment[index]] + offset[index]
    by = np.lexsort((place, rank, group))
    first = np.ones(len(by), bool)
    first[1:] = group[by][1:] != group[by][:-1]
    head = by[np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))]
    later = by[(rank[by] != rank[head]) | (place[by] != place[head])]
    found = np.sort(index[later])
    cuts = np.searchsorted(segment[found], np.arange(len(sizes) + 1))
    return [offset[found[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]


def segment_rows(located: DataFrame, length: int) -> DataFrame:
    """Segments of rows (doc_id, row, text, spots).

    n is 0, -1 for a segment that can repeat within itself, and for a copy that is
    known to repeat and comes without its bytes the number of these.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_in_slices(batches, limit=SLICE_BYTES):
            raw, starts = raw_bytes(batch.column("text"))
            text, name, start, n, again = repeats.spots_of(batch)
            rows, ids = batch.column("row").to_numpy(), batch.column("doc_id")
            first_row = np.zeros(len(rows), bool)
            first_row[np.unique(rows, return_index=True)[1]] = True
            order = np.lexsort((start, rows[text], pc.fill_null(ids, 0).to_numpy()[text],
                                ids.is_null().to_numpy(zero_copy_only=False)[text]))
            order = order[first_row[text][order]]
            begin = starts[text] + start
            end = begin + n + length - 1
            data = raw.tobytes()
            seen, sent, copies, parts = set(), [], [], []
            for i, b, e, named in zip(order.tolist(), begin[order].tolist(), end[order].tolist(), name[order].tolist(), strict=True):
                part = data[b:e]
                if (named, part) in seen:
                    copies.append(i)
                else:
                    seen.add((named, part))
                    sent.append(i)
                    parts.append(part)
            every = np.array(sent + copies, np.int64)
            take = pa.array(text[every])
            size = np.concatenate([-again[sent].astype(np.int64), (end - begin)[copies]]) if every.size else every
            yield pa.RecordBatch.from_arrays(
                [pa.array(name[every]), ids.take(take), batch.column("row").take(take), pa.array(start[every].astype(np.int32)),
                 pa.array(size.astype(np.int32)), pa.array(parts + [None] * len(copies), pa.binary())],
                names=["name", "doc_id", "row", "start", "n", "bytes"])

    return located.mapInArrow(run, SEGMENT_SCHEMA)


def split_gram(size: int, bound: int, length: int) -> int:
    """The gram that renames the segments of a name with ``size`` bytes."""
    return next((max(1, round(share * length)) for times, share in SPLITS if size <= times * bound), length)


def pieces_of(part: bytes, name: int, length: int, gram: int) -> list[tuple[int, int, bytes]]:
    """(name, offset, bytes) of a segment's runs of windows with the same least gram; equal windows keep equal names."""
    symbols = BYTE_VALUES[np.frombuffer(part, np.uint8)]
    least = repeats.sliding_least(mix(repeats.rolling(symbols, gram)), length - gram + 1)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    ends = np.append(first[1:], len(least)) + length - 1
    names = mix(least[first] ^ np.array([name], np.int64).view(np.uint64)).view(np.int64)
    return [(n, a, part[a:b]) for n, a, b in zip(names.tolist(), first.tolist(), ends.tolist(), strict=True)]


def split_names(segments: DataFrame, length: int, bound: int) -> DataFrame:
    """The segments, those of names with more than ``bound`` bytes cut into pieces with names of their own.

    Bytes are summed by 24 bits of the name, which shuffles less; a small name that
    shares them with a large one is split as well. The large ones are at most one
    for each ``bound`` bytes of segments.
    """
    part_of_name = F.shiftrightunsigned("name", 40).cast("int").alias("some_bits")
    large = segments.filter("n <= 0").groupBy(part_of_name).agg(F.sum(F.octet_length("bytes")).alias("size")).filter(F.col("size") > bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 2_000) for b in batches for at in range(0, b.num_rows, 2_000)):
            size = batch.column("size")
            batch = batch.select(["name", "doc_id", "row", "start", "n", "bytes"])
            cut = pc.and_(pc.is_valid(size), pc.less_equal(batch.column("n"), 0))
            if not pc.any(cut).as_py():
                yield batch
                continue
            yield batch.filter(pc.invert(cut))
            sizes = size.filter(cut).to_pylist()
            rows = sorted(zip(batch.filter(cut).to_pylist(), sizes, strict=True), key=lambda x: (
                x[0]["doc_id"] is None, x[0]["doc_id"] or 0, x[0]["row"], x[0]["start"]))
            seen: dict[tuple[int, bytes], tuple[int, int]] = {}
            out = []
            for r, total in rows:
                for name, offset, part in pieces_of(r["bytes"], r["name"], length, split_gram(total, bound, length)):
                    place = r["row"], r["start"] + offset
                    earlier = seen.setdefault((name, part), place)
                    known = earlier is not place
                    if not known or earlier != place:  # else the same row again
                        out.append(r | {"name": name, "start": place[1], "n": len(part) if known else r["n"], "bytes": None if known else part})
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_pylist(out, schema=batch.schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=batch.schema)

    return segments.withColumn("some_bits", part_of_name).join(F.broadcast(large), "some_bits", "left").select(
        "name", "doc_id", "row", "start", "n", "bytes", "size").mapInArrow(run, SEGMENT_SCHEMA)


def group_repeats(ids: list[int | None], rows: np.ndarray, starts: np.ndarray, parts: list[bytes], length: int):
    """(row, start, end) of repeats among segments, those of one name sorted by row and start."""
    key = [(x is None, x or 0, r) for x, r in zip(ids, rows.tolist(), strict=True)]
    order_of = {k: i for i, k in enumerate(sorted(set(key)))}
    rank = np.array([order_of[k] for k in key])
    first: dict[bytes, int] = {}
    copy_of = np.array([first.setdefault(p, i) for i, p in enumerate(parts)])
    own = np.flatnonzero(copy_of == np.arange(len(parts)))
    copies = np.flatnonzero(copy_of != np.arange(len(parts)))
    # a copy at the very place of its first is the same row again
    copies = copies[(rows[copies] != rows[copy_of[copies]]) | (starts[copies] != starts[copy_of[copies]])]
    sizes = np.array([len(p) for p in parts])
    out_row, out_start, out_end = [rows[copies]], [starts[copies]], [starts[copies] + sizes[copies]]
    found = repeats_in([parts[i] for i in own], rank[own], starts[own], length)
    for i, offsets in zip(own.tolist(), found, strict=True):
        if len(offsets):
            begin, end = repeats.intervals(offsets, length)
            out_row.append(np.full(len(begin), rows[i]))
            out_start.append(begin + starts[i])
            out_end.append(end + starts[i])
    return np.concatenate(out_row), np.concatenate(out_start), np.concatenate(out_end)


def strings(segments: DataFrame, length: int) -> DataFrame:
    """(row, start, end) of repeats, from segments and known copies."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(rows, starts, ends):
            return pa.RecordBatch.from_arrays(
                [pa.array(rows), pa.array(starts.astype(np.int32)), pa.array(ends.astype(np.int32))], names=["row", "start", "end"])

        held: list[tuple] = []
        size = 0
        last = None

        def flush():
            times = Counter(item[0] for item in held)
            use = [item for item in held if times[item[0]] > 1 or item[1]]
            if use:
                _, _, ids, rows, starts, parts = zip(*use, strict=True)
                yield answer(*group_repeats(ids, np.array(rows, np.int64), np.array(starts, np.int64), list(parts), length))

        for batch in batches:
            copies = batch.filter(pc.greater(batch.column("n"), 0))
            if copies.num_rows:
                start = copies.column("start").to_numpy()
                yield answer(copies.column("row").to_numpy(), start, start + copies.column("n").to_numpy())
            new = batch.filter(pc.less_equal(batch.column("n"), 0))
            for item in zip(*(new.column(c).to_pylist() for c in ("name", "n", "doc_id", "row", "start", "bytes")), strict=True):
                if size >= GROUP_BYTES and item[0] != last:
                    yield from flush()
                    held, size = [], 0
                held.append(item)
                size += len(item[5])
                last = item[0]
        if held:
            yield from flush()

    key = F.when(F.col("n") > 0, F.xxhash64("row", "start")).otherwise(F.col("name"))
    ordered = segments.repartition(key).sortWithinPartitions("name", F.col("doc_id").asc_nulls_last(), "row", "start")
    return ordered.mapInArrow(run, "row long, start int, end int")


def repeated_strings(documents: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH,
                     bound: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, row, text, spans) of every row: spans are (start, end) in bytes, to be removed.

    Names with more than ``bound`` bytes of segments are split.
    """
    rows = documents.select(
        F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(key), text_of(text)).alias("row"), text_of(text).alias("text"))
    spots = repeats.repeating_runs(rows, byte_symbols, length, min(GRAM, length), SLICE_BYTES)
    found = strings(split_names(segment_rows(rows.join(spots, "row"), length), length, bound), length)
    spans = found.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return rows.join(spans, "row", "left")


def without_strings(found: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): the bytes that stay, and maximal removed runs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_in_slices(batches, limit=SLICE_BYTES):
            raw, starts = raw_bytes(batch.column("text"))
            sizes = np.diff(starts)
            removed, n_spans, kept = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
            for i, spans in enumerate(batch.column("spans")):
                own = raw[starts[i]:starts[i + 1]]
                if spans.is_valid:
                    gone = repeats.covered(len(own), spans.as_py())
                    removed[i] = gone.sum()
                    n_spans[i] = np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) > 0)
                    own = own[~gone]
                kept.append(own.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(removed), pa.array(n_spans), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return found.select("doc_id", "text", "spans").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
