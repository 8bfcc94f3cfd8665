"""Benchmark items inside documents, within an edit distance.

An item of m characters may be altered by k = floor(rate * m) edits. It is split
into k + 1 pieces; k edits cannot touch all of them, so every altered copy holds
one piece unchanged (pigeonhole). One automaton finds the pieces of all items in
a pass over a text, and each hit is verified with Myers' bit-parallel distance on
the stretch around it, once for a diagonal. The same argument holds for halves:
of the pieces of an altered copy at least one also lies in a pair with one edit
at most, that in a four with three, and so on up to the item, so a hit is
verified on ever longer stretches and most end at the first.

Items and texts are compared in lower case with runs of white space as one space.
The items are the query set: they are taken in blocks of ``block_chars``
characters (a longer item is one of its own). The driver reads one block at a time.
One block is a function of the documents' own stage; several are one job each, which
stores the hits of the texts that have any, and the documents are joined with these
by 128 bits of hashes of the text. So a task holds one block, whatever their number.

Defined results: a null or empty text contains nothing; null or empty items and
items with a null id match nothing; an item listed twice is reported once;
repeated rows get the same result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bloomtide.llm.common import Scratch, free_name

HITS = "array<struct<item_id:bigint,start:int,end:int,distance:int>>"
HIT_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("distance", pa.int32())]))


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """The item in ``budget + 1`` parts of equal length, to within one: (offset, part)."""
    n = min(budget + 1, len(item))
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks_of(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def best_end(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(distance, end): the least edits that turn the item into a stretch of the text, and where the first ends.

    Myers' bit vectors; one addition and a few logical steps for each character.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, at = m, 0
    get = masks.get
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        across = ((((eq & plus) + plus) ^ plus) | eq | minus)
        up = minus | (~(across | plus) & full)
        down = plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | (~(across | up) & full)
        minus = up & across
        if score < best:
            best, at = score, j
    return best, at


def stretches(item: str, parts: list[tuple[int, str]]) -> list[list[tuple]]:
    """For each piece the stretches of the item around it, from two pieces up to less than all.

    Each is (start, end, edits allowed, masks), halves of halves of the pieces.
    """
    chains: list[list[tuple]] = [[] for _ in parts]

    def halve(first: int, last: int) -> None:
        if last - first > 1:
            middle = (first + last) // 2
            halve(first, middle)
            halve(middle, last)
            if last - first < len(parts):
                start = parts[first][0]
                end = parts[last][0] if last < len(parts) else len(item)
                node = start, end, last - first - 1, masks_of(item[start:end])
                for i in range(first, last):
                    chains[i].append(node)

    halve(0, len(parts))
    return chains


def climbs(chain: list[tuple], text: str, diagonal: int) -> bool:
    """Whether all stretches around a piece are there within their edits."""
    for start, end, allowed, masks in chain:
        around = text[max(0, diagonal + start - allowed):max(0, diagonal + end + allowed)]
        if best_end(masks, end - start, around)[0] > allowed:
            return False
    return True


class Finder:
    """Finds a block of items in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = []
        places: dict[str, list[tuple]] = {}
        for item_id, text in items:
            budget = int(rate * len(text))
            parts = pieces(text, budget)
            for (offset, part), chain in zip(parts, stretches(text, parts), strict=True):
                places.setdefault(part, []).append((len(self.items), offset, chain))
            self.items.append((item_id, text, budget, masks_of(text), masks_of(text[::-1])))
        self.automaton = ahocorasick.Automaton()
        for part, where in places.items():
            self.automaton.add_word(part, (len(part), where))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[dict]:
        if not text or not self.items:
            return []
        text = normalised(text)
        best: dict[int, tuple[int, int, int]] = {}
        tried: dict[int, set[int]] = {}
        for last, (length, where) in self.automaton.iter(text):
            for index, offset, chain in where:
                diagonal = last + 1 - length - offset
                seen = tried.setdefault(index, set())
                if diagonal in seen or not climbs(chain, text, diagonal):
                    continue
                seen.add(diagonal)
                item_id, item, budget, masks, reverse = self.items[index]
                known = best.get(item_id)
                if known and known[0] == 0:
                    continue
                m = len(item)
                if diagonal >= 0 and text.startswith(item, diagonal):
                    best[item_id] = (0, diagonal, diagonal + m)
                    continue
                low = max(0, diagonal - budget)
                stretch = text[low:diagonal + m + budget]
                if len(stretch) < m - budget:
                    continue
                distance, end = best_end(masks, m, stretch)
                if distance <= budget and (known is None or distance < known[0]):
                    _, back = best_end(reverse, m, stretch[:end][::-1])
                    best[item_id] = (distance, low + end - back, low + end)
        return [{"item_id": i, "start": s, "end": e, "distance": d} for i, (d, s, e) in sorted(best.items())]


def item_blocks(items: DataFrame, key: str, text: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The distinct items, normalised, block by block; a longer item is a block of its own."""
    block, size = [], 0
    rows = items.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).cast("long").alias("k"), F.col(text).alias("t")).distinct().orderBy("k", "t")
    for row in rows.toLocalIterator():
        item = normalised(row["t"])
        if not item:
            continue
        if block and size + len(item) > block_chars:
            yield block
            block, size = [], 0
        block.append((row["k"], item))
        size += len(item)
    if block:
        yield block


def item_hits(text: Column, block: list[tuple[int, str]], rate: float) -> Column:
    """For one block: the best match of each item found, by item id."""
    @F.arrow_udf(HITS)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder = Finder(block, rate)
        for texts in batches:
            yield pa.array([finder.find(t.as_py()) for t in texts], HIT_TYPE)

    return found(text)


def with_benchmark_hits(documents: DataFrame, items: DataFrame, item_key: str = "item_id", item_text: str = "text",
                        text: str = "text", name: str = "benchmark_hits", rate: float = 0.1,
                        block_chars: int = 1_000_000) -> DataFrame:
    """Add (or replace) ``name``: (item_id, start, end, distance) in the normalised text."""
    blocks = item_blocks(items, item_key, item_text, block_chars)
    few = list(itertools.islice(blocks, 2))
    if len(few) < 2:
        return documents.withColumn(name, item_hits(F.col(text), few[0], rate) if few else F.array().cast(HITS))
    scratch, names = Scratch(documents.sparkSession, "benchmark-hits"), [c for c in documents.columns if c != name]
    by_text = [F.xxhash64(F.col(text)), F.xxhash64(F.lit(1), F.col(text))]
    bodies = documents.filter(F.length(text) > 0).select(*[h.alias(f"h{i}") for i, h in enumerate(by_text)], F.col(text).alias("body"))
    stored = [
        scratch.store(bodies.select("h0", "h1", item_hits(F.col("body"), block, rate).alias("hits")).filter(F.size("hits") > 0))
        for block in itertools.chain(few, blocks)]
    # texts that stand in several rows bring the same hits again
    each = reduce(DataFrame.unionByName, stored).select("h0", "h1", F.explode("hits").alias("hit")).distinct()
    first = each.groupBy("h0", "h1", "hit.item_id").agg(F.min(F.struct("hit.distance", "hit.start", "hit.end")).alias("best"))
    hit = F.struct("item_id", "best.start", "best.end", "best.distance")
    h0, h1 = free_name(documents, "_h0"), free_name(documents, "_h1")
    found = first.groupBy(F.col("h0").alias(h0), F.col("h1").alias(h1)).agg(F.array_sort(F.collect_list(hit)).alias(name))
    joined = documents.select(*names, by_text[0].alias(h0), by_text[1].alias(h1)).join(found, [h0, h1], "left")
    return joined.select(*names, F.coalesce(F.col(name), F.array().cast(HITS)).alias(name))
