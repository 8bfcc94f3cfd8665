"""Passages and byte strings against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bloomtide.llm import byte_repeats, repeats, word_repeats
from tests.llm.frames import WORD, documents


def texts(seed: int) -> list[tuple]:
    """Random words with copied, periodic and overlapping stretches."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for i in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 3)):
            if out and rng.random() < 0.7:
                other = rng.choice(out)[1].split()
                a = rng.randint(0, max(0, len(other) - 1))
                text[rng.randint(0, len(text)):0] = other[a:a + rng.randint(1, 60)]
            else:
                text += [rng.choice(words[:2])] * rng.randint(1, 50) + words[:rng.randint(1, 5)] * rng.randint(1, 12)
        out.append((rng.choice([i, i, i // 2, None]) if i % 9 == 0 else i, rng.choice([" ", " \n"]).join(text)))
    out += [out[5], out[5], (200, out[7][1]), (201, None), (None, out[8][1])]
    return out


def brute(rows, symbols, length):
    """Per row the mask of removed symbols, in the operators' order of rows."""
    unique = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    first, masks = {}, {}
    for row in unique:
        s = symbols(row[1])
        for i in range(len(s) - length + 1):
            first.setdefault(tuple(s[i:i + length]), (row, i))
    for row in unique:
        s = symbols(row[1])
        gone = [False] * len(s)
        for i in range(len(s) - length + 1):
            if first[tuple(s[i:i + length])] != (row, i):
                gone[i:i + length] = [True] * length
        masks[row] = (s, gone)
    return masks


def rows_with_hash(spark, rows):
    df = documents(spark, rows)
    return [tuple(r) for r in df.select(
        "doc_id", F.coalesce("text", F.lit("")), F.xxhash64("doc_id", F.coalesce("text", F.lit("")))).collect()]


@pytest.mark.parametrize(("seed", "length"), [(1, 20), (2, 20), (3, 7)])
def test_passages(spark, seed, length):
    rows = texts(seed)
    want = []
    masks = brute(rows_with_hash(spark, rows), WORD.findall, length)
    for r in rows_with_hash(spark, rows):
        words, gone = masks[r]
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        want.append((r[0], len(words), sum(gone), kept))
    found = word_repeats.repeated_passages(documents(spark, rows).repartition(5), length=length)
    got = [tuple(r) for r in word_repeats.without_passages(found).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize(("seed", "length"), [(1, 100), (4, 30)])
def test_strings(spark, seed, length):
    rows = texts(seed)
    masks = brute(rows_with_hash(spark, rows), lambda t: list(t.encode()), length)
    want = []
    for r in rows_with_hash(spark, rows):
        data, gone = masks[r]
        runs = sum(g and not h for g, h in zip(gone, [False, *gone], strict=False))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        want.append((r[0], len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    found = byte_repeats.repeated_strings(documents(spark, rows).repartition(5), length=length)
    got = [tuple(r) for r in byte_repeats.without_strings(found).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_small_groups_give_the_same(spark, monkeypatch):
    rows = documents(spark, texts(6))
    def both():
        words = word_repeats.without_passages(word_repeats.repeated_passages(rows)).collect()
        data = byte_repeats.without_strings(byte_repeats.repeated_strings(rows)).collect()
        return sorted(map(str, words)), sorted(map(str, data))
    want = both()
    monkeypatch.setattr(word_repeats, "GROUP", 3)
    monkeypatch.setattr(word_repeats, "SLICE_BYTES", 200)
    monkeypatch.setattr(byte_repeats, "GROUP_BYTES", 300)
    monkeypatch.setattr(byte_repeats, "SLICE_BYTES", 200)
    assert both() == want


@pytest.mark.parametrize("length", [20, 7, 2])
def test_nodes_of_every_depth(length):
    rng = np.random.default_rng(length)
    words = rng.integers(0, 3, 600).astype(np.uint64)
    at = np.arange(len(words) - length + 1)
    path, rest = word_repeats.paths(words, at, length)
    order = np.lexsort((rest, path))
    shared = word_repeats.common_steps(path[order], rest[order])
    for step, depth in enumerate(word_repeats.depths(length), 1):
        first, node = word_repeats.internal_nodes(shared, step)
        of_prefix, of_node = {}, {}
        for place, number in zip(order.tolist(), node.tolist(), strict=True):
            prefix = tuple(words[place:place + depth].tolist())
            of_prefix.setdefault(prefix, set()).add(number)
            of_node.setdefault(number, set()).add(prefix)
        assert all(len(x) == 1 for x in of_prefix.values()) and len(first) == len(of_node)
        if step in (1, word_repeats.STEPS):  # the steps between have few bits: prefixes may share a node there
            assert all(len(x) == 1 for x in of_node.values())


def test_a_frequent_start_is_split(spark, monkeypatch):
    """A third of the suffixes begin alike; the prefix they are dealt out by is lengthened until they part."""
    rng = random.Random(3)
    start = [f"s{i}" for i in range(6)]
    passages = [" ".join(start + [f"p{i}x{j}" for j in range(14)]) for i in range(150)]
    rows = documents(spark, [(i, p) for i, p in enumerate(passages + passages)] + [
        (1000 + i, " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 999)) for _ in range(40))) for i in range(20)])
    texts_ = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    spots = repeats.repeating_runs(texts_, word_repeats.word_symbols, 20, 5, 100, named=False)
    located = texts_.join(spots, "row")
    def sizes(group):
        monkeypatch.setattr(word_repeats, "GROUP", group)
        prefix = word_repeats.prefix_of(F.col("path"), word_repeats.prefix_counts(located, 20))
        found = word_repeats.suffix_rows(located, 20).filter("n = 0").groupBy(prefix.alias("prefix")).count()
        return sorted(r["count"] for r in found.collect())
    whole, split = sizes(10_000), sizes(20)
    assert sum(whole) == sum(split) and whole[-1] >= 150 and split[-1] <= 20
    got = word_repeats.without_passages(word_repeats.repeated_passages(rows)).filter("n_removed > 0").collect()
    assert {(r["doc_id"], r["n_removed"]) for r in got} == {(150 + i, 20) for i in range(150)}


@pytest.mark.parametrize("bound", [10_000, 700, 50])
def test_names_with_many_bytes_are_split(spark, bound):
    rng = random.Random(9)
    def some(n):
        return "".join(rng.choice("abcdefghij ") for _ in range(n))
    phrase = some(40)
    rows = [(i, some(150) + phrase + some(150)) for i in range(300)]
    rows += [(400 + i, some(30) + rows[i][1][90 + i:260] + some(50)) for i in range(30)] + [rows[3], (None, rows[4][1])]
    df = documents(spark, rows).repartition(4)
    found = byte_repeats.repeated_strings(df, bound=bound)
    got = {(r["doc_id"], r["kept"]) for r in byte_repeats.without_strings(found).select("doc_id", "kept").collect()}
    masks = brute(rows_with_hash(spark, rows), lambda t: list(t.encode()), 100)
    assert got == {(r[0], bytes(b for b, g in zip(*m, strict=True) if not g)) for r, m in masks.items()}
    texts_ = df.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    spots = repeats.repeating_runs(texts_, byte_repeats.byte_symbols, 100, 22, 10**6)
    segments = byte_repeats.segment_rows(texts_.join(spots, "row"), 100)
    def largest(some_segments):
        return some_segments.filter("n <= 0").groupBy("name").agg(F.sum(F.octet_length("bytes")).alias("size")).agg(F.max("size")).first()[0]
    assert largest(segments) > 20_000 and largest(byte_repeats.split_names(segments, 100, bound)) < 2_000


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(0, 2 + seed * 40, rng.integers(1, 400)).astype(np.uint8)
    if seed % 2:
        text = np.concatenate([text, text[: len(text) // 2], np.zeros(30, np.uint8)])
    got = byte_repeats.suffix_array(text, 1000)
    want = sorted(range(len(text)), key=lambda i: text[i:].tobytes() + b"")
    assert got.tolist() == want


def test_rolling_and_least():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 2**63, 300).astype(np.uint64)
    values[100:105] = values[200:205]
    for gram in (1, 2, 5, 7):
        hashes = repeats.rolling(values, gram)
        grams = [tuple(values[i:i + gram]) for i in range(len(values) - gram + 1)]
        assert (len(set(grams)) == len(set(hashes.tolist()))) and hashes[100 if gram < 6 else 0] == hashes[200 if gram < 6 else 0]
        for width in (1, 4, 9):
            want = [hashes[i:i + width].min() for i in range(len(hashes) - width + 1)]
            assert repeats.sliding_least(hashes, width).tolist() == want
