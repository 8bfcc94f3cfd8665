"""Classes of the n-gram join against all pairs."""

from __future__ import annotations

import random

import pytest

from bloomtide.llm import ngram_join
from tests.llm.frames import WORD, documents


def near_copies(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(3000)]
    out = []
    for group in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([2, 8, 40, 150]))]
        for _ in range(rng.randint(1, 12)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                text += base[:3]
            out.append((len(out) * 7 % 101, (" ".join(text)).title() if rng.random() < 0.3 else " ".join(text)))
    return out + [(500, None), (501, ""), (None, out[0][1]), out[3]]


def brute(rows, n, num, den):
    sets = []
    for _, text in rows:
        words = WORD.findall((text or "").lower())
        sets.append({tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(least.get(root(i), key), key)
    return [(key, len(sets[i]), least.get(root(i))) for i, (key, _) in enumerate(rows)]


@pytest.mark.parametrize(("seed", "n", "num"), [(1, 3, 90), (2, 5, 80), (3, 3, 60)])
def test_classes(spark, seed, n, num):
    rows = near_copies(seed)
    got = ngram_join.classes(documents(spark, rows), n=n, num=num).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows, n, num, 100), key=str)


def test_one_of_each(spark):
    rows = near_copies(4)
    docs = documents(spark, rows)
    got = [tuple(r)[:2] for r in ngram_join.one_of_each(docs).collect()]
    assert len(got) == len(set(got))
    classes = brute(rows, 5, 80, 100)
    want = {key for key, size, least in classes if size and key == least}
    assert {k for k, t in got if t} == want
    assert {(500, None), (501, "")} <= set(got)


def test_a_line_that_hundreds_of_unlinked_texts_share(spark):
    """Short texts of which the shared line is a large part, so that its n-grams are prefix n-grams."""
    rng = random.Random(9)
    line = "this text may be copied by all who name its source"
    rows = [(i, f"{line} {' '.join(f'u{rng.randrange(10**6)}' for _ in range(rng.randint(1, 4)))}") for i in range(300)]
    rows += [(1000 + i, rows[i][1] + (" x" if i % 2 else "")) for i in range(0, 300, 10)]
    got = ngram_join.classes(documents(spark, rows), n=3, num=80).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, 3, 80, 100))


def test_a_set_that_many_are_held_against_is_copied(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SHARE", 5)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:-1] + [f"z{i}"])) for i in range(80)]
    got = ngram_join.classes(documents(spark, rows), n=3, num=90).collect()
    assert {r["component_id"] for r in got} == {0} and len(got) == 80
