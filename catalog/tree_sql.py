"""Whole trees and forests in SQL: bins, draws of rows and features, and every split down to the leaves."""

from __future__ import annotations

import math
from collections.abc import Sequence

from catalog.registry import r

WORD = f"{(1 << 64) - 1}::UHUGEINT"  # words are multiplied in 128 bits, and the last 64 count
BINS = 32
#: Integers have a hash of their own.
WHOLE = ("label", "season", "year")
P1, P2, P3, P4, P5 = (f"{p}::UHUGEINT" for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _times(a: str, b: str) -> str:
    return f"(({a}) * {b} & {WORD})"


def _right(x: str, bits: int) -> str:
    return f"(({x}) >> {bits}::UHUGEINT)"


def _turned(x: str, bits: int) -> str:
    return f"({_times(x, f'{1 << bits}::UHUGEINT')} + {_right(x, 64 - bits)})"


def _mixed(h: str, part: str) -> str:
    """The next word of a hash of seeds, trees, nodes, rows and features."""
    a = _times(f"xor({h}, CAST({part} AS UHUGEINT))", f"{0x9E3779B97F4A7C15}::UHUGEINT")
    b = _times(f"xor({a}, {_right(a, 29)})", f"{0xBF58476D1CE4E5B9}::UHUGEINT")
    return f"xor({b}, {_right(b, 32)})"


def _ids(features: Sequence[str]) -> str:
    """``ids``: xxhash64 of each row, column by column in the order of their names."""
    names = sorted([*features, "label"])
    words = []
    for i, c in enumerate(names, 1):
        if c in WHOLE:
            a = _times(f"CAST((CAST({c} AS BIGINT) + 4294967296) % 4294967296 AS UHUGEINT)", P1)
        else:
            bits = f"CAST(CAST(CAST({c} AS DOUBLE) AS BIT) AS UBIGINT)"
            a = _times(_turned(_times(f"CAST({bits} AS UHUGEINT)", P2), 31), P1)
        words.append(f"SELECT row, {i} AS i, {a} AS a, {str(c in WHOLE).lower()} AS whole FROM numbered")
    return f"""words AS MATERIALIZED ({' UNION ALL '.join(words)}),
chain AS (
  SELECT 0 AS i, row, 42::UHUGEINT AS h FROM numbered
  UNION ALL
  SELECT i, row, CASE WHEN a IS NULL THEN h ELSE xor(e, {_right('e', 32)}) END FROM (
    SELECT *, {_times(f"xor(d, {_right('d', 29)})", P3)} AS e FROM (
      SELECT *, {_times(f"xor(c, {_right('c', 33)})", P2)} AS d FROM (
        SELECT *, CASE WHEN whole THEN {_times(_turned('b', 23), P2)} + {P3} ELSE {_times(_turned('b', 27), P1)} + {P4} END & {WORD} AS c FROM (
          SELECT w.i, w.row, h, a, whole, xor(h + {P5} + CASE WHEN whole THEN 4::UHUGEINT ELSE 8::UHUGEINT END & {WORD}, a) AS b
          FROM chain JOIN words w ON w.row = chain.row AND w.i = chain.i + 1))))),
ids AS (SELECT row, h AS id FROM chain WHERE i = {len(names)})"""


def _steps() -> list[float]:
    """Where a uniform number passes to the next number of draws: Poisson with mean 1."""
    out, p, total = [], math.exp(-1.0), 0.0
    for k in range(1, 12):
        total += p
        out.append(total)
        p /= k
    return out


def grown_nodes_sql(train: str, weights: str, features: Sequence[str], gini: str, *, trees: int = 1, seed: int | None = None) -> str:
    """``nodes`` of ``trees`` trees grown to the end.

    ``train`` has t, ``weights`` ww, ``gini`` is the gain of l0.., r0.., a0... With ``seed``
    each tree has rows of its own and each node a choice of features.
    """
    n = len(features)
    values = " UNION ALL ".join(f"SELECT row, {j} AS pos, CAST({f} AS DOUBLE) AS v FROM numbered" for j, f in enumerate(features, 1))
    if seed is None:
        draws = f"drawn AS (SELECT CAST(tree AS INTEGER) AS tree, row, 1 AS w FROM numbered, (SELECT unnest(range({trees})) AS tree) x)"
        tried = f"SELECT tree, node, unnest(range(1, {n + 1})) AS f FROM n"
    else:
        u = f"CAST({_right(_mixed('rows_', 'id'), 11)} AS DOUBLE) / 9007199254740992"
        draws = f"""{_ids(features)},
seeds AS MATERIALIZED (SELECT CAST(tree AS INTEGER) AS tree, {_mixed(_mixed('0::UHUGEINT', str(seed)), 'tree')} AS rows_,
  {_mixed(_mixed('0::UHUGEINT', str(seed + 1)), 'tree')} AS nodes_ FROM (SELECT unnest(range({trees})) AS tree) x),
drawn AS (SELECT tree, row, {' + '.join(f'CAST(u >= {s!r} AS INTEGER)' for s in _steps())} AS w
  FROM (SELECT tree, row, {u} AS u FROM ids, seeds))"""
        tried = f"""SELECT tree, node, f + 1 AS f FROM (SELECT tree, node, unnest(range({n})) AS f, {_mixed('nodes_', 'node')} AS h FROM n JOIN seeds USING (tree))
    QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY {_mixed('h', 'f')}) <= {max(1, math.isqrt(n))}"""
    counts = ", ".join(f"CAST(coalesce(sum(w) FILTER (WHERE y = {c}), 0) AS BIGINT) AS {{0}}{c}" for c in range(3))
    left = ", ".join(f"CAST(sum(n{c}) OVER (PARTITION BY tree, node, f ORDER BY bin) AS BIGINT) AS l{c}" for c in range(3))
    right = ", ".join(f"a{c} - l{c} AS r{c}" for c in range(3))
    return f"""WITH RECURSIVE {train}, {weights},
numbered AS MATERIALIZED (SELECT row_number() OVER () AS row, label, {', '.join(f if f in WHOLE else r(f) for f in features)} FROM t),
values_ AS MATERIALIZED ({values}),
ranks AS (SELECT pos, v, sum(n) OVER (PARTITION BY pos ORDER BY v) AS upto, sum(n) OVER (PARTITION BY pos) AS n, count(*) OVER (PARTITION BY pos) AS d
  FROM (SELECT pos, v, count(*) AS n FROM values_ WHERE v IS NOT NULL GROUP BY 1, 2)),
edges AS MATERIALIZED (SELECT pos, list(v ORDER BY v) AS e FROM (
    SELECT pos, v FROM ranks WHERE d <= {0.8 * BINS} UNION
    SELECT pos, min(v) AS v FROM ranks, (SELECT unnest(range(1, {BINS})) AS k) k WHERE d > {0.8 * BINS} AND upto * {BINS} >= k * n GROUP BY pos, k)
  GROUP BY pos),
binned AS MATERIALIZED (SELECT row, list(CASE WHEN v IS NULL THEN len(e) ELSE coalesce(len(list_filter(e, lambda x: x < v)), 0) END ORDER BY pos) AS bins
  FROM values_ LEFT JOIN edges USING (pos) GROUP BY row),
known AS MATERIALIZED (SELECT row, label AS y, bins FROM binned JOIN numbered USING (row)),
{draws},
s AS (
  SELECT tree, CAST(0 AS BIGINT) AS node, row, w, CAST(1 AS BIGINT) AS f, CAST(-1 AS BIGINT) AS bin, 0.0::DOUBLE AS gain FROM drawn WHERE w > 0
  UNION ALL (
  WITH x AS MATERIALIZED (SELECT tree, 2 * node + CAST(bins[f] > bin AS INTEGER) AS node, s.row, w, y, bins FROM s JOIN known ON known.row = s.row WHERE f IS NOT NULL),
  n AS MATERIALIZED (SELECT tree, node, {counts.format('a')} FROM x GROUP BY 1, 2),
  tried AS ({tried}),
  cells AS (SELECT x.tree, x.node, f, CAST(bins[f] AS BIGINT) AS bin, {counts.format('n')}
    FROM x JOIN tried ON tried.tree = x.tree AND tried.node = x.node GROUP BY 1, 2, 3, 4),
  lefts AS (SELECT tree, node, f, bin, {left} FROM cells),
  sides AS (SELECT lefts.*, a0, a1, a2, {right} FROM lefts JOIN n ON n.tree = lefts.tree AND n.node = lefts.node),
  gains AS (SELECT tree, node, f, bin, {gini} AS gain FROM sides, ww WHERE l0 + l1 + l2 > 0 AND r0 + r1 + r2 > 0),
  best AS (SELECT tree, node, arg_min({{'f': f, 'bin': bin, 'gain': gain}}, {{'a': -gain, 'b': f, 'c': bin}}) AS b FROM gains GROUP BY 1, 2 HAVING max(gain) > 0)
  SELECT x.tree, x.node, row, w, b.f, b.bin, coalesce(b.gain, 0.0) FROM x LEFT JOIN best ON best.tree = x.tree AND best.node = x.node)),
grown AS (SELECT tree, node, any_value(f) AS f, any_value(bin) AS bin, any_value(gain) AS gain, {counts.format('n')}
  FROM s JOIN known ON known.row = s.row WHERE node > 0 GROUP BY 1, 2),
nodes AS (SELECT tree, node, {list(features)}[f] AS feature, e[bin + 1] AS threshold, gain, n0, n1, n2 FROM grown LEFT JOIN edges ON pos = f)"""
