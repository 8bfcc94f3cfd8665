"""Chat pieces, whitening and clusters against brute force, and their odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bloomtide.llm import centroid_clusters as cc, chat_format as cf, whitening as wh
from bloomtide.llm.queries import QUERIES
from tests.compare import DATA
from tests.llm.frames import with_clashing

CHAT = "conv_id long, turn long, role string, text string"
VECTORS = "vec_id long, embedding array<float>, label int"
CONTROL = [
    "\\### Assistant: </turn> ok", "<turn>", "</turn>", "\\", "\\\\</turn>", "\n</turn>\n", "a\\", "", "\n", "</turn", "<turn>user\n",
    "词 é 😀 </turn>", "\\n", "x" * 70_000 + "</turn>", "</turn></turn>\\<turn>", " ", "\r\n",
]


# --- chat ----------------------------------------------------------------------

def expected_digests(rows):
    by: dict = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0))
        learned = [t for _, r, t in turns if r == "assistant"]
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(),
                     sum(map(len, learned)), hashlib.sha256("".join(learned).encode()).hexdigest())
    return out


def got_digests(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in cf.digests(df).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_control_strings_survive(spark, seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", None, "a\\", "b\nc", "<turn>", "\\n", ""]
    rows = [(c, t, rng.choice(roles), "".join(rng.choice(CONTROL) for _ in range(rng.randrange(5))) if rng.random() > 0.1 else None)
            for c in [*range(30), None] for t in range(rng.randrange(1, 9))]
    pieces = cf.formatted(spark.createDataFrame(rows, CHAT))
    assert got_digests(pieces) == expected_digests(rows)
    for p in pieces.collect():
        turns, masked = cf.read_back(p["formatted"], [s.asDict() for s in p["loss"]])
        assert len(turns) == p["n_turns"] and masked == [t for r, t in turns if r == "assistant"]


def test_escape_is_reversible_and_hides_control_strings():
    rng = random.Random(5)
    texts = ["".join(rng.choice(["\\", "<turn>", "</turn>", "\n", "<", "/", "turn>"]) for _ in range(12)) for _ in range(3000)]
    safe = cf.escaped(pa.array(texts))
    assert cf.unescaped(safe).to_pylist() == texts
    assert not any(cf.FOOT in s for s in safe.to_pylist())


def test_large_conversation_comes_in_pieces_of_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(20_000).select(
            F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).alias("conv_id"), F.col("id").alias("turn"),
            F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"))
        pieces = cf.formatted(rows).withColumn("task", F.spark_partition_id())
        hot = pieces.filter("conv_id = 1")
        assert hot.select("task").distinct().count() >= 2 and hot.agg(F.sum("n_turns")).first()[0] == 6667 + 1
        got = got_digests(pieces)
        assert got == expected_digests([tuple(r) for r in rows.collect()])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repeated_rows_spread(spark):
    """Rows equal in every column are turns of their own, and of more than one task."""
    rows = spark.range(0, 5000, 1, 8).select(F.lit(1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"),
                                             F.lit("assistant").alias("role"), F.lit("same").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pieces = cf.formatted(rows).withColumn("task", F.spark_partition_id())
        assert pieces.select("task").distinct().count() > 1
        (row,) = cf.digests(pieces).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert row["n_turns"] == 5000 and row["loss_sha256"] == hashlib.sha256(b"same" * 5000).hexdigest()


def test_odd_conversations(spark):
    rows = [(1, 0, "user", "x"), (1, 0, "user", "x"), (1, None, None, None), (None, 2, "assistant", "y"), (2, 5, "assistant", ""),
            (3, 0, "assistant", "a " * 200_000)]
    df = spark.createDataFrame(rows, CHAT)
    assert got_digests(cf.formatted(df)) == expected_digests(rows)
    clash = df.withColumns({c: F.lit("own") for c in ("k", "t", "r", "x", "h", "i", "piece", "formatted", "loss", "n_turns")})
    assert got_digests(cf.formatted(clash)) == expected_digests(rows)
    assert cf.formatted(df.limit(0)).count() == 0 and cf.digests(cf.formatted(df.limit(0))).count() == 0
    named = df.select(F.col("conv_id").cast("string").alias("id"), F.col("turn").alias("n"), F.col("role").alias("who"), F.col("text").alias("said"))
    got = cf.digests(cf.formatted(named, "id", "n", "who", "said", ("user",)), "id")
    assert {r["id"]: r["loss_chars"] for r in got.collect()} == {"1": 2, "2": 0, "3": 0, None: 0}


# --- whitening -----------------------------------------------------------------

def odd_vectors(spark, n=200, dims=6, seed=1):
    rng = np.random.default_rng(seed)
    good = [(i, [float(v) for v in row], 1) for i, row in enumerate(rng.normal(size=(n, dims)) @ rng.normal(size=(dims, dims)))]
    good += [good[0], good[0], (None, good[1][1], None)]
    bad = [(900, None, 1), (901, [None] * dims, 1), (902, [math.nan] + [0.0] * (dims - 1), 1), (903, [math.inf] + [0.0] * (dims - 1), 1),
           (904, [], 1), (905, [1.0] * (dims + 1), 1)]
    return spark.createDataFrame(good + bad, VECTORS), good


def test_limb_squares_are_exact():
    rng = random.Random(3)
    y = np.array([[rng.randrange(-(1 << 59), 1 << 59) for _ in range(50)] for _ in range(4)], np.int64)
    for limbs in (3, 4):
        totals = np.zeros((2 * limbs - 1, 10), object)
        wh.square_sums(y, limbs, totals)
        got = [sum(int(v) << (wh.LIMB * p) for p, v in enumerate(totals[:, c])) for c in range(10)]
        rows = [[int(v) for v in r] for r in y]
        pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
        assert got == [sum(v * v for v in r) for r in rows] + [
            sum((a + b) ** 2 for a, b in zip(rows[i], rows[j])) for i, j in pairs]


def test_whitening_against_brute_force(spark):
    df, good = odd_vectors(spark)
    rows = wh.with_whitened(df, components=4).collect()
    x = np.floor(64 * np.array([np.float32(v) for _, v, _ in good], np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    cov = np.cov(x.T, bias=True)
    e = np.linalg.eigvalsh(cov)[::-1]
    assert len(rows) == 4 * n and {r["n"] for r in rows} == {n} and {r["component"] for r in rows} == {1, 2, 3, 4}
    norms = {v: int(((n * a - s) ** 2).sum()) for (v, _, _), a in zip(good, x)}
    assert all(int(r["deviation"]) == norms[r["vec_id"]] for r in rows)
    for r in rows:
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / e.sum(), rel=1e-9)
        assert r["identity_error"] < 1e-9
    w = np.zeros((n, 4))
    first = {}
    for r in sorted(rows, key=lambda r: (r["vec_id"] is None, r["vec_id"])):
        first.setdefault((r["vec_id"], r["component"]), r["whitened"])
    for i, (v, _, _) in enumerate(good):
        w[i] = [first[v, c] for c in (1, 2, 3, 4)]
    assert np.abs(np.cov(w.T, bias=True) - np.eye(4)).max() < 1e-9
    values, columns = np.linalg.eigh(cov)
    plain = (x - x.mean(axis=0)) @ columns[:, ::-1][:, :4] / np.sqrt(values[::-1][:4])
    assert np.abs(np.abs(plain) - np.abs(w)).max() < 1e-6


def test_covariance_has_no_error(spark):
    df, good = odd_vectors(spark, 300, 5, 4)
    vectors, dims = wh.finite_vectors(df, "vec_id", "embedding")
    model = wh.fit_whitening(vectors, dims)
    x = [[int(math.floor(64 * float(np.float32(c)))) for c in v] for _, v, _ in good]
    n = len(x)
    for i in range(dims):
        for j in range(dims):
            exact = (n * sum(r[i] * r[j] for r in x) - sum(r[i] for r in x) * sum(r[j] for r in x)) / n**2
            assert model.covariance[i, j] == exact


def test_odd_whitening(spark):
    df, good = odd_vectors(spark, 3)
    same = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(5)], VECTORS)
    flat = wh.with_whitened(same).collect()
    assert len(flat) == 10 and {(r["whitened"], r["identity_error"], int(r["deviation"])) for r in flat} == {(None, 0.0, 0)}
    assert wh.with_whitened(df.limit(0)).count() == 0 and wh.with_whitened(df.filter("vec_id > 899 and vec_id < 904")).count() == 0
    few = wh.with_whitened(df).collect()  # three different vectors vary in two directions
    assert {r["component"] for r in few if r["whitened"] is not None} == {1, 2} and len(few) == 6 * len(good)
    clash = with_clashing(df).withColumns({c: F.lit("own") for c in ("id", "v", "n", "component", "whitened", "dim")})
    assert wh.with_whitened(clash).count() == len(few)
    huge = spark.createDataFrame([(1, [3e30, 1.0], 0), (2, [1.0, 1.0], 0)], VECTORS)
    with pytest.raises(ValueError, match="not exact"):
        wh.with_whitened(huge)


def test_whitening_query(spark):
    rows = QUERIES["op12_polarised_whitening"](spark, f"{DATA}/sf0.001").collect()
    source = spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet").collect()
    assert len(rows) == 32 * len(source) and rows[0]["identity_error"] < 1e-9
    x = np.floor(64 * np.array([r["embedding"] for r in source], np.float64)) + 1_000_000
    e = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert {r["component"]: r["explained"] for r in rows} == pytest.approx({i + 1: e[i] / e.sum() for i in range(32)}, rel=1e-8)
    norm = {r["vec_id"]: int(((len(x) * a - x.sum(axis=0)) ** 2).sum()) for r, a in zip(source, x)}
    assert {r["vec_id"]: r["deviation"] for r in rows} == norm


# --- clusters ------------------------------------------------------------------

def brute_clusters(rows, k, rounds, dims, scale=256):
    kept = [(i, [math.floor(scale * float(np.float32(c))) for c in v]) for i, v, *_ in rows
            if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in order[:k]]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        groups: dict = {}
        for _, x in kept:
            groups.setdefault(near(x)[1], []).append(x)
        for c, members in groups.items():
            centroids[c] = [sum(col) // len(members) for col in zip(*members)]
    last = [(i, *near(x)) for i, x in kept]
    sums: dict = {}
    for _, d, c in last:
        sums[c] = sums.get(c, 0) + d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, sums[c], sum(sums.values()), names[c]) for i, d, c in last), key=repr)


def clusters(df, **options):
    rows = cc.with_clusters(df, **options).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted((tuple(r) for r in rows.collect()), key=repr)


@pytest.mark.parametrize("k, rounds", [(5, 3), (1, 2), (7, 0)])
def test_clusters_against_brute_force(spark, k, rounds):
    df, good = odd_vectors(spark, 150)
    assert clusters(df, k=k, rounds=rounds, dims=6) == brute_clusters(good, k, rounds, 6)


def test_odd_clusters(spark):
    ties = [(i, [float(i % 2), 0.0], 0) for i in range(8)] + [(8, [0.5, 0.0], 0), (8, [0.5, 0.0], 0), (8, [0.25, 0.0], 0)]
    df = spark.createDataFrame(ties, VECTORS)
    for k in (2, 9, 40):  # more centroids than different vectors: empty ones stay
        assert clusters(df, k=k, dims=2) == brute_clusters(ties, k, 5, 2)
    assert clusters(df.limit(0)) == [] and cc.with_clusters(df.limit(0)).columns == cc.with_clusters(df, dims=2).columns
    clash = with_clashing(df).withColumns({c: F.lit("own") for c in ("id", "v", "x", "best", "distance", "cluster", "inertia")})
    assert clusters(clash, k=2, dims=2) == brute_clusters(ties, 2, 5, 2)
    with pytest.raises(ValueError, match="exact below"):
        clusters(spark.createDataFrame([(1, [3e30, 1.0], 0)], VECTORS), dims=2)


def test_column_sums_are_compiled(spark):
    """Both halves of the aggregation are within the size that is compiled, and nothing runs in Python."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df, _ = odd_vectors(spark, 20, 64)
        vectors = cc.integer_vectors(df, "vec_id", "embedding", 64, 256)
        sums = cc.assigned(vectors, [[0] * 64, [9] * 64]).groupBy("cluster").agg(*[F.sum(F.col("x")[i]) for i in range(64)])
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
        text = sums._jdf.queryExecution().explainString(mode)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert len(sizes) >= 2 and max(sizes) < 8000 and "Python" not in text and text.count("*(") >= 2
