"""The operators as queries on the given tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bloomtide.llm import (
    byte_repeats, centroid_clusters, chat_format, decontamination, interleaving, line_frequency, ngram_join, pairwise_quality,
    secrets_scan, segmentations, site_templates, whitening, word_repeats,
)
from bloomtide.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


@query()
def op1_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality").filter(~held_out)
    model = pairwise_quality.fit_pairwise(documents, labels)
    return (
        pairwise_quality.with_features(documents)
        .select("doc_id", held_out.alias("held_out"), model.score(0.3).alias("score"))
        .withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
    )


@query()
def op2_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleaving.interleaved(read(spark, sf_dir, "documents"), 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


LINE_FREQUENCY_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, CASE WHEN source IS NULL THEN 'n' ELSE 'h' || source END AS host
    FROM documents
),
w AS (
    SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
        list_distinct(list_filter(list_transform(string_split(text, chr(10)),
            lambda x: trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g'))), lambda x: x <> '')) AS plain,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS real_lines
    FROM d
),
texts AS (SELECT DISTINCT host, text, plain FROM w),
lines AS (SELECT host, text, unnest(plain) AS line FROM texts),
often AS (SELECT host, line FROM lines GROUP BY host, line HAVING count(*) > 10),
gone AS (
    SELECT l.host, l.text, count(*) AS n_lines, sum(len(string_split(l.line, ' '))) AS n_gone
    FROM lines l JOIN often o ON o.host = l.host AND o.line = l.line GROUP BY l.host, l.text
),
rows_ AS (SELECT row_number() OVER () AS rid, * FROM w),
win AS (
    SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
    FROM (SELECT rid, words, unnest(generate_series(1, len(words) - 2)) AS i FROM rows_ WHERE len(words) >= 3)
),
twice AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
repeats AS (
    SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid
),
counted AS (
    SELECT r.doc_id, r.host, r.text, len(words) AS n_words,
        length(regexp_replace(r.text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        length(r.text) - length(regexp_replace(r.text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(real_lines) - len(list_distinct(real_lines)) AS n_dup_lines, coalesce(x.n, 0) AS n_repeat_words,
        coalesce(list_sum(list_transform(plain, lambda l: len(string_split(l, ' ')))), 0) AS n_line_words
    FROM rows_ r LEFT JOIN repeats x ON x.rid = r.rid
)
SELECT c.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
        AND n_line_words - coalesce(n_gone, 0) >= 0.5 * n_line_words AS kept,
    coalesce(n_lines, 0) AS n_removed_lines, CAST(coalesce(n_gone, 0) AS BIGINT) AS n_removed_words
FROM counted c LEFT JOIN gone g ON g.host = c.host AND g.text = c.text
"""


@query(LINE_FREQUENCY_SQL)
def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.quality_rules(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.coalesce(F.size("removed_lines"), F.lit(0)).cast("long").alias("n_removed_lines"),
        F.coalesce("n_removed_words", F.lit(0)).cast("long").alias("n_removed_words"))


#: The vocabulary of the token query and of the pipeline; a parameter of the operator.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"


@query()
def op4_sampled_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    sampled = segmentations.with_segmentations(documents, MODEL_FILE).select("doc_id", F.explode("segmentations").alias("s"))
    return sampled.select(
        "doc_id", "s.rank", F.size("s.ids").cast("long").alias("n_pieces"), "s.log_prob", "s.perturbed", "s.inclusion", "s.ids")


@query()
def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def span_list(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the whole matches of these kinds, by start and kind, joined by commas."""
    wanted = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    place = F.array(*[F.lit(k) for k in kinds])
    ordered = F.array_sort(F.transform(wanted, lambda s: F.struct(
        s["match"].alias("match"), F.array_position(place, s["kind"]).alias("place"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["match"].cast("string"), s["end"].cast("string"))), ",")


@query()
def op7_guess_cost_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = secrets_scan.corpus_ranks(documents)
    found = secrets_scan.with_secrets(documents, ranks=ranks).select("doc_id", "secrets")
    kinds = F.transform("secrets", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, F.lit(k).__eq__)).cast("long").alias(f"n_{k}") for k in secrets_scan.KINDS]
    base = secrets_scan.KINDS[:3]
    return found.select(
        "doc_id", *counts, F.sha2(span_list(F.col("secrets"), base), 256).alias("base_sha256"),
        span_list(F.col("secrets"), secrets_scan.KINDS).alias("spans"))


@query()
def op8_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontamination.with_benchmark_hits(documents, read(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id", (F.size("benchmark_hits") > 0).alias("contaminated"),
        F.transform("benchmark_hits", lambda h: h["item_id"]).alias("item_ids"),
        F.transform("benchmark_hits", lambda h: h["distance"]).alias("distances"))


@query()
def op10_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = site_templates.with_main_text(read(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query()
def op5_suffix_tree_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = word_repeats.repeated_passages(read(spark, sf_dir, "documents"))
    return word_repeats.without_passages(found).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query()
def op9_two_stage_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = byte_repeats.repeated_strings(read(spark, sf_dir, "documents"))
    return byte_repeats.without_strings(found).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


CHAT_SQL = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
t AS (
    SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS learned,
        replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<', '\l') AS head,
        regexp_replace(text, '(\\*)(</?turn>)', '\\\1\2', 'g') AS body
    FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
    CAST(sum(length(learned)) AS BIGINT) AS loss_chars, sha256(string_agg(learned, '' ORDER BY turn)) AS loss_sha256,
    CAST(sum(16 + length(head) + length(body)) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


@query(CHAT_SQL)
def op11_columnar_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], conversations.schema)
    return chat_format.digests(chat_format.formatted(conversations.unionByName(added)))


@query()
def op12_polarised_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.with_whitened(read(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").cast("long"))


def centroid_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """Vectors and centroids as (id, dimension, value) rows; each round assigns and moves."""
    near = """near{i} AS (
    SELECT id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
        SELECT v.id, m.c, sum((v.x - m.x) * (v.x - m.x)) AS d FROM v JOIN m{i} m ON m.dim = v.dim GROUP BY v.id, m.c)
    GROUP BY id)"""
    move = """m{j} AS (
    SELECT m.c, m.dim, coalesce(n.x, m.x) AS x FROM m{i} m LEFT JOIN (
        SELECT c, dim, CAST(sum(x) AS HUGEINT) // count(*) - CASE WHEN sum(x) < 0 AND sum(x) % count(*) <> 0 THEN 1 ELSE 0 END AS x
        FROM v JOIN near{i} USING (id) GROUP BY c, dim) n ON n.c = m.c AND n.dim = m.dim)"""
    steps = [s for i in range(rounds) for s in (near.format(i=i), move.format(i=i, j=i + 1))]
    return f"""
WITH kept AS (
    SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * 256) AS BIGINT)) AS x
    FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
),
v AS (SELECT id, unnest(range({dims})) AS dim, unnest(x) AS x FROM kept),
m0 AS (
    SELECT c, unnest(range({dims})) AS dim, unnest(x) AS x FROM (
        SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS c, x FROM kept) WHERE c < {k}
),
{", ".join(steps)},
{near.format(i=rounds)},
named AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY dim)) AS centroid_sha256 FROM m{rounds} GROUP BY c)
SELECT k.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
    CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM near{rounds} a JOIN kept k ON k.id = a.id JOIN named n ON n.c = a.c
"""


@query(centroid_sql())
def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.with_clusters(read(spark, sf_dir, "embeddings"))
