"""A corpus from raw documents to token ids, in stages that are written and read again.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and
returns the columns of ``documents``; the last one adds the token ids. Columns
besides doc_id, text, source and n_chars pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bloomtide.llm import decontamination, line_frequency, ngram_join, secrets_scan, segmentations
from bloomtide.llm.common import Scratch, free_name, read
from bloomtide.llm.queries import MODEL_FILE


def with_text(docs: DataFrame, text: Column) -> DataFrame:
    """The rows with a new text where there is one, and its length in ``n_chars`` if there is that column."""
    new = free_name(docs, "_new_text")
    columns = {"text": F.coalesce(F.col(new), F.col("text"))}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.coalesce(F.length(new), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return docs.withColumn(new, text).withColumns(columns).drop(new)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; from the others go the lines that too many documents of their source share."""
    used = line_frequency.ADDED + line_frequency.INTERNAL
    names = {c: free_name(docs, f"_own_{c}") for c in docs.columns if c in used}
    judged = line_frequency.quality_rules(docs.withColumnsRenamed(names))
    kept = judged.filter("kept")
    text = F.when(F.col("removed_lines").isNotNull(), line_frequency.without_lines(F.col("text"), F.col("removed_lines")))
    cleaned = with_text(kept, text)
    return cleaned.drop(*line_frequency.ADDED).withColumnsRenamed({v: k for k, v in names.items()}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of 5-word shingles overlap by 0.8 or more."""
    return ngram_join.one_of_each(docs, n=5, num=80, den=100)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, altered by a tenth of its length at most, go."""
    name = free_name(docs, "_hits")
    hits = decontamination.with_benchmark_hits(docs, read(spark, sf_dir, "benchmark"), name=name)
    return hits.filter(F.size(name) == 0).drop(name)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    name = free_name(docs, "_secrets")
    found = secrets_scan.with_secrets(docs, name=name, ranks=secrets_scan.corpus_ranks(docs))
    return with_text(found, F.when(F.size(name) > 0, secrets_scan.redacted(F.col("text"), F.col(name)))).drop(name)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every text as ids of the public vocabulary, in ``segmentations``."""
    return segmentations.with_segmentations(docs, MODEL_FILE)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("token_ids", token_ids),
]

#: Sampling segmentations has no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage on all that its predecessor kept; what it wrote goes when its successor has written."""
    docs, stored = read(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for _, stage in STAGES:
        docs = stored.store(stage(spark, docs, sf_dir))
        stored.drop_but_last()
    return docs
