"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bloomtide.llm import (
    byte_repeats, decontamination, interleaving, line_frequency, ngram_join, pairwise_quality, secrets_scan, segmentations,
    site_templates, word_repeats,
)
from bloomtide.llm.queries import MODEL_FILE
from tests.llm.frames import documents, odd, odd_rows, prose, with_clashing


def items(spark):
    return spark.createDataFrame([(1, prose(2, 30)), (1, prose(2, 30)), (2, None), (3, ""), (None, "x")], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(0, 1), (1, 1), (4, 1), (5, 0), (7, 0), (8, 1), (None, 1), (9, None)], "doc_id long, quality int")


OPERATORS = {
    "scores": lambda s, d: pairwise_quality.with_features(d, name="own_features").withColumn(
        "score", pairwise_quality.fit_pairwise(d, labels(s)).score(0.3, "own_features")),
    "shards": lambda s, d: interleaving.interleaved(d, 3),
    "rules": lambda s, d: line_frequency.quality_rules(d),
    "segmentations": lambda s, d: segmentations.with_segmentations(d, MODEL_FILE, 3),
    "passages": lambda s, d: word_repeats.without_passages(word_repeats.repeated_passages(d)),
    "classes": lambda s, d: ngram_join.classes(d),
    "secrets": lambda s, d: secrets_scan.with_secrets(d),
    "decontamination": lambda s, d: decontamination.with_benchmark_hits(d, items(s)),
    "strings": lambda s, d: byte_repeats.without_strings(byte_repeats.repeated_strings(d)),
}
PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    got = OPERATORS[name](spark, odd(spark)).collect()
    assert len(got) == len(odd_rows())
    both = [r.asDict() for r in got if r["doc_id"] == 1]
    varying = {"slot", "position", "shard", "source_rank"}
    assert len(both) == 2
    assert {k: v for k, v in both[0].items() if k not in varying} == {k: v for k, v in both[1].items() if k not in varying}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table_and_clashing_columns(spark, name):
    assert OPERATORS[name](spark, documents(spark, [])).count() == 0
    assert OPERATORS[name](spark, with_clashing(odd(spark))).count() == len(odd_rows())


def test_pages(spark):
    rows = [(1, None, None), (1, None, None), (2, "x", ""), (None, "http://h/", "<p>a" * 3000), (3, "http://h/", "<<p <a b='"),
            (4, "http://h/", "<article><p>one <b>two</b>&nbsp;&amp; 3<p>4</article>")]
    pages = spark.createDataFrame(rows, PAGES)
    got = {(r["page_id"], r["text"][:12]) for r in site_templates.with_main_text(pages).collect()}
    assert (4, "one two & 3 ") in got and (1, "") in got and (2, "") in got
    assert site_templates.with_main_text(pages.limit(0)).count() == 0
    clash = pages.withColumn("row", F.lit(1)).withColumn("_row", F.lit(1)).withColumn("host", F.lit(1))
    assert site_templates.with_main_text(clash).count() == len(rows)


@pytest.mark.parametrize("clash", [False, True])
def test_stages(spark, clash):
    docs = odd(spark)
    if clash:
        docs = with_clashing(docs)
    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf)
        own = [c for c in got.columns if name != "token_ids" or c != "segmentations"]
        assert own == docs.columns
        assert got.count() <= len(odd_rows())
        assert stage(spark, docs.limit(0), sf).count() == 0
