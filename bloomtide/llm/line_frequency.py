"""Quality rules from lines that many documents of one host share.

Only DataFrame functions run here. Lines are normalised and hashed, the distinct
texts that hold a line are counted per host, and lines above the limit count as
boilerplate: they are removed, and a document that keeps too little is rejected.

Defined results: a null text has no lines and no words; a null host is one host
of its own; exact copies of a text within a host count once, so a text is never
rejected for having copies; repeated rows get the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bloomtide.llm.common import BLANKS, number_of, replaced, text_of, words_of

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"


def host_key(host: str) -> Column:
    return F.when(F.col(host).isNull(), F.lit("n")).otherwise(F.concat(F.lit("h"), F.col(host).cast("string")))


def normalised_lines(text: Column) -> Column:
    """The ``\\n``-split lines in order: lower case, runs of blanks as one space, trimmed."""
    plain = F.regexp_replace(replaced(F.lower(text), "\t\x0b\x0c\r", " "), " {2,}", " ")
    plain = F.replace(F.replace(plain, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))
    return F.split(F.trim(plain), "\n")


def distinct_lines(documents: DataFrame, text: str, host: str) -> DataFrame:
    """(host_key, text_hash, line, words), once for each distinct line of each distinct text."""
    lines = F.array_distinct(normalised_lines(text_of(text)))
    return (
        documents.select(host_key(host).alias("host_key"), F.xxhash64(text_of(text)).alias("text_hash"),
                         F.explode(lines).alias("line_text"))
        .filter("line_text <> ''")
        .select("host_key", "text_hash", F.xxhash64("line_text").alias("line"),
                F.size(F.split("line_text", " ")).alias("words"))
        .groupBy("host_key", "text_hash", "line").agg(F.max("words").alias("words"))
    )


def frequent_lines(lines: DataFrame, min_documents: int) -> DataFrame:
    """(host_key, line): lines in more than ``min_documents`` distinct texts of the host, however many it has."""
    counts = lines.groupBy("host_key", "line").agg(F.count("*").alias("n_with"))
    return counts.filter(F.col("n_with") > min_documents).select("host_key", "line")


def removals(documents: DataFrame, text: str = "text", host: str = "source", min_documents: int = 10) -> DataFrame:
    """(host_key, text_hash, removed_lines, n_removed_words) of the texts that lose lines."""
    lines = distinct_lines(documents, text, host)
    return lines.join(frequent_lines(lines, min_documents), ["host_key", "line"]).groupBy(
        "host_key", "text_hash").agg(
        F.collect_set("line").alias("removed_lines"), F.sum("words").alias("n_removed_words"))


def window_hashes(words: Column) -> Column:
    """The hash of each 3-word window, in order."""
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, 1, F.greatest(n - 2, F.lit(0))), F.slice(words, 2, F.greatest(n - 2, F.lit(0))),
                       lambda a, b: F.xxhash64(a, b))
    return F.zip_with(pairs, F.slice(words, 3, F.greatest(n - 2, F.lit(0))), lambda ab, c: F.xxhash64(ab, c))


def repeated_places(windows: Column) -> Column:
    """The sorted places of windows that occur twice or more.

    Equal windows become neighbours by sorting (hash, place); a text without a
    repeat, found by its number of distinct windows, is not sorted.
    """
    n = F.size(windows)
    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < n, ordered)


def cover(places: Column) -> Column:
    """Words covered by 3-word windows at sorted places."""
    return F.aggregate(
        F.zip_with(places, F.slice(places, 2, F.size(places)), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))),
        F.lit(0), lambda total, x: total + x)


INTERNAL = ("_words", "_windows", "_lines", "_plain", "_ordered", "_places")


def with_base_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_line_words, base_failed.

    ``n_line_words`` counts the words of distinct normalised lines, against which
    removed words are held.
    """
    body = text_of(text)
    keep = [c for c in documents.columns if c not in INTERNAL]
    staged = (
        documents.select(
            *keep, words_of(body).alias("_words"),
            F.filter(F.split(body, "\n"), lambda line: F.length(replaced(line, BLANKS)) > 0).alias("_lines"),
            F.length(replaced(body, BLANKS)).cast("long").alias("word_chars"),
            number_of(body, SYMBOLS).cast("long").alias("n_symbols"),
            F.array_remove(F.array_distinct(normalised_lines(body)), "").alias("_plain"),
        )
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("_plain", F.array_join("_plain", " "))
        .withColumn("n_line_words", F.when(F.col("_plain") == "", F.lit(0)).otherwise(number_of(F.col("_plain"), " ") + 1).cast("long"))
        .withColumn("_windows", window_hashes(F.col("_words")))
        .withColumn("_ordered", repeated_places(F.col("_windows")))
    )
    ordered = F.col("_ordered")
    shorter = F.greatest(F.size(ordered) - 1, F.lit(0))
    neighbours = F.zip_with(F.slice(ordered, 1, shorter), F.slice(ordered, 2, shorter),
                            lambda a, b: F.struct(a["i"].alias("a"), b["i"].alias("b"), (a["h"] == b["h"]).alias("same")))
    places = F.array_sort(F.array_distinct(F.flatten(F.transform(
        F.filter(neighbours, lambda x: x["same"]), lambda x: F.array(x["a"], x["b"])))))
    return (
        staged.withColumn("_places", places)
        .withColumn("n_repeat_words", F.coalesce(cover(F.col("_places")), F.lit(0)).cast("long"))
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_line_words", "base_failed")
    )


def quality_rules(documents: DataFrame, text: str = "text", host: str = "source", min_documents: int = 10,
                  min_left: float = 0.5) -> DataFrame:
    """Each row with its counts, ``removed_lines`` (hashes) and the verdict ``kept``.

    A document is rejected when its base rules fail or when the lines above the
    limit hold more than ``1 - min_left`` of the words of its distinct lines.
    Added columns replace columns of the same name, and columns named as in
    ``INTERNAL`` are left out.
    """
    rows = documents.select(*[c for c in documents.columns if c not in ADDED])
    gone = removals(documents, text, host, min_documents)
    counted = with_base_counts(
        rows.withColumns({"host_key": host_key(host), "text_hash": F.xxhash64(text_of(text))}), text)
    left = F.col("n_line_words") - F.coalesce("n_removed_words", F.lit(0))
    return counted.join(gone, ["host_key", "text_hash"], "left").withColumn(
        # the lesser of both, not their conjunction: a filter on it then stays above the join, and counts are made once
        "kept", F.least((~F.col("base_failed")).cast("int"), (left >= min_left * F.col("n_line_words")).cast("int")) == 1)


ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_line_words", "base_failed",
         "host_key", "text_hash", "removed_lines", "n_removed_words", "kept")


def without_lines(text: Column, removed: Column) -> Column:
    """The text without the lines whose hash is removed, other lines unchanged."""
    pairs = F.zip_with(F.split(text, "\n"), normalised_lines(text),
                       lambda line, plain: F.struct(line.alias("line"), F.xxhash64(plain).alias("hash")))
    left = F.filter(pairs, lambda x: ~F.array_contains(removed, x["hash"]))
    return F.when(removed.isNull(), text).otherwise(F.array_join(F.transform(left, lambda x: x["line"]), "\n"))
