"""What several operators share: reading, words, bounded slices, scratch space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bloomtide.session import scratch_path

#: Word separators of every operator here: space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]+"

#: Bytes of text that a worker turns into arrays at once; a longer text is one slice.
SLICE_BYTES = 2_000_000

MIX_A, MIX_B, MIX_C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


BLANKS = " \t\n\x0b\x0c\r"


def replaced(text: Column, characters: str, by: str = "") -> Column:
    """Each of the characters replaced; plain searches, far cheaper than a pattern."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(by))
    return text


def number_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(replaced(text, characters))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(replaced(text, BLANKS[1:], " "), " "), "")


def free_name(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of the table has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, []

    def store(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, self.name)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_but_last(self, keep: int = 1) -> None:
        """Delete all tables but the last ``keep``."""
        while len(self.paths) > keep:
            delete_path(self.spark, self.paths.pop(0))


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x + MIX_A
    x = (x ^ (x >> np.uint64(30))) * MIX_B
    x = (x ^ (x >> np.uint64(27))) * MIX_C
    return x ^ (x >> np.uint64(31))


def batches_in_slices(batches: Iterator[pa.RecordBatch], column: str = "text",
                      limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows whose texts have ``limit`` bytes together, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < len(sizes):
            before = ends[start - 1] if start else 0
            end = max(int(np.searchsorted(ends, before + limit, side="right")), start + 1)
            yield batch.slice(start, end - start)
            start = end


def hash_words(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words, each distinct one hashed once.

    A word's bytes are the coefficients of a polynomial modulo 2**64 at a fixed
    odd point, its length and a mixing step added; no per-word Python.
    """
    coded = words.dictionary_encode()
    distinct = coded.dictionary
    if not len(distinct):
        return np.empty(0, np.uint64)
    offsets = np.frombuffer(distinct.buffers()[1], np.int32)[distinct.offset:distinct.offset + len(distinct) + 1]
    data = np.frombuffer(distinct.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    starts = (offsets - offsets[0]).astype(np.int64)
    lengths = np.diff(starts)
    place = np.arange(len(data)) - np.repeat(starts[:-1], lengths)
    terms = mix(data.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(8)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    values = mix((sums[starts[1:]] - sums[starts[:-1]]) ^ (lengths.astype(np.uint64) << np.uint64(40)))
    return values[coded.indices.to_numpy(zero_copy_only=False)]


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and where each text's words begin (and the last end)."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)  # A-Z only
    lists = pc.ascii_split_whitespace(texts)
    values, owner = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    real = pc.greater(pc.binary_length(values), 0)
    mask = real.to_numpy(zero_copy_only=False)
    if not mask.all():
        values, owner = values.filter(real), owner[mask]
    return values, np.searchsorted(owner, np.arange(len(texts) + 1))


def strings(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
