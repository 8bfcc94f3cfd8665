r"""Conversations as one marked text with a loss mask, assembled column by column.

A turn is written as ``<turn>``, its role, a line feed, its text, a line feed, ``</turn>``
and a line feed. Headers, texts and footers of a slice of turns are three columns: numpy
takes their lengths, adds them up to offsets, and scatters all bytes into one buffer that
becomes the Arrow column. The mask is the run of bytes of each assistant text.

Control strings inside a text are escaped reversibly: ``<turn>`` or ``</turn>`` behind
any number of backslashes gets one more, reading takes one away, and nothing else
changes. A footer begins with a line feed, so a text's own last backslashes never meet
it. In a role ``\``, line feed and ``<`` become ``\\``, ``\n`` and ``\l``.

Rows are dealt out by ranges of (conversation, turn, tie), not by conversation, so one
with a third of all rows is spread over many tasks; it comes out in *pieces*, each whole
turns of one slice, which put one behind another are the conversation. A task holds a
slice of about ``SLICE_BYTES`` of text, or one turn. Reading back streams the pieces of a
conversation in order and keeps a running digest only.

Defined results: null texts and roles are empty; null ids make one conversation, null
turns come first; equal turns are ordered by a hash of role and text, then by both;
repeated rows are turns of their own; extra columns are dropped; an empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from bloomtide.llm.common import batches_in_slices, text_of

HEAD, HEAD_END, FOOT = "<turn>", "\n", "\n</turn>\n"
ESCAPE, ESCAPED = r"(\\*)(</?turn>)", r"\\\1\2"
UNESCAPE, UNESCAPED = r"\\(\\*</?turn>)", r"\1"
ROLE_CODES = (("\\", "\\\\"), ("\n", "\\n"), ("<", "\\l"))
ROLE_CODE = re.compile(r"\\(.)", re.S)
#: Texts from this size on are copied whole, shorter ones byte by byte through indices.
COPY_BYTES = 1 << 16

SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))
ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def escaped(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, ESCAPE, ESCAPED)


def unescaped(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, UNESCAPE, UNESCAPED)


def coded_role(role: str) -> str:
    for plain, code in ROLE_CODES:
        role = role.replace(plain, code)
    return role


def plain_role(role: str) -> str:
    back = {"\\": "\\", "n": "\n", "l": "<"}
    return ROLE_CODE.sub(lambda m: back[m[1]], role)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a string column, where each value starts in them, and its length."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), offsets[:-1], np.diff(offsets)


def scatter(out: np.ndarray, column: pa.Array, at: np.ndarray) -> None:
    """Copy every value of a column to its place in ``out``."""
    data, starts, lengths = bytes_of(column)
    for i in np.flatnonzero(lengths >= COPY_BYTES):
        out[at[i]:at[i] + lengths[i]] = data[starts[i]:starts[i] + lengths[i]]
    small = np.where(lengths < COPY_BYTES, lengths, 0)
    within = np.arange(small.sum()) - np.repeat(np.cumsum(small) - small, small)
    out[np.repeat(at, small) + within] = data[np.repeat(starts, small) + within]


def assembled(roles: pa.Array, texts: pa.Array, first: np.ndarray, trained: tuple[str, ...]) -> tuple[pa.Array, pa.Array]:
    """The pieces that begin at the turns ``first``, and the mask of each in bytes from its start."""
    coded = roles.dictionary_encode()
    heads = pa.array([HEAD + coded_role(r) + HEAD_END for r in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
    bodies = escaped(texts)
    feet = pa.array([FOOT], pa.string()).take(pa.array(np.zeros(len(roles), np.int32)))
    columns = [heads, bodies, feet]
    lengths = np.stack([bytes_of(c)[2] for c in columns], axis=1)  # turns by segments
    ends = np.cumsum(lengths.ravel()).reshape(lengths.shape)
    starts = ends - lengths
    buffer = pa.allocate_buffer(int(ends[-1, -1]))
    out = np.frombuffer(buffer, np.uint8)
    for i, column in enumerate(columns):
        scatter(out, column, starts[:, i])
    piece_starts = starts[first, 0]
    offsets = np.append(piece_starts, ends[-1, -1])
    pieces = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), buffer)
    learned = pc.is_in(roles, pa.array(trained, pa.string())).to_numpy(zero_copy_only=False)
    piece = np.searchsorted(first, np.flatnonzero(learned), side="right") - 1
    span = pa.StructArray.from_arrays(
        [pa.array(starts[learned, 1] - piece_starts[piece]), pa.array(ends[learned, 1] - piece_starts[piece])], ["start", "end"])
    counts = np.append(0, np.cumsum(np.bincount(piece, minlength=len(first)))).astype(np.int32)
    return pieces, pa.ListArray.from_arrays(pa.array(counts), span)


def starts_of_runs(keys: pa.Array) -> np.ndarray:
    """Positions at which a value differs from the one before; nulls equal each other."""
    codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))


def formatted(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
              trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``key, piece, n_turns, formatted, loss``: the pieces of all conversations.

    ``piece`` grows along a conversation. ``loss`` has a (start, end) in bytes of
    ``formatted`` for the text of each turn whose role is one of ``trained``.
    """
    body, who = text_of(text), text_of(role)
    rows = df.select(F.col(key).alias("k"), F.col(turn).alias("t"), who.alias("r"), body.alias("x"),
                     F.xxhash64(who, body).alias("h"), F.monotonically_increasing_id().alias("i"))
    # the last key spreads rows that are equal in everything
    dealt = rows.repartitionByRange("k", "t", "h", "i").sortWithinPartitions("k", "t", "h", "r", "x")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId() << 32
        for batch in batches_in_slices(batches, "x"):
            if not batch.num_rows:
                continue
            first = starts_of_runs(batch.column("k"))
            texts, loss = assembled(batch.column("r"), batch.column("x"), first, trained)
            numbers = np.arange(piece, piece + len(first))
            piece += len(first)
            yield pa.RecordBatch.from_arrays([
                batch.column("k").take(pa.array(first)), pa.array(numbers),
                pa.array(np.diff(np.append(first, batch.num_rows)).astype(np.int32)), texts.cast(pa.string()), loss],
                schema.names)

    schema = StructType([
        StructField(key, df.schema[key].dataType), StructField("piece", LongType()), StructField("n_turns", IntegerType()),
        StructField("formatted", StringType()), StructField("loss", SPANS)])
    return dealt.select("k", "r", "x").mapInArrow(part, schema)


def turns_of(piece: str) -> list[tuple[str, str]]:
    """(role, escaped text) of each turn of a piece."""
    turns = piece.split(FOOT)
    if turns.pop():
        raise ValueError("the piece does not end with a turn")
    out = []
    for t in turns:
        head, _, body = t.partition(HEAD_END)
        if not head.startswith(HEAD):
            raise ValueError("a turn does not begin with its mark")
        out.append((plain_role(head[len(HEAD):]), body))
    return out


def read_back(piece: str, loss: list[dict]) -> tuple[list[tuple[str, str]], list[str]]:
    """The turns of a piece and the texts under its mask, both unescaped."""
    turns, raw = turns_of(piece), piece.encode()
    masked = [raw[s["start"]:s["end"]].decode() for s in loss]
    texts = unescaped(pa.array([t for _, t in turns] + masked, pa.string())).to_pylist()
    return list(zip((r for r, _ in turns), texts)), texts[len(turns):]


def digests(pieces: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row a conversation, read from its pieces: counts and digests of its turns and of the text under the mask.

    ``turns_sha256`` is over role, line feed, text, line feed of every turn. A digest is
    one sequence, so a conversation's pieces pass through one task, one at a time.
    """
    rows = pieces.select(F.col(key).alias("k"), "piece", "formatted", "loss")
    dealt = rows.repartition("k").sortWithinPartitions("k", "piece").drop("piece")
    schema = StructType([
        StructField(key, pieces.schema[key].dataType), StructField("n_turns", LongType()),
        StructField("turns_sha256", StringType()), StructField("loss_chars", LongType()),
        StructField("loss_sha256", StringType()), StructField("formatted_chars", LongType())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[list] = []
        keys: list[pa.Array] = []
        last, whole, learned, counts = None, None, None, None

        def close() -> None:
            keys.append(last)
            done.append([counts[0], whole.hexdigest(), counts[1], learned.hexdigest(), counts[2]])

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))]
            out = pa.RecordBatch.from_arrays([pa.concat_arrays(keys), *columns], schema.names)
            done.clear(), keys.clear()
            return out

        for batch in batches_in_slices(batches, "formatted"):
            starts = set(starts_of_runs(batch.column("k")).tolist()) if batch.num_rows else set()
            for i in range(batch.num_rows):
                if i in starts:
                    own = batch.column("k").slice(i, 1)
                    if last is None or not own.equals(last):
                        if last is not None:
                            close()
                        last, whole, learned, counts = own, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                piece = batch.column("formatted")[i].as_py()
                turns, masked = read_back(piece, batch.column("loss")[i].as_py())
                for r, t in turns:
                    whole.update(f"{r}\n{t}\n".encode())
                for t in masked:
                    learned.update(t.encode())
                counts[0] += len(turns)
                counts[1] += sum(map(len, masked))
                counts[2] += len(piece)
            if done:
                yield flush()
        if last is not None:
            close()
            yield flush()

    return dealt.mapInArrow(part, schema)
