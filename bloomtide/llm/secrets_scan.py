"""Secrets in texts: fixed patterns, and credential values that are hard to guess.

Base spans come from three patterns. Besides, every value in a credential context
(an assignment to a credential name, a password in a URL, a bearer header) is
given a guess cost: the cheapest segmentation of the value into common words,
dates, repeats, keyboard walks and brute-force spans, by dynamic programming over
its positions. Values whose cost reaches the threshold are spans of kind
``guess``; ``password=changeme2024`` is not, ``password=x9$Kq!72`` is.

The span of an ``assign`` is that of the value (group 2 of its pattern), which is the
secret; the name before it stays. ``match`` is where the match of a kind's pattern begins:
for an ``assign`` the name, else the start of the span. Words are ranked by a fixed list and, with
``corpus_ranks``, by their frequency in the documents.

Defined results: a null or empty text has no spans; positions are code points;
a value that a base span covers wholly is not reported again, one that goes on
beyond it is scored as a whole; repeated rows get the same spans. The cost of a long value grows linearly with its length, and so does
the work.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bloomtide.llm.common import Scratch

SPANS = "array<struct<kind:string,start:int,end:int,cost:double,match:int>>"
SPAN_TYPE = pa.list_(pa.struct([
    ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("cost", pa.float64()), ("match", pa.int32())]))

# The patterns of the base kinds.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

# Names of credentials, and other places where one stands.
CONTEXTS = (
    re.compile(
        r"(?ai:pass(?:word|wd|code|phrase)?|pwd|secret|token|credentials?|auth(?:_?key)?|(?:api|access|private|client)[_-]?(?:key|secret))"
        r"[\"']?[ \t]*(?::|=>|:?=)[ \t]*(?:\"([^\"\r\n]{6,})\"|'([^'\r\n]{6,})'|([^\s\"'<>,;]{6,}))"),
    re.compile(r"://[^\s/:@]+:([^\s/@]{6,})@"),
    re.compile(r"(?ai:\bbearer)[ \t]+([A-Za-z0-9._~+/=-]{6,})"),
)

#: What stands before ``://``; looked for backwards over so many characters.
SCHEME, LONGEST_SCHEME = re.compile(r"(?ai:[a-z][a-z0-9+.-]*)\Z"), 32

# Common words of passwords, most frequent first.
COMMON_WORDS = (
    "password", "admin", "welcome", "letmein", "monkey", "dragon", "master", "login", "secret", "test", "changeme",
    "example", "user", "root", "guest", "hello", "default", "access", "token", "pass", "qwerty", "abc", "love",
    "summer", "winter", "spring", "autumn", "football", "baseball", "shadow", "sunshine", "princess", "superman",
    "batman", "trustno", "freedom", "whatever", "computer", "internet", "server", "database", "system", "manager",
    "oracle", "mysql", "postgres", "temp", "temporary", "sample", "demo", "dummy", "placeholder", "your", "here",
    "my", "the", "new", "key", "api", "private", "public", "none", "null", "true", "false", "undefined", "string",
    "value", "company", "home", "office", "london", "paris", "berlin", "michael", "jordan", "thomas", "daniel",
    "jessica", "charlie", "andrew", "george", "robert", "ashley", "nicole", "hunter", "ranger", "killer", "pepper",
    "ginger", "cookie", "chocolate", "banana", "orange", "purple", "yellow", "silver", "golden", "flower", "lovely",
    "angel", "blue", "red", "green", "black", "white", "happy", "lucky", "star", "magic", "soccer", "hockey", "tennis",
    "correct", "horse", "battery", "staple", "xxx", "foobar", "foo", "bar", "baz", "production", "staging", "develop",
)
LEET = str.maketrans({"4": "a", "@": "a", "8": "b", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t"})
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
DATES = re.compile(
    r"(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])"
    r"|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d)")

RANKS = {word: rank for rank, word in enumerate(COMMON_WORDS, 1)}
#: Words of the corpus that are ranked behind the fixed ones: a table of this size at most.
RANKED_WORDS = 50_000
SHORTEST_WORD, LONGEST_WORD = 3, 24


def corpus_ranks(documents: DataFrame, text: str = "text", size: int = RANKED_WORDS) -> dict[str, int]:
    """Ranks of the fixed words, and behind them of the ``size`` most frequent words of all documents.

    Words are runs of 3 to 24 letters a-z in lower case that occur five times or more,
    counted in Spark. Counts are taken in sixteenths of a power of two: so many whole
    steps from the top as hold ``size`` words at most. Only steps and chosen words come to
    the driver; equal counts are ordered by the word.
    """
    letters = F.regexp_replace(F.lower(F.col(text)), "[^a-z]+", " ")
    words = documents.select(F.explode(F.split(letters, " ")).alias("w")).filter(
        F.length("w").between(SHORTEST_WORD, LONGEST_WORD))
    scratch = Scratch(documents.sparkSession, "word-counts")
    counts = scratch.store(words.groupBy("w").agg(F.count("*").alias("n")).filter("n >= 5").withColumn(
        "step", F.floor(F.log2("n") * 16).cast("int")))
    least, held = None, 0
    for step, n in sorted(counts.groupBy("step").count().collect(), reverse=True):  # some hundreds of steps
        held += n
        if held > size:
            break
        least = step
    chosen = [] if least is None else counts.filter(F.col("step") >= least).select("w", "n").collect()
    scratch.drop_but_last(0)
    out = dict(RANKS)
    for word, _ in sorted(chosen, key=lambda r: (-r["n"], r["w"])):
        out.setdefault(word, len(out) + 1)
    return out


PLACES = {c: (x, y) for y, row in enumerate(KEY_ROWS) for x, c in enumerate(row)}
#: log10 of the choices for a character tried by brute force, by its class.
DIGIT, LETTER, OTHER = math.log10(10), math.log10(26), math.log10(33)
#: What another segment adds: guessing where it starts.
SEGMENT = math.log10(2)


def brute(char: str) -> float:
    return DIGIT if char.isdigit() else LETTER if char.isalpha() else OTHER


def word_spans(value: str, lowered: str, plain: str, ranks: dict[str, int]):
    """(start, end, cost) of common words, in any case, backwards, and with common substitutions."""
    for i in range(len(value)):
        for j in range(i + 2, min(len(value), i + LONGEST_WORD) + 1):
            own = lowered[i:j]
            exact = ranks.get(own)
            rank = exact or ranks.get(plain[i:j])
            back = ranks.get(own[::-1])
            if back and (not rank or 2 * back < rank):
                rank, exact = 2 * back, True
            if rank:
                upper = sum(c.isupper() for c in value[i:j])
                variants = 1 if not upper else 2 if upper == j - i or upper == 1 and value[i].isupper() else 2**min(upper, j - i - upper + 1)
                yield i, j, math.log10(rank * variants * (1 if exact else 4) + 1)


def date_spans(value: str):
    i = 0
    while found := DATES.search(value, i):
        text = found[0]
        yield found.start(), found.end(), math.log10(120) if len(text) == 4 else math.log10(365 * 120)
        i = found.start() + 1


def walk_spans(lowered: str):
    """Longest walks over touching keys, three keys at least; a change of direction costs."""
    start, turns, last = 0, 0, None
    for i in range(1, len(lowered) + 1):
        step = None
        if i < len(lowered):
            here, there = PLACES.get(lowered[i - 1]), PLACES.get(lowered[i])
            if here and there and here != there and abs(here[0] - there[0]) <= 1 and abs(here[1] - there[1]) <= 1:
                step = there[0] - here[0], there[1] - here[1]
        if step is None:
            if i - start >= 3:
                yield start, i, math.log10(47 * (i - start)) + turns * math.log10(4)
            start, turns, last = i, 0, None
        else:
            if last is not None and step != last:
                turns += 1
            last = step


def repeat_spans(value: str, ranks: dict[str, int], unit_limit: int = 64):
    """Leftmost repeats of a shortest unit (up to ``unit_limit`` characters) and their cost."""
    one = re.compile(rf"(.{{1,{unit_limit}}}?)\1+", re.S)
    for found in one.finditer(value):
        unit = found[1]
        if found.end() - found.start() >= 3:
            inner = guess_cost(unit, ranks) if len(unit) > 1 and len(unit) < len(value) else brute(unit[0]) * len(unit)
            yield found.start(), found.end(), inner + math.log10(len(found[0]) / len(unit))


def guess_cost(value: str, ranks: dict[str, int] = RANKS) -> float:
    """log10 of the guesses of the cheapest segmentation.

    Two states a position: the value up to it ends in a pattern, or in a
    brute-force span, which another brute-force character lengthens for free.
    """
    n = len(value)
    lowered = value.lower() if len(value.lower()) == n else value
    spans: dict[int, list[tuple[int, float]]] = {}
    for found in (word_spans(value, lowered, lowered.translate(LEET), ranks), date_spans(value), walk_spans(lowered),
                  repeat_spans(value, ranks)):
        for start, end, cost in found:
            spans.setdefault(end, []).append((start, cost))
    pattern, forced = [0.0] + [math.inf] * n, [math.inf] * (n + 1)
    for end in range(1, n + 1):
        forced[end] = min(forced[end - 1], pattern[end - 1] + (SEGMENT if end > 1 else 0.0)) + brute(value[end - 1])
        for start, cost in spans.get(end, ()):
            before = min(pattern[start], forced[start])
            pattern[end] = min(pattern[end], before + cost + (SEGMENT if start else 0.0))
    return min(pattern[n], forced[n])


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, match) of leftmost non-overlapping matches of each kind, too short ones dropped."""
    found = []
    if "=" in text or ":" in text:
        found += [("assign", *m.span(2), m.start()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [("access", *m.span(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    return found + [("hex", *m.span(), m.start()) for m in HEX.finditer(text)]


def guess_spans(text: str, taken: list[tuple[str, int, int, int]], threshold: float, ranks: dict[str, int]) -> list[tuple[str, int, int, float, int]]:
    """Values of credential contexts that no span of ``taken`` covers and whose cost reaches the threshold."""
    if ":" not in text and "=" not in text and "earer" not in text.lower():
        return []
    out, spans = [], [(s, e) for _, s, e, _ in taken]
    for pattern in CONTEXTS:
        for m in pattern.finditer(text):
            start, end = m.span(m.lastindex)
            if m[0].startswith("://") and not SCHEME.search(text[max(0, m.start() - LONGEST_SCHEME):m.start()]):
                continue
            if any(s <= start and end <= e for s, e in spans):
                continue
            cost = guess_cost(text[start:end], ranks)
            if cost >= threshold:
                out.append(("guess", start, end, cost, start))
                spans.append((start, end))
    return out


def all_spans(text: str, threshold: float, ranks: dict[str, int] = RANKS) -> list[dict]:
    base = base_spans(text)
    spans = [(k, s, e, guess_cost(text[s:e], ranks) if k == "assign" else None, m) for k, s, e, m in base]
    spans += guess_spans(text, base, threshold, ranks)
    return [dict(zip(("kind", "start", "end", "cost", "match"), x, strict=True))
            for x in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0])))]


def secret_spans(text: Column, threshold: float = 10.0, ranks: dict[str, int] = RANKS) -> Column:
    """An array of (kind, start, end, cost, match) by start and kind; cost is null where none was needed."""
    @F.arrow_udf(SPANS)
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([all_spans(t.as_py() or "", threshold, ranks) for t in texts], SPAN_TYPE)

    return found(text)


def with_secrets(documents: DataFrame, text: str = "text", name: str = "secrets", threshold: float = 10.0,
                 ranks: dict[str, int] = RANKS) -> DataFrame:
    """Add (or replace) the spans of every row's text; ``ranks`` as of ``corpus_ranks``."""
    return documents.withColumn(name, secret_spans(F.col(text), threshold, ranks))


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each span (overlapping ones as one) replaced by ``mark``."""
    merged = F.aggregate(
        spans, F.array().cast("array<struct<start:int,end:int>>"),
        lambda out, x: F.when(
            (F.size(out) > 0) & (x["start"] < F.coalesce(F.try_element_at(out, F.lit(-1))["end"], F.lit(-1))),
            F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(
                F.try_element_at(out, F.lit(-1))["start"].alias("start"),
                F.greatest(F.try_element_at(out, F.lit(-1))["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(out, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))))
    pieces = F.aggregate(
        merged, F.struct(F.lit("").alias("text"), F.lit(0).alias("at")),
        lambda out, x: F.struct(
            F.concat(out["text"], F.substring(text, out["at"] + 1, x["start"] - out["at"]), F.lit(mark)).alias("text"),
            x["end"].alias("at")),
        lambda out: F.concat(out["text"], F.substring(text, out["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, pieces).otherwise(text)
