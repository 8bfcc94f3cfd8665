"""Sampled segmentations of texts into the pieces of a SentencePiece vocabulary.

A text is a path through a lattice of pieces. A path's probability is that of
its pieces, and ``k`` distinct paths are drawn without replacement by Gumbel
top-k: every path's log probability is perturbed by Gumbel noise and the k
largest are taken, without listing the paths. The search is top-down and best
first (A*): the noise of the best path below a node is drawn first, and the
noise of what branches off it is drawn conditioned on being smaller. So the
bound of a node is exact and each step finds the next sample.

Spaces become U+2581 and one is put in front, as the vocabulary has it; no piece
has one inside, so the lattice falls into chunks, and equal chunks share their
part of it. All paths of all texts of a slice advance together as arrays.

Pieces carry log probabilities where the vocabulary has them. One made by merges
has ranks instead; there p is proportional to 1 / (rank + 2.7). Characters
without a piece are spelled in byte pieces.

A sample's inclusion score is 1 - exp(-exp(log p - kappa)), kappa being the
(k + 1)-th perturbed log probability: the probability that it is drawn with that
threshold. Noise comes from the row key by a counter-based generator, so a row
gets the same samples in any partition and after any restart.

Defined results: a null or empty text has one segmentation, empty, with
probability 1; a text with fewer than k segmentations has all of them; every
segmentation decodes to the text exactly (``with_decoded``); rows with the same key and text get the
same samples; a null key is a key like others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from bloomtide.llm.common import batches_in_slices, free_name, mix, text_of

SPACE = 0x2581
#: Stands for a U+2581 of the text itself, which is spelled in bytes.
LITERAL = 0x110000
SAMPLES = "array<struct<rank:int,ids:array<int>,log_prob:double,perturbed:double,inclusion:double>>"
SAMPLE_TYPE = pa.list_(pa.struct([("rank", pa.int32()), ("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()),
                                  ("perturbed", pa.float64()), ("inclusion", pa.float64())]))
POINT = np.uint64(0xD1342543DE82EF95)
#: Bytes of text in a slice: its lattice takes some hundred times as much.
SLICE = 800_000
#: Rows that are spelled at once.
ROWS = 256
#: Steps of a logarithm in sums.
FIXED = 2.0**32
#: Characters of a chunk whose weights cannot underflow.
LONG = 40


@dataclass
class Vocabulary:
    """For each length the sorted hashes of pieces and of prefixes of longer ones, and byte pieces.

    ``ids`` is -1 for a prefix that is no piece; ``alive`` tells of longer pieces.
    """

    pieces: list[bytes]
    byte_ids: np.ndarray
    byte_log: float
    hashes: list[np.ndarray]
    ids: list[np.ndarray]
    weights: list[np.ndarray]
    alive: list[np.ndarray]

    @property
    def longest(self) -> int:
        return len(self.hashes)


def hash_of(points: list[int]) -> int:
    value = 0
    for p in points:
        value = (value * int(POINT) + p + 1) & 0xFFFFFFFFFFFFFFFF
    return value


def load_vocabulary(path: str) -> Vocabulary:
    """Read a SentencePiece model on the driver; tasks get the tables."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(len(model))]
    byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
    special = set(byte_ids.tolist()) | {i for i in range(len(names)) if model.is_control(i) or model.is_unknown(i)}
    usable = [i for i in range(len(names)) if i not in special and not model.is_unused(i) and (model.get_score(i) > -1e8 or len(names[i]) == 1)]
    if any(chr(SPACE) in names[i][1:] or "\n" in names[i] for i in usable):
        raise ValueError("pieces that cross words are not supported")
    scores = np.array([max(model.get_score(i), -1e6) for i in usable])  # a character of no rank comes last
    if np.array_equal(scores, np.round(scores)):
        ranks = -scores - (-scores).min()
        weights = 1 / (ranks + 2.7)
    else:
        weights = np.exp(scores)
    byte_weight = weights.min()
    total = weights.sum() + 256 * byte_weight
    logs = np.log(weights / total)
    longest = max(len(names[i]) for i in usable)
    by_length: list[dict[int, tuple[int, float]]] = [{} for _ in range(longest)]
    prefixes: list[set[int]] = [set() for _ in range(longest)]
    for i, log in zip(usable, logs, strict=True):
        points = [ord(c) for c in names[i]]
        by_length[len(points) - 1][hash_of(points)] = (i, float(log))
        for n in range(1, len(points)):
            prefixes[n - 1].add(hash_of(points[:n]))
    tables = [sorted(set(t) | p) for t, p in zip(by_length, prefixes, strict=True)]
    pieces = [b""] * len(names)
    for i in usable:
        pieces[i] = names[i].replace(chr(SPACE), " ").encode()
    for b, i in enumerate(byte_ids.tolist()):
        pieces[i] = bytes([b])
    found = [[t.get(h, (-1, -np.inf)) for h in keys] for keys, t in zip(tables, by_length, strict=True)]
    return Vocabulary(
        pieces, byte_ids, float(np.log(byte_weight / total)),
        [np.array(keys, np.uint64) for keys in tables],
        [np.array([v[0] for v in values], np.int32) for values in found],
        [np.exp(np.array([v[1] for v in values])) for values in found],
        [np.array([h in p for h in keys], bool) for keys, p in zip(tables, prefixes, strict=True)])


def find(sorted_values: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value is (any place if absent) and whether it is there."""
    if not len(sorted_values):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return at, sorted_values[at] == values


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts, each with a space in front unless empty, and where texts begin."""
    joined = "".join(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum(sizes + (sizes > 0))])
    out = np.empty(starts[-1], np.uint32)
    lead = np.zeros(len(out), bool)
    lead[starts[:-1][sizes > 0]] = True
    out[lead] = SPACE
    out[~lead] = np.where(raw == SPACE, LITERAL, np.where(raw == 0x20, SPACE, raw))
    return out, starts


class Lattice:
    """The lattice of the distinct chunks of a slice, a row for each position of each chunk.

    Rows are laid out by the number of characters left, and within one number by
    falling size of the chunk: whatever lies ``l`` characters further on is the
    same stretch of rows in another place, and no lookup is needed to sum over it.

    ``p[l, row]`` is the probability, given the position, that the next piece has
    l + 1 characters; ``best`` its most likely length.
    """

    def __init__(self, chars: np.ndarray, text_starts: np.ndarray, words: Vocabulary):
        n = len(chars)
        cut = chars == SPACE
        cut |= chars == 10
        cut[1:] |= chars[:-1] == 10
        cut[text_starts[:-1][np.diff(text_starts) > 0]] = True
        first = np.flatnonzero(cut)
        length = np.diff(np.append(first, n))
        place = np.arange(n) - np.repeat(first, length)
        terms = mix(chars.astype(np.uint64) | (place.astype(np.uint64) << np.uint64(24)))
        names = np.add.reduceat(terms, first) if n else np.empty(0, np.uint64)
        _, sample, kind = np.unique(names, return_index=True, return_inverse=True)
        order = np.argsort(-length[sample], kind="stable")
        sample = sample[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        sizes = length[sample]
        counts = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes.max(initial=0) + 1))
        #: rows with so many characters left begin here
        self.base = np.concatenate([[0], np.cumsum(counts)])
        self.left = np.repeat(np.arange(len(counts)), counts)
        #: of each chunk of the slice the row where it begins, and its first character
        self.chunk_row = self.base[length] + rank[kind]
        self.chunk_at = first
        self.first_chunk = np.searchsorted(first, text_starts)
        kind_of = np.repeat(np.arange(len(sizes)), sizes)
        inner = np.arange(len(kind_of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.chars = np.zeros(len(self.left), np.uint32)
        self.chars[self.base[sizes[kind_of] - inner] + kind_of] = chars[first[sample][kind_of] + inner]
        self.edges(words)
        self.backward(counts)

    def onward(self, row: np.ndarray, steps) -> np.ndarray:
        """The rows so many characters further on."""
        left = self.left[row]
        return row - self.base[left] + self.base[left - steps]

    def edges(self, words: Vocabulary) -> None:
        """Weights and ids of the pieces that begin at each row, by length."""
        self.p = np.zeros((words.longest, len(self.chars)))
        self.ids = np.full((words.longest, len(self.chars)), -1, np.int32)
        active = np.flatnonzero(self.left > 0)
        value, at, left, used = np.zeros(len(active), np.uint64), active, self.left[active], 1
        for l in range(words.longest):
            if not len(active):
                break
            value = value * POINT + self.chars[at].astype(np.uint64) + np.uint64(1)
            where, there = find(words.hashes[l], value)
            whole = there & (words.ids[l][where] >= 0)
            self.ids[l, active[whole]] = words.ids[l][where[whole]]
            self.p[l, active[whole]] = words.weights[l][where[whole]]
            if whole.any():
                used = l + 1
            if l == 0:
                plain = active[~whole]
                n_bytes = 1 + (self.chars[plain] > 0x7F) + (self.chars[plain] > 0x7FF) + (
                    (self.chars[plain] > 0xFFFF) & (self.chars[plain] != LITERAL))
                self.p[0, plain] = np.exp(n_bytes * words.byte_log)
            go = np.flatnonzero(there & words.alive[l][where] & (left > 1))
            active, value, at, left = active[go], value[go], at[go], left[go]
            at = at - self.base[left] + self.base[left - 1]
            left = left - 1
        self.p, self.ids = self.p[:used], self.ids[:used]

    def backward(self, counts: np.ndarray) -> None:
        """Turn weights into probabilities of the next piece given the position.

        From the ends of the chunks the weight of all that follows is summed up,
        as logarithms where it could underflow.
        """
        base, k = self.base, len(self.p)
        rest = np.zeros(len(self.left))
        rest[:counts[0] if len(counts) else 0] = 1.0
        for d in range(1, min(len(counts), LONG + 1)):
            here = slice(base[d], base[d + 1])
            n = counts[d]
            terms = self.p[:min(d, k), here]
            for l in range(len(terms)):
                terms[l] *= rest[base[d - l - 1]:base[d - l - 1] + n]
            total = terms.sum(axis=0)
            rest[here] = total
            terms /= total
        with np.errstate(divide="ignore"):
            if len(counts) > LONG + 1:
                rest = np.log(rest)
            for d in range(LONG + 1, len(counts)):
                here, n = slice(base[d], base[d + 1]), counts[d]
                terms = self.p[:k, here]
                logs = np.log(terms) + np.stack([rest[base[d - l - 1]:base[d - l - 1] + n] for l in range(k)])
                top = logs.max(axis=0)
                np.exp(logs - top, out=logs)
                total = logs.sum(axis=0)
                rest[here] = top + np.log(total)
                terms[:] = logs / total
        self.best = self.p.argmax(axis=0)
        self.best_p = self.p[self.best, np.arange(len(self.left))]

    def draw(self, row: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The length index of the next piece: the most likely one first, else the others in order."""
        l = self.best[row]
        rest = np.flatnonzero(u >= self.best_p[row])
        if len(rest):
            rows, best, left = row[rest], l[rest], u[rest] - self.best_p[row[rest]]
            choice = best.copy()
            for i in range(len(self.p)):
                p = np.where(best == i, 0.0, self.p[i, rows])
                choice[(p > 0) & (left >= 0)] = i  # rounding may leave a remainder: the last one then
                left = left - p
                left[left < 0] = -1.0
            l[rest] = choice
        return l


class Noise:
    """Uniform numbers from a text's seed, the path's rank, a place and a purpose."""

    def __init__(self, seeds: np.ndarray):
        self.seeds = mix(seeds)

    def __call__(self, text: np.ndarray, rank: int, place: np.ndarray, purpose: int) -> np.ndarray:
        salt = np.uint64((rank << 40) | (purpose << 36))
        bits = mix(self.seeds[text] ^ mix(place.astype(np.uint64) | salt)) >> np.uint64(12)
        return (bits.astype(np.float64) + 0.5) * 2.0**-52


def walk(lattice: Lattice, row: np.ndarray, text: np.ndarray, place: np.ndarray, noise: Noise, rank: int):
    """Sample pieces from positions to the end of their chunks.

    ``place`` is the position's character in its text, which numbers the noise.
    Returns text, place, row and length index of each piece, in the order given.
    """
    out, who = [], np.arange(len(row))
    counts = np.zeros(len(row), np.int64)
    while len(row):
        l = lattice.draw(row, noise(text, rank, place, 1))
        out.append((who, text, place, row, l))
        counts[who] += 1
        row, place = lattice.onward(row, l + 1), place + l + 1
        go = np.flatnonzero(lattice.left[row] > 0)
        row, place, text, who = row[go], place[go], text[go], who[go]
    # the pieces of a chunk stand together, in the order of the steps
    first = np.cumsum(counts) - counts
    found = tuple(np.empty(counts.sum(), np.int64) for _ in range(4))
    for step, (who, *values) in enumerate(out):
        at = first[who] + step
        for column, value in zip(found, values, strict=True):
            column[at] = value
    return found


class Path:
    """One sampled path of every text: its pieces, and what branches off each of them."""

    def __init__(self, steps, lattice: Lattice, n_texts: int, limit: np.ndarray):
        self.text, self.place, self.row, self.l = steps
        self.starts = np.searchsorted(self.text, np.arange(n_texts + 1))
        self.p = lattice.p[self.l, self.row]
        # summed as whole numbers, so a text's sums do not depend on its neighbours in the slice
        sums = np.concatenate([[0], np.cumsum(np.rint(np.log(self.p) * FIXED).astype(np.int64))])
        self.before = (sums[:-1] - sums[self.starts[:-1]][self.text]) / FIXED
        self.log_prob = (sums[self.starts[1:]] - sums[self.starts[:-1]]) / FIXED
        self.taken = np.left_shift(1, self.l).astype(np.int64)
        #: of the best path that branches off at each step: the larger, the smaller its noise
        self.cost = np.full(len(self.row), np.inf)
        self.limit = limit

    def open(self, steps: np.ndarray, lattice: Lattice) -> np.ndarray:
        """The lengths not taken at the steps."""
        return (self.taken[steps] >> np.arange(len(lattice.p))[:, None]) & 1 == 0

    def draw(self, steps: np.ndarray, lattice: Lattice, noise: Noise, rank: int, limit: np.ndarray | None = None) -> None:
        """Noise of the best path that leaves at each of the steps by a length not taken.

        A Gumbel variable below a limit G is -log(exp(-G) + exp(cost)); costs are
        kept with the limit of the whole path, or turned into it from another.
        """
        mass = 1 - self.p[steps]
        exact = np.flatnonzero((mass < 1e-6) | (self.taken[steps] != np.left_shift(1, self.l[steps])))
        mass[exact] = np.where(self.open(steps[exact], lattice), lattice.p[:, self.row[steps[exact]]], 0.0).sum(axis=0)
        u = noise(self.text[steps], rank, self.place[steps], 2)
        with np.errstate(divide="ignore"):
            cost = np.log(-np.log(u) / mass) - self.before[steps]
            if limit is not None:
                most = -self.limit[self.text[steps]]
                higher = np.logaddexp(-limit, cost)
                cost = higher + np.log(-np.expm1(np.minimum(most - higher, -1e-300)))
        cost[mass <= 0] = np.inf
        self.cost[steps] = cost

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        """For each text the largest bound along the path and its step (-inf, 0 without one)."""
        n = len(self.starts) - 1
        least, step = np.full(n, np.inf), np.zeros(n, np.int64)
        some = np.flatnonzero(np.diff(self.starts) > 0)
        if len(some):
            least[some] = np.minimum.reduceat(self.cost, self.starts[some])
            hit = np.flatnonzero(self.cost == least[self.text])
            step[self.text[hit][::-1]] = hit[::-1]
        return np.where(np.isfinite(least), -np.logaddexp(-self.limit, least), -np.inf), step


def sample(texts: list[str], seeds: np.ndarray, k: int, words: Vocabulary) -> list[list[tuple]]:
    """Of each text up to k (ids, log_prob, perturbed, inclusion), by falling perturbed log probability."""
    n = len(texts)
    chars, text_starts = code_points(texts)
    lattice, noise = Lattice(chars, text_starts, words), Noise(seeds)
    chunk_text = np.repeat(np.arange(n), np.diff(lattice.first_chunk))
    chunk_place = lattice.chunk_at - text_starts[chunk_text]
    whole = np.arange(n)
    top = -np.log(-np.log(noise(whole, 0, np.zeros(n), 0)))
    path = Path(walk(lattice, lattice.chunk_row, chunk_text, chunk_place, noise, 0), lattice, n, top)
    path.draw(np.arange(len(path.row)), lattice, noise, 0)
    paths, perturbed, has = [path], [top], [np.ones(n, bool)]
    while True:
        found = [p.best() for p in paths]
        values = np.stack([v for v, _ in found])
        parent = values.argmax(axis=0)
        bound = values.max(axis=0)
        if len(paths) == k:
            break
        rank = len(paths)
        live = np.isfinite(bound)
        steps = []
        for i, p in enumerate(paths):
            mine = np.flatnonzero(live & (parent == i))
            if not len(mine):
                continue
            at = found[i][1][mine]
            # another length at the step, among those not taken, by its probability
            rows = p.row[at]
            open_ = np.where(p.open(at, lattice), lattice.p[:, rows], 0.0)
            cum = np.cumsum(open_, axis=0)
            u = noise(mine, rank, p.place[at], 3) * cum[-1]
            l = np.minimum((cum <= u).sum(axis=0), len(cum) - 1)
            bad = open_[l, np.arange(len(l))] <= 0
            if bad.any():
                l[bad] = np.argmax(open_[:, bad], axis=0)
            p.taken[at] |= np.left_shift(1, l)
            p.draw(at, lattice, noise, rank, bound[mine])
            # pieces up to the step stay, the step's is new, the rest is sampled afresh
            depth = np.arange(len(p.row)) - p.starts[:-1][p.text]
            cut_of = np.full(n, -1)
            cut_of[mine] = at - p.starts[mine]
            keep = depth < cut_of[p.text]
            steps.append(tuple(x[keep] for x in (p.text, p.place, p.row, p.l)))
            steps.append((mine, p.place[at], rows, l))
            on, on_place = lattice.onward(rows, l + 1), p.place[at] + l + 1
            go = lattice.left[on] > 0
            steps.append(walk(lattice, on[go], mine[go], on_place[go], noise, rank))
            limit_place = np.full(n, np.iinfo(np.int64).max)
            limit_place[mine] = p.place[at]
            later = chunk_place > limit_place[chunk_text]
            steps.append(walk(lattice, lattice.chunk_row[later], chunk_text[later], chunk_place[later], noise, rank))
        merged = [np.concatenate(x) for x in zip(*steps, strict=True)] if steps else [np.empty(0, np.int64)] * 4
        order = np.argsort(merged[0], kind="stable")  # within a text the parts are in order already
        new = Path(tuple(x[order] for x in merged), lattice, n, bound)
        branch = np.full(n, np.iinfo(np.int64).max)
        for i, p in enumerate(paths):
            mine = np.flatnonzero(live & (parent == i))
            branch[mine] = p.place[found[i][1][mine]]
        fresh = np.flatnonzero(new.place > branch[new.text])
        new.draw(fresh, lattice, noise, rank)
        paths.append(new)
        perturbed.append(bound)
        has.append(live)
    return [collect(i, p, lattice, words, perturbed[i], has[i], bound) for i, p in enumerate(paths)]


def piece_ids(path: Path, lattice: Lattice, words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all pieces, characters without one spelled in bytes, and where each text's begin."""
    ids = lattice.ids[path.l, path.row]
    spelled = np.flatnonzero(ids < 0)
    if not len(spelled):
        return ids, path.starts
    chars = lattice.chars[path.row[spelled]]
    coded = [chr(SPACE if c == LITERAL else c).encode("utf-8", "surrogatepass") for c in chars.tolist()]
    sizes = np.ones(len(ids), np.int64)
    sizes[spelled] = [len(c) for c in coded]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = np.repeat(ids, sizes)
    out[out < 0] = words.byte_ids[np.frombuffer(b"".join(coded), np.uint8)]
    return out, starts[path.starts]


def collect(rank: int, path: Path, lattice: Lattice, words: Vocabulary, perturbed, has, kappa) -> tuple:
    ids, starts = piece_ids(path, lattice, words)
    with np.errstate(over="ignore"):
        inclusion = np.where(np.isfinite(kappa), -np.expm1(-np.exp(path.log_prob - kappa)), 1.0)
    return ids, starts, path.log_prob, perturbed, inclusion, has


def samples_column(found: list[tuple], n: int) -> pa.Array:
    """Ranks side by side as one list of structs for each text."""
    has = np.stack([f[5] for f in found], axis=1)
    text, rank = np.nonzero(has)
    sizes = np.stack([np.diff(f[1]) for f in found], axis=1)[text, rank]
    ids = np.concatenate([f[0] for f in found])
    begin = np.stack([f[1][:-1] for f in found], axis=1)[text, rank] + np.cumsum([0] + [len(f[0]) for f in found[:-1]])[rank]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], sizes) + np.repeat(begin, sizes)
    structs = pa.StructArray.from_arrays(
        [pa.array((rank + 1).astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[at].astype(np.int32))),
         *(pa.array(np.stack([f[j] for f in found], axis=1)[text, rank]) for j in (2, 3, 4))],
        fields=list(SAMPLE_TYPE.value_type))
    per_text = np.concatenate([[0], np.cumsum(has.sum(axis=1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(per_text), structs)


def with_segmentations(documents: DataFrame, model_file: str, k: int = 2, key: str = "doc_id", text: str = "text",
                       name: str = "segmentations", seed: int = 0) -> DataFrame:
    """Add (or replace) ``name``: up to k sampled segmentations of each text, best perturbed first."""
    tables = documents.sparkSession.sparkContext.broadcast(vars(load_vocabulary(model_file)))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(**tables.value)
        for batch in batches_in_slices(batches, body, SLICE):
            texts = batch.column(body).to_pylist()
            seeds = batch.column(number).to_numpy().view(np.uint64)
            column = samples_column(sample(texts, seeds, k, words), len(texts))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), column], names=[*columns, name])

    kept = documents.select(*[c for c in documents.columns if c != name])
    columns = kept.columns
    body, number = free_name(kept, "_text"), free_name(kept, "_seed")
    rows = kept.withColumns({body: text_of(text), number: F.xxhash64(F.lit(seed), F.col(key))})
    schema = kept.withColumn(name, F.lit(None).cast(SAMPLES)).schema
    return rows.mapInArrow(run, schema)


def decode(ids: list[int], words: Vocabulary) -> str:
    """The text of a segmentation."""
    return b"".join([words.pieces[i] for i in ids]).decode("utf-8", "surrogatepass")[1:]


def decode_lists(lists: pa.Array, pieces: pa.Array) -> pa.Array:
    """Texts of lists of ids; ``pieces`` ends with what stands for ids that there are not."""
    known = len(pieces) - 1
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    ids = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
    ids = np.where((ids < 0) | (ids >= known), known, ids)
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    joined = pc.binary_join(pa.LargeListArray.from_arrays(ends, pieces.take(pa.array(ids))), pa.scalar(b"", pa.large_binary()))
    texts = [t.decode("utf-8", "replace").removeprefix(" ") for t in joined.to_pylist()]
    return pa.array(texts, pa.string(), mask=lists.is_null().to_numpy(zero_copy_only=False))


def with_decoded(table: DataFrame, model_file: str, ids: str = "ids", name: str = "text") -> DataFrame:
    """Add (or replace) ``name``: the text that the ids of ``array<int>`` spell.

    The space that encoding puts in front is taken off. Null ids give null, no ids the
    empty text; a null entry, an id the vocabulary does not have, and bytes that are no
    UTF-8 become U+FFFD; control pieces are nothing.
    """
    pieces = [*load_vocabulary(model_file).pieces, "\ufffd".encode()]
    tables = table.sparkSession.sparkContext.broadcast(pieces)  # of fixed size

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = pa.array(tables.value, pa.large_binary())
        for lists in batches:
            # a few rows at a time, so what is spelled at once stays small
            parts = [decode_lists(lists.slice(i, ROWS), known) for i in range(0, len(lists), ROWS)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return table.withColumn(name, text(F.col(ids)))
