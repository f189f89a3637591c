"""SentencePiece encoding and decoding of place names by suffix-array matching.

Records: facilities (facility_id, name, any further columns). A null name counts as
empty and has no pieces. The vocabulary is that of a BPE model with byte fallback
whose normaliser changes nothing but spaces (U+2581 stands for a space) and adds one
in front; it is read once by the driver and sent along, so its path need not exist on
the executors and its size bounds what is sent.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
# No piece goes on past a space, so a text falls into units: spaces and what follows them. A unit goes by what comes after its first space.
UNIT = re.compile(" ( *[^ ]*)")
SLICE_CHARS = 1_500_000
SLICE_IDS = 500_000
KEPT_UNITS = 300_000
LONG_UNIT = 256
NEVER = np.int64(2**31)


class Vocabulary:
    """Pieces, their ids and ranks (0 is merged first; equal scores share a rank), and the ids of the 256 bytes."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.vocab_size())
        self.surface = [b"" if model.is_control(i) else model.id_to_piece(i).encode() for i in every]
        plain = [i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.byte_ids = np.zeros(256, np.int64)
        for i in every:
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                self.byte_ids[value] = i
                self.surface[i] = bytes([value])
        texts = [model.id_to_piece(i) for i in plain]
        if any(SPACE in t.lstrip(SPACE) or len(t) > 60 for t in texts):
            raise ValueError("a piece of this vocabulary crosses a space or has over 60 characters")
        self.ids = np.array(plain, np.int64)
        self.lens = np.array([len(t) for t in texts], np.int64)
        self.codes = np.full((len(texts), int(self.lens.max())), -1, np.int32)
        for row, t in enumerate(texts):
            self.codes[row, :len(t)] = [ord(c) for c in t]
        scores = np.array([model.get_score(i) for i in plain])
        self.ranks = np.unique(-scores, return_inverse=True)[1].astype(np.int64)


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes, in order of their first `depth` characters or up to the next end of a unit (a code below 0).

    As many characters as fit are packed into one number; only suffixes that tie go on to the next ones.
    """
    there = np.zeros(int(codes.max()) + 2, bool)
    there[codes + 1] = there[0] = True
    rank = (np.cumsum(there) - 1)[codes + 1]
    bits = max(1, int(rank.max()).bit_length())
    per = min(depth, 62 // bits)
    n = len(codes)
    padded = np.r_[rank, np.zeros(depth + per, np.int64)]
    key, open_ = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(per):
        char = padded[k:k + n]
        open_ &= char > 0
        key = key << bits | np.where(open_, char, 0)
    order = np.argsort(key)
    sorted_key = key[order]
    done = per
    group = np.cumsum(np.r_[False, sorted_key[1:] != sorted_key[:-1]])
    more = open_[order]
    while done < depth:
        tied = np.r_[False, group[1:] == group[:-1]]
        tied |= np.r_[tied[1:], False]
        rows = np.flatnonzero(tied & more)
        if not len(rows):
            break
        at = order[rows]
        key, still = np.zeros(len(rows), np.int64), np.ones(len(rows), bool)
        for k in range(done, done + per):
            char = padded[at + k]
            still &= char > 0
            key = key << bits | np.where(still, char, 0)
        by = np.lexsort((key, group[rows]))
        order[rows], key = at[by], key[by]
        more[rows] = still[by]
        new = np.zeros(n, bool)
        new[rows[1:]] = key[1:] != key[:-1]
        group = np.cumsum(np.r_[False, group[1:] != group[:-1]] | new)
        done += per
    return order


def occurrences(codes: np.ndarray, order: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """[first, end) of every piece in the suffix array, all pieces searched at once by halving."""
    n, lens = len(codes), vocabulary.lens
    padded = np.r_[codes, np.full(vocabulary.codes.shape[1], -2, codes.dtype)]
    out = []
    for upper in (False, True):
        lo, hi = np.zeros(len(lens), np.int64), np.full(len(lens), n, np.int64)
        while (lo < hi).any():
            mid = (lo + hi) // 2
            at = order[np.minimum(mid, n - 1)]
            after = np.zeros(len(lens), bool)  # the suffix is beyond what is looked for
            undecided = lo < hi
            rows = np.flatnonzero(undecided)
            for k in range(vocabulary.codes.shape[1]):
                rows = rows[lens[rows] > k]
                if not len(rows):
                    break
                diff = padded[at[rows] + k] - vocabulary.codes[rows, k]
                after[rows[diff > 0]] = True
                less = rows[diff < 0]
                undecided[less] = False
                rows = rows[diff == 0]
            below = (lo < hi) & ~after & ~undecided
            equal = (lo < hi) & ~after & undecided
            go_right = below | equal if upper else below
            hi = np.where((lo < hi) & ~go_right, mid, hi)
            lo = np.where(go_right, mid + 1, lo)
        out.append(lo)
    return out[0], out[1]


class Edges:
    """Every occurrence of a piece as an edge (start, length), sorted by position.

    Per start: the number of its first edge, and its edges' lengths as bits.
    """

    def __init__(self, codes: np.ndarray, vocabulary: Vocabulary):
        self.width = vocabulary.codes.shape[1] + 1
        order = suffix_array(codes, self.width - 1)
        first, end = occurrences(codes, order, vocabulary)
        n = end - first
        which = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        edge = (order[place] * self.width + vocabulary.lens[which]) << 20 | which
        edge.sort()
        self.piece = np.r_[edge & (2**20 - 1), 0].astype(np.int32)
        start, length = np.divmod(edge >> 20, self.width)
        heads = np.flatnonzero(np.r_[True, start[1:] != start[:-1]][:len(start)])
        self.lengths, self.first = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
        if len(heads):
            self.lengths[start[heads]] = np.bitwise_or.reduceat(np.int64(1) << length, heads)
            self.first[start[heads]] = heads
        self.ranks, self.ids = vocabulary.ranks, vocabulary.ids

    def find(self, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece row, whether there is one) for each span."""
        lengths, bit = self.lengths[start], np.int64(1) << np.minimum(length, self.width)
        return self.piece[self.first[start] + np.bitwise_count(lengths & (bit - 1))], (lengths & bit) > 0

    def rank(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        piece, there = self.find(start, length)
        return np.where(there, self.ranks[piece], NEVER)


def _relax_long(start: int, length: int, edges: Edges) -> list[int]:
    """Token lengths of one unit: the best edge that joins two tokens is taken until none is left, by a heap."""
    size = [1] * length
    left, right = list(range(-1, length - 1)), list(range(1, length + 1))
    ranks = edges.rank(start + np.arange(length - 1), np.full(length - 1, 2)).tolist()
    heap = [(r, i, 2) for i, r in enumerate(ranks) if r < NEVER]
    heapq.heapify(heap)
    while heap:
        _, i, joined = heapq.heappop(heap)
        j = right[i] if size[i] else length
        if j >= length or size[i] + size[j] != joined:
            continue
        size[i], size[j], right[i] = joined, 0, right[j]
        if right[i] < length:
            left[right[i]] = i
        spans = [(i, size[i] + size[right[i]])] if right[i] < length else []
        if left[i] >= 0:
            spans.append((left[i], size[left[i]] + size[i]))
        if spans:
            for (p, m), r in zip(spans, edges.rank(np.array([start + p for p, _ in spans]), np.array([m for _, m in spans])).tolist(), strict=True):
                if r < NEVER:
                    heapq.heappush(heap, (r, p, m))
    return [s for s in size if s]


def relax(starts: np.ndarray, lens: np.ndarray, edges: Edges) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, start, length) of the tokens of all units, in order.

    Each round every unit takes its best edge that joins two neighbouring tokens, the
    leftmost of equal ones; units without one are finished.
    """
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    long_ = np.flatnonzero(lens > LONG_UNIT)
    for u in long_.tolist():
        size = np.array(_relax_long(int(starts[u]), int(lens[u]), edges), np.int64)
        done.append((np.full(len(size), u), starts[u] + np.cumsum(size) - size, size))
    some = np.flatnonzero((lens <= LONG_UNIT) & (lens > 0))
    unit = np.repeat(some, lens[some])
    at = np.arange(len(unit)) - np.repeat(np.cumsum(lens[some]) - lens[some], lens[some]) + starts[unit]
    size = np.ones(len(unit), np.int64)
    rank = np.full(len(unit), NEVER)
    same = np.flatnonzero(unit[1:] == unit[:-1])
    rank[same] = edges.rank(at[same], np.full(len(same), 2))
    while len(unit):
        n = len(unit)
        heads = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        best = np.minimum.reduceat(rank * n + np.arange(n), heads)
        live = best < NEVER * n
        pick = best[live] % n
        size[pick] += size[pick + 1]
        keep = np.ones(n, bool)
        keep[pick + 1] = False
        over = np.repeat(~live, np.diff(np.r_[heads, n]))
        done.append((unit[over], at[over], size[over]))
        keep &= ~over
        new_place = np.cumsum(keep) - 1
        unit, at, size, rank = unit[keep], at[keep], size[keep], rank[keep]
        pick = new_place[pick]
        fresh = np.concatenate([pick, pick - 1])
        fresh = fresh[fresh >= 0]
        nxt = np.minimum(fresh + 1, max(0, len(unit) - 1))
        pair = (nxt > fresh) & (unit[nxt] == unit[fresh]) if len(unit) else np.zeros(0, bool)
        rank[fresh] = NEVER
        rank[fresh[pair]] = edges.rank(at[fresh[pair]], size[fresh[pair]] + size[nxt[pair]])
    unit, at, size = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in range(3))
    order = np.argsort(at, kind="stable")
    return unit[order], at[order], size[order]


def _units(name: str) -> list[str]:
    """The units of a name, each without its first space."""
    if not name:
        return []
    name = name.replace(SPACE, " ")
    return UNIT.findall(f" {name}") if name[0] == " " or "  " in name else name.split(" ")


class Encoder:
    """Encodes names; the units it has met are kept, so only new ones are indexed."""

    def __init__(self, vocabulary: Vocabulary, most: int = KEPT_UNITS):
        self.vocabulary, self.most = vocabulary, most
        self._forget()

    def _forget(self) -> None:
        self.number: defaultdict[str, int] = defaultdict(count().__next__)
        self.ids = np.zeros(0, np.int32)
        self.count = np.zeros(0, np.int64)

    def _learn(self, units: list[str]) -> None:
        """Concatenate the units, index them and relax their edges."""
        vocabulary = self.vocabulary
        joined = "".join([f"{SPACE}{u}\0" for u in units]).replace(" ", SPACE)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int32)
        lens = np.fromiter(map(len, units), np.int64, len(units)) + 1
        ends = np.cumsum(lens + 1) - 1
        codes[ends] = -1
        edges = Edges(codes, vocabulary)
        unit, at, size = relax(ends - lens, lens, edges)
        piece, known = edges.find(at, size)
        n_ids = np.ones(len(at), np.int64)
        odd = np.flatnonzero(~known)
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in codes[at[odd]].tolist()]
        n_ids[odd] = [len(r) for r in raw]
        flat = np.repeat(vocabulary.ids[piece], n_ids)
        first = np.cumsum(n_ids) - n_ids
        for i, r in zip(first[odd].tolist(), raw, strict=True):
            flat[i:i + len(r)] = vocabulary.byte_ids[list(r)]
        self.ids = np.concatenate([self.ids, flat.astype(np.int32)])
        self.count = np.concatenate([self.count, np.bincount(unit, n_ids, len(units)).astype(np.int64)])

    def __call__(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all names one after another, how many each has)."""
        if len(self.number) > self.most:
            self._forget()
        number, known = self.number, len(self.number)
        parts = [_units(name) for name in names]
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        seq = np.fromiter(map(number.__getitem__, chain.from_iterable(parts)), np.int64, int(counts.sum()))
        if len(number) > known:
            self._learn(list(islice(number, known, None)))
        first = np.cumsum(self.count) - self.count
        n = self.count[seq]
        take = np.arange(int(n.sum())) + np.repeat(first[seq] - (np.cumsum(n) - n), n)
        return self.ids[take], np.bincount(np.repeat(np.arange(len(names)), counts), n, len(names)).astype(np.int64)


def decode_ids(flat: np.ndarray, counts: np.ndarray, vocabulary: Vocabulary) -> Iterator[str]:
    """The texts of lists of ids, given one after another; bytes that are no UTF-8 become U+FFFD."""
    pieces = pa.array(vocabulary.surface, pa.large_binary()).take(pa.array(flat))
    ends = np.r_[0, np.cumsum(pc.binary_length(pieces).to_numpy())][np.cumsum(counts)].tolist()
    data = bytes(pieces.buffers()[2] or b"")
    for lo, hi in zip([0, *ends], ends, strict=False):
        text = data[lo:hi].decode("utf-8", "replace").replace(SPACE, " ")
        yield text[1:] if text[:1] == " " else text


def _slices(sizes: list[int], enough: int) -> Iterator[slice]:
    """Consecutive rows whose sizes add up to `enough`."""
    lo = total = 0
    for i, size in enumerate(sizes):
        total += size
        if total >= enough:
            yield slice(lo, i + 1)
            lo, total = i + 1, 0
    if lo < len(sizes):
        yield slice(lo, len(sizes))


def encode_names(facilities: DataFrame, path: str = MODEL) -> DataFrame:
    """(facility_id, ids array<int>): the piece ids of every name, as the model at `path` gives them."""
    vocabulary = Vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(vocabulary)
        for b in batches:
            names = b.column("name").to_pylist()
            for s in _slices([len(name) for name in names], SLICE_CHARS):
                flat, counts = encode(names[s])
                offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column("facility_id")[s.start:s.stop], pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32)))],
                                                 names=["facility_id", "ids"])

    return facilities.select("facility_id", F.coalesce("name", F.lit("")).alias("name")).mapInArrow(run, "facility_id long, ids array<int>")


def decode_names(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """(facility_id, ids, name): the text of every row of ids; null ids give an empty name. Columns beyond these stay away."""
    vocabulary = Vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = b.column("ids").value_lengths().fill_null(0).to_numpy()
            for s in _slices(counts.tolist(), SLICE_IDS):
                ids = b.column("ids")[s.start:s.stop]
                names = pa.array(list(decode_ids(ids.flatten().to_numpy(), counts[s], vocabulary)), pa.string())
                yield pa.RecordBatch.from_arrays([b.column("facility_id")[s.start:s.stop], ids, names], names=["facility_id", "ids", "name"])

    return encoded.select("facility_id", "ids").mapInArrow(run, "facility_id long, ids array<int>, name string")
