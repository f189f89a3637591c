"""SimHash fingerprints of place names and near-duplicate groups found with BK-trees.

Records: facilities (facility_id long, name string, any further columns).
A null name counts as empty. Repeated rows and equal names are ordinary rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.components import pair_parts, spanning, star_forest
from strideframe.llm.tables import settle, without

RADIUS = 3
# Five blocks of a 64-bit fingerprint; with at most 3 differing bits two blocks at least are equal.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
PAIRS = tuple(combinations(range(5), 2))
TASK_ROWS = 100_000
# MinHash values of a name's shingles: at a similarity of 0.8 two names share none of the bands in one of 13,000 pairs.
BANDS, DEPTH = 24, 5
MARKS = BANDS * DEPTH
PART_ROWS = 5000
# An estimate from MARKS values deviates by 0.04 at a similarity of 0.8; below `least` - ROOM, five deviations, it discards.
ROOM = 0.2


# ---- fingerprints -------------------------------------------------------------------------------

def _words(name: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII white space."""
    return (name or "").encode("utf-8", "surrogatepass").lower().split()


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One fingerprint a group of consecutive hashes: a bit is 1 if set in over half of them; 0 for an empty group."""
    # The bits of a byte as eight byte-wide counters of one word: 255 rows add up without a carry.
    spread = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    ones = np.zeros((len(counts), 64), np.int64)
    ends, full = np.cumsum(counts), np.flatnonzero(counts)
    n_blocks = -(-counts[full] // 255)
    owner = np.repeat(full, n_blocks)
    inside = np.arange(n_blocks.sum()) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    starts = (ends - counts)[owner] + 255 * inside
    for at in range(0, len(starts), 4000):
        first = starts[at:at + 4000]
        last = starts[at + 4000] if at + 4000 < len(starts) else hashes.size
        lanes = spread[np.ascontiguousarray(hashes[first[0]:last]).astype("<u8").view(np.uint8).reshape(-1, 8)]
        sums = np.add.reduceat(lanes, first - first[0], axis=0).view(np.uint8)
        own = owner[at:at + 4000]
        new = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        ones[own[new]] += np.add.reduceat(sums, new, axis=0, dtype=np.int64)
    out = np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def shingle_prints(names: list[str | None], words: int) -> np.ndarray:
    """uint64 SimHash of each name over the XXH64 (seed 42) of its word shingles, repeats included."""
    digest, hashes, counts = xxhash.xxh64_intdigest, [], []
    for name in names:
        w = _words(name)
        if not w:
            counts.append(0)
            continue
        text = b" ".join(w)
        n = max(1, len(w) - words + 1)
        ends = np.cumsum([len(x) + 1 for x in w])
        starts = [0, *ends[:n - 1].tolist()]
        stops = (ends[min(words, len(w)) - 1:] - 1).tolist()
        hashes.append(np.fromiter((digest(text[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, n))
        counts.append(n)
    return _majority(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.array(counts, np.int64))


def shingle_fingerprints(facilities: DataFrame, words: int = 3) -> DataFrame:
    """(facility_id, fingerprint long): the 64-bit SimHash of every name; a name without words has 0.

    Words are runs of bytes other than ASCII white space after lower-casing A-Z;
    a name shorter than `words` words is one shingle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = shingle_prints(b.column("name").to_pylist(), words)
            yield pa.RecordBatch.from_arrays([b.column("facility_id"), pa.array(prints.view(np.int64))], names=["facility_id", "fingerprint"])

    return facilities.select("facility_id", "name").mapInArrow(run, "facility_id long, fingerprint long")


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingle_sets(names: list[str | None], words: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Per name the codes of its set of words and the sorted 64-bit hashes of its set of word shingles; the words' hashes by code.

    A name shorter than `words` words is one shingle, one without words has none.
    """
    code: dict[bytes, int] = {}
    seqs = [np.fromiter((code.setdefault(w, len(code)) for w in _words(name)), np.int64) for name in names]
    base = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in code), np.uint64, len(code))
    shingles = []
    for s in seqs:
        n = max(1, len(s) - words + 1) if len(s) else 0
        h = np.zeros(n, np.uint64)
        for j in range(min(words, len(s))):
            h = h * np.uint64(0x100000001B3) + base[s[j:j + n]]
        shingles.append(np.unique(_mix(h, 99)))
    return [np.unique(s) for s in seqs], shingles, base


def word_prints(names: list[str | None], seeds: int, words: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Per name `seeds` SimHashes of its set of words, BANDS keys of DEPTH MinHash values of its shingles each, and a byte of every value."""
    prints = np.zeros((len(names), seeds), np.uint64)
    sets, shingles, base = shingle_sets(names, words)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
    counts = np.array([len(s) for s in sets], np.int64)
    for k in range(seeds):
        prints[:, k] = _majority(_mix(base, k)[flat], counts)
    least = np.full((len(names), MARKS), 2**64 - 1, np.uint64)
    full = np.flatnonzero([len(s) for s in shingles])
    if len(full):
        hashes = np.concatenate(shingles)
        sizes = np.array([len(shingles[i]) for i in full])
        starts = np.cumsum(sizes) - sizes
        factors = _mix(np.arange(MARKS, dtype=np.uint64), 17) | np.uint64(1)
        for k in range(MARKS):
            least[full, k] = np.minimum.reduceat((hashes ^ (hashes >> np.uint64(31))) * factors[k], starts)
    keys = np.zeros((len(names), BANDS), np.uint64)
    for j in range(DEPTH):
        keys = _mix(keys + least[:, j::DEPTH], j)
    marks = (_mix(least, 7) % np.uint64(255)).astype(np.uint8) + np.uint8(1)
    marks[counts == 0] = 0
    return prints, keys, [m.tobytes() for m in marks]


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated shingle similarity of paired sketch rows (1 for two names without words)."""
    used = ((a > 0) | (b > 0)).sum(1)
    same = ((a == b) & (a > 0)).sum(1)
    raw = same / np.maximum(1, used)
    return np.where(used == 0, 1.0, np.maximum(0.0, (raw - 1 / 255) / (1 - 1 / 255)))


# ---- BK-trees -----------------------------------------------------------------------------------

class BkForest:
    """One BK-tree per group of distinct fingerprints, as arrays; children keyed by the distance to the parent."""

    def __init__(self, group: np.ndarray, prints: np.ndarray):
        """group must be sorted; within a group the fingerprints are distinct."""
        self.prints, n = prints, len(prints)
        first = np.r_[True, group[1:] != group[:-1]] if n else np.zeros(0, bool)
        self.root = np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else np.zeros(0, np.int64)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        rest = np.flatnonzero(~first)
        at = self.root[rest]
        while len(rest):
            edge = at * 65 + np.bitwise_count(prints[rest] ^ prints[at]).astype(np.int64)
            codes, where, back = np.unique(edge, return_index=True, return_inverse=True)
            child = rest[where]
            self.levels.append((codes, child))
            stay = child[back] != rest
            rest, at = rest[stay], child[back][stay]

    def near(self, asked: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (asked, other), other before asked, within `radius` bits in the same group.

        Of a node at distance d only the children with keys d - radius .. d + radius are followed.
        """
        who, node, a, b = asked, self.root[asked], [], []
        for level in [*self.levels, None]:
            d = np.bitwise_count(self.prints[who] ^ self.prints[node]).astype(np.int64)
            hit = (d <= radius) & (node < who)
            a.append(who[hit])
            b.append(node[hit])
            if level is None or not len(who):
                break
            codes, child = level
            next_who, next_node = [], []
            for step in range(-radius, radius + 1):
                edge = node * 65 + d + step
                ok = (d + step >= 1) & (d + step <= 64)
                pos = np.minimum(np.searchsorted(codes, edge), len(codes) - 1)
                ok &= codes[pos] == edge
                next_who.append(who[ok])
                next_node.append(child[pos[ok]])
            who, node = np.concatenate(next_who), np.concatenate(next_node)
        return np.concatenate(a), np.concatenate(b)


def _join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest label of each component after adding the links a-b; label[i] <= i is a root of i."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, label[label]):
            label = label[label]


def bk_links(key: np.ndarray, prints: np.ndarray, item: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(item, item of its group's first member) for items whose fingerprints lie within `radius` bits under one key.

    The links span each component, so their number is linear; no list of pairs is built.
    """
    order = np.lexsort((item, prints, key))
    key, prints, item = key[order], prints[order], item[order]
    n = len(key)
    if not n:
        return item, item
    new = np.r_[True, (key[1:] != key[:-1]) | (prints[1:] != prints[:-1])]
    lo = np.flatnonzero(new)
    size = np.diff(np.r_[lo, n])
    forest = BkForest(key[lo], prints[lo])
    label = np.repeat(lo, size)
    group_size = np.bincount(np.unique(key[lo], return_inverse=True)[1])
    chunk = int(max(16, 400_000 // group_size.max()))
    several = np.r_[True, key[lo][1:] != key[lo][:-1]]
    alone = several & np.r_[several[1:], True] & (size == 1)
    asked = np.flatnonzero(~alone)
    for at in range(0, len(asked), chunk):
        a, b = forest.near(asked[at:at + chunk], radius)
        label = _join_labels(label, lo[a], lo[b])
    linked = label != np.arange(n)
    return item[linked], item[label[linked]]


def _block(col, i: int):
    start, width = BLOCKS[i]
    return F.shiftrightunsigned(col, start).bitwiseAND(F.lit((1 << width) - 1))


def _block_keys(fp) -> list:
    return [F.lit(k << 26).bitwiseOR(F.shiftleft(_block(fp, i), 13)).bitwiseOR(_block(fp, j)).cast("long") for k, (i, j) in enumerate(PAIRS)]


def _sub_keys(fp, key) -> list:
    """Keys of the second level: the 38 bits outside the two equal blocks in four parts, one of which is equal too."""
    out = []
    for k, (i, j) in enumerate(PAIRS):
        bits = [start + b for n, (start, width) in enumerate(BLOCKS) if n not in (i, j) for b in range(width)]
        for part in range(4):
            mask = sum(1 << b for b in bits[part::4])
            mask -= (mask >> 63) << 64
            out.append((k, part, F.xxhash64(key, F.lit(part), fp.bitwiseAND(F.lit(mask)))))
    return out


def _keyed(prints: DataFrame, most: int) -> DataFrame:
    """prints (seed, fingerprint, ...) with one row per block pair and its `key`; keys with over `most` rows are cut finer."""
    wide = prints.withColumn("pair", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), key.alias("key")) for k, key in enumerate(_block_keys(F.col("fingerprint")))])))
    wide = wide.withColumn("k", F.col("pair.k")).withColumn("key", F.xxhash64("seed", "pair.key")).drop("pair")
    hot = wide.groupBy("key").count().where(F.col("count") > most).select("key", F.lit(True).alias("hot"))
    wide = wide.join(hot, "key", "left")
    subs = F.array(*[F.when((F.col("k") == k) & (F.col("hot")), sub) for k, _, sub in _sub_keys(F.col("fingerprint"), F.col("key"))])
    return wide.withColumn("key", F.explode(F.when(F.col("hot"), F.filter(subs, lambda x: x.isNotNull())).otherwise(F.array("key")))).drop("hot", "k")


def _tasks(df: DataFrame, rows: int) -> DataFrame:
    return df.withColumn("task", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(max(1, -(-rows // TASK_ROWS)))))


def near_prints(prints: DataFrame, most: int = 20_000, radius: int = RADIUS) -> DataFrame:
    """(a, b) spanning links between the distinct fingerprints of `prints` (fingerprint) at most `radius` = 3 bits apart.

    The fingerprints under an equal pair of blocks form a tree's group; BK-trees of
    many groups share a task. Trees are partitioned with their queries instead of
    broadcast, because they grow with the table.
    """
    def run(t: pa.Table) -> pa.Table:
        fp = t.column("fingerprint").to_numpy().view(np.uint64)
        a, b = bk_links(t.column("key").to_numpy(), fp, fp.view(np.int64), radius)
        return pa.table({"a": a, "b": b})

    some = prints.select("fingerprint").where("fingerprint IS NOT NULL").distinct()
    some = some.withColumn("seed", F.lit(0))
    rows = 10 * prints.count()
    return _tasks(_keyed(some, most), rows).select("task", "key", "fingerprint").groupBy("task").applyInArrow(run, "a long, b long")


def near_groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints (facility_id, fingerprint) with component_id, the smallest facility_id reachable over links of `radius` bits or fewer.

    Equal fingerprints are one node, so copies cost no links. Rows without an id get
    the component of their fingerprint; an empty table gives an empty one. A column
    named component_id is replaced.
    """
    prints = without(prints, "component_id")
    nodes = settle(prints.groupBy("fingerprint").agg(F.min("facility_id").alias("first_id")))
    forest = star_forest(near_prints(nodes, radius=radius)).withColumnRenamed("node", "fingerprint")
    rooted = nodes.join(forest, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint")


def near_copies(facilities: DataFrame, words: int = 5, least: float = 0.8, seeds: int = 6, most: int = 20_000) -> DataFrame:
    """(facility_id, group_id): the smallest facility_id of each group of names whose word shingles are alike by `least` or more.

    A single SimHash of five-word shingles differs in about ten bits at a similarity
    of 0.8, so candidates come from `seeds` SimHashes of the set of words within 3
    bits, and from BANDS keys of DEPTH MinHash values of the shingles: these hold for
    a passage cut or added as for scattered words. Names that candidates join are
    split by the similarity that MARKS MinHash bytes estimate at `least`
    - ROOM or more, and then by the exact similarity of their sets of shingles.
    Exact copies count as one name. Nothing is capped or sampled.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                prints, keys, sketches = word_prints(part.column("name").to_pylist(), seeds, words)
                lists = [pa.array(list(x.view(np.int64)), pa.list_(pa.int64())) for x in (prints, keys)]
                yield pa.RecordBatch.from_arrays([part.column("facility_id"), part.column("copy"), *lists, pa.array(sketches, pa.binary())],
                                                 names=["facility_id", "copy", "prints", "keys", "sketch"])

    copies = facilities.select("facility_id", F.coalesce("name", F.lit("")).alias("name")).withColumn("copy", F.sha2("name", 256))
    made = settle(copies.select("facility_id", "name", "copy").mapInArrow(run, "facility_id long, copy string, prints array<long>, keys array<long>, sketch binary"))
    items = settle(made.groupBy("copy").agg(F.min("facility_id").alias("item"), *[F.min(c).alias(c) for c in ("prints", "keys", "sketch")])
                .where("item IS NOT NULL"))
    n_items = items.count()

    def near(t: pa.Table) -> pa.Table:
        fp, item = t.column("fingerprint").to_numpy().view(np.uint64), t.column("item").to_numpy()
        a, b = bk_links(t.column("key").to_numpy(), fp, item)
        return pa.table({"a": a, "b": b})

    def banded(t: pa.Table) -> pa.Table:
        key, item = t.column("key").to_numpy(), t.column("item").to_numpy()
        order = np.lexsort((item, key))
        key, item = key[order], item[order]
        first = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], np.arange(len(key)), 0))
        open_ = item != item[first]
        return pa.table({"a": item[open_], "b": item[first][open_]})

    spread = items.select("item", F.posexplode("prints").alias("seed", "fingerprint"))
    by_bits = settle(_tasks(_keyed(spread, most), 10 * seeds * n_items).select("task", "key", "fingerprint", "item").groupBy("task")
                     .applyInArrow(near, "a long, b long").distinct())
    bands = items.select("item", F.posexplode("keys").alias("band", "key")).select("item", F.xxhash64("band", "key").alias("key"))
    by_bands = settle(_tasks(bands, BANDS * n_items).select("task", "key", "item").groupBy("task").applyInArrow(banded, "a long, b long").distinct())
    forest = settle(star_forest(by_bits.unionByName(by_bands)))
    forest = settle(star_forest(_alike_links(items, forest, least - ROOM)))
    forest = star_forest(_exact_links(copies, items, forest, words, least))
    named = items.select("copy", "item").join(forest.withColumnRenamed("node", "item"), "item", "left")
    named = named.select("copy", F.coalesce("root", "item").alias("group_id"))
    return made.select("facility_id", "copy").join(named, "copy", "left").select("facility_id", "group_id")


def _members(items: DataFrame, forest: DataFrame) -> DataFrame:
    """The rows of items (item, ...) in a component of two or more, with its root."""
    whole = forest.select(F.col("node").alias("item"), "root").unionByName(forest.select(F.col("root").alias("item"), "root").distinct())
    return items.join(whole, "item")


def _by_part(t: pa.Table, links: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """(a, b): the links, as items, that `links` finds among the row numbers of each part."""
    part, item = t.column("part").to_numpy(), t.column("item").to_numpy()
    order = np.lexsort((item, part))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        x, y = links(own)
        a.append(item[own[x]])
        b.append(item[own[y]])
    return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})


def _alike_links(items: DataFrame, forest: DataFrame, least: float) -> DataFrame:
    """(a, b): links that span what the sketches put at `least` or more inside the components of forest (node, root)."""
    def run(t: pa.Table) -> pa.Table:
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, MARKS)
        return _by_part(t, lambda own: spanning(len(own), lambda c, rest: alike(sketch[own[c]][None], sketch[own[rest]]) >= least))

    rows = settle(_members(items.select("item", "copy", "sketch"), forest))
    return pair_parts(rows, "copy", PART_ROWS, 4 * PART_ROWS).select("task", "part", "item", "sketch").groupBy("task").applyInArrow(run, "a long, b long")


def _exact_links(copies: DataFrame, items: DataFrame, forest: DataFrame, words: int, least: float) -> DataFrame:
    """(a, b): links that span the pairs whose sets of shingles are alike by `least` or more inside the components of forest (node, root).

    The texts come to their component by join. Pairs that the sketches put below
    `least` - ROOM are not compared.
    """
    def run(t: pa.Table) -> pa.Table:
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, MARKS)
        sets: list[np.ndarray] = []
        for at in range(0, t.num_rows, 1000):
            sets += shingle_sets(t.column("name").slice(at, 1000).to_pylist(), words)[1]

        def good(c: int, rest: np.ndarray) -> np.ndarray:
            out = np.zeros(len(rest), bool)
            for k in np.flatnonzero(alike(sketch[c][None], sketch[rest]) >= least - ROOM):
                x, y = sets[c], sets[rest[k]]
                if min(len(x), len(y)) < (least - 1e-9) * max(len(x), len(y)):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                out[k] = both >= least * (len(x) + len(y) - both) - 1e-9
            return out

        return _by_part(t, lambda own: spanning(len(own), lambda c, rest: good(own[c], own[rest])))

    rows = _members(items.select("item", "copy", "sketch"), forest)
    texts = copies.select("copy", "name").join(rows.select("copy").distinct(), "copy", "left_semi").groupBy("copy").agg(F.first("name").alias("name"))
    rows = settle(rows.join(texts, "copy"))
    return pair_parts(rows, "copy", PART_ROWS, PART_ROWS).select("task", "part", "item", "sketch", "name").groupBy("task").applyInArrow(run, "a long, b long")


def without_near_copies(facilities: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of `facilities`, all columns, that are the first of their group of near copies.

    Rows without an id stay. Of rows that repeat an id every one stays or goes with it.
    """
    gone = near_copies(facilities, words, least).where("facility_id <> group_id").select("facility_id").distinct()
    return facilities.join(gone, "facility_id", "left_anti").select(*facilities.columns)
