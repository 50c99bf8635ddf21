"""Near-duplicate join on word shingles: signature trees with OR-combined bitmaps and size ranges, joined by dual traversal, in exact blocks.

Sets of about one size are cut in parts by a hash of the shingle, in more parts than alike sets may differ in. Two sets that are alike enough share one of
the best parts of each, those of many rare shingles, so the sets that share one of those are a block, and no link is lost; sets that only share a passage,
or shingles by chance, hardly ever meet. Blocks with the same least set are one family. A tree of bitmaps over a family is joined with itself; what it
leaves apart cannot be alike. What it brings together becomes a tree of whole sets, whose traversal verifies each pair at the leaves and passes over pairs
that are linked already. Sets that are equal are one class from the start."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, per_task, scratch, texts, written
from .components import components
from .filters import bloom_filter, passes

#: Bytes of text that are hashed at once, about.
SEGMENT = 1 << 20
#: Counters of the sketch of shingle counts, which tells what is common, and chunks in which it travels. It only decides how many sets meet in a
#: block; links are the same with any.
COUNTERS, CHUNKS = 1 << 22, 64
#: How often a range of sizes grows by what alike sets may differ, the parts that sets are cut in per hundred that are needed, and the worth of a shingle
#: that is not common, in eighths of a power of two.
STEPS, SPARE, RAREST = 4, 150, 128
#: Children of a tree's node.
FANOUT = 8
#: Sets, and bytes of them, in one tree at most. Larger groups are cut in cells.
CELL_SETS, CELL_BYTES = 4096, 32 << 20
#: Digests that a task remembers.
REMEMBERED = 300_000

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BASE = int(_M1)


def _mixed(x: np.ndarray, by: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * by
    return x ^ (x >> np.uint64(29))


# ---- shingles


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class _Powers:
    """Powers of the base of word hashes and of its inverse modulo 2**64, as many as the longest text so far asked for."""

    up = down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)


_powers_of_base = _Powers()
_FOLD = np.arange(1, 257, dtype=np.uint64)
_FOLD[65:91] = _FOLD[97:123]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _hash_words(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of the bytes x, A-Z as lower case, and where it begins: differences of prefix sums of a polynomial, shifted to one place."""
    space = np.ones(len(x) + 2, bool)
    space[1:-1] = _IS_SPACE[x]
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[0::2], edges[1::2]
    _powers_of_base.reach(len(x) + 1)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(_FOLD[x] * _powers_of_base.up[: len(x)], out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * _powers_of_base.down[starts], _M2), starts


def word_hashes(raw: bytes, segment: int = SEGMENT) -> np.ndarray:
    """Hashes of all words of a text, which is read in segments that end at white space."""
    x = np.frombuffer(raw, np.uint8)
    out, at = [], 0
    while at < len(x):
        end = at + segment
        while end < len(x) and not len(last := np.flatnonzero(_IS_SPACE[x[at:end]])):
            end += segment
        end = at + int(last[-1]) + 1 if end < len(x) else len(x)
        out.append(_hash_words(x[at:end])[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _of_words(w: np.ndarray, size: int) -> np.ndarray:
    n = len(w)
    if not n:
        return w
    width = min(size, n)
    h = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        h = _mixed(h ^ w[i : n - width + 1 + i], _M1)
    return np.unique(h)


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; A-Z count as lower case. With fewer words than size, one hash of them all."""
    return _of_words(word_hashes(text.encode("utf-8", "surrogatepass")), size)


def all_shingles(own: list[str], size: int) -> Iterator[np.ndarray]:
    """shingles() of each text; short texts are hashed together."""
    held: list[bytes] = []
    held_bytes = 0

    def flush() -> Iterator[np.ndarray]:
        w, starts = _hash_words(np.frombuffer(b" ".join(held) + b" ", np.uint8))
        cuts = np.searchsorted(starts, np.cumsum([len(r) + 1 for r in held]))
        for a, b in zip([0, *cuts], cuts):
            yield _of_words(w[a:b], size)

    for text in own:
        raw = text.encode("utf-8", "surrogatepass")
        if held and held_bytes + len(raw) > SEGMENT:
            yield from flush()
            held, held_bytes = [], 0
        if len(raw) > SEGMENT:
            yield _of_words(word_hashes(raw), size)
        else:
            held.append(raw)
            held_bytes += len(raw) + 1
    if held:
        yield from flush()


def _digest(h: np.ndarray, by: np.uint64) -> int:
    return int(_mixed(h, by).sum(dtype=np.uint64).view(np.int64))


# ---- what is common, and blocks


def _counter(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(COUNTERS)).astype(np.int64)


def _packed_counts(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Each part of the counters that is not all zeros: which counters are used, and their counts."""
    for k, part in enumerate(counts.reshape(CHUNKS, -1)):
        used = part > 0
        if used.any():
            yield k, zstandard.compress(np.packbits(used).tobytes() + part[used].tobytes(), 1)


def _unpacked_counts(blob: bytes) -> np.ndarray:
    raw, size = zstandard.decompress(blob), COUNTERS // CHUNKS
    out = np.zeros(size, np.int64)
    out[np.unpackbits(np.frombuffer(raw, np.uint8, size // 8)).astype(bool)] = np.frombuffer(raw, np.uint32, offset=size // 8)
    return out


class _Levels:
    """One byte a counter, compressed wherever it is kept or sent."""

    def __init__(self, levels: np.ndarray) -> None:
        self.packed = zstandard.compress(levels.tobytes(), 3)

    def unpacked(self) -> np.ndarray:
        return np.frombuffer(zstandard.decompress(self.packed), np.uint8)


def _levels(sketch: DataFrame) -> _Levels:
    """By counter, how far its count is above the mean, in eighths of a power of two: one byte each, summed and rounded on the executors."""

    def summed(batches):
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k not in out:
                    out[k] = np.zeros(COUNTERS // CHUNKS, np.int64)
                out[k] += _unpacked_counts(blob)
        for k, counts in out.items():
            log = np.clip(np.round(8 * np.log2(np.maximum(counts, 1))), 0, 511).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([int(counts.sum())], pa.int64()), pa.array([zstandard.compress(log.tobytes(), 3)], pa.binary())], names=["chunk", "total", "levels"])

    rows = sketch.repartition(CHUNKS, "chunk").mapInArrow(summed, "chunk long, total long, levels binary").collect()
    mean = 8 * np.log2(max(1.0, sum(r.total for r in rows) / COUNTERS))
    out = np.zeros((CHUNKS, COUNTERS // CHUNKS), np.uint8)
    for r in rows:
        out[r.chunk] = np.clip(np.frombuffer(zstandard.decompress(r.levels), np.uint16).astype(int) - round(mean), 0, 255)
    return _Levels(out)


class _SizeClasses:
    """Ranges of sizes, each so wide that a set's larger alike sets are in its own range or the next one. most: the largest size, by range."""

    def __init__(self, percent: int) -> None:
        self.percent, self.most = percent, [0]

    def of(self, n: int) -> int:
        while self.most[-1] < n:
            most = self.most[-1] + 1
            for _ in range(STEPS):
                most = 100 * most // self.percent
            self.most.append(most)
        return bisect_left(self.most, n)


_size_classes: dict[int, _SizeClasses] = {}


def _differ(n: int, other: int, percent: int) -> int:
    """How many shingles are in only one of two sets of these sizes at most, if they are alike enough."""
    return (n + other) * (100 - percent) // (100 + percent)


def _best_parts(h: np.ndarray, rarity: np.ndarray, of_class: int, parts: int, n: int) -> np.ndarray:
    """A hash of each of the n best parts of a set that is cut in parts by hash: those whose shingles are rare and many."""
    salt = np.uint64(of_class * int(_M2) % (1 << 64))
    part = (_mixed(h ^ salt, _M2) % np.uint64(parts)).astype(np.int64)
    worth, content = np.zeros(parts, np.int64), np.arange(parts, dtype=np.uint64) * _M1 + salt
    np.add.at(worth, part, rarity)
    np.add.at(content, part, _mixed(h, _M1))
    token = _mixed(content, _M2)
    return token[np.lexsort((token, -worth))[:n]]


def prefix(h: np.ndarray, levels: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """Tokens of a set, of which it shares one with any set that is alike enough, and how many of them, the first ones, it shares one of with any such set
    of its size or more.

    All sets of a range of sizes are cut alike in more parts than two alike sets may differ in. Of d + 1 parts that are best in one order for all sets, at
    least one is the same in two sets that differ in d shingles, since all other equal parts come after the best of them. A set is cut as its own range
    asks for and, if there may be smaller ones in the range before, as that one asks for."""
    n = len(h)
    classes = _size_classes.setdefault(percent, _SizeClasses(percent))
    rarity = RAREST - np.minimum(levels[_counter(h)], RAREST - 1).astype(np.int64)

    def cut(c: int, other: int) -> np.ndarray:
        most = classes.most[c]
        parts = SPARE * (_differ(most, 100 * most // percent, percent) + 1) // 100
        return _best_parts(h, rarity, c, parts, _differ(n, other, percent) + 1)

    own = classes.of(n)
    out = [cut(own, 100 * n // percent)]
    if -(-percent * n // 100) <= classes.most[own - 1]:
        out.append(cut(own - 1, classes.most[own - 1]))
    return np.concatenate(out), len(out[0])


# ---- trees


def bitmap(h: np.ndarray) -> np.ndarray:
    """Words of a bitmap of at least two bits a shingle, a power of two. The longer of two bitmaps of a set, cut in halves and OR-ed, is the shorter."""
    n_bits = max(64, 1 << (2 * len(h) - 1).bit_length())
    bits = np.zeros(n_bits, np.uint8)
    bits[(_mixed(h, _M1) % np.uint64(n_bits)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows) cut to so many words and OR-ed."""
    return np.bitwise_or.reduce(bits.reshape(*bits.shape[:-1], -1, words), axis=-2)


def _tiled(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows) as if each bit stood for all that it may stand for in a longer one."""
    return np.tile(bits, words // bits.shape[-1]) if words > bits.shape[-1] else bits


def _count(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(axis=-1, dtype=np.int64)


def _only(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that only a has, each of which stands for a shingle that only a has."""
    wa, wb = a.shape[-1], b.shape[-1]
    return _count(a & ~(_folded(b, wa) if wa < wb else _tiled(b, wa)))


def _lowest(bits: np.ndarray) -> int:
    i = int((bits != 0).argmax())
    return 64 * i + (int(bits[i]) & -int(bits[i])).bit_length()


class _Node:
    """bits: the OR of those below; sizes from least to most; excess: the most shingles that share bits in one of the sets."""

    __slots__ = ("rows", "children", "bits", "least", "most", "excess", "all_in")


class SignatureTree:
    """Sets sorted by length of bitmap, component and least bit. ``join`` goes through pairs of its nodes and unites what ``linked`` says."""

    def __init__(self, sizes: list[int], bits: list[np.ndarray], percent: int, components: list[int] | None = None):
        n = len(sizes)
        self.percent, self.sizes = percent, np.array(sizes, np.int64)
        first: dict[int, int] = {}
        self.parent = list(range(n)) if components is None else [first.setdefault(c, i) for i, c in enumerate(components)]
        many = set() if components is None else {c for c, k in Counter(components).items() if k > 1}
        self.bits = bits
        order = sorted(range(n), key=lambda i: (len(bits[i]), self.parent[i] if many and components[i] in many else -1, _lowest(bits[i]), sizes[i]))
        level: list[_Node] = []
        at = 0
        while at < n:
            end = at + 1
            while end < min(n, at + FANOUT) and len(bits[order[end]]) == len(bits[order[at]]):
                end += 1
            level.append(self._leaf(order[at:end]))
            at = end
        while len(level) > 1:
            level = [self._above(level[i : i + FANOUT]) for i in range(0, len(level), FANOUT)]
        self.root = level[0] if level else None

    def _leaf(self, rows: list[int]) -> _Node:
        node = _Node()
        node.rows, node.children = rows, None
        own, sizes = np.stack([self.bits[i] for i in rows]), self.sizes[rows]
        node.bits, node.least, node.most = np.bitwise_or.reduce(own), int(sizes.min()), int(sizes.max())
        node.excess = int((sizes - _count(own)).max())
        node.all_in = rows[0] if all(self.find(i) == self.find(rows[0]) for i in rows) else None
        return node

    def _above(self, children: list[_Node]) -> _Node:
        node = _Node()
        node.rows, node.children = None, children
        words = max(len(c.bits) for c in children)
        node.bits = np.bitwise_or.reduce([_tiled(c.bits, words) for c in children])
        node.least, node.most, node.excess = min(c.least for c in children), max(c.most for c in children), max(c.excess for c in children)
        self._settle(node)
        return node

    def _settle(self, node: _Node) -> None:
        """Notes whether all sets below are in one component."""
        one = node.rows if node.children is None else [c.all_in for c in node.children]
        node.all_in = one[0] if one[0] is not None and all(i is not None and self.find(i) == self.find(one[0]) for i in one) else None

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def unite(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)

    def _together(self, a: _Node, b: _Node) -> bool:
        return a.all_in is not None and b.all_in is not None and self.find(a.all_in) == self.find(b.all_in)

    def apart(self, a: _Node, b: _Node) -> bool:
        """Whether no set below a can be alike enough to one below b, by sizes and by the most shingles that they may share."""
        if 100 * a.most < self.percent * b.least or 100 * b.most < self.percent * a.least:
            return True
        words = max(len(a.bits), len(b.bits))
        shared = int(_count(_tiled(a.bits, words) & _tiled(b.bits, words))) + min(a.excess, b.excess)
        overlap = min(shared, a.most, b.most)
        return (100 + self.percent) * overlap < self.percent * (max(a.least, overlap) + max(b.least, overlap))

    def may_link(self, x: list[int], y: list[int]) -> np.ndarray:
        """By (set of x, set of y), two leaves: the most shingles that they may share if they may be alike enough, or else 0. A bit that only one of
        two sets has stands for a shingle that only it has."""
        a, b = np.stack([self.bits[i] for i in x])[:, None], np.stack([self.bits[i] for i in y])[None]
        na, nb = self.sizes[x][:, None], self.sizes[y][None]
        only_a, only_b = _only(a, b), _only(b, a)
        overlap = np.minimum(na - only_a, nb - only_b)
        return np.where((100 + self.percent) * overlap >= self.percent * (na + nb), overlap, 0)

    def join(self, linked) -> Iterator[tuple[int, int]]:
        """Pairs of sets, of different components so far, for which linked(i, j) holds; they are united, so a spanning set of links results."""
        if self.root is not None:
            yield from self._within(self.root, linked)

    def _within(self, node: _Node, linked) -> Iterator[tuple[int, int]]:
        if node.all_in is not None:
            return
        if node.children is None:
            yield from self._leaves(node.rows, node.rows, linked)
        else:
            for c in node.children:
                yield from self._within(c, linked)
            for i, c in enumerate(node.children):
                for d in node.children[i + 1 :]:
                    yield from self._across(c, d, linked)
        self._settle(node)

    def _across(self, a: _Node, b: _Node, linked) -> Iterator[tuple[int, int]]:
        if self._together(a, b) or self.apart(a, b):
            return
        if a.children is None and b.children is None:
            yield from self._leaves(a.rows, b.rows, linked)
        elif b.children is None or (a.children is not None and a.most - a.least > b.most - b.least):
            for c in a.children:
                yield from self._across(c, b, linked)
        else:
            for c in b.children:
                yield from self._across(a, c, linked)

    def _leaves(self, x: list[int], y: list[int], linked) -> Iterator[tuple[int, int]]:
        most = self.may_link(x, y)
        i, j = np.nonzero(np.triu(most, 1) if x is y else most)
        for k in np.argsort(-most[i, j], kind="stable"):
            p, q = x[i[k]], y[j[k]]
            if self.find(p) != self.find(q) and linked(p, q):
                self.unite(p, q)
                yield p, q


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are alike enough."""
    if len(a) > len(b):
        a, b = b, a
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


# ---- groups in tasks


def _by_group(batches, n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of batches that are sorted by their first columns."""
    kept: list[tuple] = []
    now = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:n_keys] != now and kept:
                yield now, kept
                kept = []
            now = row[:n_keys]
            kept.append(row[n_keys:])
    if kept:
        yield now, kept


def _long_batches(rows: Iterator[tuple], names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for row in rows:
        out.append(row)
        if len(out) == 8192:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=list(names))
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=list(names))


def _together_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def _plausible(families: DataFrame, percent: int) -> DataFrame:
    """grp, rep of the sets that a tree of bitmaps does not tell apart from all others of their family. families: family, rep, n, bits. grp: the
    least set of those that are not told apart, directly or through others."""

    def run(batches):
        def found():
            for _, rows in _by_group(batches, 1):
                rows = list(dict.fromkeys(rows))
                reps, sizes, bits = zip(*rows)
                tree = SignatureTree(sizes, [np.frombuffer(b, np.uint64) for b in bits], percent)
                for _ in tree.join(lambda i, j: True):
                    pass
                members: dict[int, list[int]] = {}
                for i in range(len(rows)):
                    members.setdefault(tree.find(i), []).append(reps[i])
                for own in members.values():
                    if len(own) > 1:
                        yield from ((min(own), r) for r in own)

        yield from _long_batches(found(), ("grp", "rep"))

    return _together_by(families, "family").select("family", "rep", "n", "bits").mapInArrow(run, "grp long, rep long")


def _tree_links(cells: DataFrame, keys: tuple[str, ...], percent: int) -> DataFrame:
    """a, b: links that span what is alike within each cell. cells: keys, rep, component, set."""

    def run(batches):
        def found():
            for _, rows in _by_group(batches, len(keys)):
                reps, comps, raw = zip(*rows)
                sets = [np.frombuffer(s, np.uint64) for s in raw]
                tree = SignatureTree([len(s) for s in sets], [bitmap(s) for s in sets], percent, list(comps))
                for i, j in tree.join(lambda i, j: alike(sets[i], sets[j], percent)):
                    if reps[i] != reps[j]:
                        yield reps[i], reps[j]

        yield from _long_batches(found(), ("a", "b"))

    return _together_by(cells, *keys).select(*keys, "rep", "component", "set").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """rep, set (sorted hashes as bytes) of the documents with these ids (column rep), and of a few others; each different set of an id once."""
    known = bloom_filter(ids.select("rep"))

    def run(batch: pa.RecordBatch) -> dict | None:
        own = np.array([-1 if x is None else x for x in batch.column(0).to_pylist()], np.int64)
        good = np.flatnonzero(passes(own, known) & batch.column(0).is_valid().to_numpy(zero_copy_only=False))
        if not len(good):
            return None
        found = all_shingles(texts(batch.take(pa.array(good))), shingle)
        return {"rep": own[good], "set": [h.tobytes() for h in found]}

    found = in_batches(docs, run, "rep long, set binary").where(F.length("set") > 0)
    return found.groupBy("rep").agg(F.collect_set("set").alias("set")).select("rep", F.explode("set").alias("set"))


def _cut_in_cells(groups: DataFrame, most_sets: int, most_bytes: int) -> DataFrame:
    """groups (grp, rep, n) with cells, the number of cells of the group, and cell."""
    sizes = groups.groupBy("grp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(most_sets)), F.ceil(F.sum(8 * F.col("n")) / F.lit(most_bytes))).cast("long").alias("cells"))
    return groups.join(sizes, "grp").withColumn("cell", F.pmod(F.xxhash64("rep"), F.col("cells")))


def _links(docs: DataFrame, groups: DataFrame, shingle: int, percent: int, most_sets: int, most_bytes: int) -> DataFrame:
    """a, b: links that span what is alike within each group. groups: grp, rep, n.

    Groups of one cell, nearly all, take one pass. Of larger ones the cells are joined, then one set of each component, as long as that unites any;
    where a group still has several components, each pair of its cells is joined."""
    cut = written(_cut_in_cells(groups, most_sets, most_bytes), "cells")

    def joined(rows: DataFrame, *keys: str) -> DataFrame:
        sets = _sets(docs, rows.select("rep").distinct(), shingle)
        return written(_tree_links(rows.join(sets, "rep"), keys, percent), "links")

    links = joined(cut.withColumn("component", F.col("rep")), "grp", "cell")
    large = cut.where("cells > 1")
    if large.isEmpty():
        return links
    large = written(large.select("grp", "rep", "n"), "large")
    labels = written(components(links), "labels")
    per_group = Window.partitionBy("grp")

    def still_open() -> DataFrame:
        """large with components, where a group has several."""
        own = large.join(labels, large["rep"] == labels["node"], "left").select("grp", "rep", "n", F.coalesce("component", "rep").alias("component"))
        own = own.withColumn("lo", F.min("component").over(per_group)).withColumn("hi", F.max("component").over(per_group))
        return written(own.where("lo != hi").drop("lo", "hi"), "open")

    now, before = still_open(), None
    while (count := now.select("grp", "component").distinct().count()) and (before is None or count < before):
        heads = now.groupBy("grp", "component").agg(F.min_by(F.struct("rep", "n"), "rep").alias("r")).select("grp", "component", "r.*")
        more = joined(_cut_in_cells(heads, most_sets, most_bytes), "grp", "cell")
        links = written(links.unionByName(more), "links")
        labels = written(components(links), "labels")
        before, now = count, still_open()
    if count:
        of_cells = _cut_in_cells(now, most_sets, most_bytes)
        others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).alias("other")
        pairs = of_cells.select("grp", "rep", "component", "cell", others).select("grp", "rep", "component", F.least("cell", "other").alias("one"), F.greatest("cell", "other").alias("two"))
        more = joined(pairs, "grp", "one", "two")
        links = written(links.unionByName(more), "links")
    return links


def similarity_join(docs: DataFrame, shingle: int = 5, percent: int = 80, most_sets: int = CELL_SETS, most_bytes: int = CELL_BYTES) -> DataFrame:
    """doc_id, n_shingles, class_id (least doc_id with an equal set), component_id of every document.

    Null or empty text has no shingles, class_id and component_id are its own doc_id. Rows that repeat a doc_id are one document; if their texts differ, it
    links by any of them. Rows with a null doc_id get the component of their class, null if the class has no other id. Components are exact: every pair that
    is alike enough is linked by a path of verified pairs, of which only a spanning set is sought. Texts of any length are read whole. Other columns play
    no part. An empty table has an empty result."""
    with scratch():
        return written(_joined(docs.select("doc_id", "text"), shingle, percent, most_sets, most_bytes), "joined", keep=True)


def _joined(own: DataFrame, shingle: int, percent: int, most_sets: int, most_bytes: int) -> DataFrame:
    def describe(batches):
        counts, used = np.zeros(COUNTERS, np.uint32), False
        for batch in batches:
            found = list(all_shingles(texts(batch), shingle))
            for h in found:
                np.add.at(counts, _counter(h), np.uint32(1))
                used = used or len(h) > 0
            yield {"doc_id": batch.column(0), "n": list(map(len, found)), "d1": [_digest(h, _M1) for h in found], "d2": [_digest(h, _M2) for h in found], "bits": [bitmap(h).tobytes() if len(h) else None for h in found]}
        if used:
            parts, blobs = zip(*_packed_counts(counts))
            yield {"chunk": list(parts), "counts": list(blobs)}

    seen: set[int] = set()  # digests that a task has emitted: of copies in a task, one is enough
    described = written(per_task(own, describe, "doc_id long, n long, d1 long, d2 long, bits binary, chunk long, counts binary"), "described")
    levels = _levels(described.where("chunk IS NOT NULL").select("chunk", "counts"))
    described = described.where("chunk IS NULL").drop("chunk", "counts")

    def sign(batches):
        order = levels.unpacked()
        return (_signed(batch, order) for batch in batches)

    def _signed(batch: pa.RecordBatch, order: np.ndarray) -> dict | None:
        tokens, keys = [], []
        for h in all_shingles(texts(batch), shingle):
            d = _digest(h, _M1) & -2
            if len(h) and d not in seen:
                if len(seen) > REMEMBERED:
                    seen.clear()
                seen.add(d)
                first, n_low = prefix(h, order, percent)
                key = np.full(len(first), d)
                key[:n_low] |= 1
                tokens.append(first.view(np.int64))
                keys.append(key)
        return {"token": pa.array(np.concatenate(tokens)), "key": pa.array(np.concatenate(keys))} if tokens else None

    classes = written(described.where("n > 0").groupBy("d1", "d2").agg(F.min_by(F.struct("doc_id", "n", "bits"), "doc_id").alias("c")).select("d1", "d2", F.col("c.doc_id").alias("rep"), "c.n", "c.bits"), "classes")
    known = classes.where("rep IS NOT NULL")
    # Of a set's parts nearly all are in no other set and end here. The lowest bit of a key tells which the smaller set of a pair must share.
    of_token = Window.partitionBy("token")
    met = per_task(own, sign, "token long, key long").select("token", F.col("key").bitwiseAND(-2).alias("class"), (F.col("key").bitwiseAND(1) == 1).alias("low"))
    met = met.withColumn("lo", F.min("class").over(of_token)).withColumn("hi", F.max("class").over(of_token)).withColumn("any_low", F.max("low").over(of_token))
    met = met.where("lo != hi AND any_low").select("token", "class", "low").distinct()
    blocks = met.join(known.select(F.col("d1").bitwiseAND(-2).alias("class"), "rep", "n"), "class").select("token", "rep", "n", "low")
    in_order = of_token.orderBy("n", "rep")
    low_n = F.when(F.col("low"), F.col("n"))
    smaller = F.when(F.col("low"), F.max(low_n).over(in_order.rowsBetween(Window.unboundedPreceding, -1))).otherwise(F.max(low_n).over(of_token.orderBy("n").rangeBetween(Window.unboundedPreceding, 0)))
    blocks = blocks.withColumn("larger", F.when(F.col("low"), F.lead("n").over(in_order))).withColumn("smaller", smaller)
    blocks = blocks.where((100 * F.col("n") >= percent * F.col("larger")) | (100 * F.col("smaller") >= percent * F.col("n")))
    families = written(blocks.select(F.min("rep").over(of_token).alias("family"), "rep", "n").distinct(), "families")
    sizes = families.groupBy("family").agg(F.count(F.lit(1)).alias("n_sets"), F.sum("n").alias("n_all"))
    families = families.join(sizes, "family")
    fits = (F.col("n_sets") <= most_sets) & (F.col("n_all") <= most_bytes)
    small = families.where(fits).join(known.select("rep", "n", "bits"), ["rep", "n"]).select("family", "rep", "n", "bits")
    groups = written(_plausible(small, percent).unionByName(families.where(~fits).select(F.col("family").alias("grp"), "rep")).distinct(), "groups")
    groups = groups.join(known.groupBy("rep").agg(F.max("n").alias("n")), "rep").select("grp", "rep", "n")
    links = _links(own, groups, shingle, percent, most_sets, most_bytes)
    labels = components(links)
    named = classes.select("d1", "d2", "rep").join(labels, F.col("rep") == F.col("node"), "left").select("d1", "d2", "rep", F.coalesce("component", "rep").alias("component"))
    named = written(named, "named")
    joined = described.select("doc_id", "n", "d1", "d2").join(named, ["d1", "d2"], "left")

    def or_own(column: str) -> Column:
        return F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col(column))

    return joined.select("doc_id", F.col("n").alias("n_shingles"), or_own("rep").alias("class_id"), or_own("component").alias("component_id"))


def op4_jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id: sets of 3-word shingles, linked from a similarity of 0.9 on."""
    return similarity_join(docs, shingle=3, percent=90)
