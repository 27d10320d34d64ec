"""Exact n-gram Jaccard self-join by signature trees.

A document is the set of its word shingles (64-bit hashes); it is a leaf with
its size and a token bitmap. The forest has three levels of nodes:

* Top nodes hold the documents that agree on one of their rarest shingles. All
  sets are ordered by one global order, rarest first; linked sets share a
  shingle among the few that come first in both (prefix lengths below), so each
  linked pair shares a top node. The order comes from counts of all shingles of
  all documents in a table of fixed size; any order is correct, a good one keeps
  passages that many documents share out of the top.
* Under a top node stands a tree whose inner nodes hold the OR of token bitmaps
  and the range of sizes. A dual traversal descends into pairs of nodes whose
  largest possible overlap suffices. What it can't exclude joins leaves into
  families; every link lies inside one family.
* A family's leaves form a tree again, now with their texts at hand: the same
  traversal prunes, and surviving leaves are compared exactly.

Both traversals run as ``_search``: nodes of bounded weight in one task; a
heavier one in slots, first each slot with the node's best connected leaf, then
only leaves outside that leaf's component against the slots, in blocks.
"""

from __future__ import annotations

import gc
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, give_back, join_hot, mix64, stored, table
from .components import connected_components

#: Leaves under one inner node.
FANOUT = 8
#: Leaves of a top node, and shingles of a family, that one task takes.
NODE_LEAVES = 8192
FAMILY_SHINGLES = 4_000_000
#: Words of bitmaps that are compared at once (8 MB a side).
BIT_WORDS = 1 << 20
#: Leaves that are compared with all others of a task before the traversal.
STARS = 3
#: Members up to which equal nodes of one partition are recognised as equal.
KNOWN_MEMBERS = 1 << 16
#: Bits of a size's code, and its step (the logarithm of 1.0206).
SIZE_BITS, SIZE_STEP = 10, 0.0204
#: Cells of the table of shingle counts, and cells in one stored row of it.
CELLS, CHUNK = 1 << 22, 1 << 16
_CELL_SHIFT = np.uint64(64 - 22)
#: Texts that a counting task holds as strings at once.
TEXTS = 512
#: Bits for each wanted set in the filter that tells their texts apart, and its least and largest size (8 KiB, 32 MiB).
BITS_PER_SET, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Multiplier of the words' polynomial hash, its inverse mod 2^64, and their powers.
_STEP = 0xD1342543DE82EF95
_POWERS = np.ones(1, np.uint64), np.ones(1, np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the multiplier and of its inverse, mod 2^64."""
    global _POWERS
    if len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = []
        for base in (_STEP, pow(_STEP, -1, 1 << 64)):
            p = np.ones(1, np.uint64)
            while len(p) < size:  # doubling: the next half is this half times its last step
                p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
            out.append(p)
        _POWERS = tuple(out)
    return _POWERS


#: Bytes hashed at once; longer texts are taken in stretches that end between words.
STRETCH = 1 << 20


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words of lower-cased UTF-8, from their bytes alone."""
    if len(raw) > STRETCH:
        cut = max(raw.rfind(c, 0, STRETCH) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut < 0:  # one word longer than a stretch
            ends = [k for k in (raw.find(c, STRETCH) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if k >= 0]
            cut = min(ends, default=len(raw))
        if cut < len(raw):
            parts, rest = [], memoryview(raw)
            while len(rest) > STRETCH:
                head = bytes(rest[: cut + 1])
                parts.append(_hashes(head))
                rest = rest[cut + 1 :]
                near = bytes(rest[:STRETCH])
                cut = max(near.rfind(c) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
                if cut < 0:
                    break
            return np.concatenate([*parts, _hashes(bytes(rest))])
    return _hashes(raw)


def _hashes(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.empty(0, np.uint64)
    space = _SPACE[b]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    up, down = _powers(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=total[1:])
    return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _ODD)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles.

    A-Z are lower-cased, words are runs without ASCII white space; with fewer
    words, the whole sequence is the one shingle; without words the set is empty.
    """
    h = word_hashes(text.encode().lower()) if text else np.empty(0, np.uint64)
    if not len(h):
        return h
    w = min(words, len(h))
    n = len(h) - w + 1
    acc = mix64(h[:n] + np.uint64(w * int(_ODD) & 0xFFFFFFFFFFFFFFFF))
    for k in range(1, w):
        acc = mix64(acc * _ODD + h[k : k + n])
    acc.sort()
    return acc[np.append(True, acc[1:] != acc[:-1])]


def fingerprint(s: np.ndarray) -> bytes:
    """16 bytes that depend on the set alone."""
    return b"".join(int(mix64(s ^ np.uint64(c)).sum(dtype=np.uint64)).to_bytes(8, "little") for c in (0x243F6A8885A308D3, 0x13198A2E03707344))


def node_of(mark: bytes, n: int) -> int:
    """A set's number inside the top of the tree: 52 bits of its fingerprint and a code of its size.

    Sets with one number are never taken for equal: a number stands for all its sets.
    """
    return int.from_bytes(mark[:8], "little") >> 12 << SIZE_BITS | min(int(np.log(n) / SIZE_STEP), (1 << SIZE_BITS) - 1)


def shingle_levels(docs: DataFrame, words: int) -> np.ndarray:
    """How common a shingle is, for each cell of its hash: eighths of log2 of the number of
    shingles in the cell, over all documents. 4 MiB, whatever the input."""

    def count(batches):
        total, one = np.zeros(CELLS, np.uint32), np.uint32(1)
        for b in batches:
            for i in range(0, b.num_rows, TEXTS):
                for t in b.column(0).slice(i, TEXTS).to_pylist():
                    np.add.at(total, (shingle_set(t, words) >> _CELL_SHIFT).astype(np.int64), one)
        for k in range(CELLS // CHUNK):
            cells = total[k * CHUNK : (k + 1) * CHUNK]
            if cells.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(cells.astype("<u4").tobytes(), 1)], pa.binary())], names=["chunk", "cells"])
        del total
        give_back()

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total.setdefault(k, np.zeros(CHUNK, np.int64))
                total[k] += np.frombuffer(zlib.decompress(c), "<u4")
        level = [np.minimum(255, np.round(8 * np.log2(1.0 + c))).astype(np.uint8).tobytes() for c in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(level, pa.binary())], names=["chunk", "cells"])

    schema = "chunk int, cells binary"
    chunks = docs.select("text").mapInArrow(count, schema).repartition(CELLS // CHUNK, "chunk").mapInArrow(add, schema)
    levels = np.zeros(CELLS, np.uint8)
    for r in chunks.collect():
        levels[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.cells, np.uint8)
    return levels


def prefix(s: np.ndarray, levels: np.ndarray, num: int, den: int) -> tuple[np.ndarray, int]:
    """The set's rarest shingles, and how many of them are its short prefix.

    Of two linked sets, the smaller one's short prefix and the larger one's
    whole prefix share a shingle: an overlap of at least t leaves at most
    len - t shingles of a set outside it, and t is at least num / den of the
    larger size and 2 num / (num + den) of the smaller.
    """
    n = len(s)
    long = n - -(-n * num // den) + 1
    short = n - -(-2 * n * num // (num + den)) + 1
    level = levels[(s >> _CELL_SHIFT).astype(np.int64)]
    if long < n // 2:
        least = np.partition(level, long - 1)[long - 1]
        s, level = s[level <= least], level[level <= least]
    return s[np.lexsort((s, level))[:long]], short


def bitmap(s: np.ndarray) -> bytes:
    """A set's token bitmap: 64-bit words, a power of two of them, two to four bits a shingle."""
    width = 1 << max(0, int(np.ceil(np.log2(max(2 * len(s), 64) / 64))))
    return bitmaps([s], width)[0].tobytes()


def bitmaps(sets: list[np.ndarray], width: int) -> np.ndarray:
    bits = np.zeros((len(sets), width), np.uint64)
    for row, s in enumerate(sets):
        at = s & np.uint64(width * 64 - 1)
        np.bitwise_or.at(bits[row], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return bits


def folded(stored_bits: list[bytes], width: int | None = None) -> np.ndarray:
    """Bitmaps at one width: wider ones are folded, which keeps every token's bit."""
    rows = [np.frombuffer(b, np.uint64) for b in stored_bits]
    width = width or min(map(len, rows))
    return np.array([np.bitwise_or.reduce(r.reshape(-1, width), axis=0) for r in rows])


class Tree:
    """Leaves in order of size; each level ORs the bitmaps of FANOUT nodes below."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((bits[:, 0], sizes))
        bits, sizes = bits[self.order], sizes[self.order]
        extra = sizes - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.levels = [(bits, sizes, sizes, extra)]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, extra = self.levels[-1]
            at = np.arange(0, len(bits), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(extra, at)))

    def labelled(self, label: np.ndarray) -> list[np.ndarray]:
        """Each node's label where all its leaves have one, else -1."""
        low = high = label[self.order]
        out = [low]
        for level in self.levels[1:]:
            at = np.arange(0, len(low), FANOUT)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            out.append(np.where(low == high, low, -1))
            assert len(low) == len(level[0])
        return out

    def star(self, center: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leaves, center, largest possible overlap) of the leaves that may link with one."""
        bits, sizes, _, extra = self.levels[0]
        at = int(np.flatnonzero(self.order == center)[0])
        over = np.minimum(np.bitwise_count(bits & bits[at]).sum(axis=1).astype(np.int64) + np.minimum(extra, extra[at]), np.minimum(sizes, sizes[at]))
        keep = over >= -(-num * (sizes + sizes[at]) // (den + num))
        keep[at] = False
        return self.order[keep], np.full(int(keep.sum()), center), over[keep]

    def central(self, among: np.ndarray) -> int:
        """Of some leaves, the one whose bits most of them have."""
        bits = self.levels[0][0]
        rank = np.empty(len(self.order), np.int64)
        rank[self.order] = np.arange(len(self.order))
        some = bits[rank[among[:: max(1, len(among) // 512)]]]
        loose = np.unpackbits(some.view(np.uint8), axis=1).astype(np.float32)
        score = loose @ loose.sum(axis=0) / np.maximum(loose.sum(axis=1), 1)
        return int(among[:: max(1, len(among) // 512)][int(np.argmax(score))])


def tree_of(sets: list[np.ndarray]) -> Tree:
    """A tree of sets at hand, with at least four bits a shingle of a set of average size."""
    mean = sum(map(len, sets)) / len(sets)
    width = 1 << max(0, int(np.ceil(np.log2(max(4 * mean, 64) / 64))))
    return Tree(bitmaps(sets, width), np.array([len(s) for s in sets], np.int64))


def surviving_pairs(a: Tree, b: Tree, num: int, den: int, same: bool, label_a=None, label_b=None):
    """Arrays of leaf pairs (of a, of b, largest possible overlap) that the traversal can't exclude.

    Node pairs whose leaves all have one label are left out.
    """
    if label_a is not None:
        label_a, label_b = a.labelled(label_a), b.labelled(label_b)
    stack = [(len(a.levels) - 1, len(b.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        la, lb, x, y = stack.pop()
        if len(x) > 20_000:
            stack += [(la, lb, x[i : i + 20_000], y[i : i + 20_000]) for i in range(0, len(x), 20_000)]
            continue
        (abits, alow, ahigh, aextra), (bbits, blow, bhigh, bextra) = a.levels[la], b.levels[lb]
        need = -(-num * (alow[x] + blow[y]) // (den + num))
        over = np.minimum(ahigh[x], bhigh[y])
        keep = (over >= need) & (ahigh[x] * den >= blow[y] * num) & (bhigh[y] * den >= alow[x] * num)
        if same and la == lb:
            keep &= (x < y) if la == 0 else (x <= y)
        if label_a is not None:
            keep &= (label_a[la][x] != label_b[lb][y]) | (label_a[la][x] < 0)
        x, y, need, over = x[keep], y[keep], need[keep], over[keep]
        if len(x):
            step = max(1, BIT_WORDS // abits.shape[1])
            common = np.concatenate([np.bitwise_count(abits[x[i : i + step]] & bbits[y[i : i + step]]).sum(axis=1).astype(np.int64) for i in range(0, len(x), step)])
            over = np.minimum(over, common + np.minimum(aextra[x], bextra[y]))
            keep = over >= need
            x, y, over = x[keep], y[keep], over[keep]
        if not len(x):
            continue
        if la == 0 and lb == 0:
            yield a.order[x], b.order[y], over
            continue
        if la >= lb:
            x, y = (x[:, None] * FANOUT + np.arange(FANOUT)).reshape(-1), np.repeat(y, FANOUT)
            inside = x < len(a.levels[la - 1][0])
            la, x, y = la - 1, x[inside], y[inside]
        else:
            x, y = np.repeat(x, FANOUT), (y[:, None] * FANOUT + np.arange(FANOUT)).reshape(-1)
            inside = y < len(b.levels[lb - 1][0])
            lb, x, y = lb - 1, x[inside], y[inside]
        stack.append((la, lb, x, y))


def linked(s: np.ndarray, t: np.ndarray, num: int, den: int) -> bool:
    """den * intersection >= num * union, exactly."""
    both = np.concatenate([s, t])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common > 0 and den * common >= num * (len(s) + len(t) - common)


class Forest:
    """Union-find over the leaves of a task, with the links that joined them."""

    def __init__(self, n: int, test):
        self.parent, self.test, self.links = np.arange(n), test, []

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up

    def _find(self, k: int) -> int:
        p = self.parent
        while p[k] != k:
            p[k] = k = p[p[k]]
        return k

    def join(self, x: np.ndarray, y: np.ndarray, over: np.ndarray) -> None:
        """Tests pairs of different components, the likeliest first, and joins those that pass."""
        root = self.roots()
        apart = root[x] != root[y]
        x, y, over = x[apart], y[apart], over[apart]
        for i in np.argsort(-over, kind="stable").tolist():
            p, q = int(x[i]), int(y[i])
            f, g = self._find(p), self._find(q)
            if f != g and self.test(p, q):
                self.parent[max(f, g)] = min(f, g)
                self.links.append((p, q))


def spanning_links(tree: Tree, n: int, num: int, den: int, test) -> list[tuple[int, int]]:
    """Links that join all linked leaves of a tree into the same components.

    A few central leaves meet all others first, so the traversal finds most
    leaves in one component and leaves out the node pairs inside it.
    """
    forest = Forest(n, test)
    out = np.arange(n)
    for _ in range(STARS if n > 16 else 0):
        center = tree.central(out)
        forest.join(*tree.star(center, num, den))
        root = forest.roots()
        out = np.flatnonzero(root != np.bincount(root).argmax())
        if not len(out):
            return forest.links
    label = forest.roots()
    for x, y, over in surviving_pairs(tree, tree, num, den, True, label, label):
        forest.join(x, y, over)
    return forest.links


def crossing_links(a: Tree, b: Tree, label_a: np.ndarray, label_b: np.ndarray, num: int, den: int, test) -> list[tuple[int, int]]:
    """Links between two trees, one for each two labels that they join (leaves of one label are joined already)."""
    _, group = np.unique(np.concatenate([label_a, label_b]), return_inverse=True)
    na = len(label_a)
    forest = Forest(len(group), lambda p, q: test(p, q - na))
    first = np.full(group.max() + 1, len(group))
    np.minimum.at(first, group, np.arange(len(group)))
    forest.parent = first[group]
    for x, y, over in surviving_pairs(a, b, num, den, False, group[:na], group[na:]):
        forest.join(x, y + na, over)
    return [(p, q - na) for p, q in forest.links]


def consecutive(batches, keys: int):
    """Tables of the consecutive rows that agree on the first ``keys`` columns."""
    held, held_key = [], None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        fresh = np.ones(b.num_rows, bool)
        fresh[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        cut = np.flatnonzero(fresh).tolist()
        for start, end in zip(cut, [*cut[1:], b.num_rows], strict=True):
            key = tuple(c[start] for c in columns)
            if held and key != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(b.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def _tree_top(docs: DataFrame, levels: np.ndarray, words: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The leaves and the members of the tree's top nodes, from one pass over the texts.

    leaves: doc_id, tag, node, n_shingles, mark (fingerprint; null for empty sets) of every row.
    members: (gid, node) of the nodes that hold at least two sets, one of them by its
    short prefix; nodes with equal members are one node.

    A task enters equal sets once. Rows are dealt by key, sorted, and read as a
    stream, so a node of any size passes through a task without being held there.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    common = spark.sparkContext.broadcast(levels)
    names = ["key", "node", "doc_id", "tag", "n_shingles", "mark", "bits"]

    def batch(key, node, doc_id=None, tag=None, n=None, mark=None, bits=None):
        none = [None] * len(key)
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(node, pa.int64()), pa.array(doc_id if n else none, pa.int64()), pa.array(tag if n else none, pa.int64()), pa.array(n or none, pa.int64()), pa.array(mark or none, pa.binary()), pa.array(bits or none, pa.binary())], names=names)

    def enter(batches):
        seen, level = set(), common.value
        for b in batches:
            keys, nodes, leaves = [], [], []
            for d, t, tag in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                s = shingle_set(t, words)
                mark = fingerprint(s) if len(s) else None
                node = node_of(mark, len(s)) if mark else 0
                leaves.append((hash((d, len(leaves), mark)) >> 1, node, d, tag, len(s), mark, bitmap(s) if mark else None))
                if mark and mark not in seen:
                    seen.add(mark)
                    k, short = prefix(s, level, num, den)
                    keys.append(k)
                    nodes.append(node << 1 | (np.arange(len(k)) < short))
            if leaves:
                yield batch(*map(list, zip(*leaves, strict=True)))
            if keys:
                key, node = np.concatenate(keys).view(np.int64), np.concatenate(nodes)
                for i in range(0, len(key), 1 << 18):
                    yield batch(key[i : i + (1 << 18)], node[i : i + (1 << 18)])
        seen.clear()
        give_back()

    # How far the size codes of linked sets can be apart.
    reach = int(np.log(den / num) / SIZE_STEP) + 1

    def groups(batches):
        known: set[int] = set()
        held_key, held = None, None  # the group that is still open
        streaming = False

        def rows(gid, members):
            return batch(np.asarray(gid, np.int64), members >> 1)

        def close(keys, nodes):
            """The groups of at least two, each once a partition: gid and members of every row.

            A group is cut into runs of sizes in which neighbours may link; of a
            run stay the sets that have a partner: of the two, the smaller one is
            there by its short prefix.
            """
            size = nodes >> 1 & (1 << SIZE_BITS) - 1
            order = np.lexsort((size, keys))
            keys, nodes, size, at = keys[order], nodes[order], size[order], np.arange(len(keys))
            run = np.append(True, (keys[1:] != keys[:-1]) | (np.diff(size) > reach))
            start = np.maximum.accumulate(np.where(run, at, 0))
            short = nodes & 1 > 0
            # The nearest short one below in the run, and whether another set comes next within reach or of equal size.
            below = np.maximum.accumulate(np.where(short, at, -1))
            below = np.append(-1, below[:-1])
            larger = (below >= start) & (size - size[np.maximum(below, 0)] <= reach)
            after = np.append(~run[1:], False)
            equal_below = np.append(False, ~run[1:] & (size[1:] == size[:-1]))
            keep = larger | (short & (after | equal_below))
            # Equal codes stand for a range of sizes, so a short one also makes its equals before it partners.
            above = len(at) - 1 - np.maximum.accumulate(np.where(short[::-1], at, -1))[::-1]
            above = np.append(above[1:], len(at))
            equal_above = (above < len(at)) & (size[np.minimum(above, len(at) - 1)] == size) & (start[np.minimum(above, len(at) - 1)] == start)
            keep |= equal_above
            keys, nodes, start = keys[keep], nodes[keep], start[keep]
            if not len(keys):
                return None
            cut = np.flatnonzero(np.append(True, start[1:] != start[:-1]))
            size = np.diff(np.append(cut, len(keys)))
            gid = np.add.reduceat(mix64((nodes >> 1).view(np.uint64) ^ np.uint64(0x452821E638D01377)), cut)
            gid = mix64(gid + size.astype(np.uint64)).view(np.int64)
            keep = np.flatnonzero(size > 1)
            keep = keep[np.array([g not in known and not known.add(g) for g in gid[keep].tolist()], bool)]
            if len(keep):
                row = np.repeat(np.isin(np.arange(len(cut)), keep), size)
                return rows(np.repeat(gid[keep], size[keep]), nodes[row])
            return None

        for b in batches:
            leaf = b.column(4).is_valid()
            if leaf.true_count:
                yield b.filter(leaf)
            keys, nodes = b.column(0).to_numpy(), b.column(1).to_numpy()
            own = ~leaf.to_numpy(zero_copy_only=False)
            keys, nodes = keys[own], nodes[own]
            if not len(keys):
                continue
            fresh = np.append(True, (np.diff(keys) != 0) | (np.diff(nodes) != 0))
            if held_key is not None and held_key == keys[0] and held[-1] == nodes[0]:
                fresh[0] = False
            keys, nodes = keys[fresh], nodes[fresh]
            if not len(keys):
                continue
            if streaming and keys[0] == held_key:  # the rest of a very large group
                n = int(np.searchsorted(keys, held_key, "right"))
                yield rows(np.full(n, held_key), nodes[:n])
                held = nodes[n - 1 : n]
                keys, nodes = keys[n:], nodes[n:]
                if not len(keys):
                    continue
            if held_key is not None and not streaming:
                keys, nodes = np.concatenate([np.full(len(held), held_key), keys]), np.concatenate([held, nodes])
            streaming = False
            tail = int(np.searchsorted(keys, keys[-1], "left"))
            if tail and (out := close(keys[:tail], nodes[:tail])):
                yield out
            held_key, held = keys[-1], nodes[tail:]
            if len(held) > KNOWN_MEMBERS:
                yield rows(np.full(len(held), held_key), held)
                streaming, held = True, held[-1:]
        if held_key is not None and not streaming and (out := close(np.full(len(held), held_key), held)):
            yield out

    schema = "key long, node long, doc_id long, tag long, n_shingles long, mark binary, bits binary"
    dealt = docs.mapInArrow(enter, schema).repartition(parts, "key").sortWithinPartitions("key", "node")
    top = stored(dealt.mapInArrow(groups, schema), "tree-top")
    leaves = top.where("n_shingles is not null").select("doc_id", "tag", F.when(F.col("mark").isNotNull(), F.col("node")).alias("node"), "n_shingles", "mark", "bits")
    leaves.stored_path = top.stored_path
    return leaves, top.where("n_shingles is null").select(F.col("key").alias("gid"), "node")


class Kernel:
    """What a task does with the leaves of a node: ``possible`` works on bitmaps alone, else exactly on texts."""

    def __init__(self, possible: bool, words: int, num: int, den: int):
        self.possible, self.words, self.num, self.den = possible, words, num, den

    def _leaves(self, t: pa.Table):
        """Distinct leaves in runs of sizes: sets more than a link's factor apart in size never link."""
        first: dict[bytes, int] = {}
        for k, m in enumerate(t.column("mark").to_pylist()):
            first.setdefault(m, k)
        at = np.array(list(first.values()), np.int64)
        n = t.column("n").to_numpy()[at].astype(np.int64)
        at, n = at[np.argsort(n, kind="stable")], np.sort(n)
        for run in np.split(np.arange(len(at)), np.flatnonzero(n[:-1] * self.den < n[1:] * self.num) + 1):
            yield t.take(pa.array(at[run], pa.int64()))

    def _tree(self, t: pa.Table, width: int | None = None):
        n, body = t.column("n").to_numpy().astype(np.int64), t.column("body").to_pylist()
        if self.possible:
            return Tree(folded(body, width), n), None
        sets = [shingle_set(x, self.words) for x in body]
        return (tree_of(sets) if width is None else Tree(bitmaps(sets, width), n)), sets

    def inside(self, t: pa.Table):
        """(mark, mark) links that join all linked leaves of one node."""
        for run in self._leaves(t):
            if run.num_rows < 2:
                continue
            tree, sets = self._tree(run)
            test = (lambda p, q: True) if self.possible else (lambda p, q, s=sets: linked(s[p], s[q], self.num, self.den))
            marks = run.column("mark").to_pylist()
            for p, q in spanning_links(tree, len(marks), self.num, self.den, test):
                yield marks[p], marks[q]

    def across(self, t: pa.Table):
        """(mark, mark) links between the leaves of side 0 and those of side 1."""
        side = t.column("side").to_numpy()
        a, b = (t.filter(pa.array(side == k)) for k in (0, 1))
        if not a.num_rows or not b.num_rows:
            return
        width = min(len(x) // 8 for x in t.column("body").to_pylist()) if self.possible else 1 << max(0, int(np.ceil(np.log2(max(4 * float(np.mean(t.column("n").to_numpy())), 64) / 64))))
        (ta, sa), (tb, sb) = self._tree(a, width), self._tree(b, width)
        test = (lambda p, q: True) if self.possible else (lambda p, q: linked(sa[p], sb[q], self.num, self.den))
        ma, mb = a.column("mark").to_pylist(), b.column("mark").to_pylist()
        _, label = np.unique(a.column("component").to_pylist() + b.column("component").to_pylist(), return_inverse=True)
        for p, q in crossing_links(ta, tb, label[: len(ma)], label[len(ma) :], self.num, self.den, test):
            yield ma[p], mb[q]

    def over(self, rows: DataFrame, keys: list[str], how: str) -> DataFrame:
        """Runs ``inside`` or ``across`` on the nodes that ``keys`` name."""
        kernel, parts = self, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)

        def run(batches):
            a, b = [], []
            for t in consecutive(batches, len(keys)):
                if t.num_rows > 1:
                    for p, q in getattr(kernel, how)(t):
                        a.append(p)
                        b.append(q)
                if len(a) > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
                    a, b = [], []
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
            give_back()

        rest = [c for c in rows.columns if c not in keys]
        return rows.select(*keys, *rest).repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, "a binary, b binary")


def _search(rows: DataFrame, weight: str, most: int, kernel: Kernel) -> DataFrame:
    """Links (a, b) that join all linked leaves of each node.

    ``rows``: gid (node), mark, n, body, score. A node of at most ``most`` summed
    ``weight`` is one task's. A heavier node is dealt into slots. Superstep 1
    searches each slot together with the node's best connected leaf; superstep 2
    searches the leaves that are not in that leaf's component, in blocks, against
    the slots. A node of near copies ends after the first.
    """
    heavy = rows.groupBy("gid").agg(F.sum(weight).alias("total"), F.max(F.struct("score", "mark")).alias("x"))
    heavy = stored(heavy.where(F.col("total") > most).select("gid", F.ceil(F.col("total") / most).cast("int").alias("slots"), F.col("x.mark").alias("pivot")), "heavy-nodes")
    if heavy.isEmpty():
        return stored(kernel.over(rows.select("gid", "mark", "n", "body"), ["gid"], "inside"), "links")
    light = rows.join(heavy, "gid", "left_anti").select("gid", F.lit(0).alias("slot"), "mark", "n", "body")
    large = stored(rows.join(heavy, "gid").withColumn("slot", F.pmod(F.xxhash64("mark"), F.col("slots")).cast("int")).select("gid", "slot", "slots", "pivot", "mark", "n", "body"), "heavy-leaves")
    pivots = large.where("mark = pivot").withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    dealt = large.where("mark != pivot").unionByName(pivots).select("gid", "slot", "mark", "n", "body")
    links = stored(kernel.over(light.unionByName(dealt), ["gid", "slot"], "inside"), "links")
    found = connected_components(links)
    named = large.join(found.withColumnsRenamed({"node": "mark", "component": "own"}), "mark", "left")
    of_pivot = heavy.join(found.withColumnsRenamed({"node": "pivot", "component": "main"}), "pivot", "left").select("gid", F.coalesce("main", "pivot").alias("main"))
    named = stored(named.join(of_pivot, "gid").withColumn("component", F.coalesce("own", "mark")).drop("own"), "named-leaves")
    apart = named.where("component != main")
    blocks = stored(apart.groupBy("gid").agg(F.ceil(F.sum(F.lit(1) if weight == "one" else F.col("n")) / most).cast("int").alias("blocks")), "open-nodes")
    if not blocks.isEmpty():
        sides = named.join(blocks, "gid")
        one = apart.join(blocks, "gid").withColumn("block", F.pmod(F.xxhash64("mark", F.lit(1)), F.col("blocks")).cast("int")).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
        two = sides.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        both = one.withColumn("side", F.lit(0)).unionByName(two.withColumn("side", F.lit(1)))
        links = stored(links.union(kernel.over(both.select("gid", "slot", "block", "side", "mark", "n", "body", "component"), ["gid", "slot", "block"], "across")), "links")
    for done in (large, named, heavy, blocks):
        discard(done)
    return links


def _texts(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(mark, body): one text of each wanted set.

    A filter built from all wanted marks, sized by their number, keeps most other
    texts from being moved (all but a sixteenth of them up to 16 million wanted sets; beyond,
    the filter fills, and in the end each distinct text is moved once). What it
    lets through is checked by an exact join.
    """
    bits_needed = min(max(1 << (BITS_PER_SET * wanted.count()).bit_length(), LEAST_BITS), MOST_BITS)

    def bit(marks):
        return (mix64(np.frombuffer(b"".join(m[:8] for m in marks), np.uint64)) % np.uint64(bits_needed)).astype(np.int64)

    def gather(batches):
        held = np.zeros(bits_needed, bool)
        for b in batches:
            if b.num_rows:
                held[bit(b.column(0).to_pylist())] = True
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(held).tobytes(), 1)], pa.binary())], names=["bits"])

    held = np.zeros(bits_needed // 8, np.uint8)
    for r in wanted.select("mark").mapInArrow(gather, "bits binary").toLocalIterator():
        held |= np.frombuffer(zlib.decompress(r.bits), np.uint8)
    share = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches):
        bits, seen = share.value, set()
        for b in batches:
            marks, kept = [], []
            for t in b.column(0).to_pylist():
                s = shingle_set(t, words)
                mark = fingerprint(s) if len(s) else None
                if mark and mark not in seen:
                    at = int(bit([mark])[0])
                    if bits[at >> 3] >> (7 - (at & 7)) & 1:
                        seen.add(mark)
                        marks.append(mark)
                        kept.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.binary()), pa.array(kept, pa.string())], names=["mark", "body"])
        seen.clear()
        give_back()

    return docs.select("text").mapInArrow(run, "mark binary, body string").join(wanted.select("mark"), "mark", "left_semi").dropDuplicates(["mark"])


def jaccard_classes(docs: DataFrame, words: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The leaves (doc_id, tag, n_shingles, mark) of all rows of docs (doc_id, text, tag), and
    (mark, component) of the sets that have links; component is the component's smallest mark."""
    spark = docs.sparkSession
    leaves, nodes = _tree_top(docs, shingle_levels(docs, words), words, num, den)
    release(spark)
    nodes = nodes.distinct()
    met = nodes.select("node").distinct()
    classes = stored(leaves.where("mark is not null").select("node", "mark", F.col("n_shingles").alias("n"), F.col("bits").alias("body")).join(met, "node", "left_semi").dropDuplicates(["mark"]), "classes")
    # A leaf's score is how often it meets others; an unedited original meets all its copies.
    score = nodes.groupBy("node").agg(F.count("*").alias("score"))
    members = stored(nodes.join(classes.join(score, "node"), "node").select("gid", "mark", "n", "body", "score").withColumn("one", F.lit(1)), "members")
    maybe = _search(members, "one", NODE_LEAVES, Kernel(True, words, num, den))
    discard(members)
    release(spark)
    families = connected_components(maybe)
    wanted = stored(families.withColumnsRenamed({"node": "mark", "component": "family"}).join(classes.select("mark", "n"), "mark"), "families")
    texts = _texts(docs, wanted, words)
    degree = maybe.select(F.explode(F.array("a", "b")).alias("mark")).groupBy("mark").agg(F.count("*").alias("score"))
    rows = stored(wanted.join(degree, "mark").join(texts, "mark").select(F.xxhash64("family").alias("gid"), "mark", "n", "body", "score"), "family-leaves")
    links = _search(rows, "n", FAMILY_SHINGLES, Kernel(False, words, num, den))
    discard(rows)
    found = connected_components(links)
    for done in (classes, maybe, wanted, links):
        discard(done)
    return leaves, found.withColumnRenamed("node", "mark")


def jaccard_components(df: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``df``.

    Two documents link when den * |A and B| >= num * |A or B| for their shingle
    sets; component_id is the smallest id reachable by links. Equal sets are
    one leaf. Null or empty texts have no shingles and link with nothing
    (component_id is their own id). Rows without an id take part in linking;
    a component of such rows alone has a null component_id. Repeated rows give
    repeated rows, other columns are left out, and an empty table gives no rows.
    Shingles are compared by 64-bit hashes, so n_shingles counts different hashes.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.lit(None).cast("long").alias("tag"))
    return labelled(*jaccard_classes(docs, words, num, den))


def labelled(leaves: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every leaf, from the components (mark, component) of the sets that have links."""
    lows = leaves.where("mark is not null").groupBy("mark").agg(F.min("doc_id").alias("low"), F.count("*").alias("rows"))
    named = stored(lows.join(found, "mark", "left").withColumn("component", F.coalesce("component", "mark")), "named")
    least = named.groupBy("component").agg(F.min("low").alias("component_id"), F.count("*").alias("rows"))
    ids = stored(join_hot(named.select("mark", "component", F.col("rows").alias("copies")), least, "component", "rows").select("mark", "component_id", F.col("copies").alias("rows")), "ids")
    full = join_hot(leaves.where("mark is not null"), ids, "mark", "rows").select("doc_id", "n_shingles", "component_id")
    return full.union(leaves.where("mark is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def release(spark: SparkSession) -> None:
    """Lets the driver drop shuffle files that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=3, num=90, den=100)
