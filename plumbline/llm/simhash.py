"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints are 64-bit majorities over the XXH64 hashes of 4-word shingles. Rows of one fingerprint are collapsed to
one leaf. The index's upper nodes are masked bit patterns: the 64 bits fall into 6 blocks, and two fingerprints with at
most 4 differing bits agree on at least 2 blocks, so they meet under one of the 15 patterns of 2 blocks. Below an
upper node the fingerprints are sorted by Gray rank, and runs of neighbours are factored, level by level, into nodes
that keep the bits all their leaves share. Pairs of nodes are followed from the top; a pair is pruned as a whole when
its shared bits already differ in more than 4 places, or when all its leaves are known to be in one group. An upper
node with more than `NODE` fingerprints is parted by hash and each pair of parts is searched on its own.

Only the links of a spanning forest leave a task; components are found by contraction (`components.py`).

Defined results: a null or empty text has fingerprint zero and is linked like any other; a null document id is
never a component's name unless nothing else is in it (then the name is null) and its row always stays in
`keep_one`; of repeated rows with the id that stays, one stays; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bytes import LOWER, buffer_of
from plumbline.llm.components import components
from plumbline.llm.storage import stored

SHINGLE = 4
DISTANCE = 4
SEED = 42
BLOCKS = 6
NODE = 1 << 16
FAN = 16
_LOWER = LOWER.tobytes()


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of a text in UTF-8."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[:len(words) - size + 1].tolist(), ends[size - 1:].tolist())), np.uint64, len(words) - size + 1)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", size: int = SHINGLE) -> DataFrame:
    """`doc_id` and signed 64-bit `fp` of every row."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffer_of(batch.column("text"))
            fps = np.fromiter((fingerprint(data[a:b].tobytes(), size) for a, b in zip(offsets[:-1], offsets[1:])), np.uint64, len(offsets) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(per_batch, "doc_id long, fp long")


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence, where neighbours differ in one bit."""
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class Groups:
    """Disjoint sets over 0..n-1 with bulk merges; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Unite the sets of each pair; the places of pairs that united two sets, a spanning forest of what they joined."""
        used, place = [], np.arange(len(a))
        while True:
            ra, rb = self.parent[a], self.parent[b]
            open_ = ra != rb
            if not open_.any():
                return np.concatenate(used) if used else place[:0]
            a, b, place = a[open_], b[open_], place[open_]
            low, high = np.minimum(ra, rb)[open_], np.maximum(ra, rb)[open_]
            order = np.lexsort((low, high))
            first = order[np.flatnonzero(np.diff(high[order], prepend=-1))]
            used.append(place[first])
            self.parent[high[first]] = low[first]
            while True:
                up = self.parent[self.parent]
                if np.array_equal(up, self.parent):
                    break
                self.parent = up


class GrayIndex:
    """Nodes over fingerprints that are sorted by (upper node, Gray rank)."""

    def __init__(self, keys: np.ndarray, fps: np.ndarray, distance: int = DISTANCE):
        self.distance = distance
        order = np.lexsort((gray_rank(fps), keys))
        keys, self.fps = keys[order], fps[order]
        self.leaf, self.member = np.unique(self.fps, return_inverse=True)
        self.groups = Groups(len(self.leaf))
        #: Pairs of leaves whose link joined two groups.
        self.forest: list[tuple[np.ndarray, np.ndarray]] = []
        #: Per level: first child of each node (with an end), bits shared by its leaves, and their values.
        self.first, self.shared, self.value = [np.arange(len(keys) + 1)], [np.full(len(keys), ~np.uint64(0))], [self.fps]
        while len(keys) > 1 and (keys[1:] == keys[:-1]).any():
            opens = np.concatenate([[True], keys[1:] != keys[:-1]])
            start = np.flatnonzero(opens)
            place = np.arange(len(keys)) - np.repeat(start, np.diff(np.append(start, len(keys))))
            cut = np.flatnonzero(place % FAN == 0)
            low = np.bitwise_and.reduceat(self.value[-1] & self.shared[-1], cut)
            high = np.bitwise_or.reduceat(self.value[-1] | ~self.shared[-1], cut)
            keys = keys[cut]
            self.first.append(np.append(cut, len(place)))
            self.shared.append(~(low ^ high))
            self.value.append(low)

    def _settled(self) -> list[np.ndarray]:
        """Per level: the group of a node whose leaves are all in one group, else a number of its own below 0."""
        low = high = self.groups.parent[self.member]
        out = [low]
        for first in self.first[1:]:
            low, high = np.minimum.reduceat(low, first[:-1]), np.maximum.reduceat(high, first[:-1])
            out.append(np.where(low == high, low, -1 - np.arange(len(low))))
        return out

    def _children(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = self.first[level]
        na, nb = first[a + 1] - first[a], first[b + 1] - first[b]
        total = na * nb
        pair = np.repeat(np.arange(len(a)), total)
        inner = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
        x, y = first[a][pair] + inner // nb[pair], first[b][pair] + inner % nb[pair]
        keep = x <= y
        return x[keep], y[keep]

    def link(self, block: int = 1 << 15) -> Groups:
        """Follow node pairs down, pruning whole pairs, until every pair of leaves is linked or ruled out."""
        top = len(self.first) - 1
        roots = np.arange(len(self.value[top]))
        stack, settled = [(top, roots, roots)], self._settled()
        while stack:
            level, a, b = stack.pop()
            if len(a) > block:
                stack += [(level, a[i:i + block], b[i:i + block]) for i in range(0, len(a), block)]
                continue
            apart = np.bitwise_count((self.value[level][a] ^ self.value[level][b]) & self.shared[level][a] & self.shared[level][b])
            keep = (apart <= self.distance) & ((settled[level][a] != settled[level][b]) | ((settled[level][a] < 0) & (level > 0)))
            a, b = a[keep], b[keep]
            if level == 0:
                if len(a):
                    x, y = self.member[a], self.member[b]
                    used = self.groups.merge(x, y)
                    self.forest.append((x[used], y[used]))
                    settled = self._settled()
            elif len(a):
                stack.append((level - 1, *self._children(level, a, b)))
        return self.groups


def _masks(blocks: int = BLOCKS, shared: int = BLOCKS - DISTANCE) -> list[int]:
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    bits = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(bits, shared)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(leaves: DataFrame, node: int = NODE, distance: int = DISTANCE, blocks: int = BLOCKS, agreeing: int | None = None, rising: Sequence[int] = ()) -> DataFrame:
    """Links `a`, `b` that join all fingerprints `fp` (distinct rows) within the distance, directly or in steps.

    Without more, a link leads to the smallest fingerprint of the group. With `rising` distances every link is a pair within
    the distance, the nearest pairs first, so that a task's links are a shortest spanning forest of what meets in it.
    """
    patterns = F.array(*[F.struct(F.lit(k).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for k, m in enumerate(_masks(blocks, blocks - distance if agreeing is None else agreeing))])
    upper = leaves.select("fp", F.explode(patterns).alias("p")).select("fp", "p.m", "p.bits")
    hot = stored(upper.groupBy("m", "bits").count().where(F.col("count") > node)
                 .select(F.col("m").alias("hm"), F.col("bits").alias("hb"), F.ceil(F.col("count") / node).cast("int").alias("parts")), "hot")
    parts = upper.join(hot, (F.col("m") == F.col("hm")) & (F.col("bits") == F.col("hb")), "left").withColumn("part", F.expr("pmod(hash(fp), parts)"))
    dealt = parts.select("fp", "m", "bits", F.explode(F.expr("if(parts is null, array(0L), transform(sequence(0, parts - 1), q -> least(part, q) * 1000000L + greatest(part, q)))")).alias("pair"))

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column("key").to_numpy(zero_copy_only=False), b.column("fp").to_numpy(zero_copy_only=False)) for b in batches]
        if got:
            keys, fps = np.concatenate([k for k, _ in got]), np.concatenate([f for _, f in got]).view(np.uint64)
            _, at, count = np.unique(keys, return_inverse=True, return_counts=True)
            shared = count[at] > 1
            index = GrayIndex(keys[shared], fps[shared], distance)
            for index.distance in rising if len(index.fps) else ():
                index.link()
            if rising:
                a, b = (np.concatenate([*(pair[k] for pair in index.forest), np.zeros(0, np.int64)]) for k in range(2))
                leaf = index.leaf.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(leaf[a]), pa.array(leaf[b])], ["a", "b"])
            elif len(index.fps):
                root = index.link().parent
                moved = np.flatnonzero(root != np.arange(len(root)))
                leaf = index.leaf.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(leaf[moved]), pa.array(leaf[root[moved]])], ["a", "b"])

    return dealt.select(F.xxhash64("m", "bits", "pair").alias("key"), "fp").repartition("key").mapInArrow(per_task, "a long, b long")


def grouped(docs: DataFrame) -> DataFrame:
    """`doc_id`, `fp` and `component_id` of every row."""
    fps = stored(fingerprints(docs), "fingerprints")
    leaves = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "leaves")
    labels = components(links(leaves))
    named = leaves.join(labels, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("of"), "least", F.coalesce("label", "fp").alias("label"))
    named = stored(named, "named")
    names = named.groupBy(F.col("label").alias("l")).agg(F.min("least").alias("component_id"))
    table = named.join(names, F.col("label") == F.col("l")).select("of", "component_id")
    return fps.join(table, F.col("fp") == F.col("of")).select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    return grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs` with the smallest id of every component only; all columns stay."""
    found = stored(grouped(docs).select(F.col("doc_id").alias("id"), "component_id"), "components")
    gone = stored(found.where("id <> component_id").select("id").distinct(), "gone")
    again = stored(found.where("id = component_id").groupBy("id").count().where(F.col("count") > 1).select("id"), "again")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("at"))
    once = rows.join(gone.unionAll(again), F.col("at") == F.col("id"), "left_anti")
    first = rows.join(again, F.col("at") == F.col("id"), "left_semi").dropDuplicates(["at"])
    return once.unionAll(first).select("row.*")
