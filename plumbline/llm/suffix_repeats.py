"""Suffix-array dedup: common-prefix interval trees over enhanced suffix arrays of anchored suffixes.

Only suffixes that begin at an anchor are indexed. The anchor of a 100-byte string is the position in it whose 24 bytes
have the least hash (the last of several), so equal strings have equal anchors at equal offsets and every repeat of 100
bytes or more is met in the suffix array of its anchor's bucket. Per bucket:

* the anchored suffixes are sorted, with the lengths of the prefixes that neighbours share (LCP);
* a stack scan over the LCPs gives the tree of common-prefix intervals;
* each interval is tested for left-extension diversity: where all its occurrences share the bytes to their left too,
  they form one group as far as those bytes agree; where they differ, the interval is parted by a second stack scan,
  over the sorted left contexts;
* every group is a set of all occurrences of one repeat, reaching to the left and right as far as they agree.

Of each group all occurrences but the earliest are repeats, and their bytes are covered.

Anchors go to buckets first, by hash alone, about 6 bytes each; only those met twice come back and send their contexts
(100 bytes and the reach of the anchor). A slab settles first what repeats inside it, so that of a passage that very
many documents share only the first occurrence in the slab travels on. Whole copies of an earlier text are set aside.
Anchor hashes only propose; bytes decide.

Defined results: a null text is empty; a null document id comes after all others; rows of one id are one place in
order: equal strings at the same offset of repeated rows do not count as earlier; empty tables give empty results;
the other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bytes import buffer_of, rolling_hashes, slabs, spread, within_rows
from plumbline.llm.packets import RETURNS, RETURNS_SQL, bucket_of, by_document, identified, later_copies, n_buckets, pack, places, record_batch, returned, runs, unpack, unplanes

LENGTH = 100
GRAM = 24
REACH = LENGTH - GRAM
SLAB = 1 << 19
_TIE = (1 << 24) - 1


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors, and the first and last string (by its start) that each anchors."""
    grams = rolling_hashes(data, GRAM)
    fits = within_rows(offsets, LENGTH)
    found = np.zeros(len(fits), np.int64)
    step = 1 << 22
    for a in range(0, len(fits), step):
        part = grams[a:a + step + REACH]
        least = (part | np.uint64(_TIE)) - np.arange(len(part), dtype=np.uint64)  # the last of equal hashes is the least
        width = 1
        while 2 * width <= REACH + 1:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = REACH + 1 - width
        least = np.minimum(least[:len(least) - rest], least[rest:])
        found[a:a + len(least)] = a + (_TIE - (least & np.uint64(_TIE)).astype(np.int64))
    starts = np.flatnonzero(fits)
    at = found[starts]
    first = runs(at)
    last = np.append(first[1:], len(at)) - 1
    at = at[first] if len(at) else at
    # Least hashes are small numbers; buckets need them spread again.
    return at, spread(grams[at]), starts[first], starts[last] if len(at) else starts


@dataclass
class Contexts:
    """Anchored suffixes with their surroundings; bytes are shifted by one so that 0 marks what is not there."""

    did: np.ndarray
    place: np.ndarray
    least: np.ndarray  # offsets of the anchor in the strings it anchors: smallest
    most: np.ndarray  # and largest
    right: np.ndarray  # (n, LENGTH) bytes from the anchor on
    left: np.ndarray  # (n, REACH) bytes before the anchor, nearest first


def gather(data: np.ndarray, did: np.ndarray, place: np.ndarray, at: np.ndarray, least: np.ndarray, most: np.ndarray) -> Contexts:
    """Contexts around positions `at` of `data`, copied some thousand at a time."""
    n, ahead, back = len(at), np.arange(LENGTH), np.arange(REACH)
    right, left = np.empty((n, LENGTH), np.uint8), np.empty((n, REACH), np.uint8)

    def around(where: np.ndarray, held: np.ndarray) -> np.ndarray:
        return np.where(held, data[np.clip(where, 0, len(data) - 1)] + np.uint8(1), np.uint8(0))

    for i in range(0, n, 4096):
        k = slice(i, i + 4096)
        right[k] = around(at[k, None] + ahead, ahead < (LENGTH - least[k])[:, None])
        left[k] = around(at[k, None] - 1 - back, back < most[k][:, None])
    return Contexts(did, place, least, most, right, left)


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of rows."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def intervals(shared: list[int], extra: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """Stack scan: (first, last, depth, depth of the parent, least `extra` between neighbours) of every interval of two or more.

    `shared[i]` is what entries i and i + 1 have in common; intervals of depth 0 are left out.
    """
    stack = [[0, 0, 1 << 30]]  # depth, first entry, least extra so far
    for i, depth in enumerate([*shared, 0]):
        first, least = i, 1 << 30
        while stack[-1][0] > depth:
            top, first, held = stack.pop()
            least = min(least, held)
            yield first, i, top, max(depth, stack[-1][0]), least
        if i < len(extra):
            least = min(least, extra[i])
        if depth > stack[-1][0]:
            stack.append([depth, first, least])
        else:
            stack[-1][2] = min(stack[-1][2], least)


def repeat_groups(c: Contexts) -> Iterator[tuple[np.ndarray, int, int]]:
    """Groups of occurrences (indices into the contexts) with the smallest and largest anchor offset of the strings they share."""
    order = np.argsort(np.ascontiguousarray(c.right).view(f"S{LENGTH}").ravel(), kind="stable")
    right, left = c.right[order], c.left[order]
    shared, before = _shared(right[1:], right[:-1]), _shared(left[1:], left[:-1])
    for first, last, depth, above, common in intervals(shared.tolist(), before.tolist()):
        low, high = max(0, LENGTH - depth), min(REACH, LENGTH - 1 - above)
        if low > high:
            continue
        if low <= common:
            yield order[first:last + 1], low, min(high, common)
        if common >= high or last == first + 1:
            continue
        own = left[first:last + 1]  # left extensions differ: part the interval by them
        turned = np.argsort(np.ascontiguousarray(own).view(f"S{REACH}").ravel(), kind="stable")
        agree = _shared(own[turned[1:]], own[turned[:-1]])
        for a, b, deep, over, _ in intervals(agree.tolist(), []):
            if max(low, over + 1) <= min(high, deep) and deep > common:
                yield order[first + turned[a:b + 1]], max(low, over + 1, common + 1), min(high, deep)


def later_strings(c: Contexts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences that an earlier one equals: index, smallest and largest anchor offset of the strings concerned."""
    if len(c.did) < 2:
        return (np.zeros(0, np.int64),) * 3
    rank = np.empty(len(c.did), np.int64)
    order = np.lexsort((c.place, c.did))
    change = np.zeros(len(order), bool)
    change[runs(c.did[order])] = True
    change[runs(c.place[order])] = True
    rank[order] = np.cumsum(change)
    who, low, high = [], [], []
    for members, a, b in repeat_groups(c):
        if len(members) == 2:
            i, j = members
            if rank[i] != rank[j]:
                who.append(int(j if rank[j] > rank[i] else i)), low.append(a), high.append(b)
            continue
        ranks = rank[members]
        for m in members[ranks > ranks.min()].tolist():
            who.append(m), low.append(a), high.append(b)
    who = np.array(who, np.int64)
    low, high = np.maximum(np.array(low, np.int64), c.least[who]), np.minimum(np.array(high, np.int64), c.most[who])
    keep = low <= high
    return who[keep], low[keep], high[keep]


_ANCHORS = [("bucket", pa.int32()), ("did", pa.binary()), ("counts", pa.binary()), ("place", pa.binary()), ("part", pa.binary())]
_ANCHORS_SQL = "bucket int, did binary, counts binary, place binary, part binary"


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _slabs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = buffer_of(batch.column("text"))
    for first, last in slabs(offsets, SLAB):
        yield first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]


def _met(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more, and which entry is the first of its key."""
    order = np.argsort(keys, kind="stable")
    first = runs(keys[order])
    count = np.diff(np.append(first, len(keys)))
    twice, lead = np.empty(len(keys), bool), np.zeros(len(keys), bool)
    twice[order] = np.repeat(count > 1, count)
    lead[order[first]] = True
    return twice, lead


def _anchors(buckets: int):
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            ids = _numbers(batch, "did")
            for first, last, data, offsets in _slabs(batch):
                at, keys, _, _ = anchors(data, offsets)
                if not len(at):
                    continue
                row = np.searchsorted(offsets, at, "right") - 1
                place, own = at - offsets[row], ids[first:last]
                twice, lead = _met(keys)
                part = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                made = list(pack(bucket_of(keys[lead], buckets), row[lead], place[lead], [own], [part[lead]]))
                turn += 1
                made += [[*p, None] for p in pack(np.full(int(twice.sum()), (first + turn) % buckets), row[twice], place[twice], [own], [])]
                yield record_batch(made, _ANCHORS)

    return per_batch


def _hits(buckets: int):
    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, list] = {}
        for batch in batches:
            settled = []
            for bucket, did, counts, place, part in zip(*(batch.column(c).to_pylist() for c, _ in _ANCHORS)):
                (ids,), at = unpack([did], counts, place)
                if part is None:  # met twice in its slab
                    settled += returned(ids, None, at, None, buckets)
                else:
                    open_.setdefault(bucket, []).append((ids, at, unplanes(part, np.uint32)))
            yield record_batch(settled, RETURNS)
        for got in open_.values():
            ids, at, part = (np.concatenate(c) for c in zip(*got))
            got.clear()
            twice, _ = _met(part)
            yield record_batch(returned(ids[twice], None, at[twice], None, buckets), RETURNS)

    return per_partition


_CONTEXTS = [("bucket", pa.int32()), ("did", pa.binary()), ("tk", pa.binary()), ("counts", pa.binary()), ("place", pa.binary()), ("least", pa.binary()), ("most", pa.binary()), ("bytes", pa.binary())]
_CONTEXTS_SQL = "bucket int, did binary, tk binary, counts binary, place binary, least binary, most binary, bytes binary"


def _spread(parts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions parts[i] .. parts[i] + sizes[i] - 1, one after the other."""
    return np.repeat(parts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _contexts(buckets: int):
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            ids, texts, hits = _numbers(batch, "did"), _numbers(batch, "tk"), batch.column("hits").to_pylist()
            for first, last, data, offsets in _slabs(batch):
                at, keys, begin, end = anchors(data, offsets)
                hit = np.isin(at, np.concatenate([offsets[k] + places(hits[first + k]) for k in range(last - first)]))
                at, keys, begin, end = at[hit], keys[hit], begin[hit], end[hit]
                if not len(at):
                    continue
                row = np.searchsorted(offsets, at, "right") - 1
                place, own, own_texts = at - offsets[row], ids[first:last], texts[first:last]
                least, most = at - end, at - begin
                who, low, high = later_strings(gather(data, own[row], place, at, least, most))
                settled = np.zeros(len(at), np.int64)
                np.add.at(settled, who, high - low + 1)
                go = settled < most - least + 1  # some string of it is the first of its kind here
                made = []
                bucket = bucket_of(keys, buckets)
                order = np.flatnonzero(go)[np.argsort(bucket[go], kind="stable")]
                size = (end + LENGTH - begin)[order]
                raw, cuts = data[_spread(begin[order], size)], np.concatenate([[0], np.cumsum(size)])
                ends = np.append(runs(bucket[order]), len(order))
                packed = pack(bucket[go], row[go], place[go], [own, own_texts], [least[go].astype(np.uint8), most[go].astype(np.uint8)])
                for p, a, b in zip(packed, ends[:-1], ends[1:]):
                    made.append([*p, raw[cuts[a]:cuts[b]].tobytes()])
                turn += 1
                # Spans settled here go on as they are, in any bucket: their packet has no bytes, and `most` holds the ends.
                spans = returned(own[row[who]], own_texts[row[who]], place[who] - high, place[who] - low + LENGTH, 1)
                made += [[(first + turn) % buckets, did, tk, counts, start, None, until, None] for _, did, tk, counts, start, until in spans]
                yield record_batch(made, _CONTEXTS)

    return per_batch


def _repeats(buckets: int):
    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, list] = {}
        for batch in batches:
            settled = []
            for bucket, did, tk, counts, place, least, most, raw in zip(*(batch.column(c).to_pylist() for c, _ in _CONTEXTS)):
                if raw is None:
                    (ids, texts), start = unpack([did, tk], counts, place)
                    settled += returned(ids, texts, start, start + unplanes(most, np.uint32), buckets)
                else:
                    open_.setdefault(bucket, []).append((did, tk, counts, place, least, most, raw))
            yield record_batch(settled, RETURNS)
        for got in open_.values():
            parts = []
            for did, tk, counts, place, least, most, raw in got:
                (ids, texts), at = unpack([did, tk], counts, place)
                parts.append((ids, texts, at, unplanes(least, np.uint8).astype(np.int64), unplanes(most, np.uint8).astype(np.int64), np.frombuffer(raw, np.uint8)))
            got.clear()
            ids, texts, place, least, most, data = (np.concatenate(c) for c in zip(*parts))
            del parts
            size = most - least + LENGTH
            at = np.cumsum(size) - size + most
            who, low, high = later_strings(gather(data, ids, place, at, least, most))
            yield record_batch(returned(ids[who], texts[who], place[who] - high, place[who] - low + LENGTH, buckets), RETURNS)

    return per_partition


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of overlapping or touching spans, rows of (first, end)."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    opens = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.stack([spans[opens, 0], reach[np.append(np.flatnonzero(opens)[1:], len(spans)) - 1]], axis=1)


_KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _kept(with_spans: bool):
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffer_of(batch.column("text"))
            texts, rows, cut = _numbers(batch, "tk"), [], []
            for k, found in enumerate(batch.column("found").to_pylist()):
                text = data[offsets[k]:offsets[k + 1]]
                own = [f for f in found or [] if f["tk"] == texts[k]]
                spans = np.zeros((0, 2), np.int64)
                if any(f["starts"] is None for f in own):  # a copy of an earlier text
                    spans = np.array([[0, len(text)]]) if len(text) >= LENGTH else spans
                elif own:
                    spans = merged(np.stack([np.frombuffer(own[0][c], np.uint32).astype(np.int64) for c in ("starts", "ends")], axis=1))
                keep = np.ones(len(text), bool)
                for a, b in spans:
                    keep[a:b] = False
                rows.append((len(text), int(len(text) - keep.sum()), len(spans), hashlib.sha256(text[keep].tobytes()).hexdigest()))
                cut.append([{"first": int(a), "end": int(b)} for a, b in spans])
            columns = list(zip(*rows)) or [[]] * 4
            arrays = [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())]
            if with_spans:
                arrays.append(pa.array(cut, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))))
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in _KEPT.split(", ")] + ["spans"] * with_spans)

    return per_batch


def dedup(docs: DataFrame, with_spans: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, on demand, the removed `spans` in bytes."""
    rows, buckets = identified(docs), n_buckets(docs)
    copies = later_copies(rows)
    flagged = copies.select(F.col("did").alias("d"), F.col("tk").alias("t"))
    originals = rows.join(flagged, (F.col("did") == F.col("d")) & (F.col("tk") == F.col("t")), "left_anti")
    found = originals.select("did", "text").mapInArrow(_anchors(buckets), _ANCHORS_SQL).repartitionById(buckets, "bucket")
    hits = by_document(found.mapInArrow(_hits(buckets), RETURNS_SQL), buckets).select(F.col("did").alias("d"), F.col("places").alias("hits"))
    # Both joins read the same columns of the documents, so that Spark shuffles these once.
    near = rows.join(hits, F.col("did") == F.col("d")).select("doc_id", "did", "tk", "text", "hits")
    contexts = near.mapInArrow(_contexts(buckets), _CONTEXTS_SQL).repartitionById(buckets, "bucket")
    spans = by_document(contexts.mapInArrow(_repeats(buckets), RETURNS_SQL), buckets).select("did", "tk", F.col("places").alias("starts"), F.col("untils").alias("ends"))
    none = F.lit(None).cast("binary")
    spans = spans.unionByName(copies.select("did", "tk", none.alias("starts"), none.alias("ends")))
    per_document = spans.groupBy(F.col("did").alias("d")).agg(F.collect_list(F.struct("tk", "starts", "ends")).alias("found"))
    joined = rows.join(per_document, F.col("did") == F.col("d"), "left").select("doc_id", "did", "tk", "text", "found")
    return joined.mapInArrow(_kept(with_spans), _KEPT + ", spans array<struct<first:long,end:long>>" * with_spans)
