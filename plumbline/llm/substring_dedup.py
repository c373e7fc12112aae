"""Substring dedup by fixed-block anchors.

Every document is cut into non-overlapping blocks of 7 words, the index; every rolling window of 7 words probes it.
A repeated window of 13 words holds exactly one whole block of the document it stands in, so both its places are hit.
Hits are extended to the windows of 13 words around them, which are matched as wholes; matched windows that overlap or
adjoin make up the maximal exact repeats, and the words of each repeat go from every document but the first.

Probes travel packed, about 6 bytes each, to buckets by hash. A block is itself a probe at a place divisible by 7, so the
index needs no rows of its own. Before each shuffle a slab decides what it can: of a block or window that stands often in a slab,
only the first and the last document travel on, so a passage that very many documents share stays small. Whole
copies of an earlier text are set aside first. Block hashes have 32 bits beside the bucket and only propose windows;
windows are matched by 64 bits beside the bucket.

Defined results: a null text has no words; a null document id comes after all others, and several such rows count as
one document; so do repeated rows of one id, whose windows are never removed on account of each other; empty tables
give empty results; the other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bytes import SLAB, buffer_of, covered, slabs, span_hashes, window_hashes, within_rows, word_spans
from plumbline.llm.packets import (LAST, RETURNS, RETURNS_SQL, bucket_of, by_document, identified, later_copies, n_buckets, pack, places, record_batch, returned, runs, unpack,
                                   unplanes)

WINDOW = 13
BLOCK = (WINDOW + 1) // 2

_PROBES = [("bucket", pa.int32()), ("did", pa.binary()), ("counts", pa.binary()), ("place", pa.binary()), ("part", pa.binary())]
_PROBES_SQL = "bucket int, did binary, counts binary, place binary, part binary"
_WINDOWS = [("bucket", pa.int32()), ("did", pa.binary()), ("tk", pa.binary()), ("counts", pa.binary()), ("place", pa.binary()), ("hash", pa.binary())]
_WINDOWS_SQL = "bucket int, did binary, tk binary, counts binary, place binary, hash binary"


def _slabs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = buffer_of(batch.column("text"))
    for first, last in slabs(offsets, SLAB):
        yield first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def find_hits(keys: np.ndarray, did: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of probes with equal keys: which hit a block of another document or are such a block, and which others need.

    A probe hits when an earlier document has the block; a block counts when a later document probes it.
    """
    order = np.argsort(keys, kind="stable")
    first = runs(keys[order])
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
    did, block = did[order], block[order]
    indexed = np.where(block, did, LAST)
    low, high = np.minimum.reduceat(indexed, first)[group], np.maximum.reduceat(did, first)[group]
    hit = (did > low) | (block & (did < high))
    needed = ~hit
    for mark in (block & (did == low), did == high):
        at = np.flatnonzero(mark)
        needed[at[runs(group[at])]] = True
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return hit[back], needed[back]


def _probes(buckets: int):
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            ids = _numbers(batch, "did")
            for first, last, data, offsets in _slabs(batch):
                starts, ends, rows = word_spans(data, offsets)
                at = np.flatnonzero(within_rows(rows, BLOCK))
                if not len(at):
                    continue
                keys = window_hashes(span_hashes(data, starts, ends), BLOCK)[at]
                row = np.searchsorted(rows, at, "right") - 1
                place, own = at - rows[row], ids[first:last]
                hit, needed = find_hits(keys, own[row], place % BLOCK == 0)
                part = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                made = list(pack(bucket_of(keys[needed], buckets), row[needed], place[needed], [own], [part[needed]]))
                turn += 1
                made += [[*p, None] for p in pack(np.full(int(hit.sum()), (first + turn) % buckets), row[hit], place[hit], [own], [])]
                yield record_batch(made, _PROBES)

    return per_batch


def _hits(buckets: int):
    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, list] = {}
        for batch in batches:
            settled = []
            for bucket, did, counts, place, part in zip(*(batch.column(c).to_pylist() for c, _ in _PROBES)):
                (ids,), at = unpack([did], counts, place)
                if part is None:  # decided in its slab
                    settled += returned(ids, None, at, None, buckets)
                else:
                    open_.setdefault(bucket, []).append((ids, at, unplanes(part, np.uint32)))
            yield record_batch(settled, RETURNS)
        for got in open_.values():
            ids, at, part = (np.concatenate(c) for c in zip(*got))
            got.clear()
            hit, _ = find_hits(part, ids, at % BLOCK == 0)
            yield record_batch(returned(ids[hit], None, at[hit], None, buckets), RETURNS)

    return per_partition


def _windows(buckets: int):
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            ids, texts, hits = _numbers(batch, "did"), _numbers(batch, "tk"), batch.column("hits").to_pylist()
            for first, last, data, offsets in _slabs(batch):
                starts, ends, rows = word_spans(data, offsets)
                fits = within_rows(rows, WINDOW)
                near = [rows[k] + places(hits[first + k]) for k in range(last - first)]
                near = np.concatenate([n[n < rows[k + 1]] for k, n in enumerate(near)])
                at = np.flatnonzero(covered(np.maximum(near - (BLOCK - 1), 0), BLOCK, len(starts))[:len(fits)] & fits)
                if not len(at):
                    continue
                keys = window_hashes(span_hashes(data, starts, ends), WINDOW)[at]
                other = window_hashes(span_hashes(data, starts, ends, 1), WINDOW, 1)[at]
                row = np.searchsorted(rows, at, "right") - 1
                own, own_texts = ids[first:last], texts[first:last]
                later = _later(keys, own[row])
                place = at - rows[row]
                made = list(pack(bucket_of(other[~later], buckets), row[~later], place[~later], [own, own_texts], [keys[~later]]))
                turn += 1
                made += [[*p, None] for p in pack(np.full(int(later.sum()), (first + turn) % buckets), row[later], place[later], [own, own_texts], [])]
                yield record_batch(made, _WINDOWS)

    return per_batch


def _later(keys: np.ndarray, did: np.ndarray) -> np.ndarray:
    """Windows that an earlier document has too."""
    order = np.argsort(keys, kind="stable")
    first = runs(keys[order])
    low = np.repeat(np.minimum.reduceat(did[order], first), np.diff(np.append(first, len(keys)))) if len(keys) else did
    out = np.zeros(len(keys), bool)
    out[order] = did[order] > low
    return out


def _repeats(buckets: int):
    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, list] = {}
        for batch in batches:
            settled = []
            for bucket, did, tk, counts, place, keys in zip(*(batch.column(c).to_pylist() for c, _ in _WINDOWS)):
                (ids, texts), at = unpack([did, tk], counts, place)
                if keys is None:
                    settled += returned(ids, texts, at, None, buckets)
                else:
                    open_.setdefault(bucket, []).append((ids, texts, at, unplanes(keys, np.uint64)))
            yield record_batch(settled, RETURNS)
        for got in open_.values():
            ids, texts, at, keys = (np.concatenate(c) for c in zip(*got))
            got.clear()
            later = _later(keys, ids)
            yield record_batch(returned(ids[later], texts[later], at[later], None, buckets), RETURNS)

    return per_partition


_KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _kept(with_text: bool):
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffer_of(batch.column("text"))
            texts = _numbers(batch, "tk")
            rows: list[list] = []
            for k, found in enumerate(batch.column("found").to_pylist()):
                words = data[offsets[k]:offsets[k + 1]].tobytes().split()
                n = len(words)
                own = [f for f in found or [] if f["tk"] == texts[k]]
                if any(f["starts"] is None for f in own) and n >= WINDOW:  # a copy of an earlier text
                    words = []
                elif own:
                    gone = covered(places(own[0]["starts"]), WINDOW, n)
                    words = [words[i] for i in np.flatnonzero(~gone)]
                line = b" ".join(words)
                rows.append([n, n - len(words), hashlib.sha256(line).hexdigest(), *([line.decode()] if with_text else [])])
            columns = list(zip(*rows)) or [[]] * (3 + with_text)
            arrays = [batch.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), *[pa.array(c, pa.string()) for c in columns[2:]]]
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in _KEPT.split(", ")] + ["text"] * with_text)

    return per_batch


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and, on demand, the kept words as `text`."""
    rows, buckets = identified(docs), n_buckets(docs)
    copies = later_copies(rows)
    flagged = copies.select(F.col("did").alias("d"), F.col("tk").alias("t"))
    originals = rows.join(flagged, (F.col("did") == F.col("d")) & (F.col("tk") == F.col("t")), "left_anti")
    probes = originals.select("did", "text").mapInArrow(_probes(buckets), _PROBES_SQL).repartitionById(buckets, "bucket")
    hits = by_document(probes.mapInArrow(_hits(buckets), RETURNS_SQL), buckets).select(F.col("did").alias("d"), F.col("places").alias("hits"))
    # Both joins read the same columns of the documents, so that Spark shuffles these once.
    near = rows.join(hits, F.col("did") == F.col("d")).select("doc_id", "did", "tk", "text", "hits")
    windows = near.mapInArrow(_windows(buckets), _WINDOWS_SQL).repartitionById(buckets, "bucket")
    repeats = by_document(windows.mapInArrow(_repeats(buckets), RETURNS_SQL), buckets).select("did", "tk", F.col("places").alias("starts"))
    repeats = repeats.unionByName(copies.withColumn("starts", F.lit(None).cast("binary")))
    found = repeats.groupBy(F.col("did").alias("d")).agg(F.collect_list(F.struct("tk", "starts")).alias("found"))
    joined = rows.join(found, F.col("did") == F.col("d"), "left").select("doc_id", "did", "tk", "text", "found")
    return joined.mapInArrow(_kept(with_text), _KEPT + ", text string" * with_text)


ORACLE_SQL = f"""with d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
t as (select doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') as k from d, unnest(range(1, len(w) - {WINDOW - 2})) u(i)),
r as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by k) as least from t) where least < doc_id),
c as (select distinct doc_id, i + o as j from r, unnest(range({WINDOW})) v(o)),
words as (select doc_id, u.j, u.word from d, unnest(w) with ordinality u(word, j)),
kept as (select words.doc_id, count(*) filter (where c.j is not null) as n_removed, string_agg(word, ' ' order by words.j) filter (where c.j is null) as line
  from words left join c on words.doc_id = c.doc_id and words.j = c.j group by words.doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(line, '')) as kept_sha256
from d left join kept on d.doc_id = kept.doc_id"""
