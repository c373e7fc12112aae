"""Language-model scores from sharded Elias-Fano bigram tries.

The corpus is counted whole. Every token travels once, packed with its context (the word before it, or a start mark), to the
shard of its context. A shard gathers the bigrams of its contexts from the training documents into a trie:

* level one holds the contexts, as an Elias-Fano sequence of hashes with the quantised back-off weight of each;
* monotone pointers, again Elias-Fano, give the range of children of each context;
* level two holds the next words; a child is stored as context number * 2^40 + word, which ascends over the whole level,
  with its quantised smoothed probability.

A shard is cut into sub-shards by further bits of the context's hash, each a task of its own, as many as its share of the training
tokens asks for (PER_TASK each), so a task holds the packets and the trie of a bounded share, and small shards are not cut into crumbs that
each send a packet to every bucket. All levels lie in anonymous memory maps of the task. A token is scored by the successor search for its context, then for itself within the
context's range. Probabilities are discounted: (count - DISCOUNT) / context count for known pairs; otherwise the context's
back-off weight DISCOUNT * kinds / context count times the probability of the word alone, (count + 0.1) / (all + 0.1 * (kinds + 1)),
which is looked up in the word's own shard of the unigram level. Logarithms are kept in steps of 1 / STEP.

Words that make up more than a quarter of a shard's share are few (fewer than 4 per shard, by that very bound) and
known to all tasks; as contexts they are parted by the next word. Their distinct next words are counted over all parts beforehand,
so that every part, also one without a training pair, has the same back-off weight. Within a slab equal pairs travel once with the list of their documents. Scores are summed per document, never gathered.

Defined results: a null text has only the end token; the text of a null id is the empty string for the hold-out rule;
rows that share a document id and the text are repeats with one score each, those that share the id alone (null ids too) are scored
by their own texts; empty tables give empty results; the other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bytes import LOWER, buffer_of, slabs, span_hashes, word_spans
from plumbline.llm.elias_fano import EliasFano, mapped
from plumbline.llm.packets import LAST, bucket_of, n_buckets, planes, record_batch, runs, unplanes
from plumbline.llm.storage import stored

DISCOUNT = 0.75
STEP = 16
ADDED = 0.1
TEXTS = 4 << 20
PER_TASK = 1 << 19  # training tokens whose contexts one task scores; words and sums keep one bucket per shard
WAITING = 1 << 20  # tokens that are scored at once, and tokens without a known pair that a task holds before it sends them on
FIXED = 1 << 32  # unit of the base score's sums
U = np.uint64
START, END = U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)
WORD = U(24)  # a word below a context is known by the upper 40 bits of its hash


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None or doc_id == LAST else str(doc_id).encode()) % 10 == 0


def quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(p) * STEP), 0, 255).astype(np.uint8)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slab: ids, hold-out marks, word hashes, and row offsets into them."""
    ids = batch.column("did").to_numpy(zero_copy_only=False)
    data, offsets = buffer_of(batch.column("text"))
    # Where rows go by a number of their text, `whose` holds the document id that decides the hold-out.
    whose = batch.column("whose").to_numpy(zero_copy_only=False) if "whose" in batch.schema.names else ids
    for first, last in slabs(offsets, TEXTS):
        hashes, rows = [], [np.zeros(1, np.int64)]
        for a, b in slabs(offsets[first:last + 1]):
            own = LOWER[data[offsets[first + a]:offsets[first + b]]]
            starts, ends, cuts = word_spans(own, offsets[first + a:first + b + 1] - offsets[first + a])
            hashes.append(span_hashes(own, starts, ends))
            rows.append(cuts[1:] + rows[-1][-1])
        yield ids[first:last], np.array([held_out(i) for i in whose[first:last].tolist()], bool), np.concatenate(hashes), np.concatenate(rows)


_WORDS = [("bucket", pa.int32()), ("hash", pa.binary()), ("count", pa.binary()), ("tokens", pa.int64()), ("kinds", pa.int64())]
_WORDS_SQL = "bucket int, hash binary, count binary, tokens long, kinds long"


def _rising(values: np.ndarray) -> bytes:
    steps = values.copy()
    steps[1:] -= values[:-1]
    return planes(steps)


def _risen(raw: bytes, dtype: type = U) -> np.ndarray:
    return np.cumsum(unplanes(raw, dtype), dtype=dtype)


def _count_words(buckets: int):
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, held, hashes, rows in _texts(batch):
                words, count = np.unique(hashes[np.repeat(~held, np.diff(rows))], return_counts=True)
                words, count = np.append(words, END), np.append(count, (~held).sum())
                order = np.argsort(words)
                words, count = words[order][count[order] > 0], count[order][count[order] > 0]
                bucket = bucket_of(words, buckets)
                cuts = runs(bucket)
                made = [[int(bucket[a]), _rising(w), planes(c.astype(np.uint32)), 0, 0] for a, w, c in zip(cuts, np.split(words, cuts[1:]), np.split(count, cuts[1:]))] if len(cuts) else []
                yield record_batch(made, _WORDS)

    return per_batch


def _summed(keys: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, count
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = runs(keys)
    return keys[first], np.add.reduceat(count[order], first)


def _merge_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got: dict[int, list] = {}
    for batch in batches:
        for bucket, words, count in zip(*(batch.column(c).to_pylist() for c in ("bucket", "hash", "count"))):
            got.setdefault(bucket, []).append((_risen(words), unplanes(count, np.uint32).astype(np.int64)))
    for bucket, parts in got.items():
        words, count = _summed(*(np.concatenate(c) for c in zip(*parts)))
        yield record_batch([[bucket, _rising(words), planes(count), int(count.sum()), len(words)]], _WORDS)


@dataclass
class Totals:
    """What all tasks know: sums over the training tokens and the words that are parted as contexts."""

    tokens: int
    kinds: int
    ends: int
    often: dict[int, int] = field(default_factory=dict)  # context hash -> its training count
    followers: dict[int, int] = field(default_factory=dict)  # context hash -> its distinct next words in training, over all parts
    limit: int = 1

    @property
    def whole(self) -> float:
        return self.tokens + ADDED * (self.kinds + 1)

    def subshards(self, buckets: int) -> int:
        """Tasks per shard of contexts."""
        return max(1, -(-self.tokens // (buckets * PER_TASK)))

    def parted(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes of the often contexts and their numbers of parts."""
        words = np.array(sorted(self.often), U)
        return words, np.array([-(-self.often[int(w)] // self.limit) for w in words], U)

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted hashes of all parts, with the training count and the distinct next words of the context, and whether it is the start."""
        words, n = self.parted()
        which = np.repeat(np.arange(len(words)), n.astype(np.int64))
        number = np.arange(len(which)) - np.repeat(np.cumsum(n.astype(np.int64)) - n.astype(np.int64), n.astype(np.int64))
        keys = part_of(words[which], number.astype(U))
        order = np.argsort(keys)
        count = np.array([self.often[int(w)] for w in words], np.int64)
        followers = np.array([self.followers.get(int(w), 0) for w in words], np.int64)
        return keys[order], count[which][order], followers[which][order], (words[which] == START)[order]


def part_of(context: np.ndarray, number: np.ndarray) -> np.ndarray:
    x = (context ^ (number + U(1)) * U(0x9E3779B97F4A7C15)) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(31))


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


_PAIRS = [("bucket", pa.int32()), ("part", pa.int32()), ("context", pa.binary()), ("children", pa.binary()), ("word", pa.binary()), ("uses", pa.binary()),
          ("row", pa.binary()), ("did", pa.binary()), ("held", pa.binary())]
_PAIRS_SQL = "bucket int, part int, context binary, children binary, word binary, uses binary, row binary, did binary, held binary"


def _pairs(buckets: int, totals: Totals):
    often, n_parts = totals.parted()
    cut = totals.subshards(buckets)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, held, hashes, rows in _texts(batch):
                context, word = np.insert(hashes, rows[:-1], START), np.insert(hashes, rows[1:], END)
                row = np.repeat(np.arange(len(ids)), np.diff(rows) + 1)
                at, hot = _find(often, context)
                context[hot] = part_of(context[hot], word[hot] % n_parts[at[hot]])
                kinds, number = np.unique(context, return_inverse=True)
                key = (number.astype(U) << U(40)) | (word >> WORD)
                order = np.argsort(key, kind="stable")
                key, row = key[order], row[order]
                pair = runs(key)
                uses, owner = np.diff(np.append(pair, len(key))), (key[pair] >> U(40)).astype(np.int64)
                bucket = bucket_of(kinds, buckets * cut)
                # Where the contexts, pairs, tokens and documents of each packet begin, the end last; contexts and pairs ascend with the bucket.
                contexts = np.append(runs(bucket), len(kinds))
                pairs = np.searchsorted(owner, contexts)
                tokens = np.append(pair, len(key))[pairs]
                packet = np.repeat(np.arange(len(contexts) - 1), np.diff(tokens))
                docs, local = np.unique(packet * len(ids) + row, return_inverse=True)
                documents = np.searchsorted(docs, np.arange(len(contexts)) * len(ids))
                docs, local = docs % len(ids), (local - documents[packet]).astype(np.uint32)
                low, uses, children = key[pair] & U((1 << 40) - 1), uses.astype(np.uint32), np.bincount(owner).astype(np.uint32)
                made = []
                for (c, d), (a, b), (e, f), (g, h) in zip(*map(pairwise, (contexts, pairs, tokens, documents))):
                    made.append([int(bucket[c]) // cut, int(bucket[c]), _rising(kinds[c:d]), planes(children[c:d]), planes(low[a:b])[:5 * (b - a)], planes(uses[a:b]), planes(local[e:f]),
                                 _rising(ids[docs[g:h]]), held[docs[g:h]].tobytes()])
                yield record_batch(made, _PAIRS)

    return per_batch


_NEXT = [("bucket", pa.int32()), ("pairs", pa.binary())]


def _next_words(buckets: int, totals: Totals):
    """Distinct training pairs of the often contexts, as place of the context * 2^40 + word, by bucket of the part."""
    often, n_parts = totals.parted()

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, held, hashes, rows in _texts(batch):
                context, word = np.insert(hashes, rows[:-1], START), np.insert(hashes, rows[1:], END)
                at, hot = _find(often, context)
                hot &= np.repeat(~held, np.diff(rows) + 1)
                at, word = at[hot], word[hot]
                del context, hashes, hot
                pair, first = np.unique((at.astype(U) << U(40)) | (word >> WORD), return_index=True)
                bucket = bucket_of(part_of(often[at[first]], word[first] % n_parts[at[first]]), buckets)
                order = np.argsort(bucket, kind="stable")
                pair, bucket = pair[order], bucket[order]
                cuts = np.append(runs(bucket), len(pair))
                yield record_batch([[int(bucket[a]), _rising(pair[a:b])] for a, b in zip(cuts[:-1], cuts[1:])], _NEXT)

    return per_batch


def _union(parts: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(parts))


def _count_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got: dict[int, list[np.ndarray]] = {}  # the first array of a bucket has no repeats; what follows is united with it when it has grown as large
    for batch in batches:
        for bucket, pairs in zip(batch.column("bucket").to_pylist(), batch.column("pairs").to_pylist()):
            parts = got.setdefault(bucket, [np.zeros(0, U)])
            parts.append(_risen(pairs))
            if sum(len(p) for p in parts[1:]) > max(WAITING, len(parts[0])):
                parts[:] = [_union(parts)]
    for parts in got.values():
        pair = _union(parts)
        place, kinds = np.unique(pair >> U(40), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int64)), pa.array(kinds.astype(np.int64))], ["place", "kinds"])


@dataclass
class Packet:
    context: np.ndarray
    owner: np.ndarray  # context of every pair
    word: np.ndarray
    uses: np.ndarray
    row: np.ndarray
    did: np.ndarray
    held: np.ndarray


def _packet(context: bytes, children: bytes, word: bytes, uses: bytes, row: bytes, did: bytes, held: bytes) -> Packet:
    n = unplanes(children, np.uint32)
    words = unplanes(word + bytes(3 * (len(word) // 5)), U)
    return Packet(_risen(context), np.repeat(np.arange(len(n)), n), words, unplanes(uses, np.uint32).astype(np.int64), unplanes(row, np.uint32).astype(np.int64),
                  _risen(did, np.int64), np.frombuffer(held, bool))


def _packet_of(batch: pa.RecordBatch, k: int) -> Packet:
    return _packet(*(batch.column(c)[k].as_py() for c, _ in _PAIRS[2:]))


def _joined(packets: list[Packet]) -> Packet:
    """Packets as one, their contexts and documents numbered through."""
    contexts = np.cumsum([0, *(len(p.context) for p in packets)])
    documents = np.cumsum([0, *(len(p.did) for p in packets)])
    columns = zip(*((p.context, p.owner + a, p.word, p.uses, p.row + b, p.did, p.held) for p, a, b in zip(packets, contexts, documents)))
    return Packet(*(np.concatenate(c) for c in columns))


def _groups(places: list[tuple[pa.RecordBatch, int]]) -> Iterator[Packet]:
    """The packets of a part, joined until they hold more than WAITING tokens: the more shards, the smaller is a packet."""
    held, tokens = [], 0
    for batch, k in places:
        held.append(_packet_of(batch, k))
        tokens += len(held[-1].row)
        if tokens > WAITING:
            yield _joined(held)
            held, tokens = [], 0
    if held:
        yield _joined(held)


def _back_off(following: np.ndarray, held: np.ndarray) -> np.ndarray:
    return quantised(np.minimum(1.0, DISCOUNT * following / np.maximum(held, 1)))


class Trie:
    """One shard: contexts, pointers and children, with quantised logarithms."""

    def __init__(self, columns: list[np.ndarray], totals: Totals):
        """Contexts, words and counts, one entry per pair and packet; the list is emptied, so that its arrays can go early."""
        kinds, number = np.unique(columns.pop(0), return_inverse=True)
        number = number.astype(U)
        number <<= U(40)
        number |= columns.pop(0)
        keys, count = _summed(number, columns.pop())
        del number
        owner = (keys >> U(40)).astype(np.int64)
        begin = np.searchsorted(owner, np.arange(len(kinds) + 1))
        held = np.add.reduceat(count, begin[:-1]) if len(kinds) else np.zeros(0, np.int64)
        parts, whole, followers, start = totals.parts()
        at, hot = _find(parts, kinds)
        following = np.diff(begin)
        held[hot], following[hot] = whole[at[hot]], followers[at[hot]]
        (self.held, self.seen, self.back) = mapped([held, quantised((count - DISCOUNT) / held[owner]), _back_off(following, held)])
        self.contexts = EliasFano(kinds, (1 << 64) - 1)
        self.pointers = EliasFano(begin.astype(U), int(begin[-1]))
        self.children = EliasFano(keys, int(keys[-1]) if len(keys) else 0)
        self.parts, self.whole, self.start, self.part_back = parts, whole, start, _back_off(followers, whole)

    def context_counts(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Place of each context, whether it is known, its training count, and whether it is the start mark."""
        n = self.contexts.n
        at, known = self.contexts.successor(context, np.zeros(len(context), np.int64), np.full(len(context), n))
        at = np.minimum(at, max(0, n - 1))
        count = np.where(known, self.held[at], 0) if n else np.zeros(len(context), np.int64)
        part, hot = _find(self.parts, context)
        if hot.any():
            count = np.where(hot, self.whole[part], count)
        start = (context == START) | (hot & self.start[part] if len(self.parts) else False)
        return at, known, count, start

    def scores(self, context: np.ndarray, at: np.ndarray, known: np.ndarray, owner: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Quantised logarithm of every pair, without the word's own where the pair is not known; and whether it is."""
        part, hot = _find(self.parts, context)
        back = np.zeros(len(context), np.int64)
        back[hot] = self.part_back[part[hot]]
        if not self.contexts.n:
            return back[owner], np.zeros(len(owner), bool)
        first, last = self.pointers.get(at).astype(np.int64), self.pointers.get(at + 1).astype(np.int64)
        first, last = np.where(known, first, 0), np.where(known, last, 0)
        child, seen = self.children.successor((at[owner].astype(U) << U(40)) | word, first[owner], last[owner])
        alone = np.where(known, self.back[at], back)[owner]
        return np.where(seen, self.seen[np.minimum(child, len(self.seen) - 1)], alone).astype(np.int64), seen


#: Sums of one document: quantised logarithms, base score, known tokens, tokens, ends.
_N_SUMS = 5
_SUMS = [("bucket", pa.int32()), ("kind", pa.int32()), ("did", pa.binary()), ("word", pa.binary()), ("sums", pa.binary())]
_SUMS_SQL = "bucket int, kind int, did binary, word binary, sums binary"


def _by_id(did: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(did, kind="stable")
    first = runs(did[order])
    return did[order][first], (np.add.reduceat(sums[order], first, axis=0) if len(did) else sums)


def _sum_rows(did: np.ndarray, sums: np.ndarray, buckets: int) -> list[list]:
    """Sums per document, packed by the document's bucket."""
    did, sums = _by_id(did, sums)
    bucket = bucket_of(part_of(did.view(U), U(7) + np.zeros(len(did), U)), buckets)
    order = np.argsort(bucket, kind="stable")
    did, sums, bucket = did[order], sums[order], bucket[order]
    cuts = np.append(runs(bucket), len(did))
    return [[int(bucket[a]), 1, _rising(did[a:b]), None, b"".join(planes(sums[a:b, k]) for k in range(_N_SUMS))] for a, b in zip(cuts[:-1], cuts[1:])]


def _sums_of(raw: bytes) -> np.ndarray:
    size = len(raw) // _N_SUMS
    return np.stack([unplanes(raw[k * size:(k + 1) * size], np.int64) for k in range(_N_SUMS)], axis=1)


def _score(buckets: int, totals: Totals):
    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list] = {}
        for batch in batches:
            # Packets stay where they are until their part is read, then they are unpacked once.
            for k, part in enumerate(batch.column("part").to_pylist()):
                got.setdefault(part, []).append((batch, k))
            batch = None
        for part in sorted(got):
            groups, columns = list(_groups(got.pop(part))), [[], [], []]
            for p in groups:
                count = np.add.reduceat((~p.held[p.row]).astype(np.int64), np.cumsum(p.uses) - p.uses)
                own = count > 0
                for column, piece in zip(columns, (p.context[p.owner[own]], p.word[own], count[own])):
                    column.append(piece)
            del p, own, count, piece, column
            for k in range(3):
                columns[k] = np.concatenate(columns[k])
            trie = Trie(columns, totals)
            did, sums, alone, waiting = [], [], [], 0
            for p in groups:
                at, known, count, start = trie.context_counts(p.context)
                codes, seen = trie.scores(p.context, at, known, p.owner, p.word)
                base = np.where(start, 0, np.rint(np.log10(count + ADDED) * FIXED)).astype(np.int64)
                own = np.repeat(np.arange(len(p.owner)), p.uses)
                facts = np.stack([codes, base[p.owner], ((count > 0) & ~start)[p.owner].astype(np.int64), np.ones(len(p.owner), np.int64), (p.word == END >> WORD).astype(np.int64)], axis=1)[own]
                order = np.argsort(p.row, kind="stable")
                did.append(p.did)
                sums.append(np.add.reduceat(facts[order], runs(p.row[order]), axis=0))
                unseen = np.flatnonzero(~seen[own])
                alone.append((p.word[own[unseen]], p.did[p.row[unseen]]))
                waiting += len(unseen)
                if waiting > WAITING:
                    yield record_batch(_alone(alone, buckets), _SUMS)
                    alone, waiting = [], 0
            yield record_batch(_alone(alone, buckets), _SUMS)
            yield record_batch(_sum_rows(np.concatenate(did), np.concatenate(sums), buckets), _SUMS)

    return per_partition


def _alone(tokens: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> list[list]:
    """Tokens (word and document) that need their word's own probability, packed by the word's bucket."""
    word, did = (np.concatenate(c) for c in zip(*tokens)) if tokens else (np.zeros(0, U), np.zeros(0, np.int64))
    order = np.lexsort((did, bucket_of(word << WORD, buckets)))
    word, did = word[order], did[order]
    bucket = bucket_of(word << WORD, buckets)
    cuts = np.append(runs(bucket), len(word))
    return [[int(bucket[a]), 2, _rising(did[a:b]), planes(word[a:b])[:5 * (b - a)], None] for a, b in zip(cuts[:-1], cuts[1:])]


def _together(waiting: list[tuple[bytes, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Documents and words of waiting tokens, about WAITING at a time."""
    held, tokens = [], 0
    for k, (ids, raw) in enumerate(waiting):
        held.append((_risen(ids, np.int64), unplanes(raw + bytes(3 * (len(raw) // 5)), U)))
        tokens += len(held[-1][0])
        if tokens > WAITING or k == len(waiting) - 1:
            yield tuple(np.concatenate(c) for c in zip(*held))
            held, tokens = [], 0


def _unigram_level(buckets: int, totals: Totals):
    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        did, sums, waiting, level = [], [], [], []
        for batch in batches:
            for _, kind, ids, word, raw in zip(*(batch.column(c).to_pylist() for c, _ in _SUMS)):
                if kind == 1:
                    did.append(_risen(ids, np.int64)), sums.append(_sums_of(raw))
                elif kind == 2:
                    waiting.append((ids, word))
                else:
                    level.append((_risen(word) >> WORD, unplanes(raw, np.int64)))
        words, count = _summed(*(np.concatenate(c) for c in zip(*level))) if level else (np.zeros(0, U), np.zeros(0, np.int64))
        index = EliasFano(words, 1 << 40)
        (codes,) = mapped([quantised((count + ADDED) / totals.whole)])
        unknown = int(quantised(np.array([ADDED / totals.whole]))[0])
        for ids, word in _together(waiting):
            at, known = index.successor(word, np.zeros(len(word), np.int64), np.full(len(word), len(words)))
            own = np.full(len(word), unknown, np.int64)
            own[known] = codes[at[known]]
            part = np.zeros((len(word), _N_SUMS), np.int64)
            part[:, 0] = own
            ids, part = _by_id(ids, part)
            did.append(ids), sums.append(part)
        if did:
            yield record_batch(_sum_rows(np.concatenate(did), np.concatenate(sums), buckets), _SUMS)

    return per_partition


_SCORES = "did long, copies long, codes long, base long, known long, tokens long"


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    did, sums = [], []
    for batch in batches:
        for ids, raw in zip(batch.column("did").to_pylist(), batch.column("sums").to_pylist()):
            did.append(_risen(ids, np.int64)), sums.append(_sums_of(raw))
    if did:
        ids, total = _by_id(np.concatenate(did), np.concatenate(sums))
        yield pa.RecordBatch.from_arrays([pa.array(ids), *[pa.array(np.ascontiguousarray(total[:, k])) for k in (4, 0, 1, 2, 3)]], [c.split()[0] for c in _SCORES.split(", ")])


def _totals(words: DataFrame, buckets: int) -> Totals:
    tokens, kinds = words.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    limit = max(1, tokens // (4 * buckets))

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, counts in zip(batch.column("hash").to_pylist(), batch.column("count").to_pylist()):
                word, count = _risen(raw), unplanes(counts, np.int64)
                keep = (count > limit) | (word == END)
                yield pa.RecordBatch.from_arrays([pa.array(word[keep].view(np.int64)), pa.array(count[keep])], ["word", "count"])

    found = {int(np.int64(w).view(U)): c for w, c in words.select("hash", "count").mapInArrow(often, "word long, count long").collect()}
    ends = found.pop(int(END), 0)
    if ends > limit:
        found[int(START)] = ends
    return Totals(tokens, kinds, ends, often=found, limit=limit)


def _with_followers(rows: DataFrame, totals: Totals, buckets: int) -> Totals:
    """The totals with the distinct next words of each often context; a bounded number of rows reaches the driver."""
    if not totals.often:
        return totals
    counted = rows.mapInArrow(_next_words(buckets, totals), "bucket int, pairs binary").repartitionById(buckets, "bucket").mapInArrow(_count_next, "place long, kinds long")
    words, _ = totals.parted()
    return replace(totals, followers={int(words[place]): kinds for place, kinds in counted.groupBy("place").agg(F.sum("kinds")).collect()})


def _by_text(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose id stands for more than one text get a number of id and text in its place; and which id each number is.

    Other rows keep their ids, which ascend and so travel in fewer bytes.
    """
    text = F.xxhash64("text")
    several = stored(rows.select("did", text.alias("tk")).groupBy(F.col("did").alias("of")).agg(F.min("tk").alias("a"), F.max("tk").alias("b")).where("a < b").select("of"), "several")
    if several.isEmpty():
        return rows, None
    number = F.when(F.col("of").isNull(), F.col("did")).otherwise(F.xxhash64("did", "text"))
    marked = rows.join(several, F.col("did") == F.col("of"), "left").select(number.alias("did"), F.col("did").alias("whose"), "text", F.col("of").isNotNull().alias("numbered"))
    return marked.drop("numbered"), stored(marked.where("numbered").select(F.col("did").alias("number"), "whose").distinct(), "numbers")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    buckets = n_buckets(docs)
    key = F.col("doc_id").cast("long")
    rows, numbers = _by_text(docs.select(F.coalesce(key, F.lit(LAST)).alias("did"), F.coalesce("text", F.lit("")).alias("text")))
    words = stored(rows.mapInArrow(_count_words(buckets), _WORDS_SQL).repartitionById(buckets, "bucket").mapInArrow(_merge_words, _WORDS_SQL), "unigrams")
    totals = _with_followers(rows, _totals(words, buckets), buckets)
    scored = rows.mapInArrow(_pairs(buckets, totals), _PAIRS_SQL).repartitionById(buckets * totals.subshards(buckets), "part").mapInArrow(_score(buckets, totals), _SUMS_SQL)
    level = words.select("bucket", F.lit(3).alias("kind"), F.lit(None).cast("binary").alias("did"), F.col("hash").alias("word"), F.col("count").alias("sums"))
    sums = scored.unionByName(level).repartitionById(buckets, "bucket").mapInArrow(_unigram_level(buckets, totals), _SUMS_SQL)
    final = sums.repartitionById(buckets, "bucket").mapInArrow(_finish, _SCORES)
    if numbers is not None:
        final = final.join(numbers, F.col("did") == F.col("number"), "left").withColumn("did", F.coalesce("whose", "did"))
    doc_id = F.when(F.col("did") != LAST, F.col("did"))
    n_tokens = (F.col("tokens") / F.col("copies")).cast("long")
    base = F.col("base") / F.lit(float(FIXED)) / F.col("copies") + F.lit(float(np.log10(totals.ends + ADDED))) - n_tokens * F.lit(float(np.log10(totals.whole)))
    return final.select(
        doc_id.alias("doc_id"), (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 10 == 0).alias("held_out"), n_tokens.alias("n_tokens"),
        ((F.col("known") / F.col("copies")).cast("long") + F.lit(int(totals.ends > 0))).alias("n_known"), F.lit(totals.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"), (-F.col("codes") / F.lit(float(STEP)) / F.col("copies")).alias("score"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")
