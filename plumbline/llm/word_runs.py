"""Runs of repeated words: maximal pairs from the common-prefix interval tree of each text.

A run of period q is a stretch of words in which words q apart are the same, as long as it can be, with q its smallest
period. Let u be such a run without its last q words. If the run has four periods or more, u is at least three periods
long and stands twice, q words apart; the words before the two places differ, and so do the words behind. Such a maximal
pair whose distance is at most a third of its length, with no third occurrence between, is exactly a run, and every
run is met once: nothing has to be extended.

Per slab of texts:

* a place stays only if its window of `LEAST` words comes again so near in its stretch that a run could hold both; the places
  that stay fall into shorter stretches and are tested again, which leaves little but the runs themselves;
* the suffixes of all stretches are sorted by prefix doubling, and the common prefixes of neighbours are read from its ranks;
* a stack scan builds the interval tree from the deepest intervals up. An interval keeps its places in lists by left
  word, and the smaller of two intervals is merged into the larger; only lists of different left words are compared.

Defined results: a null text has no words; an empty table gives an empty result; repeated rows are treated one by
one; a null document id is carried along and overwrites nothing; other columns play no part. Words are compared by 64-bit
hashes inside one text.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bytes import buffer_of, slabs, span_hashes, spread, window_hashes, within_rows, word_spans
from plumbline.llm.packets import record_batch

PERIODS = 4
SHORTEST = 6
LEAST = 5
NARROWINGS = 6
_FIELDS = [("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()),
           ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("n_words", pa.int64()), ("n_dropped", pa.int64())]
_SQL = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long"


def stretches(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of windows that a run may hold, and the stretch of each: windows of a stretch are neighbours in one row."""
    keys = window_hashes(hashes, LEAST)
    at = np.flatnonzero(within_rows(rows, LEAST))
    owner = np.repeat(np.arange(len(rows) - 1), np.diff(rows))[at]
    for _ in range(NARROWINGS):
        if not len(at):
            break
        size = np.bincount(owner)[owner] + LEAST - 1
        mixed = spread(keys[at] + spread(owner.astype(np.uint64)))
        order = np.argsort(mixed, kind="stable")
        near = (mixed[order[1:]] == mixed[order[:-1]]) & (PERIODS * (at[order[1:]] - at[order[:-1]]) <= size[order[1:]])
        live = np.zeros(len(at), bool)
        live[order[1:]] = near
        live[order[:-1]] |= near
        done = live.all()
        at = at[live]
        owner = np.cumsum(np.diff(at, prepend=-2) != 1) - 1
        if done:
            break
    return at, owner


def suffix_order(words: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and how many words neighbours share. `until` is the end of the stretch of each place; words of
    different stretches differ."""
    n = len(words)
    here = np.arange(n)
    ranks = [np.unique(words, return_inverse=True)[1].astype(np.int64)]
    longest = int((until - here).max(initial=0))
    width = 1
    while width < longest and int(ranks[-1].max()) < n - 1:
        rank = ranks[-1]
        ahead = here + width
        pair = rank * (n + 1) + np.where(ahead < until, rank[np.minimum(ahead, n - 1)] + 1, 0)
        ranks.append(np.unique(pair, return_inverse=True)[1].astype(np.int64))
        width *= 2
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    end_a, end_b = until[a], until[b]
    for k in range(len(ranks) - 1, -1, -1):
        reach = 1 << k
        # Equal ranks of two places in one stretch mean `reach` equal words, as their stretches end at different distances.
        same = (a + reach <= end_a) & (b + reach <= end_b)
        same[same] = ranks[k][a[same]] == ranks[k][b[same]]
        a, b = a + reach * same, b + reach * same
    return order, a - order[:-1]


def _merge(one: dict[int, list[int]], other: dict[int, list[int]], depth: int, out: list[tuple[int, int]]) -> dict[int, list[int]]:
    """Unite two intervals under one of `depth`; maximal pairs (first place, distance) that make a run go to `out`."""
    if sum(map(len, one.values())) < sum(map(len, other.values())):
        one, other = other, one
    farthest = depth // (PERIODS - 1)
    if len(one) > 1 or one.keys() != other.keys():
        for left, places in other.items():
            for word, held in one.items():
                if word == left:
                    continue
                for p in places:
                    k = bisect_left(held, p)
                    for q in held[max(0, k - 1):k + 1]:
                        first, last = (p, q) if p < q else (q, p)
                        gap = last - first
                        if gap <= farthest and gap + depth >= SHORTEST and not (_between(one, first, last) or _between(other, first, last)):
                            out.append((first, gap))
    for left, places in other.items():
        held = one.setdefault(left, places)
        if held is not places:
            for p in places:
                insort(held, p)
    return one


def _between(lists: dict[int, list[int]], first: int, last: int) -> bool:
    for held in lists.values():
        k = bisect_left(held, first + 1)
        if k < len(held) and held[k] < last:
            return True
    return False


def maximal_pairs(order: list[int], shared: list[int], left: list[int]) -> list[tuple[int, int, int]]:
    """(place, distance, depth) of the maximal pairs that are runs, by a stack scan over intervals at least `LEAST` deep."""
    found = []
    stack: list[tuple[dict[int, list[int]], int]] = []
    for p, depth in zip(order, [*shared, 0]):
        if depth < LEAST and not stack:
            continue
        own = {left[p]: [p]}
        while stack and stack[-1][1] >= depth:
            before, deep = stack.pop()
            pairs: list[tuple[int, int]] = []
            own = _merge(before, own, deep, pairs)
            found += [(first, gap, deep) for first, gap in pairs]
        if depth >= LEAST:
            stack.append((own, depth))
    return found


def runs_of(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start in the row, length and period of every run, by row, start and period."""
    at, owner = stretches(hashes, rows)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    sizes = np.diff(np.append(first, len(at))) + LEAST - 1
    ends = np.cumsum(sizes)
    words_at = np.repeat(at[first] - (ends - sizes), sizes) + np.arange(ends[-1])
    stretch = np.repeat(np.arange(len(first)), sizes)
    own = hashes[words_at]
    order, shared = suffix_order(spread(own + spread(stretch.astype(np.uint64))), ends[stretch])
    _, kinds = np.unique(own, return_inverse=True)
    left = np.where(np.append(True, stretch[1:] != stretch[:-1]), -1, np.append(0, kinds[:-1]))
    pairs = np.array(maximal_pairs(order.tolist(), shared.tolist(), left.tolist()), np.int64).reshape(-1, 3)
    begin = words_at[pairs[:, 0]]
    row = np.searchsorted(rows, begin, "right") - 1
    start, period, length = begin - rows[row], pairs[:, 1], pairs[:, 1] + pairs[:, 2]
    by = np.lexsort((period, start, row))
    return row[by], start[by], length[by], period[by]


def overwritten(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each place of a text that is overwritten by a repeating stretch; None if it is not."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def _described(text: bytes, starts: np.ndarray, ends: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> list:
    """Digest columns of one text; the arrays are its words (after any overwriting) and its runs."""
    n = len(starts)
    if len(start):
        step = np.zeros(n + 1, np.int64)
        np.add.at(step, start + period, 1)
        np.add.at(step, start + length, -1)
        kept = np.flatnonzero(np.cumsum(step[:n]) == 0)
        best = np.lexsort((period, start, -length))[0]
        s, size, q = int(start[best]), int(length[best]), int(period[best])
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in zip(start.tolist(), length.tolist(), period.tolist()))
        top = [s, size, q, 1000 * size // q]
    else:
        kept, lines, top = np.arange(n), "", [None] * 4
    words = b" ".join([text[a:b] for a, b in zip(starts[kept].tolist(), ends[kept].tolist())])
    return [len(start), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(words).hexdigest(), n, n - len(kept)]


def find(docs: DataFrame, overwrite: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """One row per document: its number of runs, the longest one, and digests of all runs and of the text without repeats.

    `overwrite` may name the word that stands at each place instead of the own one.
    """

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffer_of(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for low, high in slabs(offsets):
                cut = offsets[low:high + 1]
                own = data[cut[0]:cut[-1]]
                starts, ends, rows = word_spans(own, cut - cut[0])
                hashes = span_hashes(own, starts, ends)
                if overwrite:
                    at = np.arange(len(starts))
                    for k in range(high - low):
                        now = overwrite(ids[low + k], int(rows[k + 1] - rows[k]))
                        if now is not None:
                            at[rows[k]:rows[k + 1]] = rows[k] + now
                    starts, ends, hashes = starts[at], ends[at], hashes[at]
                row, start, length, period = runs_of(hashes, rows)
                cuts, text, out = np.searchsorted(row, np.arange(high - low + 1)), own.tobytes(), []
                for k in range(high - low):
                    w, r = slice(rows[k], rows[k + 1]), slice(cuts[k], cuts[k + 1])
                    out.append([ids[low + k], *_described(text, starts[w], ends[w], start[r], length[r], period[r])])
                yield record_batch(out, _FIELDS)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(per_batch, _SQL)


def report(docs: DataFrame) -> DataFrame:
    return find(docs, overwritten)
