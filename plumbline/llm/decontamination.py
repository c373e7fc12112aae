"""Benchmark decontamination with an FM-index per training shard.

A shard is a few megabytes of documents. Its words are coded by the benchmark's own vocabulary; a stretch of words
outside it cannot hold a test phrase and is left out, so the index holds only stretches that could. Over these runs,
each ended by a separator, the shard gets a suffix array, its Burrows-Wheeler transform in a wavelet tree with rank
counts, and sampled suffix positions. All test phrases are searched backwards at once; the surviving ranges are
located by walking to sampled positions, and the hit spans of a document are merged.

A phrase is `WINDOW` consecutive words of an item, or a whole item of fewer words. Items come to the executors as a
broadcast of at most `BLOCK_BYTES` of phrases; larger benchmarks are taken in several blocks of items, each searched
over all documents, and the blocks' spans are merged per document.

Defined results: a null text has no words; an item without words is never found; a null item id counts as the string
"null"; repeated rows are searched one by one with one block and share their merged spans, cut to their own words,
with several; empty tables give no hits; the other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bytes import LOWER, buffer_of, slabs, word_spans
from plumbline.llm.storage import stored

WINDOW = 10
BLOCK_BYTES = 16 << 20
SHARD = 4 << 20
SAMPLE = 16
#: Bytes that are not part of a word after lower-casing: all of ASCII but digits and letters.
NOT_WORD = np.array([b < 0x80 and not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A) for b in range(256)])
_TO_WORDS = bytes(32 if NOT_WORD[b] else b for b in LOWER.tolist())


def words_of(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(_TO_WORDS).split()


@dataclass
class Phrases:
    """Distinct phrases of one block of items, as word codes from 1."""

    codes: dict[bytes, int]
    texts: list[np.ndarray]
    owners: list[list[str]]

    @property
    def shortest(self) -> int:
        return min((len(p) for p in self.texts), default=1)


def phrases_of(items: list[tuple[object, str]], window: int = WINDOW) -> Phrases:
    codes: dict[bytes, int] = {}
    owners: dict[tuple[int, ...], set[str]] = {}
    for item, text in items:
        coded = [codes.setdefault(w, len(codes) + 1) for w in words_of(text)]
        if coded:
            size = min(window, len(coded))
            for i in range(len(coded) - size + 1):
                owners.setdefault(tuple(coded[i:i + size]), set()).add("null" if item is None else str(item))
    return Phrases(codes, [np.array(p, np.int64) for p in owners], [sorted(o) for o in owners.values()])


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by doubling: ranks of prefixes of 1, 2, 4, ... symbols until all differ."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[:max(0, n - width)] = rank[width:] + 1
        both = rank * (n + 2) + ahead
        order = np.argsort(both, kind="stable")
        new = np.zeros(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(both[order]) != 0)])
        rank, width = new, width * 2
        if not n or rank[order[-1]] == n - 1:
            return order


class WaveletTree:
    """Symbol ranks by the bits of the symbols, most significant first, each level stably parted by its bit."""

    def __init__(self, symbols: np.ndarray):
        self.bits = max(1, int(symbols.max(initial=0)).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the position `at`."""
        low, high = np.zeros_like(at), at.copy()
        for depth in range(self.bits):
            one = ((symbol >> (self.bits - 1 - depth)) & 1).astype(bool)
            count = self.ones[depth]
            low = np.where(one, self.zeros[depth] + count[low], low - count[low])
            high = np.where(one, self.zeros[depth] + count[high], high - count[high])
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol, at = np.zeros_like(at), at.copy()
        for depth in range(self.bits):
            count = self.ones[depth]
            one = count[at + 1] - count[at]
            symbol = symbol * 2 + one
            at = np.where(one == 1, self.zeros[depth] + count[at], at - count[at])
        return symbol


class FMIndex:
    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE):
        """`symbols` end with a 0 that occurs as separator too; codes of words are above 0."""
        order = suffix_array(symbols)
        self.tree = WaveletTree(symbols[order - 1])
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=2))])
        self.marked = (order % sample == 0) | (symbols[order - 1] == 0)  # a walk back never crosses a separator
        self.place = np.cumsum(self.marked) - self.marked
        self.samples = order[self.marked]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of the rows of `patterns`, all of one length."""
        count = len(patterns)
        low, high = np.zeros(count, np.int64), np.full(count, self.before[-1], np.int64)
        alive = np.arange(count)
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[alive, column]
            known = symbol < len(self.before) - 1
            high[alive[~known]] = low[alive[~known]]
            alive, symbol = alive[known], symbol[known]
            low[alive] = self.before[symbol] + self.tree.rank(symbol, low[alive])
            high[alive] = self.before[symbol] + self.tree.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back to a sampled row."""
        at, steps = rows.copy(), np.zeros_like(rows)
        open_ = np.flatnonzero(~self.marked[at])
        while len(open_):
            symbol = self.tree.access(at[open_])
            at[open_] = self.before[symbol] + self.tree.rank(symbol, at[open_])
            steps[open_] += 1
            open_ = open_[~self.marked[at[open_]]]
        return self.samples[self.place[at]] + steps


def search_shard(texts: list[bytes], phrases: Phrases) -> tuple[list[int], dict[int, list[tuple[int, int]]], dict[int, set[str]]]:
    """Word counts of the texts, and for texts with hits their spans of words and the items found."""
    counts, symbols, origin, owner = [], [], [], []
    get, least = phrases.codes.get, phrases.shortest
    for k, text in enumerate(texts):
        words = text.translate(_TO_WORDS).split()
        counts.append(len(words))
        if len(words) < least or not phrases.texts:
            continue
        coded = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
        gaps = np.concatenate([[-1], np.flatnonzero(coded == 0), [len(coded)]])
        for i in np.flatnonzero(np.diff(gaps) > least):
            first, last = gaps[i] + 1, gaps[i + 1]
            symbols += [coded[first:last], [0]]
            origin.append(np.arange(first, last + 1))
            owner.append(np.full(last + 1 - first, k))
    spans: dict[int, list[tuple[int, int]]] = {}
    found: dict[int, set[str]] = {}
    if symbols:
        index = FMIndex(np.concatenate(symbols).astype(np.int64))
        origin, owner = np.concatenate(origin), np.concatenate(owner)
        sizes = np.array([len(p) for p in phrases.texts])
        for size in np.unique(sizes):
            ids = np.flatnonzero(sizes == size)
            low, high = index.search(np.stack([phrases.texts[i] for i in ids]))
            hits = high - low
            rows = np.repeat(low, hits) + np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits)
            places = index.locate(rows)
            for phrase, place in zip(np.repeat(ids, hits).tolist(), places.tolist()):
                doc = int(owner[place])
                spans.setdefault(doc, []).append((int(origin[place]), int(origin[place]) + int(size)))
                found.setdefault(doc, set()).update(phrases.owners[phrase])
    return counts, spans, found


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[object, str]]]:
    """Items in blocks of bounded size, read from the executors one partition at a time."""
    block, size = [], 0
    for item, text in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        block.append((item, text))
        size += len(text) * WINDOW
        if size > limit:
            yield block
            block, size = [], 0
    yield block


_SPANS = "doc_id long, text_key long, n_words long, spans array<struct<first:long,last:long>>, items array<string>"


def _search(docs: DataFrame, items: list[tuple[object, str]]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(phrases_of(items))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        for batch in batches:
            data, offsets = buffer_of(batch.column("text"))
            for first, last in slabs(offsets, SHARD):
                texts = [data[a:b].tobytes() for a, b in zip(offsets[first:last], offsets[first + 1:last + 1])]
                counts, spans, found = search_shard(texts, phrases)
                n = range(last - first)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(first, last - first), batch.column("text_key").slice(first, last - first), pa.array(counts, pa.int64()),
                    pa.array([[{"first": a, "last": b} for a, b in merge(spans.get(k, []))] for k in n], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                    pa.array([sorted(found.get(k, ())) for k in n], pa.list_(pa.string()))], ["doc_id", "text_key", "n_words", "spans", "items"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(shards, _SPANS)


def find(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: `n_words`, merged hit `spans` of word positions, and the `items` found, sorted."""
    parts = [_search(docs, items) for items in _blocks(benchmark, block_bytes)]
    if len(parts) == 1:
        return parts[0]
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    hits = hits.where(F.size("items") > 0).groupBy("doc_id", "text_key").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    gathered = F.expr("""aggregate(spans, cast(array() as array<struct<first:bigint,last:bigint>>), (s, x) ->
      if(size(s) > 0 and x.first <= element_at(s, -1).last,
         concat(slice(s, 1, size(s) - 1), array(named_struct('first', element_at(s, -1).first, 'last', greatest(element_at(s, -1).last, x.last)))),
         concat(s, array(x))))""")
    hits = hits.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t"), gathered.alias("_s"), F.col("items").alias("_i"))
    rows = parts[0].select("doc_id", "text_key", "n_words")
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_t"))
    none = "cast(array() as array<struct<first:bigint,last:bigint>>)", "cast(array() as array<string>)"
    return rows.join(hits, same, "left").select("doc_id", "text_key", "n_words", F.expr(f"coalesce(_s, {none[0]})").alias("spans"), F.expr(f"coalesce(_i, {none[1]})").alias("items"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.last - s.first)")
    return find(docs, benchmark).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the characters of the hit words; what stood around them stays."""
    if not spans:
        return text
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    starts, ends, _ = word_spans(LOWER[data], np.array([0, len(data)]), NOT_WORD)
    out, at = [], 0
    for first, last in spans:
        out.append(raw[at:starts[first]])
        at = ends[last - 1]
    return (b"".join(out) + raw[at:]).decode()


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` with the hit words taken out of their texts and, where there is one, `n_chars` counted anew; all columns stay."""
    hits = find(docs, benchmark).where(F.size("items") > 0).select(F.col("doc_id").alias("at"), F.col("text_key").alias("key"), "spans")
    hits = stored(hits.dropDuplicates(["at", "key"]), "spans")
    cut = F.pandas_udf(lambda text, first, last: pd.Series([cut_spans(t, list(zip(a, b))) for t, a, b in zip(text, first, last)]), "string")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"))
    same = F.col("doc_id").eqNullSafe(F.col("at")) & (F.col("text_key") == F.col("key"))
    changed = rows.join(hits, same).select("row", cut("row.text", "spans.first", "spans.last").alias("left"))
    new = {"text": F.col("left")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("left").cast(docs.schema["n_chars"].dataType)
    changed = changed.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
    return rows.join(hits, same, "left_anti").select("row.*").unionAll(changed)


ORACLE_SQL = f"""with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
b as (select item_id::varchar as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
p as (select distinct item, least(len(w), {WINDOW})::bigint as size, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') as k
  from b, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) u(i) where len(w) > 0),
sizes as (select distinct size from p),
t as (select doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') as k from d, sizes, unnest(range(1, len(w) - size + 2)) u(i)),
h as (select t.doc_id, t.i, t.size, p.item from t join p on t.k = p.k and t.size = p.size),
words as (select doc_id, count(distinct i + o) as n_hit from (select distinct doc_id, i, size from h), unnest(range(size)) v(o) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as all_items from (select distinct doc_id, item from h) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(all_items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words on d.doc_id = words.doc_id left join items on d.doc_id = items.doc_id"""
