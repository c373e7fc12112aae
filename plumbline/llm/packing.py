"""Best-fit packing by a grouping genetic algorithm on islands.

Documents are encoded whole, closed by one end id and cut only where they are longer than a sequence. Full pieces are
sequences of their own. The others are dealt by hash into chunks of about `CHUNK` sequences' worth of ids. Each chunk is evolved on
several islands: a crossover injects whole well-filled bins of one parent into the other, takes out the bins that hold
their pieces too, and puts the displaced pieces back by best fit. Between epochs every island gets the elites of the
others. A chunk stops early at its lower bound. Of the best solution's bins, those among the emptiest quarter of a chunk that
are not well filled are opened again and packed anew among those of other chunks, in ever fewer chunks, until one is left.

Defined results: a null text is empty and holds the end id only; a null document id is carried along; repeated rows
are packed one by one; an empty table gives an empty result; the other columns play no part.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.bytes import buffer_of, slabs
from plumbline.llm.storage import stored
from plumbline.llm.tokens import WordEncoder

LENGTH = 4096
END = 1
CHUNK = 320
ISLANDS = 3
EPOCHS = 3
GENERATIONS = 6
POPULATION = 6
WELL_FILLED = 0.995
_ENCODERS: dict[str, WordEncoder] = {}
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """One row per piece of at most `length` ids."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            data, offsets = buffer_of(batch.column("text"))
            for first, last in slabs(offsets):
                rows, piece, start, size, crc = [], [], [], [], []
                texts = [data[a:b].tobytes() for a, b in zip(offsets[first:last], offsets[first + 1:last + 1])]
                for row, own in enumerate(encoder.encode_many(texts), first):
                    ids = np.append(own, np.uint32(END)).astype("<u4")
                    for k, at in enumerate(range(0, len(ids), length)):
                        cut = ids[at:at + length]
                        rows.append(row), piece.append(k), start.append(at), size.append(len(cut)), crc.append(zlib.crc32(cut.tobytes()))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()),
                    pa.array(crc, pa.int64())], [c.split()[0] for c in _PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(per_batch, _PIECES)


class Packing:
    """A solution: items per bin, with what is free in each."""

    def __init__(self, sizes: list[int], bins: list[list[int]], length: int):
        self.sizes, self.bins, self.length = sizes, bins, length
        self.free = [length - sum(sizes[i] for i in b) for b in bins]

    def put(self, items: list[int]) -> Packing:
        """Best fit in order of falling size."""
        room = sorted((f, k) for k, f in enumerate(self.free))
        for i in sorted(items, key=lambda i: -self.sizes[i]):
            need = self.sizes[i]
            at = bisect_left(room, (need, -1))
            if at < len(room):
                _, k = room.pop(at)
            else:
                k = len(self.bins)
                self.bins.append([])
                self.free.append(self.length)
            self.bins[k].append(i)
            self.free[k] -= need
            insort(room, (self.free[k], k))
        return self

    @property
    def worth(self) -> tuple[int, float]:
        """Fewer bins first, then uneven filling, which leaves larger gaps to use."""
        return -len(self.bins), sum((1 - f / self.length) ** 2 for f in self.free)

    def without(self, gone: set[int], more: list[list[int]] = ()) -> Packing:
        """The bins free of the items in `gone`, with the bins `more`; the other items of broken bins are put back."""
        whole, displaced = [], []
        for b in self.bins:
            if gone.isdisjoint(b):
                whole.append(list(b))
            else:
                displaced += [i for i in b if i not in gone]
        return Packing(self.sizes, whole + [list(b) for b in more], self.length).put(displaced)


def crossover(one: Packing, other: Packing, rng: np.random.Generator) -> Packing:
    """Inject a share of the other's best-filled bins into the first."""
    best = np.argsort(other.free, kind="stable")[:max(1, len(other.bins) // 2)]
    chosen = [other.bins[k] for k in rng.choice(best, max(1, len(best) // 3), replace=False)]
    return one.without({i for b in chosen for i in b}, chosen)


def mutate(one: Packing, rng: np.random.Generator) -> Packing:
    """Open the least filled bins and a few others, and pack their items anew, some at random first."""
    order = np.argsort(one.free, kind="stable")[::-1]
    opened = set(order[:2].tolist()) | set(rng.integers(0, len(one.bins), 3).tolist())
    items = [i for k in opened for i in one.bins[k]]
    rest = Packing(one.sizes, [list(b) for k, b in enumerate(one.bins) if k not in opened], one.length)
    lead = rng.permutation(items)[:len(items) // 3].tolist()
    for i in lead:
        rest.put([i])
    return rest.put([i for i in items if i not in set(lead)])


def evolve(sizes: list[int], seed: int, arrivals: list[list[list[int]]], length: int = LENGTH) -> Packing:
    """One epoch of one island; `arrivals` are the other islands' elites."""
    rng = np.random.default_rng(seed)
    least = -(-sum(sizes) // length)
    people = [Packing(sizes, [list(b) for b in bins], length) for bins in arrivals] or [Packing(sizes, [], length).put(list(range(len(sizes))))]
    best = max(people, key=lambda p: p.worth)
    if len(best.bins) <= least:
        return best
    while len(people) < POPULATION:
        people.append(mutate(people[int(rng.integers(len(people)))], rng))
    for _ in range(GENERATIONS):
        people.sort(key=lambda p: p.worth, reverse=True)
        if len(people[0].bins) <= least:
            break
        for k in range(POPULATION // 2, POPULATION):
            a, b = rng.choice(POPULATION // 2, 2, replace=False)
            people[k] = mutate(crossover(people[a], people[b], rng), rng)
    return max(people, key=lambda p: p.worth)


def _coded(bins: list[list[int]], n: int) -> list[int]:
    home = np.zeros(n, np.int64)
    for k, b in enumerate(bins):
        home[b] = k
    return home.tolist()


def _bins(home: np.ndarray) -> list[list[int]]:
    order = np.argsort(home, kind="stable")
    return [p.tolist() for p in np.split(order, np.flatnonzero(np.diff(home[order])) + 1)] if len(home) else []


def _epoch(chunks: DataFrame, number: int, length: int) -> DataFrame:
    """chunk, island, bins and home (bin of every item) after one epoch of every island."""

    def per_batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for chunk, island, sizes, homes in zip(frame["chunk"], frame["island"], frame["sizes"], frame["homes"]):
                got = evolve(list(map(int, sizes)), chunk * 1009 + island * 31 + number, [_bins(np.asarray(h)) for h in homes], length)
                out.append((chunk, island, len(got.bins), got.worth[1], _coded(got.bins, len(sizes))))
            yield pd.DataFrame(out, columns=["chunk", "island", "n_bins", "evenness", "home"])

    islands = chunks.select("chunk", "sizes", "homes", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"))
    return islands.repartition("chunk", "island").mapInPandas(per_batch, "chunk long, island int, n_bins int, evenness double, home array<long>")


def _solve(chunks: DataFrame, length: int) -> DataFrame:
    """`chunk` and the best `home` found."""
    sizes = chunks.select("chunk", F.col("items.length").alias("sizes"))
    now = sizes.withColumn("homes", F.expr("cast(array() as array<array<long>>)"))
    for epoch in range(EPOCHS):
        elites = stored(_epoch(now, epoch, length), "elites")
        if epoch < EPOCHS - 1:
            now = sizes.join(elites.groupBy("chunk").agg(F.collect_list("home").alias("homes")), "chunk")
    return elites.groupBy("chunk").agg(F.max_by("home", F.struct(-F.col("n_bins"), "evenness", "island")).alias("home"))


def pack(found: DataFrame, length: int = LENGTH, chunk: int = CHUNK) -> DataFrame:
    """Add `sequence_id` and `offset` to pieces."""
    found = stored(found, "pieces")
    done = [found.where(F.col("length") == length).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    left, base, parts, full = found.where(F.col("length") < length), 0, 1 << 40, int(WELL_FILLED * length)
    while True:
        tokens = left.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
        parts = max(1, min(parts - 1, -(-tokens // (chunk * length))))
        dealt = left.select(F.expr(f"pmod(xxhash64(doc_id, piece, {base}L), {parts}L)").alias("chunk"), F.struct(*found.columns).alias("item"))
        chunks = stored(dealt.groupBy("chunk").agg(F.collect_list("item").alias("items")), "chunks")
        placed = chunks.join(_solve(chunks, length), "chunk").select("chunk", F.posexplode("items").alias("k", "item"), "home")
        placed = placed.select("chunk", "item.*", F.expr("home[k]").alias("bin"))
        bins = placed.groupBy("chunk", "bin").agg(F.sum("length").alias("filled"), F.array_sort(F.collect_list(F.struct(*found.columns))).alias("items"))
        of_chunk = Window.partitionBy("chunk")
        emptiest = 4 * (F.row_number().over(of_chunk.orderBy("filled", "bin")) - 1) < F.count(F.lit(1)).over(of_chunk)
        bins = stored(bins.withColumn("opened", emptiest & (F.col("filled") < full) & F.lit(parts > 1)), "bins")
        good = bins.where("not opened")
        offsets = F.expr("transform(sequence(1, size(items)), j -> aggregate(slice(items, 1, j - 1), 0L, (s, x) -> s + x.length))")
        out = good.select((F.lit(base) + F.col("chunk") * (1 << 20) + F.col("bin")).cast("long").alias("sequence_id"), F.explode(F.arrays_zip("items", offsets.alias("offset"))).alias("z"))
        done.append(out.select(*[F.col(f"z.items.{c}").alias(c) for c in found.columns], "sequence_id", F.col("z.offset").alias("offset")))
        if parts == 1:
            break
        left = bins.where("opened").select(F.explode("items").alias("item")).select("item.*")
        base += parts << 20
    total = done[0]
    for part in done[1:]:
        total = total.unionByName(part)
    return total


def pack_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(pieces(docs, public_tokenizers.path("word_bpe_49k.json")))
