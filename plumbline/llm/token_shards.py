"""Token shards: ids of whole documents in key order, each shard with a minimal perfect hash over its document keys.

`write` ranges documents by key, encodes them and cuts each range into shards of about `SHARD` ids. A shard is one
binary image:

    magic, then eight numbers: documents, keys, ids, levels, words of bits, three spare
    levels        size in bits of each level of the hash
    bits, ranks   bit arrays of all levels; how many bits are set before each 512
    prints        per slot 32 bits of another hash of its key, against keys that the shard does not hold
    first, count  per slot the key's first document and how many documents have the key
    offsets       ids before each document, and in all
    ids           the payload, unsigned 32-bit little-endian

All sections are little-endian and padded to 8 bytes. The hash has no collisions: at every level a key that falls on a
bit alone is settled there, the others go on to the next level, and a key's slot is the number of bits before its own. Finding a
document takes a few bit probes and one comparison, whatever the number of documents. Images travel in a Parquet table,
one row each, so that Spark's commit protocol writes them whole to any store; beside the image a row has the shard's
number, its key range, its counts and the keys in order.

Defined results: a null text is empty and holds the end id only; documents of one key follow each other by the hash of their text;
null keys come last, belong to no slot and are reached by their place; an empty table gives no shards; other columns play
no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bytes import buffer_of, slabs, spread
from plumbline.llm.storage import stored
from plumbline.llm.tokens import ByteLevelEncoder
from plumbline.operators.ranking import running
from plumbline.runtime import scratch_dir

END = 2
SHARD = 1 << 20
MAGIC = b"IDSHARD1"
BLOCK = 512
_ENCODERS: dict[str, ByteLevelEncoder] = {}
_SHARDS = [("shard", pa.int64()), ("first_key", pa.int64()), ("last_key", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("keys", pa.list_(pa.int64())), ("image", pa.binary())]
_SHARDS_SQL = "shard long, first_key long, last_key long, n_docs long, n_ids long, keys array<long>, image binary"
_FOUND = [("doc_id", pa.int64()), ("shard", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
_FOUND_SQL = "doc_id long, shard long, local long, n_tokens long, ids_crc32 long"


def _encoder(path: str) -> ByteLevelEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteLevelEncoder(path)
    return _ENCODERS[path]


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    return spread(keys.astype(np.int64).view(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))


def perfect_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Level sizes, bits and ranks of a minimal perfect hash over distinct keys."""
    sizes, bits = [], []
    while len(keys):
        size = -(-2 * len(keys) // BLOCK) * BLOCK
        at = (_hash(keys, len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(np.packbits(alone, bitorder="little").view("<u8"))
        keys = keys[~alone[at]]
    words = np.concatenate(bits) if bits else np.zeros(0, "<u8")
    counts = np.bitwise_count(words).reshape(-1, BLOCK // 64).sum(axis=1)
    return np.array(sizes, "<i8"), words, (np.cumsum(counts) - counts).astype("<u4")


class Shard:
    """Keyed access to a shard's image."""

    def __init__(self, image: bytes):
        if image[:8] != MAGIC:
            raise ValueError("not a token shard")
        self.n_docs, self.n_keys, self.n_ids, n_levels, n_words, *_ = np.frombuffer(image, "<i8", 8, 8).tolist()
        at = 72

        def section(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(image, dtype, n, at)
            at += -(-got.nbytes // 8) * 8
            return got

        self.sizes, self.bits = section("<i8", n_levels), section("<u8", n_words)
        self.ranks = section("<u4", n_words // (BLOCK // 64))
        self.prints, self.first, self.count = (section("<u4", self.n_keys) for _ in range(3))
        self.offsets, self.ids = section("<u4", self.n_docs + 1).astype(np.int64), section("<u4", self.n_ids)

    @staticmethod
    def image(keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
        """`keys` in order (of the first documents; the others have none), ids per document, and all ids."""
        distinct, first, count = np.unique(keys, return_index=True, return_counts=True)
        levels, bits, ranks = perfect_hash(distinct)
        slot = _slots(distinct, levels, bits, ranks)
        prints, firsts, counts = (np.zeros(len(distinct), "<u4") for _ in range(3))
        prints[slot], firsts[slot], counts[slot] = _prints(distinct), first, count
        offsets = np.append(0, np.cumsum(sizes)).astype("<u4")
        head = np.array([len(sizes), len(distinct), len(ids), len(levels), len(bits), 0, 0, 0], "<i8")
        sections = [head, levels, bits, ranks, prints, firsts, counts, offsets, ids.astype("<u4")]
        return MAGIC + b"".join(s.tobytes() + b"\0" * (-s.nbytes % 8) for s in sections)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First document and number of documents of every key; none where the shard does not hold it."""
        slot = _slots(keys, self.sizes, self.bits, self.ranks)
        there = slot >= 0
        there[there] = self.prints[slot[there]] == _prints(keys[there])
        slot = slot[there]
        first, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        first[there], count[there] = self.first[slot], self.count[slot]
        return first, count

    def document(self, place: int) -> np.ndarray:
        return self.ids[self.offsets[place]:self.offsets[place + 1]]


def _prints(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, -2) >> np.uint64(32)).astype("<u4")


def _slots(keys: np.ndarray, sizes: np.ndarray, bits: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    slot = np.full(len(keys), -1, np.int64)
    left, base = np.arange(len(keys)), 0
    for level, size in enumerate(sizes.tolist()):
        at = base + (_hash(keys[left], level) % np.uint64(size)).astype(np.int64)
        word, bit = bits[at >> 6], (at & 63).astype(np.uint64)
        hit = (word >> bit) & np.uint64(1) == 1
        where = at[hit]
        block = where >> 9
        inside = bits.reshape(-1, BLOCK // 64)[block]
        before = np.arange(BLOCK // 64) < ((where >> 6) & 7)[:, None]
        rank = ranks[block].astype(np.int64) + (np.bitwise_count(inside) * before).sum(axis=1)
        rank += np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
        slot[left[hit]] = rank
        left, base = left[~hit], base + size
    return slot


def write(docs: DataFrame, path: str, tokenizer: str, shard: int = SHARD) -> DataFrame:
    """Encode documents and write their shards in key order; the table of shards."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.col("doc_id").cast("long")
    ready = docs.select(key.alias("doc_id"), text.alias("text"), key.isNull().alias("last"), F.xxhash64(text).alias("tk"), F.monotonically_increasing_id().alias("row"))
    order = ["last", "doc_id", "tk", "row"]

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = _encoder(tokenizer), TaskContext.get().partitionId() << 32
        keys, parts, held = [], [], 0

        def cut() -> pa.RecordBatch:
            nonlocal keys, parts, held, number
            known = [k for k in keys if k is not None]
            sizes = np.array([len(p) for p in parts], np.int64)
            image = Shard.image(np.array(known, np.int64), sizes, np.concatenate(parts))
            row = pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(
                (number, known[0] if known else None, known[-1] if known else None, len(parts), int(sizes.sum()), keys, image), _SHARDS)], [n for n, _ in _SHARDS])
            keys, parts, held, number = [], [], 0, number + 1
            return row

        for batch in batches:
            data, offsets = buffer_of(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for low, high in slabs(offsets):
                texts = [data[a:b].tobytes() for a, b in zip(offsets[low:high], offsets[low + 1:high + 1])]
                for k, own in enumerate(encoder.encode_many(texts), low):
                    keys.append(ids[k])
                    parts.append(np.append(own, np.uint32(END)))
                    held += len(parts[-1])
                    if held >= shard:
                        yield cut()
        if parts:
            yield cut()

    ranged = ready.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    ranged.mapInArrow(per_partition, _SHARDS_SQL).write.parquet(path)
    return spark.read.parquet(path)


def bases(shards: DataFrame) -> DataFrame:
    """Ids in all shards before each."""
    line = running(shards.select("shard", "n_ids"), [], ["shard"], {"_b": ("sum", "n_ids")})
    return stored(line.select(F.col("shard").alias("at"), F.col("_b_before").cast("long").alias("base")), "bases")


def _described(shard: Shard, number: int, doc_id: int | None, place: int) -> list:
    ids = shard.document(place)
    return [doc_id, number, int(shard.offsets[place]), len(ids), zlib.crc32(ids.tobytes())]


def read_back(shards: DataFrame) -> DataFrame:
    """Every document of the shards, each found by its key: where it starts among all ids, how many it has and their checksum."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, keys, image in zip(batch.column("shard").to_pylist(), batch.column("keys"), batch.column("image")):
                held = Shard(image.as_py())
                known = keys.values.drop_null().to_numpy().astype(np.int64)
                distinct = np.unique(known)
                first, count = held.find(distinct)
                if int(count.sum()) != len(known):
                    raise ValueError(f"shard {number} does not find its own keys")
                rows = [_described(held, number, k, place) for k, a, n in zip(distinct.tolist(), first.tolist(), count.tolist()) for place in range(a, a + n)]
                rows += [_described(held, number, None, place) for place in range(len(known), held.n_docs)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _FOUND)], [n for n, _ in _FOUND])

    found = shards.select("shard", "keys", "image").mapInArrow(per_batch, _FOUND_SQL)
    return found.join(bases(shards), F.col("shard") == F.col("at")).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "shard")


def lookup(shards: DataFrame, wanted: DataFrame) -> DataFrame:
    """The documents (doc_id, shard, ids) of the keys in `wanted`; keys that no shard holds give no row.

    Keys are ranked among the shards' key ranges, packed per shard, and only then meet the images.
    """
    ranges = shards.where("first_key is not null").select("shard", "first_key", "last_key")
    marks = ranges.select(F.col("first_key").alias("k"), F.lit(0).alias("asked"), F.col("shard").alias("mark"))
    asked = wanted.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("k"), F.lit(1).alias("asked"), F.lit(None).cast("long").alias("mark")).distinct()
    # A shard that begins with the key may follow others that hold it too, so the search begins at the last shard below.
    line = running(marks.unionByName(asked), [], ["k", "asked", "mark"], {"_last": ("max", "mark")})
    upper = stored(line.where("asked = 1").select("k", F.col("_last").alias("upper")), "asked")
    direct = upper.select("k", F.col("upper").alias("shard"))
    spanning = ranges.where("first_key is not null").join(upper, F.col("last_key") == F.col("k")).select("k", "shard")
    at = direct.unionByName(spanning).where("shard is not null").distinct()
    at = at.join(ranges, "shard").where(F.col("k").between(F.col("first_key"), F.col("last_key")))
    packed = at.groupBy("shard").agg(F.array_sort(F.collect_set("k")).alias("asked"))

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, keys, image in zip(batch.column("shard").to_pylist(), batch.column("asked"), batch.column("image")):
                held, keys = Shard(image.as_py()), keys.values.to_numpy().astype(np.int64)
                first, count = held.find(keys)
                rows = [(k, number, held.document(place).tolist()) for k, a, n in zip(keys.tolist(), first.tolist(), count.tolist()) for place in range(a, a + n)]
                for i in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i:i + 256]), (pa.int64(), pa.int64(), pa.list_(pa.int64())))], ["doc_id", "shard", "ids"])

    return packed.join(shards.select("shard", "image"), "shard").mapInArrow(per_batch, "doc_id long, shard long, ids array<long>")


def report(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    path = scratch_dir(docs.sparkSession, "token-shards")
    return read_back(write(docs, path, public_tokenizers.path("byte_bpe_50k.json")))
