"""Packets of array data that Spark shuffles: one row holds many entries of many documents for one bucket.

Numbers are laid out byte plane by byte plane, so that the zero bytes of small numbers stand together and the shuffle's own
compression takes them away. Documents of a packet are a run-length table over its entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.storage import stored

#: Stands for a null document id: after all others.
LAST = (1 << 63) - 1


def planes(values: np.ndarray) -> bytes:
    values = np.ascontiguousarray(values)
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unplanes(raw: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the high half of a hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)


def pack(bucket: np.ndarray, row: np.ndarray, place: np.ndarray, documents: list[np.ndarray], rest: list[np.ndarray]) -> Iterator[list]:
    """Split entries by bucket: [bucket, documents..., entries per document, places, rest...]. `row` is ascending."""
    if not len(bucket):
        return
    order = np.argsort(bucket.astype(np.uint16) if bucket.max() < 1 << 16 else bucket, kind="stable")
    bucket, row, place, rest = bucket[order], row[order], place[order], [r[order] for r in rest]
    cuts = np.append(runs(bucket), len(bucket))
    for a, b in zip(cuts[:-1], cuts[1:]):
        first = runs(row[a:b])
        held = row[a:b][first]
        yield [int(bucket[a]), *[planes(np.diff(d[held], prepend=d.dtype.type(0))) for d in documents], planes(np.diff(np.append(first, b - a)).astype(np.uint32)),
               planes(place[a:b].astype(np.uint32)), *[planes(r[a:b]) for r in rest]]


def unpack(documents: list[bytes], counts: bytes, place: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    """Per entry its document columns (64-bit) and its place."""
    n = unplanes(counts, np.uint32)
    return [np.repeat(np.cumsum(unplanes(d, np.int64), dtype=np.int64), n) for d in documents], unplanes(place, np.uint32).astype(np.int64)


#: Entries on their way back to their documents: packed by the document's bucket, then one row per document and text.
RETURNS = [("bucket", pa.int32()), ("did", pa.binary()), ("tk", pa.binary()), ("counts", pa.binary()), ("place", pa.binary()), ("until", pa.binary())]
RETURNS_SQL = "bucket int, did binary, tk binary, counts binary, place binary, until binary"
_GATHERED = [("did", pa.int64()), ("tk", pa.int64()), ("places", pa.binary()), ("untils", pa.binary())]


def returned(did: np.ndarray, tk: np.ndarray | None, place: np.ndarray, until: np.ndarray | None, buckets: int) -> list[list]:
    """Entries (with an end each, or none) packed by document."""
    tk = np.zeros(len(did), np.int64) if tk is None else tk
    until = place if until is None else until
    order = np.lexsort((place, tk, did))
    did, tk, place, until = did[order], tk[order], place[order], until[order]
    change = np.zeros(len(did), np.int64)
    for c in (did, tk):
        change[runs(c)] = 1
    spread = (did.view(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    documents = np.flatnonzero(change)
    return list(pack(bucket_of(spread, buckets), np.cumsum(change) - 1, place, [did[documents], tk[documents]], [(until - place).astype(np.uint32)]))


def gather_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All entries of a document and text in one row, as raw 32-bit numbers."""
    got = []
    for batch in batches:
        for _, did, tk, counts, place, more in zip(*(batch.column(c).to_pylist() for c, _ in RETURNS)):
            (ids, texts), at = unpack([did, tk], counts, place)
            got.append((ids, texts, at, at + unplanes(more, np.uint32)))
    if got:
        did, tk, place, until = (np.concatenate(c) for c in zip(*got))
        order = np.lexsort((until, place, tk, did))
        did, tk, place, until = did[order], tk[order], place[order].astype(np.uint32), until[order].astype(np.uint32)
        change = np.zeros(len(did), bool)
        for c in (did, tk):
            change[runs(c)] = True
        cuts = np.flatnonzero(change)
        for i in range(0, len(cuts), 4096):
            own = cuts[i:i + 4096]
            ends = np.append(cuts[i + 1:i + 1 + len(own)], len(did))[:len(own)]
            yield record_batch([(did[a], tk[a], place[a:b].tobytes(), until[a:b].tobytes()) for a, b in zip(own, ends)], _GATHERED)


def by_document(packed: DataFrame, buckets: int) -> DataFrame:
    """did, tk, places and untils of packets in the form of `returned`."""
    return packed.repartitionById(buckets, "bucket").mapInArrow(gather_documents, "did long, tk long, places binary, untils binary")


def places(raw: bytes | None) -> np.ndarray:
    return np.unique(np.frombuffer(raw or b"", np.uint32)).astype(np.int64)


def n_buckets(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def identified(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, `did` (nulls after all), `tk` (hash of the text) and `text` (null: empty); the same plan wherever it is used."""
    body: Column = F.coalesce(F.col(text), F.lit(""))
    key = F.col("doc_id").cast("long")
    return docs.select(key.alias("doc_id"), F.coalesce(key, F.lit(LAST)).alias("did"), F.xxhash64(body).alias("tk"), body.alias("text"))


def later_copies(rows: DataFrame) -> DataFrame:
    """`did` and `tk` of rows whose whole text an earlier document holds too, written out.

    Only texts that stand twice are joined back, from a table of their own, so that Spark can split the rows of a very
    frequent text.
    """
    texts = rows.select("did", "tk", F.sha2("text", 256).alias("digest"))
    twice = stored(texts.groupBy(F.col("digest").alias("of")).agg(F.min("did").alias("least"), F.max("did").alias("most")).where("least < most").drop("most"), "twice")
    return stored(texts.join(twice, F.col("digest") == F.col("of")).where("did > least").select("did", "tk").distinct(), "copies")


def record_batch(rows: list[list], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema)], [n for n, _ in schema])
