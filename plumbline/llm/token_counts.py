"""Token counts by field and line: records are encoded once, whole, and tokens are attributed by their character spans.

A record is its fields joined by one space. Its sections are the lines of the fields; a line feed belongs to the line
it ends, and the space between fields to the field before it. Token spans are joined to section spans by place. A
token that crosses a boundary goes to the section that holds most of its characters, and to the earlier one when they
hold equally many. Every token is counted once, so the sections of a document add up to its tokens.

Defined results: a null or empty field has one empty line; it holds no token unless the space after it is one of its
own; repeated rows are counted one by one; an empty table gives an empty result; the other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bytes import buffer_of, slabs
from plumbline.llm.tokens import ByteEncoder

FIELDS = ("source", "lang", "text")
_SCHEMA = "doc_id long, field int, line int, first_char long, last_char long, n_tokens long, n_crossing long"
_ENCODERS: dict[str, ByteEncoder] = {}


def _encoder(ranks: str) -> ByteEncoder:
    import public_tokenizers

    if ranks not in _ENCODERS:
        _ENCODERS[ranks] = ByteEncoder(ranks, public_tokenizers.PATTERN)
    return _ENCODERS[ranks]


def sections(fields: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every line of the joined fields, with the end of the whole, and the field of every line."""
    starts, owner, at = [], [], 0
    for k, field in enumerate(fields):
        breaks = np.flatnonzero(np.frombuffer(field, np.uint8) == 0x0A) + 1
        own = np.concatenate([[0], breaks[breaks < len(field)]])
        starts.append(own + at)
        owner.append(np.full(len(own), k, np.int32))
        at += len(field) + 1
    return np.concatenate([*starts, [at - 1]]), np.concatenate(owner)


def attribute(first: np.ndarray, last: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token span [first, last), and whether it crosses a boundary."""
    low = np.searchsorted(bounds[1:-1], first, "right")
    high = np.searchsorted(bounds[1:-1], np.maximum(first, last - 1), "right")
    home = low.copy()
    for i in np.flatnonzero(low != high):
        crossed = np.arange(low[i], high[i] + 1)
        held = np.minimum(bounds[crossed + 1], last[i]) - np.maximum(bounds[crossed], first[i])
        home[i] = crossed[np.argmax(held)]
    return home, low != high


def count_sections(fields: Sequence[bytes], encoder: ByteEncoder) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per section its field, and bounds in characters (with the end), tokens, and tokens that cross into or out of it."""
    whole = b" ".join(fields)
    bounds, owner = sections(fields)
    data = np.frombuffer(whole, np.uint8)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    bounds, n = chars[bounds], len(owner)
    if not whole:
        return owner, bounds, np.zeros(n, np.int64), np.zeros(n, np.int64)
    ends = np.cumsum(encoder.n_bytes[encoder.encode(whole)])
    starts = np.concatenate([[0], ends[:-1]])
    begun = (data[starts] & 0xC0) == 0x80  # the token begins inside a character, which then is its first
    home, crossing = attribute(chars[starts] - begun, chars[ends], bounds)
    return owner, bounds, np.bincount(home, minlength=n), np.bincount(home[crossing], minlength=n)


def count_tokens(docs: DataFrame, ranks: str, fields: Sequence[str] = FIELDS) -> DataFrame:
    """One row per document, field and line; `ranks` is the rank file of a byte-level vocabulary."""
    names = [f"f{k}" for k in range(len(fields))]

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks)
        for batch in batches:
            columns, ids = [buffer_of(batch.column(c)) for c in names], batch.column("doc_id")
            for first, last in slabs(sum(offsets for _, offsets in columns)):
                got = [count_sections([data[o[row]:o[row + 1]].tobytes() for data, o in columns], encoder) for row in range(first, last)]
                sizes = [len(owner) for owner, *_ in got]
                lines = np.concatenate([np.arange(len(o), dtype=np.int32) - np.searchsorted(o, o).astype(np.int32) for o, *_ in got])
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(np.repeat(np.arange(first, last), sizes))), pa.array(np.concatenate([o for o, *_ in got])), pa.array(lines),
                    *[pa.array(np.concatenate(part).astype(np.int64)) for part in ([b[:-1] for _, b, _, _ in got], [b[1:] for _, b, _, _ in got], [n for _, _, n, _ in got], [c for *_, c in got])]],
                    [c.split()[0] for c in _SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(f).cast("string").alias(n) for f, n in zip(fields, names)]).mapInArrow(per_batch, _SCHEMA)


def report(docs: DataFrame) -> DataFrame:
    """Tokens of every line of every document, its source and language standing before its text."""
    import public_tokenizers

    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return counted.withColumn("field", F.element_at(F.array(*[F.lit(f) for f in FIELDS]), F.col("field") + 1))
