"""Near copies for the pipeline: links proposed by the Gray-order fingerprint index, decided by Jaccard similarity.

Rows of one text are one node. Fingerprints are majorities over shingles of `PROPOSING` words; the index of `simhash.py`, with more
and shorter patterns, proposes links between fingerprints up to the last of `RISING` differing bits, which is wider than copies at the threshold mostly
lie apart. Whether a proposed link holds is decided by the Jaccard similarity of the sets of five-word shingles alone. Every task proposes a shortest spanning forest of its own, so a group of copies is
proposed by few links per text, never by all its pairs. Proposals are
settled in rounds: each round compares the shingle sets of the link to the smallest and to the largest partner that every node
still has open, joins those at or above the threshold, and drops links inside a group. A link is only left unread when
its ends are in one group already, and sets travel once per compared link, never for all pairs of a group.

Defined results: texts of fewer than five words are one shingle; texts without words are all alike; a null text is empty; of a
group the row with the smallest id stays (of repeated rows with it, one), rows without an id always; an empty table gives an empty result;
all columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import simhash
from plumbline.llm.bytes import LOWER, buffer_of, slabs, span_hashes, window_hashes, word_spans
from plumbline.llm.components import components
from plumbline.llm.storage import stored

WORDS = 5
SIMILAR = 0.8
#: Proposals: shingles of the fingerprints (an edited word spoils fewer short ones), differing bits, near pairs first, and the blocks
#: of bits of which two have to agree. Copies at the threshold lie about 8 bits apart.
PROPOSING = 3
RISING = (3, 6, 9, 12)
BLOCKS = 11
AGREEING = 2


def shingle_sets(texts: DataFrame) -> DataFrame:
    """`node` and the sorted distinct shingle hashes of each text, as raw 64-bit numbers."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffer_of(batch.column("text"))
            nodes = batch.column("node")
            for first, last in slabs(offsets):
                own = LOWER[data[offsets[first]:offsets[last]]]
                starts, ends, rows = word_spans(own, offsets[first:last + 1] - offsets[first])
                hashes, sets = span_hashes(own, starts, ends), []
                for a, b in zip(rows[:-1], rows[1:]):
                    sets.append(np.unique(window_hashes(hashes[a:b], min(WORDS, b - a))).tobytes() if b > a else b"")
                yield pa.RecordBatch.from_arrays([nodes.slice(first, last - first), pa.array(sets, pa.binary())], ["node", "shingles"])

    return texts.select("node", "text").mapInArrow(per_batch, "node long, shingles binary")


def similar(links: DataFrame, sets: DataFrame, least: float = SIMILAR) -> DataFrame:
    """The links `a`, `b` whose shingle sets have a Jaccard similarity of `least` or more."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= least * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, other = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return links.select("a", "b").join(one, "a").join(other, "b").select("a", "b", "x", "y").mapInArrow(per_batch, "a long, b long")


def proposals(nodes: DataFrame) -> DataFrame:
    """Links between nodes (`node`, `fp`): from the least node of a fingerprint to its others, and between those of near fingerprints."""
    leaves = stored(nodes.groupBy("fp").agg(F.min("node").alias("least")), "leaves")
    inside = nodes.join(leaves.withColumnRenamed("fp", "of"), F.col("fp") == F.col("of")).where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    found = simhash.links(leaves.select("fp"), blocks=BLOCKS, agreeing=AGREEING, rising=RISING)
    one, other = leaves.select(F.col("fp").alias("a"), F.col("least").alias("p")), leaves.select(F.col("fp").alias("b"), F.col("least").alias("q"))
    between = found.join(one, "a").join(other, "b").select(F.col("p").alias("a"), F.col("q").alias("b"))
    both = inside.unionAll(between).where("a <> b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def groups(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """`id`, `node` (hash of the text) and `label` (the node that names its group) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("node"), text.alias("text"))
    ids = stored(rows.select("doc_id", "node"), "ids")
    texts = rows.join(ids.groupBy(F.col("node").alias("of")).agg(F.min("doc_id").alias("first")), F.col("node") == F.col("of")).where("doc_id <=> first")
    # The least row of a text stands for it; equal rows of one id are taken together.
    marks = simhash.fingerprints(texts.select(F.col("node").alias("doc_id"), "text"), size=PROPOSING).select(F.col("doc_id").alias("node"), "fp").distinct()
    open_ = stored(proposals(stored(marks, "marks")), "open")
    wanted = stored(open_.select(F.col("a").alias("of")).unionAll(open_.select(F.col("b").alias("of"))).distinct(), "wanted")
    sets = stored(shingle_sets(texts.select("node", "text").join(wanted, F.col("node") == F.col("of"), "left_semi")).dropDuplicates(["node"]), "sets")
    joined, labels = None, None
    while not open_.isEmpty():
        lows = open_.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").unionAll(open_.groupBy("a").agg(F.max("b").alias("b")).select("a", "b")).distinct()
        lows = stored(lows, "round")
        good = stored(similar(lows, sets, least), "similar")
        joined = good if joined is None else stored(joined.unionAll(good), "joined")
        labels = components(joined)
        left = open_.join(lows, ["a", "b"], "left_anti")
        for end in ("a", "b"):
            named = labels.select(F.col("node").alias("at"), F.col("label").alias("l" + end))
            left = left.join(named, F.col(end) == F.col("at"), "left").drop("at")
        open_ = stored(left.where("not coalesce(la, a) <=> coalesce(lb, b)").select("a", "b"), "open")
    if labels is None:
        return ids.select("doc_id", "node", F.col("node").alias("label"))
    named = labels.select(F.col("node").alias("at"), "label")
    return ids.join(named, F.col("node") == F.col("at"), "left").select("doc_id", "node", F.coalesce("label", "node").alias("label"))


def keep_one(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """`docs` with one row of every group of near copies."""
    found = stored(groups(docs, least), "groups")
    names = stored(found.groupBy(F.col("label").alias("l")).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")).where("rows > 1"), "names")
    of_many = stored(found.join(names, F.col("label") == F.col("l")).select("doc_id", "node", "least"), "of-many")
    gone = stored(of_many.where("doc_id <> least").select(F.col("doc_id").alias("i"), F.col("node").alias("t")).distinct(), "gone")
    again = stored(of_many.where("doc_id = least").groupBy(F.col("doc_id").alias("i")).count().where(F.col("count") > 1).select("i"), "again")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("at"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("tk"))
    kept = rows.join(gone, (F.col("at") == F.col("i")) & (F.col("tk") == F.col("t")), "left_anti")
    once = kept.join(again, F.col("at") == F.col("i"), "left_anti")
    # Of repeated rows with the smallest id of a group one stays; rows of that id in other groups are apart from them.
    first = kept.join(again, F.col("at") == F.col("i"), "left_semi").dropDuplicates(["at", "tk"])
    return once.unionAll(first).select("row.*")
