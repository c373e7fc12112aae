"""Bootstrap replicates of the rank correlation and of weighted sums, the weights drawn once per row.

The weights of a row are the draws of `with_draws`, one number per replicate. They are never shuffled: rows are placed in slots by
ranges of y, and a task draws the weights of its rows and walks their values in order with one running total per replicate. What leaves it is,
per distinct x, the sums of the weights and of weight x rank, ranks counted from the start of the slot; the totals of earlier slots are
added afterwards. A value of y that fills more than a slot is dealt over several, since all its rows share one rank. The sums per x, in
blocks of WIDTH replicates, are then walked in the order of x in the same way.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.keys import POISSON_ONE
from plumbline.runtime import materialise, materialise_evenly

WIDTH = 128  # replicates of a block
ROWS = 1024  # rows whose weights a task holds at once
DISTINCT = 512  # values of x whose sums a task holds at once
_LIMITS = [np.uint32(math.ceil(t * 2 ** 32)) for t in POISSON_ONE if math.ceil(t * 2 ** 32) < 2 ** 32]

Batches = Iterator[pa.RecordBatch]


def row_draws(keys: list[str], reps: int) -> np.ndarray:
    """Weights of each key in every replicate, equal to those of `with_draws`; one digest serves eight."""
    ends, raw = [b"%d" % g for g in range(-(-reps // 8))], []
    for key in keys:
        start = sha256(f"{key}|".encode())
        for end in ends:
            h = start.copy()
            h.update(end)
            raw.append(h.digest())
    u = np.frombuffer(b"".join(raw), ">u4").astype(np.uint32).reshape(len(keys), -1)[:, :reps]
    w = np.zeros(u.shape, np.uint8)
    for limit in _LIMITS:
        w += u >= limit
    return w


def _numbers(column: pa.Array) -> np.ndarray:
    """Binary rows of doubles as a table."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


_PLACED = "slot int, v double, sums binary"


def _batch(slot: np.ndarray, v: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(v, pa.float64()), pa.array([s.tobytes() for s in sums], pa.binary())], ["slot", "v", "sums"])


def _starts(slot: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, (slot[1:] != slot[:-1]) | (v[1:] != v[:-1])))


class _Slots:
    """Places on y: one slot per range between bounds, and one per share of a value that several bounds fell on."""

    def __init__(self, limits: list[float]):
        self.bounds, times = np.unique(np.array(limits, np.float64), return_counts=True)
        self.shares = np.append(np.where(times > 1, times, 0), 0)
        self.first = np.append(0, np.cumsum(1 + self.shares[:-1]))
        self.count = int(self.first[-1]) + 1

    def at(self, v: np.ndarray, salt: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.bounds, v, "left")
        split = (self.shares[i] > 0) & (v == self.bounds[np.minimum(i, len(self.bounds) - 1)]) if len(self.bounds) else np.zeros(len(v), bool)
        return self.first[i] + np.where(split, 1 + salt % np.maximum(self.shares[i], 1), 0)

    def group(self, slot: int) -> tuple[int, bool]:
        """The first slot of those that share a value, and whether they do."""
        i = int(np.searchsorted(self.first, slot, "right")) - 1
        return (int(self.first[i]) + 1, True) if slot > self.first[i] else (slot, False)


def _dealt(slots: _Slots) -> Callable[[Batches], Batches]:
    def per_partition(batches: Batches) -> Batches:
        for batch in batches:
            slot = slots.at(batch.column("y").to_numpy(), batch.column("salt").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), *batch.columns], ["slot", *batch.schema.names])

    return per_partition


_SUMS = "place int, shared boolean, block int, x double, sums binary, totals array<array<double>>"


class _Slot:
    """Sums of one slot: per x the weights and weight x rank, and in all weights, weight x rank, weight x squared rank, further sums."""

    def __init__(self, place: int, shared: bool, blocks: int, extras: int):
        self.place, self.shared, self.blocks = place, shared, blocks
        self.per_x: dict[float, np.ndarray] = {}
        self.total = np.zeros((3 + extras, blocks * WIDTH))
        self.value, self.held = None, {}

    def close(self) -> None:
        """The rows of the open value are whole: they share one rank."""
        if not self.held:
            return
        w = sum(self.held.values())
        rank = 0.0 if self.shared else self.total[0] + (w + 1) / 2
        for x, part in self.held.items():
            both = self.per_x.setdefault(x, np.zeros((2, part.size)))
            both[0] += part
            both[1] += part * rank
        self.total[:3] += w, w * rank, w * rank * rank
        self.value, self.held = None, {}

    def add(self, y: np.ndarray, x: np.ndarray, w: np.ndarray, more: np.ndarray) -> Batches:
        """Rows in the order of y and x, whose weights fit in memory."""
        if len(more):
            self.total[3:] += more @ w
        first = np.flatnonzero(np.append(True, (y[1:] != y[:-1]) | (x[1:] != x[:-1])))
        y, x, w = y[first], x[first], np.add.reduceat(w, first, axis=0)
        inner = np.flatnonzero((y > y[0]) & (y < y[-1])) if not self.shared else np.zeros(0, int)
        self.take(y, x, w, np.flatnonzero(y == y[0]))
        if y[-1] != y[0]:
            self.close()
            if len(inner):
                self.whole(y[inner], x[inner], w[inner])
            self.take(y, x, w, np.flatnonzero(y == y[-1]))
        if len(self.per_x) > DISTINCT:
            yield from self.flush()

    def take(self, y: np.ndarray, x: np.ndarray, w: np.ndarray, rows: np.ndarray) -> None:
        if self.value is not None and self.value != y[rows[0]]:
            self.close()
        self.value = y[rows[0]]
        for k in rows:
            self.held[x[k]] = self.held.get(x[k], 0) + w[k]

    def whole(self, y: np.ndarray, x: np.ndarray, w: np.ndarray) -> None:
        """Values whose rows are all here."""
        starts = np.flatnonzero(np.append(True, y[1:] != y[:-1]))
        of_value = np.add.reduceat(w, starts, axis=0)
        upto = self.total[0] + np.cumsum(of_value, axis=0)
        rank = upto - of_value + (of_value + 1) / 2
        ranked = w * np.repeat(rank, np.diff(np.append(starts, len(y))), axis=0)
        order = np.argsort(x, kind="stable")
        cuts = np.flatnonzero(np.append(True, np.diff(x[order]) != 0))
        for value, a, b in zip(x[order][cuts], np.add.reduceat(w[order], cuts, axis=0), np.add.reduceat(ranked[order], cuts, axis=0)):
            both = self.per_x.setdefault(value, np.zeros((2, a.size)))
            both[0] += a
            both[1] += b
        self.total[:3] += of_value.sum(axis=0), (of_value * rank).sum(axis=0), (of_value * rank * rank).sum(axis=0)

    def _rows(self, block: int, x: list, sums: list, totals: list) -> pa.RecordBatch:
        k, types = len(x), [pa.int32(), pa.bool_(), pa.int32(), pa.float64(), pa.binary(), pa.list_(pa.list_(pa.float64()))]
        columns = [[self.place] * k, [self.shared] * k, [block] * k, x, sums, totals]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in _SUMS.split(", ")])

    def flush(self) -> Batches:
        for block in range(self.blocks):
            part = slice(block * WIDTH, (block + 1) * WIDTH)
            if self.per_x:
                yield self._rows(block, list(self.per_x), [v[:, part].tobytes() for v in self.per_x.values()], [None] * len(self.per_x))
        self.per_x = {}

    def end(self) -> Batches:
        self.close()
        yield from self.flush()
        for block in range(self.blocks):
            yield self._rows(block, [None], [None], [self.total[:, block * WIDTH:(block + 1) * WIDTH].tolist()])


def _counted(slots: _Slots, reps: int, extras: list[str]) -> Callable[[Batches], Batches]:
    """Sums of the slots from rows sorted by slot, y and x."""

    def per_partition(batches: Batches) -> Batches:
        now, at, blocks = None, None, -(-reps // WIDTH)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                slot, y, x = (batch.column(c).to_numpy() for c in ("slot", "y", "x"))
                w = np.zeros((len(y), blocks * WIDTH))
                w[:, :reps] = row_draws(batch.column("key").to_pylist(), reps)
                more = np.array([batch.column(c).to_numpy() for c in extras]).reshape(len(extras), len(y))
                cuts = np.append(_starts(slot, np.zeros(len(slot))), len(slot))
                for a, b in zip(cuts[:-1], cuts[1:]):
                    if at != slot[a]:
                        if now:
                            yield from now.end()
                        at = slot[a]
                        now = _Slot(*slots.group(int(at)), blocks, len(extras))
                    yield from now.add(y[a:b], x[a:b], w[a:b], more[:, a:b])
        if now:
            yield from now.end()

    return per_partition


def _lifted(bounds: np.ndarray) -> Callable[[Batches], Batches]:
    """Sums per x with ranks counted from the first row of all, placed by block and x."""

    def per_partition(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows:
                sums, x = _numbers(batch.column("sums")).copy(), batch.column("x").to_numpy()
                sums[:, WIDTH:] += sums[:, :WIDTH] * np.array(batch.column("before").to_pylist(), np.float64)
                slot = batch.column("block").to_numpy() * (len(bounds) + 1) + np.searchsorted(bounds, x, "left")
                order = np.lexsort((x, slot))
                first = _starts(slot[order], x[order])
                yield _batch(slot[order][first], x[order][first], np.add.reduceat(sums[order], first, axis=0))

    return per_partition


def _merged(batches: Batches) -> Batches:
    """One row per slot and value from sorted rows; the last value of a batch stays open for the next."""
    left = None
    for batch in batches:
        if not batch.num_rows:
            continue
        slot, v, sums = batch.column("slot").to_numpy(), batch.column("v").to_numpy(), _numbers(batch.column("sums"))
        if left:
            slot, v, sums = np.append(left[0], slot), np.append(left[1], v), np.concatenate([left[2], sums])
        first = _starts(slot, v)
        slot, v, sums = slot[first], v[first], np.add.reduceat(sums, first, axis=0)
        left = slot[-1:], v[-1:], sums[-1:]
        yield _batch(slot[:-1], v[:-1], sums[:-1])
    if left:
        yield _batch(*left)


def _slot_totals(batches: Batches) -> Batches:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        if batch.num_rows:
            slot, sums = batch.column("slot").to_numpy(), _numbers(batch.column("sums"))[:, :WIDTH]
            first = _starts(slot, np.zeros(len(slot)))
            for k, t in zip(slot[first].tolist(), np.add.reduceat(sums, first, axis=0)):
                total[k] = total.get(k, 0) + t
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.tolist() for t in total.values()], pa.list_(pa.float64()))], ["slot", "total"])


def _walk(batches: Batches) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Slot, values, sums and average ranks of sorted rows, at most a batch and a slot at a time."""
    now, total = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        slot, v, sums = batch.column("slot").to_numpy(), batch.column("v").to_numpy(), _numbers(batch.column("sums"))
        cuts = np.append(_starts(slot, np.zeros(len(slot))), len(slot))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if now != slot[a]:
                now, total = slot[a], np.array(batch.column("before")[int(a)].as_py(), np.float64)
            w = sums[a:b, :WIDTH]
            upto = total + np.cumsum(w, axis=0)
            total = upto[-1]
            yield int(now), v[a:b], sums[a:b], upto - w + (w + 1) / 2


_MOMENTS = ["n", "squares", "products"]


def _moments(batches: Batches) -> Batches:
    """Per slot and replicate the weights, the sum of squared ranks, and of products with the ranks that came along."""
    got: dict[int, np.ndarray] = {}
    for slot, _, sums, ranks in _walk(batches):
        w, brought = sums[:, :WIDTH], sums[:, WIDTH:]
        own = np.stack([w.sum(axis=0), (w * ranks * ranks).sum(axis=0), (brought * ranks).sum(axis=0) if brought.size else np.zeros(WIDTH)], axis=1)
        got[slot] = got.get(slot, 0) + own
    for slot, table in got.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(WIDTH, slot), pa.int32()), pa.array(np.arange(WIDTH), pa.int32()), *[pa.array(np.ascontiguousarray(c)) for c in table.T]],
                                         ["slot", "i", *_MOMENTS])


def _placed(rows: DataFrame, blocks: int, bounds: np.ndarray) -> DataFrame:
    """One row per slot and distinct value from such rows of many tasks, with the totals before its slot."""
    n = (len(bounds) + 1) * blocks
    placed = materialise(rows.repartitionById(n, "slot").sortWithinPartitions("slot", "v").mapInArrow(_merged, _PLACED))
    each = placed.mapInArrow(_slot_totals, "slot int, total array<double>").select("slot", F.posexplode("total").alias("i", "t"))
    line = Window.partitionBy(F.floor(F.col("slot") / (len(bounds) + 1)), "i").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    told = each.groupBy("slot", "i").agg(F.sum("t").alias("t")).withColumn("b", F.coalesce(F.sum("t").over(line), F.lit(0.0)))
    # One row of WIDTH numbers per slot, and about as many slots as shuffle partitions: that bounds what is broadcast.
    before = told.groupBy(F.col("slot").alias("_at")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "b"))), lambda s: s["b"]).alias("before"))
    return placed.join(F.broadcast(before), F.col("slot") == F.col("_at")).select("slot", "v", "sums", "before").sortWithinPartitions("slot", "v")


def spearman_replicates(df: DataFrame, key: str, x: str, y: str, reps: int, sums: Mapping[str, Column] | None = None) -> DataFrame:
    """`rep`, the weights `n` and `rho`: rank correlation of `x` and `y` with average ties in every replicate; null where a side has one value.

    Rows with a null or NaN on either side are left out. Both ranks count a row as often as it is drawn. `sums` names expressions,
    not null on the rows that stay, whose weighted sums come along.
    """
    extras, blocks = list(sums or {}), -(-reps // WIDTH)
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kept = df.where(ranked(x, y)).select(F.col(key).cast("string").alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), *[c.cast("double").alias(n) for n, c in (sums or {}).items()])
    kept = materialise_evenly(kept.withColumn("x", F.col("x") + 0.0).withColumn("y", F.col("y") + 0.0))
    per_block = max(1, -(-tasks // blocks))
    cut = lambda n: [k / n for k in range(1, n)] or [0.5]
    limits = kept.agg(F.percentile_approx("x", cut(per_block), 10_000).alias("x"), F.percentile_approx("y", cut(tasks), 10_000).alias("y")).first()
    bounds, slots = np.array(sorted(set(limits["x"] or [])), np.float64), _Slots(limits["y"] or [])
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(1 << 30)))
    more = "".join(f", {n} double" for n in extras)
    dealt = salted.mapInArrow(_dealt(slots), f"slot int, key string, x double, y double{more}, salt long").drop("salt")
    counted = materialise(dealt.repartitionById(slots.count, "slot").sortWithinPartitions("slot", "y", "x").mapInArrow(_counted(slots, reps, extras), _SUMS))

    each = counted.where("totals is not null").select("place", "shared", "block", F.posexplode(F.arrays_zip(*[F.col("totals")[k].alias(n) for k, n in enumerate(["_w", "_l", "_ll", *extras])])).alias("i", "t")).select("place", "shared", "block", "i", "t.*")
    whole = each.groupBy("place", "shared", "block", "i").agg(*[F.sum(c).alias(c) for c in ("_w", "_l", "_ll", *extras)])
    line = Window.partitionBy("block", "i").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    # One row per place and replicate. Rows of a shared value have one rank, in the middle of all their weights.
    lift = F.coalesce(F.sum("_w").over(line), F.lit(0.0)) + F.when(F.col("shared"), (F.col("_w") + 1) / 2).otherwise(0.0)
    lifted = materialise(whole.withColumn("_b", lift))
    of_y = lifted.groupBy((F.col("block") * WIDTH + F.col("i")).alias("rep")).agg(F.sum("_w").alias("n"), F.sum(F.expr("_ll + 2 * _b * _l + _b * _b * _w")).alias("_yy"), *[F.sum(c).alias(c) for c in extras])
    before = lifted.groupBy(F.col("place").alias("_at"), F.col("block").alias("_of")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "_b"))), lambda s: s["_b"]).alias("before"))
    rows = counted.where("x is not null").join(F.broadcast(before), (F.col("place") == F.col("_at")) & (F.col("block") == F.col("_of"))).select("block", "x", "sums", "before")
    of_x = _placed(rows.mapInArrow(_lifted(bounds), _PLACED), blocks, bounds)
    rep = (F.floor(F.col("slot") / (len(bounds) + 1)) * WIDTH + F.col("i")).cast("int").alias("rep")
    found = of_x.mapInArrow(_moments, f"slot int, i int, {', '.join(c + ' double' for c in _MOMENTS)}").groupBy(rep).agg(F.sum("squares").alias("_xx"), F.sum("products").alias("_xy"))
    table = of_y.join(found, "rep").where(F.col("rep") < reps)
    centre = F.col("n") * (F.col("n") + 1) * (F.col("n") + 1) / 4
    across, down = F.col("_xx") - centre, F.col("_yy") - centre
    # What rounding leaves of equal ranks is no spread.
    return table.select("rep", "n", *extras, F.when(F.least(across, down) > 1e-12 * centre, (F.col("_xy") - centre) / F.sqrt(across * down)).alias("rho"))


def ranked(x: str, y: str) -> Column:
    """Rows that have a rank on both sides."""
    x, y = F.col(x).cast("double"), F.col(y).cast("double")
    return x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
