"""Running totals, ranks, quantiles and reference ECDFs that never gather one group in one task.

A window partitioned by a low-cardinality key sends a whole group to one task. Here rows are first collapsed
to distinct values, range-placed over (group, value), and the placement is written out. Each slot then needs
only the totals of the slots before it, a table with one row per (slot, group).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.runtime import materialise

_FOLDS = {"sum": F.sum, "max": F.max, "min": F.min}


def _merge(kind: str, left: Column, right: Column) -> Column:
    if kind == "sum":
        return F.coalesce(left, F.lit(0)) + F.coalesce(right, F.lit(0))
    return F.greatest(left, right) if kind == "max" else F.least(left, right)


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], folds: Mapping[str, tuple[str, str]],
            following: str | None = None) -> DataFrame:
    """Add running folds per group: `name` up to and with the row, `name_before`, and `name_total`.

    `order` names must identify a row inside a group; prefix one with "-" for descending order.
    `following` names an ascending numeric order column whose next value is added as `<name>_next`.
    """
    by = list(by)
    sort = [F.col(o[1:]).desc() if o.startswith("-") else F.col(o).asc() for o in order]
    placed = materialise(df.repartitionByRange(*[F.col(b) for b in by], *sort)
                         .withColumn("_slot", F.spark_partition_id()))
    single = placed.rdd.getNumPartitions() == 1
    if single:
        group, joined = by, placed
    else:
        group, joined = ["_slot", *by], _carry(placed, by, folds, following)

    inside = Window.partitionBy(*group).orderBy(*sort)
    here = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prior = inside.rowsBetween(Window.unboundedPreceding, -1)
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = [F.col(c) for c in df.columns]
    for name, (kind, col) in folds.items():
        fold = _FOLDS[kind](col)
        zero = F.lit(0) if kind == "sum" else F.lit(None)
        before, total = F.coalesce(fold.over(prior), zero), fold.over(whole)
        current = fold.over(here)
        if not single:
            current, before = _merge(kind, F.col(f"_off_{name}"), current), _merge(kind, F.col(f"_off_{name}"), before)
            total = F.coalesce(F.col(f"_all_{name}"), total)
        out += [current.alias(name), before.alias(f"{name}_before"), total.alias(f"{name}_total")]
    if following:
        ahead = F.lead(following).over(inside)
        out.append((ahead if single else F.coalesce(ahead, F.col("_beyond"))).alias(f"{following}_next"))
    return joined.select(*out)


def _carry(placed: DataFrame, by: list[str], folds: Mapping[str, tuple[str, str]], following: str | None) -> DataFrame:
    """Attach what earlier slots add to a group that spans slots.

    Placement is by range, so a slot shares at most its first and last group with other slots: the carried table has
    at most two rows per slot and is broadcast. Every other group is whole inside its slot and needs nothing.
    """
    per_slot = [_FOLDS[k](c).alias(f"_in_{n}") for n, (k, c) in folds.items()]
    if following:
        per_slot.append(F.min(following).alias("_first"))
    slots = placed.groupBy("_slot", *by).agg(*per_slot)
    line = Window.partitionBy(*by).orderBy("_slot")
    earlier = line.rowsBetween(Window.unboundedPreceding, -1)
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = [F.count(F.lit(1)).over(whole).alias("_spread")]
    for name, (kind, _) in folds.items():
        carried.append(_FOLDS[kind](f"_in_{name}").over(earlier).alias(f"_off_{name}"))
        carried.append(_FOLDS[kind](f"_in_{name}").over(whole).alias(f"_all_{name}"))
    if following:
        carried.append(F.lead("_first").over(line).alias("_beyond"))
    spanning = slots.select(F.col("_slot").alias("_at"), *[F.col(b).alias(f"_by_{b}") for b in by], *carried).where("_spread > 1")
    match = F.col("_slot") == F.col("_at")
    for b in by:
        match = match & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    return placed.join(F.broadcast(spanning), match, "left")


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float],
                    weight: str | None = None) -> DataFrame:
    """Linear-interpolation quantiles per group; `weight` is an integer row count."""
    by = list(by)
    n = F.sum(weight) if weight else F.count(F.lit(1))
    cells = (df.where(F.col(value).isNotNull() & ~F.isnan(value))
             .groupBy(*by, F.col(value).cast("double").alias("_v")).agg(n.alias("_n")))
    line = running(cells, by, ["_v"], {"_c": ("sum", "_n")})
    keep, picks = F.lit(False), []
    for name, p in probs.items():
        spot = F.lit(p) * (F.col("_c_total") - 1)
        low, high = F.floor(spot), F.ceil(spot)
        at_low = (F.col("_c_before") <= low) & (low < F.col("_c"))
        at_high = (F.col("_c_before") <= high) & (high < F.col("_c"))
        keep = keep | at_low | at_high
        a, b = F.max(F.when(at_low, F.col("_v"))), F.max(F.when(at_high, F.col("_v")))
        picks.append((a + F.max(spot - low) * (b - a)).alias(name))
    return line.where(keep).groupBy(*by).agg(*picks)


def reference_ecdf(df: DataFrame, by: Sequence[str], value: str, is_ref: str, out: str) -> DataFrame:
    """Score of each distinct (group, value) against the reference rows of its group.

    (count of reference values <= v + 0.5) / (n + 1), held inside [1/(n+1), n/(n+1)]; NULL when n = 0.
    """
    cells = (df.where(F.col(value).isNotNull() & ~F.isnan(value))
             .groupBy(*by, value).agg(F.sum(F.col(is_ref).cast("long")).alias("_r")))
    line = running(cells, by, [value], {"_c": ("sum", "_r")})
    n = F.col("_c_total")
    score = F.greatest(1.0 / (n + 1), F.least(n / (n + 1), (F.col("_c") + 0.5) / (n + 1)))
    return line.select(*by, value, F.when(n > 0, score).alias(out))


def average_ranks(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Average-tie rank of each distinct (group, value)."""
    cells = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    line = running(cells, by, [value], {"_c": ("sum", "_n")})
    return line.select(*by, value, F.col("_n").alias(f"{out}_ties"), F.col("_c_before").alias(f"{out}_below"),
                       (F.col("_c_before") + (F.col("_n") + 1) / 2).alias(out), F.col("_c_total").alias(f"{out}_n"))


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str, out: str = "spearman") -> DataFrame:
    """Rank correlation with average ties per group, from collapsed (x, y) cells."""
    by = list(by)
    cells = (df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
             .groupBy(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
             .agg(F.count(F.lit(1)).alias("_n")))
    cells = materialise(cells)
    axes = (cells.select(*by, "_n", F.explode(F.array(
        F.struct(F.lit("x").alias("axis"), F.col("_x").alias("v")),
        F.struct(F.lit("y").alias("axis"), F.col("_y").alias("v")))).alias("p"))
        .groupBy(*by, F.col("p.axis").alias("_axis"), F.col("p.v").alias("_v")).agg(F.sum("_n").alias("_n")))
    line = running(axes, [*by, "_axis"], ["_v"], {"_c": ("sum", "_n")})
    centred = line.select(*by, "_axis", "_v", (F.col("_c_before") + (F.col("_n") + 1) / 2
                                               - (F.col("_c_total") + 1) / 2).alias("_d"))
    rx = centred.where("_axis = 'x'").select(*by, F.col("_v").alias("_x"), F.col("_d").alias("_dx"))
    ry = centred.where("_axis = 'y'").select(*by, F.col("_v").alias("_y"), F.col("_d").alias("_dy"))
    both = cells.join(rx, [*by, "_x"]).join(ry, [*by, "_y"])
    n = F.col("_n")
    top = F.sum(n * F.col("_dx") * F.col("_dy"))
    size = F.sqrt(F.sum(n * F.col("_dx") ** 2) * F.sum(n * F.col("_dy") ** 2))
    return both.groupBy(*by).agg(F.when(size > 0, top / size).alias(out), F.sum("_n").alias(f"{out}_n"))


def two_sample_distances(df: DataFrame, by: Sequence[str], value: str, side: str) -> DataFrame:
    """KS statistic and Wasserstein-1 distance between rows with `side` true and false, per group."""
    by = list(by)
    flag = F.col(side).cast("long")
    cells = (df.where(F.col(value).isNotNull())
             .groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.sum(flag).alias("_a"), F.sum(1 - flag).alias("_b")))
    line = running(cells, by, ["_v"], {"_ca": ("sum", "_a"), "_cb": ("sum", "_b")}, following="_v")
    gap = F.abs(F.col("_ca") / F.col("_ca_total") - F.col("_cb") / F.col("_cb_total"))
    both = (F.col("_ca_total") > 0) & (F.col("_cb_total") > 0)
    return line.where(both).groupBy(*by).agg(
        F.max("_ca_total").alias("n_a"), F.max("_cb_total").alias("n_b"), F.max(gap).alias("ks_statistic"),
        F.sum(gap * F.coalesce(F.col("_v_next") - F.col("_v"), F.lit(0.0))).alias("wasserstein"))
