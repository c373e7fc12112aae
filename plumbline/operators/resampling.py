"""Bootstrap intervals from hash-derived Poisson weights (B).

A replicate is a weighting of rows or groups; replicate sums combine map-side, so the shuffle carries one row per
(group, replicate) and task whatever the table size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.keys import with_draws
from plumbline.operators.inference import agreement
from plumbline.runtime import materialise_evenly

CI = {"low": 0.025, "high": 0.975}


def replicate_table(df: DataFrame, key: str, by: Sequence[str], reps: int, statistics: Mapping[str, Column]) -> DataFrame:
    """Statistics per (group, replicate); each statistic is an aggregate over rows carrying the draw weight `w`."""
    drawn = with_draws(df, F.col(key), reps)
    return drawn.groupBy(*by, "rep").agg(*[c.alias(n) for n, c in statistics.items()])


def percentiles(table: DataFrame, by: Sequence[str], names: Sequence[str], probs: Mapping[str, float] = CI) -> DataFrame:
    """Quantiles over replicates: at most `reps` values per group."""
    return table.groupBy(*by).agg(*[F.expr(f"percentile({n}, {p})").alias(f"{n}_{tag}") for n in names for tag, p in probs.items()])


def weighted_mean(x: Column, w: Column) -> Column:
    return F.sum(w * x) / F.sum(w)


def mean_intervals(df: DataFrame, key: str, by: Sequence[str], value: str, weight: str, reps: int) -> DataFrame:
    w, v, k = F.col("w"), F.col(value), F.col(weight)
    table = replicate_table(df, key, by, reps, {"mean": weighted_mean(v, w), "weighted_mean": F.sum(w * k * v) / F.sum(w * k)})
    return percentiles(table, by, ["mean", "weighted_mean"])


def group_bootstrap(df: DataFrame, group: str, by: Sequence[str], sums: Mapping[str, Column], statistics: Mapping[str, Column], reps: int) -> DataFrame:
    """Whole groups resampled: rows collapse to group sums first, draws apply to groups.

    Group sums are small and many draws follow for each, so they are dealt evenly over the cores before.
    """
    cells = materialise_evenly(df.groupBy(group, *by).agg(*[c.alias(n) for n, c in sums.items()]))
    return replicate_table(cells, group, by, reps, statistics)


def kappa_intervals(df: DataFrame, key: str, a: str, b: str, reps: int) -> DataFrame:
    """Interval of the quadratic kappa; replicates are weighted confusion tables."""
    drawn = with_draws(df.select(key, F.col(a).alias("a"), F.col(b).alias("b")), F.col(key), reps)
    cells = drawn.groupBy("rep", "a", "b").agg(F.sum("w").alias("n"))
    table = agreement(cells, ["rep"]).where("kappa_quadratic is not null")
    return percentiles(table, [], ["kappa_quadratic", "kappa"])


def slope_product(df: DataFrame, key: str, x: str, y: str, z: str, reps: int) -> DataFrame:
    """Replicates of slope(y on x), slope(z on y) and their product, from weighted sums."""
    w = F.col("w").cast("double")
    c = {n: F.col(n).cast("double") for n in (x, y, z)}

    def slope(p: str, q: str) -> Column:
        n = F.sum(w)
        return (n * F.sum(w * c[p] * c[q]) - F.sum(w * c[p]) * F.sum(w * c[q])) / (n * F.sum(w * c[p] * c[p]) - F.sum(w * c[p]) ** 2)

    return replicate_table(df, key, [], reps, {"slope": slope(x, y), "elasticity": slope(y, z), "product": slope(x, y) * slope(y, z)})
