"""Prediction metrics and record backtests (V)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.runtime import with_row

METRICS = ["mae", "rmse", "r2", "bias", "log_rmse"]


def error_metrics(y: Column, p: Column) -> list[Column]:
    """n, mae, rmse, r2, bias and log rmse in one aggregation; r2 uses the centred variance."""
    e, both = p - y, y.isNotNull() & p.isNotNull()
    e = F.when(both, e)
    ratio = F.when(both & (y > 0) & (p > 0), F.ln(p) - F.ln(y))
    spread = F.var_pop(F.when(both, y)) * F.count(e)
    return [F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
            F.when(spread > 0, 1 - F.sum(e * e) / spread).alias("r2"), F.avg(e).alias("bias"), F.sqrt(F.avg(ratio * ratio)).alias("log_rmse")]


def domain_metrics(df: DataFrame, domain: str, y: str, p: str) -> DataFrame:
    """Metrics per domain, their plain mean (`macro`) and pooled rows (`micro`)."""
    per = df.groupBy(F.col(domain).alias("domain")).agg(*error_metrics(F.col(y), F.col(p)))
    macro = per.agg(F.sum("n").alias("n"), *[F.avg(m).alias(m) for m in METRICS]).withColumn("domain", F.lit("macro"))
    micro = df.agg(*error_metrics(F.col(y), F.col(p))).withColumn("domain", F.lit("micro"))
    return per.unionByName(macro).unionByName(micro)


def skill_scores(test: DataFrame, train: DataFrame, domain: str, y: str, p: str) -> DataFrame:
    """1 - mae / mae of the training mean, and of the test's own mean, per domain."""
    means = train.groupBy(domain).agg(F.avg(y).alias("_train")).join(test.groupBy(domain).agg(F.avg(y).alias("_own")), domain)
    gap = lambda c: F.avg(F.abs(F.col(y) - F.col(c)))
    out = test.join(means, domain).groupBy(F.col(domain).alias("domain")).agg(gap(p).alias("mae_model"), gap("_train").alias("mae_train_mean"), gap("_own").alias("mae_own_mean"))
    return out.withColumn("skill_vs_train_mean", 1 - F.col("mae_model") / F.col("mae_train_mean")).withColumn("skill_vs_own_mean", 1 - F.col("mae_model") / F.col("mae_own_mean"))


def pinball(y: Column, p: Column, q: float) -> Column:
    return F.greatest(q * (y - p), (q - 1) * (y - p))


def interval_score(y: Column, low: Column, high: Column, alpha: float) -> Column:
    return high - low + F.when(y < low, 2 / alpha * (low - y)).when(y > high, 2 / alpha * (y - high)).otherwise(0.0)


def record_cases(df: DataFrame, by: Sequence[str], date: str, score: str, cutoffs: Sequence[str], horizons: Sequence[int]) -> DataFrame:
    """Per group, cutoff and horizon: record before the cutoff, record at the window end, and window completeness.

    Rows are first reduced to one maximum per group and day, so each cutoff reads a calendar-sized table.
    """
    daily = df.groupBy(*by, F.to_date(date).alias("_day")).agg(F.max(score).alias("_top"))
    last = daily.agg(F.max("_day").alias("_last"))
    cells = F.explode(F.array(*[F.struct(F.lit(c).cast("date").alias("cutoff"), F.lit(h).alias("horizon_days")) for c in cutoffs for h in horizons]))
    rows = with_row(daily, last).select("*", cells.alias("_k")).select("*", "_k.*")
    requested = F.date_add("cutoff", F.col("horizon_days"))
    rows = rows.withColumn("requested_end", requested).withColumn("observed_end", F.least(requested, F.col("_last")))
    out = rows.groupBy(*by, "cutoff", "horizon_days", "requested_end", "observed_end").agg(
        F.max(F.when(F.col("_day") < F.col("cutoff"), F.col("_top"))).alias("persistence"),
        F.max(F.when(F.col("_day") <= F.col("observed_end"), F.col("_top"))).alias("truth"))
    out = out.where("persistence is not null")
    return (out.withColumn("actual_days", F.datediff("observed_end", "cutoff")).withColumn("complete_window", F.col("requested_end") <= F.col("observed_end"))
            .withColumn("record_updated", F.col("truth") > F.col("persistence") + 1e-12))


def subset_metrics(df: DataFrame, subsets: Mapping[str, Column], measures: Sequence[Column]) -> DataFrame:
    """Aggregates per model and named subset; a row joins every subset whose predicate holds."""
    names = F.filter(F.array(*[F.when(cond, name) for name, cond in subsets.items()]), lambda x: x.isNotNull())
    return df.withColumn("subset", F.explode(names)).groupBy("model", "subset").agg(*measures)
