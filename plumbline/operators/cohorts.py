"""Entity cohorts, records and arrivals (E)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.ranking import running
from plumbline.runtime import with_row


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows per group. Spark keeps k rows per task before the shuffle, so a hot group stays small."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def earliest_per_entity(df: DataFrame, entity: str, date: str, tie: str) -> DataFrame:
    """Earliest row per entity, undated rows last; a map-side aggregate instead of a sort per entity."""
    first = F.struct(F.col(date).isNull(), F.col(date), F.col(tie))
    return df.groupBy(entity).agg(F.min_by(F.struct(*df.columns), first).alias("_r")).select("_r.*")


def duplicate_entities(df: DataFrame, entity: str, date: str, score: str, name: str) -> DataFrame:
    named = df.groupBy(entity, name).agg(F.count(F.lit(1)).alias("n"), F.min(date).alias("a"), F.max(date).alias("b"), F.min(score).alias("lo"), F.max(score).alias("hi"))
    return named.groupBy(entity).agg(F.sum("n").alias("records"), F.min("a").alias("first_date"), F.max("b").alias("last_date"), F.min("lo").alias("score_min"),
                                     F.max("hi").alias("score_max"), F.count(name).alias("names")).where("records > 1")


def cohort_summary(df: DataFrame, scopes: Mapping[str, Column], stratum: str, entity: str, date: str) -> DataFrame:
    """Counts per scope and stratum with an `all` level. Entities are merged map-side before they are counted."""
    names = F.filter(F.array(*[F.when(cond, name) for name, cond in scopes.items()]), lambda x: x.isNotNull())
    rows = df.select(entity, date, stratum, F.explode(names).alias("scope"))
    rows = rows.select(entity, date, "scope", F.explode(F.array(F.col(stratum), F.lit("all"))).alias("stratum"))
    per = rows.groupBy("scope", "stratum", entity).agg(F.count(F.lit(1)).alias("n"), F.min(date).alias("a"), F.max(date).alias("b"))
    return per.groupBy("scope", "stratum").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("unique_entities"),
                                               F.min("a").alias("date_min"), F.max("b").alias("date_max"))


def latest_valid_revision(df: DataFrame, folder: str, time: str, tie: str, corrupt: str) -> DataFrame:
    """Newest row of every folder without a corrupt row."""
    best = df.groupBy(folder).agg(F.bool_or(corrupt).alias("_bad"), F.max_by(F.struct(*df.columns), F.struct(time, tie)).alias("_r"))
    return best.where("not _bad").select("_r.*")


def running_frontier(df: DataFrame, by: Sequence[str], order: Sequence[str], score: str) -> DataFrame:
    """Cumulative maximum and record flag in time order; a busy group is spread over many tasks."""
    line = running(df, by, order, {"frontier": ("max", score)})
    return line.withColumn("is_record", F.col("frontier_before").isNull() | (F.col(score) > F.col("frontier_before"))).drop("frontier_before", "frontier_total")


def arrival_rates(daily: DataFrame, windows: Mapping[str, int | None], least_rows: int, least_days: int) -> DataFrame:
    """Rows per day over trailing windows of a per-day count table; a thin window falls back to the whole record."""
    full = daily.groupBy("unit").agg(F.max("day").alias("_last"))
    label = F.explode(F.array(*[F.struct(F.lit(k).alias("window"), F.lit(v).cast("int").alias("days")) for k, v in windows.items()]))
    rows = daily.join(full, "unit").select("unit", "day", "n", "_last", label.alias("w"))
    inside = F.col("w.days").isNull() | (F.col("day") >= F.date_sub(F.col("_last"), F.col("w.days")))
    sums = rows.groupBy("unit", F.col("w.window").alias("window")).agg(
        F.sum(F.when(inside, F.col("n"))).alias("n_in"), F.min(F.when(inside, F.col("day"))).alias("a_in"), F.max(F.when(inside, F.col("day"))).alias("b_in"),
        F.sum("n").alias("n_all"), F.min("day").alias("a_all"), F.max("day").alias("b_all"))
    thin = F.col("n_in") < least_rows
    pick = lambda c: F.when(thin, F.col(c + "_all")).otherwise(F.col(c + "_in"))
    days = F.greatest(F.datediff(pick("b"), pick("a")) + 1, F.lit(least_days))
    return sums.select("unit", "window", pick("n").alias("events"), days.alias("window_days"), (pick("n") / days).alias("rate_day"))


def bucket_counts(df: DataFrame, by: Sequence[str], time: str, days: int) -> DataFrame:
    """Counts per bucket of `days`, from the first to the last day of all rows, empty buckets included."""
    ends = df.agg(F.min(F.to_date(time)).alias("_a"), F.max(F.to_date(time)).alias("_b"))
    spot = F.floor(F.datediff(F.to_date(time), F.col("_a")) / days)
    counts = with_row(df, ends).groupBy(*by, spot.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    line = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.datediff("_b", "_a") / days)))
    grid = with_row(counts.select(*by).distinct(), ends).select(*by, line.alias("bucket"))
    return grid.join(counts, [*by, "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def dispersion(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean, variance, Fano factor and negative-binomial size of bucket counts."""
    m, v = F.col("mean"), F.col("variance")
    base = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("buckets"), F.avg("n").alias("mean"), F.var_samp("n").alias("variance"))
    return base.withColumn("fano", F.when(m > 0, v / m)).withColumn("nb_size", F.when((v > m + 1e-12) & (m > 0), m * m / (v - m)))


def family_weights(df: DataFrame, family: str) -> DataFrame:
    """Inverse-frequency weight per family, scaled so that the mean over rows is one: n / (families * size)."""
    sizes = df.groupBy(family).agg(F.count(F.lit(1)).alias("size"))
    whole = sizes.agg(F.sum("size").alias("_n"), F.count(F.lit(1)).alias("_f"))
    return with_row(sizes, whole).select(family, "size", (F.col("_n") / (F.col("_f") * F.col("size"))).alias("weight"))


def endpoints(df: DataFrame, by: Sequence[str], score: str, date: str, tie: str, cutoff: Column, keep: Sequence[str]) -> DataFrame:
    """Best row up to a cutoff and best row overall per group; ties go to the earliest row."""
    order = F.struct(F.col(score), -F.unix_micros(F.col(date).cast("timestamp")), -F.col(tie))
    row = F.struct(*keep)
    return df.groupBy(*by).agg(F.max_by(F.when(F.col(date) <= cutoff, row), F.when(F.col(date) <= cutoff, order)).alias("start"),
                               F.max_by(row, order).alias("end")).where("start is not null")


def shapley_split(f, x0: Column, x1: Column, t0: Column, t1: Column) -> tuple[Column, Column]:
    """Average contribution of each of two factors to f(x1, t1) - f(x0, t0)."""
    a, b, c, d = f(x0, t0), f(x1, t0), f(x0, t1), f(x1, t1)
    return 0.5 * ((b - a) + (d - c)), 0.5 * ((c - a) + (d - b))
