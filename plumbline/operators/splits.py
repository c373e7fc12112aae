"""Fold assignment, split manifests and their leakage audit (D, C19, F4, F5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.keys import hash_fold, hex_number
from plumbline.operators.ranking import exact_quantiles, running
from plumbline.runtime import materialise


def row_folds(df: DataFrame, key: str, folds: int = 5) -> DataFrame:
    return df.withColumn("fold", hash_fold(F.col(key), folds))


def balanced_group_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """Groups dealt to folds in snake order of size, largest first; one row per group."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("rows"))
    line = running(sizes.withColumn("_one", F.lit(1)), [], ["-rows", group], {"_rank": ("sum", "_one")})
    spot = (F.col("_rank") - 1) % (2 * folds)
    return line.select(group, "rows", F.least(spot, 2 * folds - 1 - spot).cast("int").alias("fold"))


def content_folds(df: DataFrame, content: Column, folds: int = 5) -> DataFrame:
    """Fold from a content digest: equal content falls into one fold in every table."""
    return df.withColumn("group_id", content).withColumn("fold", (hex_number(F.col("group_id")) % folds).cast("int"))


#: Most groups whose cuts are broadcast, a few hundred kilobytes.
STRATA = 10_000


def time_block(df: DataFrame, by: Sequence[str], time: str, share: float) -> DataFrame:
    """Add `is_train`: rows at or before the `share` quantile of `time` inside their group.

    Few groups are joined by broadcast, so that no task gathers the rows of one.
    """
    cuts = materialise(exact_quantiles(df, by, time, {"_cut": share}))
    few = cuts.limit(STRATA + 1).count() <= STRATA
    return df.join(F.broadcast(cuts) if few else cuts, list(by)).withColumn("is_train", F.col(time) <= F.col("_cut")).drop("_cut")


def manifest(df: DataFrame, record: Column, group: Column, time: Column, protocol: str, fold: Column, role: Column) -> DataFrame:
    return df.select(F.lit(protocol).alias("protocol"), fold.cast("int").alias("fold"), role.alias("role"),
                     record.cast("string").alias("record_id"), group.cast("string").alias("group_id"), time.cast("double").alias("time"))


def k_fold_manifest(df: DataFrame, record: Column, group: Column, time: Column, protocol: str, fold: str, folds: int) -> DataFrame:
    """Every row once per outer fold, as test in its own fold and train elsewhere."""
    wide = df.withColumn("_outer", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    role = F.when(F.col(fold) == F.col("_outer"), "test").otherwise("train")
    return manifest(wide, record, group, time, protocol, F.col("_outer"), role)


#: Folds whose sides share one mask.
BLOCK = 60


def leakage_audit(rows: DataFrame) -> DataFrame:
    """Per protocol and fold: records and groups on both sides, groups whose training reaches past the test start, and test
    records that an inner split of the training groups would draw in.

    The folds of a record meet as bits of one mask, so a record is shuffled once per protocol and not once per fold.
    """
    tr, te = F.col("role") == "train", F.col("role") == "test"
    groups = materialise(rows.groupBy("protocol", "fold", "group_id").agg(
        F.max(tr.cast("int")).alias("a"), F.max(te.cast("int")).alias("b"), F.max(F.when(tr, F.col("time"))).alias("t_train"),
        F.min(F.when(te, F.col("time"))).alias("t_test")))
    late = (F.col("a") * F.col("b") == 1) & (F.col("t_train") >= F.col("t_test"))
    group_side = groups.groupBy("protocol", "fold").agg(F.sum(F.col("a") * F.col("b")).cast("long").alias("group_overlap"), F.count_if(late).alias("time_leaks"))

    block, mark, none = F.floor(F.col("fold") / BLOCK).cast("int").alias("_block"), F.expr(f"shiftleft(1L, pmod(fold, {BLOCK}))"), F.lit(0).cast("long")
    sides = rows.groupBy("protocol", block, "record_id", "group_id").agg(
        F.bit_or(F.when(tr, mark).otherwise(none)).alias("_tr"), F.bit_or(F.when(te, mark).otherwise(none)).alias("_te"))
    drawn = groups.where("a = 1").groupBy("protocol", block, "group_id").agg(F.bit_or(mark).alias("_in"))
    records = sides.join(drawn, ["protocol", "_block", "group_id"], "left").groupBy("protocol", "_block", "record_id").agg(
        F.bit_or("_tr").alias("_tr"), F.bit_or("_te").alias("_te"), F.bit_or(F.coalesce("_in", none)).alias("_in"))
    cells = records.groupBy("protocol", "_block", "_tr", "_te", "_in").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("_bit", F.explode(F.sequence(F.lit(0), F.lit(BLOCK - 1))))
    cells = cells.select("protocol", (F.col("_block") * BLOCK + F.col("_bit")).cast("int").alias("fold"), "n",
                         *[F.getbit(c, F.col("_bit")).cast("long").alias(c) for c in ("_tr", "_te", "_in")])
    record_side = cells.where("_tr + _te > 0").groupBy("protocol", "fold").agg(
        F.sum("n").alias("records"), F.sum(F.col("n") * F.col("_tr") * F.col("_te")).alias("record_overlap"),
        F.sum(F.col("n") * F.col("_te") * F.col("_in")).alias("inner_in_outer_test"))
    return record_side.join(group_side, ["protocol", "fold"]).select("protocol", "fold", "records", "record_overlap", "group_overlap", "time_leaks", "inner_in_outer_test")
