"""Table profiles and data contracts. Hot values are always counted map-side before they travel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numeric import correlation
from plumbline.functions.arrays import first_argmax
from plumbline.runtime import with_row


def table_profile(df: DataFrame) -> DataFrame:
    """Per column: rows, nulls, distinct values, numeric min and max; plus a `*` row with duplicate rows as nulls."""
    kinds = dict(df.dtypes)
    numeric = {c for c, k in kinds.items() if k in ("int", "bigint", "double", "float", "smallint", "tinyint")}
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("text"),
                 (F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")).alias("number")) for c in df.columns]))
    counted = df.select(cells.alias("x")).groupBy("x.column", "x.text").agg(F.count(F.lit(1)).alias("n"), F.max("x.number").alias("number"))
    per_column = counted.groupBy("column").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("text").isNull(), F.col("n")).otherwise(0)).alias("nulls"),
        F.count("text").alias("distinct"), F.min("number").alias("low"), F.max("number").alias("high"))
    whole = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n")).agg(
        F.lit("*").alias("column"), F.sum("n").alias("rows"), (F.sum("n") - F.count(F.lit(1))).alias("nulls"),
        F.count(F.lit(1)).alias("distinct"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    return per_column.unionByName(whole)


def json_profile(df: DataFrame, column: str) -> DataFrame:
    """Per key of a JSON object column: value kind, count, numeric range; broken texts appear as kind `corrupt`."""
    parsed = df.select(F.from_json(F.when(F.try_parse_json(column).isNotNull(), F.col(column)), "map<string,variant>").alias("m"))
    rows = parsed.select(F.explode_outer("m").alias("key", "v"))
    kind = F.schema_of_variant("v")
    label = (F.when(F.col("key").isNull(), "corrupt").when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "number").when(kind == "STRING", "string")
             .when(kind == "BOOLEAN", "boolean").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object")
             .otherwise("null"))
    number = F.try_variant_get("v", "$", "double")
    return rows.groupBy("key", label.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min(number).alias("low"), F.max(number).alias("high"))


def array_profile(df: DataFrame, column: str) -> DataFrame:
    """Length histogram, per-position range and argmax counts of an array column."""
    v = F.col(column).cast("array<double>")
    base = df.select(v.alias("v"))
    nothing = F.lit(None).cast("double")
    lengths = base.groupBy(F.size("v").alias("spot")).agg(F.count(F.lit(1)).alias("n"), nothing.alias("low"), nothing.alias("high"))
    x = F.when(~F.isnan("x") & (F.abs("x") < float("inf")), F.col("x"))
    spots = base.select(F.posexplode("v").alias("spot", "x")).groupBy("spot").agg(F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"))
    tops = (base.select(first_argmax(F.col("v")).cast("int").alias("spot")).where("spot is not null").groupBy("spot")
            .agg(F.count(F.lit(1)).alias("n"), nothing.alias("low"), nothing.alias("high")))
    return (lengths.select(F.lit("length").alias("part"), "*").unionByName(spots.select(F.lit("position").alias("part"), "*"))
            .unionByName(tops.select(F.lit("argmax").alias("part"), "*")))


def duplicate_groups(df: DataFrame, key: Column) -> DataFrame:
    return (df.groupBy(key.alias("content_key")).agg(F.count(F.lit(1)).alias("records")).where("records > 1"))


def key_overlap(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column) -> DataFrame:
    """Counts of keys on each side and on both, from one aggregation over the tagged union."""
    tagged = (left.select(left_key.cast("string").alias("k"), F.lit(1).alias("l"), F.lit(0).alias("r"))
              .unionByName(right.select(right_key.cast("string").alias("k"), F.lit(0).alias("l"), F.lit(1).alias("r"))))
    sides = tagged.where("k is not null").groupBy("k").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return sides.agg(
        F.count_if(F.expr("l > 0")).alias("left_count"), F.count_if(F.expr("r > 0")).alias("right_count"),
        F.count_if(F.expr("l > 0 and r > 0")).alias("overlap_count"), F.coalesce(F.sum("l"), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("right_rows"))


def overlap_status(overlap: DataFrame) -> DataFrame:
    return overlap.select("left_count", "right_count", "overlap_count",
                          F.when(F.col("overlap_count") > 0, "risk").otherwise("pass").alias("status"))


def match_coverage(overlap: DataFrame) -> DataFrame:
    hit = F.col("overlap_count")
    return overlap.select("left_count", "right_count", hit.alias("matched"),
                          F.round(100.0 * hit / F.col("left_count"), 6).alias("left_percent"),
                          F.round(100.0 * hit / F.col("right_count"), 6).alias("right_percent"))


def pairing_contract(overlap: DataFrame) -> DataFrame:
    """One-to-one verdict: keys unique on both sides and every key matched."""
    return overlap.select(
        "left_rows", "right_rows", (F.col("left_rows") == F.col("left_count")).alias("left_unique"),
        (F.col("right_rows") == F.col("right_count")).alias("right_unique"), F.col("overlap_count").alias("matched_keys"),
        ((F.col("left_rows") == F.col("left_count")) & (F.col("right_rows") == F.col("right_count"))
         & (F.col("overlap_count") == F.col("left_count")) & (F.col("overlap_count") == F.col("right_count"))).alias("one_to_one"))


def join_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that fails the job when either side repeats or misses a key."""
    many = [c for c in right.columns if c != key]
    l = left.groupBy(key).agg(F.count(F.lit(1)).alias("_ln"), *[F.any_value(c).alias(c) for c in left.columns if c != key])
    r = right.groupBy(key).agg(F.count(F.lit(1)).alias("_rn"), *[F.any_value(c).alias(c) for c in many])
    both = l.join(r, key, "full")
    fine = (F.col("_ln") == 1) & (F.col("_rn") == 1)
    guard = F.when(F.coalesce(fine, F.lit(False)), F.col(key)).otherwise(
        F.raise_error(F.concat(F.lit("key is not one-to-one: "), F.col(key).cast("string"))).cast(dict(left.dtypes)[key]))
    return both.select(guard.alias(key), *[c for c in left.columns if c != key], *many)


def mixture_contract(shares: DataFrame, parts: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.col(p) for p in parts])
    total = F.aggregate(F.transform(cells, lambda x: F.coalesce(x, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    return shares.agg(F.count(F.lit(1)).alias("rows"), F.max(F.abs(total - 1)).alias("max_simplex_error"),
                      F.sum(F.size(F.filter(cells, lambda x: x < 0))).alias("negative_values"),
                      F.sum(F.size(F.filter(cells, lambda x: x.isNull()))).alias("missing_values"))


def value_agreement(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """Shared keys whose values agree within atol + rtol * |right|."""
    r = right.withColumnRenamed(value, "_right")
    close = F.abs(F.col(value) - F.col("_right")) <= atol + rtol * F.abs("_right")
    return left.join(r, list(keys)).agg(F.count(F.lit(1)).alias("overlap_keys"), F.count_if(close).alias("identical"),
                                        F.count_if(~close).alias("conflicting"))


def identity_audit(df: DataFrame, stored: Column, rebuilt: Column) -> list[Column]:
    """Aggregates comparing a stored value with its formula."""
    gap = F.abs(stored - rebuilt)
    return [F.count(F.lit(1)).alias("rows"), F.round(F.avg(stored - rebuilt), 4).alias("mean_difference"),
            F.round(F.max(gap), 4).alias("max_absolute"), F.round(F.max(gap / F.abs(rebuilt)), 6).alias("max_relative"),
            F.round(correlation(stored, rebuilt), 6).alias("correlation")]


def is_cartesian(df: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Whether the distinct points fill the product of the distinct levels."""
    points = df.groupBy(*axes).agg(F.count(F.lit(1)).alias("_n"))
    levels = [F.count_distinct(a).alias(f"levels_{a}") for a in axes]
    product = F.lit(1)
    for a in axes:
        product = product * F.col(f"levels_{a}")
    return points.agg(F.count(F.lit(1)).alias("points"), *levels).withColumn("cartesian", F.col("points") == product)


def support_box(df: DataFrame, box_rows: Column, columns: Sequence[str]) -> DataFrame:
    """Flag every row as inside or outside the box spanned by the rows where `box_rows` holds."""
    box = df.where(box_rows).agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("low", F.min), ("high", F.max))])
    inside = F.lit(True)
    for c in columns:
        inside = inside & F.col(c).between(F.col(f"{c}_low"), F.col(f"{c}_high"))
    return with_row(df, box).withColumn("in_box", inside)


def missing_levels(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per table: rows, missing cells, columns without any value."""
    out = None
    for name, df in tables.items():
        counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"c{i}") for i, c in enumerate(df.columns)])
        filled = F.array(*[F.col(f"c{i}") for i in range(len(df.columns))])
        row = counts.select(
            F.lit(name).alias("table"), "rows",
            (F.col("rows") * len(df.columns) - F.aggregate(filled, F.lit(0).cast("long"), lambda a, x: a + x)).alias("missing_cells"),
            F.size(F.filter(filled, lambda x: x == 0)).cast("long").alias("empty_columns"))
        out = row if out is None else out.unionByName(row)
    return out
