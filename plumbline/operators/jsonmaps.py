"""Nested evaluation documents: dynamic-key JSON maps to rows (P16, P17, S4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numeric import safe_number

DOCUMENT = ("results map<string,map<string,string>>, `n-samples` map<string,map<string,double>>, "
            "group_subtasks map<string,array<string>>")


def first_metric(metrics: Column) -> Column:
    """First numeric (key, value) that is neither the alias nor a standard error."""
    numbers = F.transform(F.map_entries(metrics), lambda e: F.struct(e["key"].alias("key"), safe_number(e["value"]).alias("value")))
    usable = F.filter(numbers, lambda e: (e["key"] != "alias") & ~e["key"].contains("stderr") & e["value"].isNotNull())
    return F.get(usable, F.lit(0))


def parse_documents(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Parse one JSON text per row; a broken text gives NULL and `corrupt` = true."""
    broken = F.try_parse_json(column).isNull() & F.col(column).isNotNull()
    return df.withColumn("corrupt", broken).withColumn("doc", F.when(~broken, F.from_json(column, schema)))


def evaluation_documents(events: DataFrame) -> DataFrame:
    """One evaluation document per user: mean value per event type, its row count, and the grouping of types."""
    cells = events.groupBy("user_id", "event_type").agg(F.avg("value").alias("acc"), F.count(F.lit(1)).alias("n"))
    group = F.when(F.col("event_type").isin("view", "click"), "browse").otherwise("act")
    per_user = cells.groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct("event_type", F.create_map(
            F.lit("alias"), F.col("event_type"), F.lit("acc"), F.col("acc").cast("string"),
            F.lit("acc_stderr"), F.lit("0.1"))))).alias("results"),
        F.map_from_entries(F.collect_list(F.struct("event_type", F.create_map(F.lit("effective"), F.col("n"))))).alias("n-samples"),
        F.collect_list(F.when(group == "browse", F.col("event_type"))).alias("_b"),
        F.collect_list(F.when(group == "act", F.col("event_type"))).alias("_a"))
    grouped = per_user.withColumn("group_subtasks", F.create_map(F.lit("browse"), F.col("_b"), F.lit("act"), F.col("_a")))
    return grouped.select("user_id", F.to_json(F.struct("results", "n-samples", "group_subtasks")).alias("body"))


def task_rows(documents: DataFrame, ids: list[str], column: str = "body") -> DataFrame:
    """Long (group, task, metric, score, effective_n) rows; tasks missing from `results` are skipped."""
    doc = parse_documents(documents, column, DOCUMENT).where("not corrupt").select(
        *ids, F.col("doc.results").alias("r"), F.col("doc.n-samples").alias("s"), F.explode("doc.group_subtasks").alias("task_group", "tasks"))
    rows = doc.select(*ids, "r", "s", "task_group", F.explode("tasks").alias("task")).where(F.map_contains_key("r", F.col("task")))
    best = first_metric(F.try_element_at("r", F.col("task")))
    weight = F.try_element_at(F.try_element_at("s", F.col("task")), F.lit("effective"))
    return rows.select(*ids, "task_group", "task", best["key"].alias("metric"), best["value"].alias("score"), weight.alias("effective_n"))
