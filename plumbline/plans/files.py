"""Registered queries for sources and sinks (S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.plans.registry import query
from plumbline.runtime import scratch_dir
from plumbline.sources import files
from plumbline.sources.sinks import write_result

_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query("s1_csv_scan", "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, null::double as c_bad from "
                      "(select c_custkey::double as c_custkey, c_name, c_nationkey::double as c_nationkey, c_acctbal, c_mktsegment from customer)")
def s1(t):
    path = scratch_dir(t.spark, "csv")
    write_result(t.customer.withColumn("c_bad", F.col("c_name")), path, "csv")
    return files.read_csv(t.spark, path, [*_CUSTOMER, "c_bad"], ["c_custkey", "c_nationkey", "c_acctbal", "c_bad"])


@query("s2_json_lines", "select lang, count(*) as records, sum(length(text))::bigint as chars, count(distinct sha256(text)) as texts from documents group by 1")
def s2(t):
    path = scratch_dir(t.spark, "lines")
    t.documents.select("doc_id", "lang", "text").write.option("compression", "gzip").json(path)
    rows = files.read_json_lines(t.spark, path, "doc_id long, lang string, text string")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("records"), F.sum(F.length("text")).alias("chars"),
                                    F.count_distinct(F.sha2("text", 256)).alias("texts"))


@query("s3_parquet_scan", "select l_returnflag, count(*) as records, round(sum(l_quantity), 2) as quantity from lineitem where l_shipdate >= timestamp '1998-01-01' group by 1")
def s3(t):
    late = t.lineitem.where(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    return late.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("records"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("s4_json_documents", """
with d as (select user_id, count(*) as events, sum(json_extract(props, '$.k')::double) as total from events group by 1)
select count(*) as documents, 0::bigint as corrupt, sum(events)::bigint as events, sum(total) as total from d""")
def s4(t):
    """One JSON file per user, written as a folder of documents and read back by the document reader."""
    facts = F.struct(F.count(F.lit(1)).alias("events"), F.sum(F.get_json_object("props", "$.k").try_cast("double")).alias("total"))
    bodies = t.events.groupBy("user_id").agg(F.to_json(facts).alias("value"))
    path = scratch_dir(t.spark, "documents")
    bodies.write.partitionBy("user_id").text(path)
    docs = files.read_json_documents(t.spark, f"{path}/*").withColumn("doc", F.from_json("body", "events long, total double"))
    return docs.agg(F.count(F.lit(1)).alias("documents"), F.count_if("corrupt").alias("corrupt"), F.sum("doc.events").alias("events"), F.sum("doc.total").alias("total"))


@query("s5_union_with_source", """
select case when o_orderstatus = 'F' then 'final' else 'open' end as source_file, count(*) as records, round(sum(o_totalprice), 2) as total from orders group by 1""")
def s5(t):
    root = scratch_dir(t.spark, "union")
    final = F.col("o_orderstatus") == "F"
    t.orders.where(final).write.parquet(f"{root}/final")
    t.orders.where(~final).write.parquet(f"{root}/open")
    rows = files.read_with_source(t.spark, [f"{root}/final", f"{root}/open"])
    return rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("records"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("s6_pruned_scan", "select l_linestatus, round(avg(l_tax), 6) as mean_tax from lineitem group by 1")
def s6(t):
    return t.lineitem.select("l_linestatus", "l_tax").groupBy("l_linestatus").agg(F.round(F.avg("l_tax"), 6).alias("mean_tax"))


@query("s7_result_sinks", """
with r as (select c_mktsegment, count(*) as n, round(sum(c_acctbal), 2) as total from customer group by 1)
select form, c_mktsegment, n, total, 'real_observational' as evidence_level from r, (values ('parquet'), ('csv.gz'), ('json')) f(form)""")
def s7(t):
    result = t.customer.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))
    schema, out = "c_mktsegment string, n long, total double, evidence_level string", None
    for form in ("parquet", "csv.gz", "json"):
        path = scratch_dir(t.spark, "sink")
        write_result(result, path, form, "real_observational")
        reader = t.spark.read.schema(schema)
        back = reader.parquet(path) if form == "parquet" else reader.json(path) if form == "json" else reader.option("header", True).csv(path)
        back = back.withColumn("form", F.lit(form))
        out = back if out is None else out.unionByName(back)
    return out


@query("s8_file_inventory")
def s8(t):
    return files.file_inventory(t.spark, t.folder).select("file", "bytes", "sha256")


@query("s9_dataset_status")
def s9(t):
    names = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations ratings"
    patterns = [(n, f"^{n}\\.parquet$") for n in names.split()]
    return files.dataset_status(t.spark, patterns, files.file_inventory(t.spark, t.folder, digest=False))
