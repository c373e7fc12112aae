"""Line dedup by site-relative frequency, in DataFrame functions only.

A line of a host is boilerplate when it stands on at least `min_pages` pages of the host and on more than `percent`
per cent of them. A page counts once for each distinct line. A page holds few distinct lines, so at most
(mean lines per page) * 100 / percent lines of a host can pass the ratio: the list kept per host is bounded by that,
and it is written out first, so that Spark broadcasts it only when its files are small and otherwise joins by host
with skewed hosts split. Line counts are combined before the shuffle; lines are known by 96 bits of hash.

With `copies_once`, which the pipeline sets, rows of a host with equal whole texts count as one page, for a line as for the host, so
that the copies of one document do not make boilerplate of its lines. Only texts that stand twice are joined back, from
a table of their own, so that Spark can split the rows of a very frequent text. Without it repeated rows count as pages, as in the SQL.

Defined results: a null text stays null and has no lines; a null host is a host of its own; blank lines are never
dropped; an empty table gives an empty result; other columns are carried through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.storage import stored

PERCENT = 5
MIN_PAGES = 5


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _wordy(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("h"), F.crc32(line).alias("c"))


def _weighed(pages: DataFrame) -> DataFrame:
    """`pages` with `weight`, one over the rows of the host with the same whole text; all null texts of a host are one page."""
    known = F.struct(F.col("host"), F.col("text").isNull(), F.md5(F.coalesce("text", F.lit(""))))
    rows = pages.select("host", "text", F.sha2(F.to_json(known, {"ignoreNullFields": "false"}), 256).alias("digest"))
    twice = stored(rows.groupBy(F.col("digest").alias("same")).count().where("count > 1"), "twice")
    return rows.join(twice, F.col("digest") == F.col("same"), "left").select("host", "text", (F.lit(1.0) / F.coalesce("count", F.lit(1))).alias("weight"))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", percent: int = PERCENT, min_pages: int = MIN_PAGES, copies_once: bool = False) -> DataFrame:
    """One row per host that has boilerplate: `host` and `drop`, the keys of its lines over the ratio."""
    pages = docs.select(F.col(host).alias("host"), F.col(text).alias("text"))
    if copies_once:
        pages = _weighed(pages)
    else:
        pages = pages.withColumn("weight", F.lit(1))
    lines = pages.select("host", "weight", F.explode(F.array_distinct(F.filter(_lines(F.col("text")), _wordy))).alias("line"))
    often = (lines.select("host", "weight", _key(F.col("line")).alias("k")).groupBy("host", "k.h", "k.c")
             .agg(F.round(F.sum("weight")).cast("long").alias("pages")).where(F.col("pages") >= min_pages))
    totals = pages.groupBy("host").agg(F.round(F.sum("weight")).cast("long").alias("total")).withColumnRenamed("host", "of")
    over = often.join(totals, F.col("host").eqNullSafe(F.col("of"))).where(100 * F.col("pages") > percent * F.col("total"))
    return over.groupBy("host").agg(F.collect_list(F.struct("h", "c")).alias("drop"))


def mark(docs: DataFrame, host: str = "source", text: str = "text", percent: int = PERCENT, min_pages: int = MIN_PAGES, copies_once: bool = False) -> DataFrame:
    """`row` (all columns of `docs`), `kept_text`, `n_lines` and `n_dropped`."""
    listed = stored(boilerplate(docs, host, text, percent, min_pages, copies_once), "boilerplate").withColumnRenamed("host", "of")
    rows = docs.select(F.struct("*").alias("row"), F.col(host).alias("host"))
    joined = rows.join(listed, F.col("host").eqNullSafe(F.col("of")), "left").select("row", "drop", _lines(F.col(f"row.{text}")).alias("lines"))
    kept = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~(_wordy(x) & F.array_contains("drop", _key(x)))))
    out = joined.select("row", "lines", kept.alias("left"))
    return out.select("row", F.array_join("left", "\n").alias("kept_text"), F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
                      (F.size("lines") - F.size("left")).cast("long").alias("n_dropped"))


def clean(docs: DataFrame, host: str = "source", text: str = "text", percent: int = PERCENT, min_pages: int = MIN_PAGES, copies_once: bool = False) -> DataFrame:
    """`docs` with the boilerplate lines taken out of their texts and, where there is one, `n_chars` counted anew."""
    marked = mark(docs, host, text, percent, min_pages, copies_once)
    new = {text: F.col("kept_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("kept_text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return marked.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    return mark(docs).select("row.doc_id", "row.source", "n_lines", "n_dropped", F.col("kept_text").alias("text"))


LINES_SQL = f"""
l_lines as (select doc_id, source, u.line, u.i from docs, unnest(string_split(text, chr(10))) with ordinality u(line, i)),
l_wordy as (select distinct doc_id, source, line from l_lines where regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
l_total as (select source, count(*) as total from docs group by source),
l_drop as (select w.source, w.line from l_wordy w join l_total t on w.source is not distinct from t.source group by w.source, w.line, t.total
  having count(*) >= {MIN_PAGES} and 100 * count(*) > {PERCENT} * t.total),
l_flag as (select l.doc_id, l.line, l.i, d.line is not null as dropped from l_lines l left join l_drop d on l.source is not distinct from d.source and l.line = d.line),
l_new as (select doc_id, coalesce(string_agg(line, chr(10) order by i) filter (where not dropped), '') as kept_text, count(*) as n_lines,
  count(*) filter (where dropped) as n_dropped from l_flag group by doc_id)"""
ORACLE_SQL = f"""with docs as (select * from documents), {LINES_SQL}
select d.doc_id, d.source, coalesce(n.n_lines, 0)::bigint as n_lines, coalesce(n.n_dropped, 0)::bigint as n_dropped, n.kept_text as text
from docs d left join l_new n on d.doc_id = n.doc_id"""
