"""Registered queries for profiles, contracts (C) and splits (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.keys import hash_fold, name_key
from plumbline.operators import profiling as p
from plumbline.operators import splits
from plumbline.plans.registry import query

_ORDERS = {"o_orderkey": True, "o_custkey": True, "o_orderstatus": False, "o_totalprice": True, "o_orderdate": False, "o_orderpriority": False}


@query("c1_table_profile", " union all ".join(
    f"select '{c}' as \"column\", count(*) as rows, count(*) - count({c}) as nulls, count(distinct {c}) as \"distinct\", "
    + (f"min({c})::double as low, max({c})::double as high from orders" if num else "null::double as low, null::double as high from orders")
    for c, num in _ORDERS.items())
    + " union all select '*', count(*), count(*) - (select count(*) from (select distinct * from orders)), "
      "(select count(*) from (select distinct * from orders)), null, null from orders")
def c1(t):
    return p.table_profile(t.orders)


@query("c2_json_profile", """
with k as (select unnest(json_keys(props)) as key, props from events), v as (select key, json_extract(props, '$.' || key) as v from k)
select key, case json_type(v) when 'UBIGINT' then 'number' when 'BIGINT' then 'number' when 'DOUBLE' then 'number' when 'VARCHAR' then 'string'
  when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'array' when 'OBJECT' then 'object' else 'null' end as kind, count(*) as n,
  min(v::double) as low, max(v::double) as high from v group by 1, 2""")
def c2(t):
    return p.json_profile(t.events, "props")


@query("c3_array_profile", """
with v as (select [x::double for x in embedding] as v from embeddings), u as (select v, unnest(range(len(v))) as spot from v)
select 'length' as part, len(v)::int as spot, count(*) as n, null::double as low, null::double as high from v group by 2
union all select 'position', spot::int, count(*), min(v[spot + 1]), max(v[spot + 1]) from u group by 2
union all select 'argmax', (list_position(v, list_max(v)) - 1)::int, count(*), null, null from v group by 2""")
def c3(t):
    return p.array_profile(t.embeddings, "embedding")


@query("c4_rollup_profile", """
select coalesce(lang, 'all') as lang, count(*) as records, min(n_chars) as low, max(n_chars) as high, round(avg(n_chars), 6) as mean
from documents group by rollup(lang)""")
def c4(t):
    return t.documents.rollup("lang").agg(F.count(F.lit(1)).alias("records"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high"),
                                          F.round(F.avg("n_chars"), 6).alias("mean")).withColumn("lang", F.coalesce("lang", F.lit("all")))


@query("c5_duplicate_groups", "select sha256(text) as content_key, count(*) as records from documents group by 1 having count(*) > 1")
def c5(t):
    return p.duplicate_groups(t.documents, F.sha2("text", 256))


@query("c6_key_overlap", """
select (select count(distinct doc_id) from documents) as left_count, (select count(distinct doc_id) from labels) as right_count,
  (select count(*) from (select doc_id from documents intersect select doc_id from labels)) as overlap_count,
  case when (select count(*) from (select doc_id from documents intersect select doc_id from labels)) > 0 then 'risk' else 'pass' end as status""")
def c6(t):
    return p.overlap_status(p.key_overlap(t.documents, t.labels, F.col("doc_id"), F.col("doc_id")))


def _vector_key():
    return F.sha2(F.concat_ws(",", F.transform("embedding", lambda x: F.round(x.cast("double") * 1e6).cast("long").cast("string"))), 256)


@query("c7_vector_overlap", """
with h as (select label, sha256(array_to_string([round(x::double * 1e6)::bigint::varchar for x in embedding], ',')) as h from embeddings),
a as (select distinct h from h where label < 5), b as (select distinct h from h where label >= 5)
select (select count(*) from a) as left_count, (select count(*) from b) as right_count,
  (select count(*) from (select h from a intersect select h from b)) as overlap_count,
  case when (select count(*) from (select h from a intersect select h from b)) > 0 then 'risk' else 'pass' end as status""")
def c7(t):
    e = t.embeddings
    return p.overlap_status(p.key_overlap(e.where("label < 5"), e.where("label >= 5"), _vector_key(), _vector_key()))


@query("c8_pairing_contract", """
select (select count(*) from documents) as left_rows, (select count(*) from labels) as right_rows,
  (select count(*) = count(distinct doc_id) from documents) as left_unique, (select count(*) = count(distinct doc_id) from labels) as right_unique,
  (select count(*) from (select doc_id from documents intersect select doc_id from labels)) as matched_keys,
  (select count(*) from documents) = (select count(*) from labels) and (select count(*) = count(distinct doc_id) from labels)
   and (select count(*) from (select doc_id from documents intersect select doc_id from labels)) = (select count(*) from documents) as one_to_one""")
def c8(t):
    return p.pairing_contract(p.key_overlap(t.documents, t.labels, F.col("doc_id"), F.col("doc_id")))


@query("c9_mixture_contract", """
with s as (select o_custkey, sum(o_totalprice) as s, sum(case when o_orderstatus = 'F' then o_totalprice else 0 end) as f,
  sum(case when o_orderstatus = 'O' then o_totalprice else 0 end) as o, sum(case when o_orderstatus = 'P' then o_totalprice else 0 end) as p
  from orders group by 1)
select count(*) as rows, round(max(abs(round(f/s, 3) + round(o/s, 3) + round(p/s, 3) - 1)), 6) as max_simplex_error,
  sum((f < 0)::int + (o < 0)::int + (p < 0)::int)::bigint as negative_values, 0::bigint as missing_values from s""")
def c9(t):
    part = [F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")).otherwise(0.0)).alias(f"_{s}") for s in "FOP"]
    c = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"), *part)
    shares = c.select(*[F.round(F.col(f"_{s}") / F.col("total"), 3).alias(s) for s in "FOP"])
    return p.mixture_contract(shares, list("FOP")).withColumn("max_simplex_error", F.round("max_simplex_error", 6))


@query("c10_name_key", """
select regexp_replace(regexp_replace(trim(lower(p_name || ' / ' || p_brand)), '^(pretrained=|hf:|hf-)', ''), '[^a-z0-9]+', '', 'g') as name_key,
  count(*) as parts from part group by 1""")
def c10(t):
    return t.part.groupBy(name_key(F.concat("p_name", F.lit(" / "), "p_brand")).alias("name_key")).agg(F.count(F.lit(1)).alias("parts"))


@query("c11_match_coverage", """
with k as (select p_size, regexp_replace(lower(p_name || p_brand), '[^a-z0-9]+', '', 'g') as k from part),
a as (select distinct k from k where p_size <= 25), b as (select distinct k from k where p_size > 25),
m as (select count(*) as n from (select k from a intersect select k from b))
select (select count(*) from a) as left_count, (select count(*) from b) as right_count, m.n as matched,
  round(100.0 * m.n / (select count(*) from a), 6) as left_percent, round(100.0 * m.n / (select count(*) from b), 6) as right_percent from m""")
def c11(t):
    key = name_key(F.concat("p_name", "p_brand"))
    return p.match_coverage(p.key_overlap(t.part.where("p_size <= 25"), t.part.where("p_size > 25"), key, key))


@query("c12_value_agreement", """
with a as (select l_suppkey, l_quantity, min(l_discount) as v from lineitem where l_returnflag = 'A' group by 1, 2),
b as (select l_suppkey, l_quantity, min(l_discount) as v from lineitem where l_returnflag = 'R' group by 1, 2)
select count(*) as overlap_keys, count(*) filter (abs(a.v - b.v) <= 1e-8 + 1e-5 * abs(b.v)) as identical,
  count(*) filter (abs(a.v - b.v) > 1e-8 + 1e-5 * abs(b.v)) as conflicting from a join b using (l_suppkey, l_quantity)""")
def c12(t):
    version = lambda flag: (t.lineitem.where(F.col("l_returnflag") == flag).groupBy("l_suppkey", "l_quantity")
                            .agg(F.min("l_discount").alias("v")))
    return p.value_agreement(version("A"), version("R"), ["l_suppkey", "l_quantity"], "v")


@query("c13_identity_audit", """
with j as (select l_returnflag, l_extendedprice as a, l_quantity * p_retailprice as b from lineitem join part on l_partkey = p_partkey)
select l_returnflag, count(*) as rows, round(avg(a - b), 4) as mean_difference, round(max(abs(a - b)), 4) as max_absolute,
  round(max(abs(a - b) / abs(b)), 6) as max_relative, round(corr(a, b), 6) as correlation from j group by 1""")
def c13(t):
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("l_returnflag").agg(*p.identity_audit(j, F.col("l_extendedprice"), F.col("l_quantity") * F.col("p_retailprice")))


@query("c15_cartesian_design", """
select count(*) as points, count(distinct l_returnflag) as levels_l_returnflag, count(distinct l_linestatus) as levels_l_linestatus,
  count(distinct l_tax) as levels_l_tax, count(*) = count(distinct l_returnflag) * count(distinct l_linestatus) * count(distinct l_tax) as cartesian
from (select distinct l_returnflag, l_linestatus, l_tax from lineitem)""")
def c15(t):
    return p.is_cartesian(t.lineitem, ["l_returnflag", "l_linestatus", "l_tax"])


@query("c16_independent_units", """
select count(*) as records, count(distinct event_id) as runs, count(distinct user_id) as users, count(distinct event_type) as types from events""")
def c16(t):
    unit = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))
    return unit.agg(F.sum("n").alias("records"), F.sum("ids").alias("runs"), F.count_distinct("user_id").alias("users"),
                    F.count_distinct("event_type").alias("types"))


@query("c17_support_box", """
with b as (select min(o_totalprice) a0, max(o_totalprice) a1, min(o_custkey) b0, max(o_custkey) b1 from orders where o_orderstatus = 'F')
select o_orderstatus, count(*) as rows, count(*) filter (o_totalprice between a0 and a1 and o_custkey between b0 and b1) as inside
from orders, b group by 1""")
def c17(t):
    rows = p.support_box(t.orders, F.col("o_orderstatus") == "F", ["o_totalprice", "o_custkey"])
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("rows"), F.count_if("in_box").alias("inside"))


_LEVELS = {"orders": list(_ORDERS), "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
           "documents": ["doc_id", "text", "lang", "source", "n_chars"], "labels": ["doc_id", "quality", "toxic"]}


@query("c18_missing_levels", " union all ".join(
    f"select '{name}' as \"table\", count(*) as rows, (" + " + ".join(f"(count(*) - count({c}))" for c in cols) + ")::bigint as missing_cells, ("
    + " + ".join(f"(count({c}) = 0)::int" for c in cols) + f")::bigint as empty_columns from {name}" for name, cols in _LEVELS.items()))
def c18(t):
    return p.missing_levels({name: getattr(t, name) for name in _LEVELS})


_FOLD = "(('0x' || substr(sha256({}::varchar), 1, 8))::bigint % 5)::int"


def _event_splits(t):
    e = t.events.withColumn("day", F.datediff("ts", F.to_date(F.lit("2024-01-01"))).cast("double") + F.hour("ts") / 24.0)
    rec, grp, time = F.col("event_id"), F.col("user_id"), F.col("day")
    rows = e.withColumn("fold", hash_fold(rec))
    groups = e.withColumn("fold", hash_fold(grp))
    late = splits.time_block(e, ["user_id"], "day", 0.75)
    late_rows = splits.manifest(late, rec, grp, time, "late_block", F.lit(0), F.when(F.col("is_train"), "train").otherwise("test"))
    return (splits.k_fold_manifest(rows, rec, grp, time, "random_row", "fold", 5),
            splits.k_fold_manifest(groups, rec, grp, time, "leave_group", "fold", 5), late_rows, groups)


_SPLIT_SQL = f"""
e as (select *, date_diff('day', date '2024-01-01', ts::date) + hour(ts) / 24.0 as day from events),
cut as (select user_id, quantile_cont(day::double, 0.75) as cut from e group by 1),
m as (select 'random_row' as protocol, f::int as fold, case when {_FOLD.format('event_id')} = f then 'test' else 'train' end as role, event_id, user_id, day
        from e, range(5) r(f)
      union all select 'leave_group', f::int, case when {_FOLD.format('user_id')} = f then 'test' else 'train' end, event_id, user_id, day from e, range(5) r(f)
      union all select 'late_block', 0, case when day <= cut then 'train' else 'test' end, event_id, user_id, day from e join cut using (user_id))"""


@query("c19_leakage_audit", f"""
with {_SPLIT_SQL},
r as (select protocol, fold, event_id, bool_or(role = 'train') a, bool_or(role = 'test') b from m group by 1, 2, 3),
g as (select protocol, fold, user_id, bool_or(role = 'train') a, bool_or(role = 'test') b, max(case when role = 'train' then day end) t0,
  min(case when role = 'test' then day end) t1 from m group by 1, 2, 3),
inn as (select u.protocol, u.fold, e.event_id from (select distinct protocol, fold, user_id from m where role = 'train') u join e on u.user_id = e.user_id),
ls as (select inn.protocol, inn.fold, count(*) as leaks from inn join m on m.role = 'test' and m.protocol = inn.protocol and m.fold = inn.fold and m.event_id = inn.event_id group by 1, 2),
rs as (select protocol, fold, count(*) as records, count(*) filter (a and b) as record_overlap from r group by 1, 2),
gs as (select protocol, fold, count(*) filter (a and b) as group_overlap, count(*) filter (a and b and t0 >= t1) as time_leaks from g group by 1, 2)
select rs.protocol, rs.fold, records, record_overlap, group_overlap, time_leaks, coalesce(leaks, 0)::bigint as inner_in_outer_test
from rs join gs on rs.protocol = gs.protocol and rs.fold = gs.fold left join ls on rs.protocol = ls.protocol and rs.fold = ls.fold""")
def c19(t):
    random, grouped, late, _ = _event_splits(t)
    # Inner folds take whole users from the training side; only a protocol that parts users keeps them out of its test side.
    return splits.leakage_audit(random.unionByName(grouped).unionByName(late))


@query("d1_row_folds", f"select {_FOLD.format('event_id')} as fold, count(*) as records, round(avg(value), 6) as mean_value from events group by 1")
def d1(t):
    return splits.row_folds(t.events, "event_id").groupBy("fold").agg(F.count(F.lit(1)).alias("records"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("d2_group_folds", f"""
with s as (select user_id, count(*) as rows, {_FOLD.format('user_id')} as hash_fold from events group by 1),
r as (select *, (row_number() over (order by rows desc, user_id) - 1) % 10 as spot from s)
select user_id, rows, least(spot, 9 - spot)::int as fold, hash_fold from r""")
def d2(t):
    return splits.balanced_group_folds(t.events, "user_id", 5).withColumn("hash_fold", hash_fold(F.col("user_id")))


@query("d3_content_folds", """
with d as (select sha256(text) as group_id, 'documents' as src from documents union all select sha256(text), 'benchmark' from benchmark
  union all select sha256(text), 'conversations' from conversations)
select src, (('0x' || substr(group_id, 1, 8))::bigint % 5)::int as fold, count(*) as records, count(distinct group_id) as groups from d group by 1, 2""")
def d3(t):
    rows = None
    for name in ("documents", "benchmark", "conversations"):
        part = splits.content_folds(getattr(t, name).select("text"), F.sha2("text", 256)).select(F.lit(name).alias("src"), "group_id", "fold")
        rows = part if rows is None else rows.unionByName(part)
    sized = rows.groupBy("src", "fold", "group_id").agg(F.count(F.lit(1)).alias("n"))
    return sized.groupBy("src", "fold").agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("groups"))


@query("d4_split_manifest", f"""
with {_SPLIT_SQL} select protocol, fold, role, count(*) as records, count(distinct user_id) as groups, round(min(day), 6) as first_day,
  round(max(day), 6) as last_day from m group by 1, 2, 3""")
def d4(t):
    random, grouped, late, _ = _event_splits(t)
    rows = random.unionByName(grouped).unionByName(late)
    sized = rows.groupBy("protocol", "fold", "role", "group_id").agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("a"), F.max("time").alias("b"))
    return sized.groupBy("protocol", "fold", "role").agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("groups"),
                                                         F.round(F.min("a"), 6).alias("first_day"), F.round(F.max("b"), 6).alias("last_day"))
