"""Registered queries for scalar, array and JSON functions (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import arrays, keys, laws, numeric
from plumbline.operators import jsonmaps, scoring_jobs
from plumbline.plans.registry import query
from plumbline.plans.trials import KAPPA, LAW, TRIALS_SQL, ndq, trials


@query("p1_safe_number", """
select o_orderkey, try_cast(o_orderpriority as double) as from_word,
       try_cast(substr(o_orderpriority, 1, 1) as double) as from_code,
       case when o_orderstatus = 'P' then null else o_totalprice end as guarded
from orders""")
def p1(t):
    odd = F.when(F.col("o_orderstatus") == "P", "NaN").otherwise(F.col("o_totalprice").cast("string"))
    return t.orders.select("o_orderkey", numeric.safe_number(F.col("o_orderpriority")).alias("from_word"),
                           numeric.safe_number(F.substring("o_orderpriority", 1, 1)).alias("from_code"),
                           numeric.safe_number(odd).alias("guarded"))


@query("p2_expected_level", """
with v as (select vec_id, [x::double for x in embedding[1:6]] as s from embeddings),
e as (select vec_id, [exp(x - list_max(s)) for x in s] as w from v)
select vec_id, round((w[2] + 2*w[3] + 3*w[4] + 4*w[5] + 5*w[6]) / (w[1]+w[2]+w[3]+w[4]+w[5]+w[6]), 6) as level from e""")
def p2(t):
    return t.embeddings.select("vec_id", F.round(arrays.expected_level(F.slice("embedding", 1, 6)), 6).alias("level"))


@query("p3_logit_margin", """
select vec_id, round(embedding[8]::double - embedding[7]::double, 6) as margin, null::double as wrong_length from embeddings""")
def p3(t):
    return t.embeddings.select("vec_id", F.round(arrays.margin(F.slice("embedding", 7, 2)), 6).alias("margin"),
                               arrays.margin(F.slice("embedding", 7, 3)).alias("wrong_length"))


@query("p4_positions_to_columns", """
select vec_id, round(embedding[9]::double, 6) as style, round(embedding[10]::double, 6) as expertise,
       round(embedding[11]::double, 6) as facts, round(embedding[12]::double, 6) as education from embeddings""")
def p4(t):
    heads = ["style", "expertise", "facts", "education"]
    return t.embeddings.select("vec_id", *[F.round(F.get("embedding", F.lit(8 + i)).cast("double"), 6).alias(h)
                                           for i, h in enumerate(heads)])


@query("p5_content_hash", "select doc_id, sha256(text) as content_sha256 from documents")
def p5(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("content_sha256"))


@query("p6_short_id", """
select o_orderkey, substr(sha256(o_orderkey || '|' || o_custkey || '|' || o_orderstatus), 1, 12) as short_id from orders""")
def p6(t):
    return t.orders.select("o_orderkey", keys.short_id(F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")).alias("short_id"))


@query("p7_hash_fold", """
select doc_id, (('0x' || substr(sha256(doc_id::varchar), 1, 8))::bigint % 5)::int as fold from documents""")
def p7(t):
    return t.documents.select("doc_id", keys.hash_fold(F.col("doc_id")).alias("fold"))


@query("p8_composition_id", """
with e as (select o_custkey, o_orderstatus, cast(round(o_totalprice * 100) as bigint) as cents from orders),
c as (select o_custkey, sum(cents) as s, sum(case when o_orderstatus = 'F' then cents else 0 end) as f, sum(case when o_orderstatus = 'O' then cents else 0 end) as o,
  sum(case when o_orderstatus = 'P' then cents else 0 end) as p from e group by 1),
b as (select o_custkey, (2000000000 * f + s) // (2 * s) as f, (2000000000 * o + s) // (2 * s) as o, (2000000000 * p + s) // (2 * s) as p from c)
select o_custkey, 'mixture:' || substr(sha256(printf('%.9f', f / 1e9) || ',' || printf('%.9f', o / 1e9) || ',' || printf('%.9f', p / 1e9)), 1, 20)
  as group_id from b""")
def p8(t):
    """Shares in billionths of exact sums of cents: the id does not hang on the order in which prices are added."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    part = [F.sum(F.when(F.col("o_orderstatus") == s, cents).otherwise(0)).cast("decimal(20,0)").alias(s) for s in "FOP"]
    c = t.orders.groupBy("o_custkey").agg(F.sum(cents).cast("decimal(20,0)").alias("total"), *part)
    shares = [F.expr(f"(2000000000 * {s} + total) div (2 * total)") / F.lit(1e9) for s in "FOP"]
    return c.select("o_custkey", keys.composition_id(shares).alias("group_id"))


@query("p9_text_predicates", """
select p_partkey, regexp_replace(p_brand, '^Brand#', '') as brand_no, p_name ilike '%RING%' as has_ring,
       starts_with(p_type, 'S') as starts_s, regexp_matches(p_brand, '^Brand#1[0-9]?$') as glob_class from part""")
def p9(t):
    return t.part.select("p_partkey", F.regexp_replace("p_brand", "^Brand#", "").alias("brand_no"),
                         F.col("p_name").ilike("%RING%").alias("has_ring"), F.col("p_type").startswith("S").alias("starts_s"),
                         F.col("p_brand").rlike("^Brand#1[0-9]?$").alias("glob_class"))


@query("p10_excerpt", """
select doc_id, sha256(substr(replace(text, chr(0), ''), 1, 2000)) as excerpt_sha256,
       length(substr(replace(text, chr(0), ''), 1, 2000))::int as excerpt_chars from documents""")
def p10(t):
    cut = F.substring(F.translate("text", "\x00", ""), 1, 2000)
    return t.documents.select("doc_id", F.sha2(cut, 256).alias("excerpt_sha256"), F.length(cut).alias("excerpt_chars"))


STRATA = {"1-URGENT": "urgent", "2-HIGH": "urgent", "3-MEDIUM": "normal", "5-LOW": "low"}


@query("p11_category_map", """
select o_orderkey, case o_orderpriority when '1-URGENT' then 'urgent' when '2-HIGH' then 'urgent' when '3-MEDIUM' then 'normal'
  when '5-LOW' then 'low' else 'other' end as stratum from orders""")
def p11(t):
    table = F.create_map(*[F.lit(x) for kv in STRATA.items() for x in kv])
    return t.orders.select("o_orderkey", F.coalesce(F.try_element_at(table, F.col("o_orderpriority")), F.lit("other")).alias("stratum"))


@query("p12_cohort_flags", """
select c_custkey, c_acctbal > 0 and trim(c_name) <> '' and c_mktsegment in ('BUILDING', 'MACHINERY') as strict_open,
       c_acctbal > 0 and trim(c_name) <> '' and c_mktsegment not in ('', 'HOUSEHOLD') as wide_open from customer""")
def p12(t):
    base = (F.col("c_acctbal") > 0) & (F.trim("c_name") != "")
    return t.customer.select("c_custkey", (base & F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).alias("strict_open"),
                             (base & ~F.col("c_mktsegment").isin("", "HOUSEHOLD")).alias("wide_open"))


@query("p13_fallback_id", """
select event_id, case when event_type <> 'error' then 'sha:' || substr(sha256(event_id::varchar), 1, 16)
  else 'fallback:' || user_id || '|' || strftime(ts, '%Y-%m-%d') end as entity_id from events""")
def p13(t):
    sha = F.concat(F.lit("sha:"), F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 16))
    spare = F.concat(F.lit("fallback:"), F.col("user_id").cast("string"), F.lit("|"), F.date_format("ts", "yyyy-MM-dd"))
    return t.events.select("event_id", F.when(F.col("event_type") != "error", sha).otherwise(spare).alias("entity_id"))


@query("p14_date_arithmetic", """
select o_orderkey, round(date_diff('day', date '1995-01-01', o_orderdate::date) / 365.25, 6) as years,
       strftime(o_orderdate::date + interval 12 month, '%Y-%m-%d') as plus_12m,
       strftime(try_cast(case when o_orderstatus = 'P' then 'not a date' else strftime(o_orderdate, '%Y-%m-%d') end as date), '%Y-%m-%d')
         as coerced from orders""")
def p14(t):
    text = F.when(F.col("o_orderstatus") == "P", "not a date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t.orders.select(
        "o_orderkey", F.round(numeric.years_between(F.col("o_orderdate"), F.to_date(F.lit("1995-01-01"))), 6).alias("years"),
        F.date_format(F.add_months(F.col("o_orderdate").cast("date"), 12), "yyyy-MM-dd").alias("plus_12m"),
        F.date_format(text.try_cast("date"), "yyyy-MM-dd").alias("coerced"))


@query("p15_logit", """
with v as (select event_id, greatest(0.05, least(99.95, value)) as v from events),
z as (select event_id, ln(v / (100.0 - v)) as z from v)
select event_id, round(z, 6) as z, round(100.0 / (1.0 + exp(-greatest(-30.0, least(30.0, z)))), 6) as back from z""")
def p15(t):
    z = numeric.logit_percent(F.col("value"))
    return t.events.select("event_id", F.round(z, 6).alias("z"), F.round(numeric.percent_from_logit(z), 6).alias("back"))


@query("p16_first_metric", """
select event_id, 'k' as metric, json_extract(props, '$.k')::double as metric_value from events""")
def p16(t):
    m = F.from_json("props", "map<string,string>")
    first = jsonmaps.first_metric(m)
    return t.events.select("event_id", first["key"].alias("metric"), first["value"].alias("metric_value"))


@query("p17_task_rows", """
select user_id, case when event_type in ('view', 'click') then 'browse' else 'act' end as task_group, event_type as task,
       'acc' as metric, round(avg(value), 6) as score, count(*) as effective_n from events group by 1, 2, 3""")
def p17(t):
    rows = jsonmaps.task_rows(jsonmaps.evaluation_documents(t.events), ["user_id"])
    return rows.select("user_id", "task_group", "task", "metric", F.round("score", 6).alias("score"), F.col("effective_n").cast("long"))


@query("p18_law_variants", f"""
with t as ({TRIALS_SQL}), r as (select *, {LAW['A']} * n ** -{LAW['alpha']} as rn, {LAW['B']} * d ** -{LAW['beta']} as rd,
  greatest(0.0, 1 - q) as u from t)
select run, round(avg({LAW['E']} + rn + rd), 6) as none, round(avg({LAW['E']} + rn + rd + {KAPPA} * u), 6) as additive,
  round(avg({LAW['E']} + (rn + rd) * (1 + {KAPPA} * u)), 6) as reducible_linear,
  round(avg({LAW['E']} + (rn + rd) * (1 + {KAPPA} * u ** 1.5)), 6) as reducible_power,
  round(avg({LAW['E']} + rn + {LAW['B']} * (d * exp({KAPPA} * (q - 1))) ** -{LAW['beta']}), 6) as effective_data,
  round(avg({LAW['E']} + rn * greatest(q, 0.001) ** -{KAPPA} + rd), 6) as n_power
from r group by run""")
def p18(t):
    n, d, q = ndq()
    return trials(t.lineitem).groupBy("run").agg(*[
        F.round(F.avg(laws.quality_loss(k, LAW, n, d, q, KAPPA, power=1.5)), 6).alias(k) for k in laws.KINDS])


@query("p19_partials", f"""
with t as ({TRIALS_SQL}), r as (select *, {LAW['A']} * n ** -{LAW['alpha']} as rn, {LAW['B']} * d ** -{LAW['beta']} as rd,
  1 + {KAPPA} * (1 - q) as m from t),
g as (select *, {LAW['E']} + (rn + rd) * m as l, -{LAW['alpha']} * rn / n * m as dn, -{LAW['beta']} * rd / d * m as dd,
  -{KAPPA} * (rn + rd) as dq from r)
select run, round(avg(dn), 6) as dn, round(avg(dd), 6) as dd, round(avg(dq), 6) as dq, round(avg(-dn * n / l), 6) as elasticity_n,
  round(avg(-dd * d / l), 6) as elasticity_d, round(avg(-dq * q / l), 6) as elasticity_q,
  bool_and(abs(dn * n - ((({LAW['E']} + ({LAW['A']} * (n * 1.0001) ** -{LAW['alpha']} + rd) * m)
   - ({LAW['E']} + ({LAW['A']} * (n * 0.9999) ** -{LAW['alpha']} + rd) * m)) / 0.0002)) < 1e-6) as central_agrees
from g group by run""")
def p19(t):
    n, d, q = ndq()
    p = laws.partials(LAW, n, d, q, KAPPA)
    at = lambda size: laws.quality_loss("reducible_linear", LAW, size, d, q, KAPPA)
    level = at(n)
    central = (at(n * 1.0001) - at(n * 0.9999)) / 0.0002
    means = {"dn": p["dn"], "dd": p["dd"], "dq": p["dq"], "elasticity_n": -p["dn"] * n / level,
             "elasticity_d": -p["dd"] * d / level, "elasticity_q": -p["dq"] * q / level}
    return trials(t.lineitem).groupBy("run").agg(*[F.round(F.avg(c), 6).alias(k) for k, c in means.items()],
                                                 F.bool_and(F.abs(p["dn"] * n - central) < 1e-6).alias("central_agrees"))


@query("p20_equivalent_size", f"""
with t as ({TRIALS_SQL}), r as (select *, least(1.0, q + 0.1) as q2 from t),
s as (select *, (({LAW['A']} * n ** -{LAW['alpha']} + {LAW['B']} * d ** -{LAW['beta']}) * (1 + 2.0 * (1 - q2)) / (1 + 2.0 * (1 - q))
  - {LAW['B']} * d ** -{LAW['beta']}) / {LAW['A']} as rhs from r)
select run, case when rhs < 0 then 'unattainable' when rhs = 0 then 'infinite_limit'
   when -ln(case when rhs > 0 then rhs end) / {LAW['alpha']} > 709.782712893384 then 'overflow' else 'finite' end as status,
  count(*) as trials, round(avg(case when rhs > 0 then -ln(case when rhs > 0 then rhs end) / {LAW['alpha']} end), 6) as mean_log_n
from s group by 1, 2""")
def p20(t):
    n, d, q = ndq()
    status, size = laws.equivalent_size(LAW, n, d, q, F.least(F.lit(1.0), q + 0.1), 2.0)
    rows = trials(t.lineitem).select("run", status.alias("status"), size.alias("size"))
    return rows.groupBy("run", "status").agg(F.count(F.lit(1)).alias("trials"), F.round(F.avg(F.ln("size")), 6).alias("mean_log_n"))


@query("p21_costs", f"""
with t as ({TRIALS_SQL}), f as (select * from t, (values ('exponential'), ('power'), ('logarithmic')) v(family)),
g as (select *, case family when 'exponential' then 1e7 * exp(6.0 * q) when 'power' then 5e9 * q ** 4 else 2e9 * ln(1 + 10.0 * q) end as g,
  case family when 'exponential' then 1e7 * exp(3.0) when 'power' then 5e9 * 0.5 ** 4 else 2e9 * ln(6.0) end as g0,
  case family when 'exponential' then 6e7 * exp(6.0 * q) when 'power' then 2e10 * q ** 3 else 2e10 / (1 + 10.0 * q) end as slope from f),
c as (select *, 6.0 * n * d as train, d * greatest(g - g0, 0) / 1e9 as quality, 2e-4 * n * d * 4096 as attention from g)
select run, family, round(avg(slope) / 1e9, 6) as slope_e9, round(avg(train), 4) as train_e18, round(avg(quality), 4) as quality_e18,
  round(avg(attention), 4) as attention_e18, round(avg(quality / (train + quality + attention)), 6) as quality_share
from c group by 1, 2""")
def p21(t):
    n, d, q = ndq()
    rows = trials(t.lineitem).withColumn("family", F.explode(F.array(*[F.lit(f) for f in laws.COST_FAMILIES])))
    fam = F.col("family")
    rise = laws.by_family(lambda f: laws.quality_cost_rise(q, F.lit(laws.QUALITY_START), f), fam)
    c = laws.cost_parts(n, d, rise, F.lit(4096))
    slope = laws.by_family(lambda f: laws.quality_cost_slope(q, f), fam)
    return rows.groupBy("run", "family").agg(
        F.round(F.avg(slope) / 1e9, 6).alias("slope_e9"),
        *[F.round(F.avg(v / 1e18), 4).alias(f"{k}_e18") for k, v in c.items()],
        F.round(F.avg(c["quality"] / (c["train"] + c["quality"] + c["attention"])), 6).alias("quality_share"))


@query("p22_active_set", f"""
with t as ({TRIALS_SQL}), b as (select min(n) n0, max(n) n1, min(d) d0, max(d) d1, min(q) q0, max(q) q1 from t)
select array_to_string(list_filter([case when abs(n - n0) <= greatest(1e-9, 3e-7 * greatest(abs(n0), 1)) then 'N_lower' end,
   case when abs(n - n1) <= greatest(1e-9, 3e-7 * greatest(abs(n1), 1)) then 'N_upper' end,
   case when abs(d - d0) <= greatest(1e-9, 3e-7 * greatest(abs(d0), 1)) then 'D_lower' end,
   case when abs(d - d1) <= greatest(1e-9, 3e-7 * greatest(abs(d1), 1)) then 'D_upper' end,
   case when abs(q - q0) <= greatest(1e-9, 3e-7 * greatest(abs(q0), 1)) then 'Q_baseline'
        when abs(q - q1) <= greatest(1e-9, 3e-7 * greatest(abs(q1), 1)) then 'Q_upper' else 'Q_interior' end], lambda x: x is not null), ';')
  as active_set, count(*) as trials from t, b group by 1""")
def p22(t):
    return scoring_jobs.label_active(trials(t.lineitem)).groupBy("active_set").agg(F.count(F.lit(1)).alias("trials"))


@query("p23_guarded_scoring", f"""
with t as ({TRIALS_SQL}), r as (select *, case when l_tax = 0.08 then 'raw' else 'billions' end as units,
   case when l_tax = 0.07 then 'other_scale' else 'trial_q' end as q_scale from t),
s as (select *, case when units <> 'billions' then 'wrong_units' when q_scale <> 'trial_q' then 'wrong_quality_scale'
   when not (n > 0 and d > 0) then 'size_not_positive' when not (q between 0 and 1) then 'quality_out_of_range'
   when n > 45 then 'outside_support' end as reason from r)
select coalesce(reason, 'scored') as outcome, count(*) as trials,
  round(avg(case when reason is null then {LAW['E']} + ({LAW['A']} * n ** -{LAW['alpha']} + {LAW['B']} * d ** -{LAW['beta']})
    * (1 + {KAPPA} * (1 - q)) end), 6) as mean_loss
from s group by 1""")
def p23(t):
    rows = (trials(t.lineitem)
            .withColumn("units", F.when(F.col("l_tax") == 0.08, "raw").otherwise("billions"))
            .withColumn("q_scale", F.when(F.col("l_tax") == 0.07, "other_scale").otherwise("trial_q")))
    scored = scoring_jobs.guarded_scores(rows, LAW, KAPPA, "trial_q", {"n": (0.0, 45.0)})
    return scored.groupBy(F.coalesce("reason", F.lit("scored")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("trials"), F.round(F.avg("loss"), 6).alias("mean_loss"))
