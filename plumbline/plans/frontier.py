"""Registered queries for cohorts, records and metrics (E, V)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.numeric import correlation
from plumbline.functions import laws
from plumbline.functions.keys import hash_fold, name_key
from plumbline.operators import cohorts as e
from plumbline.operators import metrics as v
from plumbline.operators.ranking import exact_quantiles, spearman, two_sample_distances
from plumbline.plans.quality import rank_sql
from plumbline.plans.registry import query
from plumbline.plans.trials import LAW, TRIALS_SQL, ndq, trials
from plumbline.runtime import scratch_dir, with_row
from plumbline.sources.sinks import write_result


def _day(c):
    return F.date_format(c, "yyyy-MM-dd")


@query("e1_earliest_per_entity", """select user_id, event_id, strftime(ts, '%Y-%m-%d') as day, round(value, 6) as value from
(select *, row_number() over (partition by user_id order by ts, event_id) as rn from events) where rn = 1""")
def e1(t):
    return e.earliest_per_entity(t.events, "user_id", "ts", "event_id").select("user_id", "event_id", _day("ts").alias("day"), F.round("value", 6).alias("value"))


@query("e2_duplicate_entities", """select user_id, count(*) as records, strftime(min(ts), '%Y-%m-%d') as first_date, strftime(max(ts), '%Y-%m-%d') as last_date, min(value) as score_min,
  max(value) as score_max, count(distinct event_type) as names from events group by 1 having count(*) > 1""")
def e2(t):
    return e.duplicate_entities(t.events, "user_id", "ts", "value", "event_type").withColumn("first_date", _day("first_date")).withColumn("last_date", _day("last_date"))


@query("e3_cohort_summary", """with s as (select *, 'all_rows' as scope from orders union all select *, 'strict' from orders where o_orderstatus = 'F' union all select *, 'wide' from orders where o_orderstatus <> 'P'),
l as (select scope, o_orderpriority as stratum, o_custkey, o_orderdate from s union all select scope, 'all', o_custkey, o_orderdate from s)
select scope, stratum, count(*) as rows, count(distinct o_custkey) as unique_entities, strftime(min(o_orderdate), '%Y-%m-%d') as date_min, strftime(max(o_orderdate), '%Y-%m-%d') as date_max from l group by 1, 2""")
def e3(t):
    status = F.col("o_orderstatus")
    rows = e.cohort_summary(t.orders, {"all_rows": F.lit(True), "strict": status == "F", "wide": status != "P"}, "o_orderpriority", "o_custkey", "o_orderdate")
    return rows.withColumn("date_min", _day("date_min")).withColumn("date_max", _day("date_max"))


@query("e4_composite", """with s as (select l_suppkey, avg(l_quantity) / 50 as a, avg(l_discount) * 10 as b, avg(l_tax) * 10 filter (l_tax > 0) as c, avg(l_quantity) filter (l_quantity > 49 and l_discount = 0) / 50 as d from lineitem group by 1)
select l_suppkey, round(list_avg([a, b, c, d]), 6) as composite, a is not null and b is not null and c is not null and d is not null as complete from s""".replace("avg(l_tax) * 10 filter (l_tax > 0)", "avg(l_tax) filter (l_tax > 0) * 10"))
def e4(t):
    from plumbline.functions.arrays import mean_of, present

    s = t.lineitem.groupBy("l_suppkey").agg((F.avg("l_quantity") / 50).alias("a"), (F.avg("l_discount") * 10).alias("b"), (F.avg(F.when(F.col("l_tax") > 0, F.col("l_tax"))) * 10).alias("c"),
                                            (F.avg(F.when((F.col("l_quantity") > 49) & (F.col("l_discount") == 0), F.col("l_quantity"))) / 50).alias("d"))
    cells = [F.col(c) for c in "abcd"]
    return s.select("l_suppkey", F.round(mean_of(present(cells)), 6).alias("composite"), F.expr("a is not null and b is not null and c is not null and d is not null").alias("complete"))


@query("e5_latest_valid_revision", """with f as (select *, event_type = 'error' and value > 150 as corrupt from events),
r as (select *, bool_or(corrupt) over (partition by user_id) as bad, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from f)
select user_id, event_id, value from r where rn = 1 and not bad""")
def e5(t):
    rows = t.events.withColumn("corrupt", (F.col("event_type") == "error") & (F.col("value") > 150))
    return e.latest_valid_revision(rows, "user_id", "ts", "event_id", "corrupt").select("user_id", "event_id", "value")


_LEAF = """with l as (select user_id, event_type, avg(value) as v, count(*) as w from events group by 1, 2), g as (select user_id, sum(v * w) / sum(w) as leaf, avg(v) as plain from l group by 1),
d as (select user_id, avg(value) as direct from events group by 1), c as (select 'leaf_vs_direct' as comparison, round(leaf, 9) as a, round(direct, 9) as b from g join d using (user_id)
  union all select 'plain_vs_direct', round(plain, 9), round(direct, 9) from g join d using (user_id) union all select 'leaf_vs_plain', round(leaf, 9), round(plain, 9) from g)"""


@query("e6_group_reconstruction", f"""{_LEAF}, r as (select *, {rank_sql('a', 'comparison')} as ra, {rank_sql('b', 'comparison')} as rb from c)
select comparison, count(*) as n, round(avg(abs(a - b)), 6) as mae, round(max(abs(a - b)), 6) as max_abs, round(corr(ra, rb), 6) as spearman from r group by 1""")
def e6(t):
    leaf = t.events.groupBy("user_id", "event_type").agg(F.avg("value").alias("v"), F.count(F.lit(1)).alias("w"), F.sum("value").alias("s"))
    g = leaf.groupBy("user_id").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("leaf"), F.avg("v").alias("plain"), (F.sum("s") / F.sum("w")).alias("direct"))
    cells = F.array(*[F.struct(F.lit(f"{a}_vs_{b}").alias("comparison"), F.round(a, 9).alias("a"), F.round(b, 9).alias("b")) for a, b in (("leaf", "direct"), ("plain", "direct"), ("leaf", "plain"))])
    rows = g.select(F.explode(cells).alias("c")).select("c.*")
    gap = F.abs(F.col("a") - F.col("b"))
    base = rows.groupBy("comparison").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(gap), 6).alias("mae"), F.round(F.max(gap), 6).alias("max_abs"))
    return base.join(spearman(rows, ["comparison"], "a", "b").select("comparison", F.round("spearman", 6).alias("spearman")), "comparison")


@query("e7_enrich_by_key", """with k as (select *, regexp_replace(lower(p_name || p_brand), '[^a-z0-9]+', '', 'g') as key from part), d as (select key, min(p_partkey) as ref, min(p_retailprice) as price from k where p_size <= 10 group by 1)
select p_type, count(*) as rows, count(*) filter (d.ref is null) as unmatched, round(avg(d.price), 4) as mean_price from k left join d using (key) group by 1""")
def e7(t):
    keyed = t.part.withColumn("key", name_key(F.concat("p_name", "p_brand"), unicode=False))
    ref = keyed.where("p_size <= 10").groupBy("key").agg(F.min("p_partkey").alias("ref"), F.min("p_retailprice").alias("price"))
    return keyed.select("key", "p_type").join(ref, "key", "left").groupBy("p_type").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("ref").isNull()).alias("unmatched"), F.round(F.avg("price"), 4).alias("mean_price"))


@query("e8_task_profile", """with u as (select event_type, user_id, count(*) as n, min(ts) as a, max(ts) as b from events group by 1, 2)
select event_type, sum(n)::bigint as records, count(*) as entities, min(n) as min_items, max(n) as max_items, strftime(min(a), '%Y-%m-%d') as first_date, strftime(max(b), '%Y-%m-%d') as last_date from u group by 1""")
def e8(t):
    u = t.events.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return u.groupBy("event_type").agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("entities"), F.min("n").alias("min_items"), F.max("n").alias("max_items"),
                                       _day(F.min("a")).alias("first_date"), _day(F.max("b")).alias("last_date"))


@query("e9_dominant_and_complete", """with h as (select user_id, date_trunc('day', ts) as d, event_type, value from events), c as (select event_type, count(distinct user_id) as users, count(*) as n from h group by 1),
dom as (select event_type from c order by users desc, n desc, event_type limit 1), f as (select user_id, d from h group by 1, 2 having count(distinct event_type) >= 3)
select h.event_type, h.event_type = dom.event_type as dominant, count(*) as rows, round(avg(value), 6) as mean_value from h join f on h.user_id = f.user_id and h.d = f.d, dom group by 1, 2""")
def e9(t):
    h = t.events.select("user_id", F.to_date("ts").alias("d"), "event_type", "value")
    per = h.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n")).groupBy("event_type").agg(F.count(F.lit(1)).alias("users"), F.sum("n").alias("n"))
    best = per.agg(F.min_by("event_type", F.struct(-F.col("users"), -F.col("n"), "event_type")).alias("best"))
    full = h.groupBy("user_id", "d", "event_type").agg(F.lit(1).alias("x")).groupBy("user_id", "d").agg(F.count(F.lit(1)).alias("types")).where("types >= 3").select("user_id", "d")
    rows = with_row(h.join(full, ["user_id", "d"], "left_semi"), best)
    return rows.groupBy("event_type", (F.col("event_type") == F.col("best")).alias("dominant")).agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("e10_running_frontier", """with f as (select event_id, event_type, value, max(value) over (partition by event_type order by ts, event_id rows unbounded preceding) as frontier,
  max(value) over (partition by event_type order by ts, event_id rows between unbounded preceding and 1 preceding) as before from events)
select event_id, event_type, frontier, before is null or value > before as is_record from f""")
def e10(t):
    rows = t.events.select("event_id", "event_type", "ts", "value")
    return e.running_frontier(rows, ["event_type"], ["ts", "event_id"], "value").select("event_id", "event_type", "frontier", "is_record")


@query("e11_yearly_summary", """select year(o_orderdate)::int as year, count(*) as n, round(quantile_cont(o_totalprice, 0.9), 4) as q90, max(o_totalprice) as top from orders group by 1""")
def e11(t):
    rows = t.orders.select(F.year("o_orderdate").alias("year"), "o_totalprice")
    base = rows.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))
    return base.join(exact_quantiles(rows, ["year"], "o_totalprice", {"q90": 0.9}).withColumn("q90", F.round("q90", 4)), "year")


@query("e12_arrival_rates", """with d as (select 'record' as unit, ts::date as day, count(*) as n from events group by 2 union all
  select 'family', f::date, count(*) from (select user_id, min(ts) as f from events group by 1) group by 2),
w as (select unit, win, days, max(day) over (partition by unit) as last, day, n from d, (values ('full', null), ('d7', 7), ('d14', 14), ('d21', 21)) x(win, days)),
s as (select unit, win, sum(n) filter (days is null or day >= last - days::int) as n1, min(day) filter (days is null or day >= last - days::int) as a1, max(day) filter (days is null or day >= last - days::int) as b1,
  sum(n) as n0, min(day) as a0, max(day) as b0 from w group by 1, 2), p as (select unit, win, case when n1 < 20 then n0 else n1 end as n, case when n1 < 20 then a0 else a1 end as a, case when n1 < 20 then b0 else b1 end as b from s)
select unit, win as "window", n::bigint as events, greatest(date_diff('day', a, b) + 1, 5)::int as window_days, round(n / greatest(date_diff('day', a, b) + 1, 5), 6) as rate_day from p""")
def e12(t):
    record = t.events.groupBy(F.lit("record").alias("unit"), F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    first = t.events.groupBy("user_id").agg(F.min("ts").alias("f"))
    family = first.groupBy(F.lit("family").alias("unit"), F.to_date("f").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    rates = e.arrival_rates(record.unionByName(family), {"full": None, "d7": 7, "d14": 14, "d21": 21}, 20, 5)
    return rates.withColumn("rate_day", F.round("rate_day", 6))


_WEEK = """with x as (select min(ts::date) as a, max(ts::date) as b from events), c as (select event_type, date_diff('day', a, ts::date) // 7 as bucket, count(*) as n from events, x group by 1, 2),
g as (select event_type, unnest(range(0, date_diff('day', a, b) // 7 + 1)) as bucket from (select distinct event_type from events), x), f as (select g.event_type, g.bucket, coalesce(c.n, 0) as n from g left join c on g.event_type = c.event_type and g.bucket = c.bucket)"""


@query("e13_bucket_dispersion", f"""{_WEEK}, s as (select event_type, count(*) as buckets, avg(n) as m, var_samp(n) as v from f group by 1)
select event_type, buckets, round(m, 6) as mean, round(v, 6) as variance, round(v / m, 6) as fano, round(case when v > m + 1e-12 then m * m / (v - m) end, 6) as nb_size from s""")
def e13(t):
    out = e.dispersion(e.bucket_counts(t.events, ["event_type"], "ts", 7), ["event_type"])
    return out.select("event_type", "buckets", *[F.round(c, 6).alias(c) for c in ("mean", "variance", "fano", "nb_size")])


@query("e14_family_weights", "select user_id, count(*) as size, round((select count(*) from events) / ((select count(distinct user_id) from events) * count(*))::double, 6) as weight from events group by 1")
def e14(t):
    return e.family_weights(t.events, "user_id").withColumn("weight", F.round("weight", 6))


_ENDS = """with b as (select *, ln(1 + json_extract(props, '$.k')::double) as x, date_diff('day', date '2024-01-01', ts::date) / 365.25 as t from events),
s as (select * from (select *, row_number() over (partition by event_type order by value desc, ts, event_id) as rn from b where ts <= timestamp '2024-01-12') where rn = 1),
f as (select * from (select *, row_number() over (partition by event_type order by value desc, ts, event_id) as rn from b) where rn = 1)"""


def _ends(t):
    rows = t.events.select("event_type", "event_id", "ts", "value", F.ln(1 + F.get_json_object("props", "$.k").try_cast("double")).alias("x"),
                           (F.datediff("ts", F.to_date(F.lit("2024-01-01"))) / 365.25).alias("t"))
    return e.endpoints(rows, ["event_type"], "value", "ts", "event_id", F.lit("2024-01-12").cast("timestamp_ntz"), ["event_id", "value", "x", "t"])


@query("e15_shapley_split", f"""{_ENDS}, j as (select s.event_type, s.x as x0, f.x as x1, s.t as t0, f.t as t1, ln(s.value) as y0, ln(f.value) as y1 from s join f using (event_type)),
c as (select *, 1 + 0.3 * x0 + 2 * t0 + 0.5 * x0 * t0 as a, 1 + 0.3 * x1 + 2 * t0 + 0.5 * x1 * t0 as b, 1 + 0.3 * x0 + 2 * t1 + 0.5 * x0 * t1 as c, 1 + 0.3 * x1 + 2 * t1 + 0.5 * x1 * t1 as d from j)
select event_type, round(y1 - y0, 6) as observed, round(0.5 * ((b - a) + (d - c)), 6) as scale_part, round(0.5 * ((c - a) + (d - b)), 6) as time_part, round((y1 - d) - (y0 - a), 6) as residual_change,
  abs((y1 - y0) - 0.5 * ((b - a) + (d - c)) - 0.5 * ((c - a) + (d - b)) - ((y1 - d) - (y0 - a))) < 1e-9 as identity_holds from c""")
def e15(t):
    f = lambda x, s: 1 + 0.3 * x + 2 * s + 0.5 * x * s
    x0, x1, t0, t1 = F.col("start.x"), F.col("end.x"), F.col("start.t"), F.col("end.t")
    y0, y1 = F.ln("start.value"), F.ln("end.value")
    scale, time = e.shapley_split(f, x0, x1, t0, t1)
    rest = (y1 - f(x1, t1)) - (y0 - f(x0, t0))
    return _ends(t).select("event_type", F.round(y1 - y0, 6).alias("observed"), F.round(scale, 6).alias("scale_part"), F.round(time, 6).alias("time_part"),
                           F.round(rest, 6).alias("residual_change"), (F.abs((y1 - y0) - scale - time - rest) < 1e-9).alias("identity_holds"))


@query("e16_best_at_cutoff", f"{_ENDS} select s.event_type, s.event_id as start_id, s.value as start_value, f.event_id as end_id, f.value as end_value from s join f using (event_type)")
def e16(t):
    return _ends(t).select("event_type", F.col("start.event_id").alias("start_id"), F.col("start.value").alias("start_value"), F.col("end.event_id").alias("end_id"), F.col("end.value").alias("end_value"))


_PRED = f"p as (select *, {LAW['E']} + {LAW['A']} * n ** -{LAW['alpha']} + {LAW['B']} * d ** -{LAW['beta']} as pred from ({TRIALS_SQL}))"
_M = """count(*) as n, round(avg(abs(pred - y)), 6) as mae, round(sqrt(avg((pred - y) ** 2)), 6) as rmse, round(1 - sum((pred - y) ** 2) / (var_pop(y) * count(*)), 6) as r2,
  round(avg(pred - y), 6) as bias, round(sqrt(avg((ln(pred) - ln(y)) ** 2)), 6) as log_rmse"""


def _predicted(t):
    n, d, _ = ndq()
    return trials(t.lineitem).withColumn("pred", laws.loss(LAW, n, d))


def _round_metrics(df):
    return df.select(*[F.round(c, 6).alias(c) if c in v.METRICS else F.col(c) for c in df.columns])


@query("v1_error_metrics", f"with {_PRED} select l_tax, {_M} from p group by 1")
def v1(t):
    return _round_metrics(_predicted(t).groupBy("l_tax").agg(*v.error_metrics(F.col("y"), F.col("pred"))))


@query("v2_domain_metrics", f"""with {_PRED}, d as (select run as domain, count(*) as n, avg(abs(pred - y)) as mae, sqrt(avg((pred - y) ** 2)) as rmse, 1 - sum((pred - y) ** 2) / (var_pop(y) * count(*)) as r2, avg(pred - y) as bias,
  sqrt(avg((ln(pred) - ln(y)) ** 2)) as log_rmse from p group by 1)
select domain, n, round(mae, 6) as mae, round(rmse, 6) as rmse, round(r2, 6) as r2, round(bias, 6) as bias, round(log_rmse, 6) as log_rmse from d
union all select 'macro', sum(n)::bigint, round(avg(mae), 6), round(avg(rmse), 6), round(avg(r2), 6), round(avg(bias), 6), round(avg(log_rmse), 6) from d
union all select 'micro', {_M} from p""")
def v2(t):
    return _round_metrics(v.domain_metrics(_predicted(t), "run", "y", "pred"))


@query("v3_skill_scores", f"""with {_PRED}, s as (select *, (('0x' || substr(sha256(l_orderkey::varchar), 1, 8))::bigint % 5) = 0 as test from p), m as (select run, avg(y) filter (not test) as tm, avg(y) filter (test) as om from s group by 1),
a as (select run as domain, avg(abs(y - pred)) as a, avg(abs(y - tm)) as b, avg(abs(y - om)) as c from s join m using (run) where test group by 1)
select domain, round(a, 6) as mae_model, round(b, 6) as mae_train_mean, round(c, 6) as mae_own_mean, round(1 - a / b, 6) as skill_vs_train_mean, round(1 - a / c, 6) as skill_vs_own_mean from a""")
def v3(t):
    rows = _predicted(t).withColumn("test", hash_fold(F.col("l_orderkey")) == 0)
    out = v.skill_scores(rows.where("test"), rows.where("not test"), "run", "y", "pred")
    return out.select("domain", *[F.round(c, 6).alias(c) for c in out.columns if c != "domain"])


@query("v4_rank_correlation", f"""with {_PRED}, q as (select run, round(y, 9) as y, round(pred, 9) as pred from p), r as (select *, {rank_sql('y', 'run')} as a, {rank_sql('pred', 'run')} as b from q)
select run, round(corr(a, b), 6) as spearman, round(corr(y, pred), 6) as pearson from r group by 1""")
def v4(t):
    rows = _predicted(t).select("run", F.round("y", 9).alias("y"), F.round("pred", 9).alias("pred"))
    rho = spearman(rows, ["run"], "y", "pred").select("run", F.round("spearman", 6).alias("spearman"))
    return rho.join(rows.groupBy("run").agg(F.round(correlation("y", "pred"), 6).alias("pearson")), "run")


@query("v5_sample_distances", """with s as (select event_type = 'click' as side, value from events where event_type in ('click', 'purchase')), n as (select count(*) filter (side) as na, count(*) filter (not side) as nb from s),
c as (select value, sum(side::int) as a, sum((not side)::int) as b from s group by 1), f as (select value, sum(a) over (order by value) / na as fa, sum(b) over (order by value) / nb as fb, lead(value) over (order by value) as nx from c, n)
select (select na from n) as n_a, (select nb from n) as n_b, round(max(abs(fa - fb)), 6) as ks_statistic, round(sum(abs(fa - fb) * coalesce(nx - value, 0)), 6) as wasserstein from f""")
def v5(t):
    two = t.events.where(F.col("event_type").isin("click", "purchase")).withColumn("side", F.col("event_type") == "click")
    return two_sample_distances(two, [], "value", "side").select("n_a", "n_b", F.round("ks_statistic", 6).alias("ks_statistic"), F.round("wasserstein", 6).alias("wasserstein"))


@query("v6_pinball", """with m as (select event_type, avg(value) * 2.3 as pred from events group by 1), w as (select user_id, 1.0 / count(*) as w from events group by 1),
j as (select event_type, value, pred, w, greatest(0.9 * (value - pred), -0.1 * (value - pred)) as l from events join m using (event_type) join w using (user_id))
select event_type, round(avg(l), 6) as pinball, round(sum(w * l) / sum(w), 6) as weighted_pinball, round(avg((value <= pred)::int), 6) as coverage from j group by 1""")
def v6(t):
    means = t.events.groupBy("event_type").agg((F.avg("value") * 2.3).alias("pred"))
    rows = t.events.join(means, "event_type").join(e.family_weights(t.events, "user_id"), "user_id")
    loss = v.pinball(F.col("value"), F.col("pred"), 0.9)
    return rows.groupBy("event_type").agg(F.round(F.avg(loss), 6).alias("pinball"), F.round(F.sum(F.col("weight") * loss) / F.sum("weight"), 6).alias("weighted_pinball"),
                                          F.round(F.avg((F.col("value") <= F.col("pred")).cast("double")), 6).alias("coverage"))


@query("v7_interval_score", """with m as (select event_type, avg(value) - 0.8 * stddev_samp(value) as lo, avg(value) + 1.6 * stddev_samp(value) as hi from events group by 1), j as (select * from events join m using (event_type))
select event_type, round(avg(hi - lo), 6) as width, round(avg((value between lo and hi)::int), 6) as coverage,
  round(avg(hi - lo + case when value < lo then 20 * (lo - value) when value > hi then 20 * (value - hi) else 0 end), 6) as interval_score from j group by 1""")
def v7(t):
    m = t.events.groupBy("event_type").agg((F.avg("value") - 0.8 * F.stddev_samp("value")).alias("lo"), (F.avg("value") + 1.6 * F.stddev_samp("value")).alias("hi"))
    y, lo, hi = F.col("value"), F.col("lo"), F.col("hi")
    return t.events.join(m, "event_type").groupBy("event_type").agg(
        F.round(F.avg(hi - lo), 6).alias("width"), F.round(F.avg(y.between(lo, hi).cast("double")), 6).alias("coverage"), F.round(F.avg(v.interval_score(y, lo, hi, 0.1)), 6).alias("interval_score"))


CUTOFFS, HORIZONS = ["2023-12-20", "2024-01-05", "2024-01-12", "2024-01-19", "2024-01-26"], [3, 7]
_CASES = f"""d as (select event_type, ts::date as day, max(value) as top from events group by 1, 2), k as (select c::date as cutoff, h from (values {', '.join(f"('{c}')" for c in CUTOFFS)}) a(c), (values {', '.join(f'({h})' for h in HORIZONS)}) b(h)),
r as (select d.*, cutoff, h, (cutoff + h)::date as requested, least((cutoff + h)::date, (select max(day) from d)) as observed from d, k),
cases as (select event_type, cutoff, h as horizon_days, requested, observed, max(top) filter (day < cutoff) as persistence, max(top) filter (day <= observed) as truth from r group by all having max(top) filter (day < cutoff) is not null),
cs as (select *, date_diff('day', cutoff, observed) as actual_days, requested <= observed as complete, truth > persistence + 1e-12 as updated from cases)"""


def _cases(t):
    return v.record_cases(t.events, ["event_type"], "ts", "value", CUTOFFS, HORIZONS)


_MODELS = """md as (select *, 'persistence' as model, persistence as pred, persistence as lo, persistence as hi from cs union all select *, 'drift', persistence * 1.05, persistence, persistence * 1.25 from cs)"""


def _forecasts(t):
    p = F.col("persistence")
    models = F.explode(F.array(F.struct(F.lit("persistence").alias("model"), p.alias("pred"), p.alias("lo"), p.alias("hi")),
                               F.struct(F.lit("drift").alias("model"), (p * 1.05).alias("pred"), p.alias("lo"), (p * 1.25).alias("hi"))))
    return _cases(t).select("*", models.alias("m")).select("*", "m.*").drop("m").withColumn("abs_error", F.abs(F.col("pred") - F.col("truth")))


@query("v8_subset_metrics", f"""with {_CASES}, {_MODELS}, c7 as (select distinct cutoff from cs where complete and horizon_days = 7), s as (select *, 'all' as subset from md union all select *, 'complete' from md where complete
  union all select *, 'complete_3d' from md where complete and horizon_days = 3 union all select *, 'complete_7d' from md where complete and horizon_days = 7
  union all select *, 'common_3d' from md where complete and horizon_days = 3 and cutoff in (select cutoff from c7) union all select *, 'disjoint_7d' from md where complete and horizon_days = 7 and cutoff in (date '2024-01-05', date '2024-01-19'))
select model, subset, count(*) as cases, round(avg(abs(pred - truth)), 6) as mae, round(avg(abs(pred - truth)) filter (updated), 6) as mae_updates, round(avg((truth between lo and hi)::int), 6) as coverage, round(avg(hi - lo), 6) as width from s group by 1, 2""")
def v8(t):
    rows = _forecasts(t)
    full = rows.where("complete_window and horizon_days = 7").agg(F.collect_set("cutoff").alias("_common"))  # at most one entry per cutoff
    rows = with_row(rows, full)
    c, h = F.col("complete_window"), F.col("horizon_days")
    subsets = {"all": F.lit(True), "complete": c, "complete_3d": c & (h == 3), "complete_7d": c & (h == 7), "common_3d": c & (h == 3) & F.array_contains("_common", F.col("cutoff")),
               "disjoint_7d": c & (h == 7) & F.col("cutoff").isin([F.lit(x).cast("date") for x in ("2024-01-05", "2024-01-19")])}
    return v.subset_metrics(rows, subsets, [
        F.count(F.lit(1)).alias("cases"), F.round(F.avg("abs_error"), 6).alias("mae"), F.round(F.avg(F.when(F.col("record_updated"), F.col("abs_error"))), 6).alias("mae_updates"),
        F.round(F.avg(F.col("truth").between(F.col("lo"), F.col("hi")).cast("double")), 6).alias("coverage"), F.round(F.avg(F.col("hi") - F.col("lo")), 6).alias("width")])


@query("v9_persistence", f"with {_CASES} select event_type, strftime(cutoff, '%Y-%m-%d') as cutoff, horizon_days, persistence, truth, updated as record_updated, round(abs(truth - persistence), 6) as abs_error from cs")
def v9(t):
    return _cases(t).select("event_type", _day("cutoff").alias("cutoff"), "horizon_days", "persistence", "truth", "record_updated", F.round(F.abs(F.col("truth") - F.col("persistence")), 6).alias("abs_error"))


@query("v10_window_audit", f"""with {_CASES} select distinct strftime(cutoff, '%Y-%m-%d') as cutoff, horizon_days, strftime(requested, '%Y-%m-%d') as requested_end, strftime(observed, '%Y-%m-%d') as observed_end, actual_days::int as actual_days, complete as complete_window from cs""")
def v10(t):
    return _cases(t).select(_day("cutoff").alias("cutoff"), "horizon_days", _day("requested_end").alias("requested_end"), _day("observed_end").alias("observed_end"), "actual_days", "complete_window").distinct()


@query("v11_metric_recheck", f"""with {_PRED}, st as (select run, count(*) as n, round(avg(abs(pred - y)), 9) as mae, round(sqrt(avg((pred - y) ** 2)), 9) as rmse, round(avg(pred - y), 9) as bias from p group by 1),
c as (select run, n as nn, d, count(*) as k, sum(abs(pred - y)) as a, sum((pred - y) ** 2) as s, sum(pred - y) as b from p group by 1, 2, 3),
rb as (select run, sum(k)::bigint as k, sum(a) / sum(k) as mae2, sqrt(sum(s) / sum(k)) as rmse2, sum(b) / sum(k) as bias2 from c group by 1)
select st.run, n, mae, rmse, bias + 0.0 as bias, round(greatest(abs(mae - mae2), abs(rmse - rmse2), abs(bias - bias2)), 8) as worst, n - k as missing from st join rb on st.run = rb.run""")
def v11(t):
    """The metric table is written, read back and held against sums over the collapsed cells of the rows."""
    rows = _predicted(t)
    metrics = rows.groupBy("run").agg(*v.error_metrics(F.col("y"), F.col("pred"))).select("run", "n", *[(F.round(c, 9) + 0.0).alias(c) for c in ("mae", "rmse", "bias")])
    path = scratch_dir(t.spark, "metrics")
    write_result(metrics, path, "json")
    stored = t.spark.read.schema(metrics.schema).json(path)
    gap = F.col("pred") - F.col("y")
    cells = rows.groupBy("run", "n", "d").agg(F.count(F.lit(1)).alias("k"), F.sum(F.abs(gap)).alias("a"), F.sum(gap * gap).alias("s"), F.sum(gap).alias("b"))
    rebuilt = cells.groupBy("run").agg(F.sum("k").alias("k"), (F.sum("a") / F.sum("k")).alias("mae2"), F.sqrt(F.sum("s") / F.sum("k")).alias("rmse2"), (F.sum("b") / F.sum("k")).alias("bias2"))
    worst = F.greatest(*[F.abs(F.col(m) - F.col(m + "2")) for m in ("mae", "rmse", "bias")])
    return stored.join(rebuilt, "run").select("run", "n", "mae", "rmse", "bias", F.round(worst, 8).alias("worst"), (F.col("n") - F.col("k")).alias("missing"))
