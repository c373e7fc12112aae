"""Registered queries for compositions and mixture models (M). A recipe is a customer: shares of order value by priority."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions.numeric import correlation
from plumbline.functions.keys import draws_sql, hash_fold
from plumbline.operators import composition as c
from plumbline.operators.ranking import exact_quantiles, running
from plumbline.plans.registry import query
from plumbline.runtime import materialise, with_row

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
PARTS = ["p1", "p2", "p3", "p4", "p5"]
DELTA, EPS = 1e-3, 0.01
# Two fixed scoring models: output -> intercept and a coefficient per part.
LOG_MODEL = {"loss_a": [2.4, -0.031, 0.012, -0.008, 0.027, -0.019], "loss_b": [1.9, 0.006, -0.041, 0.015, -0.011, 0.022]}
ALT_MODEL = {"loss_a": [2.4, -0.024, 0.017, -0.013, 0.021, -0.022], "loss_b": [1.9, -0.004, -0.036, 0.021, -0.017, 0.029]}

_REC = "rec as (select o_custkey as id, " + ", ".join(
    f"sum(case when o_orderpriority = '{p}' then o_totalprice else 0 end) / sum(o_totalprice) as p{i + 1}" for i, p in enumerate(PRIORITIES)) + \
    ", ln(sum(o_totalprice)) as y1, avg(o_totalprice) / 1e5 as y2, avg((o_orderstatus = 'F')::int) as y3 from orders group by 1)"


def recipes(t):
    part = [(F.sum(F.when(F.col("o_orderpriority") == p, F.col("o_totalprice")).otherwise(0.0)) / F.sum("o_totalprice")).alias(f"p{i + 1}")
            for i, p in enumerate(PRIORITIES)]
    return t.orders.groupBy(F.col("o_custkey").alias("id")).agg(
        *part, F.ln(F.sum("o_totalprice")).alias("y1"), (F.avg("o_totalprice") / 1e5).alias("y2"),
        F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("y3"))


def _cols():
    return [F.col(p) for p in PARTS]


def _zero_sql(delta=DELTA):
    zeros = " + ".join(f"({p} <= 0)::int" for p in PARTS)
    mass = " + ".join(f"greatest({p}, 0)" for p in PARTS)
    return ", ".join(f"case when {p} <= 0 then {delta} else {p} / ({mass}) * (1 - ({zeros}) * {delta}) end as z{i + 1}" for i, p in enumerate(PARTS))


def _ilr_sql():
    out = []
    for i in range(1, 5):
        head = " + ".join(f"ln(z{j + 1})" for j in range(i))
        out.append(f"(({head}) - {i} * ln(z{i + 1})) / sqrt({i * (i + 1)}.0) as i{i}")
    return ", ".join(out)


_Z = f"{_REC}, zr as (select *, {_zero_sql()} from rec)"
_I = f"{_Z}, il as (select *, {_ilr_sql()} from zr)"


@query("m1_closure", f"""with {_REC}, r as (select id, {', '.join(f'round({p}, 3) as {p}' for p in PARTS)} from rec), s as (select *, {' + '.join(PARTS)} as total from r)
select id, round(total, 6) as original_sum, round(1 / total, 6) as closure_factor, {', '.join(f'round({p} / total, 6) as {p}' for p in PARTS)} from s""")
def m1(t):
    r = recipes(t).select("id", *[F.round(p, 3).alias(p) for p in PARTS])
    total, shares = c.closed(_cols())
    return r.select("id", F.round(total, 6).alias("original_sum"), F.round(1 / total, 6).alias("closure_factor"),
                    *[F.round(s, 6).alias(p) for s, p in zip(shares, PARTS)])


@query("m2_zero_replacement", f"with {_Z} select id, " + ", ".join(f"round(z{i}, 6) as z{i}" for i in range(1, 6)) + " from zr")
def m2(t):
    return recipes(t).select("id", *[F.round(z, 6).alias(f"z{i + 1}") for i, z in enumerate(c.zero_replaced(_cols(), DELTA))])


def _ilr_frame(t):
    z = recipes(t).select("*", *[x.alias(f"z{i + 1}") for i, x in enumerate(c.zero_replaced(_cols(), DELTA))])
    return z.select("*", *[x.alias(f"i{i + 1}") for i, x in enumerate(c.helmert_ilr([F.col(f"z{i}") for i in range(1, 6)]))])


@query("m3_ilr", f"with {_I} select id, " + ", ".join(f"round(i{i}, 6) as i{i}" for i in range(1, 5)) + " from il")
def m3(t):
    return _ilr_frame(t).select("id", *[F.round(f"i{i}", 6).alias(f"i{i}") for i in range(1, 5)])


_PAIRS = [(i, j) for i in range(1, 5) for j in range(i, 5)]


@query("m4_quadratic", f"with {_I} select id, " + ", ".join(f"round(i{i} * i{j}, 6) + 0.0 as i{i}_i{j}" for i, j in _PAIRS) + " from il")
def m4(t):
    squares = c.quadratic([F.col(f"i{i}") for i in range(1, 5)])[4:]
    return _ilr_frame(t).select("id", *[(F.round(x, 6) + 0.0).alias(f"i{i}_i{j}") for x, (i, j) in zip(squares, _PAIRS)])


@query("m5_log_share", f"with {_REC} select id, " + ", ".join(f"round(ln({p} + {DELTA}), 6) as l{i + 1}, round({p}, 6) as r{i + 1}" for i, p in enumerate(PARTS)) + " from rec")
def m5(t):
    out = [x for i, p in enumerate(PARTS) for x in (F.round(F.ln(F.col(p) + DELTA), 6).alias(f"l{i + 1}"), F.round(p, 6).alias(f"r{i + 1}"))]
    return recipes(t).select("id", *out)


@query("m6_standardise", f"with {_REC}, s as (select " + ", ".join(f"avg({x}) as m_{x}, stddev_pop({x}) as d_{x}" for x in ["p1", "p2", "y1", "y2"]) +
       " from rec) select id, " + ", ".join(f"round(({x} - m_{x}) / d_{x}, 6) + 0.0 as {x}" for x in ["p1", "p2", "y1", "y2"]) + " from rec, s")
def m6(t):
    names = ["p1", "p2", "y1", "y2"]
    return c.standardised(recipes(t).select("id", *names), names).select("id", *[(F.round(n, 6) + 0.0).alias(n) for n in names])


def _ridge_sql(y):
    return f"""select '{y}' as output, unnest(['intercept', 'x1', 'x2']) as feature, unnest([round(my - c1 * m1 - c2 * m2, 6), round(c1, 6), round(c2, 6)]) as coefficient
from (select *, b1 * dy / d1 as c1, b2 * dy / d2 as c2 from (select *, ((1 + a) * r1 - r * r2) / ((1 + a) * (1 + a) - r * r) as b1,
  ((1 + a) * r2 - r * r1) / ((1 + a) * (1 + a) - r * r) as b2 from (select 1.0 / count(*) as a, avg(x1) m1, avg(x2) m2, avg({y}) my, stddev_pop(x1) d1, stddev_pop(x2) d2,
  stddev_pop({y}) dy, corr(x1, x2) r, corr(x1, {y}) r1, corr(x2, {y}) r2 from (select *, ln(p1 + {DELTA}) as x1, ln(p2 + {DELTA}) as x2 from rec))))"""


@query("m7_ridge", f"with {_REC} " + " union all ".join(_ridge_sql(y) for y in ("y1", "y2", "y3")))
def m7(t):
    r = recipes(t).select("*", *[F.ln(F.col(p) + DELTA).alias(f"x{i + 1}") for i, p in enumerate(PARTS[:2])])
    return c.fit_ridge(r, ["x1", "x2"], ["y1", "y2", "y3"], 1.0).withColumn("coefficient", F.round("coefficient", 6))


@query("m8_cross_validated_grid")
def m8(t):
    r = recipes(t).withColumn("fold", hash_fold(F.col("id")))
    return c.cross_validate(r, PARTS, ["y1", "y2", "y3"], "fold", [1e-6, 1e-4, 5e-4, 1e-3], [10.0 ** k for k in range(-4, 5)])


_F5 = "(('0x' || substr(sha256(l_orderkey::varchar), 1, 8))::bigint % 5)::int"


@query("m9_mean_baseline", f"""with b as (select {_F5} as fold, l_extendedprice as y from lineitem), f as (select fold, count(*) as n, sum(y) as s from b group by 1),
a as (select sum(n) as n, sum(s) as s from f), m as (select fold, (a.s - f.s) / (a.n - f.n) as mean from f, a)
select fold, count(*) as n, round(any_value(mean), 4) as oof_mean, round(sqrt(avg((y - mean) * (y - mean))), 4) as rmse from b join m using (fold) group by 1""")
def m9(t):
    b = t.lineitem.select(hash_fold(F.col("l_orderkey")).alias("fold"), F.col("l_extendedprice").alias("y"))
    f = b.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"))
    m = with_row(f, f.agg(F.sum("n").alias("an"), F.sum("s").alias("as")))
    m = m.select("fold", ((F.col("as") - F.col("s")) / (F.col("an") - F.col("n"))).alias("mean"))
    return b.join(m, "fold").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.first("mean"), 4).alias("oof_mean"),
                                                 F.round(F.sqrt(F.avg((F.col("y") - F.col("mean")) ** 2)), 4).alias("rmse"))


@query("m10_promotion_gates", """
with b as (select l_returnflag, l_extendedprice as y, l_quantity as x from lineitem),
g as (select avg(y) as my, regr_slope(y, x) as b1, regr_intercept(y, x) as b0 from b), f as (select l_returnflag, regr_slope(y, x) as c1, regr_intercept(y, x) as c0 from b group by 1),
m as (select sqrt(avg((y - my) ** 2)) as mean_rmse, sqrt(avg((y - b0 - b1 * x) ** 2)) as linear_rmse, sqrt(avg((y - c0 - c1 * x) ** 2)) as flag_rmse, corr(y, b0 + b1 * x) as linear_corr
  from b join f using (l_returnflag), g)
select round(mean_rmse, 4) as mean_rmse, round(linear_rmse, 4) as linear_rmse, round(flag_rmse, 4) as flag_rmse, round((mean_rmse - linear_rmse) / mean_rmse, 6) as improvement,
  (mean_rmse - linear_rmse) / mean_rmse < 0.10 or linear_corr < 0.50 as baseline_failed, flag_rmse <= 0.97 * linear_rmse as richer_admitted,
  (linear_rmse - flag_rmse) / linear_rmse >= 0.03 as promoted from m""")
def m10(t):
    b = t.lineitem.select("l_returnflag", F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("x"))
    flag = b.groupBy("l_returnflag").agg(F.regr_slope("y", "x").alias("c1"), F.regr_intercept("y", "x").alias("c0"))
    whole = b.agg(F.avg("y").alias("my"), F.regr_slope("y", "x").alias("b1"), F.regr_intercept("y", "x").alias("b0"))
    wide = with_row(b.join(flag, "l_returnflag"), whole)
    y, x = F.col("y"), F.col("x")
    rmse = lambda p: F.sqrt(F.avg((y - p) ** 2))
    m = wide.agg(rmse(F.col("my")).alias("a"), rmse(F.col("b0") + F.col("b1") * x).alias("b"), rmse(F.col("c0") + F.col("c1") * x).alias("c"),
                 correlation(y, F.col("b0") + F.col("b1") * x).alias("r"))
    gain = (F.col("a") - F.col("b")) / F.col("a")
    return m.select(F.round("a", 4).alias("mean_rmse"), F.round("b", 4).alias("linear_rmse"), F.round("c", 4).alias("flag_rmse"), F.round(gain, 6).alias("improvement"),
                    ((gain < 0.10) | (F.col("r") < 0.50)).alias("baseline_failed"), (F.col("c") <= 0.97 * F.col("b")).alias("richer_admitted"),
                    ((F.col("b") - F.col("c")) / F.col("b") >= 0.03).alias("promoted"))


# part -> (quality group, mapping type); a part without a row has no mapping.
MAPPING = {"p1": ("F", "direct"), "p2": ("O", "near_direct"), "p3": ("P", "inferred"), "p4": ("F", "direct")}


@query("m11_mapped_quality", f"""with {_REC}, q as (select avg(case when o_orderstatus = 'F' then o_totalprice end) / 1e5 as qf,
  avg(case when o_orderstatus = 'O' then o_totalprice end) / 1e5 as qo from orders), m as (select id, p1 + p2 + p4 as coverage,
  case when p1 + p2 + p4 > 0 then (p1 * qf + p2 * qo + p4 * qf) / (p1 + p2 + p4) end as mapped from rec, q), f as (select quantile_cont(mapped, 0.5) as fill from m)
select id, round(coverage, 6) as coverage, round(coalesce(mapped, fill), 6) as mapped_mean from m, f""")
def m11(t):
    quality = t.orders.groupBy("o_orderstatus").agg((F.avg("o_totalprice") / 1e5).alias("q"))
    known = [p for p, (_, kind) in MAPPING.items() if kind in ("direct", "near_direct")]
    flat = quality.agg(*[F.max(F.when(F.col("o_orderstatus") == MAPPING[p][0], F.col("q"))).alias("q_" + p) for p in known])
    wide = with_row(recipes(t), flat)
    coverage = sum((F.col(p) for p in known), F.lit(0.0))
    top = sum((F.col(p) * F.col("q_" + p) for p in known), F.lit(0.0))
    m = materialise(wide.select("id", coverage.alias("coverage"), F.when(coverage > 0, top / coverage).alias("mapped")))
    filled = with_row(m, exact_quantiles(m, [], "mapped", {"fill": 0.5}))
    return filled.select("id", F.round("coverage", 6).alias("coverage"), F.round(F.coalesce("mapped", "fill"), 6).alias("mapped_mean"))


@query("m12_scale_slope", """
with p as (select l_suppkey, avg(l_quantity) filter (l_returnflag = 'A') as qa, avg(l_quantity) filter (l_returnflag = 'R') as qr,
  avg(l_extendedprice) filter (l_returnflag = 'A') as ea, avg(l_extendedprice) filter (l_returnflag = 'R') as er from lineitem group by 1),
d as (select 'quantity' as output, (qr - qa) / ln(60.0) as d from p union all select 'price', (er - ea) / ln(60.0) from p)
select output, round(quantile_cont(d, 0.5), 6) as slope, round(quantile_cont(d, 0.75) - quantile_cont(d, 0.25), 6) as slope_iqr from d where d is not null group by 1""")
def m12(t):
    side = lambda col, flag: F.avg(F.when(F.col("l_returnflag") == flag, F.col(col)))
    p = t.lineitem.groupBy("l_suppkey").agg(*[side(col, f).alias(n + f) for n, col in (("quantity", "l_quantity"), ("price", "l_extendedprice")) for f in "AR"])
    d = p.select(F.explode(F.array(*[F.struct(F.lit(n).alias("output"), ((F.col(n + "R") - F.col(n + "A")) / F.ln(F.lit(60.0))).alias("d")) for n in ("quantity", "price")])).alias("r")).select("r.*")
    q = exact_quantiles(d, ["output"], "d", {"a": 0.25, "b": 0.5, "c": 0.75})
    return q.select("output", F.round("b", 6).alias("slope"), F.round(F.col("c") - F.col("a"), 6).alias("slope_iqr"))


def _score_sql(model, output, parts):
    b = model[output]
    return f"({b[0]} + " + " + ".join(f"({k}) * ln({p} + {DELTA})" for k, p in zip(b[1:], parts)) + ")"


def _raise_sql(j, eps):
    shrink = f"((1 - {PARTS[j]} - {eps}) / greatest(1 - {PARTS[j]}, 1e-12))"
    return [f"({p} + {eps})" if i == j else f"({p} * {shrink})" for i, p in enumerate(PARTS)]


def _effects_sql(model):
    return " union all ".join(
        f"select id, '{PARTS[j]}' as part, {PARTS[j]} as share, '{o}' as output, {_score_sql(model, o, _raise_sql(j, EPS))} - {_score_sql(model, o, PARTS)} as effect from rec where {PARTS[j]} <= 1 - {EPS}"
        for j in range(5) for o in model)


def _effects(t, model, keep=("id",)):
    return c.replacement_effects(recipes(t), PARTS, model, DELTA, EPS, keep)


@query("m13_replacement_effects", f"""with {_REC}, e as ({_effects_sql(LOG_MODEL)}), s as (select part, output, avg(effect) as m, quantile_cont(effect, 0.5) as md, count(*) as n from e group by 1, 2),
w as ({draws_sql('e', 'id', 300)}), b as (select part, output, rep, sum(w * effect) / sum(w) as m from w where w > 0 group by 1, 2, 3),
ci as (select part, output, quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi from b group by 1, 2)
select s.part, s.output, round(s.m, 6) as mean_effect, round(md, 6) as median_effect, n as recipes, round(lo, 6) as ci_low, round(hi, 6) as ci_high
from s join ci on s.part = ci.part and s.output = ci.output""")
def m13(t):
    rows = materialise(_effects(t, LOG_MODEL))
    s = c.effect_summary(rows, ["part", "output"], {"median_effect": 0.5}).join(c.effect_intervals(rows, "id", [(p, o) for p in PARTS for o in LOG_MODEL], 300), ["part", "output"])
    return s.select("part", "output", "recipes", *[F.round(n, 6).alias(n) for n in ("mean_effect", "median_effect", "ci_low", "ci_high")])


@query("m14_effects_by_tercile", f"""with {_REC}, e as ({_effects_sql(LOG_MODEL)}), k as (select part, output, quantile_cont(share, 1.0/3) as t1, quantile_cont(share, 2.0/3) as t2 from e group by 1, 2),
b as (select e.*, len(list_filter(list_distinct([t1, t2]), lambda v: v < share))::int as band from e join k on e.part = k.part and e.output = k.output)
select part, output, band, round(min(share), 6) as share_min, round(max(share), 6) as share_max, round(avg(effect), 6) as mean_effect, count(*) as recipes from b group by 1, 2, 3""")
def m14(t):
    return c.share_terciles(materialise(_effects(t, LOG_MODEL))).groupBy("part", "output", "band").agg(
        F.round(F.min("share"), 6).alias("share_min"), F.round(F.max("share"), 6).alias("share_max"), F.round(F.avg("effect"), 6).alias("mean_effect"), F.count(F.lit(1)).alias("recipes"))


@query("m15_donor_effects", f"with {_REC}, e as (" + " union all ".join(
    f"select '{PARTS[j]}' as part, '{o}' as output, {_score_sql(LOG_MODEL, o, [f'({p} + {EPS})' if i == j else f'({p} - {EPS})' if i == 4 else p for i, p in enumerate(PARTS)])}"
    f" - {_score_sql(LOG_MODEL, o, PARTS)} as effect from rec where p5 >= {EPS} and {PARTS[j]} <= 1 - {EPS}" for j in range(4) for o in LOG_MODEL) +
    ") select part, output, round(avg(effect), 6) as mean_effect, round(quantile_cont(effect, 0.5), 6) as median_effect, count(*) as recipes from e group by 1, 2 having count(*) >= 10")
def m15(t):
    rows = materialise(c.donor_effects(recipes(t), PARTS, 4, LOG_MODEL, DELTA, EPS))
    s = c.effect_summary(rows, ["part", "output"], {"median_effect": 0.5}, least=10)
    return s.select("part", "output", "recipes", F.round("mean_effect", 6).alias("mean_effect"), F.round("median_effect", 6).alias("median_effect"))


def _pair_sql():
    out = []
    for j in range(5):
        for k in range(j + 1, 5):
            rest = f"(1 - {PARTS[j]} - {PARTS[k]})"
            both = [f"({p} + {EPS / 2})" if i in (j, k) else f"({p} * (({rest} - {EPS}) / greatest({rest}, 1e-12)))" for i, p in enumerate(PARTS)]
            for o in LOG_MODEL:
                f = lambda parts: _score_sql(LOG_MODEL, o, parts)
                out.append(f"select '{PARTS[j]}' as part_a, '{PARTS[k]}' as part_b, '{o}' as output, {f(both)} - {f(_raise_sql(j, EPS / 2))} - {f(_raise_sql(k, EPS / 2))} + {f(PARTS)} as effect "
                           f"from rec where {PARTS[j]} + {PARTS[k]} <= 1 - {EPS}")
    return " union all ".join(out)


@query("m16_pair_interactions", f"""with {_REC}, e as ({_pair_sql()}) select part_a, part_b, output, round(avg(effect), 6) + 0.0 as mean_effect, round(quantile_cont(effect, 0.5), 6) + 0.0 as median_effect,
  round(quantile_cont(effect, 0.05), 6) + 0.0 as p05, round(quantile_cont(effect, 0.95), 6) + 0.0 as p95, count(*) as recipes from e group by 1, 2, 3""")
def m16(t):
    rows = materialise(c.pair_interactions(recipes(t), PARTS, LOG_MODEL, DELTA, EPS))
    s = c.effect_summary(rows, ["part_a", "part_b", "output"], {"median_effect": 0.5, "p05": 0.05, "p95": 0.95})
    return s.select("part_a", "part_b", "output", "recipes", *[(F.round(n, 6) + 0.0).alias(n) for n in ("mean_effect", "median_effect", "p05", "p95")])


@query("m17_effect_consistency", f"""with {_REC}, a as (select part, output, avg(effect) as a from ({_effects_sql(LOG_MODEL)}) group by 1, 2), b as (select part, output, avg(effect) as b from ({_effects_sql(ALT_MODEL)}) group by 1, 2),
j as (select a.output, a.part, a, b, rank() over (partition by a.output order by a) as ra, rank() over (partition by a.output order by b) as rb from a join b on a.part = b.part and a.output = b.output),
s as (select output, count(*) as cells, round(corr(ra, rb), 6) as rank_spearman, round(avg((sign(a) = sign(b))::int), 6) as sign_agreement,
  count(*) filter (abs(a) >= 0.001 or abs(b) >= 0.001) as material_cells, round(avg(abs(ra - rb)), 6) as mean_rank_difference,
  round(len(list_intersect(list(part) filter (ra <= 2), list(part) filter (rb <= 2))) / len(list_distinct(list_concat(list(part) filter (ra <= 2), list(part) filter (rb <= 2)))), 6) as top_jaccard,
  arg_min(part, a) = arg_min(part, b) as best_same from j group by 1) select * from s""")
def m17(t):
    mean = lambda model, n: _effects(t, model).groupBy("part", "output").agg(F.avg("effect").alias(n))
    j = mean(LOG_MODEL, "a").join(mean(ALT_MODEL, "b"), ["part", "output"])
    # one row per (part, output): the windows below see at most as many rows as there are parts
    j = j.withColumn("ra", F.rank().over(Window.partitionBy("output").orderBy("a"))).withColumn("rb", F.rank().over(Window.partitionBy("output").orderBy("b")))
    top_a, top_b = F.collect_list(F.when(F.col("ra") <= 2, F.col("part"))), F.collect_list(F.when(F.col("rb") <= 2, F.col("part")))
    return j.groupBy("output").agg(
        F.count(F.lit(1)).alias("cells"), F.round(correlation("ra", "rb"), 6).alias("rank_spearman"),
        F.round(F.avg((F.signum("a") == F.signum("b")).cast("double")), 6).alias("sign_agreement"),
        F.count_if((F.abs("a") >= 0.001) | (F.abs("b") >= 0.001)).alias("material_cells"), F.round(F.avg(F.abs(F.col("ra") - F.col("rb"))), 6).alias("mean_rank_difference"),
        F.round(F.size(F.array_intersect(top_a, top_b)) / F.size(F.array_union(top_a, top_b)), 6).alias("top_jaccard"),
        (F.min_by("part", "a") == F.min_by("part", "b")).alias("best_same"))


_INDEX = f"""{_REC}, y as (select id, y3 >= 0.3 as is_ref, {', '.join(f'{_score_sql(LOG_MODEL, o, PARTS)} as {o}' for o in LOG_MODEL)} from rec),
st as (select {', '.join(f'avg({o}) as m_{o}, stddev_samp({o}) as d_{o}' for o in LOG_MODEL)} from y where is_ref),
rw as (select y.*, ({' + '.join(f'({o} - m_{o}) / d_{o}' for o in LOG_MODEL)}) / 2 as raw from y, st), cs as (select avg(raw) as cc, stddev_samp(raw) as ss from rw where is_ref),
ix as (select id, loss_a, -(raw - cc) / ss as r_index from rw, cs), rk as (select *, rank() over (order by round(r_index, 9) desc) as rank from ix)"""


def _indexed(t):
    y = recipes(t).select("id", (F.col("y3") >= 0.3).alias("is_ref"), *[c.log_score(LOG_MODEL, o, _cols(), DELTA).alias(o) for o in LOG_MODEL])
    return c.relative_index(materialise(y), list(LOG_MODEL), "is_ref")


@query("m18_relative_index", f"with {_INDEX} select id, round(r_index, 6) + 0.0 as r_index, rank from rk")
def m18(t):
    return _indexed(t).select("id", (F.round("r_index", 6) + 0.0).alias("r_index"), "rank")


@query("m19_mixture_scenarios", f"""with {_INDEX}, p as (select r_index, loss_a, row_number() over (order by rank, id) as o, count(*) over () as n from rk),
w as (select case o when 1 then 'best' when n then 'worst' else 'median' end as role, r_index, loss_a from p where o in (1, n // 2 + 1, n))
select role, eta::double as eta, round(exp(-eta * r_index), 6) as multiplier, round(1.7 + (loss_a - 1.7) * exp(-eta * r_index), 6) as conditional_loss from w, (values (0.0), (0.25), (0.5)) e(eta)""")
def m19(t):
    line = running(_indexed(t).withColumn("_one", F.lit(1)), [], ["rank", "id"], {"o": ("sum", "_one")})
    middle = F.floor(F.col("o_total") / 2) + 1
    role = F.when(F.col("o") == 1, "best").when(F.col("o") == F.col("o_total"), "worst").when(F.col("o") == middle, "median")
    rows = line.withColumn("role", role).where("role is not null").withColumn("eta", F.explode(F.array(F.lit(0.0), F.lit(0.25), F.lit(0.5))))
    m = F.exp(-F.col("eta") * F.col("r_index"))
    return rows.select("role", "eta", F.round(m, 6).alias("multiplier"), F.round(1.7 + (F.col("loss_a") - 1.7) * m, 6).alias("conditional_loss"))
