"""Registered queries for scaling-law fits (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import laws
from plumbline.functions.arrays import quantile_of
from plumbline.functions.keys import POISSON_ONE, hash_fold, hex_number, poisson_weight
from plumbline.operators import fitting as f
from plumbline.operators import lawfit as lf
from plumbline.operators import metrics as v
from plumbline.operators.splits import time_block
from plumbline.plans.frontier import _M, _PRED, _predicted, _round_metrics
from plumbline.plans.registry import query
from plumbline.plans.trials import KAPPA, LAW, TRIALS_SQL, ndq, trials
from plumbline.runtime import materialise, materialise_evenly, with_row, written

ALPHAS = [0.14, 0.24, 0.34, 0.44, 0.54]
BETAS = [0.08, 0.18, 0.28, 0.38, 0.48]
KAPPAS = [round(0.1 * k, 1) for k in range(0, 11)]
FOLD = "(('0x' || substr(sha256({}), 1, 8))::bigint % 5)::int"
_COV = {"uu": ("su", "su", "suu"), "vv": ("sv", "sv", "svv"), "uv": ("su", "sv", "suv"), "uy": ("su", "sy", "suy"), "vy": ("sv", "sy", "svy"), "yy": ("sy", "sy", "syy")}
_SUMS = f"""t as ({TRIALS_SQL}), g as (select t.*, a::double as alpha, b::double as beta, n ** -a::double as u, d ** -b::double as v from t, (values {', '.join(f'({a})' for a in ALPHAS)}) x(a), (values {', '.join(f'({b})' for b in BETAS)}) z(b)),
s as (select {{by}} alpha, beta, count(*)::double as s1, sum(u) su, sum(v) sv, sum(y) sy, sum(u*u) suu, sum(v*v) svv, sum(u*v) suv, sum(u*y) suy, sum(v*y) svy, sum(y*y) syy from g group by all)"""
_FIT = "c as (select *, " + ", ".join(f"{ab} - {a} * {b} / s1 as c{n}" for n, (a, b, ab) in _COV.items()) + """ from {src}),
k as (select *, (cuy * cvv - cvy * cuv) / (cuu * cvv - cuv * cuv) as A_, (cvy * cuu - cuy * cuv) / (cuu * cvv - cuv * cuv) as B_ from c),
p as (select *, (sy - A_ * su - B_ * sv) / s1 as E_, cyy - A_ * cuy - B_ * cvy as sse from k where A_ > 0 and B_ > 0 and (sy - A_ * su - B_ * sv) / s1 > 0)"""


@query("f1_law_grid", f"with {_SUMS.format(by='')}, {_FIT.format(src='s')} select alpha, beta, round(E_, 5) as e, round(A_, 5) as a, round(B_, 5) as b, round(sqrt(sse / s1), 6) as rmse from p order by sse limit 1")
def f1(t):
    best = f.best_law(f.closed_form(f.law_sums(f.design_points(f.design_cells(trials(t.lineitem))), ALPHAS, BETAS)))
    return best.select("alpha", "beta", F.round("E", 5).alias("e"), F.round("A", 5).alias("a"), F.round("B", 5).alias("b"), F.round(F.sqrt(F.col("sse") / F.col("s1")), 6).alias("rmse"))


@query("f1_law_fit")
def f1_fit(t):
    cells = f.design_cells(trials(t.lineitem))
    return f.fit_law(cells, "raw").unionByName(f.fit_law(cells, "log"))


def law_fit_sql(name, points, steps=25):
    """Recursive Gauss-Newton in SQL: `points` (fit, n, d, w, wy) -> `name`_fit (fit, E, A, alpha, B, beta), by elimination."""
    k, j = 5, ["1.0", "u", "lu", "v", "lv"]
    sums = ", ".join([f"sum(w * {j[x]} * {j[y]}) as m{x}{y}" for x in range(k) for y in range(x, k)] + [f"sum((wy - w * pr) * {j[x]}) as m{x}5" for x in range(k)])
    cur = f"""select fit, it, e, a, al, b, be, {sums} from (select s.*, w, wy, a * n ** -al as u, -a * n ** -al * ln(n) as lu, b * d ** -be as v, -b * d ** -be * ln(d) as lv,
      e + a * n ** -al + b * d ** -be as pr from {name} s join {points} p using (fit) where it < {steps}) group by all"""
    for p in range(k - 1):
        kept = [f"m{x}{y}" for x in range(p + 1) for y in range(x, k + 1)]
        cur = f"select fit, it, e, a, al, b, be, {', '.join(kept + [f'm{x}{y} - m{p}{x} * m{p}{y} / m{p}{p} as m{x}{y}' for x in range(p + 1, k) for y in range(x, k + 1)])} from ({cur})"
    for x in range(k - 1, -1, -1):
        cur = f"select *, (m{x}5{''.join(f' - m{x}{y} * x{y}' for y in range(x + 1, k))}) / m{x}{x} as x{x} from ({cur})"
    cur = f"""select fit, it + 1, e + x0, a * exp(greatest(-1, least(1, x1))), al + greatest(-0.2, least(0.2, x2)), b * exp(greatest(-1, least(1, x3))), be + greatest(-0.2, least(0.2, x4)) from ({cur})"""
    return f"""{name}(fit, it, e, a, al, b, be) as (select distinct fit, 0, 1.0::double, 1.0::double, 0.5::double, 1.0::double, 0.5::double from {points} union all {cur}),
{name}_fit as materialized (select fit, e as "E", a as "A", al as alpha, b as "B", be as beta from {name} where it = {steps})"""


_S = "greatest(0.0, 1 - q)"
_FORM_SQL = f"""case kind when 'none' then "E" + rn + rd when 'additive' then "E" + rn + rd + kappa * {_S} when 'reducible_linear' then "E" + (rn + rd) * (1 + kappa * {_S})
  when 'reducible_power' then "E" + (rn + rd) * (1 + kappa * {_S} ** 1.5) when 'effective_data' then "E" + rn + rd * exp(beta * kappa * {_S}) else "E" + rn * greatest(q, 0.001) ** -kappa + rd end"""
_SLOPE_SQL = f"""case kind when 'none' then 0.0 when 'additive' then {_S} when 'reducible_linear' then (rn + rd) * {_S} when 'reducible_power' then (rn + rd) * {_S} ** 1.5
  when 'effective_data' then rd * exp(beta * kappa * {_S}) * beta * {_S} else -ln(greatest(q, 0.001)) * rn * greatest(q, 0.001) ** -kappa end"""
_TERMS = '"A" * n ** -alpha as rn, "B" * d ** -beta as rd'


def quality_fit_sql(name, rows, train, kinds, steps=12):
    """Gauss-Newton on the Huber cost of log residuals in SQL: `rows` (n, d, q, y, k, ...) where `train` holds, laws from g_fit -> `name`_fit (fit, kind, kappa, E ..., cost)."""
    sums = f"""select fit, kind, it, kappa, sum(k * w * g * r) as t, sum(k * w * g * g) as b, sum(k * case when abs(r) <= 0.01 then 0.5 * r * r else 0.01 * (abs(r) - 0.005) end) as cost from (
      select *, least(1.0, 0.01 / greatest(abs(r), 1e-300)) as w from (select fit, kind, it, kappa, k, ln(p) - ln(y) as r, j / p as g from (select *, {_FORM_SQL} as p, {_SLOPE_SQL} as j from (
        select x.*, f.fit, s.kind, s.it, s.kappa, f."E", f.beta, {_TERMS} from {{state}} s join g_fit f using (fit) join {rows} x on {train})))) group by all"""
    return f"""{name}(fit, kind, it, kappa) as (select fit, kind, 0, case when kind = 'none' then 0.0 else 0.3 end::double from g_fit, (values {', '.join(f"('{k}')" for k in kinds)}) z(kind)
  union all select fit, kind, it + 1, case when b > 0 then greatest(0.0, least(5.0, kappa - t / b)) else kappa end from ({sums.format(state=f'(select * from {name} where it < {steps})')})),
{name}_fit as materialized (select c.fit, c.kind, c.kappa, c.cost, f.* exclude (fit) from ({sums.format(state=f'(select * from {name} where it = {steps})')}) c join g_fit f on c.fit = f.fit)"""


_CELLS_SQL = f"cl as materialized (select n, d, q, y, count(*)::double as k {{more}} from ({TRIALS_SQL}) group by all)"


@query("f2_quality_grid", f"""with recursive {_CELLS_SQL.format(more='')}, pts as materialized (select 0 as fit, n, d, sum(k) as w, sum(k * y) as wy from cl where q >= 0.999 group by 2, 3), {law_fit_sql('g', 'pts')},
{quality_fit_sql('h', 'cl', 'true', ('additive', 'reducible_linear', 'n_power'))} select kind, round(kappa, 6) as kappa, round(cost, 6) as cost from h_fit""")
def f2(t):
    """Quality parameter of three forms on top of the law that the trials of full quality give."""
    cells = materialise(f.design_cells(trials(t.lineitem)).withColumn("k", F.col("k").cast("double")).withColumn("share", F.array(F.lit(1.0))))
    law = lf.fit_laws(_full_quality(cells), 1)
    fits = lf.fit_quality(cells, law, ["additive", "reducible_linear", "n_power"])
    return fits.select("kind", F.round("kappa", 6).alias("kappa"), F.round("cost", 6).alias("cost"))


def _full_quality(cells):
    """Design points of the cells of full quality, with the weight of each in every fit."""
    k, y = F.col("k"), F.col("y")
    return cells.where("q >= 0.999").groupBy("n", "d", "share").agg(F.sum(k).alias("w"), F.sum(k * y).alias("wy"), F.sum(k * y * y).alias("wyy"))


_REST = "rest as (select s.run as held, s.alpha, s.beta, " + ", ".join(f"w.{c} - s.{c} as {c}" for c in f.SUMS) + \
    " from s join (select alpha, beta, " + ", ".join(f"sum({c}) as {c}" for c in f.SUMS) + " from s group by 1, 2) w on s.alpha = w.alpha and s.beta = w.beta)"


@query("f3_leave_group_out", f"""with {_SUMS.format(by='run,')}, {_REST}, {_FIT.format(src='rest')}, best as (select * from (select *, row_number() over (partition by held order by sse) as rn from p) where rn = 1)
select t.run, count(*) as rows, any_value(best.alpha) as alpha, any_value(best.beta) as beta, round(sqrt(avg((E_ + A_ * n ** -best.alpha + B_ * d ** -best.beta - y) ** 2)), 6) as rmse from t join best on t.run = best.held group by 1""")
def f3(t):
    out = f.leave_group_out(f.design_cells(trials(t.lineitem), ["run"]), "run", ALPHAS, BETAS)
    return out.select("run", "rows", "alpha", "beta", F.round(F.sqrt(F.col("sse") / F.col("rows")), 6).alias("rmse"))


_OWN = '"E" + "A" * n ** -alpha + "B" * d ** -beta'


@query("f4_time_block", f"""with recursive t as materialized ({TRIALS_SQL}), cut as (select run, quantile_cont(d, 0.75) as cut from t group by 1),
pts as materialized (select 0 as fit, n, d, count(*)::double as w, sum(y) as wy from t join cut using (run) where d <= cut group by 2, 3), {law_fit_sql('g', 'pts')},
p as (select t.*, d <= cut as tr, {_OWN} as pred from t join cut using (run), g_fit)
select run, count(*) filter (tr) as train_rows, count(*) filter (not tr) as test_rows, round(sqrt(avg((pred - y) ** 2) filter (tr)), 6) as train_rmse, round(sqrt(avg((pred - y) ** 2) filter (not tr)), 6) as test_rmse,
  round(any_value(g_fit.alpha), 5) as alpha, round(any_value(g_fit.beta), 5) as beta from p join g_fit on true group by 1""")
def f4(t):
    """One law fitted on the early tokens of every run, scored on the early and on the late ones."""
    rows = materialise(time_block(trials(t.lineitem), ["run"], "d", 0.75))
    law = lf.fit_laws(lf.law_points(rows.where("is_train")).withColumn("share", F.array(F.lit(1.0))), 1)
    scored = with_row(rows, law.select(*lf.NAMES)).withColumn("pred", laws.loss({k: F.col(k) for k in lf.NAMES}, F.col("n"), F.col("d")))
    e2, tr = (F.col("pred") - F.col("y")) ** 2, F.col("is_train")
    return scored.groupBy("run").agg(F.count_if(tr).alias("train_rows"), F.count_if(~tr).alias("test_rows"), F.round(F.sqrt(F.avg(F.when(tr, e2))), 6).alias("train_rmse"),
                                     F.round(F.sqrt(F.avg(F.when(~tr, e2))), 6).alias("test_rmse"), *[F.round(F.first(c), 5).alias(c) for c in ("alpha", "beta")])


@query("f5_random_rows", f"""with recursive t as materialized (select *, {FOLD.format('l_orderkey::varchar')} as fold from ({TRIALS_SQL})),
pts as materialized (select f::int as fit, n, d, count(*)::double as w, sum(y) as wy from t, range(5) z(f) where fold <> f group by 1, 2, 3), {law_fit_sql('g', 'pts')},
p as (select t.*, {_OWN} as pred from t join g_fit on fold = fit) select fold, {_M} from p group by 1""")
def f5(t):
    """Every fold predicted by the law fitted on the others; rows of one run stand on both sides, so this is optimistic."""
    rows = materialise(trials(t.lineitem).withColumn("fold", hash_fold(F.col("l_orderkey"))))
    share = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda f: (f != F.col("fold")).cast("double"))
    law = lf.fit_laws(lf.law_points(rows, ["fold"]).withColumn("share", share), 5)
    packed = law.agg(F.array_sort(F.collect_list(F.struct("fit", *lf.NAMES))).alias("folds"))
    own = with_row(rows, packed).withColumn("g", F.get("folds", F.col("fold"))).withColumn("pred", laws.loss({k: F.col("g." + k) for k in lf.NAMES}, F.col("n"), F.col("d")))
    return _round_metrics(own.groupBy("fold").agg(*v.error_metrics(F.col("y"), F.col("pred"))))


_SHAPE = f"({LAW['A']} * n ** -{LAW['alpha']} + {LAW['B']} * d ** -{LAW['beta']})"


def _nn_sql(n, sx, sy, sxx, sxy):
    slope = f"(({n} * {sxy} - {sx} * {sy}) / ({n} * {sxx} - {sx} * {sx}))"
    icept = f"(({sy} - {slope} * {sx}) / {n})"
    thr, flat = f"greatest(0.0, {sxy} / {sxx})", f"greatest(0.0, {sy} / {n})"
    edge = f"2 * {thr} * {sxy} - {thr} * {thr} * {sxx} >= 2 * {flat} * {sy} - {flat} * {flat} * {n}"
    ok = f"{slope} >= 0 and {icept} >= 0"
    return f"case when {ok} then {icept} when {edge} then 0.0 else {flat} end", f"case when {ok} then {slope} when {edge} then {thr} else 0.0 end"


_NN = _nn_sql("m", "sx", "sy", "sxx", "sxy")
_LS = "count(*)::double as m, sum(x) sx, sum(y) sy, sum(x*x) sxx, sum(x*y) sxy, sum(y*y) syy"


def _shaped(t):
    n, d, _ = ndq()
    return trials(t.lineitem).withColumn("x", laws.size_term(LAW, n) + laws.data_term(LAW, d))


@query("f6_source_calibration", f"""with t as (select *, {_SHAPE} as x from ({TRIALS_SQL})), cut as (select run, quantile_cont(d, 0.7) as cut from t group by 1), s as (select run, {_LS} from t group by 1), c as (select run, m, {_NN[0]} as a, {_NN[1]} as b from s),
es as (select run, {_LS} from t join cut using (run) where d <= cut group by 1), ec as (select run, {_NN[0]} as ea, {_NN[1]} as eb from es)
select run, count(*) as rows, round(any_value(a), 5) as calibration_e, round(any_value(b), 5) as calibration_scale, round(sqrt(avg((y - {LAW['E']} - x) ** 2)), 6) as rmse_uncalibrated, round(sqrt(avg((y - a - b * x) ** 2)), 6) as rmse_affine,
  round(sqrt(avg((y - ea - eb * x) ** 2) filter (d > cut)), 6) as rmse_late from t join c using (run) join cut using (run) join ec using (run) group by 1""")
def f6(t):
    rows = time_block(_shaped(t), ["run"], "d", 0.7)
    x, y = F.col("x"), F.col("y")
    sums = f.line_sums(rows, ["run"], x, y)
    a, b = f.nonnegative_line(*[F.col(c) for c in ("m", "sx", "sy", "sxx", "sxy")])
    whole = sums.withColumn("a", a).withColumn("b", b).select(
        "run", F.col("m").cast("long").alias("rows"), "a", "b", F.sqrt(f.line_sse(F.lit(LAW["E"]), F.lit(1.0)) / F.col("m")).alias("u"), F.sqrt(f.line_sse(F.col("a"), F.col("b")) / F.col("m")).alias("s"))
    early = f.line_sums(rows.where("is_train"), ["run"], x, y).select("run", a.alias("ea"), b.alias("eb"))
    late = f.line_sums(rows.where("not is_train"), ["run"], x, y).join(early, "run").select("run", F.sqrt(f.line_sse(F.col("ea"), F.col("eb")) / F.col("m")).alias("l"))
    return whole.join(late, "run").select("run", "rows", F.round("a", 5).alias("calibration_e"), F.round("b", 5).alias("calibration_scale"), F.round("u", 6).alias("rmse_uncalibrated"), F.round("s", 6).alias("rmse_affine"), F.round("l", 6).alias("rmse_late"))


def _group_fold():
    return hash_fold(F.concat_ws("|", F.col("n").cast("int").cast("string"), F.col("d").cast("int").cast("string")))


_FOLD_SQL = FOLD.format("n::int || '|' || d::int")
_NEW_SQL = "(round(100 * (1 - q) / 5)::bigint % 2 = 1)"
_KIND_METRICS = "sum(k)::bigint as n, round(sum(k * abs(p - y)) / sum(k), 6) as mae, round(sqrt(sum(k * (p - y) ** 2) / sum(k)), 6) as rmse"


def _new_level():
    """Whether the trial stands at a quality level that the new-level split keeps from training: every second one."""
    return F.round(100 * (1 - F.col("q")) / 5).cast("long") % 2 == 1


@query("f7_candidate_folds", f"""with recursive {_CELLS_SQL.format(more=f', {_FOLD_SQL} as fold, {_NEW_SQL} as fresh')},
pts as materialized (select f::int as fit, n, d, sum(k) as w, sum(k * y) as wy from cl, range(6) z(f) where q >= 0.999 and fold <> f group by 1, 2, 3), {law_fit_sql('g', 'pts')},
{quality_fit_sql('h', 'cl', '(f.fit < 5 and x.fold <> f.fit or f.fit = 5 and not x.fresh)', laws.KINDS)},
pr as (select *, {_FORM_SQL} as p from (select cl.*, h_fit.*, case when fit = 5 then 'new_level' else 'grouped_5fold' end as split, {_TERMS} from cl join h_fit on fit < 5 and fold = fit or fit = 5 and fresh)),
m as (select split, kind, {_KIND_METRICS} from pr group by 1, 2)
select m.*, round(lo, 5) as kappa_low, round(hi, 5) as kappa_high from m join (select case when fit = 5 then 'new_level' else 'grouped_5fold' end as split, kind, min(kappa) as lo, max(kappa) as hi from h_fit group by 1, 2) using (split, kind)""")
def f7(t):
    """Six quality forms, law and parameter fitted in every training part: five folds of (size, tokens) groups, and held-out quality levels."""
    cells = f.design_cells(trials(t.lineitem).withColumn("fold", _group_fold()).withColumn("fresh", _new_level()), ["fold", "fresh"]).withColumn("k", F.col("k").cast("double"))
    folds = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: (i != F.col("fold")).cast("double"))
    cells = materialise(cells.withColumn("share", F.concat(folds, F.array((~F.col("fresh")).cast("double")))))
    fits = lf.fit_quality(cells, lf.fit_laws(_full_quality(cells), 6), laws.KINDS)
    split = F.when(F.col("fit") == 5, "new_level").otherwise("grouped_5fold")
    rows = lf.predicted(cells, fits, (F.col("fit") == F.col("fold")) | (F.col("fit") == 5) & F.col("fresh")).withColumn("split", split)
    k, e = F.col("k"), F.col("p") - F.col("y")
    scores = rows.groupBy("split", "kind").agg(F.sum("k").cast("long").alias("n"), F.round(F.sum(k * F.abs(e)) / F.sum("k"), 6).alias("mae"), F.round(F.sqrt(F.sum(k * e * e) / F.sum("k")), 6).alias("rmse"))
    spread = fits.groupBy(split.alias("split"), "kind").agg(F.round(F.min("kappa"), 5).alias("kappa_low"), F.round(F.max("kappa"), 5).alias("kappa_high"))
    return scores.join(spread, ["split", "kind"])


@query("f8_new_keys", """with a as (select distinct l_quantity, round(l_discount, 10) as k, l_linenumber from lineitem where l_returnflag = 'A'), r as (select distinct l_quantity, round(l_discount, 10) as k, l_linenumber, l_tax from lineitem where l_returnflag = 'R')
select l_linenumber, count(*) as new_rows from r where not exists (select 1 from a where a.l_quantity = r.l_quantity and a.k = r.k and a.l_linenumber = r.l_linenumber) group by 1""")
def f8(t):
    keyed = t.lineitem.withColumn("k", F.round("l_discount", 10))
    key = ["l_quantity", "k", "l_linenumber"]
    old = keyed.where("l_returnflag = 'A'").groupBy(*key).agg(F.lit(1).alias("x")).drop("x")
    new = keyed.where("l_returnflag = 'R'").groupBy(*key, "l_tax").agg(F.lit(1).alias("x")).drop("x")
    return new.join(old, key, "left_anti").groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("new_rows"))


@query("f9_pressure_test", f"with {_PRED} select case when n > 40 then 'extrapolated' when q < 0.6 then 'low_quality' else 'calibrated' end as data_type, {_M} from p group by 1")
def f9(t):
    kind = F.when(F.col("n") > 40, "extrapolated").when(F.col("q") < 0.6, "low_quality").otherwise("calibrated")
    return _round_metrics(_predicted(t).groupBy(kind.alias("data_type")).agg(*v.error_metrics(F.col("y"), F.col("pred"))))


_INNER_SQL = "(('0x' || substr(sha256('inner|' || n::int || '|' || d::int), 1, 8))::bigint % 4)::int"
_IN_TRAIN = "(f.fit < 5 and x.fold <> f.fit or f.fit >= 5 and x.fold <> (f.fit - 5) // 4 and x.inn <> (f.fit - 5) % 4)"


@query("f10_nested_selection", f"""with recursive {_CELLS_SQL.format(more=f', {_FOLD_SQL} as fold, {_INNER_SQL} as inn')},
pts as materialized (select f.fit::int as fit, n, d, sum(k) as w, sum(k * y) as wy from cl x, range(25) f(fit) where q >= 0.999 and {_IN_TRAIN} group by 1, 2, 3), {law_fit_sql('g', 'pts')}, {quality_fit_sql('h', 'cl', _IN_TRAIN, laws.KINDS)},
pr as (select *, {_FORM_SQL} as p from (select cl.*, h_fit.*, {_TERMS} from cl join h_fit on fit < 5 and fold = fit or fit >= 5 and fold <> (fit - 5) // 4 and inn = (fit - 5) % 4)),
i as (select (fit - 5) // 4 as outer_fold, kind, sqrt(sum(k * (p - y) ** 2) / sum(k)) as rmse, sum(k * abs(p - y)) / sum(k) as mae from pr where fit >= 5 group by 1, 2),
c as (select * from (select *, row_number() over (partition by outer_fold order by rmse, mae, kind) as rn from i) where rn = 1)
select outer_fold::int as outer, c.kind as selected, round(any_value(pr.kappa), 5) as kappa, round(any_value(c.rmse), 6) as inner_rmse, round(sqrt(sum(k * (p - y) ** 2) / sum(k)), 6) as rmse, round(sum(k * abs(p - y)) / sum(k), 6) as mae, sum(k)::bigint as rows
from c join pr on pr.fit = outer_fold and pr.kind = c.kind group by 1, 2""")
def f10(t):
    """Form chosen by inner folds, fitted on the outer training part, scored on the outer fold; law and parameter are fitted in every part."""
    inner = (hex_number(F.sha2(F.concat_ws("|", F.lit("inner"), F.col("n").cast("int").cast("string"), F.col("d").cast("int").cast("string")), 256)) % 4).cast("int")
    cells = f.design_cells(trials(t.lineitem).withColumn("outer", _group_fold()).withColumn("inner", inner), ["outer", "inner"]).withColumn("k", F.col("k").cast("double"))
    fives, fours = F.sequence(F.lit(0), F.lit(4)), F.sequence(F.lit(0), F.lit(3))
    nested = F.flatten(F.transform(fives, lambda o: F.transform(fours, lambda i: ((o != F.col("outer")) & (i != F.col("inner"))).cast("double"))))
    cells = materialise(cells.withColumn("share", F.concat(F.transform(fives, lambda o: (o != F.col("outer")).cast("double")), nested)))
    fits = lf.fit_quality(cells, lf.fit_laws(_full_quality(cells), 25), laws.KINDS)
    of = F.floor((F.col("fit") - 5) / 4).cast("int")
    inside = (F.col("fit") >= 5) & (F.col("outer") != of) & (F.col("inner") == (F.col("fit") - 5) % 4)
    k, e = F.col("k"), F.col("p") - F.col("y")
    score = [F.sqrt(F.sum(k * e * e) / F.sum("k")).alias("rmse"), (F.sum(k * F.abs(e)) / F.sum("k")).alias("mae"), F.sum("k").cast("long").alias("rows")]
    held = lf.predicted(cells, fits, ((F.col("fit") < 5) & (F.col("outer") == F.col("fit"))) | inside)
    table = materialise(held.groupBy("fit", "kind").agg(*score, F.sum(k * e * e).alias("sse"), F.sum(k * F.abs(e)).alias("sae"), F.sum("k").alias("w"), F.first("kappa").alias("kappa")))
    inner_scores = table.where("fit >= 5").groupBy(of.alias("outer"), "kind").agg(F.sqrt(F.sum("sse") / F.sum("w")).alias("inner_rmse"), (F.sum("sae") / F.sum("w")).alias("inner_mae"))
    chosen = inner_scores.groupBy("outer").agg(F.min(F.struct("inner_rmse", "inner_mae", "kind")).alias("c")).select("outer", F.col("c.kind").alias("selected"), F.col("c.inner_rmse").alias("inner_rmse"))
    out = chosen.join(table.where("fit < 5"), (F.col("outer") == F.col("fit")) & (F.col("selected") == F.col("kind")))
    return out.select("outer", "selected", F.round("kappa", 5).alias("kappa"), F.round("inner_rmse", 6).alias("inner_rmse"), F.round("rmse", 6).alias("rmse"), F.round("mae", 6).alias("mae"), "rows")


_RM = _nn_sql("rm", "rx", "ry", "rxx", "rxy")


@query("f11_leave_source_out", f"""with t as (select *, {_SHAPE} as x from ({TRIALS_SQL})), s as (select run, {_LS} from t group by 1), w as (select sum(m) m, sum(sx) sx, sum(sy) sy, sum(sxx) sxx, sum(sxy) sxy from s),
r as (select run, w.m - s.m as rm, w.sx - s.sx as rx, w.sy - s.sy as ry, w.sxx - s.sxx as rxx, w.sxy - s.sxy as rxy from s, w), c as (select run, {_RM[0]} as a, {_RM[1]} as b, ry / rm as mean from r)
select run, count(*) as rows, round(any_value(a), 5) as calibration_e, round(any_value(b), 5) as calibration_scale, round(sqrt(avg((y - a - b * x) ** 2)), 6) as rmse_affine, round(sqrt(avg((y - mean) ** 2)), 6) as rmse_train_mean,
  round(sqrt(avg((y - {LAW['E']} - x) ** 2)), 6) as rmse_uncalibrated from t join c using (run) group by 1""")
def f11(t):
    out = f.leave_source_out(f.line_sums(_shaped(t), ["run"], F.col("x"), F.col("y")), "run", LAW["E"])
    return out.select("run", "rows", F.round("calibration_e", 5).alias("calibration_e"), F.round("calibration_scale", 5).alias("calibration_scale"), *[F.round(c, 6).alias(c) for c in out.columns if c.startswith("rmse")])


@query("f12_residual_strata", f"with {_PRED}, s as (select 'n' as variable, n as value, y, pred from p union all select 'q', q, y, pred from p union all select 'tax', l_tax, y, pred from p) select variable, round(value, 6) as value, {_M} from s group by 1, 2")
def f12(t):
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("variable"), F.round(c, 6).alias("value")) for n, c in (("n", "n"), ("q", "q"), ("tax", "l_tax"))]))
    rows = _predicted(t).select("y", "pred", cells.alias("s")).select("y", "pred", "s.*")
    return _round_metrics(rows.groupBy("variable", "value").agg(*v.error_metrics(F.col("y"), F.col("pred"))))


REPS = 300
_PARAMETERS = (*lf.NAMES, "kappa")


def _draws(*parts):
    """Weight of a group in the data as they are (fit 0) and in every replicate."""
    own = [F.col(p).cast("int").cast("string") if p in ("n", "d") else F.lit(p) for p in parts]
    drawn = F.transform(F.sequence(F.lit(1), F.lit(REPS)), lambda r: poisson_weight(F.substring(F.sha2(F.concat_ws("|", *own, r.cast("string")), 256), 1, 8)).cast("double"))
    return F.concat(F.array(F.lit(1.0)), drawn)


def replicates(t):
    """Fitted laws: fit 0 on the data, fits 1 to REPS on resampled sizes; quality parameter on top, over resampled (size, tokens) groups.

    The law comes from trials of full quality, the quality parameter from all of them; sizes and groups are drawn independently.
    """
    rows = materialise(trials(t.lineitem).select("n", "d", "q", "y"))
    law = written(lf.fit_laws(lf.law_points(rows.where("q >= 0.999")).withColumn("share", _draws("n")), REPS + 1), "laws")
    short = F.greatest(F.lit(0.0), 1 - F.col("q"))
    points = materialise_evenly(rows.groupBy("n", "d").agg(F.sum(short).alias("c1"), F.sum(short * short).alias("c2"), F.sum(short * F.col("y")).alias("cy"))).withColumn("share", _draws("quality", "n", "d"))
    return written(law.join(lf.kappas(points, law), "fit", "left"), "replicates")


def _draw_sql(source, key, keep):
    w = " + ".join(f"(h >= {p!r})::int" for p in POISSON_ONE)
    return f"select {keep}, r as fit, case when r = 0 then 1.0 else {w} end as x from (select {keep}, r, ('0x' || substr(sha256({key} || '|' || r), 1, 8))::bigint / 4294967296.0 as h from (select distinct {keep} from {source}), range({REPS + 1}) z(r))"


REPLICATES_SQL = f"""t as materialized ({TRIALS_SQL}), bp as materialized (select n, d, count(*)::double as w, sum(y) as wy from t where q >= 0.999 group by 1, 2),
bd as materialized ({_draw_sql('bp', 'n::int', 'n')}), pts as materialized (select fit, n, d, x * w as w, x * wy as wy from bp join bd using (n) where x > 0), {law_fit_sql('g', 'pts')},
qp as materialized (select n, d, sum(greatest(0, 1 - q)) as c1, sum(greatest(0, 1 - q) ** 2) as c2, sum(greatest(0, 1 - q) * y) as cy from t group by 1, 2), qd as materialized ({_draw_sql('qp', "'quality|' || n::int || '|' || d::int", 'n, d')}),
kp as (select fit, sum(x * r * (cy - ("E" + r) * c1)) / sum(x * r * r * c2) as kappa from (select qp.*, x, g_fit.*, "A" * n ** -alpha + "B" * d ** -beta as r from qp join qd using (n, d) join g_fit using (fit) where x > 0) group by 1),
reps as materialized (select * from g_fit join kp using (fit))"""


@query("f13_parameter_bootstrap", f"""with recursive {REPLICATES_SQL}, z as (select fit, {', '.join(f'"{n}"' for n in _PARAMETERS)} from reps where fit > 0), c as ({' union all '.join(f"""select '{n}' as parameter, "{n}" as v, "E" as e from z""" for n in _PARAMETERS)}),
p as ({' union all '.join(f"""select '{n}' as parameter, "{n}" as estimate from reps where fit = 0""" for n in _PARAMETERS)})
select parameter, round(any_value(estimate), 5) as estimate, count(*) as replicates, 0::bigint as failures, round(quantile_cont(v, 0.025), 5) as ci_low, round(quantile_cont(v, 0.5), 5) as median, round(quantile_cont(v, 0.975), 5) as ci_high, round(corr(v, e), 5) as corr_with_e
from c join p using (parameter) group by 1""")
def f13(t):
    """Interval of every parameter over the replicates that converged, and its link with the irreducible loss."""
    reps = replicates(t)
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("parameter"), F.col(n).alias("v")) for n in _PARAMETERS]))
    rows = reps.select("fit", "success", "E", cells.alias("c")).select("fit", "success", "E", "c.*")
    drawn, good = F.col("fit") > 0, F.col("success") & (F.col("fit") > 0)
    p = lambda share, name: F.round(F.expr(f"percentile(v, {share}) filter (where success and fit > 0)"), 5).alias(name)
    return rows.groupBy("parameter").agg(
        F.round(F.max(F.when(~drawn, F.col("v"))), 5).alias("estimate"), F.count_if(good).alias("replicates"), F.count_if(drawn & ~F.col("success")).alias("failures"), p(0.025, "ci_low"), p(0.5, "median"),
        p(0.975, "ci_high"), F.round(F.corr(F.when(good, F.col("v")), F.when(good, F.col("E"))), 5).alias("corr_with_e"))


_RQ = f"(1 + kappa * greatest(0.0, 1 - q))"
_STEP_SQL = "(1 + kappa * (1 - least(1.0, q + 0.1))) / (1 + kappa * (1 - q))"


@query("f14_marginal_intervals", f"""with recursive {REPLICATES_SQL}, box as (select min(n) n0, max(n) n1, min(d) d0, max(d) d1 from t), pt as (select run, q, avg(n) as n, avg(d) as d from t group by 1, 2),
dr as (select pt.*, fit, "E" + ("A" * n ** -alpha + "B" * d ** -beta) * {_RQ} as loss, -alpha * "A" * n ** -alpha / n * (1 + kappa * (1 - q)) as dn, -beta * "B" * d ** -beta / d * (1 + kappa * (1 - q)) as dd,
  -kappa * ("A" * n ** -alpha + "B" * d ** -beta) as dq, (("A" * n ** -alpha + "B" * d ** -beta) * {_STEP_SQL} - "B" * d ** -beta) / "A" as rhs, alpha from pt, reps),
ci as (select run, q, quantile_cont(loss, 0.025) as lo, quantile_cont(loss, 0.975) as hi from dr where fit > 0 group by 1, 2)
select run, q, round(n, 5) as n, round(d, 5) as d, round(loss, 6) as loss, round(dn, 6) as dn, round(dd, 6) as dd, round(dq, 6) as dq, case when rhs < 0 then 'unattainable' when rhs = 0 then 'infinite_limit' when -ln(rhs) / alpha > 709.782712893384 then 'overflow' else 'finite' end as status,
  round(case when rhs > 0 then exp(-ln(rhs) / alpha) end, 3) as equivalent_n, round(lo, 6) as ci_low, round(hi, 6) as ci_high, n between n0 and n1 and d between d0 and d1 as in_box, case when rhs > 0 then exp(-ln(rhs) / alpha) between n0 and n1 end as equivalent_in_box
from dr join ci using (run, q), box where fit = 0""")
def f14(t):
    """Loss, partials and replicate intervals at the mean size and tokens of each run and quality level, with support flags."""
    n, d, q = ndq()
    rows = trials(t.lineitem)
    box = rows.agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("d").alias("d0"), F.max("d").alias("d1"))
    points = with_row(rows.groupBy("run", "q").agg(F.avg("n").alias("n"), F.avg("d").alias("d")), box)
    # the replicate table has one row per replicate, so it travels as one bounded array
    laws_held = replicates(t).where("success")
    held = F.struct(*_PARAMETERS)
    packed = laws_held.agg(F.first(F.when(F.col("fit") == 0, held), ignorenulls=True).alias("own"), F.collect_list(F.when(F.col("fit") > 0, held)).alias("reps"))
    rows = with_row(points, packed)
    own = {k: F.col("own." + k) for k in _PARAMETERS}
    drawn = F.transform("reps", lambda r: laws.quality_loss("reducible_linear", {k: r[k] for k in lf.NAMES}, n, d, q, r["kappa"]))
    part = laws.partials(own, n, d, q, own["kappa"])
    status, size = laws.equivalent_size(own, n, d, q, F.least(F.lit(1.0), q + 0.1), own["kappa"])
    at = lambda share: quantile_of(F.array_sort("drawn"), share)
    rows = rows.withColumn("drawn", drawn).withColumn("size", size)
    return rows.select(
        "run", "q", F.round(n, 5).alias("n"), F.round(d, 5).alias("d"), F.round(laws.quality_loss("reducible_linear", own, n, d, q, own["kappa"]), 6).alias("loss"), *[F.round(c, 6).alias(k) for k, c in part.items()], status.alias("status"),
        F.round("size", 3).alias("equivalent_n"), F.round(at(0.025), 6).alias("ci_low"), F.round(at(0.975), 6).alias("ci_high"), (n.between(F.col("n0"), F.col("n1")) & d.between(F.col("d0"), F.col("d1"))).alias("in_box"),
        F.col("size").between(F.col("n0"), F.col("n1")).alias("equivalent_in_box"))


_AB = LAW["alpha"] + LAW["beta"]


@query("f15_compute_optimal", f"""with t as ({TRIALS_SQL}), x as (select min(n) n0, max(n) n1, min(d) d0, max(d) d1 from t), o as (select run, n * d as nd, n0, n1, d0, d1, ({LAW['alpha'] * LAW['A']} / {LAW['beta'] * LAW['B']} * (n * d) ** {LAW['beta']}) ** {1 / _AB} as ns from t, x),
c as (select *, nd / ns as ds, greatest(greatest(n0, nd / d1), least(least(n1, nd / d0), ns)) as nc from o)
select run, count(*) as budgets, round(avg(ns), 6) as n_opt, round(avg(ds), 6) as d_opt, round(avg({LAW['E']} + {LAW['A']} * ns ** -{LAW['alpha']} + {LAW['B']} * ds ** -{LAW['beta']}), 6) as loss_opt, round(avg(nc), 6) as n_box,
  round(avg({LAW['E']} + {LAW['A']} * nc ** -{LAW['alpha']} + {LAW['B']} * (nd / nc) ** -{LAW['beta']}), 6) as loss_box, round({LAW['beta'] / _AB}, 6)::double as n_exponent, count(*) filter (ns between n0 and n1 and ds between d0 and d1) as inside from c group by 1""")
def f15(t):
    rows = trials(t.lineitem)
    box = rows.agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("d").alias("d0"), F.max("d").alias("d1"))
    nd = F.col("n") * F.col("d")
    ns = F.pow(LAW["alpha"] * LAW["A"] / (LAW["beta"] * LAW["B"]) * F.pow(nd, F.lit(LAW["beta"])), F.lit(1 / _AB))
    o = with_row(rows, box).withColumn("nd", nd).withColumn("ns", ns).withColumn("ds", F.col("nd") / F.col("ns"))
    o = o.withColumn("nc", F.greatest(F.greatest(F.col("n0"), F.col("nd") / F.col("d1")), F.least(F.least(F.col("n1"), F.col("nd") / F.col("d0")), F.col("ns"))))
    inside = F.col("ns").between(F.col("n0"), F.col("n1")) & F.col("ds").between(F.col("d0"), F.col("d1"))
    return o.groupBy("run").agg(
        F.count(F.lit(1)).alias("budgets"), F.round(F.avg("ns"), 6).alias("n_opt"), F.round(F.avg("ds"), 6).alias("d_opt"), F.round(F.avg(laws.loss(LAW, F.col("ns"), F.col("ds"))), 6).alias("loss_opt"), F.round(F.avg("nc"), 6).alias("n_box"),
        F.round(F.avg(laws.loss(LAW, F.col("nc"), F.col("nd") / F.col("nc"))), 6).alias("loss_box"), F.lit(round(LAW["beta"] / _AB, 6)).alias("n_exponent"), F.count_if(inside).alias("inside"))
