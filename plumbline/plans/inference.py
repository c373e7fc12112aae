"""Registered queries for grouped inference and resampling (I, B)."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from plumbline.functions.keys import draws_sql
from plumbline.operators import inference as i
from plumbline.operators import resampling as b
from plumbline.operators.cohorts import family_weights
from plumbline.operators.metrics import pinball
from plumbline.operators.rank_bootstrap import ranked, spearman_replicates
from plumbline.operators.ranking import exact_quantiles
from plumbline.plans.quality import rank_sql
from plumbline.plans.registry import query
from plumbline.runtime import materialise, spread, with_row


def _features(t, date="ts"):
    """ln value of events with size, time and browse features and inverse-frequency user weights."""
    rows = t.events.select("event_id", "event_type", "user_id", "ts", F.ln("value").alias("y"), F.ln(1 + F.get_json_object("props", "$.k").try_cast("double")).alias("size"),
                           (F.datediff(date, F.to_date(F.lit("2024-01-01"))) / 365.25).alias("time"))
    rows = with_row(rows, rows.agg(F.avg("size").alias("centre"))).withColumn("size", F.col("size") - F.col("centre"))
    rows = rows.withColumn("size2", F.col("size") ** 2).withColumn("size_time", F.col("size") * F.col("time"))
    return rows.join(family_weights(t.events, "user_id").select("user_id", "weight"), "user_id")


@query("i1_quantile_regression")
def i1(t):
    return i.quantile_fits(_features(t), "event_type", ["size", "size2", "time", "size_time"], "y", "weight", 0.9)


CUTOFFS = ["2024-01-08", "2024-01-15", "2024-01-22", "2024-01-29"]
_ROLL = f"""k as (select c::date as cutoff from (values {', '.join(f"('{c}')" for c in CUTOFFS)}) a(c)),
tr as (select e.*, cutoff from events e join k on ts::date < cutoff), te as (select e.*, cutoff from events e join k on ts::date >= cutoff and ts::date <= cutoff + 7),
q as (select cutoff, event_type, 'const_type' as model, quantile_cont(value, 0.9) as pred, count(*) as n from tr group by 1, 2
  union all select a.cutoff, a.event_type, 'const_all', g.pred, a.n from (select cutoff, event_type, count(*) as n from tr group by 1, 2) a join (select cutoff, quantile_cont(value, 0.9) as pred from tr group by 1) g on a.cutoff = g.cutoff
  union all select cutoff, event_type, 'recent', quantile_cont(value, 0.9) filter (ts::date >= cutoff - 7), count(*) from tr group by 1, 2),
fw as (select cutoff, event_type, user_id, 1.0 / count(*) as w from te group by 1, 2, 3),
s as (select te.cutoff, te.event_type, q.model, q.n as n_train, value, pred, w, greatest(0.9 * (value - pred), -0.1 * (value - pred)) as l from te join q on te.cutoff = q.cutoff and te.event_type = q.event_type
  join fw on te.cutoff = fw.cutoff and te.event_type = fw.event_type and te.user_id = fw.user_id),
bt as (select cutoff, event_type, model, n_train, count(*) as n_test, avg(l) as pinball, sum(w * l) / sum(w) as pinball_weighted, avg((value <= pred)::int) as coverage from s group by 1, 2, 3, 4 having n_train >= 30 and count(*) >= 8)"""


def _rolling(t):
    rows = t.events.select("ts", "event_type", "user_id", "value")
    train, test = i.rolling_windows(rows, "ts", CUTOFFS, 7)
    recent = train.where(F.to_date("ts") >= F.date_sub("cutoff", 7))
    sizes = train.groupBy("cutoff", "event_type").agg(F.count(F.lit(1)).alias("n_train"))
    own = exact_quantiles(train, ["cutoff", "event_type"], "value", {"const_type": 0.9})
    late = exact_quantiles(recent, ["cutoff", "event_type"], "value", {"recent": 0.9})
    whole = exact_quantiles(train, ["cutoff"], "value", {"const_all": 0.9})
    models = sizes.join(own, ["cutoff", "event_type"]).join(late, ["cutoff", "event_type"], "left").join(whole, "cutoff")
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("pred")) for m in ("const_type", "recent", "const_all")]))
    models = materialise(models.select("cutoff", "event_type", "n_train", cells.alias("m")).select("cutoff", "event_type", "n_train", "m.*"))
    share = test.groupBy("cutoff", "event_type", "user_id").agg((1.0 / F.count(F.lit(1))).alias("fw"))
    scored = test.join(share, ["cutoff", "event_type", "user_id"]).join(models, ["cutoff", "event_type"])
    loss = pinball(F.col("value"), F.col("pred"), 0.9)
    out = scored.groupBy("cutoff", "event_type", "model", "n_train").agg(
        F.count(F.lit(1)).alias("n_test"), F.avg(loss).alias("pinball"), (F.sum(F.col("fw") * loss) / F.sum("fw")).alias("pinball_weighted"),
        F.avg((F.col("value") <= F.col("pred")).cast("double")).alias("coverage"))
    return out.where("n_train >= 30 and n_test >= 8")


@query("i2_rolling_origin", f"with {_ROLL} select strftime(cutoff, '%Y-%m-%d') as cutoff, event_type, model, n_train, n_test, round(pinball, 6) as pinball, round(pinball_weighted, 6) as pinball_weighted, round(coverage, 6) as coverage from bt")
def i2(t):
    return _rolling(t).select(F.date_format("cutoff", "yyyy-MM-dd").alias("cutoff"), "event_type", "model", "n_train", "n_test", *[F.round(c, 6).alias(c) for c in ("pinball", "pinball_weighted", "coverage")])


@query("i3_time_gate", f"""with {_ROLL}, m as (select event_type, model, avg(pinball_weighted) as l from bt group by 1, 2), g as (select event_type, arg_min(model, l) filter (model <> 'recent') as best_scale, min(l) filter (model <> 'recent') as a,
  min(l) filter (model = 'recent') as b from m group by 1) select event_type, best_scale, round(a, 6) as scale_loss, round(b, 6) as time_loss, round((a - b) / a, 6) as improvement, (a - b) / a >= 0.05 as time_passes,
  case when (a - b) / a >= 0.05 then 'recent' else best_scale end as selected from g""")
def i3(t):
    m = _rolling(t).groupBy("event_type", "model").agg(F.avg("pinball_weighted").alias("l"))
    scale, time = F.col("model") != "recent", F.col("model") == "recent"
    g = m.groupBy("event_type").agg(F.min_by(F.when(scale, F.col("model")), F.when(scale, F.col("l"))).alias("best_scale"), F.min(F.when(scale, F.col("l"))).alias("a"), F.min(F.when(time, F.col("l"))).alias("b"))
    gain = (F.col("a") - F.col("b")) / F.col("a")
    return g.select("event_type", "best_scale", F.round("a", 6).alias("scale_loss"), F.round("b", 6).alias("time_loss"), F.round(gain, 6).alias("improvement"), (gain >= 0.05).alias("time_passes"),
                    F.when(gain >= 0.05, "recent").otherwise(F.col("best_scale")).alias("selected"))


@query("i4_nested_selection")
def i4(t):
    """Per outer cutoff: seven-day inner cutoffs from day 8 to three days before it; the quadratic model must win by 2 %."""
    rows = _features(t).select("event_id", "user_id", "ts", "y", "size", "size2")
    outer, _ = i.rolling_windows(rows, "ts", CUTOFFS[1:], 7)
    start, week, day = F.to_date(F.lit("2024-01-08")), F.expr("interval 7 days"), F.to_date("ts")

    def inner(frame, cutoff):
        return frame.withColumn("inner", F.explode(F.sequence(start, F.date_sub(cutoff, 3), week)))

    def weighed(part, *window):
        """Inverse-frequency user weights, counted inside the window only."""
        own = part.groupBy(*window, "user_id").agg((1.0 / F.count(F.lit(1))).alias("weight"))
        return materialise(part.join(own, [*window, "user_id"]))

    # What lies before an inner cutoff lies before every outer one that has it: one fit serves them all.
    train = weighed(inner(rows, F.lit(max(CUTOFFS)).cast("date")).where(day < F.col("inner")), "inner")
    test = weighed(inner(outer, F.col("cutoff")).where(day.between(F.col("inner"), F.date_add("inner", 6))), "cutoff", "inner")
    out = None
    for model, xs in (("linear", ["size"]), ("quadratic", ["size", "size2"])):
        terms = i.quantile_fits(train, "inner", xs, "y", "weight", 0.9)
        settled = terms.groupBy("inner").agg(F.bool_and("converged").alias("settled"))
        pred = i.predict_from_terms(test, terms, "inner", xs, "pred").join(settled, "inner")
        part = pred.groupBy("cutoff", "inner").agg((F.sum(F.col("weight") * pinball(F.col("y"), F.col("pred"), 0.9)) / F.sum("weight")).alias(model), F.count(F.lit(1)).alias("n_" + model), F.bool_and("settled").alias("settled_" + model))
        out = part if out is None else out.join(part, ["cutoff", "inner"])
    folds = out.where("n_linear >= 8").groupBy("cutoff").agg(F.count(F.lit(1)).alias("inner_folds"), F.avg("linear").alias("linear_loss"), F.avg("quadratic").alias("quadratic_loss"), F.bool_and(F.col("settled_linear") & F.col("settled_quadratic")).alias("converged"))
    return folds.withColumn("selected", F.when(F.col("quadratic_loss") <= 0.98 * F.col("linear_loss"), "quadratic").otherwise("linear"))


@query("i5_cluster_ols")
def i5(t):
    return i.cluster_ols(_features(t), "event_type", ["size", "time"], "y", "user_id")


def _tail_sql(z):
    a, t = f"abs({z})", f"(1 / (1 + {i.TAIL[0]} * abs({z})))"
    poly = f"{t} * ({i.TAIL[1]} + {t} * ({i.TAIL[2]} + {t} * ({i.TAIL[3]} + {t} * ({i.TAIL[4]} + {t} * {i.TAIL[5]}))))"
    return f"least(1.0, 2 * 0.3989422804014327 * exp(-{a} * {a} / 2) * {poly})"


#: A value of zero or less has no logarithm; such events are left out, on both sides.
_TESTS = f"""lv as (select event_type, user_id, ln(value) as v from (select * from events where value > 0)), g as (select event_type, avg(v) as m, stddev_samp(v) as s from lv group by 1), u as (select event_type, user_id, avg(v) as a, count(*) as n from lv group by 1, 2),
z as (select u.event_type, user_id, a - m as effect, (a - m) / (s / sqrt(n)) as z from u join g on u.event_type = g.event_type), tp as (select event_type, user_id, effect, {_tail_sql('z')} as p from z),
o as (select *, row_number() over (partition by event_type order by p, user_id) as rk, count(*) over (partition by event_type) as m from tp),
bh as (select event_type, user_id, effect, p, least(1.0, min(p * m / rk) over (partition by event_type order by rk desc rows unbounded preceding)) as q from o)"""


def _tested(t):
    logs = t.events.where("value > 0").select("event_type", "user_id", F.ln("value").alias("v"))
    g = logs.groupBy("event_type").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    u = logs.groupBy("event_type", "user_id").agg(F.avg("v").alias("a"), F.count(F.lit(1)).alias("n")).join(g, "event_type")
    effect = F.col("a") - F.col("m")
    rows = u.select("event_type", "user_id", effect.alias("effect"), i.normal_two_sided(effect / (F.col("s") / F.sqrt("n"))).alias("p"))
    return i.benjamini_hochberg(rows, ["event_type"], "user_id", "p")


@query("i6_bh_qvalues", f"with {_TESTS} select event_type, user_id, round(p, 6) as p, round(q, 6) as q_value from bh")
def i6(t):
    return _tested(t).select("event_type", "user_id", F.round("p", 6).alias("p"), F.round("q_value", 6).alias("q_value"))


@query("i7_effect_families", f"""with {_TESTS} select event_type, count(*) as tasks, round(avg((effect > 0)::int), 6) as positive_share, round(avg((effect > 0 and q < 0.05)::int), 6) as significant_share,
  round(quantile_cont(effect, 0.5), 6) as median_effect from bh group by 1""")
def i7(t):
    out = i.effect_families(materialise(_tested(t)), ["event_type"], "effect", "q_value")
    return out.select("event_type", "tasks", *[F.round(c, 6).alias(c) for c in ("positive_share", "significant_share", "median_effect")])


@query("i8_theil_sen", """with p as (select o_orderstatus, year(o_orderdate)::double as x, ln(sum(o_totalprice)) as y from orders group by 1, 2),
s as (select a.o_orderstatus, (b.y - a.y) / (b.x - a.x) as s from p a join p b on a.o_orderstatus = b.o_orderstatus and a.x < b.x), n as (select o_orderstatus, count(*)::int as points from p group by 1)
select s.o_orderstatus, points, round(quantile_cont(s, 0.5), 6) as slope from s join n on s.o_orderstatus = n.o_orderstatus group by 1, 2""")
def i8(t):
    points = t.orders.groupBy("o_orderstatus", F.year("o_orderdate").alias("x")).agg(F.ln(F.sum("o_totalprice")).alias("y"))
    return i.theil_sen(points, ["o_orderstatus"], "x", "y").withColumn("slope", F.round("slope", 6))


@query("i9_leave_one_out", f"""with p as (select l_quantity as x, avg(l_extendedprice) as y from lineitem group by 1), a as (select count(*) as n, avg(x) mx, avg(y) my, var_pop(x) * count(*) as sxx, regr_slope(y, x) as b from p),
r as (select y, (n * my - y) / (n - 1) as c, y - (y - my - b * (x - mx)) / (1 - (1.0 / n + (x - mx) * (x - mx) / sxx)) as l from p, a), k as (select *, {rank_sql('y')} as ra, {rank_sql('l')} as rb from r),
m as (select sqrt(avg((y - c) ** 2)) as cr, sqrt(avg((y - l) ** 2)) as lr, count(*) as n, corr(ra, rb) as rho from k)
select n, round(cr, 4) as constant_rmse, round(lr, 4) as linear_rmse, round(rho, 6) as spearman, round((cr - lr) / cr, 6) as improvement, (cr - lr) / cr >= 0.05 and rho > 0 as accepted from m""")
def i9(t):
    points = t.lineitem.groupBy(F.col("l_quantity").alias("x")).agg(F.avg("l_extendedprice").alias("y"))
    d = i.bridge_decision(i.leave_one_out(materialise(points), "x", "y"), "y")
    return d.select("n", F.round("constant_rmse", 4).alias("constant_rmse"), F.round("linear_rmse", 4).alias("linear_rmse"), F.round("spearman", 6).alias("spearman"), F.round("improvement", 6).alias("improvement"), "accepted")


@query("i10_isotonic")
def i10(t):
    """Decreasing fit of the mean discount on quantity, weighted by rows; rows collapse to one point per quantity."""
    points = t.lineitem.groupBy("l_quantity").agg(F.avg("l_discount").alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
    packed = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(materialise(points))
    model = IsotonicRegression(isotonic=False, weightCol="weight").fit(packed)
    return model.transform(packed).select("l_quantity", "label", "prediction")


@query("i11_time_axis_swap")
def i11(t):
    """Time coefficient of the quantile fit under the event date and under the first date of the user."""
    first = t.events.groupBy("user_id").agg(F.min("ts").alias("first_ts"))
    out = None
    for axis in ("event", "first_seen"):
        rows = _features(t) if axis == "event" else (_features(t).drop("time").join(first, "user_id")
                                                     .withColumn("time", F.datediff("first_ts", F.to_date(F.lit("2024-01-01"))) / 365.25))
        fit = i.quantile_fits(rows.withColumn("axis", F.lit(axis)), "axis", ["size", "size2", "time"], "y", "weight", 0.9).where("term = 'time'")
        out = fit if out is None else out.unionByName(fit)
    return out


@query("i12_rater_agreement", """with c as (select quality as a, 1 - toxic as b, count(*)::double as n from labels group by 1, 2), s as (select sum(n) as nn, sum(n) filter (a = b) as same, sum(n) filter (abs(a - b) <= 1) as near, sum(n * (a - b) ** 2) as g from c),
e as (select sum(x.na * y.nb) as pe, sum(x.na * y.nb * (x.a - y.b) ** 2) as ge from (select a, sum(n) as na from c group by 1) x, (select b, sum(n) as nb from c group by 1) y where x.a = y.b),
f as (select sum(x.na * y.nb * (x.a - y.b) ** 2) as ge from (select a, sum(n) as na from c group by 1) x, (select b, sum(n) as nb from c group by 1) y)
select nn::bigint as n, round((same / nn - pe / (nn * nn)) / (1 - pe / (nn * nn)), 6) as kappa, round(1 - g / nn / (f.ge / (nn * nn)), 6) as kappa_quadratic, round(same / nn, 6) as exact, round(near / nn, 6) as within_one from s, e, f""")
def i12(t):
    cells = t.labels.groupBy(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return i.agreement(cells).select("n", *[F.round(c, 6).alias(c) for c in ("kappa", "kappa_quadratic", "exact", "within_one")])


@query("i13_rating_contract", " union all ".join(f"""select '{c}' as field, count(*) as rows, count(*) filter ({c} is null) as missing, count(*) filter ({c} not between 0 and 1) as out_of_range,
  count(*) filter ({c} <> round({c})) as not_integer, count(*) - (select count(distinct doc_id) from labels) as duplicate_ids from labels""" for c in ("quality", "toxic")))
def i13(t):
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("v")) for c in ("quality", "toxic")]))
    per = t.labels.select("doc_id", fields.alias("f")).groupBy("f.field", "doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("f.v").isNull()).alias("m"), F.count_if(~F.col("f.v").between(0, 1)).alias("o"), F.count_if(F.col("f.v") != F.round("f.v")).alias("i"))
    return per.groupBy("field").agg(F.sum("n").alias("rows"), F.sum("m").alias("missing"), F.sum("o").alias("out_of_range"), F.sum("i").alias("not_integer"), F.sum(F.col("n") - 1).alias("duplicate_ids"))


_AUC = f"j as (select lang, n_chars::double as s, quality from documents join (select doc_id, max(quality) as quality from labels group by 1) using (doc_id))"


@query("i14_auc_and_pairs", f"""with {_AUC}, r as (select *, {rank_sql('s', 'lang')} as r from j), g as (select lang, count(*) filter (quality = 1) as positives, count(*) filter (quality <> 1) as negatives, sum(r) filter (quality = 1) as rs from r group by 1)
select lang, positives, negatives, positives * negatives as pairs, round(case when positives * negatives > 0 then (rs - positives * (positives + 1) / 2.0) / (positives * negatives) end, 6) as auc from g""")
def i14(t):
    one = t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = t.documents.select("doc_id", "lang", F.col("n_chars").cast("double").alias("s")).join(one, "doc_id")
    return i.ranked_auc(rows, ["lang"], "s", "quality").withColumn("auc", F.round("auc", 6))


@query("b1_mean_intervals", f"""with w as ({draws_sql('documents', 'doc_id', 200, 'doc_id, lang, n_chars')}), r as (select lang, rep, sum(w * n_chars) / sum(w) as m, sum(w * greatest(n_chars, 1) * n_chars) / sum(w * greatest(n_chars, 1)) as wm from w where w > 0 group by 1, 2)
select lang, round(quantile_cont(m, 0.025), 4) as mean_low, round(quantile_cont(m, 0.975), 4) as mean_high, round(quantile_cont(wm, 0.025), 4) as weighted_mean_low, round(quantile_cont(wm, 0.975), 4) as weighted_mean_high from r group by 1""")
def b1(t):
    rows = spread(t.documents.select("doc_id", "lang", "n_chars")).select("*", F.greatest("n_chars", F.lit(1)).alias("k"))
    out = b.mean_intervals(rows, "doc_id", ["lang"], "n_chars", "k", 200)
    return out.select("lang", *[F.round(c, 4).alias(c) for c in out.columns if c != "lang"])


@query("b2_metric_intervals", f"""with m as (select event_type, avg(value) as p from events group by 1), e as (select event_id, value, p, value - p as e from events join m using (event_type)),
w as materialized (select * from ({draws_sql('e', 'event_id', 1000)}) where w > 0),
r as (select rep, sqrt(sum(w * e * e) / sum(w)) as rmse, sum(w * abs(e)) / sum(w) as mae from w group by 1),
x as (select rep, p, sum(n) over (partition by rep order by p) - (n - 1) / 2 as rx from (select rep, p, sum(w)::double as n from w group by 1, 2)),
y as (select rep, value, sum(n) over (partition by rep order by value) - (n - 1) / 2 as ry from (select rep, value, sum(w)::double as n from w group by 1, 2)),
s as (select rep, sum(w)::double as n, sum(w * rx * rx) as xx, sum(w * ry * ry) as yy, sum(w * rx * ry) as xy from w join x using (rep, p) join y using (rep, value) group by 1),
k as (select rep, (xy - n * (n + 1) ** 2 / 4) / sqrt((xx - n * (n + 1) ** 2 / 4) * (yy - n * (n + 1) ** 2 / 4)) as rho from s)
select round(quantile_cont(rmse, 0.025), 6) as rmse_low, round(quantile_cont(rmse, 0.975), 6) as rmse_high, round(quantile_cont(mae, 0.025), 6) as mae_low, round(quantile_cont(mae, 0.975), 6) as mae_high,
  round(quantile_cont(rho, 0.025), 6) as rho_low, round(quantile_cont(rho, 0.975), 6) as rho_high from r join k using (rep)""")
def b2(t):
    m = t.events.groupBy("event_type").agg(F.avg("value").alias("p"))
    rows = spread(t.events.select("event_id", "event_type", "value")).join(m, "event_type").select("event_id", "value", "p", (F.col("value") - F.col("p")).alias("e"))
    rows, names = materialise(rows), ("n", "ee", "ae")
    sums = {"ee": F.col("e") * F.col("e"), "ae": F.abs("e")}
    table = spearman_replicates(rows, "event_id", "p", "value", 1000, sums)
    # Rows without a rank count in the means alone.
    rest = b.replicate_table(rows.where(~ranked("p", "value")), "event_id", [], 1000, {"n": F.sum("w"), **{c: F.sum(F.col("w") * v) for c, v in sums.items()}})
    table = table.join(rest.select("rep", *[F.col(c).alias("_" + c) for c in names]), "rep", "left")
    n, ee, ae = (F.col(c) + F.coalesce("_" + c, F.lit(0.0)) for c in names)
    out = b.percentiles(table.select("rho", F.sqrt(ee / n).alias("rmse"), (ae / n).alias("mae")), [], ["rmse", "mae", "rho"])
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("b3_cluster_gain", f"""with g as (select avg(value) as a from events), m as (select event_type, avg(value) as p from events group by 1), c as (select user_id, sum(abs(value - a)) as ea, sum(abs(value - p)) as eb, count(*) as n from events join m using (event_type), g group by 1),
w as ({draws_sql('c', 'user_id', 5000)}), r as (select rep, (sum(w * ea) - sum(w * eb)) / sum(w * n) as gain from w where w > 0 group by 1)
select round(quantile_cont(gain, 0.05), 6) as gain_p05, round(quantile_cont(gain, 0.5), 6) as gain_p50, round(quantile_cont(gain, 0.95), 6) as gain_p95, round(avg((gain > 0)::int), 6) as probability_positive from r""")
def b3(t):
    m = t.events.groupBy("event_type").agg(F.avg("value").alias("p"))
    rows = with_row(t.events.join(m, "event_type"), t.events.agg(F.avg("value").alias("a")))
    gap = lambda c: F.sum(F.abs(F.col("value") - F.col(c)))
    w = F.col("w")
    table = b.group_bootstrap(rows, "user_id", [], {"ea": gap("a"), "eb": gap("p"), "n": F.count(F.lit(1))},
                              {"gain": (F.sum(w * F.col("ea")) - F.sum(w * F.col("eb"))) / F.sum(w * F.col("n"))}, 5000)
    q = [F.round(F.expr(f"percentile(gain, {p})"), 6).alias(n) for n, p in (("gain_p05", 0.05), ("gain_p50", 0.5), ("gain_p95", 0.95))]
    return table.agg(*q, F.round(F.avg((F.col("gain") > 0).cast("double")), 6).alias("probability_positive"))


@query("b4_kappa_interval", f"""with l as (select doc_id, quality as a, 1 - toxic as b from labels), w as ({draws_sql('l', 'doc_id', 2000)}), c as (select rep, a, b, sum(w)::double as n from w where w > 0 group by 1, 2, 3),
s as (select rep, sum(n) as nn, coalesce(sum(n) filter (a = b), 0) as same, sum(n * (a - b) ** 2) as g, sum(n * a) as sa, sum(n * b) as sb, sum(n * a * a) as saa, sum(n * b * b) as sbb from c group by 1),
p as (select x.rep, sum(na * nb) as pe from (select rep, a, sum(n) as na from c group by 1, 2) x join (select rep, b, sum(n) as nb from c group by 1, 2) y on x.rep = y.rep and x.a = y.b group by 1),
k as (select (same / nn - pe / (nn * nn)) / (1 - pe / (nn * nn)) as kappa, 1 - g / nn / (saa / nn + sbb / nn - 2 * sa * sb / (nn * nn)) as kq from s join p using (rep))
select round(quantile_cont(kq, 0.025), 6) as kappa_quadratic_low, round(quantile_cont(kq, 0.975), 6) as kappa_quadratic_high, round(quantile_cont(kappa, 0.025), 6) as kappa_low, round(quantile_cont(kappa, 0.975), 6) as kappa_high from k""")
def b4(t):
    rows = spread(t.labels.select("doc_id", "quality", "toxic")).select("doc_id", "quality", (1 - F.col("toxic")).alias("clean"))
    out = b.kappa_intervals(rows, "doc_id", "quality", "clean", 2000)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("b5_slope_product", f"""with d as (select o_orderkey, date_diff('day', date '1995-01-01', o_orderdate::date) / 365.25 as x, ln(o_totalprice) as y, ln(1 + o_custkey) as z from orders), w as ({draws_sql('d', 'o_orderkey', 200)}),
s as (select rep, sum(w)::double as n, sum(w*x) as x, sum(w*y) as y, sum(w*z) as z, sum(w*x*x) as xx, sum(w*y*y) as yy, sum(w*x*y) as xy, sum(w*y*z) as yz from w where w > 0 group by 1),
k as (select (n*xy - x*y) / (n*xx - x*x) as a, (n*yz - y*z) / (n*yy - y*y) as b from s)
select count(*) as replicates, round(quantile_cont(a, 0.05), 6) as slope_p05, round(quantile_cont(a, 0.95), 6) as slope_p95, round(quantile_cont(b, 0.5), 6) as elasticity_p50, round(quantile_cont(a * b, 0.05), 6) + 0.0 as product_p05, round(quantile_cont(a * b, 0.95), 6) + 0.0 as product_p95 from k""")
def b5(t):
    rows = spread(t.orders.select("o_orderkey", "o_orderdate", "o_totalprice", "o_custkey")).select("o_orderkey", (F.datediff("o_orderdate", F.to_date(F.lit("1995-01-01"))) / 365.25).alias("x"), F.ln("o_totalprice").alias("y"), F.ln(1 + F.col("o_custkey")).alias("z"))
    table = b.slope_product(rows, "o_orderkey", "x", "y", "z", 200)
    p = lambda c, q, n: (F.round(F.expr(f"percentile({c}, {q})"), 6) + 0.0).alias(n)
    return table.agg(F.count(F.lit(1)).alias("replicates"), p("slope", 0.05, "slope_p05"), p("slope", 0.95, "slope_p95"), p("elasticity", 0.5, "elasticity_p50"), p("product", 0.05, "product_p05"), p("product", 0.95, "product_p95"))
