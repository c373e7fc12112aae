"""Registered queries for document scoring (K)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions.keys import permuted_sql
from plumbline.functions.numeric import correlation
from plumbline.functions.text import FACETS, MORPHOLOGY, SEMANTIC, SIGNALS, text_signals
from plumbline.operators import scoring as k
from plumbline.operators.cohorts import top_per_group
from plumbline.operators.ranking import exact_quantiles, reference_ecdf, spearman
from plumbline.plans.registry import query
from plumbline.runtime import materialise, with_row


def _share(keep: str, over: str = "n") -> str:
    return f"length(regexp_replace(text, '[^{keep}]', '', 'g'))::double / {over}"


_SIG = f"""
words as (select *, string_split(text, ' ') as w, string_split(text, chr(10)) as l, greatest(length(text), 1)::double as n,
  length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::double as letters from documents),
sig as (select d.doc_id, lang, source, n_chars, sha256(text) as content_key, case when r.doc_id is null then 'extension' else 'reference' end as dataset,
  r.doc_id is not null as is_ref, len(w)::double as word_count, {_share('.!?', '1')} as sentence_count,
  len(list_distinct(w)) / len(w)::double as unique_share, (length(text) - (len(w) - 1)) / len(w)::double as mean_word_length,
  case when letters > 0 then {_share('aeiouAEIOU', 'letters')} end as vowel_share, {_share('.!?', 'len(w)')} as sentence_rate,
  {_share('A-Za-z')} as letter_share, {_share(',')} as comma_share, {_share('A-Z')} as upper_share, {_share('0-9')} as digit_share,
  {_share('#*=<>@/')} as symbol_share, {_share(',;:.!?')} as punct_share, 1 - len(list_distinct(l)) / len(l)::double as repeat_line_share,
  len(l) / len(w)::double as line_rate from words d left join (select distinct doc_id from labels) r on r.doc_id = d.doc_id)"""
_BAND = _SIG + """,
lx as (select *, ln(1 + greatest(word_count, 0)) as x from sig),
cut as (select lang, quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) as c from lx where is_ref group by lang),
gcut as (select quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) as g from lx where is_ref),
band as (select lx.* exclude (x), len(list_filter(coalesce(c, g), lambda v: v <= x))::int as length_band from lx left join cut using (lang), gcut)"""


def _clip(count: str, n: str) -> str:
    return f"greatest(1.0 / ({n} + 1), least({n}::double / ({n} + 1), ({count} + 0.5) / ({n} + 1)))"


def _whole(x: str) -> str:
    n = f"sum((is_ref and {x} is not null)::int) over ()"
    return f"case when {x} is not null then {_clip(f'sum((is_ref and {x} is not null)::int) over (order by {x})', n)} end"


def _near(x: str) -> str:
    levels = {}
    for name, part in (("g", "partition by lang, length_band"), ("l", "partition by lang"), ("a", "")):
        n = f"sum((is_ref and {x} is not null)::int) over ({part})"
        levels[name] = (n, _clip(f"sum((is_ref and {x} is not null)::int) over ({part} order by {x})", n))
    return (f"case when {x} is null then null when {levels['g'][0]} >= 50 then {levels['g'][1]} "
            f"when {levels['l'][0]} >= 1 then {levels['l'][1]} else {levels['a'][1]} end")


def _direct(u: str, way: str) -> str:
    out = {"positive": u, "reverse": f"1 - {u}", "typical": f"1 - 2 * abs({u} - 0.5)"}[way]
    return f"greatest(0.0, least(1.0, {out}))"


_RAW = _BAND + ", raw as (select *, " + ", ".join(
    f"{_whole(n) if n in SEMANTIC else _near(n)} as u_{n}" for n in SIGNALS) + " from band)"
_DIR = _RAW + ", dir as (select * exclude (" + ", ".join("u_" + n for n in SIGNALS) + "), " + ", ".join(
    f"case when u_{n} is not null then {_direct('u_' + n, way)} end as d_{n}" for n, way in SIGNALS.items()) + " from raw)"
_SCORE = _DIR + ", fill as (select lang, " + ", ".join(f"quantile_cont(d_{n}, 0.5) as m_{n}" for n in SIGNALS) + \
    " from dir where is_ref group by lang), score as (select dir.* exclude (" + ", ".join("d_" + n for n in SIGNALS) + "), " + \
    ", ".join(f"coalesce(d_{n}, m_{n}, 0.5) as s_{n}" for n in SIGNALS) + " from dir left join fill using (lang))"


def _facet_sql() -> str:
    stage1, stage2, stage3, stage4 = [], [], [], []
    for f, names in FACETS.items():
        v = "[" + ", ".join("s_" + n for n in names) + "]"
        stage1.append(f"list_avg({v}) as {f}_equal, list_median({v}) as md_{f}")
        stage2.append(f"1.4826 * list_median([" + ", ".join(f"abs(s_{n} - md_{f})" for n in names) + f"]) as mad_{f}")
        w = [f"least(1.0, 1.5 / greatest(abs(s_{n} - md_{f}) / (case when mad_{f} > 1e-8 then mad_{f} else 1.0 end), 1e-12))" for n in names]
        stage3.append("(" + " + ".join(f"{x} * s_{n}" for x, n in zip(w, names)) + ") / (" + " + ".join(w) + f") as {f}_robust")
    for kind in ("equal", "robust"):
        stage4.append("(" + " + ".join(f"{f}_{kind}" for f in FACETS) + f") / 4 as q_{kind}")
    sem, mor = [" + ".join("s_" + n for n in g) for g in (SEMANTIC, MORPHOLOGY)]
    return (f", f1 as (select *, {', '.join(stage1)} from score), f2 as (select *, {', '.join(stage2)} from f1), "
            f"f3 as (select *, {', '.join(stage3)} from f2), facet as (select *, {', '.join(stage4)}, ({sem}) / 6 as semantic_score, "
            f"({mor}) / 6 as morphology_score, ({sem}) / 6 - ({mor}) / 6 as family_gap from f3)")


_FACET = _SCORE + _facet_sql()
_CONFLICT = _FACET + """,
gm as (select lang, length_band, quantile_cont(family_gap, 0.5) as m from facet where is_ref group by 1, 2),
gs as (select f.lang, f.length_band, any_value(m) as m, greatest(1.4826 * quantile_cont(abs(family_gap - m), 0.5), 1e-8) as s
  from facet f join gm on f.lang = gm.lang and f.length_band = gm.length_band where is_ref group by 1, 2),
am as (select quantile_cont(family_gap, 0.5) as m from facet where is_ref),
al as (select any_value(m) as m, greatest(1.4826 * quantile_cont(abs(family_gap - m), 0.5), 1e-8) as s from facet, am where is_ref),
cz as (select f.*, abs(family_gap - coalesce(gs.m, al.m)) / coalesce(gs.s, al.s) as conflict_z from facet f
  left join gs on f.lang = gs.lang and f.length_band = gs.length_band, al),
cs as (select *, 0.5 * abs(family_gap) + 0.5 * least(1.0, greatest(0.0, conflict_z / 6)) as conflict_strength from cz),
th as (select quantile_cont(conflict_strength, 0.95) as t950, quantile_cont(conflict_strength, 0.975) as t975, quantile_cont(conflict_strength, 0.99) as t990
  from cs where is_ref),
conflict as (select *, conflict_strength >= t975 as high_conflict from cs, th)"""
_SHAPES = {"words": "ln(1 + word_count)", "sentences": "ln(1 + sentence_count)", "length": "mean_word_length"}


def _structure_sql() -> str:
    med = ", ".join(f"quantile_cont({e}, 0.5) as m_{n}" for n, e in _SHAPES.items())
    mad = ", ".join(f"any_value(m_{n}) as m_{n}, greatest(1.4826 * quantile_cont(abs({e} - m_{n}), 0.5), 1e-8) as s_{n}" for n, e in _SHAPES.items())
    z = ", ".join(f"abs({e} - coalesce(l.m_{n}, g.m_{n})) / coalesce(l.s_{n}, g.s_{n})" for n, e in _SHAPES.items())
    gone = " or ".join(f"{n} is null" for n in SIGNALS)
    return f""",
sm as (select lang, {med} from sig where is_ref group by 1), sl as (select sig.lang, {mad} from sig join sm using (lang) where is_ref group by 1),
tm as (select {med} from sig where is_ref), tl as (select {mad} from sig, tm where is_ref),
struct_z as (select doc_id, greatest({z}) as structural_z, ({gone}) as missing_signal from sig left join sl l using (lang), tl g),
structure as (select *, structural_z > 6 as structural_outlier, structural_z > 6 or missing_signal as measurement_anomaly from struct_z)"""


_STRUCT = _structure_sql()
_ALL = _CONFLICT + _STRUCT + ", scored as (select * from conflict join structure using (doc_id))"
_POOL = _ALL + """, ranked as (select *, row_number() over (partition by content_key order by (dataset = 'extension')::int desc, doc_id desc) as rn from scored),
work as (select * exclude (rn) from ranked where false union all by name select * from scored union all by name
  select * exclude (rn) replace ('pooled_unique' as dataset) from ranked where rn = 1)"""


def _scored(t):
    return k.scored_documents(t.documents, t.labels)


def _round(c, digits=6):
    """round() as the SQL does it: the scaled double decides a half, not the decimal digits of the unscaled one."""
    unit = F.lit(10.0 ** digits)
    return F.round(c * unit) / unit


def _rounded(df, *names, digits=6):
    return df.select(*[_round(F.col(c), digits).alias(c) if c in names else F.col(c) for c in df.columns])


@query("k0_text_signals", f"with {_SIG} select doc_id, word_count, sentence_count, " + ", ".join(f"round({n}, 6) as {n}" for n in SIGNALS) + " from sig")
def k0(t):
    return _rounded(text_signals(t.documents).select("doc_id", "word_count", "sentence_count", *SIGNALS), *SIGNALS)


@query("k1_reference_ecdf", f"with {_SIG} select doc_id, round({_whole('n_chars')}, 6) as score from sig")
def k1(t):
    ref = t.labels.select("doc_id").distinct().withColumn("is_ref", F.lit(True))
    rows = t.documents.select("doc_id", "n_chars").join(ref, "doc_id", "left").withColumn("is_ref", F.coalesce("is_ref", F.lit(False)))
    rows = rows.withColumn("v", F.col("n_chars").cast("double"))
    return rows.join(reference_ecdf(rows, [], "v", "is_ref", "score"), "v", "left").select("doc_id", F.round("score", 6).alias("score"))


def _half_up(x: str) -> str:
    """`_half_up_columns` in SQL: what doubles leave beyond the twelfth decimal does not decide a tie."""
    return f"round(({x})::decimal(18, 12), 6)::double"


def _half_up_columns(df, *names):
    """Six decimals, halves up: scores are shares of the sample size plus one, and often lie just on a half."""
    return df.select(*[F.round(F.col(c).cast("decimal(18,12)"), 6).cast("double").alias(c) if c in names else F.col(c) for c in df.columns])


@query("k2_filled_scores", f"with {_SCORE} select doc_id, " + ", ".join(f"{_half_up('s_' + n)} as s_{n}" for n in SEMANTIC) + " from score")
def k2(t):
    names = ["s_" + n for n in SEMANTIC]
    return _half_up_columns(k.signal_scores(k.signal_frame(t.documents, t.labels)).select("doc_id", *names), *names)


@query("k3_length_bands", f"with {_BAND} select lang, length_band, dataset, count(*) as documents, min(word_count) as low, max(word_count) as high from band group by 1, 2, 3")
def k3(t):
    banded = k.length_bands(k.signal_frame(t.documents, t.labels))
    return banded.groupBy("lang", "length_band", "dataset").agg(F.count(F.lit(1)).alias("documents"), F.min("word_count").alias("low"), F.max("word_count").alias("high"))


@query("k4_grouped_ecdf", f"with {_RAW} select doc_id, lang, length_band, round(u_punct_share, 6) as score from raw")
def k4(t):
    banded = k.length_bands(k.signal_frame(t.documents, t.labels))
    rows = k.long_signals(banded, ["punct_share"], ["doc_id", "lang", "length_band", "is_ref"])
    ladder = [(("lang", "length_band"), 50), (("lang",), 1), ((), 0)]
    return k.laddered_ecdf(rows, ["signal"], ladder, "score").select("doc_id", "lang", "length_band", F.round("score", 6).alias("score"))


@query("k5_directed_scores", f"with {_SCORE} select doc_id, " + ", ".join(f"round(s_{n}, 6) as s_{n}" for n in MORPHOLOGY) + " from score")
def k5(t):
    names = ["s_" + n for n in MORPHOLOGY]
    return _rounded(k.signal_scores(k.signal_frame(t.documents, t.labels)).select("doc_id", *names), *names)


def _faceted(t):
    return k.with_facets(k.signal_scores(k.signal_frame(t.documents, t.labels)))


@query("k6_facet_means", f"with {_FACET} select doc_id, " + ", ".join(f"round({f}_equal, 6) as {f}_equal" for f in FACETS) + ", round(q_equal, 6) as q_equal from facet")
def k6(t):
    names = [f"{f}_equal" for f in FACETS] + ["q_equal"]
    return _rounded(_faceted(t).select("doc_id", *names), *names)


@query("k7_huber_means", f"with {_FACET} select doc_id, " + ", ".join(f"round({f}_robust, 6) as {f}_robust" for f in FACETS) + ", round(q_robust, 6) as q_robust from facet")
def k7(t):
    names = [f"{f}_robust" for f in FACETS] + ["q_robust"]
    return _rounded(_faceted(t).select("doc_id", *names), *names)


@query("k8_family_gap", f"""with {_FACET} select doc_id, {_half_up('semantic_score')} as semantic_score, {_half_up('morphology_score')} as morphology_score,
  {_half_up('family_gap')} + 0.0 as family_gap from facet""")
def k8(t):
    names = ["semantic_score", "morphology_score", "family_gap"]
    return _half_up_columns(_faceted(t).select("doc_id", *names), *names).withColumn("family_gap", F.col("family_gap") + 0.0)


@query("k9_robust_location", """
with m as (select event_type, quantile_cont(value, 0.5) as centre from events group by 1)
select event_type, round(any_value(centre), 6) as centre, round(greatest(1.4826 * quantile_cont(abs(value - centre), 0.5), 1e-8), 6) as scale
from events join m using (event_type) group by 1""")
def k9(t):
    stats = k.robust_statistics(t.events.select("event_type", "value"), ["event_type"], 1e-8)
    return _rounded(stats, "centre", "scale")


@query("k10_conflict_strength", f"with {_CONFLICT} select doc_id, round(conflict_z, 4) as conflict_z, round(conflict_strength, 6) as conflict_strength, high_conflict from conflict")
def k10(t):
    flagged = k.with_conflict(_faceted(t)).select("doc_id", "conflict_z", "conflict_strength", "high_conflict")
    return _rounded(_rounded(flagged, "conflict_strength"), "conflict_z", digits=4)


@query("k11_structural_outliers", f"with {_SIG}{_STRUCT} select doc_id, round(structural_z, 6) as structural_z, structural_outlier, measurement_anomaly from structure")
def k11(t):
    rows = k.structural_outliers(k.signal_frame(t.documents, t.labels))
    return _rounded(rows.select("doc_id", "structural_z", "structural_outlier", "measurement_anomaly"), "structural_z")


_RESID = """
with b as (select l_returnflag as flag, l_extendedprice as raw, l_extendedprice / greatest(l_quantity, 1) as rate, ln(1 + l_quantity) as x from lineitem),
g as (select flag, count(*) as n, regr_slope(rate, x) as b, regr_intercept(rate, x) as a from b group by 1),
w as (select regr_slope(rate, x) as gb, regr_intercept(rate, x) as ga from b),
r as (select b.*, rate - (case when n >= 30 then g.a + g.b * x else ga + gb * x end) as resid from b join g using (flag), w)"""


def _residuals(t):
    base = t.lineitem.select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("raw"),
                             (F.col("l_extendedprice") / F.greatest("l_quantity", F.lit(1.0))).alias("rate"), F.log1p("l_quantity").alias("x"))
    return k.length_residuals(base, "flag", "rate", "x", "resid")


@query("k12_group_residuals", _RESID + " select flag, count(*) as rows, round(sqrt(avg(resid * resid)), 4) as rms, round(max(abs(resid)), 4) as largest from r group by 1")
def k12(t):
    return _residuals(t).groupBy("flag").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sqrt(F.avg(F.col("resid") ** 2)), 4).alias("rms"),
                                             F.round(F.max(F.abs("resid")), 4).alias("largest"))


@query("k13_length_correlation", _RESID + """ select flag, round(corr(raw, x), 6) as raw_corr, round(corr(rate, x), 6) as rate_corr,
  round(abs(corr(resid, x)), 6) as residual_corr from r group by 1""")
def k13(t):
    return _residuals(t).groupBy("flag").agg(F.round(correlation("raw", "x"), 6).alias("raw_corr"), F.round(correlation("rate", "x"), 6).alias("rate_corr"),
                                             F.round(F.abs(correlation("resid", "x")), 6).alias("residual_corr"))


def _summary_sql(source: str, by: str) -> str:
    return f"""select {by}, count(*) as n, round(avg(q_equal), 6) as q_equal_mean, round(avg(q_robust), 6) as q_robust_mean,
  round(stddev_samp(q_robust), 6) as q_robust_sd, round(sum(greatest(word_count, 1) * q_robust) / sum(greatest(word_count, 1)), 6) as q_length_weighted_mean,
  round(avg(high_conflict::int), 6) as high_conflict_rate, round(avg(measurement_anomaly::int), 6) as anomaly_rate,
  {', '.join(f'round(avg({f}_robust), 6) as {f}_mean' for f in FACETS)}, round(quantile_cont(q_robust, .05), 6) as q_p05,
  round(quantile_cont(q_robust, .25), 6) as q_p25, round(quantile_cont(q_robust, .5), 6) as q_median, round(quantile_cont(q_robust, .75), 6) as q_p75,
  round(quantile_cont(q_robust, .95), 6) as q_p95 from {source} group by {by}"""


def _round_all(df, skip):
    return df.select(*[F.col(c) if c in skip else F.round(c, 6).alias(c) for c in df.columns])


@query("k14_quality_summary", f"with {_ALL} " + _summary_sql("scored", "dataset, lang"))
def k14(t):
    return _round_all(k.quality_summary(_scored(t), ["dataset", "lang"]), ("dataset", "lang", "n"))


@query("k15_pooled_summary", f"with {_POOL} " + _summary_sql("work", "dataset"))
def k15(t):
    scored = _scored(t)
    return _round_all(k.quality_summary(scored.unionByName(k.pooled_unique(scored)), ["dataset"]), ("dataset", "n"))


@query("k16_pareto_front", f"""with {_ALL}, g as ({_summary_sql('scored', 'source')})
select source, {', '.join(f + '_mean' for f in FACETS)} from g a where not exists (select 1 from g b where
  {' and '.join(f'b.{f}_mean >= a.{f}_mean' for f in FACETS)} and ({' or '.join(f'b.{f}_mean > a.{f}_mean' for f in FACETS)}))""")
def k16(t):
    names = [f + "_mean" for f in FACETS]
    rows = _round_all(k.quality_summary(_scored(t), ["source"]), ("source", "n")).select("source", *names)
    return k.pareto_front(rows, names)


@query("k17_threshold_sensitivity", f"""with {_POOL}, q as (select 0.95 as level, t950 as threshold from th union all select 0.975, t975 from th
  union all select 0.99, t990 from th)
select dataset, lang, level::double as level, round(threshold, 6) as threshold, count(*) as n, round(avg((conflict_strength >= threshold)::int), 6) as conflict_rate
from work, q group by 1, 2, 3, 4""")
def k17(t):
    scored = _scored(t)
    work = scored.unionByName(k.pooled_unique(scored))
    cells = F.array(*[F.struct(F.lit(level).alias("level"), F.col(name).alias("threshold")) for name, level in k.CONFLICT_LEVELS.items()])
    rows = work.select("dataset", "lang", "conflict_strength", F.explode(cells).alias("c")).select("dataset", "lang", "conflict_strength", "c.*")
    return rows.groupBy("dataset", "lang", "level", F.round("threshold", 6).alias("threshold")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("conflict_strength") >= F.col("threshold")).cast("double")), 6).alias("conflict_rate"))


def rank_sql(x: str, part: str = "") -> str:
    """Average-tie rank in SQL."""
    over = f"partition by {part} " if part else ""
    peers = f"partition by {part}, {x}" if part else f"partition by {x}"
    return f"(rank() over ({over}order by {x}) + (count(*) over ({peers}) - 1) / 2.0)"


@query("k18_method_agreement", f"""with {_ALL}, r as (select *, {rank_sql('q_equal', 'dataset')} as ra, {rank_sql('q_robust', 'dataset')} as rb,
  abs(q_robust - q_equal) as delta from scored)
select dataset, count(*) as n, round(corr(ra, rb), 6) as spearman, round(avg(delta), 6) as mean_change,
  round(avg(delta) filter (high_conflict), 6) as mean_change_conflict, round(avg(delta) filter (measurement_anomaly), 6) as mean_change_anomaly
from r group by 1""")
def k18(t):
    scored = _scored(t)
    rho = spearman(scored, ["dataset"], "q_equal", "q_robust")
    delta = F.abs(F.col("q_robust") - F.col("q_equal"))
    means = scored.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(delta), 6).alias("mean_change"),
        F.round(F.avg(F.when(F.col("high_conflict"), delta)), 6).alias("mean_change_conflict"),
        F.round(F.avg(F.when(F.col("measurement_anomaly"), delta)), 6).alias("mean_change_anomaly"))
    return means.join(rho.select("dataset", F.round("spearman", 6).alias("spearman")), "dataset")


_STRATA = {"high_quality": ("q_robust", True), "low_quality": ("q_robust", False), "high_conflict": ("conflict_strength", True), "low_conflict": ("conflict_strength", False)}


@query("k19_audit_sample", f"""with {_ALL}, s as (select doc_id, lang, round(q_robust, 9) as q_robust, round(conflict_strength, 9) as conflict_strength from scored where is_ref), p as (""" + " union all ".join(
    f"select doc_id, lang, '{s}' as stratum, {i} as o, row_number() over (partition by lang order by {c} {'desc' if d else 'asc'}, doc_id) as rn from s"
    for i, (s, (c, d)) in enumerate(_STRATA.items())) + """), c as (select doc_id, arg_min(stratum, o) as stratum from p where rn <= 3 group by 1)
select c.doc_id, lang, stratum, sha256(substr(replace(text, chr(0), ''), 1, 2000)) as excerpt_sha256 from c join documents using (doc_id)""")
def k19(t):
    ref = _scored(t).where("is_ref").select("doc_id", "lang", F.round("q_robust", 9).alias("q_robust"), F.round("conflict_strength", 9).alias("conflict_strength"))
    picks = None
    for i, (name, (col, high)) in enumerate(_STRATA.items()):
        order = [F.col(col).desc() if high else F.col(col).asc(), F.col("doc_id").asc()]
        part = top_per_group(ref, ["lang"], order, 3).select("doc_id", F.lit(name).alias("stratum"), F.lit(i).alias("o"))
        picks = part if picks is None else picks.unionByName(part)
    chosen = picks.groupBy("doc_id").agg(F.min_by("stratum", "o").alias("stratum"))
    excerpt = F.substring(F.translate("text", "\x00", ""), 1, 2000)
    return chosen.join(t.documents, "doc_id").select("doc_id", "lang", "stratum", F.sha2(excerpt, 256).alias("excerpt_sha256"))


def _weight_sql(source: str) -> str:
    parts = []
    for f, names in FACETS.items():
        cols = ["s_" + n for n in names]
        x = {c: f"(greatest(0.0, least(1.0, {c})) + 1e-12)" for c in cols}
        room = {c: f"greatest(0.0, 1 + (sum({x[c]} * ln({x[c]})) / sum({x[c]}) - ln(sum({x[c]}))) / ln(count(*)))" for c in cols}
        crit = {c: f"stddev_samp({c}) * (" + " + ".join(f"(1 - coalesce(corr({c}, {o}), 0))" for o in cols if o != c) + ")" for c in cols}
        inner = ", ".join(f"{room[c]} as e{i}, {crit[c]} as c{i}" for i, c in enumerate(cols))
        norm = ", ".join(f"e{i} / (e0 + e1 + e2) as e{i}, c{i} / (c0 + c1 + c2) as c{i}" for i in range(3))
        for i, n in enumerate(names):
            parts.append(f"select '{f}' as facet, '{n}' as signal, 1.0 / 3 as equal, e{i} as entropy, c{i} as critic, sqrt(e{i} * c{i}) / "
                         f"(sqrt(e0 * c0) + sqrt(e1 * c1) + sqrt(e2 * c2)) as geometric from (select {norm} from (select {inner} from {source} where is_ref))")
    return " union all ".join(parts)


@query("k20_entropy_weights", f"with {_SCORE}, w as ({_weight_sql('score')}) select facet, signal, round(entropy, 6) as entropy from w")
def k20(t):
    return k.facet_weights(k.signal_scores(k.signal_frame(t.documents, t.labels)).where("is_ref")).select("facet", "signal", F.round("entropy", 6).alias("entropy"))


@query("k21_critic_weights", f"with {_SCORE}, w as ({_weight_sql('score')}) select facet, signal, round(critic, 6) as critic, round(geometric, 6) as geometric from w")
def k21(t):
    w = k.facet_weights(k.signal_scores(k.signal_frame(t.documents, t.labels)).where("is_ref"))
    return w.select("facet", "signal", F.round("critic", 6).alias("critic"), F.round("geometric", 6).alias("geometric"))


def _weighted_sql() -> str:
    kinds = ["equal", "entropy", "critic", "geometric"]
    flat = ", ".join(f"max({kd}) filter (signal = '{n}') as w_{kd}_{n}" for kd in kinds for n in SIGNALS)
    q = ", ".join("(" + " + ".join(f"s_{n} * w_{kd}_{n}" for n in SIGNALS) + f") / 4 as qw_{kd}" for kd in kinds)
    rows = " union all ".join(f"select '{kd}' as method, round(avg(abs(qw_{kd} - q_robust)), 6) as mean_difference, round(corr("
                              f"a_{kd}, b), 6) as spearman from r" for kd in kinds)
    ranks = ", ".join(f"{rank_sql(f'round(qw_{kd}, 9)')} as a_{kd}" for kd in kinds)
    return (f"with {_FACET}, w as ({_weight_sql('score')}), flat as (select {flat} from w), q as (select *, {q} from facet, flat), "
            f"r as (select *, {ranks}, {rank_sql('round(q_robust, 9)')} as b from q) {rows}")


@query("k22_weight_stability", _weighted_sql())
def k22(t):
    facets = materialise(k.with_facets(k.signal_scores(k.signal_frame(t.documents, t.labels))))
    scored = k.weighted_scores(facets, materialise(k.facet_weights(facets.where("is_ref"))))
    kinds = ["equal", "entropy", "critic", "geometric"]
    rows = scored.select("q_robust", F.explode(F.array(*[F.struct(F.lit(kd).alias("method"), F.col("qw_" + kd).alias("q")) for kd in kinds])).alias("m"))
    rows = rows.select("m.method", F.round("m.q", 9).alias("q"), F.round("q_robust", 9).alias("base"), F.abs(F.col("m.q") - F.col("q_robust")).alias("gap"))
    means = rows.groupBy("method").agg(F.round(F.avg("gap"), 6).alias("mean_difference"))
    return means.join(spearman(rows, ["method"], "q", "base").select("method", F.round("spearman", 6).alias("spearman")), "method")


def _z_sql() -> str:
    long = " union all ".join(f"select doc_id, dataset, lang, length_band, is_ref, '{n}' as signal, s_{n} as v from score" for n in SIGNALS)
    levels = []
    for name, part in (("zg", "signal, lang, length_band"), ("zl", "signal, lang"), ("za", "signal")):
        keys = part.split(", ")
        on = " and ".join(f"x.{c} = m.{c}" for c in keys)
        grp = ", ".join("x." + c for c in keys)
        levels.append(f"{name}m as (select {part}, count(*) as n, quantile_cont(v, 0.5) as m from lz where is_ref group by all), "
                      f"{name}s as (select {grp}, any_value(n) as n, any_value(m) as m, greatest(1.4826 * quantile_cont(abs(v - m), 0.5), 0.03) as s "
                      f"from lz x join {name}m m on {on} where is_ref group by {grp})")
    pick = lambda c: f"case when zgs.n >= 30 then zgs.{c} when zls.n >= 30 then zls.{c} else zas.{c} end"
    return (f", lz as ({long}), " + ", ".join(levels) +
            f", z as (select x.doc_id, x.dataset, x.lang, x.length_band, x.is_ref, x.signal, greatest(-8.0, least(8.0, (v - {pick('m')}) / {pick('s')})) as z from lz x "
            "left join zgs on x.signal = zgs.signal and x.lang = zgs.lang and x.length_band = zgs.length_band "
            "left join zls on x.signal = zls.signal and x.lang = zls.lang join zas on x.signal = zas.signal)")


_Z = _SCORE + _z_sql()
_FA = "(" + ", ".join(f"'{n}'" for n in SEMANTIC) + ")"
_GAP = (f", ends as (select doc_id, any_value(dataset) as dataset, any_value(lang) as lang, any_value(length_band) as length_band, any_value(is_ref) as is_ref, "
        f"max(z) filter (signal in {_FA}) as a1, min(z) filter (signal in {_FA}) as a0, max(z) filter (signal not in {_FA}) as b1, "
        f"min(z) filter (signal not in {_FA}) as b0 from z group by doc_id), gap as (select *, greatest(a1 - b0, b1 - a0) as max_gap from ends)")


@query("k23_conditional_z", f"with {_Z} select doc_id, signal, round(z, 6) + 0.0 as z from z")
def k23(t):
    z = k.conditional_z(k.signal_scores(k.signal_frame(t.documents, t.labels)))
    return z.select("doc_id", "signal", (_round(F.col("z")) + 0.0).alias("z"))


@query("k24_widest_gap", f"with {_Z}{_GAP} select doc_id, dataset, round(max_gap, 6) as max_gap from gap")
def k24(t):
    z = k.conditional_z(k.signal_scores(k.signal_frame(t.documents, t.labels)))
    return _rounded(k.widest_gap(z, ["doc_id", "dataset"]), "max_gap")


PERMS = 200
_WAYS = {"conditional": ("lang", "length_band"), "global": ()}


def _null_sql(way: int, by: tuple[str, ...]) -> str:
    part = f"partition by {', '.join(by)} " if by else ""
    keys = "".join(c + ", " for c in by)
    number = "list_position([" + ", ".join(f"'{n}'" for n in SIGNALS) + "], signal) - 1"
    return f"""select quantile_cont(greatest(a1 - b0, b1 - a0), 0.99) as v from (select {keys}perm, place, max(z) filter (signal in {_FA}) as a1, min(z) filter (signal in {_FA}) as a0, max(z) filter (signal not in {_FA}) as b1,
  min(z) filter (signal not in {_FA}) as b0 from (select {keys}perm, signal, z, {permuted_sql('r', 'n', 'seed')} as place from (select {keys}perm, signal, z, r, n, perm * 7919 + ({number}) * 15485863 + {1000003 * way} as seed
  from (select z.*, rank_.r, rank_.n from z join (select doc_id, row_number() over ({part}order by doc_id) - 1 as r, count(*) over ({part}) as n from (select distinct doc_id, lang, length_band from z where is_ref)) rank_ using (doc_id)), range({PERMS}) p(perm))) group by all)"""


_THRESHOLDS = ", null_c as materialized (" + _null_sql(0, _WAYS["conditional"]) + "), null_g as materialized (" + _null_sql(1, _WAYS["global"]) + ")"


def _thresholds(z):
    """Conditional and global threshold of the widest gap; `z` is the long table of conditional scores."""
    wide = k.wide_signals(z.where("is_ref"), "doc_id", "z", list(SIGNALS), "z_").select("doc_id", F.array(*["z_" + n for n in SIGNALS]).alias("zs"))
    keys = z.where("is_ref").groupBy("doc_id").agg(F.first("lang").alias("lang"), F.first("length_band").alias("length_band"))
    return k.permutation_thresholds(materialise(wide.join(keys, "doc_id")), "doc_id", _WAYS, PERMS, 0.99)


@query("k25_permutation_threshold", f"with {_Z}{_THRESHOLDS} select round(null_c.v, 6) as threshold_conditional, round(null_g.v, 6) as threshold_global, {PERMS} as permutations from null_c, null_g")
def k25(t):
    z = materialise(k.conditional_z(k.signal_scores(k.signal_frame(t.documents, t.labels))))
    return _rounded(_thresholds(z), "threshold_conditional", "threshold_global").withColumn("permutations", F.lit(PERMS))


_FLAGS = (_CONFLICT + _z_sql() + _GAP + _THRESHOLDS
          + ", flags as (select gap.*, c.high_conflict as a, max_gap >= null_c.v as b, max_gap >= null_g.v as g from gap join conflict c using (doc_id), null_c, null_g)")


def _flagged(t):
    """Documents with their scores and three flags: main conflict `a`, beyond the conditional threshold `b`, beyond the global one `g`."""
    scored = _scored(t)
    z = materialise(k.conditional_z(scored))
    wide = k.wide_signals(z, "doc_id", "z", list(SIGNALS), "z_")
    rows = scored.select("doc_id", "dataset", "lang", "is_ref", "high_conflict").join(wide, "doc_id").join(k.widest_gap(z, ["doc_id"]), "doc_id")
    return (with_row(rows, _thresholds(z)).withColumn("a", F.col("high_conflict")).withColumn("b", F.col("max_gap") >= F.col("threshold_conditional"))
            .withColumn("g", F.col("max_gap") >= F.col("threshold_global")))


@query("k26_flag_comparison", f"""with {_FLAGS} select dataset, lang, count(*) as n, round(avg(a::int), 6) as main_rate, round(avg(b::int), 6) as conditional_rate,
  round(avg(g::int), 6) as global_rate, round(case when count(*) filter (a or b) > 0 then count(*) filter (a and b) / count(*) filter (a or b) else 1.0 end, 6) as jaccard,
  bool_and(not b or g) as conditional_is_subset from flags group by 1, 2""")
def k26(t):
    both, either = F.count_if(F.expr("a and b")), F.count_if(F.expr("a or b"))
    return _flagged(t).groupBy("dataset", "lang").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.col(c).cast("double")), 6).alias(n) for c, n in (("a", "main_rate"), ("b", "conditional_rate"), ("g", "global_rate"))],
        F.round(F.when(either > 0, both / either).otherwise(1.0), 6).alias("jaccard"), F.bool_and(F.expr("not b or g")).alias("conditional_is_subset"))


@query("k27_dominant_pair", f"""with {_FLAGS}, pr as (select x.doc_id, x.signal || ' x ' || y.signal as pair, abs(x.z - y.z) as d,
   list_position([{', '.join(f"'{n}'" for n in SEMANTIC)}], x.signal) * 6 + list_position([{', '.join(f"'{n}'" for n in MORPHOLOGY)}], y.signal) as o
   from z x join z y on x.doc_id = y.doc_id where x.signal in {_FA} and y.signal not in {_FA}),
best as (select doc_id, pair from (select *, row_number() over (partition by doc_id order by round(d, 9) desc, o) as rn from pr) where rn = 1),
c as (select f.threshold, dataset, pair, count(*) as n from (select doc_id, dataset, 'conditional' as threshold from flags where b union all select doc_id, dataset, 'global' from flags where g) f join best using (doc_id) group by 1, 2, 3)
select threshold, dataset, pair, n as records, round(n / sum(n) over (partition by threshold, dataset), 6) as share from c""")
def k27(t):
    """Pairs of signals that differ most in the documents beyond each threshold."""
    kinds = F.array_compact(F.array(F.when(F.col("b"), F.lit("conditional")), F.when(F.col("g"), F.lit("global"))))
    zr = _flagged(t).select("dataset", F.explode(kinds).alias("threshold"), *["z_" + n for n in SIGNALS])
    pairs = zr.groupBy("threshold", "dataset", k.dominant_pair(zr).alias("pair")).agg(F.count(F.lit(1)).alias("records"))
    share = F.col("records") / F.sum("records").over(Window.partitionBy("threshold", "dataset"))  # at most 36 pairs per dataset
    return pairs.withColumn("share", F.round(share, 6))


@query("k29_length_deciles", f"""with {_CONFLICT}, t as (select *, ntile(10) over (order by word_count, doc_id) as decile from conflict)
select decile::int as decile, count(*) as n, round(avg(high_conflict::int), 6) as conflict_rate, max(word_count) as longest from t group by 1""")
def k29(t):
    rows = k.with_conflict(_faceted(t)).select("doc_id", "word_count", "high_conflict")
    return k.rank_tiles(rows, ["word_count", "doc_id"], 10, "decile").groupBy("decile").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("high_conflict").cast("double")), 6).alias("conflict_rate"), F.max("word_count").alias("longest"))


@query("k30_bin_counts", """
select event_type, (least(greatest(floor(value / 25) + 1, 0), 21))::int as value_bin, (hour(ts) // 3)::int as hour_bin, count(*) as n from events group by 1, 2, 3""")
def k30(t):
    return t.events.groupBy("event_type", F.width_bucket("value", F.lit(0.0), F.lit(500.0), F.lit(20)).cast("int").alias("value_bin"),
                            F.floor(F.hour("ts") / 3).cast("int").alias("hour_bin")).agg(F.count(F.lit(1)).alias("n"))
