"""Reference-calibrated scores, conflict flags and their summaries (K).

Signals are kept long, (id, signal, value), wherever a statistic is needed per signal: every signal shares one
range-placed pass. Group statistics fall back along a ladder of coarser groups when a group has few reference rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.numeric import correlation
from plumbline.functions.arrays import mean_of, present, with_huber_means
from plumbline.functions.text import FACETS, MORPHOLOGY, SEMANTIC, SIGNALS, text_signals
from plumbline.functions.keys import permuted, unpermuted
from plumbline.operators.ranking import exact_quantiles, reference_ecdf, running
from plumbline.operators.splits import STRATA
from plumbline.runtime import materialise, materialise_evenly, spread, with_row

Ladder = Sequence[tuple[Sequence[str], int]]
BAND_CUTS = {"c20": 0.2, "c40": 0.4, "c60": 0.6, "c80": 0.8}
CONFLICT_LEVELS = {"t950": 0.95, "t975": 0.975, "t990": 0.99}


def signal_frame(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """Text signals with `is_ref` (labelled documents are the reference sample); texts are read once and dropped."""
    signals = text_signals(spread(docs)).withColumn("content_key", F.sha2("text", 256)).drop("text")
    ref = labelled.select("doc_id").distinct().withColumn("is_ref", F.lit(True))
    rows = signals.join(ref, "doc_id", "left").withColumn("is_ref", F.coalesce("is_ref", F.lit(False)))
    return materialise(rows.withColumn("dataset", F.when(F.col("is_ref"), "reference").otherwise("extension")))


def length_bands(df: DataFrame, group: str = "lang") -> DataFrame:
    """Band 0..4 of log word count between the reference quantiles of the group, or of all rows when it has none."""
    x = df.withColumn("_x", F.log1p(F.greatest("word_count", F.lit(0.0))))
    ref = x.where("is_ref")
    own = exact_quantiles(ref, [group], "_x", BAND_CUTS)
    wide = with_row(x.join(own, group, "left"), exact_quantiles(ref, [], "_x", BAND_CUTS), "g_")
    cuts = F.array(*[F.coalesce(c, "g_" + c) for c in BAND_CUTS])
    band = F.size(F.filter(cuts, lambda c: c <= F.col("_x")))
    return wide.withColumn("length_band", band).select(*df.columns, "length_band")


def long_signals(df: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("signal"), F.col(n).cast("double").alias("v")) for n in names]))
    return df.select(*keep, cells.alias("_c")).select(*keep, "_c.signal", F.col("_c.v").alias("value"))


def wide_signals(long: DataFrame, key: str, value: str, names: Sequence[str], prefix: str) -> DataFrame:
    return long.groupBy(key).agg(*[F.max(F.when(F.col("signal") == n, F.col(value))).alias(prefix + n) for n in names])


def _level_key(cols: Sequence[str]) -> Column:
    return F.concat_ws("\x1f", F.lit(str(len(cols))), *[F.col(c).cast("string") for c in cols])


def _reference_levels(rows: DataFrame, fixed: Sequence[str], ladder: Ladder) -> DataFrame:
    """Reference rows once per ladder level, under the key of that level."""
    ref = rows.where(F.col("is_ref") & F.col("value").isNotNull())
    return ref.select(*fixed, "value", F.explode(F.array(*[_level_key(c) for c, _ in ladder])).alias("_key"))


def with_level(rows: DataFrame, fixed: Sequence[str], ladder: Ladder) -> DataFrame:
    """Add `_key`: the first level of the ladder with enough reference values. Coarser levels use columns of finer ones."""
    finest = list(ladder[0][0])
    usable = (F.col("is_ref") & F.col("value").isNotNull()).cast("long")
    groups = rows.groupBy(*fixed, *finest).agg(F.sum(usable).alias("_n"))
    chosen = F.lit(None).cast("string")
    for cols, least in reversed(ladder):
        size = F.sum("_n").over(Window.partitionBy(*fixed, *cols))
        chosen = F.when(size >= least, _level_key(cols)).otherwise(chosen)
    groups = groups.select(*fixed, *finest, chosen.alias("_key"))
    return rows.join(groups, [*fixed, *finest]) if fixed or finest else with_row(rows, groups)


def laddered_ecdf(rows: DataFrame, fixed: Sequence[str], ladder: Ladder, out: str) -> DataFrame:
    """Reference ECDF of `value` inside the chosen level; levels share one range-placed pass."""
    placed = with_level(rows, fixed, ladder)
    ref = _reference_levels(rows, fixed, ladder).withColumn("_ref", F.lit(True))
    ask = placed.where(F.col("value").isNotNull()).select(*fixed, "value", "_key").distinct().withColumn("_ref", F.lit(False))
    scores = reference_ecdf(ref.unionByName(ask), [*fixed, "_key"], "value", "_ref", out)
    return placed.join(scores, [*fixed, "_key", "value"], "left").drop("_key")


def robust_statistics(rows: DataFrame, by: Sequence[str], floor: float) -> DataFrame:
    """Median and max(1.4826 MAD, floor) of `value` per group."""
    med = exact_quantiles(rows, by, "value", {"centre": 0.5})
    if by:
        gaps = rows.join(med, list(by))
    else:
        gaps = with_row(rows, med)
    gaps = gaps.where("value is not null").withColumn("value", F.abs(F.col("value") - F.col("centre"))).drop("centre")
    mad = exact_quantiles(gaps, by, "value", {"mad": 0.5})
    both = med.join(mad, list(by)) if by else with_row(med, mad)
    return both.select(*by, "centre", F.greatest(1.4826 * F.col("mad"), F.lit(floor)).alias("scale"))


def laddered_robust(rows: DataFrame, fixed: Sequence[str], ladder: Ladder, floor: float) -> DataFrame:
    """Add `centre` and `scale` of the chosen level's reference values."""
    stats = robust_statistics(_reference_levels(rows, fixed, ladder), [*fixed, "_key"], floor)
    return with_level(rows, fixed, ladder).join(stats, [*fixed, "_key"], "left").drop("_key")


def directed(score: Column, direction: str) -> Column:
    out = {"positive": score, "reverse": 1 - score, "typical": 1 - 2 * F.abs(score - 0.5)}[direction]
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), out))


def fill_scores(df: DataFrame, names: Sequence[str], group: str = "lang") -> DataFrame:
    """Fill missing scores with the reference median of the group, else 0.5; medians only for columns that need them."""
    gaps = df.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in names]).first()
    needy = [n for n in names if gaps[n]]
    if not needy:
        return df
    med = exact_quantiles(long_signals(df.where("is_ref"), needy, [group]), [group, "signal"], "value", {"m": 0.5})
    med = med.groupBy(group).agg(*[F.max(F.when(F.col("signal") == n, F.col("m"))).alias("_m_" + n) for n in needy])
    wide = df.join(med, group, "left")
    return wide.select(*[F.coalesce(c, "_m_" + c, F.lit(0.5)).alias(c) if c in needy else F.col(c) for c in df.columns])


def signal_scores(signals: DataFrame) -> DataFrame:
    """Reference scores `s_*`: one sample for meaning signals, language and length band for form signals.

    Meaning signals take the name of one common group, so both kinds share a single pass.
    """
    banded = materialise(length_bands(signals))
    rows = long_signals(banded, list(SIGNALS), ["doc_id", "lang", "length_band", "is_ref"])
    common = F.col("signal").isin(*SEMANTIC)
    rows = rows.withColumn("group", F.when(~common, F.col("lang"))).withColumn("band", F.when(~common, F.col("length_band")))
    rows = rows.select("doc_id", "is_ref", "signal", "value", F.coalesce("group", F.lit("*")).alias("group"), F.coalesce("band", F.lit(-1)).alias("band"))
    scores = laddered_ecdf(rows, ["signal"], [(("group", "band"), 50), (("group",), 1), ((), 0)], "score")
    raw = wide_signals(scores, "doc_id", "score", list(SIGNALS), "s_")
    scored = banded.join(raw, "doc_id")
    scored = materialise_evenly(scored.select(*banded.columns, *[directed(F.col("s_" + n), SIGNALS[n]).alias("s_" + n) for n in SIGNALS]))
    return fill_scores(scored, ["s_" + n for n in SIGNALS])


def with_facets(scored: DataFrame) -> DataFrame:
    """Equal and Huber facet means, their averages, family scores and the family gap."""
    vectors = {f: present([F.col("s_" + n) for n in names]) for f, names in FACETS.items()}
    out = scored.withColumns({f"{f}_equal": mean_of(v) for f, v in vectors.items()})
    out = with_huber_means(out, {f"{f}_robust": v for f, v in vectors.items()})
    for kind in ("equal", "robust"):
        out = out.withColumn(f"q_{kind}", mean_of(present([F.col(f"{f}_{kind}") for f in FACETS])))
    out = out.withColumn("semantic_score", mean_of(present([F.col("s_" + n) for n in SEMANTIC])))
    out = out.withColumn("morphology_score", mean_of(present([F.col("s_" + n) for n in MORPHOLOGY])))
    return out.withColumn("family_gap", F.col("semantic_score") - F.col("morphology_score"))


def conflict_thresholds(flagged: DataFrame) -> DataFrame:
    return exact_quantiles(flagged.where("is_ref"), [], "conflict_strength", CONFLICT_LEVELS)


def with_conflict(facets: DataFrame) -> DataFrame:
    """Conflict strength of the family gap against its group, flagged at the 97.5 % reference quantile."""
    facets = materialise(facets)
    rows = facets.select("doc_id", "lang", "length_band", "is_ref", F.col("family_gap").alias("value"))
    stats = laddered_robust(rows, [], [(("lang", "length_band"), 1), ((), 0)], 1e-8)
    z = F.abs(F.col("value") - F.col("centre")) / F.col("scale")
    z = stats.select("doc_id", z.alias("conflict_z"))
    out = facets.join(z, "doc_id").withColumn(
        "conflict_strength", 0.5 * F.abs("family_gap") + 0.5 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("conflict_z") / 6)))
    out = materialise(out)
    return with_row(out, conflict_thresholds(out)).withColumn("high_conflict", F.col("conflict_strength") >= F.col("t975"))


def structural_outliers(signals: DataFrame) -> DataFrame:
    """Largest robust z over log words, log sentences and word length inside the language; outlier above 6."""
    shaped = signals.select("doc_id", "lang", "is_ref", F.log1p("word_count").alias("words"), F.log1p("sentence_count").alias("sentences"),
                            F.col("mean_word_length").alias("length"),
                            F.greatest(*[F.col(n).isNull() for n in SIGNALS]).alias("missing_signal"))
    long = long_signals(shaped, ["words", "sentences", "length"], ["doc_id", "lang", "is_ref", "missing_signal"])
    z = laddered_robust(long, ["signal"], [(("lang",), 1), ((), 0)], 1e-8)
    z = z.withColumn("z", F.abs(F.col("value") - F.col("centre")) / F.col("scale"))
    top = z.groupBy("doc_id").agg(F.max("z").alias("structural_z"), F.bool_or("missing_signal").alias("missing_signal"))
    return top.withColumn("structural_outlier", F.col("structural_z") > 6).withColumn(
        "measurement_anomaly", F.col("structural_outlier") | F.col("missing_signal"))


def scored_documents(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """The full scored frame: signals, scores, facets, conflict and anomaly flags."""
    signals = signal_frame(docs, labelled)
    flagged = with_conflict(with_facets(signal_scores(signals)))
    return materialise(flagged.join(structural_outliers(signals), "doc_id"))


def pooled_unique(scored: DataFrame) -> DataFrame:
    """One row per content, extension rows first, under the name `pooled_unique`; copies meet in a map-side aggregate."""
    first = F.struct((F.col("dataset") == "extension").cast("int"), "doc_id")
    one = scored.groupBy("content_key").agg(F.max_by(F.struct(*scored.columns), first).alias("r")).select("r.*")
    return one.withColumn("dataset", F.lit("pooled_unique"))


def quality_summary(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group: size, means, spread, quantiles, length-weighted mean and flag rates."""
    by, q, w = list(by), F.col("q_robust"), F.greatest("word_count", F.lit(1.0))
    base = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("q_equal").alias("q_equal_mean"), F.avg(q).alias("q_robust_mean"),
        F.stddev_samp(q).alias("q_robust_sd"), (F.sum(w * q) / F.sum(w)).alias("q_length_weighted_mean"),
        F.avg(F.col("high_conflict").cast("double")).alias("high_conflict_rate"),
        F.avg(F.col("measurement_anomaly").cast("double")).alias("anomaly_rate"),
        *[F.avg(f"{f}_robust").alias(f"{f}_mean") for f in FACETS])
    spread = exact_quantiles(scored, by, "q_robust", {"q_p05": .05, "q_p25": .25, "q_median": .5, "q_p75": .75, "q_p95": .95})
    return base.join(spread, by)


def pareto_front(rows: DataFrame, dims: Sequence[str], block: int = 2000) -> DataFrame:
    """Rows no other row dominates (all dims at least as large, one larger).

    Each partition first drops rows dominated inside it; what is left is compared with itself in blocks of at most
    `block` rows, each broadcast in turn, so any front size is handled.
    """
    names = list(dims)

    def keep_local(batches):
        front = None
        for pdf in batches:
            both = pdf if front is None else pd.concat([front, pdf], ignore_index=True)
            x = both[names].to_numpy(float)
            stays = np.ones(len(x), bool)
            for i in range(len(x)):
                if stays[i]:
                    beaten = np.all(x <= x[i], axis=1) & np.any(x < x[i], axis=1)
                    stays &= ~beaten
            front = both[stays]
        if front is not None:
            yield front

    local = materialise(rows.mapInPandas(keep_local, rows.schema))
    points = local.select(*[F.col(d).alias("_o_" + d) for d in names]).distinct().withColumn("_one", F.lit(1))
    line = running(points, [], ["_o_" + d for d in names], {"_at": ("sum", "_one")})
    line = line.withColumn("_block", F.floor((F.col("_at") - 1) / block))
    blocks = (line.agg(F.max("_block")).first()[0] or 0) + 1
    beaten, larger = F.lit(True), F.lit(False)
    for d in names:
        beaten = beaten & (F.col("_o_" + d) >= F.col(d))
        larger = larger | (F.col("_o_" + d) > F.col(d))
    out = local
    for b in range(blocks):
        rivals = line.where(F.col("_block") == b).select(*["_o_" + d for d in names])
        out = out.join(F.broadcast(rivals), beaten & larger, "left_anti")
    return out


def entropy_weights(scored: DataFrame, names: Sequence[str]) -> DataFrame:
    """Entropy weights of columns in [0, 1] from one aggregation: sum p ln p = (sum x ln x) / s - ln s."""
    cells = {n: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(n))) + 1e-12 for n in names}
    sums = scored.agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias("s_" + n) for n, x in cells.items()],
                      *[F.sum(x * F.ln(x)).alias("l_" + n) for n, x in cells.items()])
    room = {n: F.greatest(F.lit(0.0), 1 + (F.col("l_" + n) / F.col("s_" + n) - F.ln("s_" + n)) / F.ln("n")) for n in names}
    total = sum(room.values(), F.lit(0.0))
    return sums.select(*[F.when(total > 0, room[n] / total).otherwise(1.0 / len(names)).alias(n) for n in names])


def critic_weights(scored: DataFrame, names: Sequence[str]) -> DataFrame:
    """CRITIC weights (spread times lack of correlation) from one aggregation over all column pairs."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    sums = scored.agg(*[F.stddev_samp(n).alias("d_" + n) for n in names],
                      *[F.coalesce(correlation(a, b), F.lit(0.0)).alias(f"r_{i}") for i, (a, b) in enumerate(pairs)])
    c = {}
    for n in names:
        free = [1 - F.col(f"r_{i}") for i, p in enumerate(pairs) if n in p]
        c[n] = F.col("d_" + n) * sum(free, F.lit(0.0))
    total = sum(c.values(), F.lit(0.0))
    return sums.select(*[F.when(total > 0, c[n] / total).otherwise(1.0 / len(names)).alias(n) for n in names])


def facet_weights(ref: DataFrame) -> DataFrame:
    """Rows (facet, signal, equal, entropy, critic, geometric) fitted on the reference sample."""
    out = None
    for facet, names in FACETS.items():
        cols = ["s_" + n for n in names]
        e, c = entropy_weights(ref, cols), critic_weights(ref, cols)
        both = with_row(e, c, "c_")
        blend = {n: F.sqrt(F.col(n) * F.col("c_" + n)) for n in cols}
        total = sum(blend.values(), F.lit(0.0))
        rows = both.select(F.explode(F.array(*[F.struct(
            F.lit(facet).alias("facet"), F.lit(n[2:]).alias("signal"), F.lit(1.0 / len(cols)).alias("equal"), F.col(n).alias("entropy"),
            F.col("c_" + n).alias("critic"), (blend[n] / total).alias("geometric")) for n in cols])).alias("r")).select("r.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def weighted_scores(scored: DataFrame, weights: DataFrame) -> DataFrame:
    """Facet and overall scores under each weighting; the weight table has one row per signal and travels as one row."""
    kinds = ["equal", "entropy", "critic", "geometric"]
    flat = weights.agg(*[F.max(F.when(F.col("signal") == n, F.col(k))).alias(f"w_{k}_{n}") for k in kinds for n in SIGNALS])
    wide = with_row(scored, flat)
    cols = {}
    for k in kinds:
        facets = [sum((F.col("s_" + n) * F.col(f"w_{k}_{n}") for n in names), F.lit(0.0)) for names in FACETS.values()]
        cols[f"qw_{k}"] = sum(facets, F.lit(0.0)) / len(facets)
    return wide.withColumns(cols).drop(*[f"w_{k}_{n}" for k in kinds for n in SIGNALS])


def conditional_z(scored: DataFrame, floor: float = 0.03, clip: float = 8.0) -> DataFrame:
    """Robust z of each score against language and length band, language, or all reference rows (30-row minimum)."""
    keep = ["doc_id", "dataset", "lang", "length_band", "is_ref"]
    long = long_signals(scored, ["s_" + n for n in SIGNALS], keep)
    rows = laddered_robust(long, ["signal"], [(("lang", "length_band"), 30), (("lang",), 30), ((), 0)], floor)
    z = F.greatest(F.lit(-clip), F.least(F.lit(clip), (F.col("value") - F.col("centre")) / F.col("scale")))
    return rows.select(*keep, F.expr("substr(signal, 3)").alias("signal"), z.alias("z"))


def family_of(signal: Column) -> Column:
    return F.when(signal.isin(*SEMANTIC), "a").otherwise("b")


def widest_gap(z: DataFrame, by: Sequence[str]) -> DataFrame:
    """Largest difference between a value of one family and a value of the other."""
    a, b = F.col("_f") == "a", F.col("_f") == "b"
    ends = z.withColumn("_f", family_of(F.col("signal"))).groupBy(*by).agg(
        F.max(F.when(a, F.col("z"))).alias("a1"), F.min(F.when(a, F.col("z"))).alias("a0"),
        F.max(F.when(b, F.col("z"))).alias("b1"), F.min(F.when(b, F.col("z"))).alias("b0"))
    return ends.select(*by, F.greatest(F.col("a1") - F.col("b0"), F.col("b1") - F.col("a0")).alias("max_gap"))


#: Permutations searched whole for a first bound, and the shares of places, in multiples of what lies above the quantile, that bounds leave.
PILOT, MARGINS = 4, (1.4, 4.0)


def _family() -> Column:
    return F.array(*[F.lit(n in SEMANTIC) for n in SIGNALS])


def _seeded(cells: DataFrame, way: int) -> DataFrame:
    return cells.withColumn("_seed", (F.col("_perm") * 7919 + F.col("_j") * 15485863 + 1000003 * way).cast("long"))


def shuffled_gaps(rows: DataFrame, by: Sequence[str], way: int, perms: int) -> DataFrame:
    """Widest gap at every place of every group and permutation: cells are dealt to (group, permutation, place) and combined there."""
    cells = rows.select(*by, "_r", "_n", F.posexplode("zs").alias("_j", "_z")).withColumn("_perm", F.explode(F.sequence(F.lit(0), F.lit(perms - 1))))
    sent = permuted(_seeded(cells, way), "_r", "_n", "_seed", "_place").withColumn("_a", F.get(_family(), F.col("_j")))
    own, other = F.when(F.col("_a"), F.col("_z")), F.when(~F.col("_a"), F.col("_z"))
    ends = sent.groupBy(*by, "_perm", "_place").agg(F.max(own).alias("a1"), F.min(own).alias("a0"), F.max(other).alias("b1"), F.min(other).alias("b0"))
    return ends.select(F.greatest(F.col("a1") - F.col("b0"), F.col("b1") - F.col("a0")).alias("gap"))


def leading_cells(rows: DataFrame, by: Sequence[str], least: float, ends: Mapping[str, float]) -> DataFrame:
    """Cells that are the larger end of some gap of `least` or more, if their place holds a far enough value of the other family.

    Of two values that lie `least` apart one is at least half of it away from zero; and no gap reaches beyond the other family's ends.
    """
    reach = least * (1 - 1e-12)  # a difference may be rounded up to `least`
    cells = rows.select(*by, "_r", "_n", F.posexplode("zs").alias("_j", "_z")).withColumn("_a", F.get(_family(), F.col("_j")))
    low, high = (F.when(F.col("_a"), F.lit(ends["b" + e])).otherwise(F.lit(ends["a" + e])) for e in "01")
    z = F.col("_z")
    return cells.where(((z >= reach / 2) & (z - low >= reach)) | ((z <= -reach / 2) & (high - z >= reach)))


def wide_gaps(rows: DataFrame, by: Sequence[str], way: int, perms: int, least: float, leads: DataFrame) -> DataFrame:
    """The gaps of `shuffled_gaps` that are `least` or more, from leading cells alone.

    A leading cell is sent to its places; the inverse permutation names the rows whose values of the other family stand
    there, and only these are fetched. Nothing else is moved.
    """
    by = list(by)
    sent = permuted(_seeded(leads.withColumn("_perm", F.explode(F.sequence(F.lit(0), F.lit(perms - 1)))), way), "_r", "_n", "_seed", "_place")
    others = F.filter(F.sequence(F.lit(0), F.lit(len(SIGNALS) - 1)), lambda j: F.get(_family(), j) != F.col("_a"))
    asked = sent.select(*by, "_n", "_perm", "_place", F.col("_z").alias("_lead"), F.explode(others).alias("_j"))
    asked = unpermuted(_seeded(asked, way), "_place", "_n", "_seed", "_r").select(*by, "_r", "_perm", "_place", "_lead", F.col("_j").cast("tinyint").alias("_j"))
    met = asked.join(rows.select(*by, "_r", "zs"), [*by, "_r"])
    gaps = met.withColumn("gap", F.abs(F.col("_lead") - F.get("zs", F.col("_j").cast("int")))).where(F.col("gap") >= least)
    return gaps.groupBy(*by, "_perm", "_place").agg(F.max("gap").alias("gap")).select("gap")


def null_quantile(rows: DataFrame, by: Sequence[str], way: int, perms: int, level: float) -> DataFrame:
    """Quantile of the gaps of `shuffled_gaps` as a row `v`, exact.

    A few permutations searched whole suggest a bound below the quantile; of all permutations only the gaps above it are
    found. They are counted: when they do not reach down to the quantile a lower bound is tried, in the end none.
    """
    flat = {True: F.filter("zs", lambda z, j: F.get(_family(), j)), False: F.filter("zs", lambda z, j: ~F.get(_family(), j))}
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.exists("zs", lambda z: z.isNull() | F.isnan(z))).alias("gone"),
                     *[f(g(flat[a])).alias(c + e) for a, c in ((True, "a"), (False, "b")) for e, f, g in (("0", F.min, F.array_min), ("1", F.max, F.array_max))]).first()
    n = stats["n"] * perms
    if n and not stats["gone"] and perms > PILOT:
        bounds = exact_quantiles(shuffled_gaps(rows, by, way, PILOT), [], "gap", {f"m{i}": max(0.0, 1 - m * (1 - level)) for i, m in enumerate(MARGINS)}).first()
        for least in bounds:
            if least <= 0:
                break
            leads = leading_cells(rows, by, least, stats.asDict())
            if 2 * leads.count() > stats["n"]:  # would ask for as many values as there are
                break
            found = materialise(wide_gaps(rows, by, way, perms, least, leads).groupBy("gap").agg(F.count(F.lit(1)).alias("n")))
            above = found.agg(F.sum("n")).first()[0] or 0
            if above >= n - math.floor(level * (n - 1)):
                below = rows.sparkSession.range(1).select(F.lit(-1.0).alias("gap"), F.lit(n - above).cast("long").alias("n")).where("n > 0")
                return exact_quantiles(found.unionByName(below), [], "gap", {"v": level}, weight="n")
    return exact_quantiles(shuffled_gaps(rows, by, way, perms), [], "gap", {"v": level})


def permutation_thresholds(z: DataFrame, key: str, groups: Mapping[str, Sequence[str]], perms: int, level: float) -> DataFrame:
    """Null quantile of the widest gap when every signal is shuffled inside its group, for each way of grouping.

    Rows of `z` have the key, the group columns and an array `zs` of the signals' values. Each way ranks the rows once per
    group; a keyed permutation then says where a value goes, so no shuffle of values needs a sort or a join.
    Returns (threshold_<name>...) in one row.
    """
    found = None
    for way, (name, by) in enumerate(groups.items()):
        by = list(by)
        ranked = running(z.withColumn("_one", F.lit(1).cast("long")), by, [key], {"_rank": ("sum", "_one")})
        rows = materialise_evenly(ranked.select(*by, "zs", F.col("_rank_before").cast("long").alias("_r"), F.col("_rank_total").cast("long").alias("_n")))
        one = null_quantile(rows, by, way, perms, level).withColumnRenamed("v", f"threshold_{name}")
        found = one if found is None else with_row(found, one)
    return materialise(found)


def dominant_pair(zwide: DataFrame, prefix: str = "z_") -> Column:
    """Name of the cross-family signal pair with the largest absolute difference; the first pair wins ties."""
    cells = [F.struct(F.abs(F.col(prefix + a) - F.col(prefix + b)).alias("d"), F.lit(-(i * len(MORPHOLOGY) + j)).alias("o"), F.lit(f"{a} x {b}").alias("pair"))
             for i, a in enumerate(SEMANTIC) for j, b in enumerate(MORPHOLOGY)]
    return F.array_max(F.array(*cells))["pair"]


def rank_tiles(df: DataFrame, order: Sequence[str], tiles: int, out: str) -> DataFrame:
    """ntile over a total order without gathering it in one task."""
    line = running(df.withColumn("_one", F.lit(1)), [], order, {"_r": ("sum", "_one")})
    small, extra = F.floor(F.col("_r_total") / tiles), F.col("_r_total") % tiles
    edge = extra * (small + 1)
    tile = F.when(F.col("_r") <= edge, F.ceil(F.col("_r") / (small + 1))).otherwise(
        extra + F.ceil((F.col("_r") - edge) / F.greatest(small, F.lit(1))))
    return line.select(*df.columns, tile.cast("int").alias(out))


def _few(groups: DataFrame) -> DataFrame:
    """Statistics of groups, broadcast when there are few, so that no task gathers the rows of one."""
    groups = materialise(groups)
    return F.broadcast(groups) if groups.limit(STRATA + 1).count() <= STRATA else groups


def length_residuals(df: DataFrame, group: str, y: str, x: str, out: str, least: int = 30) -> DataFrame:
    """Residual of y on x from the line of the row's group, or of all rows when the group has few."""
    line = [F.count(F.lit(1)).alias("_n"), F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a")]
    own = df.groupBy(group).agg(*line)
    wide = with_row(df.join(_few(own), group), df.agg(*line), "g")
    use = F.col("_n") >= least
    fit = F.when(use, F.col("_a")).otherwise(F.col("g_a")) + F.when(use, F.col("_b")).otherwise(F.col("g_b")) * F.col(x)
    return wide.withColumn(out, F.col(y) - fit).select(*df.columns, out)
