"""Regression and inference on grouped data (I). Fits read k x k sums; only those reach the driver."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.ranking import average_ranks, exact_quantiles, running, spearman
from plumbline.runtime import materialise, with_row, written

# Rational approximation of the normal tail (Abramowitz and Stegun 26.2.17).
TAIL = (0.2316419, 0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
#: Up to so many strata their coefficients are sent to every task; beyond, rows and strata are joined.
FEW_STRATA = 5000


def normal_two_sided(z: Column) -> Column:
    """Two-sided normal p-value of a z statistic."""
    a = F.abs(z)
    t = 1 / (1 + TAIL[0] * a)
    poly = t * (TAIL[1] + t * (TAIL[2] + t * (TAIL[3] + t * (TAIL[4] + t * TAIL[5]))))
    return F.least(F.lit(1.0), 2 * 0.3989422804014327 * F.exp(-a * a / 2) * poly)


def quantile_fits(df: DataFrame, by: str, xs: Sequence[str], y: str, weight: str, q: float, tolerance: float = 1e-4, passes: int = 40) -> DataFrame:
    """Weighted linear quantile regression per stratum by Newton steps on a smoothed check loss.

    The kink is rounded inside a band that halves with every accepted step down to a small share of the spread; a step
    that raises the true loss is shortened. A stratum is finished when its next step would move its coefficients by less than
    `tolerance`, relative to the largest. A pass is one aggregation per stratum over the written feature frame; coefficients,
    steps and bands stay in a table with one row per stratum. Returns (by, term, coefficient, pinball, change, converged).
    """
    k = len(xs) + 1
    rows = materialise(df.select(F.col(by).cast("string").alias(by), F.lit(1.0).alias("_x0"), *[F.col(c).cast("double").alias(f"_x{i + 1}") for i, c in enumerate(xs)],
                                 F.col(y).cast("double").alias("_y"), F.col(weight).cast("double").alias("_w")))
    x, yy, w = [F.col(f"_x{i}") for i in range(k)], F.col("_y"), F.col("_w")

    def sums(frame: DataFrame, cell: Column, right: Column, extra: Column) -> DataFrame:
        square = [F.sum(cell * x[min(i, j)] * x[max(i, j)]) for i in range(k) for j in range(k)]
        return frame.groupBy(by).agg(F.array(*square).alias("_m"), F.array(*[F.sum(right * x[i]) for i in range(k)]).alias("_v"), F.sum(w * extra).alias("_e"), F.sum(w).alias("_t"))

    def size(a: Column) -> Column:
        return F.array_max(F.transform(a, F.abs))

    first = sums(rows, w, w * yy, yy * yy).withColumn("_b", _solve("_m", "_v"))
    fitted = F.aggregate(F.zip_with("_b", "_v", lambda i, j: i * j), F.lit(0.0), lambda a, c: a + c)
    band = 1.5 * F.sqrt(F.greatest(F.col("_e") - fitted, F.lit(1e-12)) / F.col("_t"))
    state = written(first.select(by, "_b", F.array_repeat(F.lit(0.0), k).alias("_s"), F.lit(float("inf")).alias("_l"), band.alias("_g"), (band / 256).alias("_f"),
                                     F.lit(1.0).alias("change"), F.lit(False).alias("converged")))
    few = state.count() <= FEW_STRATA
    line = sum((x[i] * F.col("_at")[i] for i in range(1, k)), x[0] * F.col("_at")[0])
    r, g = yy - line, F.col("_g")
    bend = 0.5 * w * F.when(F.abs(r) <= g, 1 / g).otherwise(0.02 / F.greatest(F.abs(r), F.lit(1e-12)))
    slope = w * (q - 0.5 + 0.5 * F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r / g)))
    for _ in range(passes):
        todo = state.where("not converged").withColumn("_at", F.zip_with("_b", "_s", lambda i, j: i + j))
        trial = todo.select(by, "_at", "_g")
        found = sums(rows.join(F.broadcast(trial) if few else trial, by), bend, slope, F.greatest(q * r, (q - 1) * r)).withColumn("_n", _solve("_m", "_v"))
        both = todo.join(found, by)
        better = F.col("_e") / F.col("_t") <= F.col("_l")
        at, step = F.when(better, F.col("_at")).otherwise(F.col("_b")), F.when(better, F.col("_n")).otherwise(F.transform("_s", lambda i: i * 0.3))
        moved = both.select(
            by, at.alias("_b"), step.alias("_s"), F.when(better, F.col("_e") / F.col("_t")).otherwise(F.col("_l")).alias("_l"), "_g", "_f", better.alias("_better"),
            (size(step) / (1e-9 + size(at))).alias("change"))
        still = F.col("change") < tolerance  # within this band nothing is left to gain
        moved = moved.select(
            by, "_b", F.when(still & (g > F.col("_f")), F.array_repeat(F.lit(0.0), k)).otherwise(F.col("_s")).alias("_s"), "_l",
            F.when(F.col("_better") | still, F.greatest(g * 0.5, "_f")).otherwise(g).alias("_g"), "_f", "change", (still & (g <= F.col("_f"))).alias("converged"))
        state = written(state.where("converged").unionByName(moved))
        if state.where("not converged").isEmpty():
            break
    terms = F.explode(F.array(*[F.struct(F.lit(n).alias("term"), F.col("_b")[i].alias("coefficient")) for i, n in enumerate(["intercept", *xs])]))
    return state.select(by, F.col("_l").alias("pinball"), "change", "converged", terms.alias("t")).select(by, "t.term", "t.coefficient", "pinball", "change", "converged")


def predict_from_terms(df: DataFrame, terms: DataFrame, by: str, xs: Sequence[str], out: str) -> DataFrame:
    """Attach predictions of the stratum's coefficients."""
    wide = terms.groupBy(by).agg(*[F.max(F.when(F.col("term") == n, F.col("coefficient"))).alias("_c_" + n) for n in ["intercept", *xs]])
    line = sum((F.col(x) * F.col("_c_" + x) for x in xs), F.col("_c_intercept"))
    return df.withColumn(by, F.col(by).cast("string")).join(wide, by).withColumn(out, line).select(*df.columns, out)


def rolling_windows(df: DataFrame, time: str, cutoffs: Sequence[str], horizon: int) -> tuple[DataFrame, DataFrame]:
    """(train, test) rows per cutoff: train strictly before, test from the cutoff to its horizon."""
    dates = F.array(*[F.lit(c).cast("date") for c in cutoffs])
    day = F.to_date(time)
    train = df.withColumn("cutoff", F.explode(F.filter(dates, lambda c: day < c)))
    test = df.withColumn("cutoff", F.explode(F.filter(dates, lambda c: (day >= c) & (day <= F.date_add(c, horizon)))))
    return train, test


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solve(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for m, v in zip(a, b):
        k = len(v)
        out.append(np.linalg.lstsq(np.asarray(m, float).reshape(k, k), np.asarray(v, float), rcond=None)[0])
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _sandwich(a: pd.Series, meat: pd.Series, scale: pd.Series) -> pd.Series:
    out = []
    for m, c, s in zip(a, meat, scale):
        k = int(round(len(m) ** 0.5))
        bread = np.linalg.pinv(np.asarray(m, float).reshape(k, k))
        out.append(np.sqrt(np.clip(np.diag(bread @ np.asarray(c, float).reshape(k, k) @ bread) * s, 0, None)))
    return pd.Series(out)


def cluster_ols(df: DataFrame, by: str, xs: Sequence[str], y: str, cluster: str) -> DataFrame:
    """OLS per group with cluster-robust errors.

    Rows are read once into sums per (group, cluster). Coefficients come from group totals; the score of a cluster is
    X'y - X'X b, so the error sandwich also needs only cluster sums. The small solves run on one row per group.
    """
    names, k = ["intercept", *xs], len(xs) + 1
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in xs]]
    yy = F.col(y).cast("double")
    cells = df.groupBy(by, cluster).agg(F.count(F.lit(1)).alias("n"), *[F.sum(x[i] * x[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)],
                                        *[F.sum(x[i] * yy).alias(f"b{i}") for i in range(k)], F.sum(yy).alias("sy"), F.sum(yy * yy).alias("syy"))
    cells = materialise(cells)
    a = lambda i, j: f"a{min(i, j)}_{max(i, j)}"
    totals = cells.groupBy(by).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("clusters"), F.sum("sy").alias("sy"), F.sum("syy").alias("syy"),
                                   F.array(*[F.sum(a(i, j)) for i in range(k) for j in range(k)]).alias("m"), F.array(*[F.sum(f"b{i}") for i in range(k)]).alias("v"))
    fitted = totals.withColumn("beta", _solve("m", "v"))
    scores = cells.join(fitted.select(by, "beta"), by)
    u = [F.col(f"b{i}") - sum((F.col(a(i, j)) * F.get("beta", F.lit(j)) for j in range(k)), F.lit(0.0)) for i in range(k)]
    meat = scores.select(by, *[u[i].alias(f"u{i}") for i in range(k)]).groupBy(by).agg(
        F.array(*[F.sum(F.col(f"u{i}") * F.col(f"u{j}")) for i in range(k) for j in range(k)]).alias("meat"))
    g, n = F.col("clusters"), F.col("n")
    out = fitted.join(meat, by).withColumn("se", _sandwich("m", "meat", g / (g - 1) * (n - 1) / (n - k)))
    dot = F.aggregate(F.zip_with("beta", "v", lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    out = out.withColumn("r2", 1 - (F.col("syy") - dot) / (F.col("syy") - F.col("sy") * F.col("sy") / n))
    rows = out.select(by, "n", "clusters", "r2", F.explode(F.arrays_zip(F.array(*[F.lit(v) for v in names]).alias("term"), F.col("beta").alias("b"), F.col("se").alias("s"))).alias("t"))
    est, se = F.col("t.b"), F.col("t.s")
    return rows.select(by, F.col("t.term").alias("term"), est.alias("effect"), se.alias("std_error"), (est - 1.959963984540054 * se).alias("ci_low"),
                       (est + 1.959963984540054 * se).alias("ci_high"), normal_two_sided(est / F.when(se > 0, se)).alias("p_value"), "n", "clusters", "r2")


def benjamini_hochberg(df: DataFrame, scope: Sequence[str], key: str, p: str) -> DataFrame:
    """q-values per scope: least of p * m / rank over this and larger p, held at one."""
    ranked = running(df.withColumn("_one", F.lit(1)), scope, [p, key], {"_rank": ("sum", "_one")})
    raw = ranked.withColumn("_q", F.col(p) * F.col("_rank_total") / F.col("_rank")).drop("_one", "_rank_before", "_rank_total")
    line = running(raw, scope, ["-_rank"], {"q_value": ("min", "_q")})
    return line.withColumn("q_value", F.least(F.lit(1.0), F.col("q_value"))).select(*df.columns, "q_value")


def effect_families(df: DataFrame, by: Sequence[str], effect: str, q: str, level: float = 0.05) -> DataFrame:
    positive = F.col(effect) > 0
    base = df.groupBy(*by).agg(F.count(F.lit(1)).alias("tasks"), F.avg(positive.cast("double")).alias("positive_share"),
                               F.avg((positive & (F.col(q) < level)).cast("double")).alias("significant_share"))
    return base.join(exact_quantiles(df, by, effect, {"median_effect": 0.5}), list(by))


def theil_sen(points: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Median pairwise slope per group of calendar-sized point sets (one point per period)."""
    packed = points.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("_p"))
    slopes = F.flatten(F.transform("_p", lambda a: F.transform(
        F.filter("_p", lambda b: b["x"] > a["x"]), lambda b: (b["y"] - a["y"]) / (b["x"] - a["x"]))))
    flat = packed.select(*by, F.size("_p").alias("points"), F.explode(slopes).alias("s"))
    return flat.groupBy(*by, "points").agg(F.expr("percentile(s, 0.5)").alias("slope"))


def leave_one_out(df: DataFrame, x: str, y: str) -> DataFrame:
    """Leave-one-out predictions of the mean and of the line, from totals minus the own row."""
    sums = df.agg(F.count(F.lit(1)).alias("_n"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"), (F.var_pop(x) * F.count(F.lit(1))).alias("_sxx"), F.regr_slope(y, x).alias("_b"))
    n, dx, yy = F.col("_n"), F.col(x) - F.col("_mx"), F.col(y)
    wide = with_row(df, sums)
    e = yy - F.col("_my") - F.col("_b") * dx
    h = 1 / n + dx * dx / F.col("_sxx")
    return wide.select(*df.columns, ((n * F.col("_my") - yy) / (n - 1)).alias("constant"), (yy - e / (1 - h)).alias("linear"))


def bridge_decision(loo: DataFrame, y: str) -> DataFrame:
    """Accept the line when it beats the mean by 5 % and ranks the same way."""
    loo = materialise(loo)
    rmse = lambda p: F.sqrt(F.avg((F.col(y) - F.col(p)) ** 2))
    m = loo.agg(rmse("constant").alias("constant_rmse"), rmse("linear").alias("linear_rmse"), F.count(F.lit(1)).alias("n"))
    both = with_row(m, spearman(loo, [], y, "linear").select("spearman"))
    gain = (F.col("constant_rmse") - F.col("linear_rmse")) / F.col("constant_rmse")
    return both.withColumn("improvement", gain).withColumn("accepted", (gain >= 0.05) & (F.col("spearman") > 0))


def agreement(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cohen kappa (plain, quadratic), exact and within-one agreement from weighted (a, b, n) cells."""
    by, n = list(by), F.col("n").cast("double")
    size = cells.groupBy(*by).agg(F.sum(n).alias("N"), F.sum(F.when(F.col("a") == F.col("b"), n).otherwise(0.0)).alias("same"),
                                  F.sum(F.when(F.abs(F.col("a") - F.col("b")) <= 1, n).otherwise(0.0)).alias("near"), F.sum(n * (F.col("a") - F.col("b")) ** 2).alias("gap2"),
                                  F.sum(n * F.col("a")).alias("sa"), F.sum(n * F.col("b")).alias("sb"), F.sum(n * F.col("a") ** 2).alias("saa"), F.sum(n * F.col("b") ** 2).alias("sbb"))
    left = cells.groupBy(*by, F.col("a").alias("v")).agg(F.sum(n).alias("na"))
    right = cells.groupBy(*by, F.col("b").alias("v")).agg(F.sum(n).alias("nb"))
    chance = left.join(right, [*by, "v"]).groupBy(*by).agg(F.sum(F.col("na") * F.col("nb")).alias("pe"))
    out = size.join(chance, by, "left") if by else with_row(size, chance)
    N = F.col("N")
    po, pe = F.col("same") / N, F.coalesce(F.col("pe"), F.lit(0.0)) / (N * N)
    # expected squared gap under independence: E a^2 + E b^2 - 2 E a E b
    expected = F.col("saa") / N + F.col("sbb") / N - 2 * F.col("sa") * F.col("sb") / (N * N)
    return out.select(*by, N.cast("long").alias("n"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"),
                      F.when(expected > 0, 1 - F.col("gap2") / N / expected).alias("kappa_quadratic"), po.alias("exact"), (F.col("near") / N).alias("within_one"))


def ranked_auc(df: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """AUC per group by rank sums, with the number of (positive, negative) pairs; no pair is ever formed."""
    by = list(by)
    ranks = average_ranks(df, by, score, "_r").select(*by, score, "_r")
    pos = F.col(label).cast("int") == 1
    s = df.join(ranks, [*by, score]).groupBy(*by).agg(F.count_if(pos).alias("positives"), F.count_if(~pos).alias("negatives"), F.sum(F.when(pos, F.col("_r"))).alias("_s"))
    pairs = F.col("positives") * F.col("negatives")
    return s.select(*by, "positives", "negatives", pairs.alias("pairs"),
                    F.when(pairs > 0, (F.col("_s") - F.col("positives") * (F.col("positives") + 1) / 2) / pairs).alias("auc"))
