"""Compositions: closure, log-ratio features, ridge from moments, and replacement scenarios (M).

A composition is a row of share columns in a fixed part order. Features are plain column expressions; fits travel as
k x k moments; fitted models are small coefficient tables used as literals when scoring.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.keys import with_draws
from plumbline.operators.ranking import exact_quantiles, running, spearman
from plumbline.runtime import materialise, materialise_evenly, with_row

Model = Mapping[str, Sequence[float]]  # output -> [intercept, coefficient per part]


def closed(parts: Sequence[Column]) -> tuple[Column, list[Column]]:
    """Row sum and shares scaled to one."""
    total = sum(parts[1:], parts[0])
    return total, [p / total for p in parts]


def zero_replaced(parts: Sequence[Column], delta: float) -> list[Column]:
    """Zeros become delta; positive parts are rescaled to the rest."""
    zeros = sum(((p <= 0).cast("int") for p in parts), F.lit(0))
    mass = sum((F.when(p > 0, p).otherwise(0.0) for p in parts), F.lit(0.0))
    return [F.when(p <= 0, F.lit(delta)).otherwise(p / mass * (1 - zeros * delta)) for p in parts]


def helmert_ilr(parts: Sequence[Column]) -> list[Column]:
    """Isometric log-ratio coordinates: coordinate i contrasts the first i parts with part i + 1."""
    logs = [F.ln(p) for p in parts]
    out = []
    for i in range(1, len(logs)):
        head = sum(logs[1:i], logs[0])
        out.append((head - i * logs[i]) / math.sqrt(i * (i + 1)))
    return out


def quadratic(features: Sequence[Column]) -> list[Column]:
    return [*features, *[features[i] * features[j] for i in range(len(features)) for j in range(i, len(features))]]


def standardised(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns minus mean over population deviation."""
    stats = df.agg(*[F.avg(n).alias("m_" + n) for n in names], *[F.stddev_pop(n).alias("d_" + n) for n in names])
    wide = with_row(df, stats)
    scaled = {n: (F.col(n) - F.col("m_" + n)) / F.when(F.col("d_" + n) > 0, F.col("d_" + n)).otherwise(1.0) for n in names}
    return wide.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


def moments(df: DataFrame, names: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, means and population covariance of columns from one aggregation."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = df.agg(F.count(F.lit(1)), *[F.avg(n) for n in names], *[F.covar_pop(names[i], names[j]) for i, j in pairs]).first()
    k = len(names)
    cov = np.zeros((k, k))
    for (i, j), v in zip(pairs, row[1 + k:]):
        cov[i, j] = cov[j, i] = v
    return row[0], np.array(row[1:1 + k], float), cov


def solve_ridge(mean: np.ndarray, cov: np.ndarray, p: int, alpha: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Intercepts and raw-scale coefficients of standardised ridge for columns [x_1..x_p, y...]."""
    d = np.sqrt(np.clip(np.diag(cov), 0, None))
    d[d <= 1e-12] = 1.0
    r = cov / np.outer(d, d)
    beta = np.linalg.solve(r[:p, :p] + alpha / n * np.eye(p), r[:p, p:])
    coef = beta * d[p:] / d[:p, None]
    return mean[p:] - mean[:p] @ coef, coef


def fit_ridge(df: DataFrame, xs: Sequence[str], ys: Sequence[str], alpha: float) -> DataFrame:
    """Coefficient rows (output, feature, coefficient) of a multi-output ridge."""
    n, mean, cov = moments(df, [*xs, *ys])
    icept, coef = solve_ridge(mean, cov, len(xs), alpha, n)
    rows = [(y, "intercept", float(icept[h])) for h, y in enumerate(ys)]
    rows += [(y, x, float(coef[j, h])) for h, y in enumerate(ys) for j, x in enumerate(xs)]
    return df.sparkSession.createDataFrame(rows, "output string, feature string, coefficient double")


def cross_validate(df: DataFrame, parts: Sequence[str], ys: Sequence[str], fold: str, deltas: Sequence[float],
                   alphas: Sequence[float], degree: int = 1) -> DataFrame:
    """Grid of (delta, alpha) with pooled out-of-fold error, from one aggregation of fold sums.

    Training moments are totals minus the fold; the held-out squared error of a linear model also follows from fold
    sums, so no further pass is needed. The winner's rank correlation takes one scoring pass.
    """
    spark, names = df.sparkSession, list(ys)
    wide = df.withColumn("_delta", F.explode(F.array(*[F.lit(float(d)) for d in deltas])))
    cols = [F.when(F.col(p) <= 0, F.col("_delta")) for p in parts]
    zeros = sum(((F.col(p) <= 0).cast("int") for p in parts), F.lit(0))
    mass = sum((F.when(F.col(p) > 0, F.col(p)).otherwise(0.0) for p in parts), F.lit(0.0))
    filled = [F.coalesce(c, F.col(p) / mass * (1 - zeros * F.col("_delta"))) for c, p in zip(cols, parts)]
    ilr = helmert_ilr(filled)
    feats = quadratic(ilr) if degree == 2 else ilr
    p, k = len(feats), len(feats) + len(names)
    rows = materialise(wide.select(fold, "_delta", *[f.alias(f"x{i}") for i, f in enumerate(feats)], *names))
    allc = [*[f"x{i}" for i in range(p)], *names]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = rows.groupBy("_delta", fold).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(c) for c in allc]).alias("s"),
                                           F.array(*[F.sum(F.col(allc[i]) * F.col(allc[j])) for i, j in pairs]).alias("q")).collect()
    sums = {}
    for g in got:
        q = np.zeros((k, k))
        for (i, j), v in zip(pairs, g["q"]):
            q[i, j] = q[j, i] = v
        sums[g["_delta"], g[fold]] = (g["n"], np.array(g["s"]), q)
    folds = sorted({f for _, f in sums})
    grid, models = [], {}
    for d in map(float, deltas):
        n_all = sum(sums[d, f][0] for f in folds)
        s_all, q_all = sum(sums[d, f][1] for f in folds), sum(sums[d, f][2] for f in folds)
        for a in map(float, alphas):
            sse = 0.0
            for f in folds:
                n, s, q = sums[d, f]
                m, mean = n_all - n, (s_all - s) / (n_all - n)
                icept, coef = solve_ridge(mean, (q_all - q) / m - np.outer(mean, mean), p, a, m)
                models[d, a, f] = (icept, coef)
                for h in range(len(names)):
                    b = np.concatenate([[icept[h]], coef[:, h]])
                    full = np.block([[np.array([[n]]), s[None, :p]], [s[:p, None], q[:p, :p]]])
                    cross = np.concatenate([[s[p + h]], q[:p, p + h]])
                    sse += q[p + h, p + h] - 2 * b @ cross + b @ full @ b
            grid.append((degree, d, a, float(np.sqrt(max(sse, 0.0) / (n_all * len(names))))))
    best = min(grid, key=lambda g: (g[3], g[1], g[2]))
    chosen = rows.where(F.col("_delta") == best[1])
    cells = []
    for h, y in enumerate(names):
        pred = F.lit(None).cast("double")
        for f in folds:
            icept, coef = models[best[1], best[2], f]
            line = F.lit(float(icept[h]))
            for i in range(p):
                line = line + float(coef[i, h]) * F.col(f"x{i}")
            pred = F.when(F.col(fold) == f, line).otherwise(pred)
        cells.append(F.struct(F.lit(y).alias("output"), F.col(y).cast("double").alias("y"), pred.alias("pred")))
    long = chosen.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    rho = spearman(long, ["output"], "y", "pred").agg(F.expr("percentile(spearman, 0.5)")).first()[0]
    table = [(*g, rho if g == best else None, g == best) for g in grid]
    return spark.createDataFrame(table, "degree int, delta double, alpha double, cv_rmse double, cv_spearman_median double, selected boolean")


def log_score(model: Model, output: str, parts: Sequence[Column], delta: float) -> Column:
    b = model[output]
    out = F.lit(float(b[0]))
    for c, p in zip(b[1:], parts):
        out = out + float(c) * F.ln(p + delta)
    return out


def raised(p: Column, j: Column, eps: float) -> Column:
    """Share array with part j plus eps and every other part reduced in proportion."""
    shrink = (1 - F.get(p, j) - eps) / F.greatest(1 - F.get(p, j), F.lit(1e-12))
    return F.transform(p, lambda x, i: F.when(i == j, x + eps).otherwise(x * shrink))


def raised_pair(p: Column, j: Column, k: Column, eps: float) -> Column:
    rest = 1 - F.get(p, j) - F.get(p, k)
    shrink = (rest - eps) / F.greatest(rest, F.lit(1e-12))
    return F.transform(p, lambda x, i: F.when((i == j) | (i == k), x + eps / 2).otherwise(x * shrink))


def moved(p: Column, j: Column, donor: int, eps: float) -> Column:
    return F.transform(p, lambda x, i: F.when(i == j, x + eps).when(i == donor, x - eps).otherwise(x))


def _contrasts(df: DataFrame, names: Sequence[str], model: Model, delta: float, cases: Sequence[tuple[int, ...]], feasible, terms,
               keep: Sequence[str] = ()) -> DataFrame:
    """Effect of a signed sum of share arrays per case and output.

    The score is linear in log shares and the signs sum to zero, so the log arrays are combined once per case and
    each output is one dot product; expressions stay small for any number of parts and outputs.
    """
    p, c = F.col("_p"), [F.col("_c")[f"i{n}"] for n in range(len(cases[0]))]
    listed = F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"i{n}") for n, v in enumerate(case)]) for case in cases]))
    rows = df.select(*keep, F.array(*names).alias("_p"), listed.alias("_c")).where(feasible(p, *c))
    logs = rows.select(*keep, "_p", "_c", *[F.transform(fn(p, *c), lambda x: F.ln(x + delta)).alias(f"_l{n}") for n, (_, fn) in enumerate(terms)])
    total = F.transform("_l0", lambda x: x * terms[0][0])
    for n, (sign, _) in list(enumerate(terms))[1:]:
        total = F.zip_with(total, F.transform(f"_l{n}", _scaled(sign)), lambda a, x: a + x)
    scored = logs.select(*keep, "_p", "_c", total.alias("_x"))
    outputs = F.explode(F.array(*[F.struct(F.lit(o).alias("output"), F.array(*[F.lit(float(v)) for v in b[1:]]).alias("b")) for o, b in model.items()]))
    wide = scored.select(*keep, "_p", "_c", "_x", outputs.alias("_m"))
    effect = F.aggregate(F.zip_with(F.col("_m.b"), "_x", lambda b, x: b * x), F.lit(0.0), lambda a, x: a + x)
    label = F.array(*[F.lit(n) for n in names])
    tags = [F.get(label, F.col("_c")[f"i{n}"]).alias(t) for n, t in enumerate(["part"] if len(cases[0]) == 1 else ["part_a", "part_b"])]
    return wide.select(*keep, *tags, F.get("_p", F.col("_c.i0")).alias("share"), F.col("_m.output").alias("output"), effect.alias("effect"))


def _scaled(sign: float):
    return lambda x: x * sign


def replacement_effects(df: DataFrame, names: Sequence[str], model: Model, delta: float, eps: float, keep: Sequence[str] = ()) -> DataFrame:
    """Change of each output when one part grows by eps at the cost of all others."""
    terms = [(1.0, lambda p, j: raised(p, j, eps)), (-1.0, lambda p, j: p)]
    return _contrasts(df, names, model, delta, [(j,) for j in range(len(names))], lambda p, j: F.get(p, j) <= 1 - eps, terms, keep)


def effect_summary(rows: DataFrame, by: Sequence[str], probs: Mapping[str, float], least: int = 1) -> DataFrame:
    by = list(by)
    base = rows.groupBy(*by).agg(F.avg("effect").alias("mean_effect"), F.count(F.lit(1)).alias("recipes")).where(F.col("recipes") >= least)
    return base.join(exact_quantiles(rows, by, "effect", probs), by)


def effect_intervals(rows: DataFrame, key: str, cases: Sequence[tuple[str, str]], reps: int) -> DataFrame:
    """Bootstrap interval of the mean effect over recipes for known (part, output) cases.

    Effects of a recipe travel side by side, so each draw is hashed once per recipe and replicates combine map-side.
    """
    cell = lambda p, o: F.max(F.when((F.col("part") == p) & (F.col("output") == o), F.col("effect")))
    wide = materialise_evenly(rows.groupBy(key).agg(*[cell(p, o).alias(f"_e{i}") for i, (p, o) in enumerate(cases)]))
    w = F.col("w")
    means = with_draws(wide, F.col(key), reps).groupBy("rep").agg(*[
        (F.sum(w * F.col(f"_e{i}")) / F.sum(F.when(F.col(f"_e{i}").isNotNull(), w))).alias(f"_m{i}") for i in range(len(cases))])
    ends = means.agg(*[F.expr(f"percentile(_m{i}, array(0.025, 0.975))").alias(f"_c{i}") for i in range(len(cases))])
    return ends.select(F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.lit(o).alias("output"), F.get(f"_c{i}", F.lit(0)).alias("ci_low"), F.get(f"_c{i}", F.lit(1)).alias("ci_high"))
                                           for i, (p, o) in enumerate(cases)])).alias("c")).select("c.*")


def share_terciles(rows: DataFrame) -> DataFrame:
    """Band of the initial share per (part, output): number of distinct tercile cuts strictly below it."""
    cuts = exact_quantiles(rows, ["part", "output"], "share", {"t1": 1 / 3, "t2": 2 / 3})
    below = F.array_distinct(F.array("t1", "t2"))
    return rows.join(cuts, ["part", "output"]).withColumn("band", F.size(F.filter(below, lambda c: c < F.col("share"))))


def donor_effects(df: DataFrame, names: Sequence[str], donor: int, model: Model, delta: float, eps: float) -> DataFrame:
    """Change of each output when one part takes eps from a single donor part."""
    terms = [(1.0, lambda p, j: moved(p, j, donor, eps)), (-1.0, lambda p, j: p)]
    return _contrasts(df, names, model, delta, [(j,) for j in range(len(names)) if j != donor],
                      lambda p, j: (F.get(p, F.lit(donor)) >= eps) & (F.get(p, j) <= 1 - eps), terms)


def pair_interactions(df: DataFrame, names: Sequence[str], model: Model, delta: float, eps: float) -> DataFrame:
    """f(j and k) - f(j) - f(k) + f for every pair of parts."""
    terms = [(1.0, lambda p, j, k: raised_pair(p, j, k, eps)), (-1.0, lambda p, j, k: raised(p, j, eps / 2)),
             (-1.0, lambda p, j, k: raised(p, k, eps / 2)), (1.0, lambda p, j, k: p)]
    pairs = [(j, k) for j in range(len(names)) for k in range(j + 1, len(names))]
    return _contrasts(df, names, model, delta, pairs, lambda p, j, k: F.get(p, j) + F.get(p, k) <= 1 - eps, terms)


def relative_index(df: DataFrame, outputs: Sequence[str], is_ref: str) -> DataFrame:
    """Add `r_index` (larger = lower predicted outputs) and its descending minimum rank; values that agree to nine decimals tie."""
    ref = df.where(is_ref)
    wide = with_row(df, ref.agg(*[F.avg(o).alias("m_" + o) for o in outputs], *[F.stddev_samp(o).alias("d_" + o) for o in outputs]))
    z = sum(((F.col(o) - F.col("m_" + o)) / F.when(F.col("d_" + o) > 1e-12, F.col("d_" + o)).otherwise(1.0) for o in outputs), F.lit(0.0)) / len(outputs)
    raw = materialise(wide.withColumn("_raw", z).select(*df.columns, "_raw"))
    scaled = with_row(raw, raw.where(is_ref).agg(F.avg("_raw").alias("_c"), F.stddev_samp("_raw").alias("_s")))
    out = materialise(scaled.withColumn("r_index", -(F.col("_raw") - F.col("_c")) / F.col("_s")).select(*df.columns, "r_index"))
    # What rounding leaves of equal indices is no difference in rank.
    out = out.withColumn("_level", F.round("r_index", 9))
    line = running(out.groupBy("_level").agg(F.count(F.lit(1)).alias("_n")), [], ["-_level"], {"_above": ("sum", "_n")})
    return out.join(line.select("_level", (F.col("_above_before") + 1).alias("rank")), "_level").drop("_level")
