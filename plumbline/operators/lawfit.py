"""Many law fits at once: damped Gauss-Newton over design points, and the budget plans of every fitted law.

A fit is one row of a small state table (parameters, step, cost). A pass evaluates every fit at its trial
parameters on the design points it weighs and brings back one row of sums per fit: one shuffle of (fits x tasks) rows whatever
the size of the data. Fits are bootstrap replicates or training folds; they travel to the points as one bounded array.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import laws
from plumbline.operators.fitting import SUMS, best_law, closed_form
from plumbline.runtime import explode_numbers, materialise_evenly, with_row, written

#: Exponents of the start grid, over all that are plausible.
STARTS = (0.05, 0.15, 0.3, 0.5, 0.8, 1.2)
LOW, HIGH = 0.01, 3.0
#: Longest step of an exponent.
LONGEST = 0.3
NAMES = ("E", "A", "alpha", "B", "beta")
_K = 5


def law_points(trials: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct (size, tokens) points with count, sum and square sum of the loss."""
    y = F.col("y")
    return trials.groupBy(*by, "n", "d").agg(F.count(F.lit(1)).cast("double").alias("w"), F.sum(y).alias("wy"), F.sum(y * y).alias("wyy"))


def start_laws(points: DataFrame, fits: int) -> DataFrame:
    """Per fit the best pair of start exponents with its linear parameters; fits without any positive solution are missing."""
    rows = points.select("share", "n", "d", "w", "wy", "wyy", explode_numbers(STARTS).alias("alpha")).select("*", explode_numbers(STARTS).alias("beta"))
    rows = rows.withColumn("u", F.pow("n", -F.col("alpha"))).withColumn("v", F.pow("d", -F.col("beta")))
    w, u, v, wy = (F.col(c) for c in ("w", "u", "v", "wy"))
    terms = [w, w * u, w * v, wy, w * u * u, w * v * v, w * u * v, wy * u, wy * v, F.col("wyy")]
    # Shares are the same for many points (those of one resampled group): sums per share first, then per fit.
    per = rows.groupBy("share", "alpha", "beta").agg(*[F.sum(c).alias(n) for n, c in zip(SUMS, terms)])
    drawn = per.select("*", F.posexplode("share").alias("fit", "x")).where("x > 0")
    return best_law(closed_form(drawn.groupBy("fit", "alpha", "beta").agg(*[F.sum(F.col("x") * F.col(n)).alias(n) for n in SUMS])), ["fit"])


def _sums(points: DataFrame, trial: DataFrame) -> DataFrame:
    """Per fit at its trial exponents: normal matrix of (1, u, v, u ln n, v ln d), their products with what the trial law leaves, and its square."""
    packed = trial.agg(F.collect_list(F.struct("fit", F.col("_at").alias("p"))).alias("fits"))
    rows = with_row(points, packed).select("n", "d", "w", "wy", "wyy", "share", F.explode("fits").alias("f"))
    rows = rows.select("n", "d", "w", "wy", "wyy", F.col("f.fit").alias("fit"), F.get("share", F.col("f.fit")).alias("x"), *[F.col("f.p")[i].alias(n) for i, n in enumerate(NAMES)]).where("x > 0")
    rows = rows.withColumn("u", F.pow("n", -F.col("alpha"))).withColumn("v", F.pow("d", -F.col("beta")))
    rows = rows.withColumn("p", F.expr("E + A * u + B * v")).withColumn("lu", F.col("u") * F.ln("n")).withColumn("lv", F.col("v") * F.ln("d"))
    j = [F.lit(1.0), F.col("u"), F.col("v"), F.col("lu"), F.col("lv")]
    w, gap = F.col("x") * F.col("w"), F.col("x") * (F.col("wy") - F.col("w") * F.col("p"))
    cost = F.col("x") * (F.col("wyy") - 2 * F.col("p") * F.col("wy") + F.col("w") * F.col("p") * F.col("p"))
    upper = {(a, b): F.sum(w * j[a] * j[b]).alias(f"m{a}{b}") for a in range(_K) for b in range(a, _K)}
    out = rows.groupBy("fit").agg(*upper.values(), *[F.sum(gap * j[a]).alias(f"g{a}") for a in range(_K)], F.sum(cost).alias("_e"))
    square = F.array(*[F.col(f"m{min(a, b)}{max(a, b)}") for a in range(_K) for b in range(_K)])
    return out.select("fit", "_e", square.alias("_m"), F.array(*[F.col(f"g{a}") for a in range(_K)]).alias("_v"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _projected(m: pd.Series, v: pd.Series, e: pd.Series, at: pd.Series) -> pd.Series:
    """E, A, alpha, B, beta with the linear parameters solved for the exponents, the cost there, and the next step of both exponents."""
    out = []
    for square, right, cost, p in zip(m, v, e, at):
        square, right = np.asarray(square, float).reshape(_K, _K), np.asarray(right, float)
        scale = 1 / np.sqrt(np.maximum(np.diag(square), 1e-300))
        even = square * scale[:, None] * scale
        linear = scale[:3] * np.linalg.lstsq(even[:3, :3], right[:3] * scale[:3], rcond=1e-14)[0]
        whole = scale * np.linalg.lstsq(even, right * scale, rcond=1e-14)[0]
        level, size, data = p[0] + linear[0], p[1] + linear[1], p[3] + linear[2]
        step = np.clip([-whole[3] / size, -whole[4] / data], -LONGEST, LONGEST) if size and data else np.full(2, np.nan)
        out.append([level, size, p[2], data, p[4], cost - float(linear @ right[:3]), *step])
    return pd.Series(out)


def fit_laws(points: DataFrame, fits: int, tolerance: float = 1e-10, passes: int = 40) -> DataFrame:
    """Least-squares E + A n^-alpha + B d^-beta for every fit, by variable projection.

    `points` has n, d, w, wy, wyy and `share`, an array with the weight of the point in each of the fits. The linear parameters
    are solved at every trial, so steps follow the valley in which they trade against the exponents; a step of the exponents that
    raises the cost is damped to a third. Returns fit, the parameters, cost, passes and `success`: false where steps did not become
    small or a parameter left its range (exponents LOW to HIGH, the others above zero); fits without a start have no parameters.
    """
    points = materialise_evenly(points.select("n", "d", "w", "wy", "wyy", "share"))
    state = written(start_laws(points, fits).select("fit", F.array(*NAMES).alias("_b"), F.array(F.lit(0.0), F.lit(0.0)).alias("_s"), F.lit(float("inf")).alias("_l"), F.lit(0).alias("passes"), F.lit(False).alias("done")), "fits")
    for turn in range(passes):
        b, s = F.col("_b"), F.col("_s")
        todo = state.where("not done").withColumn("_at", F.array(b[0], b[1], b[2] + s[0], b[3], b[4] + s[1]))
        both = todo.join(_sums(points, todo.select("fit", "_at")), "fit").withColumn("_t", _projected("_m", "_v", "_e", "_at"))
        t = F.col("_t")
        # Close to the optimum costs are equal up to rounding, and the step still gets better.
        better = F.coalesce(t[5] <= F.col("_l") * (1 + 1e-9), F.lit(False))
        step = F.when(better, F.slice("_t", 7, 2)).otherwise(F.transform("_s", lambda c: c / 3))
        moved = both.select("fit", F.when(better, F.slice("_t", 1, _K)).otherwise(b).alias("_b"), step.alias("_s"), F.when(better, t[5]).otherwise(F.col("_l")).alias("_l"), F.lit(turn + 1).alias("passes"))
        moved = moved.withColumn("done", F.coalesce(F.array_max(F.transform("_s", F.abs)) < tolerance, F.lit(True)))
        state = written(state.where("done").unionByName(moved), "fits")
        if state.where("not done").isEmpty():
            break
    b = F.col("_b")
    inside = b[2].between(LOW, HIGH) & b[4].between(LOW, HIGH) & (b[0] > 0) & (b[1] > 0) & (b[3] > 0) & (F.array_max(F.transform("_s", F.abs)) < tolerance)
    solved = state.select("fit", *[b[i].alias(n) for i, n in enumerate(NAMES)], F.col("_l").alias("cost"), "passes", F.coalesce(F.col("done") & inside, F.lit(False)).alias("success"))
    every = points.sparkSession.range(fits).select(F.col("id").cast("int").alias("fit"))
    return every.join(solved, "fit", "left").withColumn("success", F.coalesce("success", F.lit(False)))


def kappas(points: DataFrame, law: DataFrame) -> DataFrame:
    """Per fit the quality parameter of the reducible-linear form on top of its law, in closed form.

    `points` has n, d, `share` and the sums c1, c2 of s and s squared and cy of s times the loss, where s is what quality lacks to one.
    """
    packed = law.where("success").agg(F.collect_list(F.struct("fit", *NAMES)).alias("laws"))
    rows = with_row(points, packed).withColumn("f", F.explode("laws"))
    own = {k: F.col("f." + k) for k in NAMES}
    rows = rows.withColumn("x", F.get("share", F.col("f.fit"))).where("x > 0").withColumn("r", laws.size_term(own, F.col("n")) + laws.data_term(own, F.col("d")))
    top = F.sum(F.col("x") * F.col("r") * (F.col("cy") - (own["E"] + F.col("r")) * F.col("c1")))
    return rows.groupBy(F.col("f.fit").alias("fit")).agg((top / F.sum(F.col("x") * F.col("r") * F.col("r") * F.col("c2"))).alias("kappa"))


def best_size(law: Mapping[str, Column], c: Column, k: Column, r: Column, low: Column, high: Column, steps: int = 8) -> Column:
    """Size that minimises A n^-alpha + B (c / (k n + r))^-beta between two sizes.

    In the logarithm of the size the loss is convex and its slope has the sign of a smooth, nearly straight function; Newton steps
    from the root without `r` reach its root in a few turns.
    """
    alpha, beta = law["alpha"], law["beta"]
    c0 = F.ln(alpha * law["A"] / (beta * law["B"])) + beta * F.ln(c) - F.ln(k)

    def turn(x: Column, _: Column) -> Column:
        cost = k * F.exp(x) + r
        return x + (c0 - (1 + alpha) * x + (1 - beta) * F.ln(cost)) / ((1 + alpha) - (1 - beta) * k * F.exp(x) / cost)

    begin = (c0 + (1 - beta) * F.ln(k)) / (alpha + beta)
    return F.least(high, F.greatest(low, F.exp(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), begin, turn))))


def _form(kind: Column, law: Mapping[str, Column], rn: Column, rd: Column, q: Column, kappa: Column, power: float) -> tuple[Column, Column]:
    """Prediction of a quality form and its derivative in kappa, from the law's size and data terms."""
    short, level = F.greatest(F.lit(0.0), 1 - q), F.greatest(q, F.lit(1e-3))
    bent = F.pow(short, F.lit(power))
    data, size = rd * F.exp(law["beta"] * kappa * short), rn * F.pow(level, -kappa)
    base = law["E"] + rn + rd
    pred = (F.when(kind == "none", base).when(kind == "additive", base + kappa * short).when(kind == "reducible_linear", law["E"] + (rn + rd) * (1 + kappa * short))
            .when(kind == "reducible_power", law["E"] + (rn + rd) * (1 + kappa * bent)).when(kind == "effective_data", law["E"] + rn + data).otherwise(law["E"] + size + rd))
    slope = (F.when(kind == "none", 0.0).when(kind == "additive", short).when(kind == "reducible_linear", (rn + rd) * short).when(kind == "reducible_power", (rn + rd) * bent)
             .when(kind == "effective_data", data * law["beta"] * short).otherwise(-F.ln(level) * size))
    return pred, slope


def _formed(cells: DataFrame, fits: DataFrame, power: float) -> DataFrame:
    """Cells under every fit: its columns, the prediction `p` and its slope `j`; fits travel as one bounded array."""
    packed = fits.agg(F.collect_list(F.struct("fit", "kind", "kappa", *NAMES)).alias("_fits"))
    rows = with_row(cells, packed).withColumn("_f", F.explode("_fits")).select(*cells.columns, "_f.*")
    own = {k: F.col(k) for k in NAMES}
    rows = rows.withColumn("_rn", laws.size_term(own, F.col("n"))).withColumn("_rd", laws.data_term(own, F.col("d")))
    pred, slope = _form(F.col("kind"), own, F.col("_rn"), F.col("_rd"), F.col("q"), F.col("kappa"), power)
    return rows.withColumn("p", pred).withColumn("j", slope)


def fit_quality(cells: DataFrame, law: DataFrame, kinds: Sequence[str], scale: float = 0.01, power: float = 1.5, passes: int = 12, top: float = 5.0) -> DataFrame:
    """Quality parameter of every form on top of every law, by Gauss-Newton steps on the Huber cost of log residuals.

    `cells` has n, d, q, y, their count k and `share`, the weight of the cell in each law's fit; `law` has fit and the parameters. A pass is one
    aggregation per (fit, form). Returns fit, kind, kappa, the law's parameters and the training cost.
    """
    cells = materialise_evenly(cells.select("n", "d", "q", "y", "k", "share"))
    state = law.where("success").select("fit", *NAMES, F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind"))
    state = written(state.withColumn("kappa", F.when(F.col("kind") == "none", 0.0).otherwise(0.3)), "forms")
    for turn in range(passes + 1):
        rows = _formed(cells, state, power).withColumn("x", F.get("share", F.col("fit")) * F.col("k")).where("x > 0").withColumn("r", F.ln("p") - F.ln("y")).withColumn("g", F.col("j") / F.col("p"))
        w = F.col("x") * F.least(F.lit(1.0), scale / F.greatest(F.abs("r"), F.lit(1e-300)))
        a = F.abs(F.col("r"))
        cost = F.col("x") * F.when(a <= scale, 0.5 * a * a).otherwise(scale * (a - 0.5 * scale))
        sums = rows.groupBy(F.col("fit").alias("_fit"), F.col("kind").alias("_kind")).agg(F.sum(w * F.col("g") * F.col("r")).alias("_t"), F.sum(w * F.col("g") * F.col("g")).alias("_b"), F.sum(cost).alias("cost"))
        both = state.select("fit", "kind", "kappa", *NAMES).join(sums, (F.col("fit") == F.col("_fit")) & (F.col("kind") == F.col("_kind")))
        if turn == passes:
            return written(both.select("fit", "kind", "kappa", *NAMES, "cost"), "forms")
        moved = F.greatest(F.lit(0.0), F.least(F.lit(top), F.col("kappa") - F.col("_t") / F.when(F.col("_b") > 0, F.col("_b"))))
        state = written(both.select("fit", "kind", F.when(F.col("_b") > 0, moved).otherwise(F.col("kappa")).alias("kappa"), *NAMES), "forms")


def predicted(cells: DataFrame, fits: DataFrame, by: Column, power: float = 1.5) -> DataFrame:
    """Cells with `p` of the fits that `by` admits (a condition over cell columns and `fit`)."""
    return _formed(cells, fits, power).where(by)
