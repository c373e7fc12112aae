"""Scaling-law fits as aggregate jobs (F).

Trials are first collapsed to distinct (size, tokens, quality, loss) cells with a count. For fixed exponents the law is
linear, so each exponent pair needs ten sums and a closed form; held-out errors follow from totals minus group sums.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import laws
from plumbline.runtime import explode_numbers, materialise, materialise_evenly, with_row

SUMS = ["s1", "su", "sv", "sy", "suu", "svv", "suv", "suy", "svy", "syy"]


def design_cells(trials: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return trials.groupBy(*keep, "n", "d", "q", "y").agg(F.count(F.lit(1)).alias("k"))


def design_points(cells: DataFrame, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Distinct (size, tokens) points with weighted count, sum and square sum of the loss; `weight` may use n, d, y."""
    w = F.col("k").cast("double") if weight is None else F.col("k") * weight
    return cells.groupBy(*by, "n", "d").agg(F.sum(w).alias("w"), F.sum(w * F.col("y")).alias("wy"), F.sum(w * F.col("y") * F.col("y")).alias("wyy"))


def law_sums(points: DataFrame, alphas: Sequence[float], betas: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """The ten sums of y on (1, n^-alpha, d^-beta) per exponent pair and group; the grid expands design points, not rows."""
    rows = points.select(*by, "n", "d", "w", "wy", "wyy", explode_numbers(alphas).alias("alpha")).withColumn("u", F.pow("n", -F.col("alpha")))
    rows = rows.select("*", explode_numbers(betas).alias("beta")).withColumn("v", F.pow("d", -F.col("beta")))
    w, u, v, wy = (F.col(c) for c in ("w", "u", "v", "wy"))
    terms = dict(zip(SUMS, [w, w * u, w * v, wy, w * u * u, w * v * v, w * u * v, wy * u, wy * v, F.col("wyy")]))
    return rows.groupBy(*by, "alpha", "beta").agg(*[F.sum(c).alias(n) for n, c in terms.items()])


def closed_form(sums: DataFrame) -> DataFrame:
    """Add E, A, B and sse; rows with a non-positive parameter are dropped."""
    c = {n: F.col(n) for n in SUMS}
    cov = lambda a, b, ab: c[ab] - c[a] * c[b] / c["s1"]
    uu, vv, uv, uy, vy, yy = cov("su", "su", "suu"), cov("sv", "sv", "svv"), cov("su", "sv", "suv"), cov("su", "sy", "suy"), cov("sv", "sy", "svy"), cov("sy", "sy", "syy")
    staged = sums.select("*", uu.alias("_uu"), vv.alias("_vv"), uv.alias("_uv"), uy.alias("_uy"), vy.alias("_vy"), yy.alias("_yy"))
    det = F.expr("_uu * _vv - _uv * _uv")
    staged = staged.withColumn("_det", det).where(F.col("_det") > 1e-14 * F.col("_uu") * F.col("_vv"))
    fit = staged.withColumn("A", F.expr("(_uy * _vv - _vy * _uv) / _det")).withColumn("B", F.expr("(_vy * _uu - _uy * _uv) / _det"))
    fit = fit.withColumn("E", F.expr("(sy - A * su - B * sv) / s1")).withColumn("sse", F.expr("_yy - A * _uy - B * _vy"))
    return fit.where("A > 0 and B > 0 and E > 0").drop("_uu", "_vv", "_uv", "_uy", "_vy", "_yy", "_det")


def best_law(fits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    row = F.struct("sse", "alpha", "beta", "E", "A", "B", "s1")
    return fits.groupBy(*by).agg(F.min(row).alias("r")).select(*by, "r.*")


def _refined(centre: float, step: float, low: float, high: float) -> list[float]:
    return sorted({round(min(high, max(low, centre + i * step)), 12) for i in range(-6, 7)})


def fit_law(cells: DataFrame, objective: str = "raw", rounds: int = 3, passes: int = 2) -> DataFrame:
    """Coarse-to-fine exponents around a Huber-weighted linear fit. One row: parameters, cost and grid-edge flag.

    The log objective uses relative residuals. Each step is one aggregation of the written cells; the driver sees one row.
    """
    cells = materialise_evenly(cells)
    low, high, law, delta = 0.02, 1.5, None, None
    if objective == "raw":
        delta = max(0.01, 0.1 * cells.agg(F.sqrt(F.sum(F.col("k") * F.col("y") * F.col("y")) / F.sum("k") - F.pow(F.sum(F.col("k") * F.col("y")) / F.sum("k"), 2))).first()[0])
    else:
        delta = 0.01
    step, alphas = 0.1, [0.05 + 0.1 * i for i in range(15)]
    betas = list(alphas)
    for turn in range(passes + 1):
        weight = F.lit(1.0) if objective == "raw" else 1 / (F.col("y") * F.col("y"))
        if law is not None:
            pred = laws.loss(law, F.col("n"), F.col("d"))
            r = F.abs(pred - F.col("y")) if objective == "raw" else F.abs(F.ln(pred) - F.ln("y"))
            huber = F.least(F.lit(1.0), delta / F.greatest(r, F.lit(1e-12)))
            weight = huber if objective == "raw" else huber / (pred * pred)
        points = materialise_evenly(design_points(cells, weight=weight))
        for _ in range(rounds if turn == 0 else 1):
            row = best_law(closed_form(law_sums(points, alphas, betas))).first()
            if row is None:
                raise ValueError("no exponent pair gives positive parameters")
            step = step / 6
            alphas, betas = _refined(row["alpha"], step, low, high), _refined(row["beta"], step, low, high)
        law = {n: float(row[n]) for n in ("E", "A", "alpha", "B", "beta")}
        step = step * 6
        alphas, betas = _refined(law["alpha"], step, low, high), _refined(law["beta"], step, low, high)
    edge = any(abs(law[e] - b) < 1e-9 for e in ("alpha", "beta") for b in (low, high))
    return cells.sparkSession.createDataFrame([(objective, *[law[n] for n in ("E", "A", "alpha", "B", "beta")], float(row["sse"]), edge)],
                                              "objective string, E double, A double, alpha double, B double, beta double, cost double, grid_edge boolean")


def leave_group_out(cells: DataFrame, group: str, alphas: Sequence[float], betas: Sequence[float]) -> DataFrame:
    """Held-out error of every group: fit on totals minus the group, score on the group's own sums."""
    per = materialise(law_sums(design_points(cells, [group]), alphas, betas, [group]))
    total = per.groupBy("alpha", "beta").agg(*[F.sum(s).alias("t_" + s) for s in SUMS])
    both = per.join(total, ["alpha", "beta"])
    rest = both.select(F.col(group).alias("held"), "alpha", "beta", *[(F.col("t_" + s) - F.col(s)).alias(s) for s in SUMS])
    best = best_law(closed_form(rest), ["held"]).drop("s1", "sse")
    own = per.join(best, (F.col(group) == F.col("held")) & (per.alpha == best.alpha) & (per.beta == best.beta)).drop(best.alpha).drop(best.beta)
    e, a, b = F.col("E"), F.col("A"), F.col("B")
    sse = (F.col("syy") - 2 * (e * F.col("sy") + a * F.col("suy") + b * F.col("svy")) + e * e * F.col("s1") + a * a * F.col("suu") + b * b * F.col("svv")
           + 2 * (e * a * F.col("su") + e * b * F.col("sv") + a * b * F.col("suv")))
    return own.select(group, F.col("s1").cast("long").alias("rows"), "alpha", "beta", "E", "A", "B", F.greatest(sse, F.lit(0.0)).alias("sse"))


def huber_cost(r: Column, scale: float = 0.01) -> Column:
    a = F.abs(r)
    return F.when(a <= scale, 0.5 * r * r).otherwise(scale * (a - 0.5 * scale))


def quality_sums(cells: DataFrame, law: Mapping[str, float], kinds: Sequence[str], ks: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Log-Huber cost and plain error sums per (kind, k) and group."""
    y, w = F.col("y"), F.col("k")
    rows = _by_kind(cells, law, kinds, ks, by)
    e = F.col("p") - y
    return rows.groupBy(*by, "kind", "kappa").agg(F.sum(w * huber_cost(F.ln("p") - F.ln(y))).alias("cost"), F.sum(w * e * e).alias("sse"), F.sum(w * F.abs(e)).alias("sae"),
                                                  F.sum(w * e).alias("se"), F.sum("k").alias("rows"), F.sum(w * y).alias("sy"), F.sum(w * y * y).alias("syy"))


def _by_kind(cells: DataFrame, law, kinds, ks, by) -> DataFrame:
    """Grid expansion with the parameter as a column, so expressions stay small for long grids."""
    n, d, q = F.col("n"), F.col("d"), F.col("q")
    pairs = [(kind, v) for kind in kinds for v in ([0.0] if kind == "none" else ks)]
    grid = F.expr("explode(array(" + ", ".join(f"named_struct('kind', '{a}', 'kappa', {float(v)!r}D)" for a, v in pairs) + "))")
    rows = cells.select(*by, "n", "d", "q", "y", "k", grid.alias("g")).select(*by, "n", "d", "q", "y", "k", "g.*")
    p = F.lit(None).cast("double")
    for kind in kinds:
        p = F.when(F.col("kind") == kind, laws.quality_loss(kind, law, n, d, q, F.col("kappa"), power=1.5)).otherwise(p)
    return rows.select(*by, "y", "k", "kind", "kappa", p.alias("p"))


def candidate_folds(sums: DataFrame, fold: str) -> DataFrame:
    """Per kind and fold: parameter with the least training cost (total minus fold) and its held-out sums."""
    total = sums.groupBy("kind", "kappa").agg(F.sum("cost").alias("_all"))
    both = sums.join(total, ["kind", "kappa"]).withColumn("_train", F.col("_all") - F.col("cost"))
    row = F.struct("_train", "kappa", "sse", "sae", "rows")
    return both.groupBy("kind", fold).agg(F.min(row).alias("r")).select("kind", fold, "r.kappa", "r.sse", "r.sae", "r.rows")


def candidate_scores(folds: DataFrame) -> DataFrame:
    return folds.groupBy("kind").agg(F.sqrt(F.sum("sse") / F.sum("rows")).alias("rmse"), (F.sum("sae") / F.sum("rows")).alias("mae"), F.sum("rows").alias("rows"),
                                     F.array_sort(F.collect_list(F.struct("fold", "kappa"))).alias("fold_parameters"))


def nested_selection(sums: DataFrame) -> DataFrame:
    """Outer folds with inner selection, all from (kind, kappa, outer, inner) sums."""
    per = materialise(sums)
    grand = per.groupBy("kind", "kappa", "inner").agg(*[F.sum(c).alias("t_" + c) for c in ("cost", "sse", "sae", "rows")])
    held = per.select("kind", "kappa", "inner", "outer", *["cost", "sse", "sae", "rows"])
    train = held.join(grand, ["kind", "kappa", "inner"]).select("kind", "kappa", "outer", "inner", *[(F.col("t_" + c) - F.col(c)).alias(c) for c in ("cost", "sse", "sae", "rows")])
    whole = train.groupBy("kind", "kappa", "outer").agg(F.sum("cost").alias("full"))
    row = F.struct("_fit", "kappa", "sse", "sae", "rows")
    picks = train.join(whole, ["kind", "kappa", "outer"]).withColumn("_fit", F.col("full") - F.col("cost")).groupBy("kind", "outer", "inner").agg(F.min(row).alias("r"))
    scores = picks.groupBy("kind", "outer").agg(F.sqrt(F.sum("r.sse") / F.sum("r.rows")).alias("rmse"), (F.sum("r.sae") / F.sum("r.rows")).alias("mae"))
    chosen = scores.groupBy("outer").agg(F.min(F.struct("rmse", "mae", "kind")).alias("c")).select("outer", F.col("c.kind").alias("kind"), F.col("c.rmse").alias("inner_rmse"))
    fitted = whole.join(chosen.select("outer", "kind"), ["outer", "kind"]).groupBy("outer", "kind").agg(F.min(F.struct("full", "kappa")).alias("f")).select("outer", "kind", F.col("f.kappa").alias("kappa"))
    test = per.groupBy("kind", "kappa", "outer").agg(F.sum("sse").alias("sse"), F.sum("sae").alias("sae"), F.sum("rows").alias("rows"))
    out = fitted.join(test, ["outer", "kind", "kappa"]).join(chosen, ["outer", "kind"])
    return out.select("outer", F.col("kind").alias("selected"), "kappa", "inner_rmse", F.sqrt(F.col("sse") / F.col("rows")).alias("rmse"), (F.col("sae") / F.col("rows")).alias("mae"), "rows")


def nonnegative_line(n: Column, sx: Column, sy: Column, sxx: Column, sxy: Column) -> tuple[Column, Column]:
    """Intercept and slope, both >= 0, minimising squared error, from sums."""
    slope = (n * sxy - sx * sy) / F.when(n * sxx - sx * sx != 0, n * sxx - sx * sx)
    icept = (sy - slope * sx) / n
    through = F.greatest(F.lit(0.0), sxy / sxx)
    flat = F.greatest(F.lit(0.0), sy / n)
    gain_through = 2 * through * sxy - through * through * sxx
    gain_flat = 2 * flat * sy - flat * flat * n
    inside = F.coalesce((slope >= 0) & (icept >= 0), F.lit(False))
    edge = gain_through >= gain_flat
    return F.when(inside, icept).when(edge, 0.0).otherwise(flat), F.when(inside, slope).when(edge, through).otherwise(0.0)


LINE = {"m": lambda x, y: F.count(F.lit(1)).cast("double"), "sx": lambda x, y: F.sum(x), "sy": lambda x, y: F.sum(y), "sxx": lambda x, y: F.sum(x * x), "sxy": lambda x, y: F.sum(x * y), "syy": lambda x, y: F.sum(y * y)}


def line_sums(df: DataFrame, by: Sequence[str], x: Column, y: Column) -> DataFrame:
    return df.groupBy(*by).agg(*[f(x, y).alias(n) for n, f in LINE.items()])


def line_sse(a: Column, b: Column) -> Column:
    """Squared error of a + b x from the sums of `line_sums`."""
    return F.greatest(F.lit(0.0), F.col("syy") - 2 * a * F.col("sy") - 2 * b * F.col("sxy") + a * a * F.col("m") + 2 * a * b * F.col("sx") + b * b * F.col("sxx"))


def leave_source_out(sums: DataFrame, group: str, uncalibrated: float) -> DataFrame:
    """Held-out rmse per group of the affine fit, the training mean and the uncalibrated law."""
    total = sums.agg(*[F.sum(n).alias("t_" + n) for n in LINE])
    wide = with_row(sums, total)
    r = {n: F.col("t_" + n) - F.col(n) for n in LINE}
    a, b = nonnegative_line(r["m"], r["sx"], r["sy"], r["sxx"], r["sxy"])
    wide = wide.withColumn("_a", a).withColumn("_b", b).withColumn("_mean", r["sy"] / r["m"])
    rmse = lambda p, q: F.sqrt(line_sse(p, q) / F.col("m"))
    return wide.select(group, F.col("m").cast("long").alias("rows"), F.col("_a").alias("calibration_e"), F.col("_b").alias("calibration_scale"), rmse(F.col("_a"), F.col("_b")).alias("rmse_affine"),
                       rmse(F.col("_mean"), F.lit(0.0)).alias("rmse_train_mean"), rmse(F.lit(uncalibrated), F.lit(1.0)).alias("rmse_uncalibrated"))
