"""Closed-form scaling law, its quality variants, partials and cost functions.

Units: N and D in billions, compute in 1e18 FLOPs unless a name says otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the attention cost coefficient, the default starting quality and the cost families.
ATTENTION = 2e-4
QUALITY_START = 0.5
COST_FAMILIES = ("exponential", "power", "logarithmic")
KINDS = ("none", "additive", "reducible_linear", "reducible_power", "effective_data", "n_power")

Law = Mapping[str, float | Column]


def _lit(v: float | Column) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def size_term(law: Law, n: Column) -> Column:
    return _lit(law["A"]) * F.pow(n, -_lit(law["alpha"]))


def data_term(law: Law, d: Column) -> Column:
    return _lit(law["B"]) * F.pow(d, -_lit(law["beta"]))


def loss(law: Law, n: Column, d: Column) -> Column:
    return _lit(law["E"]) + size_term(law, n) + data_term(law, d)


def quality_loss(kind: str, law: Law, n: Column, d: Column, q: Column, k: float | Column, power: float = 1.0) -> Column:
    """Law with one quality parameter `k` in one of six shapes."""
    e, rn, rd, k = _lit(law["E"]), size_term(law, n), data_term(law, d), _lit(k)
    short = F.greatest(F.lit(0.0), 1 - q)
    shapes = {
        "none": e + rn + rd,
        "additive": e + rn + rd + k * short,
        "reducible_linear": e + (rn + rd) * (1 + k * short),
        "reducible_power": e + (rn + rd) * (1 + k * F.pow(short, F.lit(power))),
        "effective_data": e + rn + data_term(law, d * F.exp(k * (q - 1))),
        "n_power": e + rn * F.pow(F.greatest(q, F.lit(1e-3)), -k) + rd,
    }
    return shapes[kind]


def partials(law: Law, n: Column, d: Column, q: Column, k: float) -> dict[str, Column]:
    """Analytic derivatives of the reducible-linear law."""
    m = 1 + k * (1 - q)
    rn, rd = size_term(law, n), data_term(law, d)
    return {"dn": -_lit(law["alpha"]) * rn / n * m, "dd": -_lit(law["beta"]) * rd / d * m, "dq": -k * (rn + rd)}


def equivalent_size(law: Law, n: Column, d: Column, q: Column, q_next: Column, k: float) -> tuple[Column, Column]:
    """(status, N) with L(N, D, q) = L(n, D, q_next); N is NULL unless finite."""
    step = (1 + k * (1 - q_next)) / (1 + k * (1 - q))
    rhs = ((size_term(law, n) + data_term(law, d)) * step - data_term(law, d)) / _lit(law["A"])
    log_n = -F.ln(F.when(rhs > 0, rhs)) / _lit(law["alpha"])
    top = 709.782712893384  # ln of the largest double
    status = (F.when(rhs < 0, "unattainable").when(rhs == 0, "infinite_limit")
              .when(log_n > top, "overflow").otherwise("finite"))
    return status, F.when((rhs > 0) & (log_n <= top), F.exp(log_n))


def quality_cost(q: Column, family: str) -> Column:
    """FLOPs per token spent on reaching quality q."""
    return {"exponential": 1e7 * F.exp(6.0 * q), "power": 5e9 * F.pow(q, F.lit(4.0)),
            "logarithmic": 2e9 * F.ln(1 + 10.0 * q)}[family]


def quality_cost_slope(q: Column, family: str) -> Column:
    return {"exponential": 6e7 * F.exp(6.0 * q), "power": 2e10 * F.pow(q, F.lit(3.0)),
            "logarithmic": 2e10 / (1 + 10.0 * q)}[family]


def quality_cost_rise(q: Column, start: Column, family: str) -> Column:
    return F.greatest(quality_cost(q, family) - quality_cost(start, family), F.lit(0.0))


def by_family(fn, family: Column) -> Column:
    """Pick fn(name) by a family column."""
    out = F.lit(None).cast("double")
    for name in COST_FAMILIES:
        out = F.when(family == name, fn(name)).otherwise(out)
    return out


def cost_parts(n: Column, d: Column, rise: Column, context: Column) -> dict[str, Column]:
    """FLOPs for training, quality work and attention."""
    tokens = d * 1e9
    return {"train": 6.0 * (n * 1e9) * tokens, "quality": tokens * rise, "attention": ATTENTION * (n * 1e9) * tokens * context}


def affordable_data(budget: Column, n: Column, rise: Column, context: Column) -> Column:
    """Billions of tokens a budget (FLOPs) buys at size n."""
    return (budget / 1e18) / ((6.0 + ATTENTION * context) * n + rise / 1e9)
