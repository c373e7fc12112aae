"""Row-local array statistics, all inside JVM expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expected_level(logits: Column, levels: int = 6) -> Column:
    """Mean level 0..levels-1 under the softmax of a logit vector; NULL unless the vector is whole and finite."""
    v = logits.cast("array<double>")
    whole = (F.size(v) == levels) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    e = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    ranked = F.aggregate(F.transform(e, lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return F.when(whole, ranked / total)


def margin(pair: Column, positive: int = 1, negative: int = 0) -> Column:
    """Difference of the two entries of a length-2 logit vector, else NULL."""
    return F.when(F.size(pair) == 2,
                  pair[positive].cast("double") - pair[negative].cast("double"))


def first_argmax(v: Column) -> Column:
    """Zero-based position of the first maximum; NULL when any entry is missing."""
    whole = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x))
    return F.when(whole, F.array_position(v, F.array_max(v)) - 1)


def present(values: list[Column]) -> Column:
    return F.filter(F.array(*values), lambda x: x.isNotNull() & ~F.isnan(x))


def mean_of(v: Column) -> Column:
    return F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v))


def median_of(v: Column) -> Column:
    s, n = F.array_sort(v), F.size(v)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.when(n > 0, (F.get(s, low) + F.get(s, high)) / 2)


def with_huber_means(df: DataFrame, vectors: Mapping[str, Column], c: float = 1.5) -> DataFrame:
    """Add one-step Huber means of array columns about their median, scaled by 1.4826 MAD (1 when it vanishes).

    Each stage is its own projection so that no intermediate value is written out twice inside a lambda.
    """
    names, keep = list(vectors), df.columns
    out = df.withColumns({f"_v_{n}": v for n, v in vectors.items()})
    out = out.withColumns({f"_m_{n}": median_of(F.col(f"_v_{n}")) for n in names})

    def gaps(n: str) -> Column:
        return F.transform(F.col(f"_v_{n}"), lambda x: F.abs(x - F.col(f"_m_{n}")))

    def weights(n: str) -> Column:
        return F.transform(F.col(f"_d_{n}"), lambda d: F.least(F.lit(1.0), c / F.greatest(d / F.col(f"_k_{n}"), F.lit(1e-12))))

    out = out.withColumns({f"_d_{n}": gaps(n) for n in names})
    out = out.withColumns({f"_s_{n}": 1.4826 * median_of(F.col(f"_d_{n}")) for n in names})
    out = out.withColumns({f"_k_{n}": F.when(F.col(f"_s_{n}") > 1e-8, F.col(f"_s_{n}")).otherwise(1.0) for n in names})
    out = out.withColumns({f"_w_{n}": weights(n) for n in names})
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    means = {n: F.when(F.size(f"_v_{n}") > 0, total(F.zip_with(f"_v_{n}", f"_w_{n}", lambda x, w: x * w)) / total(F.col(f"_w_{n}"))) for n in names}
    return out.select(*keep, *[m.alias(n) for n, m in means.items()])


def bound(value: Column, use) -> Column:
    """use(value) with `value` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def quantile_of(values: Column, share: float) -> Column:
    """Linear-interpolation quantile of a sorted array."""

    def pick(held: Column) -> Column:
        spot = F.lit(share) * (F.size(held) - 1)
        low = F.floor(spot).cast("int")
        a, b = F.get(held, low), F.get(held, F.ceil(spot).cast("int"))
        return a + (spot - low) * (b - a)

    return bound(values, pick)
