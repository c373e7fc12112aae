"""Hash keys, folds and hash-derived random weights."""

from __future__ import annotations

import math
import unicodedata
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cumulative Poisson(1) probabilities P(X <= k); twelve terms go beyond what a 32-bit uniform can tell apart.
POISSON_ONE = tuple(accumulate(math.exp(-1) / math.factorial(k) for k in range(12)))


def hex_number(digest: Column, start: int = 1, digits: int = 8) -> Column:
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")


def hash_fold(key: Column, folds: int = 5) -> Column:
    return (hex_number(F.sha2(key.cast("string"), 256)) % folds).cast("int")


def short_id(*parts: Column, digits: int = 12) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, digits)


def composition_id(parts: list[Column]) -> Column:
    """Group id of a composition from its nine-decimal rendering."""
    text = F.concat_ws(",", *[F.format_string("%.9f", p) for p in parts])
    return F.concat(F.lit("mixture:"), F.substring(F.sha2(text, 256), 1, 20))


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))


def nfkc(text: Column) -> Column:
    """Unicode compatibility form; only non-ASCII rows are sent to Python."""
    odd = F.when(text.rlike("[^\\x00-\\x7F]"), text)
    return F.coalesce(_nfkc(odd), text)


# Prefixes that loaders put before a name.
LOADER_PREFIXES = ("pretrained=", "hf:", "hf-")


def name_key(text: Column, unicode: bool = True) -> Column:
    """Letters and digits of a name after dropping loader prefixes."""
    base = F.trim(F.lower(nfkc(text) if unicode else text))
    base = F.regexp_replace(base, f"^({'|'.join(LOADER_PREFIXES)})", "")
    return F.coalesce(F.regexp_replace(base, "[^a-z0-9]+", ""), F.lit(""))


def poisson_weight(digits: Column) -> Column:
    """Poisson(1) draw by inverse CDF from eight hex digits, read as a share of 2^32.

    Digits of one length are in the order of their numbers, so they are compared as they stand.
    """
    limits = [math.ceil(t * 2 ** 32) for t in POISSON_ONE]
    out = F.lit(sum(v < 2 ** 32 for v in limits))
    for k, v in reversed(list(enumerate(limits))):
        if v < 2 ** 32:
            out = F.when(digits < f"{v:08x}", F.lit(k)).otherwise(out)
    return out


def with_draws(df: DataFrame, key: Column, reps: int) -> DataFrame:
    """Expand rows over `rep` 0..reps-1 with a positive bootstrap weight `w`.

    One SHA-256 digest serves eight replicates; zero-weight draws are dropped before any shuffle.
    """
    blocks = df.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(-(-reps // 8) - 1))))
    blocks = blocks.withColumn("_h", F.sha2(F.concat_ws("|", key.cast("string"), F.col("_g")), 256))
    digits = blocks.select(*df.columns, "_g", F.posexplode(F.array(*[F.substring("_h", 8 * s + 1, 8) for s in range(8)])).alias("_s", "_d"))
    drawn = digits.select(*df.columns, (F.col("_g") * 8 + F.col("_s")).cast("int").alias("rep"), poisson_weight(F.col("_d")).alias("w"))
    return drawn.where(f"w > 0 and rep < {reps}")


def draws_sql(source: str, key: str, reps: int, keep: str = "*") -> str:
    """The same expansion in SQL, for checks."""
    u = "('0x' || substr(sha256({k} || '|' || g), 8 * s + 1, 8))::bigint / 4294967296.0".format(k=key)
    weight = " + ".join(f"(u >= {t!r})::int" for t in POISSON_ONE)
    return (f"select * exclude (u, g, s), g * 8 + s as rep, {weight} as w from (select {keep}, g, s, {u} as u from {source}, "
            f"range({-(-reps // 8)}) t1(g), range(8) t2(s) where g * 8 + s < {reps})")


#: Fixed values of the keyed permutation: multipliers and modulus of its mixing step, rounds, and steps of cycle walking.
MIX, SPREAD, MODULUS, ROUNDS, WALKS = 7919, 104729, 2147483647, 4, 32


def _exchanged(x: Column, side: Column, keys: list[Column]) -> Column:
    """One pass of a Feistel network over pairs of numbers below `side`."""
    left, right = F.floor(x / side).cast("long"), x % side
    for k in keys:
        left, right = right, (left + (right * MIX + k) * SPREAD % MODULUS) % side
    return left * side + right


def permuted(df: DataFrame, place: str, n: str, seed: str, out: str) -> DataFrame:
    """Add where a keyed permutation of 0 .. n-1 sends `place`; `seed` (below 10^9) names the permutation.

    A Feistel network permutes the square numbers up to the next square above n; places that fall behind n walk on until
    they come back. Fewer than 2 sqrt(n) + 1 places lie behind, so walks are short: with 32 steps none stays out.
    """
    side, keys = F.col("_side"), [F.col(seed) + 32452843 * r for r in range(ROUNDS)]
    rows = df.withColumn("_side", F.ceil(F.sqrt(F.col(n).cast("double"))).cast("long"))
    rows = rows.withColumn("_left", F.floor(F.col(place) / side).cast("long")).withColumn("_right", F.col(place) % side)
    for k in keys:
        rows = rows.select(*df.columns, "_side", F.col("_right").alias("_left"), ((F.col("_left") + (F.col("_right") * MIX + k) * SPREAD % MODULUS) % side).alias("_right"))
    rows = rows.withColumn("_at", F.col("_left") * side + F.col("_right"))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), F.col("_at"), lambda at, _: F.when(at >= F.col(n), _exchanged(at, side, keys)).otherwise(at))
    return rows.select(*df.columns, F.when(F.col("_at") < F.col(n), F.col("_at")).otherwise(walked).alias(out))


def unpermuted(df: DataFrame, place: str, n: str, seed: str, out: str) -> DataFrame:
    """Add which number of 0 .. n-1 the permutation of `permuted` sends to `place`: its rounds backwards, the walk included."""
    side, keys = F.col("_side"), [F.col(seed) + 32452843 * r for r in reversed(range(ROUNDS))]
    rows = df.withColumn("_side", F.ceil(F.sqrt(F.col(n).cast("double"))).cast("long"))
    rows = rows.withColumn("_left", F.floor(F.col(place) / side).cast("long")).withColumn("_right", F.col(place) % side)
    for k in keys:
        rows = rows.select(*df.columns, "_side", _lowered(F.col("_right"), F.col("_left"), k, side).alias("_left"), F.col("_left").alias("_right"))
    rows = rows.withColumn("_at", F.col("_left") * side + F.col("_right"))

    def back(at: Column) -> Column:
        left, right = F.floor(at / side).cast("long"), at % side
        for k in keys:
            left, right = _lowered(right, left, k, side), left
        return left * side + right

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), F.col("_at"), lambda at, _: F.when(at >= F.col(n), back(at)).otherwise(at))
    return rows.select(*df.columns, F.when(F.col("_at") < F.col(n), F.col("_at")).otherwise(walked).alias(out))


def _lowered(half: Column, other: Column, key: Column, side: Column) -> Column:
    """What a round added to `half` taken off again."""
    return F.pmod(half - (other * MIX + key) * SPREAD % MODULUS, side)


def permuted_sql(place: str, n: str, seed: str) -> str:
    """The same place in SQL."""
    side = f"ceil(sqrt({n}::double))::bigint"

    def once(x: str) -> str:
        left, right = f"({x} // {side})", f"({x} % {side})"
        for r in range(ROUNDS):
            left, right = right, f"(({left} + ({right} * {MIX} + {seed} + {32452843 * r}) * {SPREAD} % {MODULUS}) % {side})"
        return f"({left} * {side} + {right})"

    return f"list_reduce(list_concat([{once(place)}], range({WALKS})), lambda spot, step: case when spot >= {n} then {once('spot')} else spot end)"
