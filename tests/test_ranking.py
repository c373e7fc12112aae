import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import ranking as r


@pytest.fixture
def rows():
    rng = np.random.default_rng(3)
    n = 4000
    g = np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abcdefgh"), n))
    v = np.round(rng.normal(size=n) * 4) / 4
    v[rng.random(n) < 0.3] = 0.0
    return pd.DataFrame({"id": np.arange(n), "g": g, "v": v, "w": np.round(rng.normal(size=n), 1), "ref": rng.random(n) < 0.4})


def test_running_over_many_slots(spark, many_slots, rows):
    df = spark.createDataFrame(rows)
    got = r.running(df, ["g"], ["v", "id"], {"s": ("sum", "w"), "m": ("max", "w")}).toPandas().sort_values(["g", "v", "id"])
    want = rows.sort_values(["g", "v", "id"])
    assert np.allclose(got.s, want.groupby("g").w.cumsum())
    assert np.allclose(got.m, want.groupby("g").w.cummax())
    assert np.allclose(got.s_total, want.groupby("g").w.transform("sum"))
    assert np.allclose(got.s_before, want.groupby("g").w.cumsum() - want.w, atol=1e-9)


def test_running_uses_several_slots(spark, many_slots, rows):
    df = spark.createDataFrame(rows).repartitionByRange(F.col("g"), F.col("v"), F.col("id"))
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_quantiles_match_numpy(spark, many_slots, rows):
    got = r.exact_quantiles(spark.createDataFrame(rows), ["g"], "v", {"a": 0.05, "b": 0.5, "c": 0.975}).toPandas().set_index("g")
    for g, part in rows.groupby("g"):
        assert np.allclose(got.loc[g, ["a", "b", "c"]].astype(float), np.quantile(part.v, [0.05, 0.5, 0.975]))


def test_one_row_group(spark):
    df = spark.createDataFrame([("x", 2.0)], "g string, v double")
    assert r.exact_quantiles(df, ["g"], "v", {"a": 0.1, "b": 0.9}).first()[1:] == (2.0, 2.0)


def test_ecdf_matches_searchsorted(spark, many_slots, rows):
    got = r.reference_ecdf(spark.createDataFrame(rows), ["g"], "v", "ref", "u").toPandas()
    for g, part in got.groupby("g"):
        ref = np.sort(rows[(rows.g == g) & rows.ref].v)
        n = len(ref)
        want = np.clip((np.searchsorted(ref, part.v, side="right") + 0.5) / (n + 1), 1 / (n + 1), n / (n + 1))
        assert np.allclose(part.u, want)


def test_spearman_matches_pandas(spark, many_slots, rows):
    got = r.spearman(spark.createDataFrame(rows), ["g"], "v", "w").toPandas().set_index("g")
    for g, part in rows.groupby("g"):
        assert np.isclose(got.loc[g, "spearman"], np.corrcoef(part.v.rank(), part.w.rank())[0, 1])


def test_sample_distances(spark, many_slots, rows):
    got = r.two_sample_distances(spark.createDataFrame(rows), [], "v", "ref").first()
    a, b = np.sort(rows[rows.ref].v), np.sort(rows[~rows.ref].v)
    grid = np.unique(rows.v)
    gap = np.abs(np.searchsorted(a, grid, side="right") / len(a) - np.searchsorted(b, grid, side="right") / len(b))
    assert np.isclose(got["ks_statistic"], gap.max())
    assert np.isclose(got["wasserstein"], np.sum(gap[:-1] * np.diff(grid)))
