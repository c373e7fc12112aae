"""Queries on small made-up tables: values without a logarithm, ties, sums whose order differs."""

import hashlib

import duckdb
import numpy as np
import pandas as pd
from compare import difference
from pyspark.sql import functions as F

from plumbline.functions import keys
from plumbline.functions.text import SIGNALS
from plumbline.operators import allocation, composition, inference, plan_search, rank_bootstrap, resampling, scoring, splits
from plumbline.plans import ORACLES, QUERIES, budgets, quality
from plumbline.plans.trials import KAPPA, LAW


def small_tables(folder, **frames):
    """Tables of a few rows as files, and DuckDB over them."""
    con = duckdb.connect()
    for name, frame in frames.items():
        frame.to_parquet(f"{folder}/{name}.parquet", index=False)
        con.sql(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return str(folder), con


def test_events_without_a_logarithm_are_left_out(spark, tmp_path):
    rng = np.random.default_rng(5)
    events = pd.DataFrame({"event_id": np.arange(240), "event_type": np.where(np.arange(240) % 2, "view", "click"), "user_id": np.arange(240) % 7,
                           "value": np.where(np.arange(240) % 41 == 0, 0.0, rng.lognormal(size=240))})
    folder, con = small_tables(tmp_path, events=events)
    for name in ("i6_bh_qvalues", "i7_effect_families"):
        assert difference(QUERIES[name](spark, folder), con, ORACLES[name]) is None
    assert QUERIES["i6_bh_qvalues"](spark, folder).where("p is null or p = 1").count() == 0


def test_equal_indices_share_a_rank(spark):
    """Indices that differ only by what rounding leaves of them are ties."""
    pdf = pd.DataFrame({"id": range(6), "a": [1.0, 0.1 + 0.2, 0.3, 5.0, 2.0, 2.0], "is_ref": True})
    got = composition.relative_index(spark.createDataFrame(pdf), ["a"], "is_ref").toPandas().sort_values("id")
    assert got["rank"].tolist() == [3, 1, 1, 6, 4, 4]


def test_composition_ids_do_not_hang_on_the_order_of_sums(spark, tmp_path):
    """The first share is 0.0000000025 or 0.0000000015 exactly: half a billionth goes up, whatever the last bits of a sum of doubles say."""
    cents = [(1, "F", 5), (1, "O", 1_999_999_995), (2, "F", 3), (2, "O", 1_999_999_997), (3, "F", 10), (3, "P", 20), (3, "O", 70)]
    orders = pd.DataFrame([(k, s, c / 100) for k, s, c in cents], columns=["o_custkey", "o_orderstatus", "o_totalprice"])
    folder, con = small_tables(tmp_path, orders=orders)
    df = QUERIES["p8_composition_id"](spark, folder)
    assert difference(df, con, ORACLES["p8_composition_id"]) is None
    got = {r.o_custkey: r.group_id for r in df.collect()}
    for key, shares in {1: "0.000000003,0.999999998,0.000000000", 2: "0.000000002,0.999999999,0.000000000", 3: "0.100000000,0.700000000,0.200000000"}.items():
        assert got[key] == "mixture:" + hashlib.sha256(shares.encode()).hexdigest()[:20]


def test_grid_searched_in_the_row_equals_the_best_of_all_cells(spark):
    """No cell is shuffled; scenarios that afford nothing go."""
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"id": range(40), "budget": 10 ** rng.uniform(18, 23, 40), "context": rng.choice([2048.0, 8192.0], 40), "family": rng.choice(["power", "exponential", "logarithmic"], 40), "q0": rng.choice([0.5, 0.72], 40)})
    sc = spark.createDataFrame(pdf)
    got = allocation.least_cells(sc, budgets.NS, budgets.QS, LAW, KAPPA, budgets.B, budgets.KEY, profile=True)
    fine = allocation.refine(got, LAW, KAPPA, budgets.B, budgets._RATIO, budgets.STEP, budgets.KEY)
    assert not any("Exchange" in df._jdf.queryExecution().executedPlan().toString() for df in (got, fine))
    cells = allocation.cell_losses(allocation.grid_cells(sc, budgets.NS, budgets.QS), LAW, KAPPA, budgets.B)
    want = allocation.best_cell(cells, budgets.KEY)
    names = ["id", "loss", "n", "d", "q", "d_affordable"]
    a, b = (df.select(names).toPandas().sort_values("id").to_numpy() for df in (got, want))
    assert 0 < len(a) < 40 and np.allclose(a, b, rtol=1e-12)
    levels = got.selectExpr("id", "inline(profile)").groupBy("id", "q").agg(F.min("loss").alias("p")).toPandas().sort_values(["id", "q"]).to_numpy()
    assert np.allclose(levels, cells.groupBy("id", "q").agg(F.min("loss").alias("p")).toPandas().sort_values(["id", "q"]).to_numpy(), rtol=1e-12)
    assert (fine.toPandas().sort_values("id").loss.to_numpy() <= a[:, 1] + 1e-12).all()


def test_plans_of_all_replicates_beat_a_fine_scan(spark, monkeypatch):
    """In slices of three scenarios; one of them affords nothing, one not the higher levels."""
    monkeypatch.setattr(plan_search, "SLICE", 3)
    rng = np.random.default_rng(2)
    reps = {"E": rng.uniform(1.5, 2, 9), "A": rng.uniform(0.7, 1.1, 9), "alpha": rng.uniform(0.2, 0.5, 9), "B": rng.uniform(1.2, 1.8, 9), "beta": rng.uniform(0.2, 0.4, 9), "kappa": rng.uniform(0.2, 0.6, 9)}
    qs, b = [0.5, 0.8, 1.0], budgets.B
    rows = pd.DataFrame({"id": range(7), "family": "power", "q0": 0.5, "c": [1e-3, 10.0, 40.0, 200.0, 900.0, 5e3, 4e4], "k": [6.4] * 3 + [7.6] * 4, "r": [np.array([0.0, 0.8, 4.0])] * 7})
    work = plan_search.replicate_optima(reps, qs, b)
    got = pd.concat(work(iter([rows]))).set_index("id")
    best = {}
    for row in rows.itertuples():
        found = []
        for q, r in zip(qs, row.r):
            top = min(b.n_max, (row.c / b.d_min - r) / row.k)
            n = np.linspace(b.n_min, top, 200001)[:, None] if top >= b.n_min else np.full((1, 1), b.n_max)
            d = np.minimum(b.d_max, row.c / (row.k * n + r))
            here = reps["E"] + (reps["A"] * n ** -reps["alpha"] + reps["B"] * d ** -reps["beta"]) * (1 + reps["kappa"] * (1 - q))
            found.append(np.where(d >= b.d_min * (1 - 1e-9), here, np.inf).min(axis=0))
        if np.isfinite(found).any():
            best[row.id] = np.min(found, axis=0)
    assert sorted(got.index) == sorted(best) and 0 not in best
    for k, losses in best.items():
        assert np.allclose([got.loss_low[k], got.loss_median[k], got.loss_high[k]], np.quantile(losses, [0.025, 0.5, 0.975]), atol=1e-6)
    own = {c: v[:1] for c, v in reps.items()}
    risk = pd.concat(plan_search.risk_decisions(own, reps, qs, (0.8, 1.0, 1.25), b)(iter([rows]))).set_index("id")
    assert sorted(risk.index) == sorted(best)
    assert (risk.p90_regret >= -1e-12).all() and (risk.max_regret >= risk.p90_regret).all() and (risk.p90_loss <= got.loss_high + 1).all()


def test_replicate_sums_of_shared_values_and_many_sides(spark, monkeypatch):
    """A value over several slots, more values of x than a task holds, and further weighted sums; no weight is shuffled."""
    monkeypatch.setattr(rank_bootstrap, "DISTINCT", 3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    rng = np.random.default_rng(6)
    y = np.where(rng.random(300) < 0.4, 2.0, rng.normal(size=300).round(2))
    pdf = pd.DataFrame({"k": np.arange(300), "x": (y + rng.normal(size=300)).round(1), "y": y})
    try:
        limits = spark.createDataFrame(pdf).agg(F.percentile_approx("y", [k / 24 for k in range(1, 24)])).first()[0]
        assert rank_bootstrap._Slots(limits).shares.max() > 1
        got = rank_bootstrap.spearman_replicates(spark.createDataFrame(pdf), "k", "x", "y", 130, {"yy": F.col("y") * F.col("y")}).toPandas().set_index("rep")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    drawn = resampling.with_draws(spark.createDataFrame(pdf), F.col("k"), 130).toPandas()
    assert sorted(got.index) == list(range(130))
    for rep, rows in drawn.groupby("rep"):
        twice = rows.loc[rows.index.repeat(rows.w)]
        assert abs(got.rho[rep] - twice.x.rank().corr(twice.y.rank())) < 1e-9
        assert got.n[rep] == len(twice) and abs(got.yy[rep] - (twice.y ** 2).sum()) < 1e-8


def test_scores_on_a_half_round_up(spark, tmp_path):
    """With 319 documents in the sample every score is an odd number of 640ths, half a millionth above six decimals."""
    rng = np.random.default_rng(9)
    texts = [" ".join("".join(rng.choice(list("abcdeio,.X7"), rng.integers(2, 9))) for _ in range(rng.integers(5, 40))) for _ in range(500)]
    docs = pd.DataFrame({"doc_id": np.arange(500), "text": texts, "lang": "en", "source": "web", "n_chars": [len(x) for x in texts]})
    labels = pd.DataFrame({"doc_id": np.arange(319), "quality": 1, "toxic": 0})
    folder, con = small_tables(tmp_path, documents=docs, labels=labels)
    for name in ("k2_filled_scores", "k8_family_gap"):
        assert difference(QUERIES[name](spark, folder), con, ORACLES[name]) is None


def test_few_time_blocks_do_not_gather_their_groups(spark, monkeypatch):
    """Rows of few groups stay where they are; many groups are joined by key, with the same marks."""
    pdf = pd.DataFrame({"g": np.arange(200) % 3, "t": np.arange(200.0)})
    rows = spark.createDataFrame(pdf)
    few = splits.time_block(rows, ["g"], "t", 0.5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in splits.time_block(rows, ["g"], "t", 0.5)._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(splits, "STRATA", 2)
        many = splits.time_block(rows, ["g"], "t", 0.5)
        assert "BroadcastHashJoin" not in many._jdf.queryExecution().executedPlan().toString()
        a, b = (df.orderBy("t").toPandas().is_train.tolist() for df in (few, many))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = pdf.groupby("g").t.transform("quantile", 0.5)
    assert a == b == (pdf.t <= want).tolist()


def test_lines_of_few_groups_do_not_gather_their_rows(spark, monkeypatch):
    """Rows get the line of their group by broadcast; many groups are joined by key, with the same residuals."""
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": [f"g{i % 3}" for i in range(300)], "x": rng.normal(size=300), "y": rng.normal(size=300)})
    rows = spark.createDataFrame(pdf)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = scoring.length_residuals(rows, "g", "y", "x", "r")
        assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(scoring, "STRATA", 2)
        many = scoring.length_residuals(rows, "g", "y", "x", "r")
        assert "BroadcastHashJoin" not in many._jdf.queryExecution().executedPlan().toString()
        a, b = (df.toPandas().sort_values("x").r.to_numpy() for df in (few, many))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = pdf.groupby("g", group_keys=False)[["x", "y"]].apply(lambda d: d.y - np.polyval(np.polyfit(d.x, d.y, 1), d.x)).reindex(pdf.sort_values("x").index)
    assert np.allclose(a, want) and np.allclose(b, want)


def test_wide_gaps_are_found_from_leading_cells(spark, monkeypatch):
    """The quantile of all gaps equals the one from the widest gaps alone, which move few cells; bounds that leave too little are lowered."""
    rng = np.random.default_rng(12)
    z = np.clip(np.round(rng.standard_t(3, size=(700, len(SIGNALS))), 2), -8, 8)
    z[:, 7] = np.minimum(z[:, 7], 0)
    pdf = pd.DataFrame({"g": np.where(np.arange(700) % 7, "u", "v"), "_r": 0, "_n": 0, "zs": z.tolist()})
    pdf["_r"] = pdf.groupby("g").cumcount()
    pdf["_n"] = pdf.groupby("g").g.transform("size")
    rows = spark.createDataFrame(pdf).cache()
    gaps = scoring.shuffled_gaps(rows, ["g"], 1, 30).toPandas().gap.to_numpy()
    assert len(gaps) == 700 * 30
    ends = {"a0": z[:, :6].min(), "a1": z[:, :6].max(), "b0": z[:, 6:].min(), "b1": z[:, 6:].max()}
    least = float(np.quantile(gaps, 0.97))
    leads = scoring.leading_cells(rows, ["g"], least, ends)
    wide = scoring.wide_gaps(rows, ["g"], 1, 30, least, leads).toPandas().gap.to_numpy()
    assert np.array_equal(np.sort(wide), np.sort(gaps[gaps >= least])) and leads.count() < 700
    whole = scoring.shuffled_gaps
    asked = []
    monkeypatch.setattr(scoring, "shuffled_gaps", lambda r, by, way, perms: asked.append(perms) or whole(r, by, way, perms))
    for margins, calls in (((1.4, 4.0), [4]), ((0.1, 2.0), [4]), ((0.1, 0.2), [4, 30])):
        monkeypatch.setattr(scoring, "MARGINS", margins)
        asked.clear()
        assert scoring.null_quantile(rows, ["g"], 1, 30, 0.99).first().v == np.quantile(gaps, 0.99) and asked == calls


def test_permutation_is_undone(spark):
    rows = spark.range(200).select(F.explode(F.sequence(F.lit(1), F.lit(12))).alias("k"), F.col("id")).withColumn("n", F.col("k") * F.col("k") + F.col("k") % 5 + 1)
    rows = rows.where("id < n").withColumn("seed", F.col("k") * 15485863 + 7919)
    back = keys.unpermuted(keys.permuted(rows, "id", "n", "seed", "at"), "at", "n", "seed", "from")
    assert back.where(F.col("from") != F.col("id")).count() == 0 and back.count() == rows.count()


def test_folds_of_a_record_share_a_mask(spark):
    """Counts of the audit equal plain ones over many folds, with copies of records, and an inner split of training groups is checked."""
    rng = np.random.default_rng(8)
    n = 4000
    pdf = pd.DataFrame({"protocol": rng.choice(["p", "q"], n), "fold": rng.choice([0, 1, 59, 60, 130], n), "role": rng.choice(["train", "test"], n),
                        "record_id": rng.integers(0, 300, n).astype(str), "time": rng.random(n)})
    pdf["group_id"] = (pdf.record_id.astype(int) // 2).astype(str)
    got = splits.leakage_audit(spark.createDataFrame(pdf)).toPandas().set_index(["protocol", "fold"])
    assert len(got) == 10
    for key, d in pdf.groupby(["protocol", "fold"]):
        train, test = d[d.role == "train"], d[d.role == "test"]
        drawn = test[test.group_id.isin(train.group_id)]
        want = (d.record_id.nunique(), len(set(train.record_id) & set(test.record_id)), len(set(train.group_id) & set(test.group_id)), drawn.record_id.nunique())
        assert tuple(got.loc[key, ["records", "record_overlap", "group_overlap", "inner_in_outer_test"]]) == want


def test_an_inner_cutoff_is_fitted_once(spark, monkeypatch):
    """Outer cutoffs that share an inner one share its fit; every outer cutoff still has all its inner folds."""
    fits, seen = inference.quantile_fits, []

    def counted(df, by, *args):
        seen.append(df.groupBy(by).agg(F.countDistinct("event_id").alias("ids"), F.count(F.lit(1)).alias("n")).collect())
        return fits(df, by, *args, passes=1)

    monkeypatch.setattr(inference, "quantile_fits", counted)
    got = QUERIES["i4_nested_selection"](spark, "/root/testdata/sf0.01").orderBy("cutoff").collect()
    assert [r.inner_folds for r in got] == [1, 2, 3]
    assert [len(s) for s in seen] == [3, 3] and all(r.ids == r.n for s in seen for r in s)


def test_halves_round_as_in_sql(spark, tmp_path):
    """Means and differences of scores on a half of the last decimal, also negative ones, go where round() of the SQL takes them."""
    odd = np.arange(1, 640, 2)
    x = np.concatenate([odd / 640, -odd / 640, odd / 5120, (1 - odd / 640) / 3, odd / 320 * 0.5 + 0.5])
    pd.DataFrame({"doc_id": np.arange(len(x)), "x": x, "y": x}).to_parquet(f"{tmp_path}/scores.parquet", index=False)
    df = spark.read.parquet(f"{tmp_path}/scores.parquet")
    rounded = quality._rounded(quality._rounded(df, "x"), "y", digits=4).toPandas()
    want = duckdb.sql(f"select doc_id, round(x, 6) as x, round(y, 4) as y from '{tmp_path}/scores.parquet'").df()
    both = rounded.merge(want, on="doc_id")
    assert len(both) == len(x) and (both.x_x == both.x_y).all() and (both.y_x == both.y_y).all()


def test_means_of_scores_on_a_half_equal_their_sql(spark, tmp_path):
    rng = np.random.default_rng(9)
    texts = [" ".join("".join(rng.choice(list("abcdeio,.X7"), rng.integers(2, 9))) for _ in range(rng.integers(5, 40))) for _ in range(500)]
    docs = pd.DataFrame({"doc_id": np.arange(500), "text": texts, "lang": "en", "source": "web", "n_chars": [len(x) for x in texts]})
    folder, con = small_tables(tmp_path, documents=docs, labels=pd.DataFrame({"doc_id": np.arange(319), "quality": 1, "toxic": 0}))
    for name in ("k6_facet_means", "k7_huber_means"):
        assert difference(QUERIES[name](spark, folder), con, ORACLES[name]) is None
