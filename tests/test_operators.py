import itertools
import lzma
import math

import numpy as np
import pandas as pd
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from plumbline.operators import allocation, cohorts, composition, fitting, inference, metrics, profiling, rank_bootstrap, resampling, scoring, splits
from plumbline.plans.trials import LAW, trials
from plumbline.sources import files
from plumbline.sources.sinks import write_result
from plumbline.streaming.buckets import windowed_counts


def test_zero_replacement_and_ilr(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.4, 0.6), (0.25, 0.25, 0.25, 0.25)], "a double, b double, c double, d double")
    cols = [F.col(c) for c in "abcd"]
    z = composition.zero_replaced(cols, 1e-3)
    rows = df.select(*[x.alias(f"z{i}") for i, x in enumerate(z)]).toPandas().to_numpy()
    assert np.allclose(rows.sum(axis=1), 1) and rows[0, 0] == 1e-3 and math.isclose(rows[0, 2], 0.4 * (1 - 2e-3))
    even = df.select(*composition.helmert_ilr(z)).toPandas().to_numpy()[1]
    assert np.allclose(even, 0)


def test_ridge_and_cross_validation(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([1, 2, 1.5], 120)
    y = np.column_stack([np.log(p[:, 0]) - 0.4 * np.log(p[:, 1]) + rng.normal(size=120) * 0.2, p[:, 2] + rng.normal(size=120) * 0.05])
    pdf = pd.DataFrame(p, columns=["a", "b", "c"]).assign(y1=y[:, 0], y2=y[:, 1], fold=np.arange(120) % 3)
    df = spark.createDataFrame(pdf)

    def ridge(x, t, alpha):
        mx, sx, mt, st = x.mean(0), x.std(0), t.mean(0), t.std(0)
        xs, ts = (x - mx) / sx, (t - mt) / st
        b = np.linalg.solve(xs.T @ xs + alpha * np.eye(x.shape[1]), xs.T @ ts)
        return lambda q: ((q - mx) / sx) @ b * st + mt

    fit = composition.fit_ridge(df, ["a", "b"], ["y1", "y2"], 2.0).toPandas()
    want = ridge(p[:, :2], y, 2.0)
    zero = want(np.zeros((1, 2)))[0]
    got = fit[fit.feature == "intercept"].set_index("output").coefficient
    assert np.allclose([got["y1"], got["y2"]], zero)

    cv = composition.cross_validate(df, ["a", "b", "c"], ["y1", "y2"], "fold", [1e-4], [0.1, 10.0]).toPandas()
    x = np.column_stack([(np.log(p[:, 0]) - np.log(p[:, 1])) / math.sqrt(2), (np.log(p[:, 0]) + np.log(p[:, 1]) - 2 * np.log(p[:, 2])) / math.sqrt(6)])
    for alpha in (0.1, 10.0):
        oof = np.empty_like(y)
        for f in range(3):
            va = pdf.fold == f
            oof[va] = ridge(x[~va], y[~va], alpha)(x[va])
        assert np.isclose(cv[cv.alpha == alpha].cv_rmse.iloc[0], np.sqrt(np.mean((oof - y) ** 2)))
    assert cv.selected.sum() == 1 and cv[cv.selected].cv_spearman_median.iloc[0] > 0.5


def test_cluster_ols_matches_direct(spark):
    rng = np.random.default_rng(1)
    n = 400
    pdf = pd.DataFrame({"g": "one", "c": rng.integers(0, 25, n), "x": rng.normal(size=n)})
    pdf["y"] = 1 + 2 * pdf.x + rng.normal(size=n) + rng.normal(size=25)[pdf.c]
    got = inference.cluster_ols(spark.createDataFrame(pdf), "g", ["x"], "y", "c").toPandas().set_index("term")
    X = np.column_stack([np.ones(n), pdf.x])
    b = np.linalg.solve(X.T @ X, X.T @ pdf.y)
    e = pdf.y - X @ b
    u = np.array([(X[pdf.c == c] * e[pdf.c == c].to_numpy()[:, None]).sum(0) for c in range(25)])
    bread = np.linalg.inv(X.T @ X)
    se = np.sqrt(np.diag(bread @ (u.T @ u) @ bread) * 25 / 24 * (n - 1) / (n - 2))
    assert np.allclose(got.loc[["intercept", "x"], "effect"], b) and np.allclose(got.loc[["intercept", "x"], "std_error"], se)
    p = math.erfc(abs(b[1] / se[1]) / math.sqrt(2))
    assert abs(got.loc["x", "p_value"] - p) < 1e-6


def test_quantile_fit_is_near_the_optimum(spark):
    rng = np.random.default_rng(2)
    n = 600
    pdf = pd.DataFrame({"s": np.where(np.arange(n) % 3, "a", "b"), "x": rng.uniform(size=n), "w": rng.uniform(0.5, 2, n)})
    pdf["y"] = 1 + 2 * pdf.x + rng.exponential(size=n)
    got = inference.quantile_fits(spark.createDataFrame(pdf), "s", ["x"], "y", "w", 0.9).toPandas()
    for s, part in pdf.groupby("s"):
        fit = got[got.s == s].set_index("term").coefficient

        def loss(a, b):
            r = part.y - a - b * part.x
            return np.average(np.maximum(0.9 * r, -0.1 * r), weights=part.w)

        # an optimal line passes through two points: search all of them
        best = min(loss(y1 - (y2 - y1) / (x2 - x1) * x1, (y2 - y1) / (x2 - x1)) for (x1, y1), (x2, y2) in
                   itertools.combinations(part.sort_values("y")[["x", "y"]].to_numpy()[-80:], 2) if x1 != x2)
        assert loss(fit["intercept"], fit["x"]) <= best * 1.002
        assert np.isclose(got[got.s == s].pinball.iloc[0], loss(fit["intercept"], fit["x"]))


def test_bh_limits_and_hot_scope(spark, many_slots):
    rng = np.random.default_rng(5)
    p = np.concatenate([[0.0, 1.0], rng.uniform(size=500) ** 2])
    pdf = pd.DataFrame({"s": "one", "k": np.arange(len(p)), "p": p})
    got = inference.benjamini_hochberg(spark.createDataFrame(pdf), ["s"], "k", "p").toPandas().sort_values("k").q_value.to_numpy()
    order = np.argsort(p, kind="stable")
    adj = np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    want = np.empty_like(p)
    want[order] = np.clip(adj, 0, 1)
    assert np.allclose(got, want) and got[0] == 0 and got[1] == 1


def test_law_fit_recovers_parameters(spark):
    rows = trials(spark.read.parquet(f"{SMALL}/lineitem.parquet")).where("l_tax = 0.04 and q >= 0.999")
    cells = fitting.design_cells(rows)
    for objective in ("raw", "log"):
        fit = fitting.fit_law(cells, objective).first()
        assert not fit["grid_edge"]
        for name in ("E", "alpha", "beta"):
            assert abs(fit[name] - LAW[name]) < 0.03, (objective, name, fit)


def test_leave_group_out_matches_refit(spark):
    rows = trials(spark.read.parquet(f"{SMALL}/lineitem.parquet"))
    got = fitting.leave_group_out(fitting.design_cells(rows, ["run"]), "run", [0.34], [0.28]).toPandas().set_index("run")
    pdf = rows.select("run", "n", "d", "y").toPandas()
    for g in pdf.run.unique():
        tr, te = pdf[pdf.run != g], pdf[pdf.run == g]
        X = lambda f: np.column_stack([np.ones(len(f)), f.n ** -0.34, f.d ** -0.28])
        b = np.linalg.lstsq(X(tr), tr.y, rcond=None)[0]
        assert np.isclose(got.loc[g, "sse"], np.sum((te.y - X(te) @ b) ** 2), rtol=1e-6)


def test_nested_selection_uses_only_training_folds(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"n": rng.integers(1, 9, 400).astype(float), "d": rng.integers(10, 60, 400).astype(float), "q": rng.choice([0.5, 0.75, 1.0], 400)})
    base = 1.7 + (0.9 * pdf.n ** -0.34 + 1.6 * pdf.d ** -0.28) * (1 + 0.4 * (1 - pdf.q))
    pdf["y"], pdf["outer"], pdf["inner"] = base, rng.integers(0, 3, 400), rng.integers(0, 2, 400)
    sums = fitting.quality_sums(fitting.design_cells(spark.createDataFrame(pdf), ["outer", "inner"]), LAW, ["none", "additive", "reducible_linear"], [0.2, 0.4, 0.6], ["outer", "inner"])
    got = fitting.nested_selection(sums).toPandas()
    assert set(got.selected) == {"reducible_linear"} and (got.kappa == 0.4).all() and (got.rmse < 1e-9).all() and got.rows.sum() == 400


def test_nearest_design_is_exact(spark):
    rng = np.random.default_rng(6)
    design, points = rng.uniform(size=(300, 2)), rng.uniform(-0.5, 1.5, size=(60, 2))
    d = spark.createDataFrame(pd.DataFrame(design, columns=["x", "y"]))
    p = spark.createDataFrame(pd.DataFrame(points, columns=["x", "y"]).assign(id=np.arange(60)))
    got = allocation.nearest_design(p, "id", d, ["x", "y"]).toPandas().sort_values("id")
    span = design.max(0) - design.min(0)
    want = np.sqrt((((points[:, None] - design[None]) / span) ** 2).sum(-1)).min(1)
    assert len(got) == 60 and np.allclose(got.distance, want)


def test_nearest_design_leaves_rows_in_place(spark, monkeypatch):
    rng = np.random.default_rng(14)
    d = spark.createDataFrame(pd.DataFrame(rng.uniform(size=(500, 3)), columns=list("xyz")))
    p = spark.createDataFrame(pd.DataFrame(rng.uniform(size=(40, 3)), columns=list("xyz")).assign(id=np.arange(40)))
    plans, keep = [], allocation.materialise
    monkeypatch.setattr(allocation, "materialise", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for value in (threshold, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", value)
            out = allocation.nearest_design(p, "id", d, list("xyz"))
            plans.append(out._jdf.queryExecution().executedPlan().toString())
            assert out.count() == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    for plan in plans:
        lines = plan.splitlines()
        for i, line in enumerate(lines):
            depth = len(line) - len(line.lstrip(" :+-"))
            below = []
            for other in lines[i + 1:]:
                if len(other) - len(other.lstrip(" :+-")) <= depth:
                    break
                below.append(other)
            if "Exchange" in line:  # copies of a row for its neighbouring cells are merged before anything is sent
                assert not any("Generate explode" in o for o in below) or any("Aggregate" in o for o in below), plan


@pytest.mark.parametrize("carried, rows, width", [(1 << 18, 80, 1e-9), (0, 700, 0.2), (0, 80, 0.2)])
def test_nearest_design_far_rows_ties_and_tiles(spark, monkeypatch, carried, rows, width):
    monkeypatch.setattr(allocation, "CARRIED", carried)
    monkeypatch.setattr(allocation, "TILE", 8)
    rng = np.random.default_rng(15)
    design = np.concatenate([rng.integers(0, 6, size=(60, 3)) / 5, 0.5 + width * rng.uniform(size=(60, 3)), rng.uniform(size=(280, 3)) ** 3, np.eye(3) * 4])
    points = np.concatenate([rng.uniform(-1, 5, size=(rows - 20, 3)), 50 * rng.normal(size=(10, 3)), design[:10]])
    d = spark.createDataFrame(pd.DataFrame(design, columns=list("xyz")))
    p = spark.createDataFrame(pd.DataFrame(points, columns=list("xyz")).assign(id=np.arange(rows)))
    got = allocation.nearest_design(p, "id", d, list("xyz")).toPandas().sort_values("id")
    apart = np.sqrt((((points[:, None] - design[None]) / (design.max(0) - design.min(0))) ** 2).sum(-1))
    assert got.id.tolist() == list(range(rows)) and np.allclose(got.distance, apart.min(1), rtol=1e-12, atol=1e-12)
    named = np.array([[n[a] for a in "xyz"] for n in got.nearest])
    again = np.sqrt((((points - named) / (design.max(0) - design.min(0))) ** 2).sum(-1))
    assert np.allclose(again, apart.min(1), rtol=1e-12, atol=1e-12)



def test_pareto_front_matches_brute_force(spark):
    x = np.random.default_rng(7).integers(0, 8, size=(300, 3)).astype(float)
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(id=np.arange(300))).repartition(4)
    want = {i for i in range(300) if not (np.all(x >= x[i], axis=1) & np.any(x > x[i], axis=1)).any()}
    assert {r["id"] for r in scoring.pareto_front(df, list("abc"), block=7).collect()} == want


def test_rank_tiles_match_ntile(spark, many_slots):
    got = scoring.rank_tiles(spark.range(103).withColumn("v", F.col("id") % 7), ["v", "id"], 10, "t").toPandas().sort_values(["v", "id"])
    sizes = [11] * 3 + [10] * 7
    assert got.t.tolist() == [i + 1 for i, s in enumerate(sizes) for _ in range(s)]


def test_state_changes_hold(spark, many_slots):
    states = list("aaabaaabbbbcacccc")
    df = spark.createDataFrame([("u", i + 1, s) for i, s in enumerate(states)], "u string, r int, s string")
    got = allocation.state_changes(df, ["u"], "r", "s", ["r"]).toPandas()
    want = [i + 1 for i in range(1, len(states) - 2) if states[i] != states[i - 1] and len(set(states[i:i + 3])) == 1]
    assert sorted(got.iloc[:, 1].tolist()) == want


def test_costs_close_and_regret(spark):
    from plumbline.plans import budgets

    sc = spark.createDataFrame([(1, 5e20, 4096.0, "power", 0.5), (2, 1e15, 4096.0, "power", 0.5)], "id int, budget double, context double, family string, q0 double")
    best = allocation.best_cell(allocation.cell_losses(allocation.grid_cells(sc, budgets.NS, budgets.QS), LAW, 0.4, budgets.B), budgets.KEY)
    rows = allocation.with_costs(best, budgets.B).collect()
    assert [r["id"] for r in rows] == [1]
    assert abs(rows[0]["train_share"] + rows[0]["quality_share"] + rows[0]["attention_share"] - 1) < 1e-12 and rows[0]["utilisation"] <= 1 + 1e-9
    assert [r["id"] for r in allocation.infeasible(sc, best, "id", budgets.B).collect()] == [2]


def test_buckets_keep_empty_weeks(spark):
    df = spark.createDataFrame([("a", "2024-01-01"), ("a", "2024-01-20"), ("b", "2024-01-08")], "g string, t string").withColumn("t", F.to_timestamp("t"))
    got = cohorts.bucket_counts(df, ["g"], "t", 7).orderBy("g", "bucket").collect()
    assert [r["n"] for r in got] == [1, 0, 1, 0, 1, 0]


def test_stream_counts_equal_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, ["event_type"], "ts").writeStream.format("memory").queryName("buckets").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.table("buckets").collect()))
    assert got == sorted(map(tuple, windowed_counts(events, ["event_type"], "ts").collect())) and got


def test_record_cases_before_first_and_after_last(spark):
    df = spark.createDataFrame([("a", "2024-01-02", 1.0), ("a", "2024-01-05", 3.0)], "g string, t string, v double").withColumn("t", F.to_timestamp("t"))
    got = metrics.record_cases(df, ["g"], "t", "v", ["2023-12-01", "2024-01-03", "2024-02-01"], [3]).orderBy("cutoff").collect()
    assert [(r["persistence"], r["truth"], r["complete_window"]) for r in got] == [(1.0, 3.0, False), (3.0, 3.0, False)]


def test_leakage_is_found(spark):
    rows = spark.createDataFrame([("p", 0, "train", "1", "g", 5.0), ("p", 0, "test", "1", "g", 4.0), ("p", 0, "test", "2", "h", 1.0)],
                                 "protocol string, fold int, role string, record_id string, group_id string, time double")
    r = splits.leakage_audit(rows).first()
    assert (r["records"], r["record_overlap"], r["group_overlap"], r["time_leaks"]) == (2, 1, 1, 1)


def test_one_to_one_join_guards(spark):
    left, right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string"), spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, y double")
    assert profiling.join_one_to_one(left, right, "k").count() == 2
    with pytest.raises(Exception, match="one-to-one"):
        profiling.join_one_to_one(left, right.union(right.limit(1)), "k").collect()
    with pytest.raises(Exception, match="one-to-one"):
        profiling.join_one_to_one(left, right.limit(1), "k").collect()


def test_xz_lines_and_corrupt_documents(spark, tmp_path):
    with lzma.open(tmp_path / "a.jsonl.xz", "wt") as fh:
        fh.write('{"id": 1, "v": 2.5}\n\n{"id": 2, "v": null}\n')
    got = files.read_xz_json_lines(spark, str(tmp_path / "*.xz"), "id long, v double").collect()
    assert sorted((r["id"], r["v"]) for r in got) == [(1, 2.5), (2, None)]
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.json").write_text('{"k": 1}')
    (docs / "b.json").write_text('{"k": ')
    assert {r["path"][-6:]: r["corrupt"] for r in files.read_json_documents(spark, str(docs)).collect()} == {"a.json": False, "b.json": True}


def test_csv_reader_keeps_odd_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Average ⬆️,x.y/z\n1.5,abc\nbad,NaN\n", encoding="utf-8")
    got = files.read_csv(spark, str(tmp_path / "a.csv"), ["Average ⬆️", "xyz"], ["Average ⬆️", "xyz"]).collect()
    assert [tuple(r) for r in got] == [(1.5, None), (None, None)]


def test_sinks_reject_unknown_forms(spark, tmp_path):
    with pytest.raises(ValueError):
        write_result(spark.range(1), str(tmp_path / "x"), "xml")


def test_rank_correlation_of_replicates(spark, many_slots, monkeypatch):
    """Against scipy-free ranks of the rows as often as drawn; ties, a value that a third of the rows share, and a chunk of few rows."""
    monkeypatch.setattr(rank_bootstrap, "ROWS", 50)
    rng = np.random.default_rng(4)
    y = np.where(rng.random(240) < 0.35, 7.0, rng.integers(0, 40, 240)).astype(float)
    pdf = pd.DataFrame({"k": np.arange(240), "x": np.round(y / 9 + rng.normal(size=240)), "y": y})
    df = spark.createDataFrame(pd.concat([pdf, pd.DataFrame({"k": [900, 901], "x": [np.nan, 1.0], "y": [1.0, np.nan]})]))
    got = rank_bootstrap.spearman_replicates(df, "k", "x", "y", 150).toPandas().set_index("rep").rho
    drawn = resampling.with_draws(spark.createDataFrame(pdf), F.col("k"), 150).toPandas()
    assert sorted(got.index) == list(range(150))
    for rep, rows in drawn.groupby("rep"):
        twice = rows.loc[rows.index.repeat(rows.w)]
        assert abs(got[rep] - twice.x.rank().corr(twice.y.rank())) < 1e-9


def test_rank_correlation_of_one_value_and_of_nothing(spark):
    one = spark.createDataFrame([(k, 1.0, float(k)) for k in range(20)], "k long, x double, y double")
    got = rank_bootstrap.spearman_replicates(one, "k", "x", "y", 3).collect()
    assert len(got) == 3 and all(r.rho is None for r in got)
    assert rank_bootstrap.spearman_replicates(one.limit(0), "k", "x", "y", 3).collect() == []
