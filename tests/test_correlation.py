"""Rank correlations by null classes and clusters by recursion against plain versions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from panelyard.plans import correlation


def plain_spearman(frame, cols, least):
    out = {}
    for date, g in frame.groupby("date"):
        if len(g) < least:
            continue
        for i, a in enumerate(cols):
            for b in cols[i + 1 :]:
                both = g[[a, b]].dropna()
                if len(both) >= least and both[a].nunique() > 1 and both[b].nunique() > 1:
                    out[date, a, b] = both[a].rank().corr(both[b].rank())
    return out


def test_spearman_ranks_each_class_once(spark):
    rng = np.random.default_rng(0)
    n, cols = 600, ["a", "b", "c", "d", "e"]
    frame = pd.DataFrame(rng.integers(0, 40, (n, 5)).astype(float), columns=cols)
    frame["date"] = rng.integers(0, 3, n)
    frame.loc[(frame["date"] == 0) & (rng.random(n) < 0.2), ["c", "d"]] = np.nan  # alike
    frame.loc[frame["date"] == 1, "e"] = np.nan  # a factor that is nowhere
    frame.loc[(frame["date"] == 2) & (rng.random(n) < 0.3), "a"] = np.nan
    frame = pd.concat([frame, pd.DataFrame({"date": [9] * 5, **{c: range(5) for c in cols}})])  # too few rows
    rows = [(int(d), *[None if np.isnan(v) else float(v) for v in vs]) for d, *vs in frame[["date", *cols]].itertuples(index=False)]
    df = spark.createDataFrame(rows, "date int, a double, b double, c double, d double, e double")
    got = {(r["date"], r["factor_a"], r["factor_b"]): r["corr"] for r in correlation.pair_correlations(df, cols, "spearman", least=30).collect()}
    assert got == pytest.approx(plain_spearman(frame, cols, 30)) and len(got) == 10 + 6 + 10
    classes = {r["date"]: r["classes"] for r in correlation.null_classes(df, cols, least=30).collect()}
    assert classes == {0: [0, 0, 2, 2, 0], 1: [0, 0, 0, 0, 4], 2: [0, 1, 1, 1, 1]}


def test_rows_are_not_multiplied_and_large_dates_go_by_windows(spark):
    rng = np.random.default_rng(2)
    cols = ["a", "b", "c", "d"]
    rows = [(int(d), *[None if rng.random() < 0.2 else float(v) for v in vs]) for d, *vs in np.column_stack([rng.integers(0, 3, 900), rng.integers(0, 9, (900, 4))])]
    rows += [(3, float(i), 1.0, 0.0 * i, float("nan") if i % 2 else float(i)) for i in range(50)] + [(3, None, None, None, None)] * 10 + [(None, 1.0, 2.0, 3.0, 4.0)] * 50
    df = spark.createDataFrame(rows, "date int, a double, b double, c double, d double").repartition(3)
    inside, windows, some = ({tuple(r)[:3]: r["corr"] for r in correlation.pair_correlations(df, cols, "spearman", least=30, cells=n).collect()} for n in (10**9, 0, 1220))
    assert inside == pytest.approx(windows) and some == pytest.approx(windows) and len(windows) == 19 and (3, "a", "d") in windows
    plan = correlation.pair_correlations(df, cols, "spearman", least=30)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan


def test_clusters_of_two_hundred_factors(spark):
    rng = np.random.default_rng(1)
    names, k = [f"f{i:03d}" for i in range(200)], 200
    corr = np.eye(k)
    order = rng.permutation(k)
    for at in range(0, 150, 50):  # three chains of fifty in random order: far from each other by steps
        for i, j in zip(order[at : at + 49], order[at + 1 : at + 50], strict=True):
            corr[i, j] = corr[j, i] = rng.choice([-1, 1]) * rng.uniform(0.71, 0.99)
    rows = [(names[i], names[j], float(corr[i, j])) for i in range(k) for j in range(i + 1, k) if corr[i, j] or rng.random() < 0.1]
    df = spark.createDataFrame(rows, "factor_a string, factor_b string, corr double")
    for priority in (None, {n: float(i % 17) for i, n in enumerate(names) if i % 3}):
        want = {("|".join(g["members"]), g["keep"], g["max_abs_corr"]) for g in correlation.redundancy_clusters(names, corr, priority=priority)}
        assert {tuple(r) for r in correlation.recursive_clusters(df, priority=priority).collect()} == want and len(want) == 3
    assert correlation.recursive_clusters(df, 1.5).count() == 0
