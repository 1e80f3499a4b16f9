"""Distributed exact quantiles, ROC AUC and time split against brute force,
including a hot group holding most rows and heavy ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydroseries.operators import evaluate, split, stats


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    rows = [("hot", float(v)) for v in rng.integers(0, 300, 3000)]          # many ties
    rows += [("warm", float(v)) for v in rng.normal(0, 1, 400)]
    rows += [("one", 5.0), ("two", 1.0), ("two", 2.0)]
    return spark.createDataFrame(rows, "g string, v double"), rows


@pytest.mark.parametrize("buckets", [None, 1, 3, 64, 1000])
def test_exact_quantiles(skewed, buckets):
    df, rows = skewed
    qs = {"q1": 0.25, "med": 0.5, "q3": 0.75, "p9": 0.9}
    got = {r["g"]: r for r in stats.exact_quantiles(df, ["g"], "v", qs, buckets=buckets).collect()}
    for g in {r[0] for r in rows}:
        vals = np.array([v for k, v in rows if k == g])
        for name, q in qs.items():
            assert got[g][name] == pytest.approx(np.quantile(vals, q), rel=1e-12, abs=1e-12), (g, name)


def test_global_quantile(skewed):
    df, rows = skewed
    got = stats.exact_quantiles(df, [], "v", {"m": 0.5}).collect()[0]["m"]
    assert got == pytest.approx(np.median([v for _, v in rows]))


def brute_auc(y, s):
    pos = [b for a, b in zip(y, s) if a == 1]
    neg = [b for a, b in zip(y, s) if a == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


@pytest.mark.parametrize("buckets", [1, 5, 256])
def test_roc_auc_with_ties(spark, buckets):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 500).tolist()
    s = [round(float(v), 1) for v in rng.random(500) + 0.3 * np.array(y)]
    df = spark.createDataFrame(list(zip(y, s)), "label int, score double")
    got = evaluate.roc_auc(df, "label", "score", buckets=buckets).collect()[0]["roc_auc"]
    assert got == pytest.approx(brute_auc(y, s), rel=1e-12)


def test_roc_auc_one_class(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "label int, score double")
    assert evaluate.roc_auc(df).collect()[0]["roc_auc"] is None


def test_report_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "label int, prediction int")
    rep = {r["class"]: r for r in evaluate.classification_report(df).collect()}
    assert rep["1"]["precision"] == 0.0 and rep["1"]["recall"] == 0.0 and rep["1"]["support"] == 1
    assert rep["0"]["precision"] == pytest.approx(2 / 3) and rep["0"]["recall"] == 1.0
    cm = {(r["actual"], r["predicted"]): r["n"] for r in evaluate.confusion_matrix(df).collect()}
    assert cm == {(0, 0): 2, (0, 1): 0, (1, 0): 1, (1, 1): 0}


@pytest.mark.parametrize("n", [1, 7, 10, 101])
def test_time_split_positional(spark, n):
    import datetime as dt
    rows = [("a", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)) for i in range(n)]
    rows += [("b", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)) for i in range(3 * n)]
    df = spark.createDataFrame(rows, "site_id string, ts timestamp_ntz")
    out = split.time_split(df, "ts", ["site_id"], 0.2, 0.2, buckets=4).orderBy("site_id", "ts").collect()
    for site, m in (("a", n), ("b", 3 * n)):
        got = [r["split"] for r in out if r["site_id"] == site]
        trval = int(m * (1 - 0.2))
        train = int(trval * (1 - 0.2))
        assert got == ["train"] * train + ["val"] * (trval - train) + ["test"] * (m - trval)


def test_column_stats_and_null_profile(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 3.0, 2.0), ("a", None, 4.0), ("b", 5.0, None)],
                               "site_id string, x double, y double")
    st = {(r["site_id"], r["column"]): (r["mean"], r["median"]) for r in stats.column_stats(df, ["x", "y"]).collect()}
    assert st[("a", "x")] == (2.0, 2.0) and st[("a", "y")] == (3.0, 3.0) and st[("b", "y")] == (None, None)
    prof = {r["site_id"]: (r["n_rows"], r["x_nulls"], r["y_nulls"]) for r in stats.null_profile(df, ["x", "y"]).collect()}
    assert prof == {"a": (3, 1, 1), "b": (1, 0, 1)}


def test_latest(spark):
    import datetime as dt
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, h), float(h)) for h in range(5)],
                               "site_id string, ts timestamp_ntz, x double")
    r = split.latest(df).collect()[0]
    assert r["ts"].hour == 4 and r["x"] == 4.0
    assert set(split.latest(df).columns) == {"site_id", "ts", "x"}
    assert split.latest(df.withColumn("y", F.lit(1))).count() == 1
