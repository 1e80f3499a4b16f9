"""As-of join against DuckDB's ASOF JOIN and a plain scan."""

import datetime as dt
import random

import duckdb
import pandas as pd
import pytest

from hydroseries.operators.asof import asof_join

T0 = dt.datetime(2024, 1, 1)


def sides(seed):
    r = random.Random(seed)
    at = lambda: T0 + dt.timedelta(seconds=r.randrange(0, 40) * 3600 + r.choice([0, 0, 1, 1800]))
    left = [(r.choice(["a", "b", "c", None]), at() if r.random() < 0.95 else None, i) for i in range(150)]
    right = [(r.choice(["a", "b", "z", None]), at() if r.random() < 0.95 else None, r.choice([None, 1.0, 2.0, 3.0]), r.choice("xy")) for _ in range(60)]
    return left + left[:5], right + right[:5]


def frames(spark, left, right):
    return (spark.createDataFrame(left, "k string, t timestamp_ntz, n long"),
            spark.createDataFrame(right, "k string, s timestamp_ntz, v double, w string"))


@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("tolerance", [None, 0, 3600, 36_000])
@pytest.mark.parametrize("chunk", [3_600, 7 * 86_400])
def test_equals_a_plain_scan(spark, exact, tolerance, chunk):
    left, right = sides(3)
    lo, ro = frames(spark, left, right)
    got = asof_join(lo, ro, ["k"], "t", ["v", "w"], "s", tolerance, exact, chunk, "at").collect()

    def best(k, t):
        ok = [r for r in right if k is not None and t and r[1] and r[0] == k and (r[1] <= t if exact else r[1] < t)]
        if not ok:
            return (None, None, None)
        m = max(ok, key=lambda r: (r[1], r[2] is not None, r[2] or 0, r[3]))
        return (m[2], m[3], m[1]) if tolerance is None or (t - m[1]).total_seconds() <= tolerance else (None, None, None)
    assert sorted(map(tuple, got), key=str) == sorted([(*r, *best(r[0], r[1])) for r in left], key=str)


def test_equals_asof_join_of_sql(spark):
    left, right = sides(9)
    lo, ro = frames(spark, left, right)
    con = duckdb.connect()
    con.register("l", pd.DataFrame(left, columns=["k", "t", "n"]))
    con.register("r", pd.DataFrame(right, columns=["k", "s", "v", "w"]))
    # DuckDB picks any of several right rows of one time: one is chosen first
    want = con.sql("SELECT l.k, l.t, l.n, u.v FROM l ASOF LEFT JOIN (SELECT k, s, max(v) AS v FROM r WHERE s IS NOT NULL GROUP BY k, s) u "
                   "ON l.k = u.k AND l.t >= u.s").fetchall()
    got = asof_join(lo, ro, ["k"], "t", ["v"], "s").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_empty_sides_and_clash(spark):
    left, right = sides(1)
    lo, ro = frames(spark, left, right)
    assert asof_join(lo.limit(0), ro, ["k"], "t", ["v"], "s").count() == 0
    assert asof_join(lo, ro.limit(0), ["k"], "t", ["v"], "s").filter("v IS NULL").count() == len(left)
    with pytest.raises(ValueError):
        asof_join(lo, ro.withColumnRenamed("v", "n"), ["k"], "t", ["n"], "s")


def test_no_grid_in_the_plan(spark):
    left, right = sides(1)
    lo, ro = frames(spark, left, right)
    plan = asof_join(lo, ro, ["k"], "t", ["v"], "s")._jdf.queryExecution().toString()
    assert "sequence(" not in plan and "explode" not in plan.lower()
