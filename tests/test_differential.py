"""Randomised differential tests against pandas (FIXTURES.md section 3), and
chunked = unchunked: 400 hourly rows per site, 35 % nulls, 3 null head rows, a
40-row hole, 30 null tail rows; chunks of 48 hours so every operator crosses
many chunk boundaries (and the hole spans whole chunks)."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from conftest import T0
from hydroseries.config import SeriesSpec
from hydroseries.operators import features, fill

SPECS = {"chunked": SeriesSpec(chunk_hours=48), "unchunked": SeriesSpec(chunk_hours=None),
         "default": SeriesSpec()}


def make(seed: int, n: int = 400) -> pd.Series:
    rng = np.random.default_rng(seed)
    x = rng.normal(1.0, 0.5, n).round(3)
    x[rng.random(n) < 0.35] = np.nan
    x[:3] = np.nan
    x[150:190] = np.nan
    x[-30:] = np.nan
    return pd.Series(x, index=pd.date_range(T0, periods=n, freq="h"))


@pytest.fixture(scope="module")
def data(spark):
    sites = {"a": make(1), "b": make(2, 250)}
    rows = [(s, t.to_pydatetime(), None if np.isnan(v) else float(v))
            for s, ser in sites.items() for t, v in ser.items()]
    # Start site b in the middle of a chunk, so the chunk edges differ by site.
    rows = [(s, t + dt.timedelta(hours=17) if s == "b" else t, v) for s, t, v in rows]
    sites["b"].index = sites["b"].index + pd.Timedelta(hours=17)
    df = spark.createDataFrame(rows, "site_id string, ts timestamp_ntz, x double")
    return df, sites


def collect(df, col):
    pdf = df.select("site_id", "ts", col).toPandas()
    return {s: g.set_index("ts")[col].sort_index() for s, g in pdf.groupby("site_id")}


def check(got, want):
    for s, w in want.items():
        g = got[s].reindex(w.index)
        np.testing.assert_allclose(g.to_numpy(dtype=float), w.to_numpy(dtype=float), rtol=1e-9, atol=1e-12,
                                   equal_nan=True, err_msg=s)


CASES = {
    "ffill": (lambda df, sp: fill.ffill(df, ["x"], sp), lambda s: s.ffill()),
    "ffill24": (lambda df, sp: fill.ffill(df, ["x"], sp, limit=24), lambda s: s.ffill(limit=24)),
    "ffill60": (lambda df, sp: fill.ffill(df, ["x"], sp, limit=60), lambda s: s.ffill(limit=60)),
    "bfill": (lambda df, sp: fill.bfill(df, ["x"], sp), lambda s: s.bfill()),
    "interp_time": (lambda df, sp: fill.interpolate_time(df, ["x"], sp),
                    lambda s: s.interpolate(method="time", limit_area="inside")),
    "interp_linear": (lambda df, sp: fill.interpolate_linear(df, ["x"], sp),
                      lambda s: s.interpolate(method="time", limit_area="inside").ffill().bfill()),
    "impute": (lambda df, sp: fill.impute_series(df.withColumnRenamed("x", "rain_1h"), ["rain_1h"], sp)
               .withColumnRenamed("rain_1h", "x"),
               lambda s: s.interpolate(method="time", limit_direction="both", limit_area="inside")
               .ffill().bfill().fillna(0.0)),
}


@pytest.mark.parametrize("spec", list(SPECS))
@pytest.mark.parametrize("case", list(CASES))
def test_fill_vs_pandas(data, spec, case):
    df, sites = data
    op, ref = CASES[case]
    check(collect(op(df, SPECS[spec]), "x"), {s: ref(v) for s, v in sites.items()})


@pytest.mark.parametrize("spec", list(SPECS))
def test_windows_vs_pandas(data, spec):
    df, sites = data
    sp = SPECS[spec]
    out = features.lags(df, ["x"], 3, sp)
    check(collect(out, "x_lag_3h"), {s: v.shift(3) for s, v in sites.items()})
    out = features.label_level(df.withColumnRenamed("x", "local_water_level_m"), spec=sp)
    check(collect(out, "water_level_next_1h"), {s: v.shift(-1) for s, v in sites.items()})
    for how, fn in (("sum", "sum"), ("avg", "mean"), ("std", "std")):
        out = features.rolling(df, ["x"], [6], how, sp)
        want = {s: getattr(v.rolling(6, min_periods=1), fn)().shift(1) for s, v in sites.items()}
        check(collect(out, f"x_{how}_6h"), want)


def test_build_features_chunked_equals_unchunked(data):
    df, _ = data
    from hydroseries.config import FeatureConfig
    x = fill.impute_series(df.withColumnRenamed("x", "local_water_level_m"), ["local_water_level_m"])
    x = x.withColumn("rain_1h", x["local_water_level_m"] * 2)
    cfg = FeatureConfig(lag_features=("rain_1h", "local_water_level_m"))
    a = features.build_features(x, cfg, SeriesSpec(chunk_hours=48)).orderBy("site_id", "ts").toPandas()
    b = features.build_features(x, cfg, SeriesSpec(chunk_hours=None)).orderBy("site_id", "ts").toPandas()
    pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-12)
    assert len(a) > 0


@pytest.mark.parametrize("keep", [False, True])
def test_densify_union_equals_join(data, keep):
    from hydroseries.operators import timegrid
    df, sites = data
    sparse = df.dropna(subset=["x"])  # missing hours, unique per (site, hour)
    a = timegrid.densify(sparse, SeriesSpec(chunk_hours=48), keep_chunk=keep).drop("_chunk")
    b = timegrid.densify(sparse, SeriesSpec(chunk_hours=None))
    pa = a.orderBy("site_id", "ts").toPandas()
    pb = b.select(*a.columns).orderBy("site_id", "ts").toPandas()
    pd.testing.assert_frame_equal(pa, pb)
    spans = {s: (v.dropna().index.min(), v.dropna().index.max()) for s, v in sites.items()}
    assert len(pa) == sum(int((e - s) / pd.Timedelta(hours=1)) + 1 for s, e in spans.values())


@pytest.mark.parametrize("chunk", [48, 2688])
def test_features_on_partitioned_dense_equal_unchunked(data, chunk):
    """The halo-only shuffle path (input still carries _chunk) equals the
    per-site computation."""
    from hydroseries.config import FeatureConfig
    from hydroseries.operators import timegrid
    df, _ = data
    sparse = df.dropna(subset=["x"]).withColumnRenamed("x", "local_water_level_m")
    sparse = sparse.withColumn("rain_1h", sparse["local_water_level_m"] * 2)
    cfg = FeatureConfig(lag_features=("rain_1h", "local_water_level_m"))
    cols = ["local_water_level_m", "rain_1h"]
    sp = SeriesSpec(chunk_hours=chunk)
    a = features.build_features(
        fill.impute_series(timegrid.densify(sparse, sp, keep_chunk=True), cols, sp), cfg, sp)
    assert "_chunk" not in a.columns
    a = a.orderBy("site_id", "ts").toPandas()
    un = SeriesSpec(chunk_hours=None)
    b = features.build_features(fill.impute_series(timegrid.densify(sparse, un), cols, un), cfg, un)
    b = b.select(*a.columns).orderBy("site_id", "ts").toPandas()
    pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-12)
    assert len(a) > 0
