"""Base plus late rows equals a full build, and only what depends on the late rows is recomputed."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hydroseries.config import SeriesSpec
from hydroseries.operators import fill, timegrid
from hydroseries.sources import history

T0 = dt.datetime(2024, 1, 1)
SPEC = SeriesSpec(chunk_hours=8)
COLS = ["local_water_level_m", "rain_1h", "dew_point"]
SCHEMA = "site_id string, ts timestamp_ntz, local_water_level_m double, rain_1h double, dew_point double"


def hour(h):
    return T0 + dt.timedelta(hours=h)


def table(spark, rows):
    return spark.createDataFrame([(s, hour(h), *v) for (s, h), v in rows.items()], SCHEMA)


def full(spark, rows):
    dense = timegrid.densify(table(spark, rows), SPEC)
    return sorted(map(tuple, fill.impute_series(dense, COLS, SPEC).select("site_id", "ts", *COLS).collect()))


def stored(spark, path):
    return sorted(map(tuple, history.read(spark, path).select("site_id", "ts", *COLS).collect()))


def close(a, b):
    assert [r[:2] for r in a] == [r[:2] for r in b]
    for x, y in zip(a, b):
        assert x[2:] == pytest.approx(y[2:])


def test_appends_equal_a_full_build(spark, tmp_path):
    r = random.Random(1)
    value = lambda: tuple(None if r.random() < 0.4 else float(r.randrange(20)) for _ in COLS)
    pick = lambda n, lo, hi: {(r.choice("abcde"), r.randrange(lo, hi)): value() for _ in range(n)}
    rows = pick(60, 20, 130)
    path = str(tmp_path / "h")
    history.create(table(spark, rows), path, COLS, SPEC, buckets=3)
    close(stored(spark, path), full(spark, rows))
    for late in (pick(6, 20, 130), pick(3, 100, 180), pick(2, 0, 30), {("new", 5): (1.0, None, None), ("new", 60): (None, 2.0, 3.0)}):
        for _ in range(2 if len(late) == 3 else 1):  # the second run stands for one after a failure
            history.append(spark, path, table(spark, late), COLS, SPEC)
        for k, v in late.items():
            was = rows.get(k, (None,) * len(COLS))
            rows[k] = tuple(n if n is not None else o for n, o in zip(v, was))
        close(stored(spark, path), full(spark, rows))
    assert history.append(spark, path, table(spark, rows).limit(0), COLS, SPEC)["touched"] == 0


def test_only_dependent_chunks_are_recomputed(spark, tmp_path):
    """Two sites of 30 chunks, a value every third hour; a late row inside a chunk reaches one chunk to either side."""
    rows = {(s, h): (float(h), float(h), None) for s in "ab" for h in range(0, 240, 3)}
    path = str(tmp_path / "h")
    history.create(table(spark, rows), path, COLS[:2], SPEC, buckets=4)
    got = history.append(spark, path, table(spark, {("a", 100): (5.0, 5.0, None)}), COLS[:2], SPEC)
    assert got == {"touched": 1, "recomputed": 3, "rows": 24, "partitions": 3}
    # a column without an observation between chunks 0 and 29 reaches over all of them
    sparse = {(s, h): (float(h), 1.0 if h in (0, 237) else None, None) for s in "ab" for h in range(0, 240, 3)}
    history.create(table(spark, sparse), path + "2", COLS[:2], SPEC, buckets=4)
    assert history.append(spark, path + "2", table(spark, {("a", 100): (5.0, 5.0, None)}), COLS[:2], SPEC)["recomputed"] == 30


def test_untouched_partitions_keep_their_files(spark, tmp_path):
    rows = {(s, h): (float(h), 0.0, None) for s in "abcdef" for h in range(64)}
    path = str(tmp_path / "h")
    history.create(table(spark, rows), path, COLS, SPEC, buckets=2)
    files = lambda: {r[0] for r in spark.read.parquet(f"{path}/history").select(F.input_file_name()).distinct().collect()}
    before = files()
    history.append(spark, path, table(spark, {("a", 3): (9.0, 9.0, 9.0)}), COLS, SPEC)
    assert len(before - files()) < len(before) and before & files()
