import datetime as dt
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from hydroseries.session import get_session
    s = get_session("local[4]", app="hydroseries-tests", shuffle_partitions=4, extra={
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="hs-test-ckpt-"),
    })
    s.sparkContext.setLogLevel("ERROR")
    yield s


T0 = dt.datetime(2024, 1, 1)


def hours(n, start=T0):
    return [start + dt.timedelta(hours=i) for i in range(n)]


def series(spark, cols: dict, site="a", start=T0, schema_types=None):
    """A one-site hourly series with the given double columns."""
    n = len(next(iter(cols.values())))
    rows = [(site, t, *[None if v is None else float(v) for v in vals])
            for t, *vals in zip(hours(n, start), *cols.values())]
    schema = "site_id string, ts timestamp_ntz, " + ", ".join(f"{c} double" for c in cols)
    return spark.createDataFrame(rows, schema)


def column(df, name, order="ts"):
    return [r[0] for r in df.orderBy(order).select(name).collect()]
