"""transformWithState: equal to the native hourly stream, state of sealed hours is gone, restart."""

import datetime as dt
import random

from pyspark.sql import functions as F

from hydroseries.plans import staging
from hydroseries.streaming import hourly as H
from hydroseries.streaming import stateful

T0 = dt.datetime(2024, 3, 1)
SCHEMA = "event_type string, ts timestamp_ntz, value double, props string"


def readings(seed, first, last):
    r = random.Random(seed)
    return [("hot" if r.random() < 0.8 else r.choice("ab"), T0 + dt.timedelta(minutes=r.randrange(first * 60, last * 60)),
             None if r.random() < 0.1 else float(r.randrange(200)), r.choice(['{"k": 3}', '{"k": "x"}', None, "{"])) for _ in range(400)]


def run(spark, path, name, build):
    stream = spark.readStream.schema(SCHEMA).parquet(f"{path}/in")
    H.run_available_now(build(stream), f"{path}/{name}", f"{path}/{name}-ck")
    rows = spark.read.parquet(f"{path}/{name}").collect()
    return sorted((r["site_id"], r["ts"], *[None if r[c] is None else round(r[c], 9) for c in staging.OBS_COLS]) for r in rows)


def test_equals_native_stream_and_leaves_open_hours_only(spark, tmp_path):
    path = str(tmp_path)
    native = lambda s: H.hourly_stream(s, staging.obs_aggs(), F.col("event_type"))
    salted = lambda s: stateful.hourly_stream_salted(s, F.col("event_type"), salts=4)
    seen = 0
    with stateful.rocksdb_state(spark):
        for rows in (readings(1, 0, 20), readings(2, 18, 40), [("late", T0 + dt.timedelta(hours=100), 1.0, None)]):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
            got = run(spark, path, "salted", salted)
            assert got == run(spark, path, "native", native) and len(got) > seen
            seen = len(got)
        state = (spark.read.format("statestore").option("operatorId", 1).option("stateVarName", "hours").load(f"{path}/salted-ck"))
        left = state.select("key.site_id").distinct().collect()
    assert [r[0] for r in left] == ["late"]  # every sealed hour is gone, dead sites with them
