"""Merge of two live feeds: equal to the batch merge on sealed hours, also after a restart."""

import datetime as dt
import random

from pyspark.sql import functions as F

from hydroseries.streaming import hourly as H
from hydroseries.streaming.combine import Feed, combined_hourly_stream

T0 = dt.datetime(2024, 3, 1)
SCHEMA = "site string, ts timestamp_ntz, v double, w double"


def readings(seed, first, last):
    r = random.Random(seed)
    return [(r.choice("abc"), T0 + dt.timedelta(minutes=r.randrange(first * 60, last * 60)), float(r.randrange(50)), float(r.randrange(9)))
            for _ in range(300)]


def expected(a, b, allowance=5):
    """Hour -> values by hand: v of feed a before b, w of feed b over a."""
    def hourly(rows):
        out = {}
        for s, t, v, w in rows:
            out.setdefault((s, t.replace(minute=0)), []).append((v, w))
        return {k: (sum(x[0] for x in g) / len(g), max(x[1] for x in g)) for k, g in out.items()}
    ha, hb = hourly(a), hourly(b)
    end = min(max(r[1] for r in a), max(r[1] for r in b)) - dt.timedelta(hours=allowance)
    got = {}
    for k in ha.keys() | hb.keys():
        if k[1] + dt.timedelta(hours=1) <= end:
            x, y = ha.get(k), hb.get(k)
            got[k] = (x[0] if x else y[0], y[1] if y else x[1])
    return got


def run(spark, tmp_path):
    def feed(name, how, cols):
        aggs = {"v": F.avg("v"), "w": F.max("w")}
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / name))
        return Feed(stream, {c: aggs[c] for c in cols}, F.col("site"), how)
    out = combined_hourly_stream([feed("a", "attach", ["v", "w"]), feed("b", "upsert", ["w"]), feed("b", "fill", ["v"])])
    H.run_available_now(out, str(tmp_path / "sink"), str(tmp_path / "ck"))
    rows = spark.read.parquet(str(tmp_path / "sink")).collect()
    got = {(r["site_id"], r["ts"]): (r["v"], r["w"]) for r in rows}
    assert len(got) == len(rows)  # no hour comes twice
    return got


def test_equals_batch_merge_before_and_after_a_restart(spark, tmp_path):
    # feed b is silent for hours 10 to 20 and ends before feed a
    a1, a2 = readings(1, 0, 30), readings(2, 30, 60)
    b1, b2 = readings(3, 0, 10) + readings(4, 20, 27), readings(5, 27, 55)
    write = lambda rows, name: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    write(a1, "a")
    write(b1, "b")
    got = run(spark, tmp_path)
    assert got == expected(a1, b1) and any(k[1] == T0 + dt.timedelta(hours=15) for k in got)
    write(a2, "a")
    write(b2, "b")
    assert run(spark, tmp_path) == expected(a1 + a2, b1 + b2)
