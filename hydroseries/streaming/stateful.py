"""T3 with explicit state: the hourly series by ``transformWithState``.

Keys have two levels, (site, salt): the readings of one hot site spread over
``salts`` state machines, each keeping the partial sums of its open hours in
a map state and giving them out by an event-time timer when the watermark
passes the hour's end; a native aggregate adds up the salts.  An hour's entry
is deleted when its timer fires, so a dead site leaves no state.

The state store must be RocksDB (``rocksdb_state`` sets it for queries started inside)."""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR_MS = 3_600_000
SUMS = ["n", "v_sum", "r_sum", "k_sum", "k_n"]
PARTIAL = "site_id string, salt int, t_end timestamp, " + ", ".join(f"{c} double" for c in SUMS)


@contextlib.contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; the session's setting is put back."""
    old = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if old is None else spark.conf.set(PROVIDER, old)


def _processor():
    """The state machine; built in a function so that it ships by value to executors without this package."""
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor
    sums, hour_ms = list(SUMS), HOUR_MS
    value = T.StructType([T.StructField(c, T.DoubleType()) for c in sums])

    class HourSums(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.hours = handle.getMapState("hours", T.StructType([T.StructField("h", T.LongType())]), value)

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd
            sealed = timerValues.getCurrentWatermarkInMs() // hour_ms
            for pdf in rows:
                # hours that the watermark has passed were given out: their late readings are dropped
                pdf = pdf[pdf["h"] >= sealed]
                for row in pdf.groupby("h")[sums].sum().reset_index().itertuples(index=False):
                    h, new = (int(row[0]),), [float(x) for x in row[1:]]
                    if self.hours.containsKey(h):
                        new = [a + b for a, b in zip(self.hours.getValue(h), new)]
                    else:
                        self.handle.registerTimer((h[0] + 1) * hour_ms)
                    self.hours.updateValue(h, tuple(new))
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            import pandas as pd
            end = expiredTimerInfo.getExpiryTimeInMs()
            h = (end // hour_ms - 1,)
            got = list(self.hours.getValue(h))
            self.hours.removeKey(h)
            yield pd.DataFrame({"site_id": [key[0]], "salt": [key[1]], "t_end": [pd.Timestamp(end, unit="ms")],
                                **{c: [x] for c, x in zip(sums, got)}})

        def close(self):
            pass
    return HourSums()


def hourly_stream_salted(stream: DataFrame, key: Column, ts: str = "ts", value: str = "value", props: str = "props",
                         late: str = "5 hours", salts: int = 8) -> DataFrame:
    """``site_id, ts, local_water_level_m, rain_1h, humidity`` per sealed hour, equal to T1's.

    Per-row work (JSON field, rain excess, hour, salt) stays in JVM expressions;
    the Python side adds up sums per (site, salt, hour)."""
    import sys

    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    s = stream.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    v, k = F.col(value), F.get_json_object(props, "$.k").try_cast("double")
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    rows = s.select(key.alias("site_id"), F.pmod(F.xxhash64("_t", v, props), F.lit(salts)).cast("int").alias("salt"), "_t",
                    F.floor(F.unix_millis("_t") / HOUR_MS).cast("long").alias("h"),
                    one(v.isNotNull()).alias("n"), F.coalesce(v.cast("double"), F.lit(0.0)).alias("v_sum"),
                    F.coalesce(F.greatest(v - 100.0, F.lit(0.0)), F.lit(0.0)).alias("r_sum"),
                    F.coalesce(k, F.lit(0.0)).alias("k_sum"), one(k.isNotNull()).alias("k_n"))
    partial = rows.groupBy("site_id", "salt").transformWithStateInPandas(
        _processor(), T.StructType.fromDDL(PARTIAL), "append", "EventTime", eventTimeColumnName="t_end")
    # an hour comes out when the watermark passes its end, so grouping by that end seals at once
    out = partial.groupBy("t_end", "site_id").agg(*[F.sum(c).alias(c) for c in SUMS])
    mean = lambda a, n: F.when(F.col(n) > 0, F.col(a) / F.col(n))
    return out.select("site_id", (F.col("t_end") - F.expr("INTERVAL 1 HOUR")).cast("timestamp_ntz").alias("ts"),
                      (mean("v_sum", "n") / 40.0).alias("local_water_level_m"), (F.col("r_sum") / 10.0).alias("rain_1h"),
                      mean("k_sum", "k_n").alias("humidity"))
