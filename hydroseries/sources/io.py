"""Sources and sinks (S1, S2, S4, S5, S7; S6 lives in ``operators.learn``).

Every reader declares its schema (no inference), converts NaN to null at the
source, and returns UTC ``TIMESTAMP_NTZ`` times.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydroseries.functions.time import from_epoch, parse_utc, to_utc

# Base hourly series (CSV).
SERIES_SCHEMA = T.StructType([
    T.StructField("site_id", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    *[T.StructField(c, T.DoubleType()) for c in (
        "temperature", "humidity", "pressure", "wind_speed", "rain_1h", "sea_level_m", "local_water_level_m")],
])

# Forecast document: a list of 3-hourly items with nested groups.
FORECAST_ITEM = T.StructType([
    T.StructField("dt", T.LongType()),
    T.StructField("main", T.StructType([T.StructField(c, T.DoubleType()) for c in
                                        ("temp", "humidity", "pressure", "temp_min", "temp_max", "dew_point")])),
    T.StructField("wind", T.StructType([T.StructField("speed", T.DoubleType()),
                                        T.StructField("deg", T.DoubleType())])),
    T.StructField("clouds", T.StructType([T.StructField("all", T.DoubleType())])),
    T.StructField("weather", T.ArrayType(T.StructType([T.StructField("main", T.StringType()),
                                                       T.StructField("description", T.StringType())]))),
    T.StructField("rain", T.StructType([T.StructField("1h", T.DoubleType()), T.StructField("3h", T.DoubleType())])),
    T.StructField("visibility", T.DoubleType()),
])
FORECAST_SCHEMA = T.StructType([T.StructField("site_id", T.StringType()),
                                T.StructField("list", T.ArrayType(FORECAST_ITEM))])


def nan_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Spark has NULL and NaN; the engine keeps only NULL."""
    cols = cols if cols is not None else [f.name for f in df.schema.fields
                                          if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(F.isnan(c), None).otherwise(F.col(c)) for c in cols})


def read_series(spark: SparkSession, path: str, schema: T.StructType = SERIES_SCHEMA,
                tz: str = "Asia/Bangkok", ts_col: str = "timestamp",
                fmt: str | None = None) -> DataFrame:
    """CSV with a header.  Texts with an offset are instants; naive
    texts are local times of ``tz``.  Output ``ts`` is UTC wall time."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    text = F.col(ts_col)
    has_zone = text.rlike(r"(Z|[+-]\d\d:?\d\d)$")
    aware = F.to_timestamp(text).cast("timestamp_ntz")  # session zone is UTC
    naive = to_utc(parse_utc(text, fmt), tz)
    out = df.withColumn("ts", F.when(has_zone, aware).otherwise(naive)).drop(ts_col)
    return nan_to_null(out)


def flatten_forecast(docs: DataFrame, keys: Sequence[str] = ("site_id",), list_col: str = "list",
                     extras: bool = False) -> DataFrame:
    """S2 + C7: one row per list item; rain 1h / 3h default to 0.0; the first
    weather entry or null; epoch seconds become UTC time.  ``extras`` (D6)
    also keeps the optional ``temp_min, temp_max, dew_point, visibility,
    cloud_cover`` fields (null where a document lacks them)."""
    it = docs.select(*keys, F.explode(list_col).alias("i"))
    i = F.col("i")
    w0 = F.get(i.getField("weather"), 0)
    more = []
    if extras:
        more = [i.getField("main").getField("temp_min").alias("temp_min"),
                i.getField("main").getField("temp_max").alias("temp_max"),
                i.getField("main").getField("dew_point").alias("dew_point"),
                i.getField("visibility").alias("visibility"),
                i.getField("clouds").getField("all").alias("cloud_cover")]
    return it.select(
        *keys,
        from_epoch(i.getField("dt")).alias("ts"),
        i.getField("main").getField("temp").alias("temperature"),
        i.getField("main").getField("humidity").alias("humidity"),
        i.getField("main").getField("pressure").alias("pressure"),
        i.getField("wind").getField("speed").alias("wind_speed"),
        i.getField("wind").getField("deg").alias("wind_deg"),
        i.getField("clouds").getField("all").alias("clouds_all"),
        w0.getField("main").alias("weather_main"),
        w0.getField("description").alias("weather_description"),
        F.coalesce(i.getField("rain").getField("1h"), F.lit(0.0)).alias("rain_1h"),
        F.coalesce(i.getField("rain").getField("3h"), F.lit(0.0)).alias("rain_3h"),
        *more,
    )


def parse_forecast(df: DataFrame, text: str | Column = "doc", keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """S2 for JSON texts held in a column."""
    doc = F.from_json(F.col(text) if isinstance(text, str) else text, T.StructType([FORECAST_SCHEMA["list"]]))
    return flatten_forecast(df.select(*keys, doc.alias("_d")).select(*keys, "_d.list"), keys)


def read_forecast(spark: SparkSession, path: str, multiline: bool = True, extras: bool = False) -> DataFrame:
    """S2 for landed files: one document per file (``multiLine``) or per line."""
    docs = spark.read.schema(FORECAST_SCHEMA).option("multiLine", multiline).json(path)
    return flatten_forecast(docs, extras=extras)


def checked_documents(df: DataFrame, text: str | Column = "doc", keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """S2 with the bad documents kept apart: ``keys, text, doc, error``.

    ``error`` is null for a document that can be flattened, else ``corrupt`` (no JSON, cut off,
    or a field of another type), ``no list`` or ``no time`` (an item without ``dt``).
    Works on batches and streams alike."""
    text = F.col(text) if isinstance(text, str) else text
    bad = "_corrupt"
    schema = T.StructType([FORECAST_SCHEMA["list"], T.StructField(bad, T.StringType())])
    doc = F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})
    x = df.select(*keys, text.alias("text"), doc.alias("doc"))
    items = F.col("doc.list")
    error = (F.when(F.col("text").isNull() | F.col(f"doc.{bad}").isNotNull() | F.col("doc").isNull(), "corrupt")
              .when(items.isNull(), "no list")
              .when(F.exists(items, lambda i: i.getField("dt").isNull()), "no time"))
    return x.withColumn("error", error).withColumn("doc", F.col("doc").dropFields(bad))


def land_documents(df: DataFrame, path: str, text: str | Column = "doc", keys: Sequence[str] = ("site_id",),
                   mode: str = "append") -> None:
    """Store checked documents in one pass, good and bad ones in folders of their own."""
    out = checked_documents(df, text, keys)
    out.withColumn("state", _state()).write.mode(mode).partitionBy("state").parquet(path)


def _state() -> Column:
    return F.when(F.col("error").isNull(), "good").otherwise("quarantined")


def land_documents_stream(stream: DataFrame, path: str, checkpoint: str, text: str | Column = "doc",
                          keys: Sequence[str] = ("site_id",)) -> None:
    """The same for a stream of texts, to the end of what is there; a restart goes on where it stopped."""
    out = checked_documents(stream, text, keys).withColumn("state", _state())
    (out.writeStream.format("parquet").outputMode("append").partitionBy("state")
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination())


def landed_forecast(spark: SparkSession, path: str, keys: Sequence[str] = ("site_id",), extras: bool = False) -> DataFrame:
    """Rows of the good documents (only their folder is read)."""
    good = spark.read.parquet(path).filter("state = 'good'")
    return flatten_forecast(good.select(*keys, "doc.list"), keys, extras=extras)


def quarantined(spark: SparkSession, path: str, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """``keys, text, error`` of the documents set aside."""
    return spark.read.parquet(path).filter("state = 'quarantined'").select(*keys, "text", "error")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
                mode: str = "overwrite") -> None:
    """Write a table, optionally partitioned (e.g. by date)."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True)
    w.save(path)


def save_scaler(scaler: DataFrame, path: str) -> None:
    """The scaler table ``(ordinal, feature, min, max)`` — one small file."""
    scaler.coalesce(1).write.mode("overwrite").parquet(path)


def load_scaler(spark: SparkSession, path: str) -> DataFrame:
    from pyspark.errors import AnalysisException
    try:
        return spark.read.parquet(path).orderBy("ordinal")
    except AnalysisException as e:
        raise FileNotFoundError(f"scaler not found at {path}; train first") from e


def write_predictions(df: DataFrame, path: str, fmt: str = "json", mode: str = "append") -> None:
    """Prediction records."""
    df.write.mode(mode).format(fmt).save(path)
