"""Bad documents are set aside with a reason; the same from a stream and after a restart."""

import json

from hydroseries.sources import io

GOOD = {"list": [{"dt": 1704067200 + 3600 * i, "main": {"temp": float(i)}} for i in range(3)]}


def documents():
    text = json.dumps(GOOD)
    typed = json.dumps({"list": [{"dt": 1704067200, "main": {"temp": "warm"}}]})
    rows = [("a", text), ("a", text[:-5]), ("b", "{}"), ("b", None), ("b", ""), ("c", '{"list": []}'), ("c", typed),
            ("c", '{"list": [{"main": {"temp": 1.0}}]}'), ("d", '{"list": {"dt": 1}}'), ("d", "[1, 2"), (None, text), ("a", text)]
    bad = sorted([("a", "corrupt"), ("b", "no list"), ("b", "corrupt"), ("b", "corrupt"), ("c", "corrupt"), ("c", "no time"), ("d", "corrupt"), ("d", "corrupt")])
    return rows, bad, 9


def counted(spark, path):
    bad = io.quarantined(spark, path)
    return sorted((r["site_id"], r["error"]) for r in bad.collect()), io.landed_forecast(spark, path).count(), bad


def test_counts_add_up(spark, tmp_path):
    rows, bad, n_rows = documents()
    df = spark.createDataFrame(rows, "site_id string, doc string")
    io.land_documents(df, str(tmp_path / "t"))
    got, n, table = counted(spark, str(tmp_path / "t"))
    assert (got, n) == (bad, n_rows)
    texts = {r["text"] for r in table.collect()}
    assert None in texts and texts <= {t for _, t in rows}  # the whole text is kept
    assert io.checked_documents(df).count() == len(rows)


def test_stream_equals_batch_also_after_a_restart(spark, tmp_path):
    rows, bad, n_rows = documents()
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for part in (rows[:5], rows[5:]):
        spark.createDataFrame(part, "site_id string, doc string").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("site_id string, doc string").parquet(src)
        io.land_documents_stream(stream, out, ck)
    got, n, _ = counted(spark, out)
    assert (got, n) == (bad, n_rows)
