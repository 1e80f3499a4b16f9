"""Session helpers: sizing, lineage cuts, checkpoint folder rules."""

import pytest

from hydroseries import session


def test_recommended_settings():
    s = session.recommended_settings(100 * 1024 ** 4, 8000)
    assert int(s["spark.sql.shuffle.partitions"]) == 409600
    assert session.recommended_settings(10 ** 6, 8)["spark.sql.shuffle.partitions"] == "16"
    assert s["spark.sql.adaptive.enabled"] == "true"


def test_materialize_modes(spark):
    df = spark.range(10)
    assert session.materialize(df, None) is df
    assert session.materialize(df, "checkpoint").count() == 10
    p = session.materialize(df, "persist")
    assert p.count() == 10 and p.is_cached
    p.unpersist()
    with pytest.raises(ValueError):
        session.materialize(df, "local")


def test_checkpoint_dir_is_the_session_setting(spark):
    d = session.checkpoint_dir(spark)
    assert d and d == spark.sparkContext.getCheckpointDir()
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
