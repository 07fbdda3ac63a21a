from __future__ import annotations

import os

from tickloom import session


def test_shared_dir_is_the_configured_one(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert session.shared_dir(spark) == configured.rstrip("/")


def test_scratch_paths_are_new_and_can_be_dropped(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    one, two = session.scratch_path(spark, "x"), session.scratch_path(spark, "x")
    assert one != two
    spark.range(3).write.parquet(one)
    assert os.path.exists(one)
    session.drop_scratch(spark)
    assert not os.path.exists(one)
