from __future__ import annotations

from types import SimpleNamespace

import pytest

from tidewatch.sources import scratch


def test_shared_folder(spark):
    """On a cluster a missing setting is an error; a master within the process has a folder of its own."""
    assert scratch.shared_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="", applicationId="app-1")
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)
    for context.master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch.shared_folder(session)
    for context.master in ("local", "local[4]", "local[*]", "local[4,2]"):
        assert scratch.shared_folder(session).endswith("/tidewatch-app-1")


def test_paths_are_new(spark):
    assert scratch.new_path(spark, "a") != scratch.new_path(spark, "a")
