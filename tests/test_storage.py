"""Tables that operators write on the way."""

from __future__ import annotations

import os
from types import SimpleNamespace

import pytest

from factloom import storage


def test_written_tables_can_be_dropped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "_WRITTEN", storage.defaultdict(list))
    monkeypatch.setattr(storage, "shared_folder", lambda _: f"file://{tmp_path}")
    kept = storage.materialize(spark.range(5), "a")
    assert kept.count() == 5 and storage.materialize(spark.range(3), "b").count() == 3
    assert len(os.listdir(tmp_path / "factloom")) == 2
    assert storage.drop_written(spark) == 2 and os.listdir(tmp_path / "factloom") == [] and storage.drop_written(spark) == 0


def session_like(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master, applicationId="app-of-a-test"))


def test_the_setting_comes_first_and_a_cluster_needs_it():
    assert storage.shared_folder(session_like("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_folder(session_like("spark://h"))
    own = storage.shared_folder(session_like("local[2]"))
    assert own.startswith("file:///tmp/spark-") and storage.shared_folder(session_like("local[2]")) == own
