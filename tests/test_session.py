from __future__ import annotations

from types import SimpleNamespace

import pytest

from siftwell.session import shared_folder


def _session(master, checkpoint_dir=None, named=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: checkpoint_dir)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: named or default))


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError):
        shared_folder(_session("spark://host:7077"))
    assert shared_folder(_session("spark://host:7077", named="hdfs:///work")) == "hdfs:///work"
    assert shared_folder(_session("spark://host:7077", checkpoint_dir="hdfs:///c")) == "hdfs:///c"


def test_a_local_session_gets_a_scratch_folder():
    assert shared_folder(_session("local[2]"))
