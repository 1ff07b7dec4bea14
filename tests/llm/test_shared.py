"""Where the training-data operators write their tables."""

from types import SimpleNamespace

import pytest

from plinth.llm import shared


def session(master, **settings):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, default=None: settings.get(k, default), set=settings.__setitem__), sparkContext=SimpleNamespace(master=master))


def test_no_local_folder_on_a_cluster():
    for master in ("spark://host:7077", "yarn", "k8s://host", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared.scratch(session(master), "t")
    named = session("yarn", **{"spark.checkpoint.dir": "hdfs:///shared/"})
    assert shared.scratch(named, "t").startswith("hdfs:///shared/t-")


def test_one_machine_sets_its_folder_once():
    for master in ("local", "local[4]", "local[*]"):
        own = session(master)
        first, second = shared.scratch(own, "t"), shared.scratch(own, "t")
        assert first.startswith("file:///tmp/spark-") and first != second and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]
