"""Written tables: where they go, and how they are removed."""

from types import SimpleNamespace

import pytest

from strandline.tables import Workspace, shared_dir


def session(master, folder=None):
    made = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: made[-1] if made else None, setCheckpointDir=made.append)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: folder), sparkContext=context)


def test_a_cluster_needs_a_shared_folder():
    assert shared_dir(session("spark://host:7077", "hdfs://all/tmp/")) == "hdfs://all/tmp"
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(session(master))
    one = session("local[4]")
    assert shared_dir(one).startswith("file:///") and shared_dir(one) == shared_dir(one)


def test_tables_are_kept_and_dropped(spark):
    space = Workspace(spark, "test")
    one, two = space.keep(spark.range(3)), space.keep(spark.range(4))
    assert one.count() == 3 and len(space.tables) == 2
    space.drop(one)
    assert two.count() == 4 and len(space.tables) == 1
    space.drop_all_but(two)
    assert two.count() == 4
    space.drop_all_but()
    with pytest.raises(Exception):
        two.count()
