from types import SimpleNamespace

import pytest

from tracewise.session import Staging, path_exists, shared_dir


def fake(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default: folder or default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(fake("yarn"))
    assert shared_dir(fake("yarn", "hdfs://c/shared/")) == "hdfs://c/shared"
    assert "tracewise-" in shared_dir(fake("local[2]"))


def test_staged_tables_are_read_back_and_removed(spark):
    staging = Staging(spark)
    first = staging.table("t", spark.range(3))
    second = staging.table("t", spark.range(5))
    assert (first.count(), second.count()) == (3, 5)
    staging.close()
    assert not path_exists(spark, staging.root)
