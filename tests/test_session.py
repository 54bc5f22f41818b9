"""The shared checkpoint folder: taken from the session, a private one only on a local master."""

import pytest

from carepulse.session import checkpoint_root


class _Context:
    def __init__(self, master, checkpoint_dir=None):
        self.master = master
        self._dir = checkpoint_dir

    def getCheckpointDir(self):
        return self._dir

    def setCheckpointDir(self, d):
        self._dir = d


class _Conf:
    def get(self, key, default=None):
        return default


class _Session:
    def __init__(self, master, checkpoint_dir=None):
        self.sparkContext = _Context(master, checkpoint_dir)
        self.conf = _Conf()


def test_configured_folder_is_used():
    assert checkpoint_root(_Session("yarn", "hdfs://nn/shared/ckpt/")) == "hdfs://nn/shared/ckpt"


def test_cluster_without_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(_Session("spark://host:7077"))


def test_local_master_gets_a_private_folder():
    s = _Session("local[2]")
    root = checkpoint_root(s)
    assert root and s.sparkContext.getCheckpointDir() == root


def test_job_scale_defaults_respect_submitted_settings():
    from carepulse.plans.job import SCALE_DEFAULTS, settings_to_apply

    assert settings_to_apply(set()) == SCALE_DEFAULTS
    mine = settings_to_apply({"spark.sql.files.maxPartitionBytes"})
    assert "spark.sql.files.maxPartitionBytes" not in mine
    assert mine["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] == "20000"


def test_discard_deletes_only_folders_of_a_run(spark):
    from carepulse.session import discard, run_dir

    path = run_dir(spark, "discard-test")
    spark.range(3).write.parquet(path)
    discard(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    for other in ("/tmp/elsewhere", f"{path}/../../other"):
        with pytest.raises(ValueError):
            discard(spark, other)
