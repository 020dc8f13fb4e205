"""Where intermediate results go."""

import pytest

from tickwise import session


class Stub:
    """The parts of a session that decide about the scratch folder."""

    def __init__(self, conf, checkpoint=None):
        self.values, self.conf, self.sparkContext, self.checkpoint = dict(conf), self, self, checkpoint

    def get(self, key, default=None):
        return self.values.get(key, default)

    def set(self, key, value):
        self.values[key] = value

    def getCheckpointDir(self):
        return self.checkpoint


def test_the_shared_folder_is_used():
    stub = Stub({"spark.master": "yarn", session.CHECKPOINT_CONF: "hdfs://shared/tmp"})
    assert session.scratch_dir(stub, "x").startswith("hdfs://shared/tmp/x-")
    assert session.scratch_root(Stub({"spark.master": "yarn"}, "hdfs://other")) == "hdfs://other"


def test_no_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError, match=session.CHECKPOINT_CONF):
        session.scratch_root(Stub({"spark.master": "yarn"}))


def test_no_folder_is_made_up_for_a_local_master():
    with pytest.raises(RuntimeError, match=session.CHECKPOINT_CONF):
        session.scratch_root(Stub({"spark.master": "local[2]"}))
    named = Stub({"spark.master": "local[2]"}, "/shared")
    assert session.scratch_dir(named, "a") != session.scratch_dir(named, "a")


def test_staged_results_come_back_equal(spark):
    df = spark.range(10).selectExpr("id", "array(double(id)) AS v")
    back = session.staged(df, "range")
    assert back.dtypes == df.dtypes
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
