import os

import pytest
from pyspark.sql import functions as F

from histospark import runtime


class Cluster:
    """As much of a session as the choice of the shared folder looks at."""

    def __init__(self, master, folder=None):
        self.sparkContext = type("Context", (), {"master": master})
        self.conf = type("Conf", (), {"get": lambda _, key, default=None: folder})()


def test_shared_folder():
    assert runtime.shared_dir(Cluster("yarn", "hdfs://x/shared/")) == "hdfs://x/shared"
    for master in ("yarn", "local-cluster[3,2,3000]", "spark://h:7077", "k8s://h"):
        with pytest.raises(RuntimeError):
            runtime.shared_dir(Cluster(master))
    for master in ("local", "local[4]", "local[*]"):
        assert runtime.shared_dir(Cluster(master)).startswith("file:///")


def test_staging(spark):
    keep = runtime.stage(spark.range(3))
    with runtime.staging():
        df, seen = runtime.stage_observed(spark.range(10), n=F.count("*"), top=F.max("id"))
        assert df.count() == 10 and seen == {"n": 10, "top": 9}
        path = df.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path) and keep.count() == 3


def test_guards(spark):
    df = spark.createDataFrame([(1.0, 0.0), (float("nan"), 2.0), (float("inf"), 4.0), (None, 1.0)], "a double, b double")
    assert [r.o for r in df.select(runtime.over(F.col("a"), F.col("b")).alias("o")).collect()][0] is None
    assert df.where(runtime.finite(F.col("a")).isNotNull()).count() == 1
