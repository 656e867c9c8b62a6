from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusflow.plans import staging as S


def test_tables_are_written_once_and_cleared(spark):
    with S.Staging(spark) as own:
        table = own.table(spark.range(5).withColumn("r", F.rand()), "t")
        assert table.collect() == table.collect() and table.columns == ["id", "r"]
        root = Path(own.root)
        assert root.exists() and root.parent.name == f"corpusflow-{spark.sparkContext.applicationId}"
    assert not root.exists()
    one, two = S.Staging(spark), S.Staging(spark)
    kept = two.table(spark.range(3), "t")
    one.table(spark.range(3), "t")
    one.clear()
    assert kept.count() == 3
    two.clear()


def test_a_cluster_must_name_a_shared_folder(monkeypatch, spark):
    class Conf:
        def __init__(self, **values):
            self.values = {k.replace("_", "."): v for k, v in values.items()}

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Session:
        def __init__(self, conf):
            self.sparkContext = self
            self.getConf = lambda: conf

    assert S.shared_dir(Session(Conf(spark_checkpoint_dir="hdfs://x/y/", spark_master="yarn"))) == "hdfs://x/y"
    assert S.shared_dir(Session(Conf(spark_master="local[2]"))) == S.LOCAL_DEFAULT
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        S.shared_dir(Session(Conf(spark_master="spark://a:1")))
