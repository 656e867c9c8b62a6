"""Tables written to the shared folder, to cut lineage.

A staged table is written once as Parquet below the folder that the cluster
names in ``spark.checkpoint.dir`` and read back. A lost executor then costs the
tasks that it ran, not the lineage behind the table, and a column that depends
on task ids is computed once only.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_DEFAULT = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, or on one machine a local one.

    On a cluster without ``spark.checkpoint.dir`` there is no folder that all
    executors see, so this raises instead of guessing one.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if conf.get("spark.master", "local").startswith("local"):
        return LOCAL_DEFAULT
    raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")


def application_dir(spark: SparkSession) -> str:
    """The application's own folder below the shared one; it is deleted when the driver ends."""
    name = f"{shared_dir(spark)}/corpusflow-{spark.sparkContext.applicationId}"
    if name not in _AT_EXIT:
        _AT_EXIT.add(name)
        atexit.register(_delete_quietly, spark, name)
    return name


#: Folders that the end of this process deletes.
_AT_EXIT: set[str] = set()


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _delete_quietly(spark: SparkSession, name: str) -> None:
    with contextlib.suppress(Exception):  # the context may be stopped by now
        _delete(spark, name)


class Staging:
    """Staged tables of one computation.

    ``clear()`` deletes them when their readers are done, as leaving a ``with``
    block does; what is not cleared goes with the application's folder.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{application_dir(spark)}/{uuid.uuid4().hex}"
        self.count = 0

    def __enter__(self) -> Staging:
        return self

    def __exit__(self, *_) -> None:
        self.clear()

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and read it back with the same columns."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        _delete(self.spark, self.root)
        self.count = 0
