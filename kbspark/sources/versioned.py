"""A Parquet table whose versions are folders of the shared file system."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``; a temporary folder only in local mode, where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="kbspark-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: what follows neither computes it again nor depends on it."""
    path = shared_path(df.sparkSession, "staged")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kb_path = path
    return out


def restaged(df: DataFrame, *old: DataFrame) -> DataFrame:
    """``staged(df)``, after which tables that only ``df`` still read are deleted: for rounds that replace each other."""
    out = staged(df)
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for table in old:
        path = jvm.org.apache.hadoop.fs.Path(table._kb_path)
        path.getFileSystem(conf).delete(path, True)
    return out


class VersionedTable:
    """Versions 0, 1, ... of one table; a version is written whole and never changed by another."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, rows: DataFrame, version: int) -> None:
        """Writing a version again replaces it."""
        rows.write.mode("overwrite").parquet(f"{self.path}/v{version}")

    def read(self, version: int) -> DataFrame | None:
        """A version's rows, None if there is no such version."""
        if version < 0:
            return None
        try:
            return self.spark.read.parquet(f"{self.path}/v{version}")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def newest(self) -> DataFrame | None:
        """The rows of the last version, None if there is none; versions are found by doubling, then halving."""
        if self.read(0) is None:
            return None
        low, high = 0, 1
        while self.read(high) is not None:
            low, high = high, 2 * high
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if self.read(mid) is not None else (low, mid)
        return self.read(low)
