"""Session helpers: building a local session, and scratch tables that outlive a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster use the session you are given."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("evispark")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a folder of our own only where that is unset."""
    set_by = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_by:
        return set_by.rstrip("/")
    if "local" not in spark.sparkContext.master or "local-cluster" in spark.sparkContext.master:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(scratch_dir, "own", None)
    if own is None:
        own = scratch_dir.own = "file://" + tempfile.mkdtemp(prefix="evispark-")
    return own


def _path(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


class Scratch:
    """Tables written to the shared folder and read back, which cuts their lineage.

    Each write is dropped when the session ends, or earlier by ``drop``."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{scratch_dir(spark)}/evispark-{uuid.uuid4().hex}"
        self.count = 0
        hadoop, fs = _path(spark, self.root)
        fs.mkdirs(hadoop)
        fs.deleteOnExit(hadoop)

    def keep(self, df: DataFrame, file_rows: int = 0) -> DataFrame:
        """The table written and read back, in files of at most ``file_rows`` rows (0: any number)."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.option("maxRecordsPerFile", file_rows).parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._evispark_path = path
        return back

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_evispark_path", None)
        if path:
            hadoop, fs = _path(self.spark, path)
            fs.delete(hadoop, True)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
