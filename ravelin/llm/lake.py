"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where it is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):  # executors elsewhere would not see a folder of the driver
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        folder = tempfile.mkdtemp(prefix="ravelin-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Bytes of one batch that a Python worker gets: texts are long, and Spark's own limit (64 MB) is meant for numbers.
BATCH_BYTES = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds what workers hold at once, unless the session has a lower bound of its own."""
    size = spark.conf.get(_LIMIT).rstrip("bB")
    if not size.isdigit() or not 0 < int(size) <= BATCH_BYTES:
        spark.conf.set(_LIMIT, str(BATCH_BYTES))


class Scratch:
    """Tables written once and read again: lineage ends there and a lost executor loses nothing."""

    def __init__(self, spark: SparkSession):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/ravelin-{uuid.uuid4().hex}"
        self.names: list[str] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        schema = df.schema
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        self.names.append(name)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.names = [x for x in self.names if x != name]

    def drop_all_but(self, *names: str) -> None:
        """Remove what no result reads any more."""
        for name in [x for x in self.names if x not in names]:
            self.drop(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fits_broadcast(n_rows: int, bytes_per_row: int, limit: int = 32 << 20) -> bool:
    """The size check in front of every broadcast that the input could outgrow."""
    return n_rows * bytes_per_row <= limit
