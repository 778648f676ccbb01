"""Tables written into the folder that all executors share, to cut long plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of so few narrow rows, as counted, may be broadcast.
SMALL_ROWS = 100_000
_own_folder: list[str] = []
#: Where this process writes, in the shared folder.
_RUN = f"riskloom-{uuid.uuid4().hex}"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or (in local mode only) a folder of our own."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append(f"file://{tempfile.mkdtemp(prefix='riskloom-')}")
    return _own_folder[0]


def settle(df: DataFrame) -> DataFrame:
    """Written once and read back: lost executors cost no recomputation, and later plans begin here."""
    path = f"{shared_folder(df.sparkSession)}/{_RUN}/{uuid.uuid4().hex}.parquet"
    df.write.option("compression", "zstd").parquet(path)  # keys are hexadecimal digits, which zstd halves
    return df.sparkSession.read.schema(df.schema).parquet(path)


def proven_small(df: DataFrame) -> DataFrame:
    """Written once, and broadcast if it has few rows, as counted; else joined as Spark sees fit."""
    out = settle(df)
    return F.broadcast(out) if out.count() <= SMALL_ROWS else out


def never_broadcast(df: DataFrame) -> DataFrame:
    """As it is if it has few rows, as counted; else joined by shuffles only: files of well packed columns look small to Spark, but their rows would all pass the driver."""
    return df if df.count() <= SMALL_ROWS else df.hint("merge")


def small_methods(spark: SparkSession) -> None:
    """Lowers (never raises) the size from which a generated method is split, to the one from which the JVM doesn't compile it: rows of many columns would be interpreted."""
    key, most = "spark.sql.codegen.hugeMethodLimit", 8000
    if int(spark.conf.get(key)) > most:
        spark.conf.set(key, str(most))


def sweep(spark: SparkSession) -> None:
    """Deletes all tables that this process has settled: to be called when the results that rest on them are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{_RUN}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
