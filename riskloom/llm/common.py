"""What the operators share: cut lineage in the shared folder, Arrow batches, bounded samples."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

_own_folder: list[str] = []
#: Where this process writes, in the shared folder.
_RUN = f"riskloom-{uuid.uuid4().hex}"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``, or (in local mode only) one of our own."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_dir:
        return set_dir
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append(f"file://{tempfile.mkdtemp(prefix='riskloom-')}")
    return _own_folder[0]


def settle(df: DataFrame) -> DataFrame:
    """Writes a table into the shared folder and reads it back, so that lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{_RUN}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Narrow tables (a few numbers a row) of at most so many rows are kept in one partition or broadcast.
SMALL_ROWS = 100_000


def gathered(df: DataFrame) -> DataFrame:
    """A written narrow table, in one partition if it is proven small, so that joins and groups need no exchange."""
    return df.coalesce(1) if df.count() <= SMALL_ROWS else df


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it is proven to have few rows."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def sweep(spark: SparkSession) -> None:
    """Deletes all tables that this process has settled: to be called when the results that rest on them are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{_RUN}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(df: DataFrame) -> None:
    """Deletes a table that ``settle`` wrote; only for one that no later step reads."""
    spark = df.sparkSession
    folder = shared_folder(spark).removeprefix("file://")
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder in parent and parent.endswith(".parquet"):
            path = spark._jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows in an Arrow batch at most: whole texts are long, and a batch is held on both sides of the socket.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers (never raises) the session's rows in an Arrow batch to ``BATCH_ROWS``."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def release() -> None:
    """Gives a worker's freed memory back to the machine: workers outlive their tasks, and several share an executor's limit."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def per_batch(df: DataFrame, worker: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str, most: int = 2000) -> DataFrame:
    """Runs ``worker()`` once a task, and what it returns on each Arrow batch, at most ``most`` rows at a time, as lists by column name.

    What a worker remembers ends with its task.
    """
    small_batches(df.sparkSession)
    parsed: StructType = _parse_datatype_string(schema)  # type: ignore[assignment]
    arrow = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = worker()
        for batch in (whole.slice(at, most) for whole in batches for at in range(0, whole.num_rows, most)):
            out = work(dict(zip(batch.schema.names, (c.to_pylist() for c in batch.columns), strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        del work
        release()

    return df.mapInArrow(run, parsed)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(text: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def hashed_sample(df: DataFrame, key: str, n: int, salt: int = 0) -> DataFrame:
    """At most ``n`` rows, the ones whose hashed key is lowest: the same rows on every run, others with another ``salt``."""
    said = [F.lit("sample"), F.col(key)] + [F.lit(salt)] * (salt != 0)
    return df.orderBy(F.xxhash64(*said), F.col(key)).limit(n)


def fold(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo the number of folds; null ids are in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds, F.lit(0))
