"""Reading dated snapshots and manifests, lineage, idempotent loads, and writing marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from riskloom.operators.rows import running_sum

MANIFEST = (
    "job_name string, source string, load_date string, status string, files array<struct<source_name:string,dataset_group:string,snapshot_type:string,source_url:string,"
    "data_object_key:string,metadata_object_key:string,downloaded_bytes:bigint,sha256:string,"
    "quality_summary:struct<passed_count:bigint,warning_count:bigint,error_count:bigint,total_count:bigint>,"
    "quality_checks:array<struct<check_name:string,status:string,severity:string>>,status:string,error:string>>"
)


#: Where a row that doesn't fit the schema is kept.
BROKEN = "_broken"


def read_csv_snapshot(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",", multi_line: bool | None = None, broken: bool = False) -> DataFrame:
    """CSV with a header, UTF-8; bad bytes are replaced, values may hold quotes and line breaks, nothing is inferred.

    A file is read by many tasks, unless values hold line breaks: then the file can't be split.  Whether any does is looked for first, unless
    ``multi_line`` says so: a line with an odd number of quotes.  With ``broken``, the column ``_broken`` holds rows that don't
    fit the schema, as they are (null for all others).  Folders such as ``load_date=2024-05-01`` become columns after the schema's.
    """
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    if multi_line is None:
        lines = spark.read.text(path).select(F.length(F.regexp_replace("value", '[^"]', "")).alias("quotes"))
        multi_line = not lines.where("quotes % 2 = 1").isEmpty()
    kind = StructType([*kind.fields, StructField(BROKEN, StringType())]) if broken else kind
    read = spark.read.schema(kind).option("header", True).option("sep", sep).option("multiLine", multi_line).option("escape", '"').option("enforceSchema", broken)
    return (read.option("columnNameOfCorruptRecord", BROKEN) if broken else read).csv(path)


def map_source_columns(df: DataFrame, wanted: dict[str, list[str]], empty_too: bool = False) -> DataFrame:
    """Each target column is the first of its source columns that is present and not null (nor empty, if asked)."""
    def value(name: str) -> Column:
        c = F.col(f"`{name}`").cast("string")
        return F.nullif(F.trim(c), F.lit("")) if empty_too else c

    out = []
    for target, names in wanted.items():
        there = [value(n) for n in names if n in df.columns]
        out.append((F.coalesce(*there) if there else F.lit(None).cast("string")).alias(target))
    return df.select(*out)


def with_lineage(df: DataFrame, object_key: Column, load_date: Column, order: list[str]) -> DataFrame:
    """Adds source_object_key, source_load_date and a row number from 1 within each object, in the order of columns that together are unique within one.

    An object may be of any size: its rows are numbered by ranges, with offsets from the ranges before.
    """
    keyed = df.withColumn("source_object_key", object_key).withColumn("source_load_date", load_date.cast("date"))
    return running_sum(keyed, ["source_object_key"], order, F.lit(1), "row_number").withColumn("row_number", F.col("row_number").cast("int"))


def row_to_json(*cols: str) -> Column:
    """The columns as one JSON text, nulls written out."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def row_hash_sha256(*cols: str) -> Column:
    """Hash of a whole row, keys in order."""
    return F.sha2(row_to_json(*sorted(cols)).cast("binary"), 256)


def replace_by_object(existing: DataFrame, incoming: DataFrame, key: str = "source_object_key") -> DataFrame:
    """The rows of incoming objects replace all earlier rows of these objects."""
    return existing.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def load_objects(incoming: DataFrame, path: str, key: str = "source_object_key") -> None:
    """Loads objects into a table on disk that is partitioned by object: each replaces its own partition, and no other is touched.

    Partitions are replaced only when all rows are written, so a load that breaks off leaves the table as it was, and one that
    is run again changes nothing.  An object's rows may be written by several tasks.
    """
    incoming.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def read_manifests(spark: SparkSession, path: str, one_a_file: bool = True) -> DataFrame:
    """One row per file of each manifest; the load date comes from the path. Manifests are files, or else lines."""
    read = spark.read.schema(MANIFEST).option("multiLine", one_a_file).option("recursiveFileLookup", True).json(path)
    dated = read.withColumn("path_load_date", F.regexp_extract(F.col("_metadata.file_path"), "load_date=([^/]+)", 1))
    return dated.select("job_name", "source", F.col("status").alias("manifest_status"), "path_load_date", F.explode("files").alias("file")).select("*", "file.*").drop("file")


def write_mart(df: DataFrame, path: str, partition_by: list[str] | None = None, not_null: list[str] | None = None, accepted: dict[str, list] | None = None) -> dict[str, int]:
    """Rebuilds a table in full, and counts while it is written: rows, nulls of columns, values outside the accepted ones.

    Returns ``rows``, ``null_<column>`` and ``unexpected_<column>``: the checks need no second scan.
    """
    seen = Observation()
    checks = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in not_null or []]
    checks += [F.count_if(~F.col(c).isin(values)).alias(f"unexpected_{c}") for c, values in (accepted or {}).items()]
    writer = df.observe(seen, F.count("*").alias("rows"), *checks).write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return seen.get


def page_content_hash(pages: DataFrame, known: Column | None = None, keep_body: bool = True) -> DataFrame:
    """SHA-256 of a page's text, or the hash that is known already; with or without the body."""
    own = F.sha2(F.encode(F.col("content"), "UTF-8"), 256)
    out = pages.withColumn("content_hash", own if known is None else F.coalesce(known, own))
    return out if keep_body else out.drop("content")
