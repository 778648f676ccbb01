"""Choosing rows, joining lists of text, and the column checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.sources.shared import SMALL_ROWS, settle


def latest_by_key(df: DataFrame, keys: list, order: list[Column]) -> DataFrame:
    """The first row of each key in the given order (state where nulls go). Spark drops the others before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def string_agg_distinct(c: Column, sep: str = ";") -> Column:
    """Distinct values in order, blanks left out; null when nothing is left."""
    return F.nullif(F.array_join(F.array_sort(F.collect_set(F.when(F.trim(c) != "", c))), sep), F.lit(""))


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """Adds the sum of ``value`` (not null) from the first row of a key to each row, in the order of columns that together are unique within a key.

    A key may hold any share of the rows: they are dealt in ranges of key and order, and written; each range is summed by itself, and begins
    with what the ranges before it hold of its key, of which there is a row a key and range.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = settle(df.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()).withColumn("_value", value))
    sums = ranged.groupBy(*keys, "_part").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = settle(sums.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_part").alias("_of"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before")))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)], F.col("_part") == F.col("_of"))
    within = F.sum("_value").over(Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    summed = ranged.withColumn("_within", within).join(F.broadcast(before) if before.count() <= SMALL_ROWS else before, same)
    return summed.withColumn(out, F.col("_before") + F.col("_within")).drop("_part", "_value", "_within", "_of", "_before", *[f"_key{i}" for i in range(len(keys))])


def require_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are all there and not blank."""
    return df.where(reduce(lambda a, b: a & b, [F.trim(F.col(k)) != "" for k in keys]))


def snapshot_filter(df: DataFrame, date: str, load_date: str | None = None) -> DataFrame:
    """The rows of one load date: the given one, else the latest there is."""
    if load_date is not None:
        return df.where(F.col(date) == F.lit(load_date).cast("date"))
    newest = df.agg(F.max(date).alias("_newest"))
    return df.join(F.broadcast(newest), F.col(date) == F.col("_newest")).drop("_newest")  # one row


def check_unique(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).where("n > 1")


def check_not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls of many columns in one pass."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns])


def check_accepted_values(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Values outside the list, with their counts; nulls pass."""
    return df.where(~F.col(column).isin(values)).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def check_relationships(child: DataFrame, child_column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child keys without a parent row."""
    keys = parent.select(F.col(parent_column).alias("_p")).distinct()
    return child.where(F.col(child_column).isNotNull()).join(keys, F.col(child_column) == F.col("_p"), "left_anti").select(F.col(child_column).alias("value")).distinct()


def table_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table by name."""
    parts = [df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)
