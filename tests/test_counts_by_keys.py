"""Tables of a row a key are counted by their keys."""

from pyspark.sql import functions as F

from riskloom.operators import sanctions as S
from riskloom.plans.catalog import QUERIES, Inputs

SF = "/root/testdata/sf0.001"


def test_counts_are_those_of_the_tables_and_nothing_is_picked_for_them(spark):
    i = Inputs(spark, SF)
    want = {"candidates": i.candidates.count(), "subjects": i.subjects.count(), "names": i.names.count(), "edges": i.edges.count()}
    df = QUERIES["table_row_counts"](spark, SF)
    assert {r["table_name"]: r["row_count"] for r in df.collect()} == want and min(want.values()) > 100
    assert "hashpartitioning(subject_key" not in df.where("table_name = 'names'")._jdf.queryExecution().executedPlan().toString()


def test_keys_of_names_that_are_null_or_of_several_rows(spark):
    fsf = spark.createDataFrame([(1, "a", "k", "x"), (2, "a", "k", "y"), (3, "a", "l", None), (4, "b", "m", None), (5, "c", "k", "x"), (6, "c", None, "z")], "raw_id long, subject_key string, name_key string, name_normalized string")
    fsf = fsf.withColumns({"source_load_date": F.lit("2024-05-01"), "publication_date": F.lit(None).cast("string")})
    keys = S.listed_keys(fsf.where("name_key is not null"))
    assert keys.where("name_key is not null").count() == S.canonical_fsf_name(fsf.where("name_key is not null")).count() == 2
    assert keys.select("subject_key").distinct().count() == S.canonical_fsf_subject(fsf).count() == 3
