"""Shared steps of the matches carry what is needed, and give the same rows as the wide ones."""

import pytest
from pyspark.sql import functions as F

from riskloom.operators import sanctions as S
from riskloom.plans.catalog import QUERIES, Inputs
from riskloom.sources import shared

SF = "/root/testdata/sf0.001"


def rows(df, columns):
    return sorted(map(repr, df.select(*columns).collect()))


def test_names_of_organizations_are_the_same(spark):
    i = Inputs(spark, SF)
    whole = S.organization_names(i.names).drop("sanctions_entity_type")
    assert rows(i.organizations, sorted(whole.columns)) == rows(whole, sorted(whole.columns)) and whole.count() > 100


def test_a_subject_of_another_type_later_is_left_out_whole(spark):
    """The type is the latest row's, so names from earlier rows of another type go with it."""
    row = lambda n, day, kind, subject, name: (n, day, day, subject, kind, None, "P", "t", "x", name, name, name)
    fsf = spark.createDataFrame([row(1, "2024-05-01", "enterprise", "a", "one"), row(2, "2024-05-02", "person", "a", "two"), row(3, "2024-05-01", "person", "b", "three"), row(4, "2024-05-02", "enterprise", "b", "four")],
                                "raw_id long, source_load_date string, publication_date string, subject_key string, subject_type string, eu_reference_number string, programme string, regulation_type string, regulation_title string, name_key string, whole_name string, name_normalized string")
    targets = Inputs(spark, SF).targets.where("false")
    subjects = S.unify_subjects(S.canonical_plus_rollup(S.canonical_fsf_subject(fsf), S.fsf_subject_rollup(fsf, {}), ["subject_key"]), targets)
    assert [tuple(r) for r in S.names_of_organizations(fsf, targets, subjects).select("source_subject_id", "sanctions_name").orderBy("sanctions_name").collect()] == [("b", "four"), ("b", "three")]


def test_listed_columns_alone_are_written(spark):
    assert Inputs(spark, SF).fsf.columns == list(S.LISTED)


@pytest.mark.parametrize("name", ["risk_score", "search_entities"])
def test_scores_without_parents_read_no_relations(spark, name):
    files = QUERIES[name](spark, SF).inputFiles()
    i = Inputs(spark, SF)
    assert "raw_relationships" not in i._made and rows(i.scored, ["lei", "risk_score", "match_tier_summary"]) and "raw_relationships" not in i._made
    assert files and not [f for f in files if "orders" in f]


def test_few_keys_are_proven_and_spare_shuffles_of_the_subjects(spark):
    """Even where Spark itself would broadcast nothing, the wide side isn't shuffled to meet counts of a few keys."""
    key, was = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")
    try:
        i = Inputs(spark, SF)
        plan = S.class_rows(*i.sides).where("record = 'subject'")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set(key, was)


def test_more_keys_than_are_proven_small_give_the_same(spark, monkeypatch):
    few = rows(Inputs(spark, SF).scored, ["lei", "risk_score", "match_tier_summary"])
    monkeypatch.setattr(shared, "SMALL_ROWS", 0)
    assert rows(Inputs(spark, SF).scored, ["lei", "risk_score", "match_tier_summary"]) == few


def test_names_alike_are_counted_together(spark):
    i = Inputs(spark, SF)
    want = S.sanctions_summary(S.screening_view(S.graded_matches(i.candidates, i.names, i.subjects)))
    columns = [c for c in want.columns if c != "source_entity_keys"]
    got = S.sanctions_summary_classes(*i.summed_sides)
    assert rows(got, columns) == rows(want, columns) and got.agg(F.sum("total_sanctions_match_count")).first()[0] > 100
