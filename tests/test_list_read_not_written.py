"""The EU list is read for subjects and for names, each in one pass, and no copy of its rows is written for the matches."""

import pytest

from riskloom.operators import sanctions as S
from riskloom.plans import catalog
from riskloom.plans.catalog import QUERIES, Inputs
from riskloom.sources import shared

SF = "/root/testdata/sf0.001"


def rows(df, columns):
    return sorted(map(repr, df.select(*columns).collect()))


@pytest.mark.parametrize("name", ["match_quality", "match_reasons", "entity_matches_ranked", "sanctions_summary"])
def test_no_copy_of_the_list_is_written(spark, monkeypatch, name):
    written = []

    def settle(df):
        written.append(df.columns)
        return shared.settle(df)

    for module in (S, catalog):
        monkeypatch.setattr(module, "settle", settle)
    QUERIES[name](spark, SF)
    assert written and not [c for c in written if "raw_id" in c]


def test_subjects_in_one_pass_are_the_same(spark):
    shown = ["subject_key", "subject_type", "eu_reference_number", "source_load_date", "programmes", "regulation_types", "regulation_titles", "source_row_count"]
    row = lambda n, day, published, kind, subject="a": (n, day, published, subject, kind, f"eu.{n}", "P", "t", str(n))
    hand = spark.createDataFrame(
        [row(1, "2024-05-02", "2024-01-01", "x"), row(2, "2024-05-02", None, "y"), row(3, "2024-05-01", "2024-03-01", "z"), row(4, "2024-05-02", "2024-01-01", None),
         row(5, None, "2020-01-01", "x", "b"), row(6, "2024-05-02", "2024-01-01", "y", "b"), row(None, "2024-05-01", None, "x", "c"), row(8, "2024-05-01", None, "y", "c")],
        "raw_id long, source_load_date string, publication_date string, subject_key string, subject_type string, eu_reference_number string, programme string, regulation_type string, regulation_title string")
    for fsf in (hand, Inputs(spark, SF).fsf):
        want = S.canonical_plus_rollup(S.canonical_fsf_subject(fsf), S.fsf_subject_rollup(fsf, {}), ["subject_key"])
        got = S.rolled_subjects(fsf)
        assert rows(got, shown) == rows(want, shown)
        assert S.most_rows(got) == max(r["source_row_count"] for r in want.collect())
    assert [r["subject_type"] for r in S.rolled_subjects(hand).orderBy("subject_key").collect()] == [None, "x", "x"]
