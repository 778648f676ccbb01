"""Queries of matches return all pairs, one row each, and scores each entity's whole list of subjects."""

import pytest
from pyspark.sql import functions as F
from test_match_classes import hand_made

from riskloom.operators import reports as P
from riskloom.operators import sanctions as S
from riskloom.plans.catalog import QUERIES, Inputs
from riskloom.sources.shared import settle

SF = "/root/testdata/sf0.001"
PLAIN = {
    "match_names": lambda i: i.matches,
    "dedupe_matches": lambda i: S.dedupe_matches(i.matches),
    "country_overlap": lambda i: i.graded,
    "identifier_overlap": lambda i: i.graded,
    "match_quality": lambda i: i.graded,
    "match_reasons": lambda i: i.graded,
    "screening_view": lambda i: i.screening,
    "entity_matches_ranked": lambda i: P.entity_matches_ranked(i.screening),
    "sanctions_summary": lambda i: S.sanctions_summary(i.screening),
}


def rows(df, columns):
    return sorted(map(repr, df.select(*columns).collect()))


@pytest.mark.parametrize("name", list(PLAIN))
def test_queries_are_the_plain_operators(spark, name):
    got, want = QUERIES[name](spark, SF), PLAIN[name](Inputs(spark, SF))
    assert "record" not in got.columns and "match_class" not in got.columns
    assert rows(got, got.columns) == rows(want, got.columns) and got.count() > 10


def test_the_job_lists_the_subjects_of_every_entity(spark):
    want = {r["entity_candidate_id"]: r["source_entity_keys"] for r in S.sanctions_summary(Inputs(spark, SF).screening).collect()}
    got = QUERIES["job_sanctions_screening"](spark, SF)
    assert "match_class" not in got.columns
    lists = {r["entity_candidate_id"]: r["source_entity_keys"] for r in got.collect()}
    assert {k: v for k, v in lists.items() if v is not None} == want and len(lists) > len(want) > 10


@pytest.mark.parametrize("most", [1, 7, 1000])
@pytest.mark.parametrize("few", [0, 100_000])
def test_a_key_dealt_in_parts_has_the_same_pairs(spark, monkeypatch, most, few):
    monkeypatch.setattr(S, "ENTITIES_MET", most)
    monkeypatch.setattr(S, "SMALL_ROWS", few)
    entities, names, subjects = hand_made(spark, 5)
    ours, sides = S.match_sides(entities, names, subjects)
    want = S.screening_view(S.graded_matches(entities, names, subjects))
    got = S.screened_pairs(ours, sides)
    assert rows(got, want.columns) == rows(want, want.columns) and got.count() == 500
    ranked = P.entity_matches_ranked(S.pairs_to_rank(ours, sides), S.DEALT)
    assert rows(ranked, ranked.columns) == rows(P.entity_matches_ranked(want), ranked.columns)
    parts = S.all_pairs(ours, sides).select("match_key", "_part").distinct().count()
    assert parts == 1 if most == 1000 else parts > 2


def test_pairs_are_not_dealt_again(spark):
    """Two shuffles, of both sides; none of the pairs, also where they are ranked; no list is broadcast."""
    ours, sides = S.match_sides(*hand_made(spark, 5))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df in (S.screened_pairs(ours, sides), P.entity_matches_ranked(S.pairs_to_rank(ours, sides), S.DEALT)):
        assert plan(df).count("Exchange hashpartitioning") == 2 and plan(df).count("REPARTITION_BY_NUM") == 2
    listed = S.with_subject_lists(settle(ours.select("match_key", "lei")), sides)
    assert "SortMergeJoin" in plan(listed) and "BroadcastExchange" not in plan(listed)
    assert listed.where(F.length("source_entity_keys") > 100).count() == 25
