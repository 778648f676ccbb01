"""Matches as classes hold all pairs that the plain joins form, and stay small where keys are common."""

import pytest
from pyspark.sql import functions as F

from riskloom.operators import reports as P
from riskloom.operators import sanctions as S
from riskloom.plans.catalog import QUERIES, Inputs

SF = "/root/testdata/sf0.001"


def pairs_of(classes, *columns):
    """The pairs behind the records: linked classes' members, but for the pairs that are rows of their own."""
    classes = classes.cache()
    of = lambda record, *more: classes.where(F.col("record") == record).select(*more)
    own = of("pair", "entity_candidate_id", "sanction_subject_id", *columns)
    out = of("link", "match_key", "entity_class", "subject_class", *columns).join(of("entity", "match_key", "entity_class", "entity_candidate_id"), ["match_key", "entity_class"])
    out = out.join(of("subject", "match_key", "subject_class", "sanction_subject_id"), ["match_key", "subject_class"]).select(*own.columns)
    return sorted(map(repr, out.join(own, ["entity_candidate_id", "sanction_subject_id"], "left_anti").union(own).collect()))


def hand_made(spark, times=1):
    """One key of entities of three countries (and none) and of subjects of both lists, some of which name an entity by its lei, inside a text or twice."""
    e = spark.range(5 * times).withColumn("n", F.col("id") % 5)
    entities = e.select(F.concat(F.lit("e"), "id").alias("entity_candidate_id"), F.lit("Acme").alias("legal_name"), F.element_at(F.array(*map(F.lit, ("DE", "DE", "FR", "US"))), F.when(F.col("n") < 4, F.col("n") + 1).cast("int")).alias("country"),
                        F.concat(F.lit("LEI"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("lei")).withColumns({"candidate_source_id": F.col("lei"), "source_load_date": F.lit("2024-05-01").cast("date"), **{c: F.lit("x") for c in ("legal_name_normalized", "entity_status", "registration_status")}})
    s = spark.range(4 * times).withColumn("n", F.col("id") % 4)
    text = F.when(F.col("id") == 0, "x lei000001LEI000002y").when(F.col("id") == 2, "LEI000001").when(F.col("n") == 3, "short")
    subjects = s.select(F.concat(F.lit("s"), "id").alias("sanction_subject_id"), F.when(F.col("n") != 1, F.lit("DE;FR")).alias("source_countries"), text.alias("source_identifiers"), *[F.lit("v").alias(c) for c in ("primary_name", "source_programs", "source_lists", "source_sanction_context")], F.lit("2024-01-01").cast("date").alias("source_date"), F.lit("company").alias("sanctions_entity_type"))
    names = s.select(F.lit("acme").alias("sanctions_name_match_key"), F.concat(F.lit("s"), "id").alias("sanction_subject_id"), F.when(F.col("n") == 1, "eu_fsf").otherwise("opensanctions").alias("sanctions_source"), F.concat(F.lit("id-"), "id").alias("source_subject_id"),
                     F.when(F.col("n") == 1, "name_alias").when(F.col("n") == 2, "alias_name").otherwise("primary_name").alias("source_name_type"), F.col("n").isin(0, 3).alias("is_primary_name"), F.concat(F.lit("n"), "id").alias("sanctions_name_id"), F.when(F.col("n") == 3, "ACME").otherwise("Acme").alias("sanctions_name"), F.lit("company").alias("sanctions_entity_type"))
    return entities, names, subjects


@pytest.fixture(params=["hand", "tables"])
def inputs(spark, request):
    if request.param == "hand":
        return hand_made(spark)
    i = Inputs(spark, SF)
    return i.candidates, i.names, i.subjects


def test_graded_classes_are_all_pairs(inputs):
    graded, sides = S.graded_matches(*inputs), S.match_sides(*inputs)
    for columns in (("country_overlap_status", "has_country_overlap"), ("has_identifier_overlap",), ("match_quality_score", "match_quality_tier"), ("match_quality_reasons",)):
        want = sorted(map(repr, graded.select("entity_candidate_id", "sanction_subject_id", *columns).collect()))
        got = S.class_rows(*sides, *columns)
        assert pairs_of(got, *columns) == want and len(want) > 10
        assert {r["record"]: r["n"] for r in got.groupBy("record").agg(F.sum("n_links").alias("n")).where("record in ('entity', 'subject')").collect()} == {"entity": len(want), "subject": len(want)}
        assert got.where("record in ('link', 'pair')").agg(F.sum("n_links")).first()[0] == len(want)


def test_screening_classes_are_the_view(inputs):
    view, got = S.screening_view(S.graded_matches(*inputs)), S.screening_classes(*S.match_sides(*inputs)).cache()
    assert set(view.columns) <= set(got.columns)
    links = [c for c in view.columns if c.startswith(("match_", "is_short", "is_generic", "has_", "country_overlap"))]
    assert pairs_of(got, *links) == sorted(map(repr, view.select("entity_candidate_id", "sanction_subject_id", *links).collect()))
    for record, key, columns in (("entity", "entity_candidate_id", ["lei", "country", "legal_name"]), ("subject", "sanction_subject_id", ["sanctions_name", "sanctions_name_id", "source_lists", "source_countries"])):
        assert sorted(map(repr, got.where(F.col("record") == record).select(key, *columns).distinct().collect())) == sorted(map(repr, view.select(key, *columns).distinct().collect()))


def test_places_in_classes(inputs):
    ranked = P.entity_matches_ranked(S.screening_view(S.graded_matches(*inputs)))
    tie = ["entity_candidate_id", "match_quality_rank", "match_quality_score", "sanctions_source", "sanctions_name"]
    subject = S.screening_view(S.graded_matches(*inputs)).select("entity_sanctions_match_id", "sanction_subject_id")
    first = ranked.groupBy(*tie).agg(F.min("match_place").cast("long").alias("first_place"), F.count("*").alias("n_tied"))
    want = ranked.join(subject, "entity_sanctions_match_id").join(first, tie).select("entity_candidate_id", "sanction_subject_id", "first_place", "n_tied").collect()
    assert pairs_of(S.ranked_classes(*S.match_sides(*inputs)), "first_place", "n_tied") == sorted(map(repr, want))


def test_matches_by_key_are_all_pairs(spark):
    i = Inputs(spark, SF)
    for name, want in (("match_names", i.matches), ("dedupe_matches", S.dedupe_matches(i.matches))):
        got = QUERIES[name](spark, SF).cache()
        names = got.where("record = 'name'").drop("record", "n_links", "entity_candidate_id")
        out = got.where("record = 'entity'").select("match_key", "entity_candidate_id").join(names, "match_key")
        assert sorted(map(repr, out.select(*sorted(out.columns)).collect())) == sorted(map(repr, want.select(*sorted(out.columns)).collect()))


def test_lists_of_subjects_once_a_key(spark):
    entities, names, subjects = hand_made(spark)
    got = S.sanctions_summary_classes(*S.match_sides(entities, names, subjects, S.SUMMED)).collect()
    whole = {r["entity_candidate_id"]: r.asDict() for r in S.sanctions_summary_below(entities, names, subjects).collect()}
    lists = {r["match_class"]: r["source_entity_keys"] for r in got if r["source_entity_keys"]}
    assert lists == {"e0": "id-0;id-1;id-2;id-3"}
    assert {r["entity_candidate_id"]: {**{k: v for k, v in r.asDict().items() if k != "match_class"}, "source_entity_keys": lists[r["match_class"]]} for r in got} == whole


def test_a_common_key_does_not_multiply(spark):
    """300 times the rows on both sides: the records grow as the sides do, the links between classes not at all."""
    count = lambda times: {r["record"]: r["count"] for r in S.class_rows(*S.match_sides(*hand_made(spark, times)), "match_quality_score").groupBy("record").count().collect()}
    few, many = count(2), count(600)
    assert many["entity"] == 3000 and many["subject"] == 2400 and many["link"] == few["link"] < 40 and many["pair"] == few["pair"] == 3
