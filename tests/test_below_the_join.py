"""Summaries below the join, and ways by doubling: the same as by the plain way."""

from pyspark.sql import functions as F

from riskloom.operators import hierarchy as H
from riskloom.operators import sanctions as S
from riskloom.plans.catalog import Inputs


def rows_of(df):
    return sorted(map(repr, (sorted(r.asDict().items()) for r in df.collect())))


def plain_summary(entities, names, subjects):
    return S.sanctions_summary(S.screening_view(S.graded_matches(entities, names, subjects)))


def test_summary_of_the_lists(spark):
    for sf in ("sf0.001", "sf0.01"):
        i = Inputs(spark, f"/root/testdata/{sf}")
        got = rows_of(i.summary)
        assert got == rows_of(plain_summary(i.candidates, i.names, i.subjects)) and len(got) > 10


def test_summary_of_hand_made_matches(spark):
    """Null countries, keys of every kind, a subject of several names, entities named by identifiers among others of their key."""
    subjects = [("s1", "DE;FR", "x lei1 y", "P2", "L", "2024-06-01"), ("s2", None, None, "P1", None, None), ("s3", "US", "LEI3", None, "L", "2024-01-01"), ("s4", " ", "LEI2LEI1", "", "M", "2024-01-02"), ("s5", "FR", "short", "P1", "L", None)]
    subjects = spark.createDataFrame(subjects, "sanction_subject_id string, source_countries string, source_identifiers string, source_programs string, source_lists string, source_date string").withColumns({
        "sanctions_entity_type": F.lit("company"), "primary_name": F.lit("n"), "source_sanction_context": F.lit("c"), "source_date": F.to_date("source_date")})
    names = [("acme", "s1", "opensanctions", "primary_name", True, "n1"), ("acme", "s1", "opensanctions", "alias_name", False, "n2"), ("acme", "s2", "eu_fsf", "name_alias", False, "n3"), ("acme", "s3", "opensanctions", "alias_name", False, "n4"),
             ("acme", "s4", "opensanctions", "primary_name", True, "n5"), ("bank", "s5", "opensanctions", "primary_name", True, "n6"), ("bank", "s4", "opensanctions", "alias_name", False, "n7"), ("abc", "s5", "opensanctions", "primary_name", True, "n8"), ("x", "s5", "opensanctions", "primary_name", True, "n9")]
    names = spark.createDataFrame(names, "sanctions_name_match_key string, sanction_subject_id string, sanctions_source string, source_name_type string, is_primary_name boolean, sanctions_name_id string").withColumns({
        "source_subject_id": F.concat(F.lit("id-"), "sanction_subject_id"), "sanctions_name": F.lit("n"), "sanctions_entity_type": F.lit("company")})
    entities = [("e1", "Acme", "DE", "LEI1"), ("e2", "ACME!", "DE", "LEI9"), ("e3", "acme", None, "LEI3"), ("e4", "Bank", "FR", "LEI2"), ("e5", "abc", "FR", "LEI5"), ("e6", "x", "FR", "LEI6"), ("e7", "none", "FR", "LEI7"), ("e8", "Acme", "US", "LEI8")]
    entities = spark.createDataFrame(entities, "entity_candidate_id string, legal_name string, country string, lei string").withColumns({
        "candidate_source_id": F.col("lei"), "source_load_date": F.lit("2024-05-01").cast("date"), **{c: F.lit("x") for c in ("legal_name_normalized", "entity_status", "registration_status")}})
    got = S.sanctions_summary_below(entities, names, subjects)
    assert rows_of(got) == rows_of(plain_summary(entities, names, subjects)) and got.count() == 6
    assert got.columns == plain_summary(entities, names, subjects).columns


def test_summary_of_a_common_key(spark):
    """A key of 2,000 entities and 2,000 subjects: every entity has all of them, by joins of far fewer than four million rows."""
    keys = spark.range(2000)
    entities = keys.select(F.concat(F.lit("e"), "id").alias("entity_candidate_id"), F.lit("Bank").alias("legal_name"), F.element_at(F.array(*map(F.lit, ("DE", "FR", "US"))), (F.col("id") % 3 + 1).cast("int")).alias("country"), F.concat(F.lit("LEI"), F.lpad(F.col("id").cast("string"), 17, "0")).alias("lei"))
    entities = entities.withColumns({"candidate_source_id": F.col("lei"), "source_load_date": F.lit("2024-05-01").cast("date")})
    subjects = keys.select(F.concat(F.lit("s"), "id").alias("sanction_subject_id"), F.when(F.col("id") % 2 == 0, "DE").alias("source_countries"), F.lit("EU.1").alias("source_identifiers"), F.lit("P").alias("source_programs"), F.lit("L").alias("source_lists"), F.lit(None).cast("date").alias("source_date"))
    names = subjects.select("sanction_subject_id", F.lit("bank").alias("sanctions_name_match_key"), F.lit("opensanctions").alias("sanctions_source"), F.col("sanction_subject_id").alias("source_subject_id"), F.lit("primary_name").alias("source_name_type"), F.lit(True).alias("is_primary_name"), F.col("sanction_subject_id").alias("sanctions_name_id"), F.lit("company").alias("sanctions_entity_type"))
    out = S.sanctions_summary_below(entities, names, subjects).drop("source_entity_keys")
    assert {(r["total_sanctions_match_count"], r["review_required_match_count"], r["n"]) for r in out.groupBy("total_sanctions_match_count", "review_required_match_count").agg(F.count("*").alias("n")).collect()} == {(2000, 2000, 2000)}


def test_ways_by_doubling_are_those_step_by_step(spark):
    up = {f"n{i}": f"n{(i * 7 + 3) % 40}" for i in range(40) if i % 5} | {f"c{i}": f"c{i + 1}" for i in range(30)} | {"s": "s", "u": "outside"}
    master = spark.createDataFrame([(f"id-{k}", k, p, f"name of {p}") for k, p in up.items()] + [("id-top", "top", None, None)], "entity_candidate_id string, lei string, direct_parent_lei string, direct_parent_name string")
    master = master.withColumns({c: F.lit("x") for c in ("legal_name", "legal_name_normalized", "country")} | {"source_load_date": F.lit("2024-05-01").cast("date")})
    for most in (1, 3, 10, 16):
        want = []
        for k in up:
            way = [k]
            while len(way) <= most and way[-1] in up and up[way[-1]] not in way:
                way.append(up[way[-1]])
            want += [(k, way[d], f"name of {way[d]}", d, " > ".join(way[: d + 1]), d == len(way) - 1) for d in range(1, len(way))]
        got = H.parent_paths(master, most).select("root_lei", "ancestor_lei", "ancestor_name", "depth", "path", "is_furthest_ancestor").collect()
        assert sorted(tuple(r) for r in got) == sorted(want)
