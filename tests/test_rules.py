"""Rules that the tables can't reach, on rows made by hand."""

import datetime
import hashlib
import json

from pyspark.sql import functions as F

from riskloom.functions import dates as D
from riskloom.functions import text as X
from riskloom.functions.display import characters, latin_display
from riskloom.operators import audit as A
from riskloom.operators import hierarchy as H
from riskloom.operators import macro as M
from riskloom.operators import reports as P
from riskloom.operators import rows as R
from riskloom.operators import sanctions as S
from riskloom.sources import files as I


def test_match_quality_branches(spark):
    rows = [
        ("acme holding", "primary_name", "opensanctions", "DE", "DE", "xLEI1", 100), ("acme", "primary_name", "opensanctions", "DE", "FR;DE", None, 95), ("acme", "primary_name", "opensanctions", "DE", "FR", None, 90),
        ("acme", "alias_name", "opensanctions", "DE", "DE", None, 85), ("acme", "name_alias", "eu_fsf", "DE", None, None, 80), ("ac", "primary_name", "opensanctions", "DE", "DE", None, 50),
        ("bank", "primary_name", "opensanctions", "DE", "DE", None, 50), ("acme", "alias_name", "opensanctions", None, "DE", None, 70),
    ]
    df = spark.createDataFrame(rows, "match_key string, source_name_type string, sanctions_source string, country string, source_countries string, source_identifiers string, want int")
    df = df.withColumn("lei", F.lit("lei1")).withColumn("candidate_source_id", F.lit("lei1"))
    got = S.match_quality(S.match_flags(df)).withColumn("reasons", S.match_reasons()).collect()
    assert all(r["match_quality_score"] == r["want"] for r in got), got
    assert got[0]["reasons"] == "identifier_overlap; country_overlap; primary_name_match"
    assert [r["country_overlap_status"] for r in got[4:5] + got[7:]] == ["sanctions_country_missing", "entity_country_missing"]


def test_parent_paths_cycles_and_depth(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(12)] + [("a", "b"), ("b", "a"), ("s", "s"), ("x", "unknown")]
    leis = sorted({p[0] for p in chain} | {"c12"})
    up = dict(chain)
    master = spark.createDataFrame([(f"id-{x}", x, up.get(x), None) for x in leis], "entity_candidate_id string, lei string, direct_parent_lei string, direct_parent_name string")
    master = master.withColumns({"legal_name": F.concat(F.lit("Name "), "lei"), "legal_name_normalized": F.concat(F.lit("name "), "lei"), "country": F.lit("DE"), "source_load_date": F.lit("2024-05-01").cast("date")})
    paths = H.parent_paths(master).collect()
    assert len({r["relationship_path_id"] for r in paths}) == len(paths) and all(r["root_legal_name"] == f"Name {r['root_lei']}" for r in paths)
    of = lambda root: sorted((r["depth"], r["ancestor_lei"]) for r in paths if r["root_lei"] == root)
    assert len(of("c0")) == 10 and of("c0")[-1] == (10, "c10")
    assert of("a") == [(1, "b")] and of("s") == [] and of("x") == [(1, "unknown")]
    assert H.parent_paths(master.limit(0)).count() == 0


def test_relationship_picks(spark):
    rows = [(1, "A", "B", None), (2, "A", "B", "2024-01-01"), (3, "A", "C", "2023-01-01")]
    raw = spark.createDataFrame(rows, "raw_id int, start_node_id string, end_node_id string, relationship_period_start_raw string").withColumns({
        "source_load_date": F.lit("2024-05-01").cast("date"), "relationship_type": F.lit(H.DIRECT), "relationship_status": F.lit("ACTIVE"), "registration_status": F.lit("PUBLISHED"), "last_update_date_raw": F.lit(None).cast("string"),
    })
    staged = H.stage_relationships(raw)
    assert sorted(r["raw_id"] for r in staged.collect()) == [2, 3]
    assert H.pick_parent(staged, H.DIRECT).first()["parent_lei"] == "B"


def test_series_edges(spark):
    day = lambda d: datetime.date(2024, 1, d)
    rows = [("x", "A", "", day(1), 9.0), ("i", "A", "s", day(1), 0.0), ("i", "A", "s", day(2), 5.0), ("i", "A", "one", day(1), 3.0), ("k", None, "n", day(1), 1.0), ("k", None, "n", day(2), 1.0)]
    ts = M.timeseries(spark.createDataFrame(rows, "indicator_code string, ref_area string, series_key string, obs_date date, obs_value double").withColumn("indicator_name", F.when(F.col("series_key") != "", "named")))
    got = {(r["series_key"], r["obs_date"].day): r for r in ts.collect()}
    assert got["s", 2]["change_abs"] == 5 and got["s", 2]["change_pct"] is None and got["one", 1]["previous_obs_value"] is None
    slopes = {r["ref_area"]: r["raw_trend_slope"] for r in M.trend_slope(ts).collect()}
    assert slopes[None] == 0
    assert M.level_momentum_percentile(ts).count() == 5


def test_text_and_dates(spark):
    df = spark.createDataFrame([(" ;; a ; \"b\" ;", "2024-02-30", "2024-Q3", '""', "ÀéŁ", "1e5")], "aliases string, d string, p string, q string, n string, num string")
    assert [(r["alias_position"], r["alias_name"]) for r in S.explode_aliases(df).collect()] == [(3, "a"), (4, "b")]
    r = df.select(D.iso_date_prefix(F.col("d")).alias("d"), D.period_to_date(F.col("p"), F.lit("Q")).alias("p"), X.quote_only_to_null(F.col("q")).alias("q"), latin_display(F.col("n")).alias("n"), D.guarded_decimal(F.col("num")).alias("num")).first()
    assert (r["d"], r["p"], r["q"], r["n"], r["num"]) == (None, datetime.date(2024, 7, 1), None, "AeL", None)


def test_health(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = [(1, "j", None, "failed", t, None, "fresh", 1), (2, "j", "t", "success", t, t, "fresh", 1), (3, "j", "t", "failed", t.replace(day=2), None, "stale_warning", 5), (4, "k", "t2", "running", t, None, None, None)]
    runs = spark.createDataFrame(rows, "job_run_id int, job_name string, target_table string, status string, started_at timestamp, finished_at timestamp, freshness_status string, snapshot_age_days int").withColumns({
        "rows_read": F.lit(1), "rows_inserted": F.lit(1), "effective_load_date": F.lit(None).cast("date"), "error_message": F.lit("")})
    health = {(r["job_name"], r["target_table"]): r["pipeline_health_status"] for r in A.audit_status(runs).collect()}
    assert health == {("j", None): "not_healthy", ("j", "t"): "latest_failed_previous_success_available", ("k", "t2"): "not_healthy"}


def test_history_goes_by_ends(spark):
    """A success that never ended is none that was; failures likewise; the last begin and end are of any run."""
    t = lambda d: datetime.datetime(2024, 1, d)
    rows = [(1, "j", "t", "success", t(1), None), (2, "j", "t", "failed", t(2), t(3)), (3, "j", "u", "success_with_warnings", t(1), t(2)), (4, "j", "u", "running", t(5), None)]
    runs = spark.createDataFrame(rows, "job_run_id int, job_name string, target_table string, status string, started_at timestamp, finished_at timestamp").withColumns({
        "freshness_status": F.lit(None).cast("string"), "snapshot_age_days": F.lit(None).cast("int"), "rows_read": F.lit(None).cast("long"), "rows_inserted": F.lit(7), "effective_load_date": F.lit(None).cast("date"), "error_message": F.lit("x")})
    got = {r["target_table"]: r for r in A.audit_status(runs).collect()}
    assert got["t"]["last_success_at"] is None and got["t"]["last_failure_at"] == t(3) and got["t"]["pipeline_health_status"] == "not_healthy" and not got["t"]["has_successful_run"]
    assert got["u"]["last_success_at"] == t(2) and got["u"]["last_failure_at"] is None and got["u"]["pipeline_health_status"] == "latest_failed_previous_success_available"
    assert (got["u"]["last_started_at"], got["u"]["last_finished_at"], got["u"]["freshness_status"], got["u"]["rows_read"], got["u"]["rows_inserted"]) == (t(5), t(2), "unknown", 0, 7)


def test_freshness_of_sources(spark):
    """Successful runs only, the one that ended last, of whatever job; a run of several targets counts for each."""
    t = lambda d: datetime.datetime(2024, 1, d)
    rows = [(1, "a", "t1 , t2", "success", t(1), t(2), "fresh", 1), (2, "b", "t1", "failed", t(3), t(4), "stale", 9), (3, "b", "t3", "success", t(1), t(9), "stale", 4), (4, "c", "t3", "success", t(5), t(6), "fresh", 0),
            (5, "a", "t4", "success_with_warnings", t(1), None, "stale_warning", 3), (6, "a", None, "success", t(1), t(2), "stale", 8), (7, "a", "t5", "success", t(1), t(2), None, 2)]
    runs = spark.createDataFrame(rows, "job_run_id int, job_name string, target_table string, status string, started_at timestamp, finished_at timestamp, freshness_status string, snapshot_age_days int")
    models = spark.createDataFrame([("both", "t1,t2"), ("stale", "t2, t3"), ("warned", "t1,t4"), ("missing", "t1,nowhere"), ("null", "t5")], "model string, targets string")
    got = {r["model"]: (r["freshness_status"], r["snapshot_age_days"], r["source_count"]) for r in A.inherited_freshness(models, runs).collect()}
    assert got == {"both": ("fresh", 1, 2), "stale": ("stale", 4, 2), "warned": ("unknown", 3, 2), "missing": ("unknown", 1, 2), "null": ("unknown", 2, 1)}


def test_manifests_and_their_checks(spark):
    checks = spark.createDataFrame([(1, "passed", "error"), (1, "failed", "warning"), (1, "failed", None), (2, "passed", "warning")], "file_id int, status string, severity string")
    assert {tuple(r) for r in A.quality_summary(checks).collect()} == {(1, 1, 1, 1, 3), (2, 1, 0, 0, 1)}
    day = datetime.date(2024, 1, 1)
    rows = [("ok", "skipped", None, None), ("warn", "success", 2, 0), ("error", "success", 0, 1), ("all failed", "failed", 0, 0), ("some failed", "failed", 1, 0), ("some failed", "success", 0, 0)]
    files = spark.createDataFrame([(s, day, *x, 10) for s, *x in rows], "source string, load_date date, status string, warning_count int, error_count int, downloaded_bytes long")
    manifests = spark.createDataFrame([("no files", day), ("ok", day)], "source string, load_date date")
    got = {r["source"]: (r["manifest_status"], r["success_count"], r["failed_count"], r["warning_count"]) for r in A.manifest_status(files, manifests).collect()}
    assert got == {"ok": ("success", 1, 0, 0), "warn": ("success_with_warnings", 1, 0, 2), "error": ("success_with_warnings", 1, 0, 0), "all failed": ("failed", 0, 1, 0), "some failed": ("success_with_warnings", 1, 1, 1), "no files": ("success", 0, 0, 0)}
    assert A.manifest_status(files).count() == 5


def test_subjects_of_the_eu_list(spark):
    """A reference holds several numbers together; the newest load comes before the newest publication; counts are of the list's own ids."""
    row = lambda **x: json.dumps({"Entity_LogicalId": "1", "NameAlias_WholeName": " A  b", **x})
    rows = [
        (1, "2024-05-01", row(Entity_EU_ReferenceNumber="eu.1", Entity_Regulation_PublicationDate="2024-04-01", Identification_LogicalId="7", Entity_Regulation_Type="AMENDMENT")),
        (2, "2024-05-02", row(Entity_EU_ReferenceNumber="EU.1 ", Entity_LogicalId="2", Entity_Regulation_PublicationDate="2020-01-01", Citizenship_LogicalId="5", NameAlias_LogicalId="9", Address_City=" Bonn ")),
        (3, "2024-05-02", row(Entity_EU_ReferenceNumber="")), (4, "2024-05-02", row(Entity_LogicalId="")),
    ]
    raw = spark.createDataFrame(rows, "raw_id int, source_load_date string, raw_row string").withColumn("source_load_date", F.to_date("source_load_date"))
    fsf = S.stage_fsf(raw)
    got = {r["raw_id"]: r for r in fsf.collect()}
    assert {i: r["subject_key"] for i, r in got.items()} == {1: "EU.1", 2: "EU.1", 3: "1"} and got[1]["regulation_type"] == "amendment" and got[2]["address_city"] == "Bonn" and len(fsf.columns) == 51
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    assert {i: r["name_key"] for i, r in got.items()} == {1: md5("EU.1|1|a b"), 2: "9", 3: md5("1|a b")}
    subjects = {r["subject_key"]: r for r in S.canonical_plus_rollup(S.canonical_fsf_subject(fsf), S.fsf_subject_rollup(fsf), ["subject_key"]).collect()}
    one = subjects["EU.1"]
    assert (one["raw_id"], one["source_row_count"], *[one[f"{c}_count"] for c in ("name_alias", "address", "birth_date", "identification", "citizenship")]) == (2, 2, 1, 0, 0, 1, 1)


def test_targets_of_the_second_list(spark):
    """Upper-case countries meet an entity's country; rows without caption go; all quotes leave an alias; quotes alone are no sanction but stay elsewhere."""
    rows = [(1, "A", "Acme", 'The ""Acme""; "Ac"me Co" ;;', " ru;ua", '""', "prog;x", "EU_L"), (2, "B", " ", "x", "RU", "y", '""', None), (3, "C", '"', None, None, None, None, None)]
    raw = spark.createDataFrame(rows, "raw_id int, id string, caption string, aliases string, countries string, sanctions string, program_ids string, datasets string").withColumns({
        "source_load_date": F.lit("2024-05-01").cast("date"), **{c: F.lit(None).cast("string") for c in ("schema", "birth_date", "addresses", "identifiers", "phones", "emails", "first_seen", "last_seen", "last_change")}})
    targets = S.canonical_targets(S.stage_targets(raw))
    got = {r["target_id"]: r for r in targets.collect()}
    assert set(got) == {"A", "C"} and (got["A"]["countries"], got["A"]["sanctions"], got["A"]["program_ids"], got["A"]["datasets"]) == ("RU;UA", None, "PROG;X", "eu_l") and got["C"]["caption"] == '"'
    assert sorted((r["alias_position"], r["alias_name"]) for r in S.explode_aliases(targets).collect()) == [(1, "The Acme"), (2, "Acme Co")]
    status = targets.select("target_id", X.country_status(F.lit("RU"), F.col("countries")).alias("s")).collect()
    assert {r["target_id"]: r["s"] for r in status} == {"A": "country_overlap", "C": "sanctions_country_missing"}


def test_observations_by_frequency(spark):
    rows = [(1, "mir.m.u2", "x", "mir", None, "m", None, "2024-03"), (2, "other.k", "own.k", "mir", "u2", "D", None, "2024-03"), (3, None, "own.a", None, "de", None, "A", "2024"), (4, "EST.B", "own.b", "est", None, "M", None, "2024"), (5, None, "q", "mir", None, "D", None, "2024-Q4")]
    raw = spark.createDataFrame(rows, "raw_id int, ecb_key string, series_key string, dataflow string, ref_area string, freq string, frequency string, time_period string").withColumns({
        "dataset_code": F.lit(" ds "), "unit": F.lit("pct"), "indicator_name": F.lit("n"), "obs_value": F.lit("1.5"), "source_load_date": F.lit("2024-05-01").cast("date")})
    got = {r["raw_id"]: (r["dataset_code"], r["series_key"], r["ref_area"], r["frequency"], r["obs_date"]) for r in M.stage_observations(raw).collect()}
    day = datetime.date
    assert got == {1: ("MIR", "M.U2", None, "M", day(2024, 3, 1)), 2: ("MIR", "OWN.K", "U2", "D", None), 3: ("DS", "OWN.A", "DE", "A", day(2024, 1, 1)), 4: ("EST", "B", "U2", "M", None), 5: ("MIR", "Q", None, "D", day(2024, 10, 1))}


def test_flexible_dates(spark):
    said = ["2020-01-05T00:00:00", "2020abc", "2020", "2020-02", "2020-02-30", " 2020", "20", None]
    got = [(r["y"], r["d"]) for r in spark.createDataFrame(list(enumerate(said)), "i int, s string").select("i", D.flexible_date(F.col("s"))[0].alias("y"), D.flexible_date(F.col("s"))[1].alias("d")).orderBy("i").collect()]
    day = datetime.date
    assert got == [(2020, day(2020, 1, 5)), (2020, None), (2020, day(2020, 1, 1)), (2020, day(2020, 2, 1)), (2020, None), (None, None), (None, None), (None, None)]


def test_top_and_search_orders(spark):
    """Equal scores by matches, then by the normalized name, in which capitals don't count."""
    rows = [("e1", "l1", "beta", "Beta", 60, 2), ("e2", "l2", "alpha", "alpha", 60, 2), ("e3", "l3", "gamma", "Gamma", 60, 3), ("e4", "l4", "delta", "a delta", 0, 0)]
    risk = spark.createDataFrame(rows, "entity_candidate_id string, lei string, legal_name_normalized string, legal_name string, risk_score int, total_sanctions_match_count long").withColumns({
        "risk_tier": F.when(F.col("risk_score") > 0, "medium").otherwise("low_or_no_known_match"), **{c: F.lit("x") for c in ("country", "entity_status", "registration_status", "source_entity_keys", "legal_jurisdiction")},
        **{f"{c}_match_count": F.lit(1) for c in ("high_confidence", "medium_confidence", "review_required")}})
    assert [r["lei"] for r in P.top_risk_entities(risk).collect()] == ["l3", "l2", "l1"]
    found = [(r["lei"], r["hit_rank"]) for r in P.search_entities(risk.drop("risk_score", "risk_tier"), risk, "a").collect()]
    assert found == []
    assert [(r["lei"], r["hit_rank"]) for r in P.search_entities(risk, risk, "TA").collect()] == [("l1", 4), ("l4", 4)]


def test_checks_and_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 3)], "k string, v int")
    assert [tuple(r) for r in R.check_unique(df, "k").collect()] == [("a", 2)]
    assert R.check_not_null(df, ["k", "v"]).first().asDict() == {"null_k": 1, "null_v": 1}
    assert R.check_accepted_values(df, "k", ["b"]).first()["n"] == 2
    assert df.groupBy().agg(R.string_agg_distinct(F.lit(" ")).alias("x")).first()["x"] is None
    (tmp_path / "x.csv").write_text('\ufeffid;name\n1;"a;b"\n2;\n', encoding="utf-8")
    rows = I.read_csv_snapshot(spark, str(tmp_path), "id string, name string", ";").collect()
    assert [(r["id"], r["name"]) for r in rows] == [("1", "a;b"), ("2", None)]


def test_indicators_and_the_entity_score(spark):
    """The four weighted indicators by name, and each entity's score: the overall one times how far it applies."""
    names = ["Euro short-term rate", "Cost of borrowing for corporations", "AAA yield curve 2Y spot rate", "AAA yield curve 10Y spot rate", "Some other (rate)"]
    df = spark.createDataFrame([(n,) for n in names], "name string").withColumn("code", X.indicator_slug(F.col("name"))).withColumn("weight", X.indicator_weight(F.col("code")))
    assert [(r["code"], r["weight"]) for r in df.collect()] == [
        ("euro_short_term_rate", 0.25), ("cost_of_borrowing_corporations", 0.35), ("aaa_yield_curve_2y_spot_rate", 0.15), ("aaa_yield_curve_10y_spot_rate", 0.25), ("some_other_rate", 0.0),
    ]
    entities = spark.createDataFrame([("1", "DE"), ("2", "US"), ("3", None)], "entity_candidate_id string, country string").withColumns({c: F.lit("x") for c in ("lei", "legal_name", "legal_name_normalized", "source_load_date")})
    summary = spark.createDataFrame([(53.35, "elevated", "said")], "macro_pressure_score double, macro_pressure_level string, macro_pressure_summary string")
    got = {r["country"]: (r["entity_macro_context_score"], r["entity_macro_context_summary"].split(" for ")[0]) for r in M.macro_context(entities, summary).collect()}
    assert got["DE"] == (53.35, "said") and got["US"][0] == 18.67 and got[None][0] == 16.01 and got["US"][1].endswith("reduced applicability")
    assert M.macro_context(entities, summary.limit(0)).count() == 0
    try:
        M.macro_context(entities, summary.unionByName(summary)).collect()
    except Exception as wrong:
        assert "one row was expected" in str(wrong)
    else:
        raise AssertionError


def test_a_newest_row_without_name_is_kept(spark):
    rows = [(1, "2024-05-01", "L1", "Old name"), (2, "2024-05-02", "L1", None), (3, "2024-05-02", " ", "No key")]
    raw = spark.createDataFrame(rows, "raw_id int, source_load_date string, lei string, legal_name string").withColumns({c: F.lit(None).cast("string") for c in (
        "entity_status", "registration_status", "legal_jurisdiction", "legal_address_country", "headquarters_address_country", "next_renewal_date_raw", "last_update_date_raw", "source_object_key")})
    staged = S.stage_lei(raw.withColumn("source_load_date", F.to_date("source_load_date"))).collect()
    assert [(r["raw_id"], r["legal_name"]) for r in staged] == [(2, None)] and '"legal_name":null' in staged[0]["raw_row"]


def test_siblings(spark):
    master = spark.createDataFrame([("e1", "a", "p"), ("e2", "b", "p"), ("e3", "c", None), ("e4", "d", "q")], "entity_candidate_id string, lei string, direct_parent_lei string").withColumns({c: F.lit("x") for c in ("legal_name", "country")})
    assert {(r["lei"], r["sibling_count"]) for r in H.same_parent_entities(master).collect()} == {("a", 1), ("b", 1), ("d", 0)}
    asked = spark.createDataFrame([("a",), ("c",), ("d",)], "lei string")
    assert [(r["asked_lei"], r["sibling_lei"]) for r in H.siblings_of(master, asked).collect()] == [("a", "b")]


def test_packed_rows(spark):
    row = '{"Entity_LogicalId": " 12 ", "Entity_EU_ReferenceNumber": "eu.1", "BirthDate_Year": "19x", "Address_CountryIso2Code": "de", "Entity_Regulation_PublicationDate": "2024-02-30", "NameAlias_WholeName": "  A b ", "Identification_TypeDescription": "PASS"}'
    r = S.extract_json_row(spark.createDataFrame([(1, row), (2, None)], "raw_id int, raw_row string")).orderBy("raw_id").collect()
    assert (r[0]["entity_logical_id"], r[0]["entity_eu_reference_number"], r[0]["birth_date_year"], r[0]["address_country_iso2_code"], r[0]["entity_regulation_publication_date"]) == (12, "EU.1", None, "DE", None)
    assert (r[0]["name_alias_whole_name"], r[0]["identification_type_description"], r[0]["entity_remark"]) == ("A b", "pass", None) and r[1]["entity_logical_id"] is None and len(r[0]) == 47


def test_display_names(spark):
    said = {
        "Ünïted Äöß Łódź": "United Aoss Lodz", "ﬁne ½ Ǆ": "fine 1/2 DZ", "e\u0301te\u0301": "ete", "Ελλάς Ψυχή": "Ellas Psukhe", "Щука Жуков": "Shchuka Zhukov", "ПАО Сбербанк": "PAO Sberbank", "Київ": "Kiyiv",
        "محمد": "mhmd", "שלום": "shlvm", "北京 Bank": "Bei Jing Bank", "東": "東", "  Ａｃｍｅ\t": "Acme", "“A” — “B”": '"A" -- "B"', "\u200b": "\u200b", "plain": "plain", "": "", "A\ue000é": "Ae",
    }
    df = spark.createDataFrame([(i, n) for i, n in enumerate([*said, None])], "i int, n string").repartition(2)
    out = df.select("i", latin_display(F.col("n"), {"北": "Bei ", "京": "Jing"}).alias("d"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert dict(zip([*said, None], [r["d"] for r in out.orderBy("i").collect()], strict=True)) == said | {None: ""}
    assert len(characters()) > 1000 and all(t.isascii() for t in characters().values())


def test_best_names_are_what_dedupe_keeps(spark):
    names = [(k, f"s{i % 3}", "eu_fsf" if i % 2 else "opensanctions", f"n{i}", ("primary_name", "alias_name", "name_alias")[i % 3], i % 4 == 0) for i, k in enumerate(["acme", "acme", "bank", "bank", "bank", "acme"] * 3)]
    df = spark.createDataFrame(names, "sanctions_name_match_key string, sanction_subject_id string, sanctions_source string, sanctions_name_id string, source_name_type string, is_primary_name boolean").withColumns({"source_subject_id": F.lit("x"), "sanctions_name": F.lit("y")})
    entities = spark.createDataFrame([("e1", "Acme"), ("e2", "Bank"), ("e3", "ACME.")], "entity_candidate_id string, legal_name string")
    rows = lambda d: sorted(map(str, d.select("entity_candidate_id", "match_key", "sanction_subject_id", "sanctions_name_id").collect()))
    assert rows(S.match_names(entities, S.best_names(df))) == rows(S.dedupe_matches(S.match_names(entities, df)))
