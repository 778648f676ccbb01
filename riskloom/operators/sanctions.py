"""Sanctions lists: staging, one row per subject and name, both lists as one, matching, grading and risk."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import dates as D
from riskloom.functions import text as X
from riskloom.operators.rows import latest_by_key, require_keys, string_agg_distinct
from riskloom.sources.shared import SMALL_ROWS, proven_small, settle, small_methods

#: Fixed values.
ORGANIZATION_TYPES = ("enterprise", "organization", "company", "legalentity")
NAME_TYPE_ORDER = ("primary_name", "name_alias", "alias_name")
#: The keys of a packed row of the EU list, by kind: text as it is, in upper or lower case, numbers, dates.
FSF_KEYS = {
    "text": (
        "fileGenerationDate", "Entity_DesignationDetails", "Entity_Remark", "NameAlias_FirstName", "NameAlias_MiddleName", "NameAlias_LastName", "NameAlias_WholeName", "NameAlias_Title",
        "NameAlias_Function", "Address_Street", "Address_City", "Address_ZipCode", "Address_CountryDescription", "BirthDate_BirthDate", "BirthDate_City", "Identification_Number",
        "Citizenship_CountryDescription", "Citizenship_Remark", "Citizenship_Regulation_NumberTitle", "Citizenship_Regulation_PublicationUrl", "Entity_Regulation_NumberTitle", "Entity_Regulation_PublicationUrl",
    ),
    "upper": (
        "Entity_EU_ReferenceNumber", "Entity_UnitedNationId", "Entity_SubjectType", "NameAlias_NameLanguage", "NameAlias_Gender", "Address_CountryIso2Code", "BirthDate_CountryIso2Code",
        "Identification_CountryIso2Code", "Citizenship_CountryIso2Code", "Citizenship_Regulation_Programme", "Entity_Regulation_Programme",
    ),
    "lower": ("Entity_SubjectType_ClassificationCode", "Identification_TypeDescription", "Citizenship_Regulation_Type", "Entity_Regulation_Type"),
    "bigint": ("Entity_LogicalId", "NameAlias_LogicalId", "Address_LogicalId", "BirthDate_LogicalId", "Identification_LogicalId", "Citizenship_LogicalId"),
    "int": ("BirthDate_Year",),
    "date": ("Entity_Regulation_PublicationDate", "Citizenship_Regulation_PublicationDate"),
}


def _c(name: str) -> Column:
    return F.col(name)


def _snake(key: str) -> str:
    return re.sub("(?<=[a-z0-9])(?=[A-Z])", "_", key).lower()


def extract_json_row(raw: DataFrame, json: str = "raw_row", keys: dict[str, tuple[str, ...]] = FSF_KEYS) -> DataFrame:
    """Typed, trimmed columns from a row packed as JSON text, which is parsed once; the column of a key is its name in lower case.

    Empty texts, missing keys, and numbers or dates that can't be read are null.
    """
    small_methods(raw.sparkSession)
    others = [c for c in raw.columns if c != json]
    names = [k for of in keys.values() for k in of]
    read = {
        "text": X.clean_text, "upper": lambda c: X.clean_text(c, "upper"), "lower": lambda c: X.clean_text(c, "lower"),
        **{kind: lambda c, kind=kind: X.clean_text(c).try_cast(kind) for kind in ("bigint", "int", "date")},
    }
    # A generator, as Spark would parse the text once for each field of a struct.
    parsed = raw.select(*others, F.json_tuple(json, *names).alias(*[f"_{k}" for k in names]))
    return parsed.select(*others, *[read[kind](_c(f"_{k}")).alias(_snake(k)) for kind, of in keys.items() for k in of])


def stage_lei(raw: DataFrame) -> DataFrame:
    """One cleaned row per entity, named or not: the latest load, then the highest raw id; with a hash and the row itself as JSON."""
    rows = require_keys(raw, ["lei"]).select(
        "raw_id", "source_load_date", X.clean_text(_c("lei"), "upper").alias("lei"), X.clean_text(_c("legal_name")).alias("legal_name"), X.normalize_name(_c("legal_name")).alias("legal_name_normalized"),
        *[X.normalize_status(_c(c)).alias(c) for c in ("entity_status", "registration_status")],
        *[X.clean_text(_c(c), "upper").alias(c) for c in ("legal_jurisdiction", "legal_address_country", "headquarters_address_country")],
        D.iso_date_prefix(_c("next_renewal_date_raw")).alias("next_renewal_date"), D.iso_date_prefix(_c("last_update_date_raw")).alias("last_update_date"),
        "next_renewal_date_raw", "last_update_date_raw", "source_object_key",
    )
    latest = latest_by_key(rows, ["lei"], [_c("source_load_date").desc_nulls_first(), _c("raw_id").desc_nulls_last()])
    content = ["lei", "legal_name", "entity_status", "registration_status", "legal_jurisdiction", "legal_address_country", "headquarters_address_country", "next_renewal_date_raw", "last_update_date_raw"]
    row = F.to_json(F.struct("raw_id", *content, "source_object_key"), {"ignoreNullFields": "false"})
    return latest.withColumns({"row_hash": X.row_hash_md5(*map(_c, content)), "raw_row": row}).drop("next_renewal_date_raw", "last_update_date_raw")


def entity_candidates(lei: DataFrame) -> DataFrame:
    """Named entities with a key and the country to compare."""
    country = X.country_fallback(_c("legal_address_country"), _c("headquarters_address_country"), _c("legal_jurisdiction"))
    return lei.where("legal_name is not null").select(
        X.md5_key(F.lit("gleif"), _c("lei")).alias("entity_candidate_id"), F.lit("gleif").alias("candidate_source"), _c("lei").alias("candidate_source_id"), "lei", "legal_name", "legal_name_normalized",
        "entity_status", "registration_status", "legal_jurisdiction", "legal_address_country", "headquarters_address_country", country.alias("country"), "source_load_date",
    )


def fallback_name_key(name_id: Column, reference: Column, entity: Column, normalized: Column) -> Column:
    """The list's own name id, else a hash of the subject's reference, its number and the name, as far as they are there."""
    return F.coalesce(name_id.cast("string"), X.md5_key(reference, entity, normalized))


#: What columns of a packed row are called afterwards; the others keep their names.
FSF_NAMES = {
    "entity_eu_reference_number": "eu_reference_number", "entity_subject_type_classification_code": "subject_type", "name_alias_whole_name": "whole_name", "entity_regulation_programme": "programme",
    "entity_regulation_type": "regulation_type", "entity_regulation_number_title": "regulation_title", "entity_regulation_publication_date": "publication_date", "entity_regulation_publication_url": "regulation_url",
}


#: The keys that subjects, names and their rollups are made from.
FSF_NEEDED = {
    "text": ("NameAlias_WholeName", "Entity_Regulation_NumberTitle"), "upper": ("Entity_EU_ReferenceNumber", "Entity_Regulation_Programme"), "lower": ("Entity_SubjectType_ClassificationCode", "Entity_Regulation_Type"),
    "bigint": FSF_KEYS["bigint"], "date": ("Entity_Regulation_PublicationDate",),
}


#: The keys that subjects and names of both lists are made from, without what is only counted; and the columns that they need.
FSF_LISTED = {**FSF_NEEDED, "bigint": ("Entity_LogicalId", "NameAlias_LogicalId")}
LISTED = (
    "raw_id", "source_load_date", "publication_date", "subject_key", "subject_type", "eu_reference_number", "programme", "regulation_type", "regulation_title", "name_key", "whole_name", "name_normalized",
)


def stage_fsf(raw: DataFrame, json: str = "raw_row", keys: dict[str, tuple[str, ...]] = FSF_KEYS) -> DataFrame:
    """Typed columns of the EU list's packed rows; a subject has as many rows as it has names, addresses and so on.

    A subject is known by its EU reference, else by its number.  ``FSF_NEEDED`` are the keys that later steps need.
    """
    rows = extract_json_row(raw, json, keys).withColumnsRenamed(FSF_NAMES).where("entity_logical_id is not null")
    reference, entity, normalized = _c("eu_reference_number"), _c("entity_logical_id").cast("string"), X.normalize_name(_c("whole_name"))
    return rows.withColumns({"subject_key": F.coalesce(reference, entity), "name_normalized": normalized, "name_key": fallback_name_key(_c("name_alias_logical_id"), reference, entity, normalized)})


def _fsf_latest() -> list[Column]:
    return [_c("source_load_date").desc_nulls_first(), _c("publication_date").desc_nulls_last(), _c("raw_id").desc_nulls_first()]


def canonical_fsf_subject(fsf: DataFrame) -> DataFrame:
    """The latest row of each subject."""
    return latest_by_key(fsf, ["subject_key"], _fsf_latest())


def canonical_fsf_name(fsf: DataFrame) -> DataFrame:
    """The latest row of each name of a subject."""
    return latest_by_key(fsf.where("name_normalized is not null"), ["subject_key", "name_key"], _fsf_latest())


def _rollup(fsf: DataFrame, keys: list[str], counted: dict[str, str], *more: Column) -> DataFrame:
    # Sets, which are small here, instead of several distinct counts, for which Spark would multiply the rows.
    distinct = lambda c: F.size(F.collect_set(c)).cast("long")
    return fsf.groupBy(*keys).agg(
        string_agg_distinct(_c("programme")).alias("programmes"), string_agg_distinct(_c("regulation_type")).alias("regulation_types"), string_agg_distinct(_c("regulation_title")).alias("regulation_titles"),
        F.min("publication_date").alias("first_publication_date"), F.max("publication_date").alias("last_publication_date"), F.count("*").alias("source_row_count"),
        *[distinct(c).alias(name) for name, c in counted.items()], *more,
    )


#: What is counted of a subject.
FSF_COUNTS = {f"{c}_count": f"{c}_logical_id" for c in ("name_alias", "address", "birth_date", "identification", "citizenship")}


def fsf_subject_rollup(fsf: DataFrame, counts: dict[str, str] = FSF_COUNTS) -> DataFrame:
    """Programmes, lists, dates and five counts (or those asked for) per subject."""
    return _rollup(fsf, ["subject_key"], counts)


def fsf_name_rollup(fsf: DataFrame) -> DataFrame:
    """Programmes, lists, dates and counts per name of a subject."""
    return _rollup(fsf.where("name_normalized is not null"), ["subject_key", "name_key"], {"name_count": "name_key", **{k: v for k, v in FSF_COUNTS.items() if k != "name_alias_count"}})


def canonical_plus_rollup(canonical: DataFrame, rollup: DataFrame, keys: list[str]) -> DataFrame:
    """The latest row of a key with the key's rollup: both are grouped by it, so they share one shuffle."""
    return canonical.join(rollup, keys, "left")


def rolled_subjects(fsf: DataFrame) -> DataFrame:
    """``canonical_plus_rollup`` of the subjects without counts of parts, in one aggregation: the list is read once, so it needn't be written for it.

    Of the latest row it has what ``unify_subjects`` shows.
    """
    load, raw_id = _c("source_load_date"), _c("raw_id")
    order = F.struct(load.isNull().alias("a"), load.alias("b"), _c("publication_date").alias("c"), raw_id.isNull().alias("d"), raw_id.alias("e"))  # the last by it is the first by ``_fsf_latest``
    latest = F.max_by(F.struct("subject_type", "eu_reference_number", "source_load_date"), order).alias("_latest")
    return _rollup(fsf, ["subject_key"], {}, latest).select("*", "_latest.*").drop("_latest")


def listed_keys(fsf: DataFrame) -> DataFrame:
    """The different subjects of the EU list and names of each, for who only counts them: ``name_key`` is null in rows without a name.

    ``rolled_subjects`` has a row for each ``subject_key``, ``canonical_fsf_name`` one for each ``subject_key`` and ``name_key`` of a name.
    """
    return fsf.select("subject_key", F.when(_c("name_normalized").isNotNull(), _c("name_key")).alias("name_key")).distinct()


def stage_targets(raw: DataFrame) -> DataFrame:
    """Cleaned rows of the second list: countries and programmes in upper case, mail and datasets in lower; sanctions that are quotes alone are none."""
    text = ("caption", "aliases", "birth_date", "addresses", "identifiers", "phones")
    content = ("id", "schema", "caption", "aliases", "birth_date", "countries", "addresses", "identifiers", "sanctions", "phones", "emails", "program_ids", "datasets", "first_seen", "last_seen", "last_change")
    return raw.where(F.trim("id") != "").select(
        "raw_id", "source_load_date", X.clean_text(_c("id")).alias("target_id"), X.clean_text(_c("schema"), "lower").alias("schema"), *[X.clean_text(_c(c)).alias(c) for c in text],
        *[X.clean_text(_c(c), "upper").alias(c) for c in ("countries", "program_ids")], *[X.clean_text(_c(c), "lower").alias(c) for c in ("emails", "datasets")],
        X.quote_only_to_null(X.clean_text(_c("sanctions"))).alias("sanctions"), X.normalize_name(_c("caption")).alias("caption_normalized"), X.normalize_name(_c("aliases")).alias("aliases_normalized"),
        X.normalize_identifier(_c("identifiers")).alias("identifiers_normalized"), *[D.strict_iso_timestamp(F.trim(c)).alias(c) for c in ("first_seen", "last_seen", "last_change")],
        X.row_hash_md5(*[F.trim(c) for c in content]).alias("row_hash"),
    )


def canonical_targets(targets: DataFrame) -> DataFrame:
    """The latest row of each target that has a caption: by load, then change, then raw id."""
    return latest_by_key(targets.where("caption is not null"), ["target_id"], [_c("source_load_date").desc_nulls_first(), _c("last_change").desc_nulls_last(), _c("raw_id").desc_nulls_last()])


def explode_aliases(df: DataFrame, column: str = "aliases") -> DataFrame:
    """One row per alias of a ``;``-list: its place from 1, without any quotes; blanks left out."""
    out = df.select("*", F.posexplode(F.split(column, r"\s*;\s*")).alias("_at", "_alias")).withColumn("alias_position", _c("_at") + 1)
    out = out.withColumn("alias_name", X.clean_text(F.replace(_c("_alias"), F.lit('"'), F.lit("")))).withColumn("alias_normalized", X.normalize_name(_c("alias_name")))
    return out.where("alias_normalized is not null").drop("_at", "_alias")


def opensanctions_names(targets: DataFrame) -> DataFrame:
    """Primary names, and aliases that differ from them, once each."""
    primary = targets.where("caption_normalized is not null").select("target_id", F.lit("primary_name").alias("name_type"), F.lit(0).alias("position"), _c("caption").alias("name"), _c("caption_normalized").alias("name_normalized"))
    aliases = explode_aliases(targets).where(~_c("alias_normalized").eqNullSafe(_c("caption_normalized")))
    aliases = aliases.select("target_id", F.lit("alias_name").alias("name_type"), _c("alias_position").alias("position"), _c("alias_name").alias("name"), _c("alias_normalized").alias("name_normalized"))
    return dedupe_names(primary.unionByName(aliases))


def dedupe_names(names: DataFrame) -> DataFrame:
    """Each name of a target and type once: the first place, then the first spelling."""
    return latest_by_key(names, ["target_id", "name_type", "name_normalized"], [_c("position").asc_nulls_last(), _c("name").asc_nulls_last()])


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def unify_subjects(fsf: DataFrame, targets: DataFrame) -> DataFrame:
    """Subjects of both lists in one shape; ``fsf`` is canonical_plus_rollup of the subjects."""
    left = fsf.select(
        F.lit("eu_fsf").alias("sanctions_source"), _c("subject_key").alias("source_subject_id"), _c("subject_type").alias("sanctions_entity_type"), _null().alias("primary_name"),
        _null().alias("source_countries"), _c("eu_reference_number").alias("source_identifiers"), _c("programmes").alias("source_programs"), _c("regulation_types").alias("source_lists"),
        _c("regulation_titles").alias("source_sanction_context"), _c("source_load_date").alias("source_date"),
    )
    right = targets.select(
        F.lit("opensanctions").alias("sanctions_source"), _c("target_id").alias("source_subject_id"), _c("schema").alias("sanctions_entity_type"), _c("caption").alias("primary_name"),
        _c("countries").alias("source_countries"), _c("identifiers").alias("source_identifiers"), _c("program_ids").alias("source_programs"), _c("datasets").alias("source_lists"),
        _c("sanctions").alias("source_sanction_context"), _c("source_load_date").alias("source_date"),
    )
    return left.unionByName(right).withColumn("sanction_subject_id", X.md5_key(_c("sanctions_source"), _c("source_subject_id")))


#: What names are told of their subject.
TYPED = ("source_subject_id", "sanction_subject_id", "sanctions_entity_type")


def unify_name_subject(names: DataFrame, subjects: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Names with their subject's key and type; within one list the subject's id is enough to join ``on``."""
    on = on or ["sanctions_source", "source_subject_id"]
    return names.join(subjects.select(*on, *[c for c in TYPED if c not in on]), on, "left")


def unify_names(fsf_names: DataFrame, os_names: DataFrame, subjects: DataFrame) -> DataFrame:
    """Names of both lists in one shape, with their match key."""
    return unify_name_subject(_fsf_shape(fsf_names).unionByName(_os_shape(os_names)), subjects)


def _fsf_shape(names: DataFrame) -> DataFrame:
    return _with_keys(names.select(F.lit("eu_fsf").alias("sanctions_source"), _c("subject_key").alias("source_subject_id"), F.lit("name_alias").alias("source_name_type"), F.lit(False).alias("is_primary_name"), _c("name_key").alias("source_name_id"), _c("whole_name").alias("sanctions_name")))


def _os_shape(names: DataFrame) -> DataFrame:
    return _with_keys(names.select(F.lit("opensanctions").alias("sanctions_source"), _c("target_id").alias("source_subject_id"), _c("name_type").alias("source_name_type"), (_c("name_type") == "primary_name").alias("is_primary_name"), X.md5_key(_c("target_id"), _c("name_type"), _c("name_normalized"), null_slot=True).alias("source_name_id"), _c("name").alias("sanctions_name")))


def _with_keys(names: DataFrame) -> DataFrame:
    keyed = names.withColumn("sanctions_name_match_key", X.match_key(_c("sanctions_name"))).withColumn("has_non_ascii", X.has_non_ascii(_c("sanctions_name")))
    return keyed.withColumn("sanctions_name_id", X.md5_key(_c("sanctions_source"), _c("source_subject_id"), _c("source_name_id")))


#: A subject of more rows than this, as counted, isn't dealt to one task.
SUBJECT_ROWS = 1_000_000


def most_rows(rolled: DataFrame) -> int:
    """The most rows that a subject has, from the subjects' rollup."""
    return rolled.agg(F.max("source_row_count")).first()[0] or 0


def by_subject(fsf: DataFrame, rows: DataFrame, most: int | None = None) -> DataFrame:
    """``rows`` of the list ``fsf`` dealt by subject, once for all picks and joins within it; as they are if a subject has too many, so that each pick deals its own keys.

    ``most`` is ``most_rows``, where it is known; else they are counted.
    """
    if most is None:
        most = most_rows(fsf.groupBy("subject_key").agg(F.count("*").alias("source_row_count")))
    return rows.repartition("subject_key") if most <= SUBJECT_ROWS else rows


def _of_list(subjects: DataFrame, source: str) -> DataFrame:
    return subjects.where(_c("sanctions_source") == source)


def names_of_lists(fsf: DataFrame, targets: DataFrame, subjects: DataFrame, most: int | None = None) -> DataFrame:
    """``unify_names`` of the picked names, list by list: the EU list's many rows are dealt by subject once, picked and joined with their subjects where they are."""
    eu = unify_name_subject(_fsf_shape(canonical_fsf_name(by_subject(fsf, fsf, most))), proven_small(_of_list(subjects, "eu_fsf").select(*TYPED)), ["source_subject_id"])
    return eu.unionByName(unify_name_subject(_os_shape(opensanctions_names(targets)), _of_list(subjects, "opensanctions"), ["source_subject_id"]))


def organization_names(names: DataFrame) -> DataFrame:
    """Names of organizations of any kind."""
    return names.where(_c("sanctions_entity_type").isin(*ORGANIZATION_TYPES))


def _organization_lists(fsf: DataFrame, targets: DataFrame, subjects: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The names of organizations in either list: rows of other subjects are left out before names are picked from them.

    A name is picked within its subject, so this keeps the same names, and fewer are sorted and keyed.
    """
    kept = organization_names(_of_list(subjects, "eu_fsf")).select(_c("source_subject_id").alias("subject_key"))
    rows = by_subject(fsf, fsf.join(proven_small(kept), "subject_key", "left_semi"), most)
    return _fsf_shape(canonical_fsf_name(rows)), _os_shape(opensanctions_names(targets.where(_c("schema").isin(*ORGANIZATION_TYPES))))


def _subject_id() -> Column:
    return X.md5_key(_c("sanctions_source"), _c("source_subject_id"))


def names_of_organizations(fsf: DataFrame, targets: DataFrame, subjects: DataFrame, most: int | None = None) -> DataFrame:
    """``organization_names`` of ``unify_names`` without the type."""
    eu, other = _organization_lists(fsf, targets, subjects, most)
    return eu.unionByName(other).withColumn("sanction_subject_id", _subject_id())


def typed_organizations(fsf: DataFrame, targets: DataFrame, subjects: DataFrame, most: int | None = None) -> DataFrame:
    """``organization_names`` of ``unify_names``: the names of organizations get their type list by list."""
    eu, other = _organization_lists(fsf, targets, subjects, most)
    kept = organization_names(subjects).select("sanctions_source", *TYPED)
    return unify_name_subject(eu, proven_small(_of_list(kept, "eu_fsf")), ["source_subject_id"]).unionByName(unify_name_subject(other, _of_list(kept, "opensanctions"), ["source_subject_id"]))


def best_of_organizations(fsf: DataFrame, targets: DataFrame, subjects: DataFrame, wanted: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """``best_names`` of ``names_of_organizations``, with what is ``wanted`` of their subjects.

    Subjects are of one list each, so this is done list by list and by the subject's own id: rows that were dealt by subject are picked and
    joined where they are, and keys of hexadecimal digits are made afterwards.
    """
    eu, other = [latest_by_key(names, ["source_subject_id", "sanctions_name_match_key"], _best_first()) for names in _organization_lists(fsf, targets, subjects, most)]
    context = tuple(c for c in CONTEXT if c in wanted)
    if context:
        known = organization_names(subjects)
        few = proven_small(_of_list(known, "eu_fsf").select("source_subject_id", *context))
        eu, other = attach_subject(eu, few, "source_subject_id", context), attach_subject(other, _of_list(known, "opensanctions"), "source_subject_id", context)
    return eu.unionByName(other).withColumn("sanction_subject_id", _subject_id())


def match_names(entities: DataFrame, names: DataFrame) -> DataFrame:
    """Every entity with every name of the same key; narrow on both sides, as common keys meet often."""
    left = entities.select("entity_candidate_id", X.match_key(_c("legal_name")).alias("match_key")).where(F.length("match_key") >= 2)
    right = names.select(_c("sanctions_name_match_key").alias("match_key"), "sanction_subject_id", "sanctions_source", "source_subject_id", "sanctions_name_id", "source_name_type", "is_primary_name", "sanctions_name")
    return left.join(right, "match_key")


def _best_first() -> list[Column]:
    kind = F.lit(9)
    for i, t in reversed(list(enumerate(NAME_TYPE_ORDER))):
        kind = F.when(_c("source_name_type") == t, F.lit(i)).otherwise(kind)
    return [_c("is_primary_name").desc_nulls_last(), kind.asc(), _c("sanctions_source").asc_nulls_last(), _c("sanctions_name_id").asc_nulls_last()]


def dedupe_matches(matches: DataFrame) -> DataFrame:
    """The best name per entity, subject and key."""
    return latest_by_key(matches, ["entity_candidate_id", "sanction_subject_id", "match_key"], _best_first())


def best_names(names: DataFrame) -> DataFrame:
    """The best name per subject and key: what ``dedupe_matches`` keeps for every entity, chosen before the join, so that common keys multiply subjects only."""
    return latest_by_key(names, ["sanction_subject_id", "sanctions_name_match_key"], _best_first())


#: What is known of a subject.
CONTEXT = ("sanctions_entity_type", "primary_name", "source_countries", "source_identifiers", "source_programs", "source_lists", "source_sanction_context", "source_date")


def attach_subject(matches: DataFrame, subjects: DataFrame, on: str = "sanction_subject_id", wanted: tuple[str, ...] = CONTEXT) -> DataFrame:
    """Matches with what is known (or ``wanted``) of the subject; within one list its own id is enough to join ``on``."""
    return matches.join(subjects.select(on, *wanted), on, "left")


def key_quality_flags(df: DataFrame, key: str = "match_key") -> DataFrame:
    """Length of a key, and whether it is short, very short or generic."""
    k = _c(key)
    return df.withColumns({"match_key_length": F.length(k), "is_short_match_key": X.is_short(k), "is_very_short_match_key": X.is_short(k, 2), "is_generic_match_key": X.is_generic(k)})


def match_flags(matches: DataFrame) -> DataFrame:
    """Flags of matches that carry the entity's lei and country and the subject's context."""
    status = X.country_status(_c("country"), _c("source_countries"))
    return key_quality_flags(matches).withColumns({
        "country_overlap_status": status, "has_country_overlap": status == "country_overlap", "has_identifier_overlap": X.identifier_overlap(_c("lei"), _c("source_identifiers"), _c("candidate_source_id")),
        "is_primary_name_match": _c("source_name_type") == "primary_name", "is_alias_name_match": _c("source_name_type").isin("alias_name", "name_alias"),
    })


def match_quality(flagged: DataFrame) -> DataFrame:
    """Score and tier: the first rule that holds."""
    clean = ~_c("is_short_match_key") & ~_c("is_generic_match_key")
    primary, alias, overlap = _c("is_primary_name_match"), _c("is_alias_name_match"), _c("has_country_overlap")
    eu = (_c("sanctions_source") == "eu_fsf") & (_c("country_overlap_status") == "sanctions_country_missing")
    rules = [
        (_c("has_identifier_overlap"), 100, "high_confidence"), (primary & overlap & clean, 95, "high_confidence"), (primary & clean, 90, "medium_confidence"),
        (alias & overlap & clean, 85, "medium_confidence"), (eu & alias & clean, 80, "medium_confidence"), (~clean, 50, "review_required"),
    ]
    score, tier = F.lit(70), F.lit("review_required")
    for holds, points, name in reversed(rules):
        score, tier = F.when(holds, F.lit(points)).otherwise(score), F.when(holds, F.lit(name)).otherwise(tier)
    return flagged.withColumns({"match_quality_score": score, "match_quality_tier": tier})


def match_reasons() -> Column:
    """The reasons that hold, in a fixed order."""
    status = _c("country_overlap_status")
    holds = {
        "identifier_overlap": _c("has_identifier_overlap"), "country_overlap": _c("has_country_overlap"), "country_mismatch": status == "country_mismatch",
        "entity_country_missing": status == "entity_country_missing", "sanctions_country_missing": status == "sanctions_country_missing",
        "eu_fsf_country_context_not_available": (_c("sanctions_source") == "eu_fsf") & (status == "sanctions_country_missing"), "short_match_key": _c("is_short_match_key"),
        "generic_match_key": _c("is_generic_match_key"), "primary_name_match": _c("is_primary_name_match"), "alias_name_match": _c("is_alias_name_match"),
    }
    return F.concat_ws("; ", *[F.when(c, F.lit(name)) for name, c in holds.items()])


def graded_matches(entities: DataFrame, names: DataFrame, subjects: DataFrame) -> DataFrame:
    """Matches of organizations with context, grade and reasons."""
    best = attach_subject(match_names(entities, best_names(organization_names(names))), subjects)
    known = entities.select("entity_candidate_id", "lei", "candidate_source_id", "legal_name", "legal_name_normalized", "entity_status", "registration_status", "country", _c("source_load_date").alias("entity_load_date"))
    graded = match_quality(match_flags(best.join(known, "entity_candidate_id"))).withColumn("match_quality_reasons", match_reasons())
    return graded.withColumn("source_load_date", D.latest_of(_c("source_date"), _c("entity_load_date")))


def quality_rank() -> Column:
    """A number for the tier, 1 is best."""
    tier = _c("match_quality_tier")
    return F.when(tier == "high_confidence", 1).when(tier == "medium_confidence", 2).when(tier == "review_required", 3).otherwise(9)


def screening_view(matches: DataFrame) -> DataFrame:
    """The narrow table that is read: rank, flags and shortened context."""
    tier, rank = _c("match_quality_tier"), quality_rank()
    return matches.select(
        match_id().alias("entity_sanctions_match_id"), "entity_candidate_id", "lei", "legal_name", "country", "sanctions_source",
        "sanctions_entity_type", "sanction_subject_id", "source_subject_id", "sanctions_name", "source_name_type", "match_quality_score", "match_quality_tier", "match_quality_reasons", rank.alias("match_quality_rank"),
        "legal_name_normalized", "entity_status", "registration_status", "sanctions_name_id", X.clean_text(_c("primary_name")).alias("sanctions_subject_primary_name"), "is_primary_name",
        F.lit("exact_name_match_key").alias("match_type"), F.lit(100).alias("match_score"), tier.isin("high_confidence", "medium_confidence").alias("is_potential_risk_match"),
        *[(tier == t).alias(f"is_{t}_match") for t in ("high_confidence", "medium_confidence", "review_required")],
        "is_short_match_key", "is_generic_match_key", "has_country_overlap", "country_overlap_status", "has_identifier_overlap", X.clean_text(_c("source_countries")).alias("source_countries"), X.clean_text(F.left(_c("source_sanction_context"), F.lit(1500))).alias("sanction_context_summary"),
        X.clean_text(_c("source_programs")).alias("source_programs"), X.clean_text(F.left(_c("source_lists"), F.lit(1000))).alias("source_lists"), "source_load_date",
    )


def sanctions_summary(screening: DataFrame) -> DataFrame:
    """Matches of each entity: counts, sources, tiers, programmes, lists, subjects, best score and newest load."""
    tier = _c("match_quality_tier")
    return screening.groupBy("entity_candidate_id").agg(
        F.count("*").alias("total_sanctions_match_count"), F.count_if(tier == "high_confidence").alias("high_confidence_match_count"), F.count_if(tier == "medium_confidence").alias("medium_confidence_match_count"),
        F.count_if(tier == "review_required").alias("review_required_match_count"), F.size(F.collect_set("sanctions_source")).cast("long").alias("sanctions_source_count"),
        F.size(F.collect_set("sanction_subject_id")).cast("long").alias("distinct_sanction_subject_count"), string_agg_distinct(_c("sanctions_source")).alias("sanctions_sources"),
        string_agg_distinct(tier).alias("match_quality_tiers"), string_agg_distinct(_c("source_programs")).alias("sanctions_programs"), string_agg_distinct(_c("source_lists")).alias("sanctions_lists"),
        string_agg_distinct(_c("source_subject_id")).alias("source_entity_keys"),
        F.max("match_quality_score").alias("max_match_quality_score"), F.min("match_quality_rank").alias("best_match_quality_rank"), F.max("source_load_date").alias("sanctions_source_load_date"),
    )


#: What a side of the summary needs to know of a name's subject.
SUMMED = ("sanctions_source", "source_subject_id", "source_name_type", "source_countries", "source_identifiers", "source_programs", "source_lists", "source_date")
#: What classes of matches need to know of a name's subject.
CLASSED = ("sanctions_source", "source_name_type", "sanctions_name", "source_countries", "source_identifiers")
#: What grades depend on besides the key and the entity: subjects of a key that share these are one class.
KINDS = ("sanctions_source", "source_name_type", "source_countries", "sanctions_name")


def match_sides(entities: DataFrame, names: DataFrame, subjects: DataFrame, wanted: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides of all matches of organizations: entities with their key, and the best name of each subject and key with the subject's context; keys of one side only are left out."""
    return sides_of(entities, best_names(organization_names(names)), subjects, wanted)


def sides_of(entities: DataFrame, best: DataFrame, subjects: DataFrame, wanted: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """``match_sides`` from the best names; names whose key no entity has are left out before they meet their subjects."""
    context = [c for c in CONTEXT if (wanted is None or c in wanted) and c not in best.columns]
    narrow = [c for c in best.columns if c not in ("sanctions_name_match_key", "sanction_subject_id") and (wanted is None or c in wanted)]
    ours = settle(entities.withColumnRenamed("source_load_date", "entity_load_date").withColumn("match_key", X.match_key(_c("legal_name"))).where(F.length("match_key") >= 2))
    theirs = settle(best.select(_c("sanctions_name_match_key").alias("match_key"), "sanction_subject_id", *narrow).join(proven_small(ours.select("match_key").distinct()), "match_key", "left_semi"))
    sides = settle(theirs.join(subjects.select("sanction_subject_id", *context), "sanction_subject_id", "left")) if context else theirs
    return ours.join(proven_small(theirs.select("match_key").distinct()), "match_key", "left_semi"), sides


def identified_pairs(ours: DataFrame, sides: DataFrame) -> DataFrame:
    """The pairs of one key whose subject's identifiers hold the entity's lei or source id.

    They meet by the key and the identifier's beginning, of the shortest identifier's length, which is looked for at each place of the texts: so a
    common key multiplies neither side.
    """
    least = F.broadcast(ours.agg(F.least(F.min(F.length(F.upper("lei"))), F.min(F.length(F.upper("candidate_source_id")))).alias("_least")))  # one row
    text = F.upper("source_identifiers")
    places = F.transform(F.sequence(F.lit(1), F.length(text) - _c("_least") + 1), lambda at: F.substr(text, at, _c("_least")))
    needed = [c for c in sides.columns if c in ("match_key", "sanction_subject_id", "subject_class", *CLASSED)]
    told = proven_small(sides.select(*needed).where(F.trim("source_identifiers") != "").join(least, F.length(text) >= _c("_least")).withColumn("_part", F.explode(F.array_distinct(places))).drop("_least"))
    starts = F.array_distinct(F.array_compact(F.array(*[F.substr(F.upper(c), F.lit(1), _c("_least")) for c in ("lei", "candidate_source_id")])))
    said = ours.select("match_key", "entity_candidate_id", "lei", "candidate_source_id", "country").crossJoin(least).withColumn("_part", F.explode(starts)).drop("_least")
    held = X.identifier_overlap(_c("lei"), _c("source_identifiers"), _c("candidate_source_id"))
    return said.join(told, ["match_key", "_part"]).where(held).dropDuplicates(["entity_candidate_id", "sanction_subject_id", "match_key"]).drop("_part")


def linked_by_key(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Matches by key as classes: a row for each entity and each name, with its key and ``n_links``, how many of the other side have it.

    Every entity of a key is matched with every name of it, so the pairs are the join of both records by ``match_key``.
    """
    count = lambda df: proven_small(df.groupBy("match_key").agg(F.count("*").alias("n_links")))
    ours, theirs = settle(ours.where(F.length("match_key") >= 2)), settle(theirs.where(F.length("match_key") >= 2))
    left = ours.join(count(theirs), "match_key").withColumn("record", F.lit("entity"))
    return left.unionByName(theirs.join(count(ours), "match_key").withColumn("record", F.lit("name")), allowMissingColumns=True)


#: So many entities of a key are met in one task; more are dealt to several, so that a common key's pairs are formed side by side.
ENTITIES_MET = 1_000
#: What rows of pairs are dealt by; an entity's are together.
DEALT = ("match_key", "_part")


def all_pairs(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Every entity with every name of its key, all pairs formed; both should be written tables, with all that a pair shows.

    Only the two sides are shuffled, by key and part of its entities, into as many tasks as there are partitions however small they are (their pairs
    are many); a task holds a part's entities and lets the names pass, and pairs are neither kept nor dealt again.
    """
    n = int(ours.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = proven_small(ours.groupBy("match_key").agg(F.ceil(F.count("*") / ENTITIES_MET).cast("int").alias("_parts")))
    dealt = lambda df, part: df.join(parts, "match_key").withColumn("_part", part).drop("_parts").repartition(n, *DEALT)
    left = dealt(ours, F.pmod(F.xxhash64("entity_candidate_id"), _c("_parts")).cast("int"))
    return dealt(theirs, F.explode(F.sequence(F.lit(0), _c("_parts") - 1))).join(F.broadcast(left) if ours.count() <= SMALL_ROWS else left.hint("merge"), list(DEALT))


def graded_pairs(ours: DataFrame, sides: DataFrame) -> DataFrame:
    """``graded_matches`` from both sides of the matches, each with its own context, so that no pair is joined after it is formed."""
    return match_quality(match_flags(all_pairs(ours, sides))).withColumn("match_quality_reasons", match_reasons())


def match_id() -> Column:
    """What a match is known by."""
    return X.md5_key(_c("entity_candidate_id"), _c("sanction_subject_id"), _c("match_key"))


def screened_pairs(ours: DataFrame, sides: DataFrame) -> DataFrame:
    """``screening_view`` of all pairs."""
    return screening_view(graded_pairs(ours, sides).withColumn("source_load_date", D.latest_of(_c("source_date"), _c("entity_load_date"))))


def pairs_to_rank(ours: DataFrame, sides: DataFrame) -> DataFrame:
    """Of ``screening_view`` what places of matches need, with what the pairs are dealt by."""
    return graded_pairs(ours, sides).select(*DEALT, "entity_candidate_id", match_id().alias("entity_sanctions_match_id"), "sanctions_source", "sanctions_name", "match_quality_score", quality_rank().alias("match_quality_rank"))


def match_classes(ours: DataFrame, sides: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Graded matches as classes, without forming the pairs: entities, subjects, and links between their classes.

    Entities of a key and country are one class (those named by a subject's identifiers are each their own), subjects of a key and
    ``KINDS`` another.  All pairs of two linked classes are matches of the link's grade (records ``link``, ``n_links`` pairs each), but for those by an
    identifier, which are rows of their own (records ``pair``).
    """
    subject_class = X.md5_key(_c("match_key"), _c("sanctions_source"), _c("source_name_type"), F.md5(F.coalesce("source_countries", F.lit(""))), _c("sanctions_name"), null_slot=True)
    sides = sides.withColumn("subject_class", subject_class)
    pairs = settle(identified_pairs(ours, sides))
    entity_class = X.md5_key(_c("match_key"), _c("country"), _c("_one"), null_slot=True)
    alone = pairs.select("entity_candidate_id", _c("entity_candidate_id").alias("_one")).distinct()
    entities = ours.join(proven_small(alone), "entity_candidate_id", "left").withColumn("entity_class", entity_class)

    of_entities = entities.groupBy("match_key", "entity_class", "_one").agg(F.min("country").alias("country"), F.count("*").alias("_ours"))
    of_subjects = sides.groupBy("match_key", "subject_class", "sanctions_source", "source_name_type", "sanctions_name").agg(F.min("source_countries").alias("source_countries"), F.count("*").alias("_theirs"))
    moved = pairs.groupBy(_c("entity_candidate_id").alias("_one"), "subject_class").agg(F.count("*").alias("_moved"))
    none = {c: F.lit(None).cast("string") for c in ("lei", "candidate_source_id", "source_identifiers")}
    met = of_entities.join(of_subjects, "match_key").join(moved, ["_one", "subject_class"], "left").withColumn("n_links", _c("_ours") * _c("_theirs") - F.coalesce("_moved", F.lit(0))).where("n_links > 0").withColumns(none)
    own = pairs.withColumns({"_one": _c("entity_candidate_id"), "n_links": F.lit(1).cast("long"), "record": F.lit("pair")}).withColumn("entity_class", entity_class)
    graded = match_quality(match_flags(met.withColumn("record", F.lit("link")).unionByName(own, allowMissingColumns=True))).withColumn("match_quality_reasons", match_reasons())
    count = lambda df: proven_small(df.groupBy("match_key").agg(F.count("*").alias("n_links")))
    return entities.join(count(sides), "match_key").withColumn("record", F.lit("entity")), sides.join(count(ours), "match_key").withColumn("record", F.lit("subject")), graded


def class_rows(ours: DataFrame, sides: DataFrame, *links: str) -> DataFrame:
    """The records of ``match_classes`` with some of the links' columns."""
    entities, subjects, graded = match_classes(ours, sides)
    base = ["record", "match_key", "n_links"]
    out = entities.select(*base, "entity_class", "entity_candidate_id").unionByName(subjects.select(*base, "subject_class", "sanction_subject_id"), allowMissingColumns=True)
    return out.unionByName(graded.select(*base, "entity_class", "subject_class", "entity_candidate_id", "sanction_subject_id", *links), allowMissingColumns=True)


def screening_classes(ours: DataFrame, sides: DataFrame) -> DataFrame:
    """``screening_view`` as records of ``match_classes``: each column with the record that it depends on; of ``source_load_date`` a pair has the later one of both sides'."""
    entities, subjects, graded = match_classes(ours, sides)
    base, tier = ["record", "match_key", "n_links"], _c("match_quality_tier")
    entities = entities.select(*base, "entity_class", "entity_candidate_id", "lei", "legal_name", "country", "legal_name_normalized", "entity_status", "registration_status", _c("entity_load_date").alias("source_load_date"))
    subjects = subjects.select(
        *base, "subject_class", "sanction_subject_id", "sanctions_source", "sanctions_entity_type", "source_subject_id", "sanctions_name", "source_name_type", "sanctions_name_id", "is_primary_name",
        X.clean_text(_c("primary_name")).alias("sanctions_subject_primary_name"), X.clean_text(_c("source_countries")).alias("source_countries"), X.clean_text(F.left(_c("source_sanction_context"), F.lit(1500))).alias("sanction_context_summary"),
        X.clean_text(_c("source_programs")).alias("source_programs"), X.clean_text(F.left(_c("source_lists"), F.lit(1000))).alias("source_lists"), _c("source_date").alias("source_load_date"),
    )
    match_id = F.when(_c("record") == "pair", X.md5_key(_c("entity_candidate_id"), _c("sanction_subject_id"), _c("match_key")))
    graded = graded.select(
        *base, "entity_class", "subject_class", "entity_candidate_id", "sanction_subject_id", match_id.alias("entity_sanctions_match_id"), "match_quality_score", "match_quality_tier", "match_quality_reasons",
        quality_rank().alias("match_quality_rank"), F.lit("exact_name_match_key").alias("match_type"), F.lit(100).alias("match_score"), tier.isin("high_confidence", "medium_confidence").alias("is_potential_risk_match"),
        *[(tier == t).alias(f"is_{t}_match") for t in ("high_confidence", "medium_confidence", "review_required")],
        "is_short_match_key", "is_generic_match_key", "has_country_overlap", "country_overlap_status", "has_identifier_overlap",
    )
    return entities.unionByName(subjects, allowMissingColumns=True).unionByName(graded, allowMissingColumns=True)


def ranked_classes(ours: DataFrame, sides: DataFrame) -> DataFrame:
    """The place of all matches within their entity, as records of ``match_classes``.

    ``first_place`` is the place of the first one of the ``n_tied`` matches of an entity that share rank, score, source and name; among these
    the place follows from the id of the match.
    """
    entities, subjects, graded = match_classes(ours, sides)
    order = ["match_quality_rank", "match_quality_score", "sanctions_source", "sanctions_name"]
    graded = settle(graded.withColumn("match_quality_rank", quality_rank()).select("record", "match_key", "n_links", "entity_class", "subject_class", "entity_candidate_id", "sanction_subject_id", *order, "_ours"))
    tied = graded.groupBy("entity_class", *order).agg(F.sum(_c("n_links") / F.coalesce("_ours", F.lit(1))).cast("long").alias("n_tied"))
    before = Window.partitionBy("entity_class").orderBy(_c(order[0]), _c(order[1]).desc(), _c(order[2]), _c(order[3])).rowsBetween(Window.unboundedPreceding, -1)
    tied = tied.withColumn("first_place", F.coalesce(F.sum("n_tied").over(before), F.lit(0)) + 1)
    base = ["record", "match_key", "n_links"]
    out = entities.select(*base, "entity_class", "entity_candidate_id").unionByName(subjects.select(*base, "subject_class", "sanction_subject_id"), allowMissingColumns=True)
    return out.unionByName(graded.join(tied, ["entity_class", *order]).drop("_ours"), allowMissingColumns=True)


def _tiers() -> list[Column]:
    """The tiers that matches of counts ``high_confidence``, ``medium_confidence`` and ``review_required`` fall into, in order."""
    return [F.when(_c(f"{t}_match_count") > 0, F.lit(t)) for t in ("high_confidence", "medium_confidence", "review_required")]


def _subject_lists(sides: DataFrame) -> DataFrame:
    """The subjects of each key as a list."""
    return sides.groupBy("match_key").agg(string_agg_distinct(_c("source_subject_id")).alias("source_entity_keys"))


def sanctions_summary_below(entities: DataFrame, names: DataFrame, subjects: DataFrame) -> DataFrame:
    """``sanctions_summary`` of all graded matches, without forming them; every entity with the list of its subjects, which grows with their product."""
    return sanctions_summary_whole(*match_sides(entities, names, subjects, SUMMED))


def with_subject_lists(rows: DataFrame, sides: DataFrame) -> DataFrame:
    """Rows that have a ``match_key``, each with the whole list of its key's subjects.

    A list is made once a key and shuffled once; it grows with the names, so it is never broadcast.  Do this last: each row has its own copy from here on.
    """
    return rows.join(_subject_lists(sides).hint("merge"), "match_key", "left")


def sanctions_summary_whole(ours: DataFrame, sides: DataFrame) -> DataFrame:
    """``sanctions_summary`` of all graded matches from both their sides."""
    return with_subject_lists(_summed_by_key(ours, sides), sides).select(*SUMMARY[:9], "sanctions_programs", "sanctions_lists", "source_entity_keys", *SUMMARY[-3:])


def sanctions_summary_classes(ours: DataFrame, sides: DataFrame) -> DataFrame:
    """``sanctions_summary_below`` with the list of subjects once for all entities of a key, which share it.

    ``match_class`` is the smallest ``entity_candidate_id`` of the key; the list is in this entity's row only, so that it isn't copied for each of them.
    """
    classes = settle(ours.groupBy("match_key").agg(F.min("entity_candidate_id").alias("match_class")))
    own = classes.join(_subject_lists(sides), "match_key").select(_c("match_class").alias("entity_candidate_id"), "source_entity_keys")
    return _summed_by_key(ours, sides).join(classes, "match_key").join(own, "entity_candidate_id", "left").drop("match_key")


def sanctions_counts(ours: DataFrame, sides: DataFrame) -> DataFrame:
    """``sanctions_summary_classes`` without the lists of subjects, for who shows none: they are neither made nor joined."""
    return _summed_by_key(ours, sides).drop("match_key")


#: The columns of a summary besides the list of subjects.
SUMMARY = (
    "entity_candidate_id", "total_sanctions_match_count", "high_confidence_match_count", "medium_confidence_match_count", "review_required_match_count", "sanctions_source_count", "distinct_sanction_subject_count",
    "sanctions_sources", "match_quality_tiers", "sanctions_programs", "sanctions_lists", "max_match_quality_score", "best_match_quality_rank", "sanctions_source_load_date",
)


def _summed_by_key(ours: DataFrame, sides: DataFrame) -> DataFrame:
    """``SUMMARY`` of each entity and its ``match_key``: what is counted is summed below the join.

    All names of a key meet all entities of this key.  So programmes, lists, subjects and dates are gathered once a key; grades depend on the key, the
    name's kind and the countries of both sides, so subjects are counted by these, and met once for each country that entities of the key are of.
    Only matches by an identifier are of single entities: these pairs are looked for, and moved to the highest tier.
    """
    # Names that share all of this are one row, so what is gathered in sets, and graded, is read from few rows.
    kinds = ["match_key", "source_countries", "sanctions_source", "source_name_type"]
    shown = [X.clean_text(_c("source_programs")).alias("source_programs"), X.clean_text(F.left(_c("source_lists"), F.lit(1000))).alias("source_lists")]
    alike = settle(sides.select(*kinds, *shown, "source_date").groupBy(*kinds, "source_programs", "source_lists").agg(F.count("*").alias("_n"), F.max("source_date").alias("source_date")))
    by_key = alike.groupBy("match_key").agg(
        F.sum("_n").alias("total_sanctions_match_count"), F.size(F.collect_set("sanctions_source")).cast("long").alias("sanctions_source_count"), string_agg_distinct(_c("sanctions_source")).alias("sanctions_sources"),
        string_agg_distinct(_c("source_programs")).alias("sanctions_programs"), string_agg_distinct(_c("source_lists")).alias("sanctions_lists"),
        F.max("source_date").alias("_newest"),
    )

    groups = alike.groupBy(*kinds).agg(F.sum("_n").alias("_n"))
    none = {c: F.lit(None).cast("string") for c in ("lei", "candidate_source_id", "source_identifiers")}
    met = match_quality(match_flags(ours.select("match_key", "country").distinct().join(groups, "match_key").withColumns(none)))
    of = lambda t: F.coalesce(F.sum(F.when(_c("match_quality_tier") == t, _c("_n"))), F.lit(0))
    by_country = met.groupBy("match_key", _c("country").alias("_country")).agg(*[of(t).alias(f"{t}_match_count") for t in ("high_confidence", "medium_confidence", "review_required")], F.max("match_quality_score").alias("max_match_quality_score"))

    named = match_quality(match_flags(identified_pairs(ours, sides).withColumn("source_identifiers", none["source_identifiers"])))
    moved = named.groupBy("entity_candidate_id").agg(F.count("*").alias("_moved"), *[F.count_if(_c("match_quality_tier") == t).alias(f"_from_{t}") for t in ("high_confidence", "medium_confidence", "review_required")])

    by_key, by_country = settle(by_key), settle(by_country)  # of few rows mostly, which Spark sees in their files
    met = ours.select("match_key", "entity_candidate_id", "country", "entity_load_date").join(by_key, "match_key").join(by_country.withColumnRenamed("match_key", "_key"), (_c("match_key") == _c("_key")) & _c("country").eqNullSafe(_c("_country"))).join(moved, "entity_candidate_id", "left")
    less = lambda t: F.coalesce(_c(f"_from_{t}"), F.lit(0))
    more = F.coalesce(_c("_moved"), F.lit(0))
    met = met.withColumns({f"{t}_match_count": _c(f"{t}_match_count") - less(t) + (more if t == "high_confidence" else F.lit(0)) for t in ("high_confidence", "medium_confidence", "review_required")})
    rank = F.when(_c("high_confidence_match_count") > 0, 1).when(_c("medium_confidence_match_count") > 0, 2).otherwise(3)
    met = met.withColumns({
        "distinct_sanction_subject_count": _c("total_sanctions_match_count"), "match_quality_tiers": F.concat_ws(";", *_tiers()), "best_match_quality_rank": rank,
        "max_match_quality_score": F.when(more > 0, 100).otherwise(_c("max_match_quality_score")), "sanctions_source_load_date": F.greatest("_newest", "entity_load_date"),
    })
    return met.select("match_key", *SUMMARY)


def attach_subject_lists(rows: DataFrame, ours: DataFrame, sides: DataFrame) -> DataFrame:
    """A few rows (broadcast) of entities, each with the list of its subjects in whole: only the lists of their keys are made."""
    keyed = settle(ours.join(F.broadcast(rows.select("entity_candidate_id")), "entity_candidate_id").select("entity_candidate_id", "match_key"))
    lists = _subject_lists(sides.join(F.broadcast(keyed.select("match_key").distinct()), "match_key", "left_semi"))
    return rows.join(F.broadcast(keyed), "entity_candidate_id", "left").join(lists, "match_key", "left").drop("match_key")


COUNTS = ("total_sanctions_match_count", "high_confidence_match_count", "medium_confidence_match_count", "review_required_match_count", "sanctions_source_count", "distinct_sanction_subject_count")


def risk_join(master: DataFrame, summary: DataFrame) -> DataFrame:
    """Every entity with its summary; without matches its counts are 0."""
    joined = master.join(summary, "entity_candidate_id", "left")
    return joined.withColumns({c: F.coalesce(_c(c), F.lit(0)) for c in COUNTS})


def risk_score(joined: DataFrame) -> DataFrame:
    """Score, tier, reason and counts as text, by the best tier that an entity has matches of."""
    levels = [("high_confidence", 100, "high"), ("medium_confidence", 60, "medium"), ("review_required", 20, "review")]
    score, tier, reason = F.lit(0), F.lit("low_or_no_known_match"), F.lit("no_known_sanctions_match")
    for name, points, said in reversed(levels):
        holds = _c(f"{name}_match_count") > 0
        score, tier, reason = F.when(holds, F.lit(points)).otherwise(score), F.when(holds, F.lit(said)).otherwise(tier), F.when(holds, F.lit(f"{name}_sanctions_match")).otherwise(reason)
    parts = [F.concat(F.lit(f"{label}="), _c(c).cast("string")) for label, c in zip(("total_matches", "high", "medium", "review"), COUNTS, strict=False)]
    return joined.withColumns({
        "has_sanctions_match": _c(COUNTS[0]) > 0, **{f"has_{name}_match": _c(f"{name}_match_count") > 0 for name, _, _ in levels}, "risk_score": score, "risk_tier": tier, "risk_reasons": F.concat(F.lit("highest_risk_reason="), reason),
        "match_tier_summary": F.concat_ws("; ", *parts), "source_load_date": D.latest_of(_c("source_load_date"), _c("sanctions_source_load_date")),
    })
