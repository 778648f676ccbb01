"""The same results in plain DuckDB SQL, written independently of the DataFrame code: one common table per operator."""

from __future__ import annotations

import re

from riskloom.sources.fixtures import FIXTURES

# Fixed values, written out here once more, so that the SQL doesn't follow a fault in the operators.
GENERIC_KEYS = (
    "llc", "ltd", "limited", "inc", "corp", "corporation", "company", "co", "bank", "group", "holding", "holdings", "investment", "invest", "capital", "finance",
    "fund", "trust", "rt", "ana", "hcg", "isb", "clara", "jules", "kera", "zenit", "pegasus", "matsa", "homa", "vsc", "spm", "tsa",
)
INDICATORS = {
    "Euro short-term rate": ("euro_short_term_rate", 0.25),
    "Cost of borrowing for corporations": ("cost_of_borrowing_corporations", 0.35),
    "AAA yield curve 2Y spot rate": ("aaa_yield_curve_2y_spot_rate", 0.15),
    "AAA yield curve 10Y spot rate": ("aaa_yield_curve_10y_spot_rate", 0.25),
}
EURO_AREA = ("AT", "BE", "HR", "CY", "EE", "FI", "FR", "DE", "GR", "IE", "IT", "LV", "LT", "LU", "MT", "NL", "PT", "SK", "SI", "ES")
SUMMARIES = {
    "high": "Euro area macro pressure is currently high. Current ECB indicators are elevated and recent trend signals point to continued pressure.",
    "elevated": "Euro area macro pressure is elevated. ECB indicators show increased financing and rate pressure compared with their historical range.",
    "moderate": "Euro area macro pressure is moderate. ECB indicators show some pressure, but not at elevated or high levels.",
    "low": "Euro area macro pressure is currently low based on the selected ECB indicators.",
}
REASONS = {
    "unknown": "Applicability unknown because the entity jurisdiction is missing or could not be mapped. ECB indicators are shown as general macroeconomic context.",
    "applicable": "Entity jurisdiction is part of the euro area. ECB indicators are relevant as regional macroeconomic context.",
    "reduced": "Reduced applicability because the entity jurisdiction is outside the euro area. ECB indicators are shown as broader macroeconomic context only.",
}
COUNTS = ("total_sanctions_match_count", "high_confidence_match_count", "medium_confidence_match_count", "review_required_match_count", "sanctions_source_count", "distinct_sanction_subject_count")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def clean(x: str) -> str:
    return f"nullif(trim({x}), '')"


def norm(x: str, case: str = "lower") -> str:
    return rf"nullif(regexp_replace(trim({case}({x})), '\s+', ' ', 'g'), '')"


def status(x: str) -> str:
    return f"case when upper(trim(coalesce({x}, ''))) in ('', 'NULL', 'N/A') then 'unknown' else lower(trim({x})) end"


def iso(x: str) -> str:
    return rf"case when regexp_matches(trim({x}), '^\d{{4}}-\d{{2}}-\d{{2}}') then try_cast(left(trim({x}), 10) as date) end"


def key(x: str) -> str:
    return rf"nullif(trim(regexp_replace(regexp_replace(lower({x}), '[[:punct:]]+', ' ', 'g'), '\s+', ' ', 'g')), '')"


def agg(x: str, sep: str = ";") -> str:
    return f"string_agg(distinct {x}, '{sep}' order by {x}) filter (where trim({x}) <> '')"


def md5(*xs: str, slots: bool = False) -> str:
    if slots:
        return "md5(" + " || '|' || ".join(f"coalesce(cast({x} as varchar), '')" for x in xs) + ")"
    return f"md5(concat_ws('|', {', '.join(xs)}))"


def unquoted(x: str) -> str:
    return f"case when trim(replace({x}, '\"', '')) <> '' then {x} end"


def first(keys: str, order: str) -> str:
    return f"qualify row_number() over (partition by {keys} order by {order}) = 1"


def period(x: str, frequency: str) -> str:
    p = f"trim({x})"
    return rf"""case when {frequency} = 'M' and regexp_matches({p}, '^[0-9]{{4}}-[0-9]{{2}}$') then try_cast({p} || '-01' as date) when regexp_matches({p}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') then try_cast({p} as date)
        when {frequency} = 'A' and regexp_matches({p}, '^[0-9]{{4}}$') then make_date(cast({p} as int), 1, 1) when regexp_matches({p}, '^[0-9]{{4}}-Q[1-4]$') then make_date(cast(left({p}, 4) as int), 3 * cast(right({p}, 1) as int) - 2, 1) end"""


def upper(x: str) -> str:
    return f"upper({clean(x)})"


def lower(x: str) -> str:
    return f"lower({clean(x)})"


def slug(x: str) -> str:
    cases = " ".join(f"when {x} = {q(n)} then {q(code)}" for n, (code, _) in INDICATORS.items())
    return f"case {cases} else lower(regexp_replace(regexp_replace({x}, '[^A-Za-z0-9]+', '_', 'g'), '^_|_$', '', 'g')) end"


def weight(x: str) -> str:
    return f"case {x} " + " ".join(f"when {q(code)} then {w}" for code, w in INDICATORS.values()) + " else 0 end"


FSF_ORDER = "source_load_date desc, publication_date desc nulls last, raw_id desc"
REL_ORDER = "source_load_date desc nulls first, relationship_period_start desc nulls last, last_update_date desc nulls last"
GOOD = "('success', 'success_with_warnings')"
SERIES = "indicator_code, ref_area, series_key"
SEVERITY = "case pipeline_health_status when 'not_healthy' then 1 when 'latest_failed_previous_success_available' then 2 when 'healthy' then 3 else 4 end"
COUNTRY = "coalesce(legal_address_country, headquarters_address_country, nullif(split_part(legal_jurisdiction, '-', 1), ''))"
EURO = "upper(country) in (" + ", ".join(map(q, EURO_AREA)) + ")"
NAME_ORDER = "is_primary_name desc, case source_name_type when 'primary_name' then 0 when 'name_alias' then 1 when 'alias_name' then 2 else 9 end, sanctions_source, sanctions_name_id"
APPLIES = f"case when country is null or trim(country) = '' then 'unknown' when {EURO} then 'applicable' else 'reduced' end"


def rollup(keys: str, *counted: str) -> str:
    counts = "".join(f", count(distinct {x}_logical_id) as {x}_count" for x in counted)
    return f"""select {keys}, {agg('programme')} as programmes, {agg('regulation_type')} as regulation_types, {agg('regulation_title')} as regulation_titles,
        min(publication_date) as first_publication_date, max(publication_date) as last_publication_date, count(*) as source_row_count{counts} from stage_fsf"""


TARGET_CONTENT = ("id", "schema", "caption", "aliases", "birth_date", "countries", "addresses", "identifiers", "sanctions", "phones", "emails", "program_ids", "datasets", "first_seen", "last_seen", "last_change")


def stamp(x: str) -> str:
    return rf"case when regexp_matches(trim({x}), '^\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}}$') then try_cast(trim({x}) as timestamp) end as {x}"


#: The packed row's columns that the derived list fills, and those that it leaves empty.
FSF_ROW = {
    "entity_logical_id": "entity_logical_id", "entity_eu_reference_number": upper("eu_reference_number"), "entity_subject_type_classification_code": "lower(subject_type)",
    "name_alias_logical_id": "name_alias_logical_id", "name_alias_whole_name": "trim(whole_name)", "entity_regulation_programme": "upper(programme)", "entity_regulation_type": "lower(regulation_type)",
    "entity_regulation_number_title": "regulation_title", "entity_regulation_publication_date": "try_cast(publication_date_raw as date)", "address_logical_id": "cast(address_logical_id as bigint)",
    "birth_date_logical_id": "birth_date_logical_id", "identification_logical_id": "identification_logical_id", "citizenship_logical_id": "citizenship_logical_id",
    "address_country_iso2_code": upper("address_country"), "address_city": clean("address_city"),
    **{x: "cast(null as varchar)" for x in (
        "file_generation_date", "entity_designation_details", "entity_remark", "name_alias_first_name", "name_alias_middle_name", "name_alias_last_name", "name_alias_title", "name_alias_function",
        "address_street", "address_zip_code", "address_country_description", "birth_date_birth_date", "birth_date_city", "identification_number", "citizenship_country_description",
        "citizenship_remark", "citizenship_regulation_number_title", "citizenship_regulation_publication_url", "entity_regulation_publication_url", "entity_united_nation_id", "entity_subject_type",
        "name_alias_name_language", "name_alias_gender", "birth_date_country_iso2_code", "identification_country_iso2_code", "citizenship_country_iso2_code",
        "citizenship_regulation_programme", "identification_type_description", "citizenship_regulation_type",
    )},
    "birth_date_year": "cast(null as int)", "citizenship_regulation_publication_date": "cast(null as date)",
}
FSF_CALLED = {
    "entity_eu_reference_number": "eu_reference_number", "entity_subject_type_classification_code": "subject_type", "name_alias_whole_name": "whole_name", "entity_regulation_programme": "programme",
    "entity_regulation_type": "regulation_type", "entity_regulation_number_title": "regulation_title", "entity_regulation_publication_date": "publication_date", "entity_regulation_publication_url": "regulation_url",
}


#: In order; each may use the ones before and the derived inputs.
STEPS: dict[str, str] = {
    "runs": "select * exclude (finished_at, seconds), case when finished_at is not null then finished_at + to_microseconds(seconds * 1000000 + 600000) end as finished_at from job_runs",
    "stage_lei": f"""select * exclude (next_renewal_date_raw, last_update_date_raw),
        {md5('lei', 'legal_name', 'entity_status', 'registration_status', 'legal_jurisdiction', 'legal_address_country', 'headquarters_address_country', 'next_renewal_date_raw', 'last_update_date_raw', slots=True)} as row_hash,
        cast(to_json({{raw_id: raw_id, lei: lei, legal_name: legal_name, entity_status: entity_status, registration_status: registration_status, legal_jurisdiction: legal_jurisdiction, legal_address_country: legal_address_country,
        headquarters_address_country: headquarters_address_country, next_renewal_date_raw: next_renewal_date_raw, last_update_date_raw: last_update_date_raw, source_object_key: source_object_key}}) as varchar) as raw_row from (select raw_id, source_load_date, upper({clean('lei')}) as lei, {clean('legal_name')} as legal_name, {norm('legal_name')} as legal_name_normalized,
        {status('entity_status')} as entity_status, {status('registration_status')} as registration_status, upper({clean('legal_jurisdiction')}) as legal_jurisdiction,
        upper({clean('legal_address_country')}) as legal_address_country, upper({clean('headquarters_address_country')}) as headquarters_address_country,
        {iso('next_renewal_date_raw')} as next_renewal_date, {iso('last_update_date_raw')} as last_update_date, next_renewal_date_raw, last_update_date_raw, source_object_key from raw_entities where trim(lei) <> '')
        {first('lei', 'source_load_date desc, raw_id desc')}""",
    "entity_candidates": f"""select {md5("'gleif'", 'lei')} as entity_candidate_id, 'gleif' as candidate_source, lei as candidate_source_id, lei, legal_name, legal_name_normalized, entity_status,
        registration_status, legal_jurisdiction, legal_address_country, headquarters_address_country, {COUNTRY} as country, source_load_date from stage_lei where legal_name is not null""",
    "stage_fsf": f"""select *, coalesce(cast(name_alias_logical_id as varchar), {md5('eu_reference_number', 'cast(entity_logical_id as varchar)', 'name_normalized')}) as name_key from (
        select *, coalesce(eu_reference_number, cast(entity_logical_id as varchar)) as subject_key, {norm('whole_name')} as name_normalized from (
        select raw_id, source_load_date, {', '.join(f"{sql} as {FSF_CALLED.get(name, name)}" for name, sql in FSF_ROW.items())} from raw_fsf where entity_logical_id is not null))""",
    "fsf_subject_one": f"select * from stage_fsf {first('subject_key', FSF_ORDER)}",
    "fsf_name_one": f"select * from stage_fsf where name_normalized is not null {first('subject_key, name_key', FSF_ORDER)}",
    "fsf_subject_rollup": rollup("subject_key", "name_alias", "address", "birth_date", "identification", "citizenship") + " group by subject_key",
    "fsf_name_rollup": rollup("subject_key, name_key", "address", "birth_date", "identification", "citizenship").replace(" from stage_fsf", ", count(distinct name_key) as name_count from stage_fsf") + " where name_normalized is not null group by subject_key, name_key",
    "canonical_plus_rollup": "select * from fsf_subject_one left join fsf_subject_rollup using (subject_key)",
    "stage_targets": f"""select raw_id, source_load_date, {clean('id')} as target_id, {lower('schema')} as schema, {', '.join(f'{clean(x)} as {x}' for x in ('caption', 'aliases', 'birth_date', 'addresses', 'identifiers', 'phones'))},
        {upper('countries')} as countries, {upper('program_ids')} as program_ids, {lower('emails')} as emails, {lower('datasets')} as datasets, {unquoted(clean('sanctions'))} as sanctions, {norm('caption')} as caption_normalized,
        {norm('aliases')} as aliases_normalized, {norm('identifiers', 'upper')} as identifiers_normalized, {stamp('first_seen')}, {stamp('last_seen')}, {stamp('last_change')},
        {md5(*[f'trim({x})' for x in TARGET_CONTENT], slots=True)} as row_hash from raw_targets where trim(id) <> ''""",
    "canonical_targets": f"select * from stage_targets where caption is not null {first('target_id', 'source_load_date desc, last_change desc nulls last, raw_id desc')}",
    "os_aliases": rf"""select target_id, caption_normalized, pos, {clean("replace(alias, chr(34), '')")} as name from (select target_id, caption_normalized,
        unnest(regexp_split_to_array(aliases, '\s*;\s*')) as alias, unnest(range(1, len(regexp_split_to_array(aliases, '\s*;\s*')) + 1)) as pos from canonical_targets where aliases is not null)""",
    "opensanctions_names": f"""select * from (select target_id, 'primary_name' as name_type, 0 as position, caption as name, caption_normalized as name_normalized from canonical_targets where caption_normalized is not null
        union all select target_id, 'alias_name', cast(pos as int), name, {norm('name')} from os_aliases where {norm('name')} is not null and {norm('name')} is distinct from caption_normalized)
        {first('target_id, name_type, name_normalized', 'position, name')}""",
    "unify_subjects": f"""select *, {md5('sanctions_source', 'source_subject_id')} as sanction_subject_id from (
        select 'eu_fsf' as sanctions_source, subject_key as source_subject_id, subject_type as sanctions_entity_type, cast(null as varchar) as primary_name, cast(null as varchar) as source_countries,
        eu_reference_number as source_identifiers, programmes as source_programs, regulation_types as source_lists, regulation_titles as source_sanction_context, source_load_date as source_date from canonical_plus_rollup
        union all select 'opensanctions', target_id, schema, caption, countries, identifiers, program_ids, datasets, sanctions, source_load_date from canonical_targets)""",
    "unify_names": f"""select n.*, {key('sanctions_name')} as sanctions_name_match_key, regexp_matches(sanctions_name, '[^ -~]') as has_non_ascii,
        {md5('n.sanctions_source', 'n.source_subject_id', 'source_name_id')} as sanctions_name_id, s.sanction_subject_id, s.sanctions_entity_type from (
        select 'eu_fsf' as sanctions_source, subject_key as source_subject_id, 'name_alias' as source_name_type, false as is_primary_name, name_key as source_name_id, whole_name as sanctions_name from fsf_name_one
        union all select 'opensanctions', target_id, name_type, name_type = 'primary_name', {md5('target_id', 'name_type', 'name_normalized', slots=True)}, name from opensanctions_names) n
        left join unify_subjects s on s.sanctions_source = n.sanctions_source and s.source_subject_id = n.source_subject_id""",
    "organization_all": "select * from unify_names where sanctions_entity_type in ('enterprise', 'organization', 'company', 'legalentity')",
    "match_names": f"""select e.entity_candidate_id, e.match_key, n.sanction_subject_id, n.sanctions_source, n.source_subject_id, n.sanctions_name_id, n.source_name_type, n.is_primary_name, n.sanctions_name
        from (select entity_candidate_id, {key('legal_name')} as match_key from entity_candidates) e join organization_all n on n.sanctions_name_match_key = e.match_key where length(e.match_key) >= 2""",
    "best_matches": f"select * from match_names {first('entity_candidate_id, sanction_subject_id, match_key', NAME_ORDER)}",
    "flagged": f"""select m.*, s.sanctions_entity_type, s.primary_name, s.source_countries, s.source_identifiers, s.source_programs, s.source_lists, s.source_sanction_context, e.lei, e.legal_name, e.legal_name_normalized, e.entity_status, e.registration_status, e.country,
        greatest(s.source_date, e.source_load_date) as source_load_date, length(match_key) as match_key_length, length(match_key) <= 3 as is_short_match_key, length(match_key) <= 2 as is_very_short_match_key,
        match_key in ({', '.join(map(q, GENERIC_KEYS))}) as is_generic_match_key,
        case when e.country is null or trim(e.country) = '' then 'entity_country_missing' when s.source_countries is null or trim(s.source_countries) = '' then 'sanctions_country_missing'
        when list_contains(string_split(s.source_countries, ';'), e.country) then 'country_overlap' else 'country_mismatch' end as country_overlap_status,
        coalesce(trim(s.source_identifiers) <> '' and (contains(upper(s.source_identifiers), upper(e.lei)) or contains(upper(s.source_identifiers), upper(e.candidate_source_id))), false) as has_identifier_overlap,
        m.source_name_type = 'primary_name' as is_primary_name_match, m.source_name_type in ('alias_name', 'name_alias') as is_alias_name_match
        from best_matches m join entity_candidates e using (entity_candidate_id) left join unify_subjects s using (sanction_subject_id)""",
    "graded": """select *, case match_quality_score when 100 then 'high_confidence' when 95 then 'high_confidence' when 90 then 'medium_confidence' when 85 then 'medium_confidence' when 80 then 'medium_confidence' else 'review_required' end as match_quality_tier,
        concat_ws('; ', case when has_identifier_overlap then 'identifier_overlap' end, case when has_country_overlap then 'country_overlap' end, case when country_overlap_status = 'country_mismatch' then 'country_mismatch' end,
        case when country_overlap_status = 'entity_country_missing' then 'entity_country_missing' end, case when country_overlap_status = 'sanctions_country_missing' then 'sanctions_country_missing' end,
        case when sanctions_source = 'eu_fsf' and country_overlap_status = 'sanctions_country_missing' then 'eu_fsf_country_context_not_available' end, case when is_short_match_key then 'short_match_key' end,
        case when is_generic_match_key then 'generic_match_key' end, case when is_primary_name_match then 'primary_name_match' end, case when is_alias_name_match then 'alias_name_match' end) as match_quality_reasons
        from (select *, country_overlap_status = 'country_overlap' as has_country_overlap, case when has_identifier_overlap then 100 when is_short_match_key or is_generic_match_key then 50
        when is_primary_name_match and country_overlap_status = 'country_overlap' then 95 when is_primary_name_match then 90 when is_alias_name_match and country_overlap_status = 'country_overlap' then 85
        when sanctions_source = 'eu_fsf' and is_alias_name_match and country_overlap_status = 'sanctions_country_missing' then 80 else 70 end as match_quality_score from flagged)""",
    "screening_view": f"""select {md5('entity_candidate_id', 'sanction_subject_id', 'match_key')} as entity_sanctions_match_id, entity_candidate_id, lei, legal_name, country, sanctions_source, sanctions_entity_type,
        sanction_subject_id, source_subject_id, sanctions_name, source_name_type, match_quality_score, match_quality_tier, match_quality_reasons,
        case match_quality_tier when 'high_confidence' then 1 when 'medium_confidence' then 2 when 'review_required' then 3 else 9 end as match_quality_rank,
        legal_name_normalized, entity_status, registration_status, sanctions_name_id, {clean('primary_name')} as sanctions_subject_primary_name, is_primary_name, 'exact_name_match_key' as match_type, 100 as match_score,
        match_quality_tier = 'high_confidence' as is_high_confidence_match, match_quality_tier = 'medium_confidence' as is_medium_confidence_match, match_quality_tier = 'review_required' as is_review_required_match,
        is_short_match_key, is_generic_match_key, has_country_overlap, country_overlap_status, has_identifier_overlap, {clean('source_countries')} as source_countries,
        match_quality_tier in ('high_confidence', 'medium_confidence') as is_potential_risk_match, {clean('left(source_sanction_context, 1500)')} as sanction_context_summary, {clean('source_programs')} as source_programs,
        {clean('left(source_lists, 1000)')} as source_lists, source_load_date from graded""",
    "sanctions_summary": f"""select entity_candidate_id, count(*) as total_sanctions_match_count, count(*) filter (where match_quality_tier = 'high_confidence') as high_confidence_match_count,
        count(*) filter (where match_quality_tier = 'medium_confidence') as medium_confidence_match_count, count(*) filter (where match_quality_tier = 'review_required') as review_required_match_count,
        count(distinct sanctions_source) as sanctions_source_count, count(distinct sanction_subject_id) as distinct_sanction_subject_count, {agg('sanctions_source')} as sanctions_sources,
        {agg('match_quality_tier')} as match_quality_tiers, {agg('source_programs')} as sanctions_programs, {agg('source_lists')} as sanctions_lists, {agg('source_subject_id')} as source_entity_keys, max(match_quality_score) as max_match_quality_score,
        min(match_quality_rank) as best_match_quality_rank, max(source_load_date) as sanctions_source_load_date from screening_view group by entity_candidate_id""",
    "stage_relationships": f"""select * from (select raw_id, source_load_date, upper({clean('start_node_id')}) as start_node_id, upper({clean('end_node_id')}) as end_node_id, upper({clean('relationship_type')}) as relationship_type,
        coalesce(lower({clean('relationship_status')}), 'unknown') as relationship_status, {status('registration_status')} as registration_status, {iso('relationship_period_start_raw')} as relationship_period_start,
        {iso('last_update_date_raw')} as last_update_date, {md5('upper(trim(start_node_id))', 'upper(trim(end_node_id))', 'upper(trim(relationship_type))', slots=True)} as relationship_key
        from raw_relationships where trim(start_node_id) <> '' and trim(end_node_id) <> '' and trim(relationship_type) <> '') {first('relationship_key', REL_ORDER + ', raw_id desc')}""",
    "active_all": "select * from stage_relationships where relationship_status in ('active', 'unknown') and registration_status not in ('annulled', 'rejected', 'retired')",
    "parent_of": f"select start_node_id as lei, end_node_id as parent_lei, relationship_type from active_all {first('start_node_id, relationship_type', REL_ORDER + ', relationship_key desc')}",
    "parent_summary": """select l.lei, d.parent_lei as direct_parent_lei, dl.legal_name as direct_parent_name, u.parent_lei as ultimate_parent_lei, ul.legal_name as ultimate_parent_name, d.parent_lei is not null as has_direct_parent,
        u.parent_lei is not null as has_ultimate_parent, d.parent_lei is not null or u.parent_lei is not null as has_any_parent from stage_lei l
        left join (select * from parent_of where relationship_type = 'IS_DIRECTLY_CONSOLIDATED_BY') d on d.lei = l.lei left join stage_lei dl on dl.lei = d.parent_lei
        left join (select * from parent_of where relationship_type = 'IS_ULTIMATELY_CONSOLIDATED_BY') u on u.lei = l.lei left join stage_lei ul on ul.lei = u.parent_lei""",
    "entity_master": "select c.*, p.* exclude (lei) from entity_candidates c left join parent_summary p on p.lei = c.lei",
    "relationship_edges": f"""select *, {md5('child_lei', 'relationship_type', 'parent_lei', slots=True)} as relationship_edge_id from (
        select entity_candidate_id as child_entity_candidate_id, lei as child_lei, legal_name as child_legal_name, legal_name_normalized as child_legal_name_normalized, source_load_date, country as child_country, 'direct_parent' as relationship_type, direct_parent_lei as parent_lei, direct_parent_name as parent_name, 1 as relationship_depth
        from entity_master where direct_parent_lei is not null union all select entity_candidate_id, lei, legal_name, legal_name_normalized, source_load_date, country, 'ultimate_parent', ultimate_parent_lei, ultimate_parent_name,
        case when direct_parent_lei <> ultimate_parent_lei then 2 else 1 end from entity_master where ultimate_parent_lei is not null and ultimate_parent_lei <> lei)""",
    "walk": """select entity_candidate_id, lei as root_lei, direct_parent_lei as ancestor_lei, direct_parent_name as ancestor_name, 1 as depth, [lei, direct_parent_lei] as way from entity_master where direct_parent_lei <> lei
        union all select w.entity_candidate_id, w.root_lei, m.direct_parent_lei, m.direct_parent_name, w.depth + 1, list_append(w.way, m.direct_parent_lei) from walk w join entity_master m on m.lei = w.ancestor_lei
        where w.depth < 10 and m.direct_parent_lei is not null and not list_contains(w.way, m.direct_parent_lei)""",
    "parent_paths": """select md5(coalesce(w.root_lei, '') || '|path|' || coalesce(w.ancestor_lei, '') || '|' || w.depth) as relationship_path_id, w.entity_candidate_id, w.root_lei, e.legal_name as root_legal_name,
        e.legal_name_normalized as root_legal_name_normalized, e.country as root_country, w.ancestor_lei, w.ancestor_name, w.depth, array_to_string(w.way, ' > ') as path,
        w.depth = max(w.depth) over (partition by w.entity_candidate_id) as is_furthest_ancestor, e.source_load_date from walk w join entity_master e on e.entity_candidate_id = w.entity_candidate_id""",
    "child_counts": "select parent_lei, count(distinct child_lei) as known_child_count from relationship_edges where relationship_type = 'direct_parent' group by parent_lei",
    "descendant_counts": "select ancestor_lei as parent_lei, count(distinct root_lei) as total_descendant_count from parent_paths group by ancestor_lei",
    "sibling_group_size": "select direct_parent_lei, count(*) as same_parent_group_size from entity_master where direct_parent_lei is not null group by direct_parent_lei",
    "path_summary": """select entity_candidate_id, max(depth) as parent_chain_depth, count(*) as parent_path_count, max(ancestor_lei) filter (where is_furthest_ancestor) as furthest_known_ancestor_lei,
        max(ancestor_name) filter (where is_furthest_ancestor) as furthest_known_ancestor_name from parent_paths group by entity_candidate_id""",
    "relationship_context": """select e.entity_candidate_id, e.lei, e.country, e.direct_parent_lei, e.ultimate_parent_lei, e.has_any_parent, coalesce(c.known_child_count, 0) as known_child_count,
        coalesce(d.total_descendant_count, 0) as total_descendant_count, coalesce(p.parent_chain_depth, 0) as parent_chain_depth, coalesce(p.parent_path_count, 0) as parent_path_count,
        case when e.direct_parent_lei is null then 0 else greatest(coalesce(s.same_parent_group_size, 0) - 1, 0) end as same_parent_entity_count, p.furthest_known_ancestor_lei, coalesce(c.known_child_count, 0) > 0 as has_known_children,
        case when e.has_any_parent then case when coalesce(d.total_descendant_count, 0) > 0 then 'Entity has both parent and child or descendant relationship context.' else 'Entity has known parent relationship context.' end
        when coalesce(d.total_descendant_count, 0) > 0 then 'Entity has known child or descendant entities but no known parent.' else 'No known parent or child relationships.' end as relationship_context_summary
        from entity_master e left join child_counts c on c.parent_lei = e.lei left join descendant_counts d on d.parent_lei = e.lei left join sibling_group_size s on s.direct_parent_lei = e.direct_parent_lei
        left join path_summary p on p.entity_candidate_id = e.entity_candidate_id""",
    "risk_all": f"""select e.*, {', '.join(f'coalesce(s.{x}, 0) as {x}' for x in COUNTS)}, s.sanctions_sources, s.match_quality_tiers, s.sanctions_programs, s.sanctions_lists, s.source_entity_keys, s.max_match_quality_score, s.best_match_quality_rank,
        coalesce(s.high_confidence_match_count, 0) > 0 as has_high_confidence_match, coalesce(s.medium_confidence_match_count, 0) > 0 as has_medium_confidence_match, coalesce(s.review_required_match_count, 0) > 0 as has_review_required_match,
        s.sanctions_source_load_date, coalesce(s.total_sanctions_match_count, 0) > 0 as has_sanctions_match,
        case when s.high_confidence_match_count > 0 then 100 when s.medium_confidence_match_count > 0 then 60 when s.review_required_match_count > 0 then 20 else 0 end as risk_score,
        case when s.high_confidence_match_count > 0 then 'high' when s.medium_confidence_match_count > 0 then 'medium' when s.review_required_match_count > 0 then 'review' else 'low_or_no_known_match' end as risk_tier,
        'highest_risk_reason=' || case when s.high_confidence_match_count > 0 then 'high_confidence_sanctions_match' when s.medium_confidence_match_count > 0 then 'medium_confidence_sanctions_match'
        when s.review_required_match_count > 0 then 'review_required_sanctions_match' else 'no_known_sanctions_match' end as risk_reasons,
        'total_matches=' || coalesce(s.total_sanctions_match_count, 0) || '; high=' || coalesce(s.high_confidence_match_count, 0) || '; medium=' || coalesce(s.medium_confidence_match_count, 0) || '; review=' || coalesce(s.review_required_match_count, 0) as match_tier_summary,
        greatest(e.source_load_date, coalesce(s.sanctions_source_load_date, e.source_load_date)) as risk_load_date from entity_master e left join sanctions_summary s on s.entity_candidate_id = e.entity_candidate_id""",
    "stage_observations": f"""select raw_id, source_load_date, flow as dataset_code, case when starts_with(full_key, flow || '.') then substr(full_key, length(flow) + 2) else own_key end as series_key, indicator_name,
        {slug('indicator_name')} as indicator_code, frequency, unit, area as ref_area, case area when 'U2' then 'Euro area' else area end as reference_area_name, time_period, {period('time_period', 'frequency')} as obs_date,
        case when regexp_matches(trim(obs_value), '^-?[0-9]+([.][0-9]+)?$') then cast(trim(obs_value) as double) end as obs_value from (select *, coalesce(said_area, case when flow = 'EST' then 'U2' end) as area from (
        select raw_id, source_load_date, coalesce({upper('dataflow')}, {upper('dataset_code')}) as flow, {upper('ecb_key')} as full_key, {upper('series_key')} as own_key, {clean('indicator_name')} as indicator_name,
        coalesce({upper('freq')}, {upper('frequency')}) as frequency, {upper('unit')} as unit, {upper('ref_area')} as said_area, {clean('time_period')} as time_period, obs_value from raw_observations))
        {first('dataset_code, series_key, time_period', 'source_load_date desc nulls last, raw_id desc')}""",
    "ts": f"""select *, obs_value - previous_obs_value as change_abs, case when previous_obs_value <> 0 then (obs_value - previous_obs_value) / abs(previous_obs_value) end as change_pct, recency_rank = 1 as is_latest_observation from (
        select *, lag(obs_value) over w as previous_obs_value, lag(obs_date) over w as previous_obs_date, avg(obs_value) over (w rows between 2 preceding and current row) as rolling_avg_3_obs,
        avg(obs_value) over (w rows between 5 preceding and current row) as rolling_avg_6_obs, avg(obs_value) over (w rows between 11 preceding and current row) as rolling_avg_12_obs,
        row_number() over (partition by {SERIES} order by obs_date desc) as recency_rank, count(*) over (partition by {SERIES}) as observation_count
        from stage_observations where obs_date is not null and obs_value is not null and indicator_name is not null window w as (partition by {SERIES} order by obs_date))""",
    "percentiles": """select *, cume_dist() over (partition by indicator_code, ref_area order by obs_value) as current_level_percentile,
        cume_dist() over (partition by indicator_code, ref_area order by coalesce(change_abs, 0)) as momentum_percentile from ts""",
    "trends": """select indicator_code, ref_area, case when count(*) > 1 then regr_slope(obs_value, epoch(cast(obs_date as timestamp))) end as raw_trend_slope, count(*) as trend_observation_count from (
        select * from ts qualify row_number() over (partition by indicator_code, ref_area order by obs_date desc, series_key nulls last, obs_value nulls last) <= 12) group by indicator_code, ref_area""",
    "indicator_pressure": f"""select {md5('p.indicator_code', 'p.ref_area', 'p.series_key', slots=True)} as pressure_indicator_id, p.indicator_code, p.ref_area, p.series_key, p.indicator_name, p.obs_date as latest_obs_date,
        p.obs_value as latest_obs_value, round(current_level_percentile * 100, 2) as current_level_score, round(momentum_percentile * 100, 2) as momentum_score,
        case when t.raw_trend_slope is null then 'unknown' when t.raw_trend_slope > 0 then 'upward' when t.raw_trend_slope < 0 then 'downward' else 'stable' end as trend_direction,
        case when t.raw_trend_slope > 0 then 75.0::double when t.raw_trend_slope < 0 then 25.0::double else 50.0::double end as trend_projection_score,
        round(50.0::double * current_level_percentile + 30.0::double * momentum_percentile + 0.2::double * case when t.raw_trend_slope > 0 then 75.0::double when t.raw_trend_slope < 0 then 25.0::double else 50.0::double end, 2) as indicator_pressure_score,
        cast({weight('p.indicator_code')} as double) as indicator_weight, t.trend_observation_count from percentiles p left join trends t on t.indicator_code = p.indicator_code and t.ref_area = p.ref_area
        where p.is_latest_observation and {weight('p.indicator_code')} > 0""",
    "weighted_macro_score": """select round(sum(indicator_pressure_score * indicator_weight) / nullif(sum(indicator_weight), 0), 2) as macro_pressure_score,
        round(sum(case trend_direction when 'upward' then 1 when 'downward' then -1 else 0 end * indicator_weight) / nullif(sum(indicator_weight), 0), 4) as weighted_trend_signal from indicator_pressure""",
    "macro_level": f"""select *, case macro_pressure_level {' '.join(f'when {q(k)} then {q(v)}' for k, v in SUMMARIES.items())} end as macro_pressure_summary from (select *,
        case when macro_pressure_score >= 75 then 'high' when macro_pressure_score >= 50 then 'elevated' when macro_pressure_score >= 25 then 'moderate' else 'low' end as macro_pressure_level,
        case when weighted_trend_signal > 0.15 then 'upward' when weighted_trend_signal < -0.15 then 'downward' else 'stable' end as macro_trend_direction from weighted_macro_score)""",
    "macro_summary": "select m.*, i.latest_obs_date from macro_level m, (select max(latest_obs_date) as latest_obs_date, count(*) as n from indicator_pressure) i where i.n > 0",
    "macro_applicability": f"""select entity_candidate_id, lei, legal_name, legal_name_normalized, country, source_load_date as entity_source_load_date, coalesce({EURO}, false) as is_euro_area_country, {APPLIES} as macro_context_applicability,
        cast(case {APPLIES} when 'unknown' then 0.30 when 'applicable' then 1.0 else 0.35 end as double) as macro_applicability_weight,
        case {APPLIES} {' '.join(f'when {q(k)} then {q(v)}' for k, v in REASONS.items())} end as macro_context_applicability_reason from entity_candidates""",
    "entity_macro": """select a.*, s.*, md5(coalesce(a.entity_candidate_id, '') || '|ecb_macro_context') as entity_macro_context_id,
        cast(round(cast(s.macro_pressure_score as decimal(12, 2)) * cast(a.macro_applicability_weight as decimal(4, 2)), 2) as double) as entity_macro_context_score,
        case a.macro_context_applicability when 'applicable' then s.macro_pressure_summary
        when 'reduced' then 'ECB macro indicators are shown with reduced applicability for this entity because its jurisdiction is outside the euro area.'
        else 'ECB macro indicators are shown as general context because applicability could not be determined.' end as entity_macro_context_summary from macro_applicability a, macro_summary s""",
    "latest_all": f"select * from runs {first('job_name, target_table', 'started_at desc nulls first, job_run_id desc')}",
    "wanted_sources": "select distinct model, trim(u.t) as target_table from model_sources, unnest(string_split(targets, ',')) u(t)",
    "done_runs": f"""select * from (select trim(u.t) as part, r.* from runs r, unnest(string_split(r.target_table, ',')) u(t) where r.status in {GOOD})
        {first('part', 'finished_at desc nulls last, started_at desc nulls last, job_run_id desc')}""",
    "run_history": f"""select job_name, target_table, count(*) as total_run_count, count(*) filter (where status in {GOOD}) as success_run_count, count(*) filter (where status not in {GOOD}) as failed_or_incomplete_run_count,
        max(finished_at) filter (where status in {GOOD}) as last_success_at, max(finished_at) filter (where status not in {GOOD}) as last_failure_at, max(started_at) as last_started_at, max(finished_at) as last_finished_at
        from runs group by job_name, target_table""",
    "audit": f"""select l.job_run_id, l.job_name, l.target_table, l.status, l.started_at, l.finished_at, cast(round((epoch_us(l.finished_at) - epoch_us(l.started_at)) / 1000000.0) as int) as duration_seconds, l.effective_load_date,
        coalesce(l.freshness_status, 'unknown') as freshness_status, l.snapshot_age_days, coalesce(l.rows_read, 0) as rows_read, coalesce(l.rows_inserted, 0) as rows_inserted, l.error_message,
        h.* exclude (job_name, target_table), h.last_success_at is not null as has_successful_run, l.status in {GOOD} as is_successful_latest_run, l.status not in {GOOD} as is_failed_or_incomplete_latest_run,
        case when l.status in {GOOD} then 'healthy' when h.last_success_at is not null then 'latest_failed_previous_success_available' else 'not_healthy' end as pipeline_health_status
        from latest_all l left join run_history h on h.job_name = l.job_name and h.target_table is not distinct from l.target_table""",
    "worst": f"select * from audit {first('target_table', SEVERITY + ', is_failed_or_incomplete_latest_run desc, started_at desc, job_run_id desc')}",
    "expected_tables_status": """select e.target_table, e.display_name, e.sort_order, w.job_name, w.status, coalesce(w.pipeline_health_status, 'missing_run') as pipeline_health_status, coalesce(w.freshness_status, 'unknown') as freshness_status,
        coalesce(w.total_run_count, 0) as total_run_count, coalesce(w.is_successful_latest_run, false) as is_successful_latest_run, coalesce(w.is_failed_or_incomplete_latest_run, false) as is_failed_or_incomplete_latest_run
        from expected_tables e left join worst w on w.target_table = e.target_table where e.is_active""",
    "quality_summary": """select file_id, count(*) filter (where status = 'passed') as passed_count, count(*) filter (where status <> 'passed' and coalesce(severity, '') = 'warning') as warning_count,
        count(*) filter (where status <> 'passed' and coalesce(severity, '') <> 'warning') as error_count, count(*) as total_count from manifest_checks group by file_id""",
    "manifest_status": """select *, case when failed_count + error_count > 0 then case when success_count > 0 then 'success_with_warnings' else 'failed' end when warning_count > 0 then 'success_with_warnings' else 'success' end as manifest_status from (
        select source, load_date, count(*) as file_count, count(*) - count(*) filter (where status = 'failed') as success_count, count(*) filter (where status = 'failed') as failed_count,
        cast(coalesce(sum(warning_count), 0) as bigint) as warning_count, cast(coalesce(sum(error_count), 0) as bigint) as error_count, cast(sum(downloaded_bytes) as bigint) as downloaded_bytes
        from manifest_files left join quality_summary using (file_id) group by source, load_date)""",
}

MATCH = "entity_candidate_id, sanction_subject_id, match_key"
OBS = "indicator_code, ref_area, series_key, obs_date, obs_value"
RISK = "entity_candidate_id, risk_score, risk_tier, risk_reasons, match_tier_summary, risk_load_date as source_load_date"


def _r(x: str, places: int = 6) -> str:
    return f"round({x}, {places}) as {x}"


def by_key(of: str, *theirs: str) -> str:
    """Matches by key as classes: each entity and each name with the number of its matches."""
    return f"""select 'entity' as record, match_key, entity_candidate_id, count(*) as n_links from {of} group by all
        union all by name select 'name' as record, match_key, {', '.join(theirs)}, count(*) as n_links from {of} group by all"""


#: Queries over the steps.
SELECTS: dict[str, str] = {
    "read_csv_snapshot": "select raw_id, lei, legal_name, cast(source_load_date as varchar) as source_load_date from raw_entities",
    "map_source_columns": f"select {clean('id')} as target_id, {clean('caption')} as caption, cast(null as varchar) as \"none\" from raw_targets",
    "with_lineage": "select page_id, candidate_id, raw_id, 'pages/' || candidate_id as source_object_key, date '2024-05-01' as source_load_date, cast(row_number() over (partition by candidate_id order by page_id) as int) as row_number from raw_pages",
    "row_to_json": "select raw_id, cast(to_json({entity_logical_id: entity_logical_id, eu_reference_number: eu_reference_number, whole_name: whole_name}) as varchar) as raw_row from raw_fsf",
    "row_hash_sha256": "select raw_id, sha256(cast(to_json({entity_logical_id: entity_logical_id, eu_reference_number: eu_reference_number, whole_name: whole_name}) as varchar)) as row_hash from raw_fsf",
    "latin_display": "select doc_id, replace(strip_accents(trim(name)), 'ß', 'ss') as display_name from names_text",
    "replace_by_object": "select page_id, source_object_key, 'new' as version from raw_pages where page_id % 3 = 0 union all select page_id, source_object_key, 'old' from raw_pages where source_object_key not in (select source_object_key from raw_pages where page_id % 3 = 0)",
    "load_objects": "select page_id, source_object_key, candidate_id, case when candidate_id % 3 = 0 then 'new' else 'old' end as version from raw_pages where candidate_id % 3 <> 0 or page_id % 80 < 40",
    "write_mart_checks": """select 'rows' as check_name, count(*) as n from entity_candidates union all select 'null_lei', count(*) filter (where lei is null) from entity_candidates union all
        select 'null_country', count(*) filter (where country is null) from entity_candidates union all select 'unexpected_entity_status', count(*) filter (where entity_status not in ('active', 'inactive')) from entity_candidates""",
    "read_manifests": "select source, cast(load_date as varchar) as path_load_date, cast(file_id as varchar) as source_name, downloaded_bytes, status as file_status from manifest_files",
    "write_mart": "select * from entity_candidates",
    "page_content_hash": "select page_id, sha256(content) as content_hash from raw_pages",
    "clean_text": f"select raw_id, {clean('legal_name')} as plain, upper({clean('entity_status')}) as upper, lower({clean('entity_status')}) as lower from raw_entities",
    "normalize_status": f"select raw_id, {status('entity_status')} as entity_status, {status('registration_status')} as registration_status from raw_entities",
    "require_keys": "select raw_id, eu_reference_number from raw_fsf where trim(whole_name) <> '' and trim(eu_reference_number) <> ''",
    "snapshot_filter": "select raw_id, lei, source_load_date from raw_entities where source_load_date = (select max(source_load_date) from raw_entities)",
    "active_relationships": "select relationship_key, start_node_id, end_node_id from active_all where relationship_type = 'IS_DIRECTLY_CONSOLIDATED_BY'",
    "organization_names": "select sanctions_name_id, sanctions_name, sanctions_entity_type from organization_all",
    "filter_series": f"select {OBS} from ts where indicator_code = 'euro_short_term_rate'",
    "attach_subject": by_key("flagged", "sanction_subject_id", "primary_name", "source_countries", "source_programs"),
    "unify_name_subject": "select sanctions_name_id, sanction_subject_id, sanctions_entity_type from unify_names",
    "risk_join": f"select entity_candidate_id, {', '.join(COUNTS)}, max_match_quality_score from risk_all",
    "macro_context": "select * from entity_macro",
    "audit_history_join": "select job_run_id, job_name, target_table, total_run_count, last_success_at, last_failure_at, last_started_at, last_finished_at from audit",
    "latest_loads": "select a.*, e.display_name, e.sort_order from audit a join expected_tables e on e.target_table = a.target_table and e.is_active",
    "entity_profile": "select entity_candidate_id, lei, legal_name, country, has_any_parent, risk_score, risk_tier, total_sanctions_match_count from risk_all",
    "descendants_of": "select p.ancestor_lei, p.root_lei, m.legal_name, m.country, p.depth, case when p.depth = 1 then 'direct_child' else 'indirect_descendant' end as relation from parent_paths p join entity_master m on m.lei = p.root_lei where p.ancestor_lei like '%7'",
    "descendants_of_all": "select p.ancestor_lei, p.root_lei, m.legal_name, m.country, p.depth, case when p.depth = 1 then 'direct_child' else 'indirect_descendant' end as relation from parent_paths p join entity_master m on m.lei = p.root_lei",
    "same_parent_entities": "select direct_parent_lei, entity_candidate_id, lei, legal_name, country, count(*) over (partition by direct_parent_lei) as same_parent_group_size, count(*) over (partition by direct_parent_lei) - 1 as sibling_count from entity_master where direct_parent_lei is not null",
    "check_relationships": "select distinct end_node_id as value from stage_relationships where end_node_id not in (select lei from raw_entities where source_load_date = (select max(source_load_date) from raw_entities))",
    "string_agg_distinct": f"select subject_key, {agg('whole_name')} as names, {agg('regulation_title', ',')} as titles from stage_fsf group by subject_key",
    "risk_overview": "select count(*) as total_entities, " + ", ".join(f"count(*) filter (where risk_tier = '{t}') as {t}_count" for t in ("high", "medium", "review", "low_or_no_known_match")) + ", cast(coalesce(sum(total_sanctions_match_count), 0) as bigint) as total_matches from risk_all",
    "risk_tier_distribution": "select risk_tier, count(*) as entity_count, case risk_tier when 'high' then 1 when 'medium' then 2 when 'review' then 3 else 4 end as tier_order from risk_all group by risk_tier",
    "trend_slope": "select indicator_code, ref_area, round(raw_trend_slope * 1e9, 3) as raw_trend_slope, trend_observation_count from trends",
    "pipeline_metrics": """select count(*) as monitored_tables, cast(coalesce(sum(total_run_count), 0) as bigint) as total_runs, count(*) filter (where pipeline_health_status = 'healthy') as healthy_tables,
        count(*) filter (where pipeline_health_status = 'latest_failed_previous_success_available') as warning_tables, count(*) filter (where pipeline_health_status = 'not_healthy') as not_healthy_tables,
        count(*) filter (where pipeline_health_status = 'missing_run') as missing_run_tables, count(*) filter (where is_failed_or_incomplete_latest_run) as tables_with_failed_latest_run from expected_tables_status""",
    "inherited_freshness": """select w.model, case when bool_or(d.freshness_status is not distinct from 'stale') then 'stale' when bool_and(d.freshness_status is not distinct from 'fresh') then 'fresh' else 'unknown' end as freshness_status,
        max(d.snapshot_age_days) as snapshot_age_days, count(*) as source_count from wanted_sources w left join done_runs d on d.part = w.target_table group by w.model""",
    "table_row_counts": "select 'candidates' as table_name, count(*) as row_count from entity_candidates union all select 'subjects', count(*) from unify_subjects union all select 'names', count(*) from unify_names union all select 'edges', count(*) from relationship_edges",
    "check_unique": "select legal_name as value, count(*) as n from raw_entities where legal_name is not null group by legal_name having count(*) > 1",
    "check_not_null": "select " + ", ".join(f"count(*) filter (where {x} is null) as null_{x}" for x in ("lei", "country", "direct_parent_lei", "direct_parent_name")) + " from entity_master",
    "check_accepted_values": "select entity_status as value, count(*) as n from stage_lei where entity_status not in ('active', 'inactive') group by entity_status",
    "latest_by_key": f"select start_node_id, relationship_type, raw_id from raw_relationships {first('start_node_id, relationship_type', 'relationship_period_start_raw desc nulls first, raw_id desc')}",
    "stage_pages": f"select page_id, source_object_key, candidate_id from (select * from raw_pages where source_load_date = (select max(source_load_date) from raw_pages)) {first('candidate_id, source_object_key', 'raw_id desc')}",
    "canonical_fsf_subject": "select subject_key, raw_id, whole_name from fsf_subject_one",
    "canonical_fsf_name": "select subject_key, name_key, raw_id from fsf_name_one",
    "pick_parent": "select lei, parent_lei from parent_of where relationship_type = 'IS_DIRECTLY_CONSOLIDATED_BY'",
    "dedupe_names": "select target_id, name_type, name_normalized, position, name from opensanctions_names",
    "required_columns_check": "select 'lei' as column_name, true as present, count(nullif(trim(lei), '')) as filled_rows, count(*) as all_rows from raw_entities union all select 'legal_name', true, count(nullif(trim(legal_name), '')), count(*) from raw_entities union all select 'no_such_column', false, 0, count(*) from raw_entities",
    "dedupe_matches": f"select {MATCH}, sanctions_name_id from best_matches",
    "series_lag": f"select {OBS}, previous_obs_value, previous_obs_date from ts",
    "series_change": f"select {OBS}, {_r('change_abs')}, {_r('change_pct')} from ts",
    "rolling_averages": f"select {OBS}, {_r('rolling_avg_3_obs')}, {_r('rolling_avg_6_obs')}, {_r('rolling_avg_12_obs')} from ts",
    "series_rank_latest": f"select {OBS}, cast(recency_rank as int) as recency_rank, observation_count, is_latest_observation from ts",
    "level_momentum_percentile": f"select {OBS}, {_r('current_level_percentile')}, {_r('momentum_percentile')} from percentiles",
    "level_momentum_spread": f"select {OBS}, {_r('current_level_percentile')}, {_r('momentum_percentile')} from percentiles",
    "furthest_ancestor": "select root_lei, ancestor_lei, depth from parent_paths where is_furthest_ancestor",
    "latest_runs": "select job_run_id, job_name, target_table, status from latest_all",
    "worst_audit_per_table": "select target_table, job_name, pipeline_health_status from worst",
    "latest_manifest": f"select source, load_date, manifest_status from manifest_status where manifest_status in {GOOD} {first('source', 'load_date desc')}",
    "top_risk_entities": """select lei, legal_name_normalized, country, entity_status, registration_status, risk_score, risk_tier, total_sanctions_match_count, high_confidence_match_count, medium_confidence_match_count,
        review_required_match_count, source_entity_keys from risk_all where risk_tier <> 'low_or_no_known_match' order by risk_score desc, total_sanctions_match_count desc, legal_name_normalized, lei limit 25""",
    "search_entities": """select entity_candidate_id, lei, legal_name_normalized, country, entity_status, registration_status, legal_jurisdiction,
        case when lei ilike 'small%' then 1 when legal_name_normalized ilike 'small%' then 2 when legal_name ilike 'small%' then 3 else 4 end as hit_rank, risk_score, risk_tier,
        total_sanctions_match_count, high_confidence_match_count, medium_confidence_match_count, review_required_match_count from risk_all
        where lei ilike '%small%' or legal_name ilike '%small%' or legal_name_normalized ilike '%small%' order by hit_rank, risk_score desc, total_sanctions_match_count desc, legal_name_normalized, lei limit 50""",
    "entity_matches_ranked": """select entity_candidate_id, entity_sanctions_match_id, sanctions_source, sanctions_name, match_quality_score, match_quality_rank,
        cast(row_number() over (partition by entity_candidate_id order by match_quality_rank, match_quality_score desc, sanctions_source, sanctions_name, entity_sanctions_match_id) as int) as match_place from screening_view""",
    "pressure_indicators": "select pressure_indicator_id, indicator_code, ref_area, indicator_pressure_score, indicator_weight from indicator_pressure",
    "latest_observations": f"select {OBS} from ts where is_latest_observation",
    "indicator_options": "select distinct indicator_code, indicator_name from ts",
    "normalize_name": f"select doc_id, {norm('name')} as normalized from names_text",
    "normalize_identifier": f"select raw_id, {norm('identifiers', 'upper')} as identifier from raw_targets",
    "match_key": f"select raw_id, {key('legal_name')} as match_key from raw_entities",
    "explode_aliases": rf"""select raw_id, cast(pos as int) as alias_position, name as alias_name, {norm('name')} as alias_normalized from (select raw_id, pos, {clean("replace(alias, chr(34), '')")} as name from (select raw_id,
        unnest(regexp_split_to_array(aliases, '\s*;\s*')) as alias, unnest(range(1, len(regexp_split_to_array(aliases, '\s*;\s*')) + 1)) as pos from raw_targets)) where {norm('name')} is not null""",
    "quote_only_to_null": f"select raw_id, {unquoted('sanctions')} as sanctions from raw_targets",
    "has_non_ascii": "select doc_id, regexp_matches(name, '[^ -~]') as has_non_ascii from names_text",
    "iso_date_prefix": f"select raw_id, {iso('next_renewal_date_raw')} as next_renewal_date from raw_entities",
    "flexible_date": r"""select raw_id, case when regexp_matches(period, '^[0-9]{4}') then cast(substr(period, 1, 4) as int) end as year, case when regexp_matches(period, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') then try_cast(substr(period, 1, 10) as date)
        when regexp_matches(period, '^[0-9]{4}-[0-9]{2}$') then try_cast(period || '-01' as date) when regexp_matches(period, '^[0-9]{4}$') then make_date(cast(period as int), 1, 1) end as date from raw_periods""",
    "safe_timestamp": r"select raw_id, case when regexp_matches(trim(period), '^\d{4}-\d{2}-\d{2}') then try_cast(trim(period) as timestamp) end as ts from raw_periods",
    "strict_iso_timestamp": r"select raw_id, case when regexp_matches(period, '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$') then try_cast(period as timestamp) end as ts from raw_periods",
    "period_to_date": f"select raw_id, {period('period', 'frequency')} as date from raw_periods",
    "guarded_decimal": r"select raw_id, case when regexp_matches(trim(obs_value), '^-?\d+(\.\d+)?$') then cast(trim(obs_value) as double) end as obs_value from raw_observations",
    "strip_series_prefix": "select raw_id, case when upper(ecb_key) like upper(dataflow) || '.%' then substr(upper(ecb_key), length(dataflow) + 2) else upper(series_key) end as series_key from raw_observations",
    "effective_ref_area": f"select raw_id, area as ref_area, case area when 'U2' then 'Euro area' else area end as reference_area_name from (select raw_id, coalesce({upper('ref_area')}, case when upper(dataflow) = 'EST' then 'U2' end) as area from raw_observations)",
    "indicator_slug": f"select raw_id, {slug('trim(indicator_name)')} as indicator_code from raw_observations",
    "country_fallback": f"select raw_id, {COUNTRY} as country from raw_entities",
    "country_overlap": f"select {MATCH}, country_overlap_status, has_country_overlap from graded",
    "identifier_overlap": f"select {MATCH}, has_identifier_overlap from graded",
    "key_quality_flags": f"""select raw_id, match_key, length(match_key) as match_key_length, coalesce(length(match_key) <= 3, false) as is_short_match_key, coalesce(length(match_key) <= 2, false) as is_very_short_match_key,
        coalesce(match_key in ({', '.join(map(q, GENERIC_KEYS))}), false) as is_generic_match_key from (select raw_id, {key('legal_name')} as match_key from raw_entities)""",
    "match_quality": f"select {MATCH}, match_quality_score, match_quality_tier from graded",
    "match_reasons": f"select {MATCH}, match_quality_reasons from graded",
    "risk_score": f"select {RISK} from risk_all",
    "indicator_weight": f"select raw_id, cast({weight('indicator_code')} as double) as weight from stage_observations",
    "latest_of": "select lei, greatest(next_renewal_date, last_update_date, source_load_date) as latest from stage_lei",
    "md5_key": f"select raw_id, {md5('lei', 'legal_address_country', 'headquarters_address_country')} as skipping, {md5('lei', 'legal_address_country', 'headquarters_address_country', slots=True)} as slotted from raw_entities",
    "row_hash_md5": f"select raw_id, {md5('entity_logical_id', 'whole_name', 'programme', 'publication_date_raw', 'eu_reference_number', slots=True)} as row_hash from raw_fsf",
    "extract_json_row": "select raw_id, " + ", ".join(f"{sql} as {name}" for name, sql in FSF_ROW.items()) + " from raw_fsf",
    "fallback_name_key": "select raw_id, name_key from stage_fsf",
    "object_key_safe": "select page_id, trim(regexp_replace(regexp_replace(source_object_key, '[^A-Za-z0-9_-]', '_', 'g'), '_+', '_', 'g'), '_') as object_key from raw_pages",
    "snapshot_freshness": "select page_id, cast(date_diff('day', source_load_date, date '2024-05-04') as int) as age_days, case when date_diff('day', source_load_date, date '2024-05-04') <= 2 then 'fresh' else 'stale_warning' end as freshness_status from raw_pages",
    "run_duration": "select job_run_id, cast(round((epoch_us(finished_at) - epoch_us(started_at)) / 1000000.0) as int) as duration_seconds from runs",
    "pipeline_health": "select job_run_id, pipeline_health_status from audit",
    "page_quality_checks": """select page_id, check_name, case when coalesce(ok, false) then 'passed' else 'failed' end as check_status from (select page_id, 'min_size' as check_name, strlen(content) >= 500 as ok from raw_pages
        union all select page_id, 'marker:<title>', contains(content, '<title>') from raw_pages union all select page_id, 'marker:&amp;', contains(content, '&amp;') from raw_pages union all select page_id, 'utf8', content is not null from raw_pages)""",
    "job_sanctions_screening": f"select {{columns}} from risk_all",
    "job_hierarchy": "select * from relationship_context",
    "job_macro_pressure": "select * from entity_macro",
    "job_audit_status": "select * from audit",
}
SELECTS["job_sanctions_screening"] = (
    "select * exclude (source_load_date, risk_load_date), risk_load_date as source_load_date from risk_all"
)
for _name in ("stage_fsf", "stage_targets", "entity_candidates", "screening_view", "macro_applicability", "match_names", "canonical_plus_rollup", "parent_summary", "entity_master", "relationship_context",
              "expected_tables_status", "fsf_subject_rollup", "fsf_name_rollup", "sanctions_summary", "child_counts", "descendant_counts", "sibling_group_size", "path_summary", "weighted_macro_score", "macro_summary",
              "run_history", "manifest_status", "quality_summary", "stage_lei", "stage_relationships", "stage_observations", "canonical_targets", "unify_subjects", "unify_names", "opensanctions_names", "relationship_edges",
              "indicator_pressure", "macro_level", "parent_paths"):
    SELECTS[_name] = f"select * from {_name}"


def _with(select: str) -> str:
    """The query behind those steps that it needs, in order."""
    library = {**FIXTURES, **STEPS}
    needed: set[str] = set()
    todo = [select]
    while todo:
        for word in set(re.findall(r"\w+", todo.pop())) & library.keys() - needed:
            needed.add(word)
            todo.append(library[word])
    parts = [f"{name} as ({sql})" for name, sql in library.items() if name in needed]
    return ("with recursive " + ",\n".join(parts) + "\n" if parts else "") + select


ORACLES: dict[str, str] = {name: _with(select) for name, select in SELECTS.items()}
