"""Inputs in the shape that the jobs expect, derived from the given tables by SQL that Spark and DuckDB share."""

from __future__ import annotations

COUNTRIES = "DEFRITESGBUSCHNLPLCZATBEHRCYEEFIGRIELVLTLUMTNOSE"

_ENTITY = f"""
    select c.c_custkey * 2 + {{snapshot}} as raw_id, date '{{day}}' as source_load_date,
        'LEI' || lpad(cast(c.c_custkey as string), 17, '0') as lei,
        case when c.c_custkey % 89 = 5 and {{snapshot}} = 1 then ' ' when c.c_custkey % 5 = 0 then upper(p.p_name) || ',  ' || p.p_brand || ' ' when c.c_custkey % 97 = 1 then 'Bank' else p.p_name || ', ' || p.p_brand end as legal_name,
        case when c.c_mktsegment = 'BUILDING' then 'N/A' when c.c_mktsegment = 'FURNITURE' then '' when c.c_mktsegment = 'MACHINERY' then 'INACTIVE' else 'Active ' end as entity_status,
        case when c.c_custkey % 7 = 0 then 'LAPSED' else 'ISSUED' end as registration_status,
        case when c.c_custkey % 3 = 0 then substring('{COUNTRIES}', cast(c.c_nationkey % 24 * 2 + 1 as int), 2) || '-XX' else substring('{COUNTRIES}', cast(c.c_nationkey % 24 * 2 + 1 as int), 2) end as legal_jurisdiction,
        case when c.c_nationkey % 6 = 0 then null else substring('{COUNTRIES}', cast(c.c_nationkey % 24 * 2 + 1 as int), 2) end as legal_address_country,
        case when c.c_nationkey % 4 = 0 then null else substring('{COUNTRIES}', cast((c.c_nationkey + 1) % 24 * 2 + 1 as int), 2) end as headquarters_address_country,
        case when c.c_custkey % 11 = 0 then 'soon' else '2025-0' || cast(c.c_custkey % 9 + 1 as string) || '-15T00:00:00Z' end as next_renewal_date_raw,
        '2024-0' || cast(c.c_custkey % 9 + 1 as string) || '-0{{snapshot}}' as last_update_date_raw,
        'gleif/load_date={{day}}/lei.csv' as source_object_key
    from customer c join part p on p.p_partkey = c.c_custkey where c.c_custkey % 13 != {{skipped}}"""

#: In order: each may name tables and the ones before.
FIXTURES: dict[str, str] = {
    "raw_entities": _ENTITY.format(snapshot=0, day="2024-05-01", skipped=99) + " union all " + _ENTITY.format(snapshot=1, day="2024-05-02", skipped=4),
    "raw_relationships": """
        select o_orderkey as raw_id, date '2024-05-02' as source_load_date,
            'LEI' || lpad(cast(o_custkey as string), 17, '0') as start_node_id,
            'LEI' || lpad(cast((o_orderkey * 7 + 3) % n.n as string), 17, '0') as end_node_id,
            case when o_orderkey % 2 = 0 then 'IS_DIRECTLY_CONSOLIDATED_BY' else 'IS_ULTIMATELY_CONSOLIDATED_BY' end as relationship_type,
            case when o_custkey % 5 = 0 then 'INACTIVE' when o_orderstatus = 'O' then 'ACTIVE' when o_orderstatus = 'P' then '' else 'INACTIVE' end as relationship_status,
            case when o_orderpriority = '5-LOW' then 'RETIRED' else 'PUBLISHED' end as registration_status,
            case when o_orderkey % 9 = 0 then null else cast(cast(o_orderdate as date) as string) end as relationship_period_start_raw,
            cast(cast(o_orderdate as date) as string) as last_update_date_raw
        from orders, (select count(*) as n from customer) n""",
    "raw_fsf": """
        select ((l_orderkey * 8 + l_linenumber) * 200003 + l_partkey) * 10007 + l_suppkey as raw_id,
            case when l_linenumber % 2 = 0 then date '2024-05-02' else date '2024-05-01' end as source_load_date,
            cast(l_suppkey as bigint) as entity_logical_id, case when l_suppkey % 3 = 0 then 'eu.' || cast(l_suppkey - l_suppkey % 6 as string) when l_suppkey % 7 = 0 then '' end as eu_reference_number,
            case when l_suppkey % 2 = 0 then 'Enterprise' else 'Person' end as subject_type,
            case when l_partkey % 11 = 0 then null else cast(l_partkey as bigint) end as name_alias_logical_id, '  ' || p_name || ' ' || p_brand as whole_name,
            l_returnflag as programme, l_linestatus as regulation_type, cast(cast(l_quantity as int) as string) as regulation_title,
            cast(cast(l_shipdate as date) as string) as publication_date_raw,
            case when l_linenumber % 3 = 0 then null else l_linenumber end as address_logical_id, case when l_quantity > 30 then cast(l_quantity as bigint) end as birth_date_logical_id,
            case when l_linenumber > 2 then cast(l_linenumber + l_suppkey % 3 as bigint) end as identification_logical_id, case when l_quantity < 9 then cast(l_quantity as bigint) end as citizenship_logical_id,
            'de' as address_country, case when l_linenumber = 1 then ' Berlin ' end as address_city
        from lineitem join part on p_partkey = l_partkey""",
    "raw_targets": """
        select p_partkey as raw_id, date '2024-05-02' as source_load_date, 'os-' || cast(p_partkey - p_partkey % 2 as string) as id,
            case p_type when 'ECONOMY' then 'Company' when 'LARGE' then 'Organization' when 'STANDARD' then 'LegalEntity' when 'PROMO' then 'Person' when 'SMALL' then 'Vessel' else 'Company' end as schema,
            case when p_partkey % 61 = 3 then ' ' when p_partkey % 61 = 4 then '"' else p_name || '  ' || p_brand end as caption,
            p_name || ' ; "' || p_name || ' "' || p_type || '"";' || p_name || '  ' || p_brand || ';;' as aliases, case when p_size % 2 = 0 then '1980-01' end as birth_date,
            case when p_size % 3 = 0 then null when p_size % 3 = 1 then 'de' else ' De;fr' end as countries, case when p_size % 5 = 0 then ' Some Street 1 ' end as addresses,
            case when p_partkey % 50 = 0 then 'x LEI' || lpad(cast(p_partkey as string), 17, '0') end as identifiers,
            case when p_partkey % 30 = 0 then '""' else 'listed ' || p_brand end as sanctions, case when p_size % 9 = 0 then '""' else lower(p_brand) end as program_ids, case when p_size % 4 = 0 then '+1 22' end as phones,
            case when p_size % 4 = 1 then 'A@B.example' end as emails, case when p_size % 2 = 0 then 'EU_List' else 'eu_list;Us_List' end as datasets, '2020-01-01T00:00:00' as first_seen, '2023-02-02' as last_seen,
            case when p_partkey % 7 = 0 then 'bad' else '2023-01-0' || cast(p_partkey % 9 + 1 as string) || 'T10:00:00' end as last_change
        from part""",
    "raw_observations": """
        select event_id as raw_id, case when event_id % 3 = 0 then date '2024-05-01' else date '2024-05-02' end as source_load_date, 'ds_' || event_type as dataset_code, event_type || '.' || cast(user_id as string) as series_key,
            case when event_id % 5 = 0 then null when event_id % 11 = 0 then 'other.' || event_type || '.' || cast(user_id as string) else case when event_type = 'view' then 'est' else 'fm' end || '.' || event_type || '.' || cast(user_id as string) end as ecb_key,
            case event_type when 'click' then 'Cost of borrowing for corporations' when 'view' then 'Euro short-term rate' when 'purchase' then ' AAA yield curve 10Y spot rate'
                when 'signup' then 'AAA yield curve 2Y spot rate' else case when user_id % 50 = 7 then ' ' else ' Other Indicator (x) ' end end as indicator_name,
            case when event_type = 'view' then 'est' when event_type = 'signup' and user_id % 10 = 3 then null else 'FM' end as dataflow,
            case when event_id % 4 = 0 then null when event_id % 4 = 1 then 'm' else 'D' end as freq, case when event_id % 4 = 0 then 'a' end as frequency, ' pct' as unit,
            case when user_id = 0 then 'u2' when user_id = 1 then null else 'a' || cast(user_id as string) end as ref_area,
            case when event_id % 40 in (5, 6) then '201' || cast(event_id % 10 as string) || '-0' || cast(event_id % 8 + 2 as string) when event_id % 40 in (8, 9) then '199' || cast(event_id % 7 as string)
                else cast(cast(ts as date) as string) end as time_period, case when event_id % 97 = 0 then 'n/a' else cast(cast(value as decimal(18, 6)) as string) end as obs_value
        from events""",
    "raw_periods": """
        select o_orderkey as raw_id, case o_orderkey % 6 when 0 then substring(cast(cast(o_orderdate as date) as string), 1, 7)
            when 1 then substring(cast(cast(o_orderdate as date) as string), 1, 4) || '-Q' || cast(o_orderkey % 4 + 1 as string)
            when 2 then substring(cast(cast(o_orderdate as date) as string), 1, 4) when 3 then cast(cast(o_orderdate as date) as string)
            when 4 then cast(cast(o_orderdate as date) as string) || 'T0' || cast(o_orderkey % 10 as string) || ':00:00'
            else case when o_orderkey % 4 = 1 then substring(cast(cast(o_orderdate as date) as string), 1, 4) || 'abc' when o_orderkey % 4 = 3 then '2023-02-30x' else 'junk ' || cast(o_orderkey as string) end end as period,
            case o_orderkey % 4 when 0 then 'M' when 1 then 'A' when 2 then 'Q' end as frequency from orders""",
    "raw_pages": "select page_id, url as source_object_key, html as content, page_id % 40 as candidate_id, date '2024-05-01' + cast(page_id % 3 as int) as source_load_date, page_id as raw_id from pages",
    "names_text": "select doc_id, replace(text, chr(10), ' ') as name from documents",
    "job_runs": """
        select event_id as job_run_id, 'job_' || event_type as job_name, case when user_id % 12 = 11 then null when user_id % 12 = 10 then 't10 , t12' else 't' || cast(user_id % 12 as string) end as target_table,
            ts as started_at, case when event_id % 10 = 0 then null else ts end as finished_at, cast(floor(value) as bigint) as seconds,
            case when event_id % 7 = 0 or user_id % 3 = 2 and event_id % 7 in (2, 4, 6) then 'failed' when event_id % 7 = 1 or user_id % 3 = 2 then 'running'
                when event_id % 7 = 2 then 'success_with_warnings' else 'success' end as status,
            case when user_id % 12 = 6 then 'stale' else case event_id % 4 when 0 then 'fresh' when 1 then 'stale_warning' when 2 then 'fresh' else null end end as freshness_status,
            cast(event_id % 9 as int) as snapshot_age_days, case when event_id % 3 = 0 then null else event_id % 1000 end as rows_read, case when event_id % 3 = 1 then event_id % 900 end as rows_inserted,
            cast(ts as date) as effective_load_date, case when event_id % 7 = 0 then 'no answer' end as error_message from events""",
    "expected_tables": " union all ".join(f"select '{t}' as target_table, 'Table {t}' as display_name, {str(t != 't9').lower()} as is_active, {i} as sort_order" for i, t in enumerate([f"t{k}" for k in range(10)] + ["never_runs"])),
    "manifest_files": """
        select 'src_' || event_type as source, cast(ts as date) as load_date, event_id as file_id,
            case when event_type = 'click' and day(cast(ts as date)) = 8 then 'success' when event_id % 211 = 0 or event_type = 'view' and day(cast(ts as date)) = 7 then 'failed' when event_id % 13 = 0 then 'skipped' else 'success' end as status,
            event_id % 5000 as downloaded_bytes from events""",
    "manifest_checks": """
        select event_id as file_id, k.n as check_number, case when event_type = 'click' and day(cast(ts as date)) = 8 then 'passed' when (event_id + k.n) % 37 = 0 or (event_id + k.n) % 401 = 0 then 'failed' else 'passed' end as status,
            case when (event_id + k.n) % 401 = 0 then 'error' when (event_id + k.n) % 74 = 0 then null else 'warning' end as severity from events, (select 1 as n union all select 2) k where event_id % 17 != 3""",
    "model_sources": "select 'model_' || cast(n_nationkey % 8 as string) as model, 't' || cast(n_nationkey % 10 as string) || ', t' || cast(n_nationkey % 8 * 3 % 14 as string) as targets from nation where n_nationkey < 16",
}
