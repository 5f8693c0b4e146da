"""The same queries in SQL for DuckDB, on the driver's tables as views."""

from __future__ import annotations

_STEPS = {
    "claims": """
        select cast(o_custkey as varchar) as npi, cast(l_suppkey as varchar) as servicing_npi,
               p_type as procedure_code, cast(date_trunc('month', l_shipdate) as date) as service_month,
               cast(1 as bigint) as beneficiaries, cast(l_quantity as bigint) as total_claims,
               cast(l_extendedprice * (1 - l_discount) as decimal(18,4)) as total_paid
        from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey""",
    "registry": """
        select cast(c_custkey as varchar) as npi,
               case when c_mktsegment = 'BUILDING' then '2' else '1' end as entity_type,
               c_name as name,
               case when c_custkey % 10 = 0 then '' else n_name end as practice_state,
               n_name as mailing_state,
               lpad(cast(c_custkey as varchar), 5, '0') || '1234' as postal_code,
               case when c_acctbal < 0 then '2020-01-01' else '' end as deactivation_date
        from customer join nation on c_nationkey = n_nationkey""",
    "monthly": """
        select npi, service_month, cast(sum(total_claims) as bigint) as total_claims,
               sum(total_paid) as total_paid, cast(sum(beneficiaries) as bigint) as beneficiaries
        from claims group by npi, service_month""",
    "procedures": """
        select npi, procedure_code, service_month,
               cast(sum(total_claims) as bigint) as total_claims, sum(total_paid) as total_paid
        from claims group by npi, procedure_code, service_month""",
    "totals": """
        select npi, cast(sum(total_claims) as bigint) as total_claims,
               sum(total_paid) as total_paid from monthly group by npi""",
    "qualified": "select * from totals where total_paid >= 1000000",
    "state_map": """
        select npi, upper(trim(case when practice_state = '' then mailing_state
                                    else practice_state end)) as state from registry""",
    "organizations": "select npi from registry where entity_type = '2'",
    "lead_codes": """
        select npi, procedure_code from (
            select npi, procedure_code, row_number() over (
                partition by npi order by sum(total_claims) desc, procedure_code) as place
            from procedures group by npi, procedure_code) where place = 1""",
    "volume_all": """
        select npi, service_month, total_claims, least(1.0, total_claims / 300.0::double) as severity
        from monthly where total_claims > 100 and npi in (select npi from qualified)""",
    "volume": """
        select * from volume_all where npi not in (select npi from organizations)
        and npi not in (select npi from lead_codes where procedure_code = 'STANDARD')""",
    "rates": """
        select npi, total_paid, total_claims,
               total_paid::double / total_claims as paid_per_claim
        from qualified where total_claims > 0""",
    "middle": "select median(paid_per_claim) as median from rates",
    "baseline": """
        select median, (select median(abs(paid_per_claim - median)) from rates) as mad
        from middle""",
    "revenue": """
        select npi, total_paid, total_claims, paid_per_claim, median, z,
               least(1.0, z / 10) as severity
        from (select *, (paid_per_claim - median) / (mad * 1.4826) as z
              from rates cross join baseline where mad > 0) where z > 3""",
    "spikes": """
        select npi, service_month, total_paid, mean_paid, months,
               total_paid::double / mean_paid as ratio,
               least(1.0, total_paid::double / mean_paid / 10) as severity
        from (select npi, service_month, total_paid,
                     count(total_paid) over (partition by npi) as months,
                     (sum(total_paid) over (partition by npi))::double
                         / count(total_paid) over (partition by npi) as mean_paid
              from monthly where npi in (select npi from qualified))
        where months >= 3 and mean_paid > 0 and total_paid::double / mean_paid > 3""",
    "code_stats": """
        select npi, procedure_code, sum(total_paid) as code_paid,
               cast(sum(total_claims) as bigint) as code_claims,
               avg(total_paid::double / total_claims) as mean_rate,
               coalesce(stddev_samp(total_paid::double / total_claims), 0) as std_rate,
               count(*) as rate_months
        from procedures group by npi, procedure_code""",
    "dominant": """
        select npi, procedure_code, share, mean_rate, std_rate / mean_rate as cv,
               rate_months as months
        from (select *, code_paid::double / (sum(code_paid) over (partition by npi))::double as share,
                     row_number() over (partition by npi order by code_paid desc, procedure_code)
                         as place from code_stats) where place = 1""",
    "consistency": """
        select npi, procedure_code, share, mean_rate, cv, months,
               least(1.0, share * (1 - cv)) as severity
        from dominant where share >= 0.25 and months >= 3 and cv < 0.40
        and npi in (select npi from qualified)""",
    "nos": """
        select npi, nos_paid, total_paid, share, least(1.0, share / 0.5) as severity
        from (select npi, sum(total_paid) as total_paid,
                     sum(total_paid) filter (where procedure_code = 'PROMO') as nos_paid,
                     nos_paid::double / (sum(total_paid))::double as share
              from procedures group by npi)
        where share >= 0.25 and npi in (select npi from qualified)""",
    "visits": """
        select npi, service_month, sum(total_claims)::bigint as claims, sum(total_paid) as paid,
               sum(total_claims * case procedure_code when 'ECONOMY' then 1 when 'SMALL' then 2
                   when 'STANDARD' then 3 when 'MEDIUM' then 4 when 'LARGE' then 5 end)::bigint
                   as points
        from procedures where procedure_code in ('ECONOMY','SMALL','STANDARD','MEDIUM','LARGE')
        group by npi, service_month""",
    "halves": """
        select npi, max(months)::bigint as months, sum(claims)::bigint as claims, sum(paid) as paid,
               coalesce(sum(points) filter (where place <= months // 2)::double
                   / nullif(sum(claims) filter (where place <= months // 2), 0), 0) as early_level,
               coalesce(sum(points) filter (where place > months // 2)::double
                   / nullif(sum(claims) filter (where place > months // 2), 0), 0) as late_level
        from (select *, count(*) over (partition by npi) as months,
                     dense_rank() over (partition by npi order by service_month) as place
              from visits) group by npi""",
    "upcoding": """
        select npi, early_level, late_level, late_level - early_level as shift, claims, paid,
               least(1.0, (late_level - early_level) / 1.5) as severity
        from halves where months >= 6 and claims >= 50 and late_level - early_level >= 0.4
        and npi in (select npi from qualified)""",
    "flags": """
        select npi, 'volume_impossibility' as flag_type, service_month, severity, 1 as place,
               format('{:,} claims in {} (max plausible: 100)', total_claims,
                      cast(service_month as varchar)) as description
        from volume
        union all
        select npi, 'revenue_outlier', null, severity, 2,
               format('Revenue per claim ${:,.2f} ({:.1f} MADs above median ${:,.2f}/claim)',
                      paid_per_claim, z, median)
        from revenue
        union all
        select npi, 'billing_spike', service_month, severity, 3,
               format('Monthly paid ${:,.2f} in {} is {:.1f}x their average ${:,.2f}',
                      total_paid::double, cast(service_month as varchar), ratio, mean_paid)
        from spikes
        union all
        select npi, 'suspicious_consistency', null, severity, 4,
               format('{:.0f}% of billing is procedure {} at ${:,.2f}/claim with only {:.1f}% rate '
                      || 'variation across {} months — consistent with copy-paste billing',
                      share * 100, procedure_code, mean_rate, cv * 100, months)
        from consistency
        union all
        select npi, 'nos_code_concentration', null, severity, 5,
               format('{:.0f}% of billing (${:,.0f}) under miscellaneous/unclassified codes — '
                      || 'vague codes obscure what was actually provided',
                      share * 100, nos_paid::double)
        from nos
        union all
        select npi, 'upcoding_trajectory', null, severity, 6,
               format('E&M code level shifted +{:.2f} points over time ({:.2f} → {:.2f}) — '
                      || 'systematic upgrade toward higher-reimbursed codes across {:,} claims',
                      shift, early_level, late_level, claims)
        from upcoding""",
    "scored": """
        select npi, least(1.0, 0.4::double * max_severity + 0.15::double * distinct_types
                               + 0.2::double * scheme_types) as overall_score,
               max_severity, num_flags, distinct_types, scheme_types, flag_types
        from (select npi, max(severity) as max_severity, count(*) as num_flags,
                     count(distinct flag_type) as distinct_types,
                     count(distinct flag_type) filter (where flag_type in
                         ('nos_code_concentration', 'upcoding_trajectory')) as scheme_types,
                     string_agg(distinct flag_type, ', ' order by flag_type) as flag_types
              from flags group by npi)""",
    "results": "select * from scored where overall_score >= 0.3",
    "ranked": """
        select row_number() over (order by overall_score desc, npi) as rank, * from results""",
    "cells": """
        select npi, procedure_code, service_month, count(*) as row_count,
               cast(sum(total_claims) as bigint) as total_claims, sum(total_paid) as total_paid,
               cast(sum(beneficiaries) as bigint) as beneficiaries
        from claims group by all""",
    "summary": """
        select npi, cast(sum(row_count) as bigint) as total_rows,
               cast(sum(total_claims) as bigint) as total_claims,
               sum(total_paid)::double as total_paid,
               cast(sum(beneficiaries) as bigint) as total_beneficiaries,
               min(service_month) as date_range_start, max(service_month) as date_range_end,
               count(distinct service_month) as active_months
        from cells group by npi""",
    "first_codes": """
        select * from (
            select npi, procedure_code, cast(sum(row_count) as bigint) as row_count,
                   cast(sum(total_claims) as bigint) as claims, sum(total_paid)::double as paid,
                   row_number() over (partition by npi
                       order by sum(row_count) desc, procedure_code) as place
            from cells group by npi, procedure_code) where place <= 10""",
    "breakdown": """
        select npi, service_month, place, procedure_code, total_claims as claims,
               total_paid::double as total_paid,
               round_even(total_paid::double / month_paid::double * 100, 1) as pct_of_month
        from (select *, row_number() over (partition by npi, service_month
                                           order by total_paid desc, procedure_code) as place,
                     dense_rank() over (partition by npi order by service_month desc) as back,
                     sum(total_paid) over (partition by npi, service_month) as month_paid
              from procedures)
        where back <= 12 and month_paid > 0 and place <= 5""",
    "peers": """
        select npi, n as peer_count, total_paid::double as provider_total_paid,
               round_even(mean, 2) as peer_mean_paid, round_even(middle, 2) as peer_median_paid,
               round_even((select count(*) from totals as o where o.total_paid <= t.total_paid)
                   / n::double * 100, 1) as provider_percentile,
               round_even(case when spread > 0 then (total_paid::double - mean) / spread end, 2)
                   + 0 as zscore
        from totals as t cross join (
            select count(*) as n, sum(total_paid)::double / count(*) as mean,
                   median(total_paid::double) as middle,
                   stddev_samp(total_paid::double) as spread from totals)""",
}


def _with(*last: str) -> str:
    """The steps that the named ones need, as the start of a statement."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for other in _STEPS:
            if other != name and _reads(_STEPS[name], other):
                add(other)
        if name not in wanted:
            wanted.append(name)

    for name in last:
        add(name)
    return "with " + ",\n".join(f"{name} as ({_STEPS[name]})" for name in wanted)


def _reads(sql: str, step: str) -> bool:
    words = sql.replace("(", " ").replace(")", " ").replace(",", " ").split()
    return any(a in ("from", "join") and b == step for a, b in zip(words, words[1:]))


def _select(columns: str, step: str, rest: str = "") -> str:
    return f"{_with(step)}\nselect {columns} from {step} {rest}"


def _money(name: str) -> str:
    return f"round({name}::double, 4) as {name}"


def _six(*names: str) -> str:
    return ", ".join(f"{_rounded(name)} as {name}" for name in names)


def _rounded(name: str) -> str:
    return f"round({name}::decimal(38,10), 6)::double"


_CLAIM = (
    "npi, servicing_npi, procedure_code, service_month, beneficiaries, total_claims, "
    + _money("total_paid")
)
_SCORE = (
    "npi, " + _six("overall_score", "max_severity")
    + ", num_flags, distinct_types, scheme_types, flag_types"
)
_MONTHLY = f"npi, service_month, total_claims, {_money('total_paid')}, beneficiaries"
_PROCEDURE = f"npi, procedure_code, service_month, total_claims, {_money('total_paid')}"
_REVENUE = (
    f"npi, {_money('total_paid')}, total_claims, "
    + _six("paid_per_claim", "median", "z", "severity")
)
_VOLUME = "npi, service_month, total_claims, " + _six("severity")
_MONTH_TEXT = "coalesce(cast(service_month as varchar), '') as service_month"
_IN_REGION = """deactivation_date = '' and practice_state = 'NATION_3'
    and substring(postal_code, 1, 3) in ('000', '001', '002', '003')"""
_PROVIDER = """'' as address, '' as city,
    case when practice_state = '' then mailing_state else practice_state end as state,
    substring(postal_code, 1, 5) as zip"""
_DESCRIPTION = (
    "case when procedure_code = 'PROMO' then '' else 'Items of type ' || lower(procedure_code) end")
_DOSSIER = f"""
    {_with('results', 'summary', 'first_codes', 'breakdown', 'peers', 'registry')}
    select results.npi, name,
           case when practice_state = '' then mailing_state else practice_state end as state,
           'NPI-' || entity_type as enumeration_type,
           {_rounded('overall_score')} as overall_score, num_flags, total_rows, total_claims,
           {_rounded('total_paid')} as total_paid, date_range_start, date_range_end, active_months,
           (select string_agg(procedure_code, ', ' order by place) from first_codes as f
            where f.npi = results.npi) as top_procedures,
           (select count(*) from breakdown as b where b.npi = results.npi) as breakdown_rows,
           active_months as timeline_months, provider_percentile as percentile
    from results join summary using (npi) join peers using (npi) join registry using (npi)"""


# Queries that show dates, which both sides give as text.
_DATED = {
    "service_month": (
        "claims_normalized", "claims_csv_roundtrip", "provider_claims", "monthly_summary",
        "procedure_summary", "qualifying_monthly", "qualifying_procedure", "region_subset",
        "volume_flags", "volume_flags_no_exclusion", "spike_flags", "provider_history",
        "procedure_monthly", "billing_timeline", "month_store_monthly", "month_store_procedure",
        "month_store_manifest", "dossier_lists",
    ),
    "date_range_start": ("claims_summary", "dossier", "dossier_roundtrip", "dossier_lookup"),
    "date_range_end": ("claims_summary", "dossier", "dossier_roundtrip", "dossier_lookup"),
}


def statements() -> dict[str, str]:
    return {name: _dates_as_text(name, sql) for name, sql in _statements().items()}


def _dates_as_text(name: str, sql: str) -> str:
    dates = [column for column, names in _DATED.items() if name in names]
    if not dates:
        return sql
    texts = ", ".join(f"cast({column} as varchar) as {column}" for column in dates)
    return f"select * replace ({texts}) from (\n{sql}\n)"


def _statements() -> dict[str, str]:
    scan = _select(_SCORE, "results")
    payload_flags = f"""{_with('ranked', 'flags')}
        select (select count(*) from results) as total, rank, npi,
               round_even(overall_score, 3) as overall_score, num_flags, flag_types,
               (select string_agg(flag_type, ', ' order by place, service_month)
                from flags where flags.npi = ranked.npi) as red_flags
        from ranked where rank <= 50"""
    funnel = f"""{_with('scored', 'flags', 'totals', 'qualified')}
            select 'seen' as stage, count(*) as providers from totals
            union all select 'qualifying', count(*) from qualified
            union all select 'excluded', count(*) from totals where total_paid < 1000000
            union all select 'in_scope', count(*) from qualified
            union all select flag_type, count(distinct npi)
                      from (values ('volume_impossibility'), ('revenue_outlier'),
                            ('billing_spike'), ('suspicious_consistency'),
                            ('nos_code_concentration'), ('upcoding_trajectory')) as k(flag_type)
                      left join flags using (flag_type) group by flag_type
            union all select 'scored', count(*) from scored
            union all select 'above_threshold', count(*) from scored
                      where overall_score >= 0.3"""
    return {
        "claims_normalized": _select(_CLAIM, "claims"),
        "claims_csv_roundtrip": _select(_CLAIM, "claims"),
        "provider_claims": _select(_CLAIM, "claims", "where npi = '20'"),
        "providers_distinct": _select("distinct npi", "claims"),
        "monthly_summary": _select(_MONTHLY, "monthly"),
        "procedure_summary": _select(_PROCEDURE, "procedures"),
        "qualifying_monthly": f"""{_with('monthly', 'qualified')}
            select {_MONTHLY} from monthly where npi in (select npi from qualified)""",
        "qualifying_procedure": f"""{_with('procedures', 'qualified')}
            select {_PROCEDURE} from procedures where npi in (select npi from qualified)""",
        "summaries_roundtrip": f"""{_with('monthly', 'procedures')}
            select npi, month_rows, round(month_paid::double, 4) as month_paid,
                   beneficiaries, procedure_rows,
                   round(procedure_paid::double, 4) as procedure_paid
            from (select npi, count(*) as month_rows, sum(total_paid) as month_paid,
                         cast(sum(beneficiaries) as bigint) as beneficiaries
                  from monthly group by npi)
            join (select npi, count(*) as procedure_rows, sum(total_paid) as procedure_paid
                  from procedures group by npi) using (npi)""",
        "registry_state_map": _select("npi, state", "state_map"),
        "registry_organizations": _select("npi", "organizations"),
        "registry_display_name": _select("npi, name", "registry"),
        "registry_search_name": _select(
            f"npi, name, {_PROVIDER}, '' as taxonomy", "registry",
            "where lower(name) like '%customer#00000012%' order by npi limit 10",
        ),
        "registry_search_npi": _select(
            f"lpad(npi, 10, '0') as npi, name, {_PROVIDER}, '' as taxonomy", "registry",
            "where npi = '20'",
        ),
        "registry_search_state": _select(
            f"npi, name, {_PROVIDER}, '' as taxonomy", "registry",
            "where practice_state = 'NATION_3' and lower(name) like '%customer#%'",
        ),
        "registry_json_provider": _select(
            """npi, case when entity_type = '2' then name else 'Pat ' || name || ', MD' end as name,
               practice_state as specialty, npi || ' Main St' as address, '' as city,
               mailing_state as state, substring(postal_code, 1, 5) as zip,
               'NPI-' || entity_type as enumeration_type""",
            "registry", "where cast(npi as bigint) % 7 <> 0",
        ),
        "registry_csv_roundtrip": _select(
            "npi, case when entity_type = '2' then 'The \"' || name || '\", Inc. \\' else name end as name, "
            f"{_PROVIDER}, '' as specialty, 'NPI-' || entity_type as enumeration_type",
            "registry",
        ),
        "region_subset": f"""{_with('claims', 'registry')}
            select {_CLAIM} from claims
            where npi in (select npi from registry where {_IN_REGION})""",
        "region_counts": f"""{_with('claims', 'registry')}
            select count(distinct npi) as providers, count(*) as claim_rows from claims
            where npi in (select npi from registry where {_IN_REGION})""",
        "org_by_top_code": _select(
            """npi, procedure_code,
               cast(procedure_code = 'STANDARD' as bigint) as bills_like_organization""",
            "lead_codes",
        ),
        "volume_flags": _select(_VOLUME, "volume"),
        "volume_flags_no_exclusion": _select(_VOLUME, "volume_all"),
        "revenue_baseline": _select(_six("median", "mad"), "baseline"),
        "revenue_flags": _select(_REVENUE, "revenue"),
        "revenue_flags_approx": f"""{_with('rates')},
            middle_value as (select quantile_disc(paid_per_claim, 0.5) as median from rates),
            deviation as (
                select median,
                       (select quantile_disc(abs(paid_per_claim - median), 0.5) from rates) as mad
                from middle_value)
            select {_REVENUE}
            from (select *, least(1.0, z / 10) as severity
                  from (select *, (paid_per_claim - median) / (mad * 1.4826) as z
                        from rates cross join deviation where mad > 0) where z > 3)""",
        "revenue_flags_state": f"""{_with('revenue', 'state_map')}
            select {_REVENUE} from revenue
            where npi in (select npi from state_map where state = 'NATION_14')""",
        "spike_flags": _select(
            f"npi, service_month, {_money('total_paid')}, months, "
            + _six("mean_paid", "ratio", "severity"), "spikes",
        ),
        "dominant_procedure": _select("npi, procedure_code, " + _six("share"), "dominant"),
        "rate_stats": _select(
            f"npi, procedure_code, {_money('code_paid')}, code_claims, rate_months, "
            + _six("mean_rate", "std_rate"), "code_stats",
        ),
        "consistency_flags": _select(
            "npi, procedure_code, months, " + _six("share", "mean_rate", "cv", "severity"),
            "consistency",
        ),
        "nos_flags": _select(
            f"npi, {_money('nos_paid')}, {_money('total_paid')}, " + _six("share", "severity"),
            "nos",
        ),
        "upcoding_halves": _select(
            f"npi, months, claims, {_money('paid')}, " + _six("early_level", "late_level"),
            "halves",
        ),
        "upcoding_flags": _select(
            f"npi, claims, {_money('paid')}, "
            + _six("early_level", "late_level", "shift", "severity"), "upcoding",
        ),
        "all_flags": _select(f"npi, flag_type, {_MONTH_TEXT}, " + _six("severity"), "flags"),
        "provider_scores": _select(_SCORE, "scored"),
        "provider_scores_four_signal": f"""{_with('flags')}
            select npi, {_rounded('overall_score')} as overall_score,
                   {_rounded('max_severity')} as max_severity, num_flags, distinct_types,
                   cast(0 as bigint) as scheme_types, flag_types
            from (select npi, max(severity) as max_severity, count(*) as num_flags,
                         count(distinct flag_type) as distinct_types,
                         least(1.0, 0.5::double * max(severity)
                               + 0.2::double * count(distinct flag_type)) as overall_score,
                         string_agg(distinct flag_type, ', ' order by flag_type) as flag_types
                  from flags where place <= 4 group by npi) where overall_score >= 0.3""",
        "scan": scan,
        "scan_from_summaries": scan,
        "scan_top": _select("rank, " + _SCORE, "ranked", "where rank <= 50"),
        "scan_ranked": _select("rank, npi, " + _six("overall_score"), "ranked"),
        "scan_state": f"""{_with('scored', 'state_map')}
            select {_SCORE} from scored
            where npi in (select npi from state_map where state = 'NATION_3')""",
        "scan_provider": _select(_SCORE, "scored", "where npi = '120'"),
        "provider_history": f"""{_with('monthly')}
            select npi, service_month, total_claims, {_money('total_paid')},
                   cast(sum(total_claims) over own as bigint) as provider_claims,
                   round((sum(total_paid) over own)::double, 4) as provider_paid,
                   count(*) over own as months,
                   cast(row_number() over (partition by npi order by service_month) = 1 as bigint)
                       as first
            from monthly window own as (partition by npi)""",
        "scan_risk_label": f"""{_with('results', 'flags')}
            select npi, case when overall_score >= 0.7 then 'HIGH'
                             when overall_score >= 0.4 then 'MEDIUM' else 'LOW' end as risk,
                   row_number() over (partition by npi order by place, service_month) as place,
                   flag_type, {_MONTH_TEXT},
                   case when severity >= 0.7 then 'HIGH'
                        when severity >= 0.4 then 'MEDIUM' else 'LOW' end as severity_risk,
                   case flag_type when 'volume_impossibility' then 'Volume Impossibility'
                        when 'revenue_outlier' then 'Revenue Outlier'
                        when 'billing_spike' then 'Billing Spike'
                        when 'suspicious_consistency' then 'Suspicious Consistency'
                        when 'nos_code_concentration' then 'Nos Code Concentration'
                        else 'Upcoding Trajectory' end as title,
                   description,
                   cast(case flag_type when 'volume_impossibility' then 2
                        when 'revenue_outlier' then 4 when 'billing_spike' then 3
                        when 'nos_code_concentration' then 3 else 5 end as bigint)
                        as evidence_items
            from results join flags using (npi)""",
        "scan_funnel": funnel,
        "scan_funnel_observed": funnel,
        "scan_payload": payload_flags,
        "payload_roundtrip": f"""{_with('ranked', 'flags', 'volume')}
            select (select count(*) from results) as total, cast(50 as bigint) as top, npi,
                   row_number() over (partition by npi
                       order by flags.place, flags.service_month) - 1 as place,
                   flag_type, round_even(flags.severity, 3) as severity,
                   coalesce(volume.total_claims, 0) as claims
            from ranked join flags using (npi)
            left join volume on volume.npi = flags.npi and flags.place = 1
                and volume.service_month = flags.service_month
            where rank <= 50""",
        "csv_roundtrip": _select(
            "rank, npi, round_even(overall_score, 3) as score, num_flags, flag_types", "ranked"
        ),
        "claims_summary": _select(
            f"""npi, total_rows, total_claims, {_six('total_paid')}, total_beneficiaries,
                date_range_start, date_range_end, active_months""", "summary",
        ),
        "top_procedures": _select(
            f"""npi, procedure_code, row_count, claims, {_six('paid')}, place,
                case when procedure_code = 'PROMO' then ''
                     else 'Items of type ' || lower(procedure_code) end as description""",
            "first_codes",
        ),
        "procedure_monthly": _select(
            f"""npi, service_month, place, procedure_code, claims, {_six('total_paid')},
                pct_of_month, case when procedure_code = 'PROMO' then ''
                     else 'Items of type ' || lower(procedure_code) end as description""",
            "breakdown",
        ),
        "peer_comparisons": _select("*", "peers"),
        "billing_timeline": _select(
            "npi, service_month, total_claims, " + _six("total_paid"),
            "monthly",
        ),
        "dossier": _DOSSIER,
        "dossier_roundtrip": _DOSSIER,
        "dossier_lookup": f"{_DOSSIER} where results.npi = '120'",
        "dossier_lists": f"""{_with('results', 'first_codes', 'breakdown', 'monthly')}
            select npi, 'top_procedures' as list, place - 1 as place, '' as service_month, procedure_code,
                   {_DESCRIPTION} as description, claims, {_six('paid')}, 0.0::double as pct_of_month
            from first_codes where npi in (select npi from results)
            union all
            select npi, 'procedure_monthly', row_number() over (partition by npi order by service_month, place) - 1,
                   service_month::varchar, procedure_code, {_DESCRIPTION}, claims,
                   {_rounded('total_paid')}, pct_of_month
            from breakdown where npi in (select npi from results)
            union all
            select npi, 'timeline', row_number() over (partition by npi order by service_month) - 1,
                   service_month::varchar, '', '', total_claims, {_rounded('total_paid')}, 0.0
            from monthly where npi in (select npi from results)""",
        "dossier_from_store": f"""{_with('scored', 'registry', 'summary', 'peers')}
            select lpad(npi, 10, '0') as npi, name, {_six('overall_score')}, flag_types, total_rows,
                   active_months as timeline_months, provider_percentile as percentile, zscore
            from scored join registry using (npi) join summary using (npi) join peers using (npi)
            where npi = '120'""",
        "month_store_monthly": _select(_MONTHLY, "monthly"),
        "month_store_procedure": _select(
            _PROCEDURE, "procedures", "where service_month in ('1995-03-01', '1995-04-01', '1996-01-01')"),
        "month_store_manifest": f"""{_with('monthly', 'procedures')}
            select case when year(service_month) = 1995 then 'restated' else 'all' end as batch,
                   case when year(service_month) = 1995 then 2 else 1 end::bigint as entry, service_month,
                   count(*) as monthly_rows, (select count(*) from procedures p where p.service_month = m.service_month)
                       as procedure_rows,
                   sum(total_claims)::bigint as total_claims, round(sum(total_paid)::double, 4) as total_paid
            from monthly m group by m.service_month""",
        "month_store_totals": _select(f"npi, total_claims, {_money('total_paid')}", "totals"),
        "month_store_baseline": _select(_six("median", "mad"), "baseline"),
        "month_estimates": _select(
            """count(distinct service_month) as months, count(*) as provider_months,
               count(distinct npi) as exact_providers, 1::bigint as providers_close, 1::bigint as median_close""",
            "monthly", "where service_month between '1994-01-01' and '1995-12-31'"),
        "scan_state_from_store": f"""{_with('scored', 'state_map')}
            select {_SCORE} from scored
            where npi in (select npi from state_map where state = 'NATION_3')""",
        "scan_provider_from_store": _select(_SCORE, "scored", "where npi = '120'"),
        "peer_one_provider": _select("*", "peers", "where npi = '20'"),
        "scan_without_detectors": _select(_SCORE, "scored", "where false"),
        "name_index_search": _select(
            f"npi, name, {_PROVIDER}, '' as taxonomy", "registry",
            "where lower(name) like '%customer#00000012%' order by npi limit 10"),
        "name_index_matches": _select(
            f"npi, name, {_PROVIDER}, '' as taxonomy", "registry",
            "where practice_state = 'NATION_3' and lower(name) like '%r#00000%'"),
        "name_index_short": _select(
            f"npi, name, {_PROVIDER}, '' as taxonomy", "registry", "where name like '%99%'"),
        "lookup_request": _select(
            f"npi, name, {_PROVIDER}, '' as taxonomy", "registry",
            "where lower(name) like '%customer#0000001%' order by npi limit 10"),
        "registry_later_rows": _select(
            "npi, case when npi::bigint % 3 = 0 then 'LATER' else state end as state", "state_map"),
        "registry_first_matches": _select(
            f"npi, name, {_PROVIDER}, '' as taxonomy", "registry",
            "where lower(name) like '%mer#00000%' order by npi::bigint desc limit 10"),
        "dossier_headings": f"""{_with('results', 'registry')}
            select npi, name,
                   case when entity_type = '2' then 'Organization' else 'Individual' end as type,
                   case when practice_state = '' then mailing_state else practice_state end
                       || ', ' || substring(postal_code, 1, 5) as address,
                   format('{{:.0f}}%', overall_score * 100) as score,
                   case when overall_score >= 0.7 then 'HIGH'
                        when overall_score >= 0.4 then 'MEDIUM' else 'LOW' end as risk
            from results join registry using (npi)""",
        "scan_request_state": f"""{_with('scored', 'state_map')}
            select count(*) over () as total, 'N4' as state, 0.5::double as threshold, npi,
                   round_even(overall_score, 3) as overall_score
            from scored where overall_score >= 0.5
                and npi in (select npi from state_map where state like '%4')
            order by scored.overall_score desc, npi limit 20""",
        "dossier_one_request": f"""{_with('scored', 'registry', 'summary')}
            select lpad(npi, 10, '0') as npi, name, {_six('overall_score')}, flag_types, total_rows,
                   active_months as timeline_months
            from scored join registry using (npi) join summary using (npi) where npi = '120'""",
        "dossier_one_provider": f"""{_with('peers', 'summary')}
            select lpad(npi, 10, '0') as npi, 0.0::double as overall_score, total_rows,
                   active_months as timeline_months, peer_count,
                   provider_percentile as percentile, zscore
            from peers join summary using (npi) where npi = '20'""",
    }
