import pytest

from claimgauge.config import ScanConfig
from claimgauge.operators import detectors as D
from claimgauge.operators import summaries as S
from tests.conftest import LAST, NPI, VAGUE, month

CONFIG = ScanConfig()


def by_npi(frame):
    return {row.npi: row for row in frame.collect()}


def close(value):
    return pytest.approx(value, abs=1e-6)


# Volume

def test_volume_flags_months_over_the_limit(monthly):
    rows = by_npi(D.volume_findings(monthly, CONFIG))
    assert {(r.npi, r.service_month, r.total_claims, r.severity) for r in rows.values()} == {
        (NPI["VOLUME_OVER"], month(LAST), 1503, 1503 / 4500), (NPI["MANY"], month(LAST), 1650, 1650 / 4500)
    }


def test_volume_boundary_and_severity(monthly_rows):
    monthly = monthly_rows([("1", month(1), 1500, 1), ("2", month(1), 1501, 1)])
    rows = by_npi(D.volume_findings(monthly, CONFIG))
    assert set(rows) == {"2"} and rows["2"].severity == close(1501 / 4500)


def test_volume_skips_registry_organizations(spark, monthly):
    organizations = spark.createDataFrame([(NPI["MANY"],)], "npi string")
    assert set(by_npi(D.volume_findings(monthly, CONFIG, organizations))) == {NPI["VOLUME_OVER"]}


@pytest.mark.parametrize("codes, flagged", [
    ([("T1019", 41), ("97110", 40)], False),  # one claim decides
    ([("T1019", 40), ("97110", 41)], True),
    ([("T1019", 40), ("97110", 40)], True),  # equal counts go to the lower code
    ([("T1019", 40), ("V2020", 40)], False),
    ([("H2019", 20), ("T1016", 20), ("97110", 21)], True),  # codes count one by one
])
def test_volume_and_leading_organization_code(monthly, procedure_rows, codes, flagged):
    monthly = monthly.where(f"npi = '{NPI['MANY']}'")
    procedure = procedure_rows([(NPI["MANY"], c, month(9), n, 1000) for c, n in codes])
    candidates = D.volume_candidates(monthly, CONFIG)
    excluded = D.volume_exclusions(procedure, CONFIG, candidates)
    assert D.volume_findings(monthly, CONFIG, excluded).isEmpty() != flagged
    profile = D.code_profile(procedure, CONFIG)
    same = D.leading_codes(procedure).collect()[0].procedure_code
    assert profile.collect()[0].leading_code == same


# Revenue

def test_revenue_baseline_and_flag(totals):
    qualified = S.qualifying(totals, CONFIG)
    baseline = D.revenue_baseline(qualified, CONFIG).collect()[0]
    assert (baseline.median, baseline.mad) == (100.0, 4.0)
    rows = by_npi(D.revenue_findings(qualified, CONFIG))
    assert set(rows) == {NPI["RATE_OVER"]}  # 117.80; 117.79 is less than 3 deviations away
    row = rows[NPI["RATE_OVER"]]
    assert row.paid_per_claim == 117.8 and row.severity == close(0.3001484)
    assert row.z == close(17.8 / (4 * 1.4826))


def test_revenue_scope_keeps_the_national_baseline(spark, totals):
    qualified = S.qualifying(totals, CONFIG)
    only = spark.createDataFrame([(NPI["RATE_OVER"],)], "npi string")
    row = D.revenue_findings(qualified, CONFIG, scope=only).collect()[0]
    assert row.npi == NPI["RATE_OVER"] and row.median == 100.0
    other = spark.createDataFrame([(NPI["RATE_AT"],)], "npi string")
    assert D.revenue_findings(qualified, CONFIG, scope=other).isEmpty()


@pytest.mark.parametrize("rows", [
    [("1", 10, 100), ("2", 20, 200), ("3", 1, 500)],  # deviation zero at the middle
    [("1", 0, 100)],  # nobody with claims
    [],
])
def test_revenue_without_spread_flags_nobody(spark, rows):
    totals = spark.createDataFrame(
        rows, "npi string, total_claims bigint, total_paid bigint"
    )
    assert D.revenue_findings(totals, CONFIG).isEmpty()


def test_revenue_approximate_median_is_an_existing_value(spark):
    totals = spark.createDataFrame(
        [(str(i), 1, v) for i, v in enumerate((1, 2, 3, 10))],
        "npi string, total_claims bigint, total_paid bigint",
    )
    assert D.revenue_baseline(totals, CONFIG).collect()[0].median == 2.5
    approximate = ScanConfig(exact_median=False)
    assert D.revenue_baseline(totals, approximate).collect()[0].median == 2.0


# Spikes

def test_spikes(monthly, totals):
    history = S.provider_history(monthly)
    rows = by_npi(D.spike_findings(history, CONFIG))
    assert set(rows) == {NPI["SPIKE_OVER"], NPI["MANY"]}  # SPIKE_AT is paid five times its mean
    assert rows[NPI["SPIKE_OVER"]].ratio == close(100 / 19)
    assert rows[NPI["MANY"]].ratio == close(5.5) and rows[NPI["MANY"]].severity == close(0.55)
    assert all(r.service_month == month(LAST) and r.months == 10 for r in rows.values())


def test_spike_history_counts_months_with_paid_only(monthly_rows):
    def rows(npi, *paid):
        return [(npi, month(i + 1), 1, p) for i, p in enumerate(paid)]

    config = ScanConfig(spike_multiplier=1.5)
    monthly = monthly_rows(
        rows("two", 1, 9) + rows("null", 1, 9, None) + rows("three", 1, 1, 9)
        + rows("zero", 0, 0, 0) + rows("negative", -9, 1, 1)
    )
    found = by_npi(D.spike_findings(S.provider_history(monthly), config))
    assert set(found) == {"three"}


# Consistency

def test_consistency(procedure):
    rows = by_npi(D.consistency_findings(D.code_profile(procedure, CONFIG), CONFIG))
    assert set(rows) == {NPI["SHARE_AT"], NPI["MANY"]}
    row = rows[NPI["SHARE_AT"]]
    assert row.share == close(0.7) and row.cv == 0.0 and row.severity == close(0.7)
    assert row.procedure_code == "G0439" and row.months == 10


def test_vague_codes_and_levels_at_their_thresholds(procedure):
    profile = D.code_profile(procedure, CONFIG)
    vague = by_npi(D.nos_findings(profile, CONFIG))
    assert set(vague) == {NPI["NOS_AT"]} and vague[NPI["NOS_AT"]].severity == close(0.5)
    assert not procedure.where(f"procedure_code = '{VAGUE}' and npi = '{NPI['NOS_UNDER']}'").isEmpty()
    levels = by_npi(D.upcoding_findings(D.visit_halves(procedure, CONFIG), CONFIG))
    assert set(levels) == {NPI["LEVEL_AT"]}
    assert levels[NPI["LEVEL_AT"]].early_level == close(2.8) and levels[NPI["LEVEL_AT"]].shift == close(0.4)


def steady(npi, code, paid, claims=10, months=3):
    return [(npi, code, month(m + 1), claims, paid) for m in range(months)]


@pytest.mark.parametrize("rows, flagged", [
    (steady("1", "A", 70) + steady("1", "B", 30), True),
    (steady("1", "A", 69) + steady("1", "B", 31), False),
    (steady("1", "A", 100, months=2), False),
    (steady("1", "A", 0), False),  # rate zero: no variation to speak of, and no error
    (steady("1", "A", 100, claims=0), False),
    (steady("1", "A", -100), True),  # shares and rates of refunds follow the same formulas
    (steady("1", "A", 120) + steady("1", "B", -20), True),
])
def test_consistency_cases(procedure_rows, rows, flagged):
    profile = D.code_profile(procedure_rows(rows), CONFIG)
    assert D.consistency_findings(profile, CONFIG).isEmpty() != flagged


def test_consistency_severity_is_bounded_above_only(procedure_rows):
    profile = D.code_profile(procedure_rows(steady("1", "A", 120) + steady("1", "B", -20)), CONFIG)
    row = D.consistency_findings(profile, CONFIG).collect()[0]
    assert row.share == close(1.2) and row.severity == 1.0


def test_rate_variation_uses_the_sample_deviation(procedure_rows):
    rows = [("1", "A", month(m), 1, paid) for m, paid in ((1, 90), (2, 100), (3, 110))]
    row = D.dominant_procedures(D.code_profile(procedure_rows(rows), CONFIG)).collect()[0]
    assert row.cv == close(0.1) and row.months == 3


# Vague codes

@pytest.mark.parametrize("rows, share, severity", [
    ([("E1399", 12000, 6), ("99213", 8000, 6)], 0.6, 1.0),
    ([("E1399", 25, 1), ("99213", 75, 1)], 0.25, 0.5),
    ([("E1399", 24, 1), ("99213", 76, 1)], None, None),
    ([("99213", 76, 1)], None, None),
])
def test_nos(procedure_rows, rows, share, severity):
    procedure = procedure_rows([
        ("1", code, month(m + 1), 10, paid) for code, paid, n in rows for m in range(n)
    ])
    found = D.nos_findings(D.code_profile(procedure, CONFIG), CONFIG).collect()
    assert [(r.share, r.severity) for r in found] == ([] if share is None else [(share, severity)])


# Level shift

def visits(*by_month):
    """One list of (code, claims) per month."""
    return [
        ("1", code, month(m + 1), claims, 50 * claims)
        for m, codes in enumerate(by_month)
        for code, claims in codes
    ]


LOW, MIXED, HIGH = [("99213", 20)], [("99213", 10), ("99214", 10)], [("99215", 20)]


@pytest.mark.parametrize("rows, early, late, severity, claims", [
    (visits(LOW, LOW, LOW, MIXED, MIXED, MIXED), 3.0, 3.5, 0.333333, 120),
    (visits(LOW, LOW, LOW, HIGH, HIGH, HIGH), 3.0, 5.0, 1.0, 120),
    (visits(LOW, LOW, LOW, HIGH, HIGH, HIGH, HIGH), 3.0, 5.0, 1.0, 140),
    (visits(*[[("99211", 0)]] * 3, HIGH, HIGH, HIGH), 0.0, 5.0, 1.0, 60),
])
def test_upcoding_found(procedure_rows, rows, early, late, severity, claims):
    halves = D.visit_halves(procedure_rows(rows), CONFIG)
    (row,) = D.upcoding_findings(halves, CONFIG).collect()
    assert (row.early_level, row.late_level, row.claims) == (early, late, claims)
    assert row.severity == close(severity) and row["shift"] == close(late - early)


@pytest.mark.parametrize("rows", [
    visits(LOW, LOW, HIGH, HIGH, HIGH),
    visits(*[[("99213", 8)]] * 5, [("99215", 9)]),
    visits(HIGH, HIGH, HIGH, LOW, LOW, LOW),
    visits(*[[("H0043", 100)]] * 6),
])
def test_upcoding_not_found(procedure_rows, rows):
    halves = D.visit_halves(procedure_rows(rows), CONFIG)
    assert D.upcoding_findings(halves, CONFIG).isEmpty()
