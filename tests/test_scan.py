import json

import pytest

from claimgauge import config as C
from claimgauge import fixed_values as fv
from claimgauge.operators import detectors as D
from claimgauge.operators import scoring
from claimgauge.operators import summaries as S
from claimgauge.operators.flags import no_flags
from claimgauge.operators.report import flag_lines
from claimgauge.plans import scan as scans
from claimgauge.schema import FLAGS
from claimgauge.sources.staging import Staging
from tests.conftest import LAST, NPI, month

ALL = C.ScanConfig(threshold=0.0)


@pytest.fixture(scope="module")
def results(claims):
    return {r.npi: r for r in scans.scan_claims(claims, ALL).collect()}


def test_six_signal_scores(results):
    found = {npi: round(r.overall_score, 6) for npi, r in results.items()}
    assert found == {NPI[name]: pytest.approx(score, abs=1e-6) for name, score in {
        "VOLUME_OVER": 0.4 * 1503 / 4500 + 0.15, "SPIKE_OVER": 4 / 19 + 0.15, "SHARE_AT": 0.43,
        "NOS_AT": 0.55, "LEVEL_AT": 0.4 * 0.4 / 1.5 + 0.35, "RATE_OVER": 0.270059, "MANY": 0.85,
    }.items()}
    many = results[NPI["MANY"]]
    assert many.flag_types == [fv.SPIKE, fv.CONSISTENCY, fv.VOLUME]
    assert many.num_flags == 3 and many.scheme_types == 0
    assert results[NPI["NOS_AT"]].scheme_types == 1


def test_four_signal_scores(monthly, procedure):
    config = C.ScanConfig(
        threshold=0.0, weights=C.FOUR_SIGNAL, flag_types=fv.FOUR_SIGNAL_FLAGS
    )
    rows = scans.scan(monthly, procedure, config).collect()
    found = {r.npi: round(r.overall_score, 6) for r in rows}
    assert set(found) == {NPI[x] for x in ("VOLUME_OVER", "SPIKE_OVER", "SHARE_AT", "RATE_OVER", "MANY")}
    assert found[NPI["MANY"]] == 1.0 and found[NPI["SHARE_AT"]] == 0.55


def test_flags_are_in_detector_order_with_their_texts(results):
    volume, spike, consistency = results[NPI["MANY"]].red_flags
    assert volume.description == "1,650 claims in 2023-12-01 (max plausible: 1,500)"
    assert json.loads(volume.evidence_json) == {"month": "2023-12-01", "claims": 1650}
    assert spike.description == (
        "Monthly paid $165,000.00 in 2023-12-01 is 5.5x their average $30,000.00"
    )
    assert json.loads(spike.evidence_json) == {
        "month": "2023-12-01", "amount": 165000, "ratio": 5.5
    }
    assert consistency.description == (
        "100% of billing is procedure 97110 at $100.00/claim with only 0.0% rate variation "
        "across 10 months — consistent with copy-paste billing"
    )
    assert volume.service_month == month(LAST) and consistency.service_month is None
    revenue = results[NPI["RATE_OVER"]].red_flags[0]
    assert revenue.description == (
        "Revenue per claim $117.80 (3.0 MADs above median $100.00/claim)"
    )
    assert json.loads(revenue.evidence_json) == {
        "paid_per_claim": 117.8, "total_paid": 141360, "total_claims": 1200,
        "modified_zscore": 3.0,
    }


def test_threshold(monthly, procedure):
    def count(threshold):
        return scans.scan(monthly, procedure, C.ScanConfig(threshold=threshold)).count()

    assert (count(0.0), count(0.4), count(0.54), count(0.84), count(0.9)) == (7, 4, 2, 1, 0)


def test_a_scope_changes_nothing_but_who_is_listed(spark, monthly, procedure, results):
    asked = [NPI["RATE_OVER"], NPI["RATE_AT"], NPI["TOO_LITTLE"], "unknown"]
    scope = spark.createDataFrame([(x,) for x in asked], "npi string")
    found = scans.scan(monthly, procedure, ALL, scope).collect()
    assert found == [results[NPI["RATE_OVER"]]]


def test_one_provider(monthly, procedure, results):
    for name in ("SPIKE_OVER", "RATE_OVER"):
        found = scans.scan_provider(monthly, procedure, C.ScanConfig(), NPI[name]).collect()
        assert found == [results[NPI[name]]]
    for name in ("SPIKE_AT", "TOO_LITTLE"):
        assert scans.scan_provider(monthly, procedure, C.ScanConfig(), NPI[name]).isEmpty()


def test_stored_totals_and_baseline_leave_other_providers_alone(spark, monthly, procedure, totals, results):
    """Nothing that is written holds a provider out of scope."""
    baseline = Staging(spark).keep(D.revenue_baseline(S.qualifying(totals, ALL), ALL), "baseline")
    staging = Staging(spark)
    kept = {}
    write = staging.keep
    staging.keep = lambda frame, name: kept.setdefault(name, write(frame, name))
    found = scans.scan(monthly, procedure, ALL, NPI["MANY"], staging=staging, totals=totals, baseline=baseline)
    assert found.collect() == [results[NPI["MANY"]]]
    assert set(kept) == {"history", "profile"}
    assert all({r.npi for r in frame.select("npi").collect()} == {NPI["MANY"]} for frame in kept.values())


def test_registry_organizations_lose_only_their_volume_flag(spark, monthly, procedure):
    organizations = spark.createDataFrame([(NPI["MANY"],)], "npi string")
    found = scans.scan(monthly, procedure, ALL, organizations=organizations)
    (row,) = found.where(f"npi = '{NPI['MANY']}'").collect()
    assert row.flag_types == [fv.SPIKE, fv.CONSISTENCY]


def test_ranks(spark, monthly, procedure):
    found = scans.scan(monthly, procedure, ALL)
    ranked = scoring.ranked(found, Staging(spark)).orderBy("rank").collect()
    expected = sorted(found.collect(), key=lambda r: (-r.overall_score, r.npi))
    assert [r["rank"] for r in ranked] == list(range(1, 8))
    assert [r.npi for r in ranked] == [r.npi for r in expected]
    first = scoring.top(found, 5).orderBy("rank").collect()
    assert [(r["rank"], r.npi) for r in first] == [(r["rank"], r.npi) for r in ranked[:5]]


@pytest.fixture(scope="module")
def counts():
    return {
        "seen": 15, "qualifying": 14, "excluded": 1, "in_scope": 14,
        fv.VOLUME: 2, fv.REVENUE: 1, fv.SPIKE: 2, fv.CONSISTENCY: 2, fv.NOS: 1,
        fv.UPCODING: 1, "scored": 7, "above_threshold": 2,
    }


def test_funnel(spark, monthly, procedure, counts):
    config = C.ScanConfig(threshold=0.5)
    steps = scans.funnel(scans.detect(monthly, procedure, config), config, Staging(spark))
    assert {r.stage: r.providers for r in steps.collect()} == counts


@pytest.mark.parametrize("scope", [None, "MANY"])
def test_funnel_counted_on_the_way(spark, monthly, procedure, totals, counts, scope):
    config = C.ScanConfig(threshold=0.5)
    if scope is not None:
        changed = {"in_scope": 1, "scored": 1, "above_threshold": 1, fv.REVENUE: 0, fv.NOS: 0, fv.UPCODING: 0,
                   fv.VOLUME: 1, fv.SPIKE: 1, fv.CONSISTENCY: 1}
        counts, scope = counts | changed, NPI[scope]
    for stored in ({}, {"totals": totals}):
        results, steps = scans.scan_with_funnel(monthly, procedure, config, scope, **stored)
        assert {r.stage: r.providers for r in steps.collect()} == counts
        assert results.count() == counts["above_threshold"]


def test_no_flags_give_no_results(spark):
    empty = no_flags(spark)
    assert empty.schema == FLAGS
    assert scoring.score(empty, ALL).isEmpty()


def test_scores_stay_within_bounds(results):
    for row in results.values():
        assert 0.0 <= row.overall_score <= 1.0
        assert all(0.0 <= flag.severity <= 1.0 for flag in row.red_flags)


def test_report_lines(claims):
    lines = flag_lines(scans.scan_claims(claims, C.ScanConfig(threshold=0.8))).orderBy("place")
    first = lines.collect()[0]
    assert (first.risk, first.severity_risk, first.title) == ("HIGH", "LOW", "Volume Impossibility")
    assert first.evidence == "month: 2023-12-01, claims: 1650"
