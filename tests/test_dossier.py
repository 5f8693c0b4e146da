import statistics

import pytest

from claimgauge.config import ScanConfig
from claimgauge.operators import dossier as sections
from claimgauge.operators import summaries as S
from claimgauge.functions.order_statistics import RankIndex
from claimgauge.operators.peers import peer_comparison, peer_lookup
from claimgauge.operators.registry import provider_rows
from claimgauge.plans import dossier as plans
from claimgauge.plans import scan as scans
from claimgauge.schema import CLAIMS
from tests.conftest import CODES, MONTHS, NPI, claim_row, month


FEW, MANY = NPI["TOO_LITTLE"], NPI["MANY"]


@pytest.fixture(scope="module")
def cells(claims):
    return S.claim_cells(claims).cache()


def only(frame, npi):
    (row,) = frame.where(f"npi = '{npi}'").collect()
    return row


def test_summary(cells):
    row = only(sections.claims_summary(cells), FEW)
    assert (row.total_rows, row.total_claims, row.total_paid) == (20, 999, 99900.0)
    assert row.total_beneficiaries == 499 and row.active_months == 10
    assert (row.date_range_start, row.date_range_end) == (month(3), month(12))


def test_peers(totals):
    paid = sorted(float(r.total_paid) for r in totals.collect())
    row = only(peer_comparison(totals), FEW)
    assert row.peer_count == 15 and row.provider_total_paid == 99900.0
    assert row.peer_mean_paid == round(statistics.mean(paid), 2)
    assert row.peer_median_paid == statistics.median(paid)
    assert row.provider_percentile == 6.7
    assert row.zscore == round((99900 - statistics.mean(paid)) / statistics.stdev(paid), 2)


def test_one_provider_among_its_peers_reads_one_range(spark, totals, tmp_path):
    index = RankIndex.build(totals, "total_paid", str(tmp_path), ranges=6)
    everyone = peer_comparison(totals, index=index).collect()
    assert sorted(everyone) == sorted(peer_comparison(totals).select(everyone[0].__fields__).collect())
    for row in everyone[::4]:
        found = peer_lookup(totals, row.npi, index)
        assert found.collect() == [row]
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "range#" in plan
    assert peer_lookup(totals, "unknown", index).isEmpty()


def test_peers_of_some_equal_peers_of_all(spark, totals):
    some = spark.createDataFrame([(FEW,), (MANY,), ("unknown",)], "npi string")
    everyone = peer_comparison(totals)
    assert sorted(peer_comparison(totals, some).collect()) == sorted(
        S.keep_providers(everyone, some).select(*everyone.columns).collect()
    )


@pytest.mark.parametrize("paid, expected", [([5], [None]), ([5, 5, 5], [None] * 3)])
def test_no_zscore_without_spread(spark, paid, expected):
    totals = spark.createDataFrame(
        [(str(i), p) for i, p in enumerate(paid)], "npi string, total_paid bigint"
    )
    rows = peer_comparison(totals).collect()
    assert [r.zscore for r in rows] == expected
    assert all(r.provider_percentile == 100.0 for r in rows)


@pytest.fixture(scope="module")
def many(spark):
    """14 months, 7 codes: code ci is billed i times a month for 10 * i."""
    rows = [
        claim_row("1", f"c{i}", month(m % 12 + 1, 2022 + m // 12), 1, 1, 10 * i)
        for m in range(14)
        for i in range(1, 8)
        for _ in range(i)
    ]
    rows += [claim_row("1", "c1", month(3, 2023), 1, 1, -5), claim_row("1", None, month(4, 2023), 1, 1, 5)]
    return S.claim_cells(spark.createDataFrame(rows, CLAIMS)).cache()


def test_top_procedures(spark, many):
    texts = spark.createDataFrame([(" C7 ", "Seven"), ("c6", "Six")], "code string, description string")
    rows = sections.top_procedures(many, texts, n=3).orderBy("place").collect()
    assert [(r.procedure_code, r.row_count, r.claims, r.paid, r.description) for r in rows] == [
        ("c7", 98, 98, 6860.0, "Seven"), ("c6", 84, 84, 5040.0, "Six"), ("c5", 70, 70, 3500.0, ""),
    ]
    assert sections.top_procedures(many).count() == 7


def test_breakdown(many):
    rows = sections.procedure_by_month(many).orderBy("service_month", "place").collect()
    months = sorted({r.service_month for r in rows})
    # March 2023 is among the last twelve months but has no positive total; April has no code.
    assert months == [month(m, 2022) for m in range(4, 13)] + [month(1), month(2)]
    first = [r for r in rows if r.service_month == month(1)]
    assert [r.procedure_code for r in first] == ["c7", "c6", "c5", "c4", "c3"]
    assert [r.pct_of_month for r in first] == [35.0, 25.7, 17.9, 11.4, 6.4]


def test_timeline_lists_every_month(many):
    rows = sections.timeline(many).orderBy("service_month").collect()
    assert len(rows) == 16
    assert [r.total_paid for r in rows][-2:] == [-5.0, 5.0] and rows[0].total_claims == 28


def test_sections_without_optional_columns(claims):
    bare = S.claim_cells(claims.select("npi", "procedure_code", "service_month"))
    assert sections.claims_summary(bare).columns == [
        "npi", "total_rows", "date_range_start", "date_range_end", "active_months"
    ]
    assert sections.procedure_by_month(bare) is None
    row = only(sections.timeline(bare).where("service_month = '2023-03-01'"), FEW)
    assert (row.total_claims, row.total_paid) == (2, 0.0)
    assert only(sections.top_procedures(bare).where("place = 1"), FEW).row_count == 10
    assert sections.timeline(S.claim_cells(claims.select("npi", "total_paid"))) is None


def test_dossiers(spark, claims, totals, monthly, procedure):
    registry = spark.createDataFrame(
        [(MANY, "1", "Doe", "Pat", "MD")],
        "npi string, entity_type string, last_name string, first_name string, credential string",
    )
    results = scans.scan(monthly, procedure, ScanConfig())
    asked = spark.createDataFrame([(MANY,), (FEW,), ("unknown",)], "npi string")
    found = plans.build_dossiers(
        claims, totals, provider_rows(registry), results, subjects=asked
    )
    rows = {r.npi: r for r in found.collect()}
    assert set(rows) == {MANY, FEW}
    many, few = rows[MANY], rows[FEW]
    assert many.provider.name == "Pat Doe, MD" and few.provider.name == ""
    assert many.overall_score == 0.85 and len(many.red_flags) == 3
    assert few.overall_score == 0.0 and few.red_flags == []
    assert few.claims_summary.total_claims == 999
    assert [(t.service_month, t.total_claims) for t in many.timeline] == [
        (month(m), 1650 if m == 12 else 150) for m in MONTHS]
    assert [(p.place, p.procedure_code, p.claims) for p in few.top_procedures] == [
        (1, CODES[0], 500), (2, CODES[1], 499)]
    assert len(few.procedure_monthly) == 20
    assert few.peer_comparison.provider_percentile == 6.7


def test_one_profile(claims):
    (row,) = plans.profile(claims, FEW).collect()
    assert row.peer_comparison.peer_count == 15
    with pytest.raises(LookupError):
        plans.profile(claims, "9999999999")
    with pytest.raises(ValueError):
        plans.profile(claims, "99")
