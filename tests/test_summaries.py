from decimal import Decimal

from claimgauge.config import ScanConfig
from claimgauge.operators import summaries as S
from claimgauge.schema import CLAIMS
from tests.conftest import NPI, claim_row, month


def test_row_counts(claims, monthly, procedure, totals):
    assert claims.count() == 430
    assert monthly.count() == 150
    assert totals.count() == 15
    assert procedure.count() == procedure.select(*S.PROCEDURE_KEY).distinct().count() == 430


def test_summaries_of_cells_equal_those_of_claims(claims, monthly, procedure):
    cells = S.claim_cells(claims)
    assert S.monthly_of_cells(cells).exceptAll(monthly).isEmpty()
    assert S.procedure_of_cells(cells).exceptAll(procedure).isEmpty()


def test_qualifying_keeps_providers_at_the_threshold(monthly, totals, procedure):
    few = f"npi = '{NPI['TOO_LITTLE']}'"
    qualified = S.qualifying(totals, ScanConfig())
    assert qualified.count() == 14 and qualified.where(few).isEmpty()
    assert qualified.where(f"npi = '{NPI['ENOUGH']}'").first().total_paid == 100_000
    assert S.keep_providers(monthly, qualified).count() == 140
    assert S.keep_providers(procedure, qualified).where(few).isEmpty()
    assert S.qualifying(totals, ScanConfig(min_total_paid=99_900)).count() == 15
    assert S.qualifying(totals, ScanConfig(min_total_paid=99_900.01)).count() == 14


def test_missing_keys_and_values(spark):
    rows = [
        claim_row("1", "A", month(1), 1, 2, 10),
        claim_row("1", None, month(1), 1, 3, 20),
        claim_row("1", "A", None, 1, 4, 40),
        ("1", "1", "B", month(2), None, None, None),
    ]
    claims = spark.createDataFrame(rows, CLAIMS)
    by_month = {r.service_month: r for r in S.monthly_summary(claims).collect()}
    assert by_month[month(1)].total_paid == Decimal(30) and by_month[month(1)].total_claims == 5
    assert by_month[month(2)].total_paid == 0 and by_month[month(2)].total_claims == 0
    assert set(by_month) == {month(1), month(2)}
    by_code = {(r.procedure_code, r.service_month) for r in S.procedure_summary(claims).collect()}
    assert by_code == {("A", month(1)), ("B", month(2))}
    cells = S.claim_cells(claims)
    assert cells.count() == 4
    assert {r.service_month: r for r in S.monthly_of_cells(cells).collect()} == by_month


def test_beneficiaries_are_optional(claims):
    without = claims.drop("beneficiaries")
    assert "beneficiaries" not in S.monthly_summary(without).columns
    assert "beneficiaries" not in S.claim_cells(without).columns


def test_history_totals_equal_aggregated_totals(monthly, totals):
    kept = S.totals_of_history(S.provider_history(monthly))
    assert kept.count() == 15
    assert kept.select(*totals.columns).exceptAll(totals).isEmpty()
