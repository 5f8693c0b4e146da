"""Tables kept by month, and tables asked for one key at a time."""

import bisect
import re
import shutil
import statistics
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from claimgauge.config import ProfileRequest, ScanConfig
from claimgauge.operators import detectors as D
from claimgauge.operators import summaries as S
from claimgauge.plans import request as requests
from claimgauge.plans import scan as scans
from claimgauge.sources import sinks
from claimgauge.sources.keyed import read_key, read_keyed, read_keys, write_keyed
from claimgauge.sources.month_store import MONTHLY, PROCEDURE, MonthStore, UnfinishedDelivery
from claimgauge.sources.staging import Staging
from tests.conftest import NPI, claim_row, month

CONFIG = ScanConfig()


def same(left, right):
    right = right.select(*left.columns)
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def files(folder, *months):
    """Names and times of the files of some months."""
    return {p: p.stat().st_mtime_ns for m in months for table in (MONTHLY, PROCEDURE)
            for p in Path(folder, table, f"service_month={m}").glob("*.parquet")}


@pytest.fixture(scope="module")
def made(spark, claims, tmp_path_factory):
    """Ten months in two deliveries."""
    store = MonthStore(spark, str(tmp_path_factory.mktemp("store")))
    early = F.col("service_month") < F.lit(month(8))
    assert store.put(claims.where(early), "spring") and store.put(claims.where(~early), "autumn")
    return store


@pytest.fixture
def filled(spark, made, tmp_path):
    """A copy of them for each test."""
    shutil.copytree(made.folder, tmp_path / "store")
    return MonthStore(spark, str(tmp_path / "store"))


def test_months_come_one_delivery_at_a_time(filled, claims, monthly, procedure):
    assert same(filled.monthly(), monthly) and same(filled.procedure(), procedure)
    assert filled.differences().isEmpty()
    entries = {r.service_month: (r.batch, r.entry) for r in filled.months().collect()}
    assert entries == {month(m): ("spring", 1) if m < 8 else ("autumn", 2) for m in range(3, 13)}


def test_a_delivery_counts_once(filled, claims, monthly):
    before = files(filled.folder, *map(month, range(3, 13)))
    assert not filled.put(claims.withColumn("total_claims", F.lit(0).cast("bigint")), "spring")
    assert files(filled.folder, *map(month, range(3, 13))) == before
    assert same(filled.monthly(), monthly)


def test_a_month_stated_anew_rewrites_its_partitions_only(spark, filled, claims):
    others = [month(m) for m in range(3, 13) if m != 5]
    before, old = files(filled.folder, *others), files(filled.folder, month(5))
    anew = claims.where(F.col("service_month") == month(5)).where(f"npi != '{NPI['MANY']}'").withColumn(
        "total_claims", F.col("total_claims") + 1)
    assert filled.put(anew, "correction")
    assert files(filled.folder, *others) == before and not set(files(filled.folder, month(5))) & set(old)
    whole = claims.where(F.col("service_month") != month(5)).unionByName(anew)
    assert same(filled.monthly(), S.monthly_summary(whole)) and same(filled.procedure(), S.procedure_summary(whole))
    rebuilt = MonthStore(spark, f"{filled.folder}-rebuilt")
    rebuilt.put(whole, "all")
    assert same(filled.monthly(), rebuilt.monthly())
    assert same(filled.months().drop("batch", "entry"), rebuilt.months().drop("batch", "entry"))
    assert filled.months().where(F.col("service_month") == month(5)).first().batch == "correction"


def test_a_month_that_loses_all_its_codes(spark, filled, claims):
    bare = claims.where(F.col("service_month") == month(12)).withColumn("procedure_code", F.lit(None).cast("string"))
    filled.put(bare, "bare")
    assert filled.procedure([month(12)]).isEmpty() and filled.monthly([month(12)]).count() == 15
    assert filled.differences().isEmpty()


def test_only_the_asked_months_are_read(filled):
    some = filled.procedure([month(4), month(9)])
    assert {r[0] for r in some.select("service_month").distinct().collect()} == {month(4), month(9)}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*service_month#\d+ IN", plan)


def test_a_half_written_delivery_is_noticed_until_it_is_put_again(filled, claims, monthly, monkeypatch):
    def fails(self, name, frame):
        if name == PROCEDURE:
            raise OSError("disk full")
        MonthStore.__dict__["_overwrite_"](self, name, frame)

    monkeypatch.setattr(MonthStore, "_overwrite_", MonthStore._overwrite, raising=False)
    monkeypatch.setattr(MonthStore, "_overwrite", fails)
    march = claims.where(F.col("service_month") == month(3))
    with pytest.raises(OSError):
        filled.put(march.limit(3), "broken")
    monkeypatch.undo()
    with pytest.raises(UnfinishedDelivery, match="broken"):
        filled.monthly()
    assert [r[0] for r in filled.differences().collect()] == [month(3)]
    assert filled.put(march, "broken")
    assert same(filled.monthly(), monthly) and filled.differences().isEmpty()


def test_rows_without_month_or_provider_are_in_no_summary(spark, tmp_path):
    from claimgauge.schema import CLAIMS
    rows = [claim_row("7", "A", month(1), 1, 2, 10), claim_row("7", "A", None, 1, 2, 10), claim_row(None, "A", month(1), 1, 2, 10)]
    store = MonthStore(spark, str(tmp_path))
    assert store.monthly().isEmpty() and store.months().isEmpty()
    assert store.put(spark.createDataFrame(rows, CLAIMS), "one")
    assert [(r.npi, r.total_claims) for r in store.monthly().collect()] == [("7", 2)]
    with pytest.raises(ValueError):
        store.put(spark.createDataFrame(rows, CLAIMS), "a/b")


def test_what_is_derived_follows_the_summaries(filled, claims, totals, monthly, procedure):
    with pytest.raises(LookupError):
        filled.totals()
    assert filled.refresh(CONFIG) and not filled.refresh(CONFIG)
    assert same(filled.totals(), totals)
    own = filled.provider_totals(NPI["MANY"])
    assert own.count() == 1 and same(own, totals.where(f"npi = '{NPI['MANY']}'"))
    assert tuple(filled.baseline().first()) == (100.0, 4.0)
    found = scans.scan_store(filled, CONFIG)
    assert same(found, scans.scan(monthly, procedure, CONFIG))
    one = scans.scan_store(filled, ScanConfig(threshold=0.0), NPI["RATE_OVER"]).collect()
    assert [r.npi for r in one] == [NPI["RATE_OVER"]]
    filled.put(claims.where(F.col("service_month") == month(3)).limit(5), "later")
    with pytest.raises(LookupError):
        filled.baseline()


def test_a_profile_from_the_store(spark, filled, claims, monthly, procedure):
    filled.refresh(CONFIG)
    for name in ("MANY", "TOO_LITTLE"):
        request = ProfileRequest(NPI[name])
        stored = requests.profile_from_store(filled, claims, request, CONFIG, Staging(spark))
        direct = requests.profile_request(claims, monthly, procedure, request, CONFIG, Staging(spark))
        assert stored.collect() == direct.select(*stored.columns).collect()
    with pytest.raises(LookupError):
        requests.profile_from_store(filled, claims, ProfileRequest("9999999999"), CONFIG, Staging(spark))


@pytest.mark.parametrize("months", [None, [month(4)], [month(3), month(12), month(1)]])
def test_estimates_of_a_span_of_months(filled, monthly, months):
    """So few rates are all kept by the sketch, so quantiles are values that occur."""
    found = filled.estimates(months).first()
    rows = [r for r in monthly.collect() if months is None or r.service_month in months]
    rates = sorted(float(r.total_paid) / r.total_claims for r in rows)
    assert (found.provider_months, found.providers) == (len(rows), len({r.npi for r in rows}))
    assert found.months == len({r.service_month for r in rows})
    assert rates[int(0.48 * len(rates))] <= found.median <= rates[int(0.52 * len(rates))]


def test_estimates_stay_within_their_errors(spark, tmp_path):
    """Skewed rates of 30,000 providers in three months, one of which is stated anew."""
    from claimgauge.schema import MONEY
    rows = spark.range(30_000).select(
        F.col("id").cast("string").alias("npi"), F.lit("A").alias("procedure_code"),
        F.explode(F.array(*[F.lit(month(m)) for m in (1, 2, 3)])).alias("service_month"),
        F.lit(2).cast("bigint").alias("total_claims"),
        F.exp(F.randn(3) * 2).cast(MONEY).alias("total_paid"))
    rows = Staging(spark).keep(rows, "rows")
    store = MonthStore(spark, str(tmp_path))
    store.put(rows.where("service_month < '2023-03-01' or npi < '2'"), "first")
    store.put(rows.where("service_month = '2023-03-01'"), "second")
    found = store.estimates([month(2), month(3)]).first()
    rates = [float(r.total_paid) / 2 for r in rows.where("service_month > '2023-01-01'").collect()]
    rates.sort()
    assert found.provider_months == 60_000 and abs(found.providers / 30_000 - 1) < 0.03
    assert abs(bisect.bisect(rates, found.median) / 60_000 - 0.5) < 0.01
    apart = sorted(abs(x - statistics.median(rates)) for x in rates)
    assert abs(bisect.bisect(apart, found.mad) / 60_000 - 0.5) < 0.02


# Lookups by key

def rows_read(frame):
    """Rows that the scan of a frame hands on, after row groups and pages are skipped."""
    frame.collect()
    scan = frame._jdf.queryExecution().executedPlan().collectLeaves().head()
    return scan.metrics().apply("numOutputRows").value()


def keyed_rows(spark, n):
    rows = spark.range(n).select(F.lpad(F.col("id").cast("string"), 10, "0").alias("npi"), F.rand(1).alias("x"))
    return rows.withColumn("note", F.sha2("npi", 256))


def test_a_lookup_reads_no_more_from_a_larger_table(spark, tmp_path):
    wanted = f"{4321:010d}"
    read = {}
    for n in (20_000, 200_000):
        path = str(tmp_path / str(n))
        write_keyed(keyed_rows(spark, n), path, buckets=8)
        found = read_key(spark, path, wanted, buckets=8)
        assert [r.npi for r in found.collect()] == [wanted]
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(key_bucket" in plan and f"EqualTo(npi,{wanted})" in plan
        read[n] = rows_read(found)
        assert rows_read(read_key(spark, path, f"{4321:09d}x", buckets=8)) <= read[n]
    assert 0 < read[200_000] <= 1.2 * read[20_000] + 1000


def test_keyed_tables_hold_every_row(spark, tmp_path):
    frame = keyed_rows(spark, 500).unionByName(keyed_rows(spark, 300))
    write_keyed(frame, str(tmp_path), order=("x",), buckets=4)
    assert same(read_keyed(spark, str(tmp_path)), frame)
    some = spark.createDataFrame([("0000000001",), ("0000000001",), ("0000000400",), ("no",)], "npi string")
    assert sorted(r.npi for r in read_keys(some, str(tmp_path), buckets=4).collect()) == ["0000000001"] * 2 + ["0000000400"]


def test_dossiers_one_at_a_time(spark, claims, totals, tmp_path):
    from claimgauge.plans.dossier import build_dossiers
    dossiers = build_dossiers(claims, totals)
    sinks.write_dossiers(dossiers, str(tmp_path / "parquet"))
    assert sinks.read_dossiers(spark, str(tmp_path / "parquet")).count() == 15
    (row,) = sinks.read_dossier(spark, str(tmp_path / "parquet"), NPI["MANY"]).collect()
    assert row.claims_summary.total_claims == 3000 and len(row.timeline) == 10
    assert sinks.read_dossier(spark, str(tmp_path / "parquet"), "unknown").isEmpty()
    sinks.write_dossiers(dossiers, str(tmp_path / "json"), "json")
    assert spark.read.json(str(tmp_path / "json")).count() == 15


def test_the_baseline_of_the_store_is_that_of_its_totals(filled):
    filled.refresh(CONFIG)
    direct = D.revenue_baseline(S.qualifying(filled.totals(), CONFIG), CONFIG)
    assert filled.baseline().first() == direct.first()
