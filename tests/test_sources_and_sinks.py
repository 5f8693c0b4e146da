import json
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from claimgauge import fixed_values as fv
from claimgauge.config import LookupRequest, ProfileRequest, ScanConfig, ScanRequest
from claimgauge.plans import scan as scans
from claimgauge.plans.region import region_subset
from claimgauge.schema import CLAIMS
from claimgauge.sources import claims as source
from claimgauge.sources import sinks
from claimgauge.sources import summary_store as store
from claimgauge.sources.staging import Staging, shared_folder
from tests.conftest import NPI, month

FEW, MANY = NPI["TOO_LITTLE"], NPI["MANY"]


@pytest.fixture(scope="module")
def files(spark, claims, tmp_path_factory):
    """The claims as raw Parquet (numeric identifiers) and as raw CSV with columns in any order."""
    folder = tmp_path_factory.mktemp("claims")
    raw = claims.select(*[
        F.col(name).cast("bigint").alias(r) if name.endswith("npi") else F.col(name).alias(r)
        for r, name in fv.CLAIM_COLUMNS
    ])
    raw.write.parquet(str(folder / "claims.parquet"))
    shuffled = raw.select(*reversed(raw.columns), F.lit("x").alias("EXTRA"))
    shuffled.withColumn(
        "CLAIM_FROM_MONTH", F.date_format("CLAIM_FROM_MONTH", "yyyy-MM")
    ).coalesce(1).write.option("header", True).csv(str(folder / "claims.csv"))
    return folder


@pytest.mark.parametrize("name", ["claims.parquet", "claims.csv"])
def test_load(spark, claims, files, name):
    loaded = source.load_claims(spark, str(files / name))
    assert loaded.schema == CLAIMS
    assert loaded.count() == 430 and loaded.exceptAll(claims).isEmpty()
    assert source.providers(loaded).count() == 15
    own = source.load_provider_claims(spark, str(files / name), FEW)
    assert own.count() == 20 and {r.npi for r in own.collect()} == {FEW}
    assert source.load_provider_claims(spark, str(files / name), "9999999999").isEmpty()


def test_provider_filter_reaches_the_scan(spark, files):
    own = source.load_provider_claims(spark, str(files / "claims.parquet"), FEW)
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert f"EqualTo(BILLING_PROVIDER_NPI_NUM,{FEW})" in plan


def test_internal_names_pass_through(claims):
    assert source.normalize(claims).schema == CLAIMS


def test_codes_keep_leading_zeros_and_bad_values_stop_the_job(spark, tmp_path):
    path = tmp_path / "claims.csv"
    head = "BILLING_PROVIDER_NPI_NUM,HCPCS_CODE,CLAIM_FROM_MONTH,TOTAL_CLAIMS,TOTAL_PAID\n"
    path.write_text(head + "1,00100,2023-01,2,3.50\n,00100,2023-01,2,3.50\n2,X,2023-02-01,,\n")
    rows = {r.npi: r for r in source.load_claims(spark, str(path)).collect()}
    assert set(rows) == {"1", "2"}
    assert rows["1"].procedure_code == "00100" and rows["1"].total_paid == Decimal("3.5000")
    assert rows["1"].service_month == month(1) and rows["2"].service_month == month(2)
    assert rows["2"].total_claims is None
    path.write_text(head + "1,A,2022-01,many,1\n")
    with pytest.raises(PySparkException):
        source.load_claims(spark, str(path)).collect()


def test_floating_identifiers(spark):
    frame = spark.createDataFrame([(1234567890.0, 1)], "npi double, total_claims int")
    assert source.normalize(frame).collect()[0].npi == "1234567890"


def test_summary_store(spark, claims, monthly, procedure, tmp_path):
    store.write_summaries(claims, str(tmp_path))
    store.write_summaries(claims, str(tmp_path))  # again, over the first
    read_monthly, read_procedure = store.read_summaries(spark, str(tmp_path))
    assert read_monthly.count() == 150 and read_monthly.exceptAll(monthly).isEmpty()
    assert read_procedure.count() == 430 and read_procedure.exceptAll(procedure).isEmpty()
    config = ScanConfig()
    direct = scans.scan_claims(claims, config)
    assert scans.scan(read_monthly, read_procedure, config).exceptAll(direct).isEmpty()


def test_staging_uses_the_shared_folder(spark):
    staging = Staging(spark)
    assert staging.folder.startswith(shared_folder(spark))
    kept = staging.keep(spark.range(3).toDF("x"), "numbers")
    assert sorted(r.x for r in kept.collect()) == [0, 1, 2]
    other = Staging(spark)
    other.keep(spark.range(2).toDF("x"), "numbers")
    other.close()
    assert kept.count() == 3
    with pytest.raises(PySparkException):
        spark.read.parquet(other.folder)


def test_csv(spark, monthly, procedure, tmp_path):
    results = scans.scan(monthly, procedure, ScanConfig())
    sinks.write_csv(results, str(tmp_path / "results"))
    rows = sinks.read_csv(spark, str(tmp_path / "results")).orderBy("rank").collect()
    assert len(rows) == 5 and [r["rank"] for r in rows] == list(range(1, 6))
    assert rows[0].npi == MANY and rows[0].score == 0.85
    assert rows[0].flag_types == "billing_spike, suspicious_consistency, volume_impossibility"
    text = "".join(p.read_text() for p in Path(tmp_path / "results").glob("part-*"))
    assert "rank,npi,score,num_flags,flag_types" in text and ",0.850," in text


def test_payload(spark, monthly, procedure, tmp_path):
    results = scans.scan(monthly, procedure, ScanConfig())
    answer = sinks.payload(results, ScanRequest(top=2))
    sinks.write_payload(answer, str(tmp_path / "answer"))
    (text,) = [p.read_text() for p in (tmp_path / "answer").glob("part-*.json") if p.stat().st_size]
    stored = json.loads(text)
    assert stored["total"] == 5 and len(stored["providers"]) == 2
    assert stored["params"] == {"threshold": 0.3, "top": 2, "state": None}
    first = stored["providers"][0]
    assert first["npi"] == MANY and first["overall_score"] == 0.85 and first["num_flags"] == 3
    assert first["red_flags"][0]["evidence"] == {"month": "2023-12-01", "claims": 1650}
    again = sinks.read_payload(spark, str(tmp_path / "answer")).collect()[0]
    assert again.total == 5 and again.providers[0].red_flags[1].severity == 0.55


def test_payload_without_results(spark, monthly, procedure):
    nobody = scans.scan(monthly, procedure, ScanConfig(threshold=1.0))
    (row,) = sinks.payload(nobody, ScanRequest(threshold=1.0)).collect()
    assert row.total == 0 and row.providers == []


@pytest.mark.parametrize("wrong", [
    lambda: ScanRequest(threshold=1.1), lambda: ScanRequest(threshold=-0.1),
    lambda: ScanRequest(top=0), lambda: ScanRequest(top=501), lambda: ScanRequest(state="WVA"),
    lambda: ProfileRequest("123"), lambda: ProfileRequest("12345678x0"),
    lambda: ProfileRequest("1234567890\n"), lambda: LookupRequest(""),
    lambda: LookupRequest("a", "W"), lambda: ScanConfig(threshold=2.0),
    lambda: ScanConfig(flag_types=("other",)),
])
def test_requests_are_checked(wrong):
    with pytest.raises(ValueError):
        wrong()


def test_requests_within_bounds():
    ScanRequest(threshold=0.0, top=500, state="WV")
    ProfileRequest("1234567890")
    LookupRequest("a")


def test_region_cut_filters_claims_before_the_shuffle(spark, claims, tmp_path):
    """Without broadcasts, as for many providers: a runtime filter keeps other regions' claims out."""
    wide = claims.crossJoin(spark.range(300).withColumnRenamed("id", "n"))
    wide.withColumn("npi", F.when(F.col("n") == 0, F.col("npi")).otherwise(F.concat("npi", "n"))).drop("n").write.parquet(
        str(tmp_path / "claims"))
    registry = [(npi, "OR", "97110", "") for npi in NPI.values()] + [("7", "ID", "83201", "")] * 50
    spark.createDataFrame(
        registry, "npi string, practice_state string, postal_code string, deactivation_date string"
    ).write.parquet(str(tmp_path / "registry"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1",
    }
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        subset = region_subset(spark.read.parquet(str(tmp_path / "claims")),
                               spark.read.parquet(str(tmp_path / "registry")), "OR", ("971",))
        plan = subset._jdf.queryExecution().executedPlan().toString()
        assert "might_contain" in plan and "BroadcastHashJoin" not in plan
        assert subset.count() == claims.count()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
