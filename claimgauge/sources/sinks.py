"""Results out: ranked CSV, a JSON answer for the best providers, dossiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgauge.config import ScanRequest
from claimgauge.functions.expressions import number
from claimgauge.operators.scoring import ranked, top
from claimgauge.schema import SCAN_PAYLOAD
from claimgauge.sources.claims import CSV
from claimgauge.sources.keyed import read_key, read_keyed, write_keyed
from claimgauge.sources.staging import Staging

_SHOWN = ("npi", "overall_score", "num_flags", "flag_types", "red_flags")


def csv_rows(numbered: DataFrame) -> DataFrame:
    return numbered.select(
        "rank",
        "npi",
        number(F.col("overall_score"), "0.000").alias("score"),
        "num_flags",
        F.array_join("flag_types", ", ").alias("flag_types"),
    )


def write_csv(results: DataFrame, path: str, staging: Staging | None = None) -> None:
    """All results, numbered, best first. Every task writes its own range of ranks."""
    own = staging or Staging(results.sparkSession)
    rows = csv_rows(ranked(results, own))
    rows.write.mode("overwrite").options(**CSV).csv(path)
    if staging is None:
        own.close()


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = "rank bigint, npi string, score double, num_flags bigint, flag_types string"
    return spark.read.schema(schema).options(**CSV).csv(path)


def payload(
    results: DataFrame, request: ScanRequest, staging: Staging | None = None
) -> DataFrame:
    """One row: how many results reach the asked threshold, the first of them in full, and what was
    asked. A state asked for is applied by the scan (`plans.request.scan_request`), not here.

    The request allows 500 providers at most, so the row stays small. The results are written
    once, because they are both counted and searched for the first.
    """
    asked = results.where(F.col("overall_score") >= request.threshold)
    results = (staging or Staging(results.sparkSession)).keep(asked, "results")
    listed = top(results, request.top).agg(
        F.sort_array(F.collect_list(F.struct("rank", *_SHOWN))).alias("_first")
    )
    params = F.struct(
        F.lit(request.threshold).alias("threshold"),
        F.lit(request.top).cast("bigint").alias("top"),
        F.lit(request.state).cast("string").alias("state"),
    )
    return listed.select(
        results.agg(F.count(F.lit(1)).alias("total")).scalar().alias("total"),
        F.transform("_first", _shown_provider).alias("providers"),
        params.alias("params"),
    )


def write_payload(answer: DataFrame, path: str) -> None:
    answer.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_payload(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCAN_PAYLOAD).json(path)


def write_dossiers(dossiers: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Parquet is laid out for `read_dossier`; other formats lie in ranges of providers."""
    if fmt == "parquet":
        write_keyed(dossiers, path)
    else:
        ranged = dossiers.repartitionByRange("npi").sortWithinPartitions("npi")
        ranged.write.mode("overwrite").format(fmt).save(path)


def read_dossiers(spark: SparkSession, path: str) -> DataFrame:
    return read_keyed(spark, path)


def read_dossier(spark: SparkSession, path: str, npi: str) -> DataFrame:
    """One provider's dossier, or no row. What is read does not grow with the number of dossiers."""
    return read_key(spark, path, npi)


def _shown_provider(row: Column) -> Column:
    return F.struct(
        row["npi"].alias("npi"),
        F.bround(row["overall_score"], 3).alias("overall_score"),
        row["num_flags"].alias("num_flags"),
        row["flag_types"].alias("flag_types"),
        F.transform(row["red_flags"], _shown_flag).alias("red_flags"),
    )


def _shown_flag(flag: Column) -> Column:
    return F.struct(
        flag["flag_type"].alias("flag_type"),
        flag["description"].alias("description"),
        F.bround(flag["severity"], 3).alias("severity"),
        F.parse_json(flag["evidence_json"]).alias("evidence"),
    )
