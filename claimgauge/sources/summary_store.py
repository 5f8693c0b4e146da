"""The two summaries as tables: written once from the claims, read by every later scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimgauge.operators import summaries as S
from claimgauge.sources.keyed import bloom_filtered
from claimgauge.sources.staging import Staging

MONTHLY = "provider_monthly"
PROCEDURE = "provider_procedure"


def write_summaries(claims: DataFrame, folder: str, staging: Staging | None = None) -> None:
    """Aggregate the claims once and write both summaries in ranges of their keys.

    A provider's rows lie together, so scans combine them before they shuffle and a lookup reads
    few row groups, while a provider with very many rows still spans several ranges. `MonthStore` keeps
    the same summaries month by month, with what is derived from them.
    """
    own = staging or Staging(claims.sparkSession)
    cells = own.keep(S.claim_cells(claims), "cells")
    for name, summary, keys in (
        (MONTHLY, S.monthly_of_cells, S.MONTHLY_KEY),
        (PROCEDURE, S.procedure_of_cells, S.PROCEDURE_KEY),
    ):
        # The cells of a row lie in one range, so they are summed there.
        ranged = summary(cells.repartitionByRange(*keys)).sortWithinPartitions(*keys)
        bloom_filtered(ranged.write.mode("overwrite"), "npi").parquet(f"{folder}/{name}")
    if staging is None:
        own.close()


def read_summaries(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/{MONTHLY}"), spark.read.parquet(f"{folder}/{PROCEDURE}")


def stage_summaries(
    claims: DataFrame, staging: Staging | None = None
) -> tuple[DataFrame, DataFrame]:
    """Both summaries for one job: the claims are read once, whatever the number of detectors."""
    staging = staging or Staging(claims.sparkSession)
    return summaries_of_cells(staging.keep(S.claim_cells(claims), "cells"))


def summaries_of_cells(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Months are summed where their provider's history is: the cells travel by provider, once. They are
    combined already, so a provider has no more of them than codes times months."""
    return S.monthly_of_cells(cells.repartition("npi")), S.procedure_of_cells(cells)
