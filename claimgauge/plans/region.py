"""Cutting the claims to the active providers of a region."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgauge.operators.registry import region_rows
from claimgauge.operators.summaries import keep_providers


def region_subset(
    claims: DataFrame, registry: DataFrame, state: str, zip_prefixes: tuple[str, ...]
) -> DataFrame:
    """Both keys are text by now, whatever the files hold.

    Where the region's providers are too many to broadcast, Spark filters the claims by a Bloom filter of
    them before it shuffles, from ``spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold``
    of claims on, so that the shuffle carries the region's rows and few others.
    """
    return keep_providers(claims, region_rows(registry, state, zip_prefixes))


def region_counts(subset: DataFrame) -> DataFrame:
    return subset.agg(
        F.count_distinct("npi").alias("providers"), F.count(F.lit(1)).alias("claim_rows")
    )


def write_region_subset(subset: DataFrame, path: str) -> None:
    subset.write.mode("overwrite").parquet(path)
