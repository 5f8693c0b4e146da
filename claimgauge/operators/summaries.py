"""Roll-ups of the claims. Every shuffle here is on the full key, after map-side combining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from claimgauge.config import ScanConfig
from claimgauge.schema import MONEY_SUM

MONTHLY_KEY = ("npi", "service_month")
PROCEDURE_KEY = ("npi", "procedure_code", "service_month")


def claim_cells(claims: DataFrame) -> DataFrame:
    """One row per provider, procedure and month, with a row count and every measure present.

    Both summaries and all report sections derive from it. Missing codes and months stay as
    groups of their own, because totals per provider include them.
    """
    keys = [key for key in PROCEDURE_KEY if key in claims.columns]
    return claims.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"), *_sums(claims, _measures(claims))
    )


def monthly_summary(claims: DataFrame) -> DataFrame:
    known = claims.where(_all_known(MONTHLY_KEY))
    return known.groupBy(*MONTHLY_KEY).agg(*_sums(claims, _measures(claims)))


def procedure_summary(claims: DataFrame) -> DataFrame:
    known = claims.where(_all_known(PROCEDURE_KEY))
    return known.groupBy(*PROCEDURE_KEY).agg(*_sums(claims, ("total_claims", "total_paid")))


def monthly_of_cells(cells: DataFrame) -> DataFrame:
    return monthly_summary(cells)


def procedure_of_cells(cells: DataFrame) -> DataFrame:
    """The cells with a code and a month are the procedure summary: no shuffle."""
    known = cells.where(_all_known(PROCEDURE_KEY))
    return known.select(*PROCEDURE_KEY, "total_claims", "total_paid")


def provider_totals(monthly: DataFrame) -> DataFrame:
    """One row per provider: everything paid and claimed."""
    return monthly.groupBy("npi").agg(*_sums(monthly, ("total_claims", "total_paid")))


def provider_history(monthly: DataFrame) -> DataFrame:
    """Every month beside its provider's sums over all months.

    One shuffle by provider serves whatever compares months with their own history, and the
    totals too: they are the rows of the first month. A provider has few months, however many
    claims it has.
    """
    own = Window.partitionBy("npi")

    def over_all(name: str, kind: str | DecimalType) -> Column:
        return F.coalesce(F.sum(name).over(own), F.lit(0)).cast(kind)

    return monthly.select(
        *MONTHLY_KEY,
        "total_claims",
        "total_paid",
        over_all("total_claims", "bigint").alias("provider_claims"),
        over_all("total_paid", MONEY_SUM).alias("provider_paid"),
        F.count("total_paid").over(own).alias("months"),
        (F.row_number().over(own.orderBy("service_month")) == 1).alias("first"),
    )


def totals_of_history(history: DataFrame) -> DataFrame:
    return history.where("first").select(
        "npi",
        F.col("provider_claims").alias("total_claims"),
        F.col("provider_paid").alias("total_paid"),
    )


def qualifying(totals: DataFrame, config: ScanConfig) -> DataFrame:
    """Providers paid enough to be worth a scan."""
    return totals.where(F.col("total_paid") >= F.lit(config.min_total_paid))


def keep_providers(frame: DataFrame, providers: DataFrame) -> DataFrame:
    return frame.join(providers.select("npi"), "npi", "left_semi")


def drop_providers(frame: DataFrame, providers: DataFrame) -> DataFrame:
    return frame.join(providers.select("npi"), "npi", "left_anti")


def _measures(frame: DataFrame) -> list[str]:
    return [m for m in ("total_claims", "total_paid", "beneficiaries") if m in frame.columns]


def _sums(frame: DataFrame, names: list[str] | tuple[str, ...]) -> list[Column]:
    """Sums that are 0 where every value is missing; money stays exact."""
    zero = F.lit(0)
    return [
        F.coalesce(F.sum(name), zero)
        .cast(MONEY_SUM if name == "total_paid" else "bigint")
        .alias(name)
        for name in names
    ]


def _all_known(keys: tuple[str, ...]) -> Column:
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    return known
