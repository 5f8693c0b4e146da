"""The sections of a provider's dossier, for any number of providers at once.

All of them read the claim cells (one row per provider, procedure and month with a row count).
A section whose columns the claims do not have is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgauge import fixed_values as fv
from claimgauge.functions.expressions import or_blank, ratio

_SUMMED = (
    ("total_claims", "total_claims", "bigint"),
    ("total_paid", "total_paid", "double"),
    ("beneficiaries", "total_beneficiaries", "bigint"),
)


def claims_summary(cells: DataFrame) -> DataFrame:
    """Row count, totals, first and last month, number of months."""
    parts = [F.sum("row_count").alias("total_rows")]
    parts += [
        _total(source, kind).alias(name)
        for source, name, kind in _SUMMED
        if source in cells.columns
    ]
    if "service_month" in cells.columns:
        parts += [
            F.min("service_month").alias("date_range_start"),
            F.max("service_month").alias("date_range_end"),
            F.count_distinct("service_month").alias("active_months"),
        ]
    return cells.groupBy("npi").agg(*parts)


def top_procedures(
    cells: DataFrame, descriptions: DataFrame | None = None, n: int = fv.TOP_PROCEDURES
) -> DataFrame:
    """Each provider's procedures with the most claims rows; equal counts by code."""
    parts = [F.sum("row_count").alias("row_count")]
    if "total_claims" in cells.columns:
        parts.append(_total("total_claims", "bigint").alias("claims"))
    if "total_paid" in cells.columns:
        parts.append(_total("total_paid", "double").alias("paid"))
    coded = cells.where(F.col("procedure_code").isNotNull())
    counted = coded.groupBy("npi", "procedure_code").agg(*parts)
    order = Window.partitionBy("npi").orderBy(F.col("row_count").desc(), "procedure_code")
    first = counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    return describe(first, descriptions)


def procedure_by_month(cells: DataFrame, descriptions: DataFrame | None = None) -> DataFrame | None:
    """The last months of each provider, and in each the procedures with the most paid.

    Months are chosen before those without a positive total drop out. Shares are of the whole
    month. The months of a provider are few; its procedures only meet month by month.
    """
    if not {"service_month", "procedure_code", "total_paid", "total_claims"} <= set(cells.columns):
        return None
    known = cells.where(F.col("procedure_code").isNotNull() & F.col("service_month").isNotNull())
    totals = known.groupBy("npi", "service_month").agg(F.sum("total_paid").alias("month_paid"))
    latest = Window.partitionBy("npi").orderBy(F.col("service_month").desc())
    months = (
        totals.withColumn("_back", F.row_number().over(latest))
        .where((F.col("_back") <= fv.BREAKDOWN_MONTHS) & (F.col("month_paid") > 0))
        .select("npi", "service_month", "month_paid")
    )
    in_month = Window.partitionBy("npi", "service_month").orderBy(
        F.col("total_paid").desc(), "procedure_code"
    )
    first = (
        known.join(months, ["npi", "service_month"])
        .withColumn("place", F.row_number().over(in_month))
        .where(F.col("place") <= fv.BREAKDOWN_PROCEDURES)
    )
    share = F.bround(ratio(F.col("total_paid"), F.col("month_paid")) * 100, 1)
    rows = first.select(
        "npi",
        "service_month",
        "place",
        "procedure_code",
        F.col("total_claims").alias("claims"),
        F.col("total_paid").cast("double").alias("total_paid"),
        share.alias("pct_of_month"),
    )
    return describe(rows, descriptions)


def timeline(cells: DataFrame) -> DataFrame | None:
    """Claims and paid per month: rows in place of claims, and 0 for paid, where not recorded."""
    if "service_month" not in cells.columns:
        return None
    claims = "total_claims" if "total_claims" in cells.columns else "row_count"
    paid = _total("total_paid", "double") if "total_paid" in cells.columns else F.lit(0.0)
    dated = cells.where(F.col("service_month").isNotNull())
    return dated.groupBy("npi", "service_month").agg(
        _total(claims, "bigint").alias("total_claims"), paid.alias("total_paid")
    )


def describe(rows: DataFrame, descriptions: DataFrame | None) -> DataFrame:
    """Add the text of each procedure code; blank where the code is unknown."""
    if descriptions is None:
        return rows.withColumn("description", F.lit(""))
    texts = descriptions.select(
        F.upper(F.trim("code")).alias("_code"), F.col("description").alias("_text")
    ).dropDuplicates(["_code"])
    matched = rows.join(texts, F.upper(F.trim("procedure_code")) == F.col("_code"), "left")
    return matched.withColumn("description", or_blank(F.col("_text"))).drop("_code", "_text")


def listed(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """One row per provider with its rows of a section as an ordered list."""
    fields = [*order, *[c for c in rows.columns if c not in ("npi", *order)]]
    return rows.groupBy("npi").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))


def _total(name: str, kind: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).cast(kind)
