"""What a written report says about a provider, as rows ready to print."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgauge.functions.expressions import evidence_text, filled, number, titled
from claimgauge.operators.registry import enumeration_label
from claimgauge.operators.scoring import risk_label


def flag_lines(results: DataFrame) -> DataFrame:
    """One row per flag, numbered within its provider."""
    flags = results.select(
        "npi", "overall_score", F.posexplode("red_flags").alias("place", "f")
    )
    return flags.select(
        "npi",
        risk_label(F.col("overall_score")).alias("risk"),
        (F.col("place") + 1).alias("place"),
        F.col("f.flag_type").alias("flag_type"),
        F.col("f.service_month").alias("service_month"),
        risk_label(F.col("f.severity")).alias("severity_risk"),
        titled(F.col("f.flag_type")).alias("title"),
        F.col("f.description").alias("description"),
        evidence_text(F.col("f.evidence_json")).alias("evidence"),
    )


def provider_lines(dossiers: DataFrame) -> DataFrame:
    """Heading of a report: name, kind of provider, address, score as percent and label."""
    kind = F.col("provider.enumeration_type")
    return dossiers.select(
        "npi",
        F.col("provider.name").alias("name"),
        F.when(kind != "", enumeration_label(kind)).otherwise("").alias("type"),
        address_line(F.col("provider")).alias("address"),
        number(F.col("overall_score"), "0%").alias("score"),
        risk_label(F.col("overall_score")).alias("risk"),
    )


def address_line(provider: Column) -> Column:
    """The known parts of an address, separated by commas."""
    parts = [filled(provider[part]) for part in ("address", "city", "state", "zip")]
    return F.concat_ws(", ", *parts)
