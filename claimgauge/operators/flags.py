"""Findings as flag rows of one shape: type, sentence, severity, evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgauge import fixed_values as fv
from claimgauge.config import ScanConfig
from claimgauge.functions.expressions import money, number, whole
from claimgauge.schema import FLAGS


def flag_rows(findings: DataFrame, flag_type: str, config: ScanConfig) -> DataFrame:
    words, evidence = _wording(flag_type, config)
    month = F.col("service_month") if "service_month" in findings.columns else F.lit(None)
    return findings.select(
        "npi",
        F.lit(flag_type).alias("flag_type"),
        month.cast("date").alias("service_month"),
        F.format_string(fv.DESCRIPTIONS[flag_type], *words).alias("description"),
        F.col("severity"),
        F.to_json(F.struct(*[value.alias(key) for key, value in evidence.items()])).alias(
            "evidence_json"
        ),
    )


def all_flags(findings: dict[str, DataFrame], config: ScanConfig) -> DataFrame:
    """One frame with the flags of all detectors in `findings` that the configuration uses."""
    parts = [
        flag_rows(findings[flag_type], flag_type, config)
        for flag_type in fv.FLAG_ORDER
        if flag_type in findings and flag_type in config.flag_types
    ]
    if not parts:
        return no_flags(next(iter(findings.values())).sparkSession)
    return reduce(DataFrame.unionByName, parts)


def no_flags(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FLAGS)


def _wording(flag_type: str, config: ScanConfig) -> tuple[list[Column], dict[str, Column]]:
    """The pieces of the sentence and the evidence for one flag type."""
    c = F.col
    month = F.col("service_month").cast("string") if flag_type in (fv.VOLUME, fv.SPIKE) else None
    if flag_type == fv.VOLUME:
        limit = F.lit(f"{config.max_claims_per_month:,}")
        words = [whole(c("total_claims")), month, limit]
        evidence = {"month": month, "claims": c("total_claims")}
    elif flag_type == fv.REVENUE:
        words = [money(c("paid_per_claim")), number(c("z"), "0.0"), money(c("median"))]
        evidence = {
            "paid_per_claim": F.bround("paid_per_claim", 2),
            "total_paid": c("total_paid"),
            "total_claims": c("total_claims"),
            "modified_zscore": F.bround("z", 2),
        }
    elif flag_type == fv.SPIKE:
        times = number(c("ratio"), "0.0")
        words = [money(c("total_paid")), month, times, money(c("mean_paid"))]
        evidence = {
            "month": month,
            "amount": c("total_paid"),
            "ratio": F.bround("ratio", 2),
        }
    elif flag_type == fv.CONSISTENCY:
        words = [
            number(c("share"), "0%"), c("procedure_code"), money(c("mean_rate")),
            number(c("cv"), "0.0%"), c("months").cast("string"),
        ]
        evidence = {
            "procedure_code": c("procedure_code"),
            "dominance_ratio": F.bround("share", 3),
            "mean_rate_per_claim": F.bround("mean_rate", 2),
            "rate_cv": F.bround("cv", 4),
            "months_observed": c("months"),
        }
    elif flag_type == fv.NOS:
        words = [number(c("share"), "0%"), whole(c("nos_paid"))]
        evidence = {
            "nos_ratio": F.bround("share", 3),
            "nos_paid": F.bround("nos_paid", 2),
            "total_paid": F.bround("total_paid", 2),
        }
    else:
        words = [
            number(c(name), "0.00") for name in ("shift", "early_level", "late_level")
        ] + [whole(c("claims"))]
        evidence = {
            "early_avg_level": F.bround("early_level", 2),
            "late_avg_level": F.bround("late_level", 2),
            "shift": F.bround("shift", 2),
            "total_em_claims": c("claims"),
            "total_em_paid": F.bround("paid", 2),
        }
    return words, evidence
