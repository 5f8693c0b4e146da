"""From flags to scored, ranked providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgauge import fixed_values as fv
from claimgauge.config import ScanConfig
from claimgauge.functions.expressions import at_most_one
from claimgauge.functions.order_statistics import global_rank
from claimgauge.sources.staging import Staging


def best_first() -> list[Column]:
    """Highest score first; equal scores by provider, so that the order is the same every time."""
    return [F.col("overall_score").desc(), F.col("npi").asc()]


def score(flags: DataFrame, config: ScanConfig) -> DataFrame:
    """One row per flagged provider.

    A provider has at most two flags per month and four others, so its list stays small.
    """
    place = F.array_position(F.lit(list(fv.FLAG_ORDER)), F.col("flag_type"))
    flag = F.struct(
        place.alias("place"), "service_month", "flag_type", "description", "severity",
        "evidence_json",
    )
    merged = flags.groupBy("npi").agg(
        F.max("severity").alias("max_severity"),
        F.count(F.lit(1)).alias("num_flags"),
        F.array_sort(F.collect_set("flag_type")).alias("flag_types"),
        F.sort_array(F.collect_list(flag)).alias("_flags"),
    )
    scheme = F.filter("flag_types", lambda t: t.isin(*fv.SCHEME_FLAGS))
    measured = merged.withColumn("distinct_types", F.size("flag_types").cast("bigint")).withColumn(
        "scheme_types", F.size(scheme).cast("bigint")
    )
    weights = config.weights
    points = (
        F.col("max_severity") * weights.severity
        + F.col("distinct_types") * weights.flag_type
        + F.col("scheme_types") * weights.scheme
    )
    return measured.select(
        "npi",
        at_most_one(points).alias("overall_score"),
        "max_severity", "num_flags", "distinct_types", "scheme_types", "flag_types",
        F.transform("_flags", lambda f: f.dropFields("place")).alias("red_flags"),
    )


def above_threshold(scored: DataFrame, config: ScanConfig) -> DataFrame:
    return scored.where(F.col("overall_score") >= config.threshold)


def ranked(results: DataFrame, staging: Staging) -> DataFrame:
    """All results numbered 1..n, best first."""
    return global_rank(results, best_first(), "ranked", staging)


def top(results: DataFrame, n: int) -> DataFrame:
    """The first n results, numbered. Each task hands over n rows at most."""
    first = results.orderBy(*best_first()).limit(n)
    number = F.row_number().over(Window.orderBy(*best_first())).cast("bigint")
    return first.select(number.alias("rank"), *[F.col(c) for c in results.columns])


def risk_label(value: Column) -> Column:
    return (
        F.when(value >= fv.HIGH_RISK, "HIGH").when(value >= fv.MEDIUM_RISK, "MEDIUM").otherwise("LOW")
    )
