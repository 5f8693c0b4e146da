"""Each provider against all providers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgauge.functions.expressions import ratio
from claimgauge.functions.order_statistics import RankIndex, indexed
from claimgauge.operators.summaries import keep_providers
from claimgauge.sources.staging import Staging


def peer_comparison(
    totals: DataFrame,
    subjects: DataFrame | None = None,
    staging: Staging | None = None,
    index: RankIndex | None = None,
) -> DataFrame:
    """Total paid of each subject (default: everyone) beside the mean, median and spread of all.

    The percentile counts the providers paid as much or less. It is looked up by amount, so the
    join stays a plain equality; where many subjects share an amount, adaptive execution can split
    their side, because the side of the counts has one row per amount. ``index`` is the rank index of
    ``total_paid``, where one is stored.
    """
    index = index or indexed(totals, "total_paid", staging)
    asked = totals if subjects is None else keep_providers(totals, subjects)
    placed = asked.join(index.cumulative(), F.col("total_paid") == F.col("value"))
    return _compared(placed, index)


def peer_lookup(totals: DataFrame, npi: str, index: RankIndex) -> DataFrame:
    """The same for one provider: its own row of the totals and one range of the index are read."""
    own = totals.where(F.col("npi") == npi).select("npi", "total_paid")
    found = own.first()
    if found is None:
        return _compared(own.withColumns({"up_to": F.lit(0), "n": F.lit(0)}), index)
    return _compared(own.crossJoin(F.broadcast(index.rows_up_to(found["total_paid"]))), index)


def _compared(placed: DataFrame, index: RankIndex) -> DataFrame:
    """``placed`` has npi, total_paid, up_to and n."""
    facts = index.facts.select(F.struct("n", "mean", "spread")).scalar()
    measured = placed.withColumn("_all", facts).withColumn("_middle", index.median().scalar())
    total = F.col("total_paid").cast("double")
    z = F.when(F.col("_all.spread") > 0, ratio(total - F.col("_all.mean"), F.col("_all.spread")))
    return measured.select(
        "npi",
        F.col("_all.n").alias("peer_count"),
        total.alias("provider_total_paid"),
        F.bround("_all.mean", 2).alias("peer_mean_paid"),
        F.bround("_middle", 2).alias("peer_median_paid"),
        F.bround(ratio(F.col("up_to"), F.col("n")) * 100, 1).alias("provider_percentile"),
        F.bround(z, 2).alias("zscore"),
    )
