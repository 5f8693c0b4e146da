"""The full scan: qualify, detect, merge, score."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from claimgauge import fixed_values as fv
from claimgauge.config import ScanConfig
from claimgauge.operators import detectors as D
from claimgauge.operators import summaries as S
from claimgauge.operators.flags import all_flags
from claimgauge.operators.scoring import above_threshold, score
from claimgauge.sources.month_store import MonthStore
from claimgauge.sources.staging import Staging
from claimgauge.sources.summary_store import stage_summaries

#: Providers in a frame, or one provider's identifier; None: everyone.
Scope = DataFrame | str | None


@dataclass(frozen=True)
class Detection:
    """What a scan knows before scoring."""

    totals: DataFrame
    selected: DataFrame
    flags: DataFrame


class Funnel:
    """Counts taken while a scan's tables are written, so that they cost no job of their own."""

    def __init__(self, config: ScanConfig) -> None:
        self.config = config
        self._totals, self._selected, self._scored = Observation(), Observation(), Observation()

    def over_totals(self, totals: DataFrame) -> DataFrame:
        return totals.observe(self._totals, *_total_counts(self.config))

    def over_selected(self, selected: DataFrame) -> DataFrame:
        return selected.observe(self._selected, F.count(F.lit(1)).alias("in_scope"))

    def over_scored(self, scored: DataFrame) -> DataFrame:
        """One row for each flagged provider, so a detector's providers are plain counts."""
        by_type = [F.count_if(F.array_contains("flag_types", name)).alias(name) for name in fv.FLAG_ORDER]
        return scored.observe(self._scored, *by_type, *_score_counts(self.config))

    def rows(self, example: DataFrame) -> DataFrame:
        """One row for each step, once the tables are written."""
        counts = self._totals.get | self._selected.get | self._scored.get
        return example.sparkSession.createDataFrame(list(counts.items()), "stage string, providers bigint")


def detect(
    monthly: DataFrame,
    procedure: DataFrame,
    config: ScanConfig,
    scope: Scope = None,
    organizations: DataFrame | None = None,
    staging: Staging | None = None,
    totals: DataFrame | None = None,
    baseline: DataFrame | None = None,
    watch: Funnel | None = None,
) -> Detection:
    """All flags of the qualifying providers, or of those of them that are in `scope`.

    A scope cuts the summaries before anything else is done with them. Only the revenue baseline covers
    every qualifying provider: it takes the totals of all, one row each. Where both are stored
    (`MonthStore`) and passed, nothing about providers out of scope is computed or written.
    Without a scope nearly all rows belong to qualifying providers, so those are selected among the flags
    instead: one small join in place of two large ones.

    The frames that several detectors read are written once: the history of months, and the
    procedure profile with one row per provider. So is the baseline's single row, or its many
    small steps would be planned anew wherever it is used.
    """
    staging = staging or Staging(monthly.sparkSession)
    stored = totals is not None
    history = staging.keep(S.provider_history(_cut(monthly, scope)), "history")
    if totals is None:
        everyone = S.totals_of_history(history) if scope is None else S.provider_totals(monthly)
        totals = staging.keep(watch.over_totals(everyone) if watch else everyone, "totals")
    qualified = S.qualifying(totals, config)
    if baseline is None:
        baseline = staging.keep(D.revenue_baseline(qualified, config, staging), "baseline")
    selected = _cut(qualified, scope)
    if watch:
        if stored:
            watch.over_totals(totals).write.format("noop").mode("overwrite").save()
        selected = staging.keep(watch.over_selected(selected), "selected")
    # The shuffle by provider serves every sum by code, by month and by provider above it.
    procedure = _cut(procedure, scope).repartition("npi")
    profile = staging.keep(D.code_profile(procedure, config), "profile")
    leading = profile.select("npi", F.col("leading_code").alias("procedure_code"))
    excluded = D.billing_like_organizations(leading, config)
    if organizations is not None:
        excluded = excluded.unionByName(organizations.select("npi")).distinct()
    findings = {
        fv.VOLUME: D.volume_findings(history, config, excluded),
        fv.REVENUE: D.revenue_findings(selected, config, baseline),
        fv.SPIKE: D.spike_findings(history, config),
        fv.CONSISTENCY: D.consistency_findings(profile, config),
        fv.NOS: D.nos_findings(profile, config),
        fv.UPCODING: D.upcoding_findings(D.visit_halves(procedure, config), config),
    }
    flags = S.keep_providers(all_flags(findings, config), selected)
    return Detection(totals, selected, flags)


def _cut(frame: DataFrame, scope: Scope) -> DataFrame:
    """One provider is a filter that reaches the scan of the table; many are a join."""
    if scope is None:
        return frame
    if isinstance(scope, str):
        return frame.where(F.col("npi") == scope)
    return S.keep_providers(frame, scope)


def scan(
    monthly: DataFrame,
    procedure: DataFrame,
    config: ScanConfig,
    scope: Scope = None,
    organizations: DataFrame | None = None,
    staging: Staging | None = None,
    **stored: DataFrame,
) -> DataFrame:
    """Providers scored at or above the threshold, unordered. `stored`: totals and baseline."""
    found = detect(monthly, procedure, config, scope, organizations, staging, **stored)
    return above_threshold(score(found.flags, config), config)


def scan_with_funnel(
    monthly: DataFrame,
    procedure: DataFrame,
    config: ScanConfig,
    scope: Scope = None,
    organizations: DataFrame | None = None,
    staging: Staging | None = None,
    **stored: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """The scan, and how many providers were left after each of its steps, counted on the way.

    Spark counts a task once for each time it ran, so after a lost executor the counts may be too high;
    `funnel` counts anew.
    """
    staging = staging or Staging(monthly.sparkSession)
    watch = Funnel(config)
    found = detect(monthly, procedure, config, scope, organizations, staging, watch=watch, **stored)
    scored = staging.keep(watch.over_scored(score(found.flags, config)), "scored")
    return above_threshold(scored, config), watch.rows(scored)


def scan_claims(
    claims: DataFrame,
    config: ScanConfig,
    scope: Scope = None,
    organizations: DataFrame | None = None,
    staging: Staging | None = None,
) -> DataFrame:
    staging = staging or Staging(claims.sparkSession)
    monthly, procedure = stage_summaries(claims, staging)
    return scan(monthly, procedure, config, scope, organizations, staging)


def scan_store(
    store: MonthStore,
    config: ScanConfig,
    scope: Scope = None,
    organizations: DataFrame | None = None,
    staging: Staging | None = None,
) -> DataFrame:
    """The scan of stored summaries, with their stored totals and baseline. The store must have been
    refreshed under the same configuration."""
    return scan(store.monthly(), store.procedure(), config, scope, organizations, staging,
                totals=store.totals(), baseline=store.baseline())


def scan_provider(
    monthly: DataFrame, procedure: DataFrame, config: ScanConfig, npi: str, **others
) -> DataFrame:
    """One provider's result at any score. Only the revenue baseline reads other providers."""
    return scan(monthly, procedure, replace(config, threshold=0.0), npi, **others)


def funnel(found: Detection, config: ScanConfig, staging: Staging) -> DataFrame:
    """How many providers are left after each step, one row per step."""
    flags = staging.keep(found.flags, "flags")
    counted = [
        found.totals.agg(*_total_counts(config)),
        found.selected.agg(F.count(F.lit(1)).alias("in_scope")),
        flags.select("npi", "flag_type").distinct().agg(*[
            F.count_if(F.col("flag_type") == name).alias(name) for name in fv.FLAG_ORDER
        ]),
        score(flags, config).agg(*_score_counts(config)),
    ]
    steps = [
        counts.unpivot([], counts.columns, "stage", "providers") for counts in counted
    ]
    return reduce(DataFrame.unionByName, steps)


def _total_counts(config: ScanConfig) -> list[Column]:
    qualifies = F.col("total_paid") >= F.lit(config.min_total_paid)
    return [
        F.count(F.lit(1)).alias("seen"),
        F.count_if(qualifies).alias("qualifying"),
        F.count_if(~qualifies).alias("excluded"),
    ]


def _score_counts(config: ScanConfig) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("scored"),
        F.count_if(F.col("overall_score") >= config.threshold).alias("above_threshold"),
    ]
