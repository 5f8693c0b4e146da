"""Dossiers: every section of every asked provider, one nested row each, in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgauge.config import ProfileRequest
from claimgauge.operators import dossier as sections
from claimgauge.operators.peers import peer_comparison
from claimgauge.operators.registry import provider_rows
from claimgauge.operators.summaries import claim_cells, keep_providers, provider_totals
from claimgauge.sources.staging import Staging


def build_dossiers(
    cells: DataFrame,
    totals: DataFrame | None,
    registry: DataFrame | None = None,
    results: DataFrame | None = None,
    descriptions: DataFrame | None = None,
    subjects: DataFrame | None = None,
    staging: Staging | None = None,
    peers: DataFrame | None = None,
) -> DataFrame:
    """One row per provider in `cells`, or per subject that has any.

    `cells` are the claims summed by provider, procedure and month (`claim_cells`), or the claims
    themselves; a scan of the same claims has the cells already. They are cut to the subjects after
    that sum, so a provider with very many claims has been combined before it travels. `totals` are
    those of all providers, which the subjects are compared with; `peers` is that comparison, where it has
    been made. `registry` is a normalized registry or rows read from service answers. Providers without a
    scan result have score 0 and no flags.
    """
    staging = staging or Staging(cells.sparkSession)
    if "row_count" not in cells.columns:
        cells = claim_cells(cells)
    asked = cells if subjects is None else keep_providers(cells, subjects)
    # Each section is one shuffle of them by provider, by which the sections are joined too.
    cells = staging.keep(asked, "dossier-cells").repartition("npi")
    summary = sections.claims_summary(cells)
    fields = [c for c in summary.columns if c != "npi"]
    dossier = summary.select("npi", F.struct(*fields).alias("claims_summary"))
    dossier = _with_provider(dossier, registry)
    dossier = _with_result(dossier, results)
    lists = {
        "top_procedures": (
            sections.top_procedures(cells, descriptions)
            if "procedure_code" in cells.columns else None,
            ("place",),
        ),
        "procedure_monthly": (
            sections.procedure_by_month(cells, descriptions), ("service_month", "place"),
        ),
        "timeline": (sections.timeline(cells), ("service_month",)),
    }
    for name, (rows, order) in lists.items():
        if rows is not None:
            dossier = dossier.join(sections.listed(rows, name, *order), "npi", "left")
            dossier = dossier.withColumn(name, F.coalesce(F.col(name), F.array()))
    if "total_paid" in cells.columns:
        peers = peer_comparison(totals, subjects, staging) if peers is None else peers
        numbers = [c for c in peers.columns if c != "npi"]
        peers = peers.select("npi", F.struct(*numbers).alias("peer_comparison"))
        dossier = dossier.join(peers, "npi", "left")
    return dossier


def profile(
    claims: DataFrame,
    npi: str,
    totals: DataFrame | None = None,
    staging: Staging | None = None,
    **others,
) -> DataFrame:
    """The dossier of one provider. It is an error if the provider has no claims."""
    ProfileRequest(npi)
    own = claims.where(F.col("npi") == npi)
    if own.isEmpty():
        raise LookupError(f"no claims found for provider {npi}")
    if totals is None:
        staging = staging or Staging(claims.sparkSession)
        totals = staging.keep(provider_totals(claims), "totals")
    subject = totals.where(F.col("npi") == npi).select("npi")
    return build_dossiers(claim_cells(own), totals, subjects=subject, staging=staging, **others)


def _with_provider(dossier: DataFrame, registry: DataFrame | None) -> DataFrame:
    names = ("name", "specialty", "address", "city", "state", "zip", "enumeration_type")
    if registry is None:
        blank = F.struct("npi", *[F.lit("").alias(n) for n in names])
        return dossier.withColumn("provider", blank)
    rows = registry if "name" in registry.columns else provider_rows(registry)
    known = rows.select("npi", F.struct(*names).alias("_p"))
    provider = F.struct(
        "npi", *[F.coalesce(F.col(f"_p.{n}"), F.lit("")).alias(n) for n in names]
    )
    return dossier.join(known, "npi", "left").withColumn("provider", provider).drop("_p")


def _with_result(dossier: DataFrame, results: DataFrame | None) -> DataFrame:
    if results is None:
        return dossier.withColumn("overall_score", F.lit(0.0)).withColumn("red_flags", F.array())
    scored = results.select("npi", "overall_score", "red_flags")
    joined = dossier.join(scored, "npi", "left")
    return joined.withColumn(
        "overall_score", F.coalesce("overall_score", F.lit(0.0))
    ).withColumn("red_flags", F.coalesce("red_flags", F.array()))
