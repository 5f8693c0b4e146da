"""Whole requests: a scan answered as JSON, and one provider's profile, each as one job."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgauge.config import LookupRequest, ProfileRequest, ScanConfig, ScanRequest
from claimgauge.operators.peers import peer_lookup
from claimgauge.operators.registry import organizations, providers_in_state, search
from claimgauge.operators.summaries import claim_cells, provider_totals
from claimgauge.plans.dossier import build_dossiers
from claimgauge.plans.scan import scan, scan_provider, scan_store
from claimgauge.sources.month_store import MonthStore
from claimgauge.sources.name_index import NameIndex
from claimgauge.sources.sinks import payload
from claimgauge.sources.staging import Staging


def scan_request(
    monthly: DataFrame,
    procedure: DataFrame,
    registry: DataFrame,
    request: ScanRequest,
    config: ScanConfig,
    staging: Staging,
) -> DataFrame:
    """The answer to a request: its state is the scan's scope, its threshold the scan's, its top the
    number of providers listed. Registered organizations are left out of the volume flags."""
    scope = providers_in_state(registry, request.state) if request.state else None
    asked = replace(config, threshold=request.threshold)
    results = scan(monthly, procedure, asked, scope, organizations(registry), staging)
    return payload(results, request, staging)


def profile_request(
    claims: DataFrame,
    monthly: DataFrame,
    procedure: DataFrame,
    request: ProfileRequest,
    config: ScanConfig,
    staging: Staging,
    registry: DataFrame | None = None,
    descriptions: DataFrame | None = None,
) -> DataFrame:
    """One provider's dossier with its flags at any score. The summaries give the peers and the scan;
    the claims are read for that provider only. It is an error if it has none."""
    own = claims.where(F.col("npi") == request.npi)
    if own.isEmpty():
        raise LookupError(f"no claims found for provider {request.npi}")
    known = organizations(registry) if registry is not None else None
    result = staging.keep(
        scan_provider(monthly, procedure, config, request.npi, organizations=known, staging=staging),
        "result",
    )
    totals = staging.keep(provider_totals(monthly), "totals")
    subject = totals.where(F.col("npi") == request.npi).select("npi")
    return build_dossiers(
        claim_cells(own), totals, registry, result, descriptions, subject, staging
    )


def profile_from_store(
    store: MonthStore,
    claims: DataFrame,
    request: ProfileRequest,
    config: ScanConfig,
    staging: Staging,
    registry: DataFrame | None = None,
    descriptions: DataFrame | None = None,
) -> DataFrame:
    """The same from stored summaries: no table is read but for this provider's rows, one range of the
    rank index and the stored baseline. It is an error if the provider has no claims."""
    own = claims.where(F.col("npi") == request.npi)
    if own.isEmpty():
        raise LookupError(f"no claims found for provider {request.npi}")
    known = organizations(registry) if registry is not None else None
    result = staging.keep(
        scan_store(store, replace(config, threshold=0.0), request.npi, known, staging), "result")
    peers = peer_lookup(store.provider_totals(request.npi), request.npi, store.rank_index())
    return build_dossiers(
        claim_cells(own), None, registry, result, descriptions, staging=staging, peers=peers
    )


def lookup_request(registry: DataFrame | NameIndex, request: LookupRequest) -> DataFrame:
    """The first providers that match a name or an identifier, in a state if one is asked for. With an
    index of the registry the registry itself is not read."""
    if isinstance(registry, NameIndex):
        return registry.search(request.query, request.state)
    return search(registry, request.query, request.state)
