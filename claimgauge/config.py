"""Parameters of a scan and the checks on what a caller asks for."""

from __future__ import annotations

import re
from dataclasses import dataclass

from claimgauge import fixed_values as fv


@dataclass(frozen=True)
class ScoreWeights:
    severity: float
    flag_type: float
    scheme: float


SIX_SIGNAL = ScoreWeights(*fv.SIX_SIGNAL_WEIGHTS)
FOUR_SIGNAL = ScoreWeights(*fv.FOUR_SIGNAL_WEIGHTS)


@dataclass(frozen=True)
class ScanConfig:
    min_total_paid: float = fv.MIN_TOTAL_PAID
    max_claims_per_month: int = fv.MAX_CLAIMS_PER_MONTH
    revenue_z: float = fv.REVENUE_Z
    spike_multiplier: float = fv.SPIKE_MULTIPLIER
    spike_min_months: int = fv.SPIKE_MIN_MONTHS
    dominance_share: float = fv.DOMINANCE_SHARE
    rate_cv: float = fv.RATE_CV
    consistency_min_months: int = fv.CONSISTENCY_MIN_MONTHS
    nos_codes: tuple[str, ...] = fv.NOS_CODES
    nos_share: float = fv.NOS_SHARE
    visit_levels: tuple[tuple[str, int], ...] = fv.VISIT_LEVELS
    upcoding_shift: float = fv.UPCODING_SHIFT
    upcoding_min_claims: int = fv.UPCODING_MIN_CLAIMS
    upcoding_min_months: int = fv.UPCODING_MIN_MONTHS
    organization_codes: tuple[str, ...] = fv.ORGANIZATION_CODES
    mad_scale: float = fv.MAD_SCALE
    weights: ScoreWeights = SIX_SIGNAL
    flag_types: tuple[str, ...] = fv.FLAG_ORDER
    threshold: float = fv.RESULT_THRESHOLD
    exact_median: bool = True
    approx_accuracy: int = 10_000

    def __post_init__(self) -> None:
        _check(0.0 <= self.threshold <= 1.0, "threshold must lie in 0..1")
        _check(self.spike_multiplier > 0, "spike_multiplier must be positive")
        _check(self.max_claims_per_month > 0, "max_claims_per_month must be positive")
        unknown = set(self.flag_types) - set(fv.FLAG_ORDER)
        _check(not unknown, f"unknown flag types: {sorted(unknown)}")


@dataclass(frozen=True)
class ScanRequest:
    threshold: float = fv.RESULT_THRESHOLD
    top: int = fv.RESULT_TOP
    state: str | None = None

    def __post_init__(self) -> None:
        _check(0.0 <= self.threshold <= 1.0, "threshold must lie in 0..1")
        _check(1 <= self.top <= 500, "top must lie in 1..500")
        _check(self.state is None or len(self.state) == 2, "state must have two letters")


@dataclass(frozen=True)
class ProfileRequest:
    npi: str

    def __post_init__(self) -> None:
        _check(re.fullmatch(r"[0-9]{10}", self.npi) is not None, "npi must be ten digits")


@dataclass(frozen=True)
class LookupRequest:
    query: str
    state: str | None = None

    def __post_init__(self) -> None:
        _check(len(self.query) >= 1, "query must not be empty")
        _check(self.state is None or len(self.state) == 2, "state must have two letters")


def _check(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)
