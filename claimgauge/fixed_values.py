"""Values that must equal the published behaviour for results to agree.

Fixed values: code lists, level table, thresholds, weights and text formats.
They are data, not logic; `ScanConfig` carries every one that a caller may change.
"""

# Procedure codes billed almost only by organizations with many staff.
ORGANIZATION_CODES = (
    "H0038", "H0039", "H0040", "H0043",
    "H2015", "H2016", "H2017", "H2018", "H2019", "H2020",
    "T1016", "T1017", "T1019", "T1020", "T2020", "T2021",
)

# Codes that do not say what was billed ("not otherwise specified").
NOS_CODES = ("A9270", "A9999", "B9998", "E1399", "K0108", "L9900", "S9999", "T9999")

# Office-visit codes and their level.
VISIT_LEVELS = (("99211", 1), ("99212", 2), ("99213", 3), ("99214", 4), ("99215", 5))

# Flag types, in the order in which a provider's flags are listed.
VOLUME = "volume_impossibility"
REVENUE = "revenue_outlier"
SPIKE = "billing_spike"
CONSISTENCY = "suspicious_consistency"
NOS = "nos_code_concentration"
UPCODING = "upcoding_trajectory"
FLAG_ORDER = (VOLUME, REVENUE, SPIKE, CONSISTENCY, NOS, UPCODING)
SCHEME_FLAGS = (NOS, UPCODING)
FOUR_SIGNAL_FLAGS = (VOLUME, REVENUE, SPIKE, CONSISTENCY)

# Detector thresholds and severity divisors.
MIN_TOTAL_PAID = 100_000
MAX_CLAIMS_PER_MONTH = 1500
REVENUE_Z = 3.0
SPIKE_MULTIPLIER = 5.0
SPIKE_MIN_MONTHS = 3
DOMINANCE_SHARE = 0.70
RATE_CV = 0.08
CONSISTENCY_MIN_MONTHS = 3
NOS_SHARE = 0.25
UPCODING_SHIFT = 0.4
UPCODING_MIN_CLAIMS = 50
UPCODING_MIN_MONTHS = 6
MAD_SCALE = 1.4826
VOLUME_SEVERITY_MONTHS = 3
REVENUE_SEVERITY_Z = 10.0
SPIKE_SEVERITY_RATIO = 10.0
NOS_SEVERITY_SHARE = 0.5
UPCODING_SEVERITY_SHIFT = 1.5

# Score weights: highest severity, per distinct flag type, per scheme flag type.
SIX_SIGNAL_WEIGHTS = (0.4, 0.15, 0.2)
FOUR_SIGNAL_WEIGHTS = (0.5, 0.2, 0.0)
RESULT_THRESHOLD = 0.3
RESULT_TOP = 50
HIGH_RISK = 0.7
MEDIUM_RISK = 0.4

# Limits of the report sections.
SEARCH_LIMIT = 10
TOP_PROCEDURES = 10
BREAKDOWN_MONTHS = 12
BREAKDOWN_PROCEDURES = 5

# Sentences shown with a flag; every %s is an already formatted number or name.
DESCRIPTIONS = {
    VOLUME: "%s claims in %s (max plausible: %s)",
    REVENUE: "Revenue per claim $%s (%s MADs above median $%s/claim)",
    SPIKE: "Monthly paid $%s in %s is %sx their average $%s",
    CONSISTENCY: (
        "%s of billing is procedure %s at $%s/claim with only %s rate variation "
        "across %s months — consistent with copy-paste billing"
    ),
    NOS: (
        "%s of billing ($%s) under miscellaneous/unclassified codes — "
        "vague codes obscure what was actually provided"
    ),
    UPCODING: (
        "E&M code level shifted +%s points over time (%s → %s) — systematic upgrade "
        "toward higher-reimbursed codes across %s claims"
    ),
}

# Raw claims columns and the names used here.
CLAIM_COLUMNS = (
    ("BILLING_PROVIDER_NPI_NUM", "npi"),
    ("SERVICING_PROVIDER_NPI_NUM", "servicing_npi"),
    ("HCPCS_CODE", "procedure_code"),
    ("CLAIM_FROM_MONTH", "service_month"),
    ("TOTAL_UNIQUE_BENEFICIARIES", "beneficiaries"),
    ("TOTAL_CLAIMS", "total_claims"),
    ("TOTAL_PAID", "total_paid"),
)

# Registry columns and the names used here.
REGISTRY_COLUMNS = (
    ("NPI", "npi"),
    ("Entity Type Code", "entity_type"),
    ("Provider Organization Name (Legal Business Name)", "organization_name"),
    ("Provider Last Name (Legal Name)", "last_name"),
    ("Provider First Name", "first_name"),
    ("Provider Credential Text", "credential"),
    ("Provider Business Practice Location Address First Line", "address"),
    ("Provider Business Practice Location Address City Name", "city"),
    ("Provider Business Practice Location Address State Name", "practice_state"),
    ("Provider Business Practice Location Address Postal Code", "postal_code"),
    ("Healthcare Provider Primary Taxonomy Code", "taxonomy"),
    ("Provider Business Mailing Address State Name", "mailing_state"),
    ("NPI Deactivation Date", "deactivation_date"),
)
