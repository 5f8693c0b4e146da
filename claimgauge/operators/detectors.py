"""The six detectors.

Each takes a summary, or a one-row-per-provider frame measured from one, and returns a row per
finding with the numbers that decided it and a severity. A provider's findings depend only on its
own rows (the revenue baseline aside), so a scan can restrict providers after detection.

Orderings within a provider run over its months, of which the calendar allows few. Anything per
procedure code is an aggregate that combines before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgauge import fixed_values as fv
from claimgauge.config import ScanConfig
from claimgauge.functions.expressions import at_most_one, ratio
from claimgauge.functions.order_statistics import median
from claimgauge.operators.summaries import drop_providers, keep_providers
from claimgauge.sources.staging import Staging


# Volume

def volume_candidates(monthly: DataFrame, config: ScanConfig) -> DataFrame:
    """Months with more claims than one practitioner can handle."""
    severity = ratio(
        F.col("total_claims"), F.lit(config.max_claims_per_month * fv.VOLUME_SEVERITY_MONTHS)
    )
    return monthly.where(F.col("total_claims") > config.max_claims_per_month).select(
        "npi", "service_month", "total_claims", at_most_one(severity).alias("severity")
    )


def volume_findings(
    monthly: DataFrame, config: ScanConfig, excluded: DataFrame | None = None
) -> DataFrame:
    candidates = volume_candidates(monthly, config)
    return candidates if excluded is None else drop_providers(candidates, excluded)


def leading_codes(procedure: DataFrame) -> DataFrame:
    """Each provider's procedure with the most claims; equal counts go to the lower code."""
    per_code = procedure.groupBy("npi", "procedure_code").agg(
        F.sum("total_claims").alias("code_claims")
    )
    return per_code.groupBy("npi").agg(_lead_by_claims().alias("procedure_code"))


def billing_like_organizations(leading: DataFrame, config: ScanConfig) -> DataFrame:
    """Providers whose leading code is one that only organizations bill."""
    wanted = F.col("procedure_code").isin(*config.organization_codes)
    return leading.where(wanted).select("npi")


def volume_exclusions(
    procedure: DataFrame,
    config: ScanConfig,
    candidates: DataFrame,
    organizations: DataFrame | None = None,
) -> DataFrame:
    """Organizations by registry or by leading code, looked for among the candidates only."""
    concerned = keep_providers(procedure, candidates)
    excluded = billing_like_organizations(leading_codes(concerned), config)
    if organizations is None:
        return excluded
    return excluded.unionByName(organizations.select("npi")).distinct()


# Revenue per claim

def paid_per_claim(totals: DataFrame) -> DataFrame:
    return totals.where(F.col("total_claims") > 0).select(
        "npi",
        "total_paid",
        "total_claims",
        ratio(F.col("total_paid"), F.col("total_claims")).alias("paid_per_claim"),
    )


def revenue_baseline(
    totals: DataFrame, config: ScanConfig, staging: Staging | None = None
) -> DataFrame:
    """One row: the median of paid per claim and the median absolute deviation from it."""
    rates = paid_per_claim(totals)

    def middle_of(frame: DataFrame, column: str) -> DataFrame:
        return median(frame, column, config.exact_median, config.approx_accuracy, staging)

    middle = middle_of(rates, "paid_per_claim")
    apart = F.abs(F.col("paid_per_claim") - middle.scalar())
    mad = middle_of(rates.select(apart.alias("deviation")), "deviation")
    return mad.select(middle.scalar().alias("median"), F.col("median").alias("mad"))


def revenue_findings(
    totals: DataFrame,
    config: ScanConfig,
    baseline: DataFrame | None = None,
    scope: DataFrame | None = None,
) -> DataFrame:
    """Providers far above the median. Without a baseline, `totals` are all peers; `scope` only limits
    the output."""
    baseline = revenue_baseline(totals, config) if baseline is None else baseline
    scoped = paid_per_claim(totals if scope is None else keep_providers(totals, scope))
    mad = F.col("_baseline.mad")
    measured = scoped.withColumn(
        "_baseline", baseline.select(F.struct("median", "mad")).scalar()
    ).where(mad > 0).withColumn("median", F.col("_baseline.median"))
    z = (F.col("paid_per_claim") - F.col("median")) / (mad * config.mad_scale)
    return measured.withColumn("z", z).where(F.col("z") > config.revenue_z).select(
        "npi", "total_paid", "total_claims", "paid_per_claim", "median", "z",
        at_most_one(F.col("z") / fv.REVENUE_SEVERITY_Z).alias("severity"),
    )


# Spikes

def spike_findings(history: DataFrame, config: ScanConfig) -> DataFrame:
    """Months far above the provider's own mean, which includes the month itself."""
    enough = (F.col("months") >= config.spike_min_months) & (F.col("provider_paid") > 0)
    mean = ratio(F.col("provider_paid"), F.col("months"))
    measured = history.where(enough).withColumn("mean_paid", mean)
    times = ratio(F.col("total_paid"), F.col("mean_paid"))
    return measured.withColumn("ratio", times).where(
        F.col("ratio") > config.spike_multiplier
    ).select(
        "npi", "service_month", "total_paid", "mean_paid", "months", "ratio",
        at_most_one(F.col("ratio") / fv.SPIKE_SEVERITY_RATIO).alias("severity"),
    )


# Procedure mix: dominance, rates, vague codes

def code_statistics(procedure: DataFrame) -> DataFrame:
    """Per provider and procedure: sums, and mean and spread of the monthly rate per claim."""
    rate = F.when(
        F.col("total_claims") > 0, ratio(F.col("total_paid"), F.col("total_claims"))
    )
    rated = procedure.withColumn("rate", rate)
    return rated.groupBy("npi", "procedure_code").agg(
        F.sum("total_paid").alias("code_paid"),
        F.sum("total_claims").alias("code_claims"),
        F.avg("rate").alias("mean_rate"),
        F.coalesce(F.stddev_samp("rate"), F.lit(0.0)).alias("std_rate"),
        F.count("rate").alias("rate_months"),
    )


def code_profile(procedure: DataFrame, config: ScanConfig) -> DataFrame:
    """One row per provider: paid in all, paid under vague codes, leading codes by paid and claims.

    The leading code is the one with the largest share of the total. Where the total is negative
    that is the most negative sum, hence both ends are kept until the total is known.
    """
    code = F.col("procedure_code")
    paid = F.col("code_paid")
    facts = F.struct("procedure_code", "code_paid", "mean_rate", "std_rate", "rate_months")
    profile = code_statistics(procedure).groupBy("npi").agg(
        F.sum(paid).alias("total_paid"),
        F.sum(F.when(code.isin(*config.nos_codes), paid)).alias("nos_paid"),
        F.min_by(facts, F.struct(-paid, code)).alias("_largest"),
        F.min_by(facts, F.struct(paid, code)).alias("_smallest"),
        _lead_by_claims().alias("leading_code"),
    )
    total = F.col("total_paid")
    return profile.select(
        "npi", "total_paid", "nos_paid", "leading_code",
        F.when(total > 0, F.col("_largest")).when(total < 0, F.col("_smallest")).alias("dominant"),
    )


def dominant_procedures(profile: DataFrame) -> DataFrame:
    """Each provider's dominant procedure, its share of paid and the variation of its rate."""
    return profile.where(F.col("dominant").isNotNull()).select(
        "npi",
        F.col("dominant.procedure_code").alias("procedure_code"),
        ratio(F.col("dominant.code_paid"), F.col("total_paid")).alias("share"),
        F.col("dominant.mean_rate").alias("mean_rate"),
        ratio(F.col("dominant.std_rate"), F.col("dominant.mean_rate")).alias("cv"),
        F.col("dominant.rate_months").alias("months"),
    )


def consistency_findings(profile: DataFrame, config: ScanConfig) -> DataFrame:
    """One dominant procedure, paid at nearly the same rate every month."""
    uniform = (
        (F.col("share") >= config.dominance_share)
        & (F.col("months") >= config.consistency_min_months)
        & (F.col("cv") < config.rate_cv)
    )
    severity = at_most_one(F.col("share") * (F.lit(1.0) - F.col("cv")))
    return dominant_procedures(profile).where(uniform).withColumn("severity", severity)


def nos_findings(profile: DataFrame, config: ScanConfig) -> DataFrame:
    """A large share paid under codes that do not say what was billed."""
    share = ratio(F.col("nos_paid"), F.col("total_paid"))
    return profile.withColumn("share", share).where(F.col("share") >= config.nos_share).select(
        "npi", "nos_paid", "total_paid", "share",
        at_most_one(F.col("share") / fv.NOS_SEVERITY_SHARE).alias("severity"),
    )


# Level shift

def visit_halves(procedure: DataFrame, config: ScanConfig) -> DataFrame:
    """Visit claims of each provider: mean level in the earlier and in the later half of its months."""
    codes = [code for code, _ in config.visit_levels]
    levels = F.create_map(*[F.lit(x) for pair in config.visit_levels for x in pair])
    level = levels.cast("map<string,int>")[F.col("procedure_code")]
    by_month = (
        procedure.where(F.col("procedure_code").isin(*codes))
        .groupBy("npi", "service_month")
        .agg(
            F.sum("total_claims").alias("claims"),
            F.sum(level * F.col("total_claims")).alias("points"),
            F.sum("total_paid").alias("paid"),
        )
    )
    history = Window.partitionBy("npi")
    place = F.row_number().over(history.orderBy("service_month"))
    halved = by_month.withColumn("months", F.count(F.lit(1)).over(history)).withColumn(
        "early", place <= F.floor(F.col("months") / 2)
    )
    return halved.groupBy("npi").agg(
        F.max("months").alias("months"),
        F.sum("claims").alias("claims"),
        F.sum("paid").alias("paid"),
        _mean_level(F.col("early")).alias("early_level"),
        _mean_level(~F.col("early")).alias("late_level"),
    )


def upcoding_findings(halves: DataFrame, config: ScanConfig) -> DataFrame:
    """Visits that moved to higher levels."""
    enough = (F.col("claims") >= config.upcoding_min_claims) & (
        F.col("months") >= config.upcoding_min_months
    )
    measured = halves.where(enough).withColumn("shift", F.col("late_level") - F.col("early_level"))
    return measured.where(F.col("shift") >= config.upcoding_shift).select(
        "npi", "early_level", "late_level", "shift", "claims", "paid",
        at_most_one(F.col("shift") / fv.UPCODING_SEVERITY_SHIFT).alias("severity"),
    )


def _mean_level(which: Column) -> Column:
    points = F.sum(F.when(which, F.col("points")))
    claims = F.sum(F.when(which, F.col("claims")))
    return F.coalesce(ratio(points, claims), F.lit(0.0))


def _lead_by_claims() -> Column:
    return F.min_by("procedure_code", F.struct(-F.col("code_claims"), "procedure_code"))
