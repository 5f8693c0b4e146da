"""The driver's tables seen as claims, registry, code descriptions and service answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimgauge import config as C
from claimgauge import fixed_values as fv
from claimgauge.schema import MONEY

# Parameters under which these tables give findings of every kind.
CONFIG = C.ScanConfig(
    min_total_paid=1_000_000,
    max_claims_per_month=100,
    spike_multiplier=3.0,
    dominance_share=0.25,
    rate_cv=0.40,
    nos_codes=("PROMO",),
    visit_levels=(("ECONOMY", 1), ("SMALL", 2), ("STANDARD", 3), ("MEDIUM", 4), ("LARGE", 5)),
    organization_codes=("STANDARD",),
)
FOUR_SIGNAL = C.ScanConfig(**{
    **CONFIG.__dict__, "weights": C.FOUR_SIGNAL, "flag_types": fv.FOUR_SIGNAL_FLAGS,
})
STATE = "NATION_3"
ZIP_PREFIXES = ("000", "001", "002", "003")
NAME_QUERY = "customer#00000012"
ONE_PROVIDER = "20"
FLAGGED_PROVIDER = "120"
REVENUE_STATE = "NATION_14"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def claims(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    parts = table(spark, folder, "part").select("p_partkey", "p_type")
    # Orders are unique and few beside their lines, which this saves from being sorted.
    joined = lines.join(orders.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey")).join(
        parts, F.col("l_partkey") == F.col("p_partkey")
    )
    paid = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return joined.select(
        F.col("o_custkey").cast("string").alias("npi"),
        F.col("l_suppkey").cast("string").alias("servicing_npi"),
        F.col("p_type").alias("procedure_code"),
        F.trunc("l_shipdate", "month").alias("service_month"),
        F.lit(1).cast("bigint").alias("beneficiaries"),
        F.col("l_quantity").cast("bigint").alias("total_claims"),
        paid.cast(MONEY).alias("total_paid"),
    )


def raw_claims(spark: SparkSession, folder: str) -> DataFrame:
    """The same claims under their raw names, as a publisher would deliver them."""
    internal = claims(spark, folder)
    return internal.select(*[
        F.col(name).cast("bigint").alias(raw) if name.endswith("npi") else F.col(name).alias(raw)
        for raw, name in fv.CLAIM_COLUMNS
    ])


def registry(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer")
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    joined = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    organization = F.col("c_mktsegment") == "BUILDING"
    key = F.col("c_custkey").cast("string")
    return joined.select(
        key.alias("npi"),
        F.when(organization, "2").otherwise("1").alias("entity_type"),
        F.when(organization, F.col("c_name")).alias("organization_name"),
        F.when(~organization, F.col("c_name")).alias("last_name"),
        F.when(F.col("c_custkey") % 10 == 0, "").otherwise(F.col("n_name")).alias("practice_state"),
        F.col("n_name").alias("mailing_state"),
        F.concat(_padded(key, 5), F.lit("1234")).alias("postal_code"),
        F.when(F.col("c_acctbal") < 0, "2020-01-01").otherwise("").alias("deactivation_date"),
    )


def descriptions(spark: SparkSession, folder: str) -> DataFrame:
    """A text for every code that occurs but one."""
    codes = table(spark, folder, "part").select("p_type").distinct()
    return codes.where(F.col("p_type") != "PROMO").select(
        F.concat(F.lit(" "), F.lower("p_type")).alias("code"),
        F.concat(F.lit("Items of type "), F.lower("p_type")).alias("description"),
    )


def service_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Registry rows as the answers a registry service would give; every seventh is unknown."""
    rows = registry(spark, folder)
    organization = F.col("entity_type") == "2"
    address = F.struct(
        F.lit("LOCATION").alias("address_purpose"),
        F.concat(F.col("npi"), F.lit(" Main St")).alias("address_1"),
        F.col("mailing_state").alias("state"),
        F.col("postal_code").alias("postal_code"),
    )
    mailing = address.withField("address_purpose", F.lit("MAILING")).withField(
        "address_1", F.lit("PO Box")
    )
    result = F.struct(
        F.concat(F.lit("NPI-"), F.col("entity_type")).alias("enumeration_type"),
        F.struct(
            F.col("organization_name"),
            F.when(~organization, F.lit("Pat")).alias("first_name"),
            F.col("last_name"),
            F.when(~organization, F.lit("MD")).alias("credential"),
        ).alias("basic"),
        F.array(mailing, address).alias("addresses"),
        F.array(
            F.struct(F.lit(False).alias("primary"), F.lit("Other").alias("desc")),
            F.struct(F.lit(True).alias("primary"), F.col("practice_state").alias("desc")),
        ).alias("taxonomies"),
    )
    known = F.col("npi").cast("bigint") % 7 != 0
    answer = F.struct(
        F.when(known, 1).otherwise(0).alias("result_count"),
        F.when(known, F.array(result)).otherwise(F.array()).alias("results"),
    )
    return rows.select("npi", F.to_json(answer).alias("payload"))


def comparable(frame: DataFrame) -> DataFrame:
    """Money to 4 and other fractions to 6 places as doubles, whole numbers as bigint, dates as text.

    Fractions pass through 10 decimal places first, so that noise in the last bits of a double
    does not decide which way a tie is rounded.
    """
    return frame.select(*[_plain(field).alias(field.name) for field in frame.schema])


def _plain(field: T.StructField) -> Column:
    value = F.col(field.name)
    if isinstance(field.dataType, T.DecimalType):
        return F.round(value.cast("double"), 4)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return F.round(value.cast("decimal(38,10)"), 6).cast("double")
    if isinstance(field.dataType, (T.IntegralType, T.BooleanType)):
        return value.cast("bigint")
    if isinstance(field.dataType, T.DateType):
        return value.cast("string")
    if isinstance(field.dataType, T.ArrayType):
        return F.array_join(value, ", ")
    return value


def _padded(key: Column, length: int) -> Column:
    return F.lpad(key, length, "0")
