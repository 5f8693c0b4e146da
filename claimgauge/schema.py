"""Declared schemas. Nothing is inferred: inference would read code 00100 as 100."""

from pyspark.sql import types as T

from claimgauge import fixed_values as fv

MONEY = T.DecimalType(18, 4)
MONEY_SUM = T.DecimalType(28, 4)

_CLAIM_TYPES = {
    "npi": T.StringType(),
    "servicing_npi": T.StringType(),
    "procedure_code": T.StringType(),
    "service_month": T.DateType(),
    "beneficiaries": T.LongType(),
    "total_claims": T.LongType(),
    "total_paid": MONEY,
}

CLAIMS = T.StructType([T.StructField(name, _CLAIM_TYPES[name]) for _, name in fv.CLAIM_COLUMNS])

FLAGS = T.StructType([
    T.StructField("npi", T.StringType()),
    T.StructField("flag_type", T.StringType()),
    T.StructField("service_month", T.DateType()),
    T.StructField("description", T.StringType()),
    T.StructField("severity", T.DoubleType()),
    T.StructField("evidence_json", T.StringType()),
])

REGISTRY_NAMES = tuple(name for _, name in fv.REGISTRY_COLUMNS)

# The parts of a registry service answer that are used.
REGISTRY_ANSWER = T.StructType([
    T.StructField("result_count", T.LongType()),
    T.StructField("results", T.ArrayType(T.StructType([
        T.StructField("enumeration_type", T.StringType()),
        T.StructField("basic", T.StructType([
            T.StructField("organization_name", T.StringType()),
            T.StructField("first_name", T.StringType()),
            T.StructField("middle_name", T.StringType()),
            T.StructField("last_name", T.StringType()),
            T.StructField("credential", T.StringType()),
        ])),
        T.StructField("addresses", T.ArrayType(T.StructType([
            T.StructField("address_purpose", T.StringType()),
            T.StructField("address_1", T.StringType()),
            T.StructField("city", T.StringType()),
            T.StructField("state", T.StringType()),
            T.StructField("postal_code", T.StringType()),
        ]))),
        T.StructField("taxonomies", T.ArrayType(T.StructType([
            T.StructField("primary", T.BooleanType()),
            T.StructField("desc", T.StringType()),
        ]))),
    ]))),
])

# A scan answer as it is stored. The evidence keys differ per flag type, so it is a variant.
SCAN_PAYLOAD = T.StructType([
    T.StructField("total", T.LongType()),
    T.StructField("providers", T.ArrayType(T.StructType([
        T.StructField("npi", T.StringType()),
        T.StructField("overall_score", T.DoubleType()),
        T.StructField("num_flags", T.LongType()),
        T.StructField("flag_types", T.ArrayType(T.StringType())),
        T.StructField("red_flags", T.ArrayType(T.StructType([
            T.StructField("flag_type", T.StringType()),
            T.StructField("description", T.StringType()),
            T.StructField("severity", T.DoubleType()),
            T.StructField("evidence", T.VariantType()),
        ]))),
    ]))),
    T.StructField("params", T.StructType([
        T.StructField("threshold", T.DoubleType()),
        T.StructField("top", T.LongType()),
        T.StructField("state", T.StringType()),
    ])),
])
